"""Keyed hashes: the only source of randomness in the package.

The digest is MD5 of ``seed:part:part`` so the same numbers can be produced by any SQL engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int | str | Column, *parts: str | Column) -> Column:
    """32 hex digits that order rows in a repeatable random way."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    cols = [head, *[F.col(p) if isinstance(p, str) else p for p in parts]]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary"))


def hash_bucket(key: Column, digits: int = 3) -> Column:
    """Leading hex digits of a hash key: an evenly filled bucket that keeps the key's order."""
    return F.substring(key, 1, digits)


def _unit(key: Column, start: int) -> Column:
    return F.conv(F.substring(key, start, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(seed: int | str | Column, *parts: str | Column) -> Column:
    """Uniform number in [0, 1) for a key."""
    return _unit(hash_key(seed, *parts), 1)


def uniform_pair(seed: int | str | Column, *parts: str | Column) -> tuple[Column, Column]:
    """Two independent uniform numbers taken from one digest."""
    key = hash_key(seed, *parts)
    return _unit(key, 1), _unit(key, 9)


def normal(seed: int | str | Column, *parts: str | Column) -> Column:
    """Standard normal number for a key (Box-Muller)."""
    first, second = uniform_pair(seed, *parts)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - first)) * F.cos(F.lit(2.0 * math.pi) * second)
