"""Logical slide identifiers built with native string expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that are removed from a slide file name.
SLIDE_SUFFIXES = (
    ".bif",
    ".h5",
    ".mrxs",
    ".ndpi",
    ".npy",
    ".npz",
    ".parquet",
    ".pt",
    ".scn",
    ".sdpc",
    ".svs",
    ".tif",
    ".tiff",
    ".vsi",
)
_SUFFIX_PATTERN = r"(?i)\.(" + "|".join(s[1:] for s in SLIDE_SUFFIXES) + ")$"


def _column(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_slide_suffix(col: str | Column) -> Column:
    """Remove one known suffix, in any letter case; other dots stay."""
    return F.regexp_replace(_column(col), _SUFFIX_PATTERN, "")


def normalize_slide_id(col: str | Column, root: str | None = None) -> Column:
    """Extension-free id with forward slashes.

    An absolute path becomes relative to ``root`` when it lies below it, and its
    last component otherwise.
    """
    raw = F.replace(F.trim(_column(col).cast("string")), F.lit("\\"), F.lit("/"))
    base_name = F.element_at(F.split(F.rtrim(raw, F.lit("/")), "/"), -1)
    absolute = base_name
    if root is not None:
        prefix = root.rstrip("/") + "/"
        absolute = F.when(raw.startswith(prefix), F.substring(raw, len(prefix) + 1, 1 << 30)).otherwise(base_name)
    relative = F.when(raw.startswith("/"), absolute).otherwise(raw)
    return strip_slide_suffix(F.regexp_replace(relative, r"^\./", ""))


def slide_id_from_path(col: str | Column, root: str) -> Column:
    """Path below ``root`` without its last extension; a URI scheme in front of the path is ignored."""
    path = F.regexp_replace(_column(col), r"^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/")
    prefix = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/", root).rstrip("/") + "/"
    below = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
    return F.regexp_replace(below, r"\.[^./]+$", "")


def path_from_slide_id(col: str | Column, root: str, extension: str = ".h5") -> Column:
    """File of a slide below ``root``: the inverse of :func:`slide_id_from_path`."""
    return F.concat(F.lit(root.rstrip("/") + "/"), _column(col), F.lit(extension))


def parse_best_epoch(col: str | Column) -> Column:
    """Epoch (counted from one) named in a checkpoint file such as ``epoch=12-step=500.ckpt``."""
    name = F.element_at(F.split(_column(col), "/"), -1)
    found = F.regexp_extract(name, r"epoch=(\d+)", 1)
    return F.when(found != "", found.cast("int") + 1)
