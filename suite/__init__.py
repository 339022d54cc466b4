"""Registered queries over the test tables, each next to the SQL that must agree with it."""

from __future__ import annotations

from suite import bags, evaluation, manifests, scoring, splits, stores

MODULES = (manifests, splits, bags, evaluation, scoring, stores)


def all_queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
