"""Manifest to stored splits, with reuse of an existing result made by the same settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagstats.operators import splits as S
from bagstats.operators.manifest import missing_features
from bagstats.sources import tables as T
from bagstats.sources.shared import NOT_THERE


@dataclass(frozen=True)
class SplitConfig:
    """Settings of a split; only those of its scheme are used."""

    scheme: str
    filename_col: str = "filename"
    label_col: str = "label"
    group_col: str | None = None
    site_col: str | None = None
    seed: int = 42
    n_folds: int = 5
    n_repeats: int = 5
    train: float | None = None
    val: float | None = None
    test: float | None = None
    test_filter: str | None = None
    val_filter: str | None = None

    def __post_init__(self) -> None:
        if self.scheme not in S.SCHEME_COLUMNS:
            raise ValueError(f"Unknown scheme '{self.scheme}'. Must be one of: {sorted(S.SCHEME_COLUMNS)}")
        if self.scheme in ("holdout", "monte_carlo"):
            S.check_ratios(self.train, self.val, self.test)
        if self.scheme.startswith("custom") and not self.test_filter:
            raise ValueError(f"{self.scheme} requires test_filter")
        if "kfold" in self.scheme and self.n_folds < 2:
            raise ValueError(f"n_folds must be at least 2, got {self.n_folds}")

    def identity(self) -> str:
        """Canonical text of the settings."""
        return json.dumps(asdict(self), sort_keys=True)

    def arguments(self) -> dict:
        every = {
            "holdout": {"train": self.train, "val": self.val, "test": self.test},
            "kfold": {"n_folds": self.n_folds, "test_ratio": self.test},
            "custom_holdout": {
                "test_filter": self.test_filter,
                "val_filter": self.val_filter,
                "val_ratio": self.val,
                "train_ratio": self.train,
            },
            "custom_kfold": {"test_filter": self.test_filter, "n_folds": self.n_folds, "val_filter": self.val_filter},
            "monte_carlo": {"n_repeats": self.n_repeats, "train": self.train, "val": self.val, "test": self.test},
        }
        return {**every[self.scheme], "seed": self.seed}


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.json(f"{path}/identity").schema  # noqa: B018
    except AnalysisException as missing:
        if missing.getCondition() not in NOT_THERE:
            raise
        return False
    return True


def make_splits(
    spark: SparkSession,
    manifest_path: str,
    path: str,
    config: SplitConfig,
    force: bool = False,
    features: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Read, split, store; returns the splits and report tables.

    An existing result is reused when settings and contents still match and
    refused otherwise, unless ``force`` replaces it.
    """
    manifest = T.read_manifest(
        spark, manifest_path, config.filename_col, config.label_col, config.group_col, config.site_col
    )
    if force or not _exists(spark, path):
        raw = S.generate(manifest, config.scheme, **config.arguments())
        site = "site" if config.site_col else None
        named = S.finalize_split_columns(raw, config.scheme, site_col=site)
        T.write_splits(named, path, manifest, config.identity(), overwrite=force)
    stored = T.read_splits(spark, path, manifest, config.identity())
    reports = {"splits": stored, "summary": S.split_summary(stored)}
    if config.site_col:
        part = "fold" if "fold" in stored.columns else "split"
        reports["site_balance"] = S.site_balance(stored, "site", part)
    if features is not None:
        reports["missing_features"] = missing_features(manifest, features)
    if "kfold" in config.scheme:
        reports["small_labels"] = S.small_labels(stored.filter(F.col("fold") != S.TEST_FOLD), config.n_folds)
    return reports
