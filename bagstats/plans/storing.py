"""Patches to a published store: restrict, check completeness, skip when nothing changed, write."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagstats.operators.bags import CAPS
from bagstats.operators.coverage import coverage_of_index
from bagstats.operators.manifest import restrict_to_manifest
from bagstats.operators.quality import completeness, order_free_fingerprint, source_identity
from bagstats.sources.shared import NOT_THERE
from bagstats.sources.store import write_patch_store
from bagstats.sources.tables import write_coverage_stats


@dataclass(frozen=True)
class StoreConfig:
    cap: int | None = None
    strategy: str = "spatial_sqrt"
    grid: int = 32
    seed: int = 42
    n_shards: int = 64
    max_records_per_file: int = 1_000_000
    require_all: bool = True

    def __post_init__(self) -> None:
        if self.cap is not None and self.cap <= 0:
            raise ValueError(f"cap must be positive, got {self.cap}")
        if self.strategy not in CAPS:
            raise ValueError(f"Unknown cap strategy '{self.strategy}'. Must be one of: {sorted(CAPS)}")
        if self.grid <= 0 or self.n_shards <= 0 or self.max_records_per_file <= 0:
            raise ValueError(f"grid, n_shards and max_records_per_file must be positive: {self}")

    def cap_options(self) -> dict:
        if self.strategy == "first":
            return {}
        return {"seed": self.seed} if self.strategy == "random" else {"seed": self.seed, "grid": self.grid}


def _same_source(mark: DataFrame, path: str) -> bool:
    try:
        stored = mark.sparkSession.read.json(f"{path}/source").first()
    except AnalysisException as missing:
        if missing.getCondition() not in NOT_THERE:
            raise
        return False
    return stored is not None and stored["fingerprint"] == mark.first()["fingerprint"]


def _mark(patches: DataFrame, manifest: DataFrame | None, config: StoreConfig) -> DataFrame:
    """The files the patches are read from, the wanted slides and the settings."""
    mark = source_identity(patches, asdict(config))
    if manifest is None:
        return mark
    column = "slide_id" if "slide_id" in manifest.columns else "filename"
    wanted = order_free_fingerprint(manifest.select(column).distinct(), [column], 20).select("fingerprint")
    return mark.select(F.concat_ws("-", "fingerprint", wanted.scalar()).alias("fingerprint"))


def build_store(
    patches: DataFrame, path: str, config: StoreConfig, manifest: DataFrame | None = None
) -> dict[str, DataFrame] | None:
    """Write the store and its reports; None when the stored source mark still matches.

    The mark of patches that are read from files holds names, sizes and times of these, the listed slides and the settings:
    the check reads no column of the patches, and files that were written anew are seen whatever changed in them.
    """
    spark = patches.sparkSession
    mark = _mark(patches, manifest, config)
    if _same_source(mark, path):
        return None
    wanted = restrict_to_manifest(patches, manifest) if manifest is not None else patches
    reports = {}
    if manifest is not None:
        report = completeness(manifest.select("slide_id"), wanted.select("slide_id"), config.require_all)
        row = report.first()
        if not row["complete"]:
            raise ValueError(f"{row['missing']} of {row['total']} manifest slides have no patches")
        reports["completeness"] = report
    reports["violations"] = write_patch_store(
        wanted,
        path,
        config.cap,
        config.strategy,
        config.max_records_per_file,
        config.n_shards,
        **(config.cap_options() if config.cap else {}),
    )
    reports["coverage"] = coverage_of_index(spark.read.parquet(f"{path}/index"))
    write_coverage_stats(reports["coverage"], f"{path}/coverage")
    mark.write.mode("errorifexists").json(f"{path}/source")
    return reports
