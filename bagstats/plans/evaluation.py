"""Predictions to an evaluation report: a set of tables, each lazy until it is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagstats.functions.probs import prob_columns, with_probs
from bagstats.operators import bootstrap as BS
from bagstats.operators import calibration as CAL
from bagstats.operators import confusion as CM
from bagstats.operators import ranking as R
from bagstats.operators import summaries as SU
from bagstats.operators.manifest import attach_patient
from bagstats.operators.quality import no_nans, subgroup_counts
from bagstats.operators.scores import class_rows, patient_aggregate
from bagstats.sources.tables import write_report


@dataclass(frozen=True)
class EvaluationConfig:
    n_classes: int = 2
    n_bins: int = 10
    n_bootstrap: int = 2000
    alpha: float = 0.05
    seed: int = 42
    threshold: float | None = None  # base of the stability table; None takes the Youden point of the predictions
    resampling: str = "poisson"  # "exact" joins n draws of n units for each repeat
    patient_col: str = "patient_id"

    def __post_init__(self) -> None:
        if self.n_classes < 2 or self.n_bins < 1 or not 0 < self.alpha < 1:
            raise ValueError(f"Invalid evaluation settings: {self}")


def evaluate_folds(preds: DataFrame, manifest: DataFrame | None, config: EvaluationConfig) -> dict[str, DataFrame]:
    """Out-of-fold predictions: counts, suites per fold and pooled, statistics over folds."""
    rows = attach_patient(preds, manifest, config.patient_col)
    suites = SU.per_fold_and_pooled(rows, config.n_classes, config.patient_col)
    per_fold = suites.filter((F.col("scope") != "pooled") & F.col("class_id").isNull())
    return {
        "counts": subgroup_counts(rows, patient_col=config.patient_col),
        "metrics": suites,
        "fold_summary": SU.fold_metric_summary(per_fold, ["level", "metric"]),
    }


def evaluate_model(preds: DataFrame, manifest: DataFrame | None, config: EvaluationConfig) -> dict[str, DataFrame]:
    """One model on held-out slides: metrics, intervals, calibration, curves, operating points; patients too.

    Two classes may come as ``prob_1``, as ``prob_0, prob_1`` or as a vector: all get every binary table.
    """
    rows = attach_patient(preds, manifest, config.patient_col)
    patients = patient_aggregate(with_probs(rows).select("slide_id", config.patient_col, "label", "probs"), (), config.patient_col, config.n_classes)
    binary = prob_columns(rows) == ["prob_1"] and "probs" not in rows.columns
    out = {
        "metrics": SU.metrics_suite(rows, config.n_classes),
        "confusion": CM.confusion_matrix(rows, config.n_classes, normalize=True),
        "patient_metrics": SU.metrics_suite(patients, config.n_classes),
        "patient_confusion": CM.confusion_matrix(patients, config.n_classes, normalize=True),
        "calibration_bins": CAL.calibration_bins(rows, config.n_bins),
        "brier_per_class": CAL.brier_per_class(rows, config.n_classes),
    }
    out["ece"] = CAL.ece(out["calibration_bins"])
    if config.n_classes == 2:
        scored = rows if binary else with_probs(rows).withColumn("prob_1", F.col("probs")[1]).drop("probs", "prob_0")
        out["brier"] = CAL.brier(scored) if binary else CAL.brier_multiclass(rows)
        out["roc"] = R.roc_curve(scored)
        out["precision_recall"] = R.pr_curve(scored)
        out["average_precision"] = R.average_precision(scored)
        out["operating_points"] = R.operating_points(scored)
        base = config.threshold
        if base is None:
            youden = out["operating_points"].filter("point = 'youdens_j'").select("threshold").first()
            base = 0.5 if youden is None or youden.threshold is None else min(1.0, youden.threshold)
        out["threshold_stability"] = CAL.threshold_stability(scored, base)
        out["checks"] = no_nans(scored)
    else:
        one_vs_rest = class_rows(rows, config.n_classes)
        key = (["class_id"], "score", "positive")
        out["brier"] = CAL.brier_multiclass(rows)
        out["roc"] = R.roc_curve(one_vs_rest, *key)
        out["precision_recall"] = R.pr_curve(one_vs_rest, *key)
        out["average_precision"] = R.average_precision(one_vs_rest, *key)
        out["operating_points"] = R.operating_points(one_vs_rest, *key)
    out["intervals"] = BS.metrics_with_ci(
        scored if config.n_classes == 2 else rows,
        config.n_bootstrap, config.alpha, config.seed, config.patient_col, config.resampling, config.n_classes,
    )
    return out


def evaluate(
    oof: DataFrame, held_out: DataFrame | None, manifest: DataFrame | None, config: EvaluationConfig
) -> dict[str, DataFrame]:
    """Fold report, and a model report only when held-out predictions exist.

    Held-out results never choose anything; they are only reported.
    """
    out = {f"oof_{k}": v for k, v in evaluate_folds(oof, manifest, config).items()}
    if held_out is not None:
        out.update({f"held_out_{k}": v for k, v in evaluate_model(held_out, manifest, config).items()})
    return out


def write_evaluation(reports: dict[str, DataFrame], path: str) -> None:
    """Every table of a report as JSON lines in its own folder."""
    for name, table in reports.items():
        write_report(table, f"{path}/{name}")
