"""Scoring bags with stored weights: patch layers, attention, pooling, classifier.

Only matrix products run in Python, as vectorised pandas UDFs over Arrow batches of the
one column they need, patches or slide vectors; pooling stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagstats.functions.probs import array_total, probs_from_logits, softmax, top_class
from bagstats.operators.bags import assemble_bags, cap_first_k, class_weights
from bagstats.operators.pooling import attention_pool
from bagstats.sources.shared import written

Layer = tuple[np.ndarray, np.ndarray]  # weight [out, in] and bias [out]


@dataclass(frozen=True)
class Attention:
    """Weights of one attention head; ``gate`` is the sigmoid branch or None."""

    tanh: Layer
    out: Layer
    gate: Layer | None = None


@dataclass(frozen=True)
class BagModel:
    """Patch layers, one or more attention heads, projection of several heads, classifier head."""

    head: Layer
    patch_layers: Sequence[Layer] = ()
    attention: Sequence[Attention] = field(default_factory=tuple)
    projection: Layer | None = None

    @property
    def in_dim(self) -> int:
        first = self.patch_layers[0] if self.patch_layers else self.attention[0].tanh
        return int(first[0].shape[1])


def _checked(features: str, dim: int, per: str = "patch") -> Column:
    """The vector, or an error that names the dimension found."""
    text = F.concat(F.lit(f"expected {dim} features per {per}, got "), F.coalesce(F.size(features).cast("string"), F.lit("none")))
    values = F.col(features).cast("array<double>")
    return F.when(F.size(features) == dim, values).otherwise(F.raise_error(text).cast("array<double>"))


def _layers_udf(layers: Sequence[Layer], last_linear: bool) -> Callable[[Column], Column]:
    parts = [(np.asarray(w, dtype=np.float64), np.asarray(b, dtype=np.float64)) for w, b in layers]

    def run(rows: pd.Series) -> pd.Series:
        if len(rows) == 0:
            return pd.Series([], dtype=object)
        h = np.vstack(rows.to_numpy())
        for i, (w, b) in enumerate(parts):
            h = h @ w.T + b
            if not (last_linear and i == len(parts) - 1):
                h = np.maximum(h, 0.0)
        return pd.Series(list(h))

    return F.pandas_udf(run, "array<double>")


def patch_mlp(patches: DataFrame, layers: Sequence[Layer], end_with_fc: bool = False) -> DataFrame:
    """Linear + ReLU stack on every patch; with ``end_with_fc`` the last layer stays linear."""
    dim = int(layers[0][0].shape[1])
    return patches.withColumn("features", _layers_udf(layers, end_with_fc)(_checked("features", dim)))


def _attention_udf(heads: Sequence[Attention]) -> Callable[[Column], Column]:
    def pair(layer: Layer) -> Layer:
        return np.asarray(layer[0], dtype=np.float64), np.asarray(layer[1], dtype=np.float64)

    parts = [(pair(h.tanh), pair(h.gate) if h.gate is not None else None, pair(h.out)) for h in heads]

    def run(rows: pd.Series) -> pd.Series:
        if len(rows) == 0:
            return pd.Series([], dtype=object)
        x = np.vstack(rows.to_numpy())
        columns = []
        for (wt, bt), gate, (wo, bo) in parts:
            a = np.tanh(x @ wt.T + bt)
            if gate is not None:
                a = a / (1.0 + np.exp(-(x @ gate[0].T + gate[1])))
            columns.append((a @ wo.T + bo)[:, 0])
        return pd.Series(list(np.stack(columns, axis=1)))

    return F.pandas_udf(run, "array<double>")


def attention_logits(patches: DataFrame, heads: Attention | Sequence[Attention]) -> DataFrame:
    """Add attention scores per patch: ``logits`` per head and their mean ``logit``."""
    many = [heads] if isinstance(heads, Attention) else list(heads)
    dim = int(many[0].tanh[0].shape[1])
    scored = patches.withColumn("logits", _attention_udf(many)(_checked("features", dim)))
    return scored.withColumn("logit", array_total(F.col("logits")) / F.lit(len(many)))


def _dense(name: str, weight: np.ndarray, bias: np.ndarray) -> Column:
    """One linear layer on a vector column as a matrix product: weights travel with the task and not in the plan."""
    layer = (np.asarray(weight, dtype=np.float64), np.asarray(bias, dtype=np.float64))
    return _layers_udf([layer], last_linear=True)(_checked(name, int(layer[0].shape[1]), "vector"))


def multihead_attention_pool(
    patches: DataFrame, heads: Sequence[Attention], projection: Layer | None = None
) -> DataFrame:
    """Pool once per head, put the head vectors side by side, project them if asked."""
    rows = attention_logits(patches, heads).select(
        "slide_id", "features", F.posexplode("logits").alias("head", "head_logit")
    )
    pooled = attention_pool(rows, "head_logit", by=["slide_id", "head"])
    item = F.struct("head", "embedding")  # one entry per head
    out = pooled.groupBy("slide_id").agg(
        F.max("n_patches").alias("n_patches"), F.array_sort(F.collect_list(item)).alias("heads")
    )
    out = out.select("slide_id", "n_patches", F.flatten(F.transform("heads", lambda h: h["embedding"])).alias("embedding"))
    if projection is None:
        return out
    return out.withColumn("embedding", _dense("embedding", *projection))


def classify(embeddings: DataFrame, weight: np.ndarray, bias: np.ndarray) -> DataFrame:
    """Linear head on slide vectors: logits, probabilities, best class and its probability."""
    out = embeddings.withColumn("logits", _dense("embedding", weight, bias))
    z = F.col("logits")
    soft = F.when(F.size(z) == 2, softmax(z)).otherwise(probs_from_logits(z))
    out = out.withColumn("probabilities", soft)
    best = top_class("probabilities")
    return out.select("*", best["pred_class"].alias("pred_class"), best["pred_prob"].alias("pred_prob"))


def score_bags(
    patches: DataFrame,
    model: BagModel | Callable[[np.ndarray], dict],
    max_instances: int | None = None,
) -> DataFrame:
    """Batch prediction per slide: embedding, logits, probabilities, class, patch count.

    A callable is given one bag matrix at a time and returns ``logits`` and
    ``embedding``; it needs ``max_instances``, because it must hold a bag whole.
    """
    if not isinstance(model, BagModel):
        return _score_with_function(patches, model, max_instances)
    rows = patches if max_instances is None else cap_first_k(patches, max_instances)
    rows = patch_mlp(rows, model.patch_layers) if model.patch_layers else rows
    if len(model.attention) == 1:
        pooled = attention_pool(attention_logits(rows, model.attention))
    else:
        pooled = multihead_attention_pool(rows, model.attention, model.projection)
    return classify(pooled, *model.head)


def _score_with_function(patches: DataFrame, predict: Callable[[np.ndarray], dict], cap: int | None) -> DataFrame:
    if cap is None:
        raise ValueError("max_instances is required with a predict function")
    bags = assemble_bags(patches, cap, pad=False).select("slide_id", "length", "features")
    kind = dict(bags.dtypes)["slide_id"]

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            found = [predict(np.vstack(rows)) for rows in batch["features"]]
            yield pd.DataFrame(
                {
                    "slide_id": batch["slide_id"],
                    "n_patches": batch["length"].astype("int64"),
                    "embedding": [np.asarray(r["embedding"], dtype=float).ravel().tolist() for r in found],
                    "logits": [np.asarray(r["logits"], dtype=float).ravel().tolist() for r in found],
                }
            )

    schema = f"slide_id {kind}, n_patches bigint, embedding array<double>, logits array<double>"
    out = bags.mapInPandas(run, schema)
    z = F.col("logits")
    out = out.withColumn("probabilities", F.when(F.size(z) == 1, probs_from_logits(z)).otherwise(softmax(z)))
    best = top_class("probabilities")
    return out.select("*", best["pred_class"].alias("pred_class"), best["pred_prob"].alias("pred_prob"))


def linear_probe_cv(
    embeddings: DataFrame, roles: DataFrame, n_folds: int, label_col: str = "label", max_iter: int = 100
) -> DataFrame:
    """Out-of-fold predictions of a class-weighted linear classifier on slide vectors.

    Each fold is one distributed fit; the loop is over the few folds only.  The slide
    vectors are written once, so no fold pools the patches again.
    """
    vectors = embeddings.select("slide_id", F.col(label_col).cast("double").alias("label"), "embedding")
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    data = written(vectors, "probe").select("slide_id", "label", vector.alias("x"))
    out = None
    for fold in range(n_folds):
        part = roles.filter(F.col("fold") == fold).select("slide_id", "role").join(data, "slide_id")
        train = class_weights(part.filter("role = 'train'"), "label")
        probe = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=max_iter)
        scored = probe.fit(train).transform(part.filter("role = 'val'"))
        fold_out = scored.select(
            F.lit(fold).alias("fold"),
            "slide_id",
            F.col("label").cast("int").alias("label"),
            vector_to_array("probability").alias("probs"),
        )
        out = fold_out if out is None else out.unionByName(fold_out)
    return out
