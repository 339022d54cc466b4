"""Caps, crops, augmentation, assembly, batching and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagstats.operators import bags as B
from bagstats.operators import coverage as C
from bagstats.sources import store
from suite import views as V
from suite.sql import key, uniform, with_views

K = 200
GRID = 16
_ID = ["slide_id", "patch_idx"]


def _narrow(spark, sf):
    return V.stored_patches(spark, sf, *_ID, "x", "y")


def first_k(spark, sf):
    return B.cap_first_k(_narrow(spark, sf), K).select(*_ID)


def _gappy(spark, sf, *more):
    """A third of the patches is gone, so positions and ``patch_idx`` differ."""
    return V.stored_patches(spark, sf).filter("patch_idx % 3 <> 0").select(*_ID, *more)


def first_k_gaps(spark, sf):
    return B.cap_first_k(_gappy(spark, sf), K)


def random_k(spark, sf):
    return B.cap_random_k(_narrow(spark, sf), K, 42).select(*_ID)


def sqrt_cap(spark, sf):
    return B.cap_spatial_sqrt(_narrow(spark, sf), K, GRID, 42).select(*_ID)


def sqrt_fine(spark, sf):
    """A grid with more occupied cells than the budget: plain random selection."""
    return B.cap_spatial_sqrt(_narrow(spark, sf), K, 64, 42).select(*_ID)


def proportional_cap(spark, sf):
    return B.cap_spatial_proportional(_narrow(spark, sf), K, GRID, 0).select(*_ID)


def even_cap(spark, sf):
    return B.cap_spatial_even(_narrow(spark, sf), K, 12, 42).select(*_ID)


def crops(spark, sf):
    return B.multi_crop(_narrow(spark, sf), 3, 50).select("crop", *_ID)


def dropout(spark, sf):
    return B.instance_dropout(_narrow(spark, sf), 0.9, 7).select(*_ID)


def noise(spark, sf):
    noisy = B.feature_noise(V.embed_patches(spark, sf), 0.1, 42)
    return noisy.select(*_ID, F.posexplode("features").alias("pos", "value")).select(
        *_ID, "pos", F.round(F.col("value").cast("double"), 5).alias("value")
    )


def assembled(spark, sf):
    """Every padded position of every bag, one row each."""
    bags = B.assemble_bags(V.stored_patches(spark, sf), 64, width=80)
    rows = bags.select("slide_id", "length", F.posexplode("mask").alias("pos", "mask"), "features", "coords")
    at = F.col("pos") + 1
    return rows.select(
        "slide_id",
        "length",
        "pos",
        "mask",
        F.element_at("features", at)[1].alias("f1"),
        F.element_at("coords", at)[0].alias("x"),
        F.element_at("coords", at)[1].alias("y"),
    )


def assembled_after_cap(spark, sf):
    """A random cap keeps scattered patch numbers; all of them must be in the bag."""
    bags = B.assemble_bags(B.cap_random_k(V.stored_patches(spark, sf), K, 42), K, pad=False)
    total = F.aggregate("coords", F.lit(0).cast("bigint"), lambda a, c: a + c[0] + c[1])
    return bags.select("slide_id", "length", total.alias("coord_sum"))


def assembled_batches(spark, sf):
    """Bags of unequal length padded to the longest of their batch."""
    patches = _gappy(spark, sf, "features", "x", "y").filter("patch_idx % 7 < slide_id % 7 + 1")
    slides = patches.select("slide_id").distinct()
    batches = slides.select("slide_id", F.lit(0).alias("bucket"), F.floor(F.col("slide_id") / 4).alias("batch_no"))
    out = B.assemble_batches(patches, batches, 150)
    real = F.aggregate("mask", F.lit(0), lambda a, m: a + m)
    return out.select("slide_id", "batch_no", "length", F.size("features").alias("width"), F.size("coords").alias("n_coords"), real.alias("n_real"))


def pack_sizes(spark, sf):
    rows = store.pack_by_size(_order_index(spark, sf), 100)
    sums = rows.groupBy("pack").agg(F.count(F.lit(1)).alias("n_bags"), F.sum("est_bytes").alias("bytes"))
    return sums.withColumn("over", (F.col("n_bags") > 1) & (F.col("bytes") > 100))


def resampled(spark, sf):
    return B.weighted_resample(V.manifest(spark, sf).select("slide_id", "label"), 42)


def capped(spark, sf):
    flags = B.cap_bags(_narrow(spark, sf), K, "random", seed=42)
    return flags.groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if("kept").alias("n_kept"), F.sum(F.when(F.col("kept"), F.col("patch_idx"))).alias("kept_sum")
    )


def weights(spark, sf):
    return V.rounded(B.class_weights(V.manifest(spark, sf).select("slide_id", "label")), 12)


def _index(spark, sf):
    """Orders as bags of their line items: many bags of few different sizes."""
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("slide_id")).agg(F.count(F.lit(1)).alias("n_patches"))


def batches(spark, sf):
    return B.length_bucket_batches(_index(spark, sf), 8, 64, 42)


def batches_full(spark, sf):
    return B.length_bucket_batches(_index(spark, sf), 5, 64, 42, drop_last=True)


def waste(spark, sf):
    return B.padding_waste(B.length_bucket_batches(_index(spark, sf), 8, 64, 42))


def size_stats(spark, sf):
    roles = V.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 2).cast("int").alias("fold"), F.col("o_orderstatus").alias("role"), F.col("o_orderkey").alias("slide_id")
    )
    return V.rounded(B.bag_size_stats(_index(spark, sf), roles))


def _kept(patches):
    return B.cap_random_k(patches, K, 42)


def kept_flags(spark, sf):
    patches = _narrow(spark, sf)
    return C.kept_vs_all(patches, _kept(patches)).select(*_ID, "kept")


def coverage(spark, sf):
    patches = _narrow(spark, sf)
    return C.coverage_stats(patches, _kept(patches))


def overview(spark, sf):
    return V.rounded(C.coverage_overview(coverage(spark, sf)))


def worst(spark, sf):
    return C.worst_coverage(coverage(spark, sf), 20)


def grid_cells(spark, sf):
    patches = _narrow(spark, sf)
    return C.coverage_grid(patches, _kept(patches))


def stride(spark, sf):
    return C.infer_patch_stride(_narrow(spark, sf))


def index_table(spark, sf):
    patches = V.stored_patches(spark, sf)
    return store.bag_index(B.cap_first_k(patches, K), patches, 8)


def packs(spark, sf):
    return store.pack_by_size(_order_index(spark, sf), 4096).select("slide_id", "est_bytes", "pack")


def packs_exact(spark, sf):
    return store.pack_by_size(_order_index(spark, sf), 512, exact=True)


def _order_index(spark, sf):
    return _index(spark, sf).select("slide_id", (F.col("n_patches") * 24).alias("est_bytes"))


QUERIES = {
    "B1_cap_first_k": first_k,
    "B1_cap_first_k_gaps": first_k_gaps,
    "B2_cap_random_k": random_k,
    "B3_cap_spatial_sqrt": sqrt_cap,
    "B3_cap_spatial_sqrt_fine_grid": sqrt_fine,
    "B4_cap_spatial_proportional": proportional_cap,
    "B5_cap_spatial_even": even_cap,
    "B6_multi_crop": crops,
    "B7_instance_dropout": dropout,
    "B8_feature_noise": noise,
    "B9_assemble_bags": assembled,
    "B9_assemble_after_cap": assembled_after_cap,
    "B9_assemble_batch_max": assembled_batches,
    "B10_weighted_resample": resampled,
    "B11_cap_bags": capped,
    "A8_bag_size_stats": size_stats,
    "A31_class_weights": weights,
    "A33_coverage_stats": coverage,
    "A33_coverage_overview": overview,
    "A34_coverage_grid": grid_cells,
    "A35_infer_patch_stride": stride,
    "J9_kept_vs_all": kept_flags,
    "T2_worst_coverage": worst,
    "W9_length_bucket_batches": batches,
    "W9_batches_drop_last": batches_full,
    "W9_padding_waste": waste,
    "S5_bag_index": index_table,
    "S6_pack_by_size": packs,
    "S6_pack_sizes": pack_sizes,
    "S6_pack_by_size_exact": packs_exact,
}

_ORD = f"{key(42, 'slide_id', 'patch_idx')}, patch_idx"
_SIZED = """sized AS (SELECT *, count(*) OVER s AS n, min(x) OVER s AS x0, max(x) OVER s AS x1, min(y) OVER s AS y0, max(y) OVER s AS y1
  FROM v_patches WINDOW s AS (PARTITION BY slide_id))"""


def _cells(cx: str, cy: str, grid: int) -> str:
    def clip(e: str) -> str:
        return f"greatest(least(CAST(floor({e}) AS BIGINT), {grid - 1}), 0)"

    return f"""{_SIZED},
placed AS (SELECT slide_id, patch_idx, n, {clip(cx)} * {grid} + {clip(cy)} AS cell FROM sized),
cells AS (SELECT slide_id, cell, count(*) AS n_cell, max(n) AS n, count(*) OVER (PARTITION BY slide_id) AS n_cells FROM placed GROUP BY 1, 2)"""


def _sqrt_cells(grid: int) -> str:
    return _cells(
        f"CAST(x - x0 AS DOUBLE) / ((CAST(x1 - x0 AS DOUBLE) + 1e-6::DOUBLE) / {grid}.0::DOUBLE)",
        f"CAST(y - y0 AS DOUBLE) / ((CAST(y1 - y0 AS DOUBLE) + 1e-6::DOUBLE) / {grid}.0::DOUBLE)",
        grid,
    )


def _greedy(amount: str, room: str, order: str) -> str:
    return f"greatest(0, least({room}, {amount} - coalesce(sum({room}) OVER (PARTITION BY slide_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))"


def _sqrt_sql(grid: int) -> str:
    return with_views("v_patches", f"""
WITH {_sqrt_cells(grid)},
b0 AS (SELECT *, round(sum(sqrt(CAST(n_cell AS DOUBLE))) OVER (PARTITION BY slide_id), 9) AS root_sum FROM cells),
b1 AS (SELECT *, {K} * sqrt(CAST(n_cell AS DOUBLE)) / root_sum AS ideal FROM b0),
b2 AS (SELECT *, least(greatest(CAST(floor(ideal) AS BIGINT), 1), n_cell) AS budget FROM b1),
b3 AS (SELECT *, {K} - sum(budget) OVER (PARTITION BY slide_id) AS gap, n_cell - budget AS spare,
       CASE WHEN n_cell = budget THEN -1.0::DOUBLE ELSE round(ideal - budget, 9) END AS rest FROM b2),
b4 AS (SELECT *, {_greedy("gap", "spare", "rest DESC, cell")} AS give, {_greedy("(-gap)", "(budget - 1)", "budget DESC, cell")} AS trim FROM b3),
quota AS (SELECT slide_id, cell, CASE WHEN n <= {K} THEN n_cell WHEN n_cells >= {K} THEN {K} ELSE budget + give - trim END AS quota,
          CASE WHEN n > {K} AND n_cells >= {K} THEN -1 ELSE cell END AS draw FROM b4),
r AS (SELECT slide_id, patch_idx, quota, row_number() OVER (PARTITION BY slide_id, draw ORDER BY {_ORD}) AS place FROM placed JOIN quota USING (slide_id, cell))
SELECT slide_id, patch_idx FROM r WHERE place <= quota""")


_PROP = _cells(
    f"CAST(x - x0 AS DOUBLE) / (CASE WHEN x1 = x0 THEN 1.0::DOUBLE ELSE CAST(x1 - x0 AS DOUBLE) END) * {GRID - 1e-9!r}::DOUBLE",
    f"CAST(y - y0 AS DOUBLE) / (CASE WHEN y1 = y0 THEN 1.0::DOUBLE ELSE CAST(y1 - y0 AS DOUBLE) END) * {GRID - 1e-9!r}::DOUBLE",
    GRID,
)
_EVEN = _cells(
    "CAST(x - x0 AS DOUBLE) / greatest(CAST(x1 - x0 AS DOUBLE), 1.0::DOUBLE) * 12.0::DOUBLE",
    "CAST(y - y0 AS DOUBLE) / greatest(CAST(y1 - y0 AS DOUBLE), 1.0::DOUBLE) * 12.0::DOUBLE",
    12,
)
_RANDOM = f"kept AS (SELECT slide_id, patch_idx FROM (SELECT slide_id, patch_idx, row_number() OVER (PARTITION BY slide_id ORDER BY {_ORD}) AS r FROM v_patches) WHERE r <= {K})"


def _packed(limit: int) -> str:
    """CTE ``packed``: bags across a multiple of the limit stand alone."""
    return f"""
pb AS (SELECT slide_id, n_patches * 24 AS est_bytes FROM idx),
pc AS (SELECT *, CAST(coalesce(sum(est_bytes) OVER (ORDER BY {_PACK}, slide_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM pb),
packed AS (SELECT slide_id, est_bytes, b // {limit} * 2 + CASE WHEN b + est_bytes > (b // {limit} + 1) * {limit} THEN 1 ELSE 0 END AS pack FROM pc)"""


_COVER = f"""
WITH {_RANDOM}, t AS (SELECT slide_id, count(*) AS n_total FROM v_patches GROUP BY 1), k AS (SELECT slide_id, count(*) AS n_kept FROM kept GROUP BY 1),
cov AS (SELECT slide_id, n_total, coalesce(n_kept, 0) AS n_kept, n_total - coalesce(n_kept, 0) AS n_discarded,
  round(100.0::DOUBLE * coalesce(n_kept, 0) / n_total, 2) AS coverage_pct, coalesce(n_kept, 0) < n_total AS was_capped FROM t LEFT JOIN k USING (slide_id))"""


def _steps(axis: str) -> str:
    return f"""
{axis}_d AS (SELECT slide_id, {axis} - lag({axis}) OVER (PARTITION BY slide_id ORDER BY {axis}) AS step FROM (SELECT DISTINCT slide_id, {axis} FROM v_patches)),
{axis}_s AS (SELECT slide_id, step FROM (SELECT slide_id, step, row_number() OVER (PARTITION BY slide_id ORDER BY count(*) DESC, step) AS r FROM {axis}_d WHERE step IS NOT NULL GROUP BY 1, 2) WHERE r = 1)"""


_STRIDE = f"""{_steps("x")}, {_steps("y")},
stride AS (SELECT slide_id, CAST(coalesce(x_s.step, y_s.step, 256) AS INT) AS stride FROM (SELECT DISTINCT slide_id FROM v_patches) LEFT JOIN x_s USING (slide_id) LEFT JOIN y_s USING (slide_id))"""

_INDEX = "idx AS (SELECT l_orderkey AS slide_id, count(*) AS n_patches FROM lineitem GROUP BY 1)"


def _batches(size: int) -> str:
    return f"""{_INDEX},
p AS (SELECT *, (row_number() OVER (ORDER BY n_patches, {key(42, "slide_id")}, slide_id) - 1) // 64 AS bucket FROM idx),
i AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {key(42, "'inside'", "slide_id")}, slide_id) - 1 AS pos FROM p),
bt AS (SELECT CAST('0x' || substr({key(42, "'bucket'", "bucket")}, 1, 8) AS BIGINT) AS bucket_order, bucket, pos // {size} AS batch_no, pos % {size} AS slot, slide_id, n_patches FROM i)"""


_U9 = uniform(7, "slide_id", "patch_idx")
_PACK = key("pack", "slide_id")
_NOISE_KEY = key(42, "slide_id", "patch_idx", "i - 1")
_SHARD8 = f"CAST(CAST('0x' || substr({key('shard', 'slide_id')}, 1, 8) AS BIGINT) % 8 AS INT)"

ORACLES = {
    "B1_cap_first_k": with_views("v_patches", f"SELECT slide_id, patch_idx FROM v_patches WHERE patch_idx < {K}"),
    "B1_cap_first_k_gaps": with_views("v_patches", f"""
SELECT slide_id, patch_idx FROM (SELECT slide_id, patch_idx, row_number() OVER (PARTITION BY slide_id ORDER BY patch_idx) AS r FROM v_patches WHERE patch_idx % 3 <> 0)
WHERE r <= {K}"""),
    "B2_cap_random_k": with_views("v_patches", f"WITH {_RANDOM} SELECT * FROM kept"),
    "B3_cap_spatial_sqrt": _sqrt_sql(GRID),
    "B3_cap_spatial_sqrt_fine_grid": _sqrt_sql(64),
    "B4_cap_spatial_proportional": with_views("v_patches", f"""
WITH {_PROP},
b1 AS (SELECT *, least(CAST(round_even(CAST(n_cell AS DOUBLE) / CAST(n AS DOUBLE) * {K}, 0) AS BIGINT), n_cell) AS budget FROM cells),
b2 AS (SELECT *, {K} - sum(budget) OVER (PARTITION BY slide_id) AS gap, n_cell - budget AS room, greatest(budget - 1, 0) AS spare FROM b1),
b3 AS (SELECT *, {_greedy("gap", "room", "room DESC, cell")} AS give, {_greedy("(-gap)", "spare", "budget DESC, cell")} AS cut FROM b2),
quota AS (SELECT slide_id, cell, CASE WHEN n <= {K} THEN n_cell ELSE budget + give - cut END AS quota FROM b3),
r AS (SELECT slide_id, patch_idx, quota, row_number() OVER (PARTITION BY slide_id, cell ORDER BY {key(0, "slide_id", "patch_idx")}, patch_idx) AS place FROM placed JOIN quota USING (slide_id, cell))
SELECT slide_id, patch_idx FROM r WHERE place <= quota"""),
    "B5_cap_spatial_even": with_views("v_patches", f"""
WITH {_EVEN},
b1 AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY {key(42, "slide_id", "cell")}, cell) AS turn FROM cells),
quota AS (SELECT slide_id, cell, CASE WHEN n <= {K} THEN n_cell ELSE least({K} // n_cells + CASE WHEN turn <= {K} - ({K} // n_cells) * n_cells THEN 1 ELSE 0 END, n_cell) END AS quota FROM b1),
r AS (SELECT slide_id, patch_idx, quota, row_number() OVER (PARTITION BY slide_id, cell ORDER BY {_ORD}) AS place FROM placed JOIN quota USING (slide_id, cell)),
need AS (SELECT slide_id, {K} - sum(quota) AS need FROM quota GROUP BY 1),
u AS (SELECT slide_id, patch_idx, need, row_number() OVER (PARTITION BY slide_id ORDER BY {_ORD}) AS place FROM r JOIN need USING (slide_id) WHERE place > quota)
SELECT slide_id, patch_idx FROM r WHERE place <= quota UNION ALL SELECT slide_id, patch_idx FROM u WHERE place <= need"""),
    "B6_multi_crop": with_views("v_patches", f"""
SELECT CAST(crop AS INT) AS crop, slide_id, patch_idx FROM (
  SELECT crop, slide_id, patch_idx, row_number() OVER (PARTITION BY crop, slide_id ORDER BY {key("(crop * 1000)", "slide_id", "patch_idx")}, patch_idx) AS r
  FROM v_patches, range(3) t(crop)) WHERE r <= 50"""),
    "B7_instance_dropout": with_views("v_patches", f"""
WITH u AS (SELECT slide_id, patch_idx, {_U9} AS u FROM v_patches),
w AS (SELECT *, count(*) OVER (PARTITION BY slide_id) AS n, max(u) OVER (PARTITION BY slide_id) AS top,
      row_number() OVER (PARTITION BY slide_id ORDER BY u DESC, patch_idx DESC) AS r FROM u)
SELECT slide_id, patch_idx FROM w WHERE u > 0.9::DOUBLE OR ((top <= 0.9::DOUBLE OR n = 1) AND r = 1)"""),
    "B8_feature_noise": with_views("v_embed", f"""
WITH e AS (SELECT slide_id, patch_idx, i, features[i] AS v, {_NOISE_KEY} AS k FROM v_embed, range(1, 65) t(i))
SELECT slide_id, patch_idx, CAST(i - 1 AS INT) AS pos, round(CAST(CAST(v + 0.1::DOUBLE * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - CAST('0x' || substr(k, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE))
  * cos(6.283185307179586::DOUBLE * (CAST('0x' || substr(k, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE)) AS FLOAT) AS DOUBLE), 5) AS value FROM e"""),
    "B9_assemble_bags": with_views("v_patches", """
WITH s AS (SELECT slide_id, CAST(least(count(*), 64) AS INT) AS length FROM v_patches GROUP BY 1),
g AS (SELECT slide_id, length, CAST(p AS INT) AS pos FROM s, range(80) t(p))
SELECT g.slide_id AS slide_id, length, pos, CAST(CASE WHEN pos < length THEN 1 ELSE 0 END AS INT) AS mask,
       CASE WHEN pos < length THEN f1 ELSE 0 END AS f1, CASE WHEN pos < length THEN x ELSE 0 END AS x, CASE WHEN pos < length THEN y ELSE 0 END AS y
FROM g LEFT JOIN v_patches p ON p.slide_id = g.slide_id AND p.patch_idx = g.pos"""),
    "B9_assemble_after_cap": with_views("v_patches", f"""
WITH {_RANDOM} SELECT slide_id, CAST(count(*) AS INT) AS length, CAST(sum(x + y) AS BIGINT) AS coord_sum FROM kept JOIN v_patches USING (slide_id, patch_idx) GROUP BY 1"""),
    "B9_assemble_batch_max": with_views("v_patches", """
WITH n AS (SELECT slide_id, CAST(least(count(*), 150) AS INT) AS length FROM v_patches WHERE patch_idx % 3 <> 0 AND patch_idx % 7 < slide_id % 7 + 1 GROUP BY 1),
w AS (SELECT *, slide_id // 4 AS batch_no, max(length) OVER (PARTITION BY slide_id // 4) AS width FROM n)
SELECT slide_id, CAST(batch_no AS BIGINT) AS batch_no, length, width, width AS n_coords, length AS n_real FROM w"""),
    "B10_weighted_resample": with_views("v_manifest", f"""
WITH ranked AS (SELECT label, slide_id, row_number() OVER (PARTITION BY label ORDER BY {key(42, "slide_id")}, slide_id) AS place FROM v_manifest),
c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS class_no, count(*) OVER () AS k FROM v_manifest GROUP BY 1),
d AS (SELECT slide_id AS draw_id, CAST(floor({uniform("42:draw", "slide_id")} * (SELECT max(k) FROM c)) AS BIGINT) AS class_no, {uniform("42:draw", "slide_id", start=9)} AS u FROM v_manifest),
a AS (SELECT draw_id, label, CAST(floor(u * n) AS BIGINT) + 1 AS place FROM d JOIN c USING (class_no))
SELECT draw_id, slide_id, label FROM a JOIN ranked USING (label, place)"""),
    "B11_cap_bags": with_views("v_patches", f"""
WITH {_RANDOM}, k AS (SELECT slide_id, count(*) AS n_kept, CAST(sum(patch_idx) AS BIGINT) AS kept_sum FROM kept GROUP BY 1)
SELECT slide_id, count(*) AS n_raw, max(n_kept) AS n_kept, max(kept_sum) AS kept_sum FROM v_patches JOIN k USING (slide_id) GROUP BY 1"""),
    "A8_bag_size_stats": f"""
WITH {_INDEX} SELECT CAST(o_custkey % 2 AS INT) AS fold, o_orderstatus AS role, count(*) AS n_slides, round(avg(n_patches), 6) AS mean_patches,
  max(n_patches) AS max_patches, CAST(sum(n_patches) AS BIGINT) AS total_patches FROM idx JOIN orders ON o_orderkey = slide_id GROUP BY 1, 2""",
    "A31_class_weights": with_views("v_manifest", "SELECT slide_id, label, round(1.0::DOUBLE / count(*) OVER (PARTITION BY label), 12) AS weight FROM v_manifest"),
    "A33_coverage_stats": with_views("v_patches", f"{_COVER} SELECT * FROM cov"),
    "A33_coverage_overview": with_views("v_patches", f"""{_COVER}
SELECT count(*) AS n_slides, count(*) FILTER (was_capped) AS n_capped, round(avg(coverage_pct) FILTER (was_capped), 6) AS mean_pct,
       min(coverage_pct) FILTER (was_capped) AS min_pct, round(quantile_cont(coverage_pct, 0.5) FILTER (was_capped), 6) AS median_pct FROM cov"""),
    "A34_coverage_grid": with_views("v_patches", f"""
WITH {_RANDOM}, {_STRIDE}, corner AS (SELECT slide_id, min(x) AS x0, min(y) AS y0 FROM v_patches GROUP BY 1)
SELECT p.slide_id AS slide_id, CAST((p.x - x0) // stride AS INT) AS gx, CAST((p.y - y0) // stride AS INT) AS gy, CAST(max(CASE WHEN k.patch_idx IS NULL THEN 1 ELSE 2 END) AS INT) AS state
FROM v_patches p JOIN corner USING (slide_id) JOIN stride USING (slide_id) LEFT JOIN kept k ON k.slide_id = p.slide_id AND k.patch_idx = p.patch_idx GROUP BY 1, 2, 3"""),
    "A35_infer_patch_stride": with_views("v_patches", f"WITH {_STRIDE} SELECT * FROM stride"),
    "J9_kept_vs_all": with_views("v_patches", f"SELECT slide_id, patch_idx, row_number() OVER (PARTITION BY slide_id ORDER BY {_ORD}) <= {K} AS kept FROM v_patches"),
    "T2_worst_coverage": with_views("v_patches", f"{_COVER} SELECT * FROM cov WHERE was_capped ORDER BY coverage_pct, slide_id LIMIT 20"),
    "W9_length_bucket_batches": f"WITH {_batches(8)} SELECT * FROM bt",
    "W9_batches_drop_last": f"WITH {_batches(5)} SELECT * FROM bt QUALIFY count(*) OVER (PARTITION BY bucket, batch_no) = 5",
    "W9_padding_waste": f"""
WITH {_batches(8)} SELECT bucket, batch_no, count(*) AS n_slides, CAST(sum(n_patches) AS BIGINT) AS n_patches,
  CAST(count(*) * max(n_patches) - sum(n_patches) AS BIGINT) AS padding FROM bt GROUP BY 1, 2""",
    "S5_bag_index": with_views("v_patches", f"""
WITH i AS (SELECT slide_id, count(*) FILTER (patch_idx < {K}) AS n_patches, count(*) AS raw_patches, {_SHARD8} AS shard FROM v_patches GROUP BY 1)
SELECT slide_id, n_patches, raw_patches, CAST(4 AS INT) AS feat_dim, CAST(2 AS INT) AS coord_dim, shard,
  CAST(coalesce(sum(n_patches) OVER (PARTITION BY shard ORDER BY slide_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_row, n_patches * 24 AS est_bytes FROM i"""),
    "S6_pack_by_size": f"""
WITH {_INDEX}, {_packed(4096)} SELECT slide_id, est_bytes, pack FROM packed""",
    "S6_pack_sizes": f"""
WITH {_INDEX}, {_packed(100)}, g AS (SELECT pack, count(*) AS n_bags, CAST(sum(est_bytes) AS BIGINT) AS bytes FROM packed GROUP BY 1)
SELECT *, n_bags > 1 AND bytes > 100 AS over FROM g""",
    "S6_pack_by_size_exact": f"""
WITH RECURSIVE {_INDEX}, b AS (SELECT slide_id, n_patches * 24 AS est_bytes, row_number() OVER w - 1 AS i,
  CAST(sum(n_patches * 24) OVER w AS BIGINT) AS ends FROM idx WINDOW w AS (ORDER BY {_PACK}, slide_id)),
nx AS (SELECT i, greatest(i + count(*) OVER (ORDER BY ends RANGE BETWEEN CURRENT ROW AND greatest(512 - est_bytes, 0) FOLLOWING), i + 1) AS next FROM b),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS pack UNION ALL SELECT nx.next, f.pack + 1 FROM f JOIN nx USING (i) WHERE nx.next < (SELECT count(*) FROM b))
SELECT slide_id, est_bytes, last_value(f.pack IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pack FROM b LEFT JOIN f USING (i)""",
}
