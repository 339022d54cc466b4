"""Bags of patches: caps, crops, augmentation, assembly and batching.

A patch table has one row per patch: ``slide_id, patch_idx, x, y`` and any wide
columns such as ``features``.  Selection works on the four narrow columns only and
ends in cut-offs: the last chosen place of every slide, or of every cell of a slide.  The wide rows are
compared with them where they stand (see ``beside``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagstats.functions.keys import hash_bucket, hash_key, normal, uniform, uniform_pair
from bagstats.functions.spread import TASK_ROWS, beside, keep_lowest, lookup, met_ranked, ranked, tasks_for
from bagstats.sources.shared import written

KEY = ["slide_id", "patch_idx"]
_WHOLE_SLIDE = -1  # pool of a slide whose grid is finer than the budget


# --- selection helpers ------------------------------------------------------


def _narrow(patches: DataFrame, *more: str) -> DataFrame:
    """The columns that selection reads; coordinates tell apart patches of one number."""
    return patches.select(*KEY, *dict.fromkeys([*(c for c in ("x", "y") if c in patches.columns), *more]))


def _sizes(patches: DataFrame) -> DataFrame:
    return patches.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"))


def _extent(patches: DataFrame) -> DataFrame:
    return patches.groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
    )


def _tie(patches: DataFrame) -> Column:
    """Orders patches of one slide and number by their coordinates; patches alike in these too are one to a cut-off."""
    return F.xxhash64(*[F.col(c).cast("double") for c in ("x", "y")]) if {"x", "y"} <= set(patches.columns) else F.lit(0).cast("bigint")


def _draw_order(patches: DataFrame, seed: int | Column, *extra: str) -> list[Column]:
    return [hash_key(seed, "slide_id", "patch_idx", *extra), F.col("patch_idx"), _tie(patches)]


def _mark(order: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])


def _up_to_last(patches: DataFrame, chosen: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Patches that come no later in ``order`` than the last chosen one of their slide.

    The chosen patches are the first of their slide, so one value per slide tells them from the rest.
    """
    last = chosen.groupBy("slide_id").agg(F.max(_mark(order)).alias("__last"))
    return beside(patches, last, ["slide_id"]).filter(_mark(order) <= F.col("__last")).select(*patches.columns)


def _last_drawn(patches: DataFrame, k: int, seed: int, step: int = 0, n_crops: int = 1) -> DataFrame:
    """The mark of the k-th patch of every slide in hash order (the last one, of smaller slides), for crop c with seed ``seed + step * c``:
    a stored table ``slide_id, crop, __last``.

    Hashes are even, so the first k of n lie below a share of them that is little more than k / n.  Only patches below it are dealt and
    ordered.  A slide that has fewer than k patches there after all (many patches of one number) is drawn from all its patches.
    """
    few = k + 8 * math.sqrt(k) + 32
    share = F.least(F.lit(1.0), F.lit(few) / F.col("n"))
    bound = F.lpad(F.lower(F.hex(F.floor(share * F.lit(4294967295.0)).cast("bigint"))), 8, "0").alias("__bound")
    sizes = written(_sizes(patches).select("slide_id", "n", bound), "sizes")
    seeds = F.col("crop") * F.lit(step) + F.lit(seed)
    crops = F.explode(F.sequence(F.lit(0), F.lit(n_crops - 1))).alias("crop")
    rows = beside(_narrow(patches), sizes, ["slide_id"], stored=True).select("*", crops)
    low = rows.filter(hash_bucket(hash_key(seeds, "slide_id", "patch_idx"), 8) <= F.col("__bound")).drop("__bound")
    expected = sizes.agg(F.sum(F.least(F.col("n"), F.lit(int(few)))).alias("n")).first()["n"] or 0
    low = low.repartition(tasks_for(patches, expected * n_crops), "slide_id", "crop").withColumn("__mark", _mark(_draw_order(low, seeds)))
    turn = F.row_number().over(Window.partitionBy("slide_id", "crop").orderBy("__mark"))
    first = low.withColumn("__turn", turn).filter(F.col("__turn") <= k).groupBy("slide_id", "crop")
    lasts = written(first.agg(F.max("__mark").alias("__last"), (F.count(F.lit(1)) >= F.least(F.max("n"), F.lit(k))).alias("__whole")), "lasts")
    whole = lasts.filter("__whole").drop("__whole")
    missing = written(beside(sizes.select("slide_id", crops), whole, ["slide_id", "crop"], "left_anti", stored=True), "missing")
    if missing.isEmpty():
        return whole
    again = beside(rows.drop("n", "__bound"), missing, ["slide_id", "crop"], "left_semi", stored=True)
    chosen = keep_lowest(again, ["slide_id", "crop"], _draw_order(again, seeds), k, ["patch_idx"])
    drawn = chosen.groupBy("slide_id", "crop").agg(F.max(_mark(_draw_order(chosen, seeds))).alias("__last"))
    return written(whole.unionByName(drawn), "lasts")


def _first_patches(patches: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    rows = _narrow(patches)
    return keep_lowest(rows, ["slide_id"], order, k, ["patch_idx"], tasks=tasks_for(rows, rows.count()))


def cap_first_k(patches: DataFrame, k: int) -> DataFrame:
    """The first k patches of every bag by position, whatever gaps ``patch_idx`` has."""
    order = [F.col("patch_idx"), _tie(patches)]
    return _up_to_last(patches, _first_patches(patches, k, order), order)


def cap_random_k(patches: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k patches of every bag without replacement, repeatable per (seed, slide)."""
    last = _last_drawn(patches, k, seed).drop("crop")
    return beside(patches, last, ["slide_id"], stored=True).filter(_mark(_draw_order(patches, seed)) <= F.col("__last")).select(*patches.columns)


# --- spatial caps -----------------------------------------------------------


def _axis_cell(kind: str, value: Column, low: Column, high: Column, grid: int) -> Column:
    """Grid index of a coordinate; the three caps differ in how they treat the far edge."""
    offset = (value - low).cast("double")
    span = (high - low).cast("double")
    if kind == "sqrt":
        index = F.floor(offset / ((span + F.lit(1e-6)) / F.lit(float(grid))))
    elif kind == "proportional":
        safe = F.when(span == 0, F.lit(1.0)).otherwise(span)
        index = F.floor(offset / safe * F.lit(grid - 1e-9))
    else:
        index = F.floor(offset / F.greatest(span, F.lit(1.0)) * F.lit(float(grid)))
    return F.greatest(F.least(index, F.lit(grid - 1)), F.lit(0))


def _cell(kind: str, grid: int) -> Column:
    """Cell of a patch that stands beside its slide's extent."""
    cell_x = _axis_cell(kind, F.col("x"), F.col("min_x"), F.col("max_x"), grid)
    cell_y = _axis_cell(kind, F.col("y"), F.col("min_y"), F.col("max_y"), grid)
    return (cell_x * F.lit(grid) + cell_y).cast("int")


def _gridded(patches: DataFrame, kind: str, grid: int) -> tuple[DataFrame, DataFrame]:
    """Patches with their cell, and the stored cell table with sizes (at most grid * grid rows per slide)."""
    placed = beside(_narrow(patches, "x", "y"), _extent(patches), ["slide_id"])
    placed = placed.select(*KEY, "x", "y", "n", _cell(kind, grid).alias("cell"))
    cells = placed.groupBy("slide_id", "cell").agg(F.count(F.lit(1)).alias("n_cell"), F.max("n").alias("n"))
    return placed.drop("n"), written(cells, "cells")


def _first_per_cell(placed: DataFrame, cells: DataFrame, quotas: DataFrame, k: int, seed: int) -> DataFrame:
    """The first k patches of every cell in hash order with ``place`` and their cell's quota.

    No quota exceeds k, so nothing that could be chosen is lost.  Patches and quotas are dealt once, by cell, and ordered where they
    meet; only if a cell is more than a task should order, each salt of a cell is down to k rows first.
    """
    sizes = cells.agg(F.sum("n_cell").alias("n"), F.max("n_cell").alias("most")).first()
    tasks = tasks_for(placed, sizes["n"] or 0)
    if (sizes["most"] or 0) > TASK_ROWS:
        placed = keep_lowest(placed, ["slide_id", "cell"], _draw_order(placed, seed), k, ["patch_idx"], tasks=tasks)
    return met_ranked(placed, quotas, ["slide_id", "cell"], lambda rows: _draw_order(rows, seed), "place", tasks).filter(F.col("place") <= k)


_LAST = ["patch_idx", "x", "y"]


def _last_of(chosen: DataFrame) -> DataFrame:
    """The last chosen patch of every ``pool`` of a slide, by its ``mark``."""
    last = F.max_by(F.struct(*_LAST), "mark").alias("last")
    return chosen.groupBy("slide_id", "pool").agg(last).select("slide_id", "pool", "last.*")


def _no_later(patches: DataFrame, name: str, seed: int) -> Column:
    """Whether a patch comes no later than the one beside it, whose columns begin with ``name``: hashes of both are made here and travel nowhere."""
    tie = F.xxhash64(*[F.col(f"{name}{c}").cast("double") for c in ("x", "y")])
    last = [hash_key(seed, "slide_id", f"{name}patch_idx"), F.col(f"{name}patch_idx"), tie]
    return F.col(f"{name}there").isNotNull() & F.coalesce(_mark(_draw_order(patches, seed)) <= _mark(last), F.lit(False))


def _within(patches: DataFrame, last: DataFrame, kind: str, grid: int, seed: int) -> DataFrame:
    """All patches with ``__kept``: those no later than the last chosen patch of their cell (``pool`` is the cell), or than the
    last of those chosen from the whole slide (``pool`` is ``_WHOLE_SLIDE``).  ``last`` has these patches, one for each pool."""
    # Written once: both kinds of cut-offs come out of one selection.
    cuts = written(last, "cuts")
    named = cuts.select("slide_id", "pool", *[F.col(c).alias(f"__last_{c}") for c in _LAST], F.lit(True).alias("__last_there"))
    whole = named.filter(F.col("pool") == _WHOLE_SLIDE).drop("pool").withColumnsRenamed({f"__last_{c}": f"__whole_{c}" for c in [*_LAST, "there"]})
    slides = lookup(_extent(patches), whole, ["slide_id"], how="left").drop("n")
    cells = named.filter(F.col("pool") != _WHOLE_SLIDE).withColumnRenamed("pool", "__cell")
    names = {c: f"__{c}" for c in ("min_x", "max_x", "min_y", "max_y")}
    placed = beside(patches.withColumnsRenamed({c: f"__own_{c}" for c in names if c in patches.columns}), slides, ["slide_id"])
    placed = placed.withColumn("__cell", _cell(kind, grid)).drop(*names)
    placed = placed.withColumnsRenamed({f"__own_{c}": c for c in names if c in patches.columns})
    cut = beside(placed, cells, ["slide_id", "__cell"], "left", stored=True)
    kept = _no_later(cut, "__last_", seed) | _no_later(cut, "__whole_", seed)
    return cut.select(*patches.columns, kept.alias("__kept"))


def _greedy(cells: DataFrame, amount: Column, room: Column, order: Sequence[Column]) -> Column:
    """What each cell takes of ``amount`` when cells are served in order up to their room."""
    before = Window.partitionBy("slide_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    served = F.coalesce(F.sum(room).over(before), F.lit(0))
    return F.greatest(F.lit(0), F.least(room, amount - served))


def _sqrt_budgets(cells: DataFrame, k: int) -> DataFrame:
    """Budget per cell in proportion to the root of its size, at least one, exactly k in all."""
    slide = Window.partitionBy("slide_id")
    rows = cells.withColumn("root_sum", F.round(F.sum(F.sqrt(F.col("n_cell").cast("double"))).over(slide), 9))
    rows = rows.withColumn("ideal", F.lit(k) * F.sqrt(F.col("n_cell").cast("double")) / F.col("root_sum"))
    rows = rows.withColumn("budget", F.least(F.greatest(F.floor("ideal"), F.lit(1)), F.col("n_cell")))
    rows = rows.withColumn("gap", F.lit(k) - F.sum("budget").over(slide))
    rows = rows.withColumn("spare", F.col("n_cell") - F.col("budget"))
    rest = F.when(F.col("spare") == 0, F.lit(-1.0)).otherwise(F.round(F.col("ideal") - F.col("budget"), 9))
    rows = rows.withColumn("rest", rest)
    give = _greedy(rows, F.col("gap"), F.col("spare"), [F.col("rest").desc(), F.col("cell")])
    trim = _greedy(rows, -F.col("gap"), F.col("budget") - 1, [F.col("budget").desc(), F.col("cell")])
    rows = rows.withColumn("give", give).withColumn("trim", trim)
    return rows.withColumn("quota", F.col("budget") + F.col("give") - F.col("trim"))


def _proportional_budgets(cells: DataFrame, k: int) -> DataFrame:
    """Budget per cell in proportion to its size (half-even rounding), exactly k in all."""
    slide = Window.partitionBy("slide_id")
    share = F.bround(F.col("n_cell") / F.col("n") * F.lit(k), 0).cast("bigint")
    rows = cells.withColumn("budget", F.least(share, F.col("n_cell")))
    rows = rows.withColumn("gap", F.lit(k) - F.sum("budget").over(slide))
    rows = rows.withColumn("room", F.col("n_cell") - F.col("budget"))
    add = _greedy(rows, F.col("gap"), F.col("room"), [F.col("room").desc(), F.col("cell")])
    spare = F.greatest(F.col("budget") - 1, F.lit(0))
    cut = _greedy(rows, -F.col("gap"), spare, [F.col("budget").desc(), F.col("cell")])
    rows = rows.withColumn("add", add).withColumn("cut", cut)
    return rows.withColumn("quota", F.col("budget") + F.col("add") - F.col("cut"))


def _even_budgets(cells: DataFrame, k: int, seed: int) -> DataFrame:
    """The same base for every cell, leftovers to cells in hash order."""
    slide = Window.partitionBy("slide_id")
    rows = cells.withColumn("n_cells", F.count(F.lit(1)).over(slide))
    rows = rows.withColumn("turn", F.row_number().over(slide.orderBy(hash_key(seed, "slide_id", "cell"), "cell")))
    base = F.floor(F.lit(k) / F.col("n_cells"))
    extra = (F.col("turn") <= F.lit(k) - base * F.col("n_cells")).cast("bigint")
    return rows.withColumn("quota", F.least(base + extra, F.col("n_cell")))


def _keep_all_when_small(quotas: DataFrame, k: int) -> DataFrame:
    quota = F.when(F.col("n") <= k, F.col("n_cell")).otherwise(F.col("quota"))
    return quotas.withColumn("quota", quota)


def _sqrt_kept(patches: DataFrame, k: int, grid: int = 32, seed: int = 42) -> DataFrame:
    placed, cells = _gridded(patches, "sqrt", grid)
    counted = cells.withColumn("n_cells", F.count(F.lit(1)).over(Window.partitionBy("slide_id")))
    too_fine = (F.col("n_cells") >= k) & (F.col("n") > k)
    budgets = _keep_all_when_small(_sqrt_budgets(counted, k), k).withColumn("whole", too_fine)
    rows = _first_per_cell(placed, cells, budgets.select("slide_id", "cell", "quota", "whole"), k, seed)
    rows = rows.filter(F.col("whole") | (F.col("place") <= F.col("quota")))
    pool = F.when(F.col("whole"), F.lit(_WHOLE_SLIDE)).otherwise(F.col("cell"))
    rows = rows.withColumn("pool", pool).repartition("slide_id", "pool")  # marks are made where they are compared
    rows = rows.withColumn("mark", _mark(_draw_order(rows, seed)))
    turn = F.row_number().over(Window.partitionBy("slide_id", "pool").orderBy("mark"))
    chosen = rows.withColumn("turn", turn).filter(F.col("turn") <= k)
    return _within(patches, _last_of(chosen), "sqrt", grid, seed)


def cap_spatial_sqrt(patches: DataFrame, k: int, grid: int = 32, seed: int = 42) -> DataFrame:
    """k patches per bag over a grid; dense cells are damped by a square root.

    A bag with no more than k patches stays whole; with at least k occupied cells
    the k patches are drawn from the whole bag.
    """
    return _sqrt_kept(patches, k, grid, seed).filter("__kept").drop("__kept")


def _proportional_kept(patches: DataFrame, k: int, grid: int = 32, seed: int = 0) -> DataFrame:
    placed, cells = _gridded(patches, "proportional", grid)
    quotas = _keep_all_when_small(_proportional_budgets(cells, k), k)
    rows = _first_per_cell(placed, cells, quotas.select("slide_id", "cell", "quota"), k, seed)
    last = rows.filter(F.col("place") == F.col("quota")).select("slide_id", F.col("cell").alias("pool"), *_LAST)
    return _within(patches, last, "proportional", grid, seed)


def cap_spatial_proportional(patches: DataFrame, k: int, grid: int = 32, seed: int = 0) -> DataFrame:
    """k patches per bag over a grid, each cell in proportion to its size."""
    return _proportional_kept(patches, k, grid, seed).filter("__kept").drop("__kept")


def _even_kept(patches: DataFrame, k: int, grid: int = 32, seed: int = 42) -> DataFrame:
    placed, cells = _gridded(patches, "even", grid)
    quotas = _keep_all_when_small(_even_budgets(cells, k, seed), k)
    taken = F.sum("quota").over(Window.partitionBy("slide_id"))
    need = F.when(F.col("n") > k, F.lit(k) - taken).otherwise(F.lit(0))
    quotas = quotas.select("slide_id", "cell", "quota", need.alias("need"))
    rows = _first_per_cell(placed, cells, quotas, k, seed).filter(F.col("place") <= F.col("quota") + F.col("need"))
    rows = rows.withColumn("spare", F.col("place") > F.col("quota")).repartition("slide_id", "spare")
    rows = rows.withColumn("mark", _mark(_draw_order(rows, seed)))
    turn = F.row_number().over(Window.partitionBy("slide_id", "spare").orderBy("mark"))
    rows = rows.withColumn("turn", turn).filter(~F.col("spare") | (F.col("turn") <= F.col("need")))
    # What is beyond a cell's quota and no later than the last spare patch is a spare patch itself.
    pool = F.when(F.col("spare"), F.lit(_WHOLE_SLIDE)).otherwise(F.col("cell"))
    return _within(patches, _last_of(rows.withColumn("pool", pool)), "even", grid, seed)


def cap_spatial_even(patches: DataFrame, k: int, grid: int = 32, seed: int = 42) -> DataFrame:
    """k patches per bag spread evenly over the occupied cells, topped up at random.

    A cell gives the top-up at most ``need`` patches beyond its quota, and quota plus
    need never exceed k, so the last window sees few rows of a slide.
    """
    return _even_kept(patches, k, grid, seed).filter("__kept").drop("__kept")


def _ordered_kept(patches: DataFrame, last: DataFrame, order: Sequence[Column]) -> DataFrame:
    return beside(patches, last, ["slide_id"], "left", stored=True).withColumn("__kept", F.coalesce(_mark(order) <= F.col("__last"), F.lit(False))).drop("__last")


def _first_kept(patches: DataFrame, k: int) -> DataFrame:
    order = [F.col("patch_idx"), _tie(patches)]
    last = _first_patches(patches, k, order).groupBy("slide_id").agg(F.max(_mark(order)).alias("__last"))
    return _ordered_kept(patches, written(last, "lasts"), order)


def _random_kept(patches: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return _ordered_kept(patches, _last_drawn(patches, k, seed).drop("crop"), _draw_order(patches, seed))


# Every patch with ``__kept``, by the name of the cap.
_KEPT: dict[str, Callable[..., DataFrame]] = {
    "first": _first_kept,
    "random": _random_kept,
    "spatial_sqrt": _sqrt_kept,
    "spatial_proportional": _proportional_kept,
    "spatial_even": _even_kept,
}
CAPS: dict[str, Callable[..., DataFrame]] = {
    "first": cap_first_k,
    "random": cap_random_k,
    "spatial_sqrt": cap_spatial_sqrt,
    "spatial_proportional": cap_spatial_proportional,
    "spatial_even": cap_spatial_even,
}


def cap_by_name(patches: DataFrame, k: int, strategy: str = "spatial_sqrt", **options) -> DataFrame:
    if strategy not in CAPS:
        raise ValueError(f"Unknown cap strategy '{strategy}'. Must be one of: {sorted(CAPS)}")
    if k <= 0:
        raise ValueError(f"The cap must be positive, got {k}")
    return CAPS[strategy](patches, k, **options)


def cap_bags(patches: DataFrame, k: int, strategy: str = "spatial_sqrt", **options) -> DataFrame:
    """Every patch with ``kept``: the table behind coverage reports."""
    if strategy not in _KEPT:
        raise ValueError(f"Unknown cap strategy '{strategy}'. Must be one of: {sorted(CAPS)}")
    if k <= 0:
        raise ValueError(f"The cap must be positive, got {k}")
    flagged = _KEPT[strategy](patches, k, **options)
    return flagged.select(*[c for c in patches.columns if c != "kept"], F.col("__kept").alias("kept"))


def multi_crop(patches: DataFrame, n_crops: int, k: int, strategy: str = "random", seed: int = 0) -> DataFrame:
    """Seeded views of the same bags, one per crop, as one job.

    Crop c is drawn with seed ``seed + 1000 * c``.
    """
    crops = F.sequence(F.lit(0), F.lit(n_crops - 1))
    if strategy == "first":
        return cap_first_k(patches, k).withColumn("crop", F.explode(crops))
    if strategy == "random":
        last = _last_drawn(patches, k, seed, 1000, n_crops).withColumnRenamed("__last", "last")
        # One row per slide with the cut-off of every crop in order; a wide row is repeated only for the crops it is in.
        cuts = last.groupBy("slide_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("crop", "last"))), lambda c: c["last"]).alias("__cuts"))
        wide = beside(patches, cuts, ["slide_id"])
        inside = F.filter(crops, lambda c: _mark(_draw_order(patches, c * F.lit(1000) + F.lit(seed))) <= F.get("__cuts", c))
        return wide.withColumn("crop", F.explode(inside)).select(*patches.columns, "crop")
    views = [cap_by_name(patches, k, strategy, seed=seed + 1000 * c).withColumn("crop", F.lit(c)) for c in range(n_crops)]
    out = views[0]
    for view in views[1:]:
        out = out.unionByName(view)
    return out


# --- augmentation -----------------------------------------------------------


def instance_dropout(patches: DataFrame, p: float, seed: int = 42) -> DataFrame:
    """Drop each patch with probability p; a bag never becomes empty, single-patch bags stay.

    One aggregate per slide tells whether anything survives; nothing is ranked.
    """
    number = uniform(seed, "slide_id", "patch_idx")
    per_slide = _narrow(patches).withColumn("u", number).groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("__n"),
        F.max((F.col("u") > p).cast("int")).alias("__any"),
        F.max_by("patch_idx", F.struct("u", "patch_idx")).alias("__best"),
    )
    rescued = per_slide.filter((F.col("__any") == 0) | (F.col("__n") == 1)).select(
        "slide_id", F.col("__best").alias("patch_idx"), F.lit(True).alias("__rescued")
    )
    joined = beside(patches, rescued, KEY, "left")
    return joined.filter((number > p) | F.col("__rescued")).drop("__rescued")


def feature_noise(patches: DataFrame, sigma: float, seed: int = 42) -> DataFrame:
    """Add normal noise to every feature value, keyed by slide, patch and position."""
    kind = patches.schema["features"].dataType
    noisy = F.transform(
        "features",
        lambda v, i: v + F.lit(sigma) * normal(seed, F.col("slide_id"), F.col("patch_idx"), i),
    )
    return patches.withColumn("features", noisy.cast(kind))


# --- assembly ---------------------------------------------------------------


def assemble_bags(patches: DataFrame, max_instances: int, pad: bool = True, width: int | None = None) -> DataFrame:
    """One row per slide: ordered features and coordinates, length and mask.

    The cap comes first, so a row never holds more than ``max_instances`` patches;
    patches beyond it stay in the patch table.  ``width`` is the padded length
    (``max_instances`` by default); padding rows are zeros with mask 0.
    """
    if not max_instances or max_instances <= 0:
        raise ValueError("assemble_bags needs a positive max_instances: a whole bag may not fit one row")
    item = F.struct("patch_idx", "features", "x", "y")
    bags = cap_first_k(patches, max_instances).groupBy("slide_id").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    out = bags.select(
        "slide_id",
        F.size("rows").alias("length"),
        F.transform("rows", lambda r: r["features"]).alias("features"),
        F.transform("rows", lambda r: F.array(r["x"], r["y"])).alias("coords"),
        F.array_repeat(F.lit(1), F.size("rows")).alias("mask"),
    )
    return _padded(out, F.lit(width or max_instances)).select(*out.columns) if pad else out


def assemble_batches(patches: DataFrame, batches: DataFrame, max_instances: int) -> DataFrame:
    """Bags of every batch padded to the longest bag of their batch, with ``bucket, batch_no``.

    ``batches`` has ``slide_id, bucket, batch_no`` (see :func:`length_bucket_batches`); slides in no batch are left out.
    """
    bags = assemble_bags(patches, max_instances, pad=False)
    placed = bags.join(batches.select("slide_id", "bucket", "batch_no"), "slide_id")
    longest = placed.groupBy("bucket", "batch_no").agg(F.max("length").alias("width"))
    return _padded(placed.join(longest, ["bucket", "batch_no"]), F.col("width"))


def _padded(out: DataFrame, width: Column) -> DataFrame:
    """Zero rows with mask 0 up to a length; further columns stay."""
    gap = F.greatest(width - F.col("length"), F.lit(0))
    zero_features = F.transform(F.col("features")[0], lambda v: v - v)
    zero_coords = F.transform(F.col("coords")[0], lambda v: v - v)
    return out.select(
        *[c for c in out.columns if c not in ("features", "coords", "mask")],
        F.concat("features", F.array_repeat(zero_features, gap)).alias("features"),
        F.concat("coords", F.array_repeat(zero_coords, gap)).alias("coords"),
        F.concat("mask", F.array_repeat(F.lit(0), gap)).alias("mask"),
    )


# --- sampling of slides -----------------------------------------------------


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Inverse class frequency on every row."""
    counts = df.groupBy(label_col).agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    spread = ["slide_id"] if "slide_id" in df.columns else [c for c in df.columns if c != label_col] or [label_col]
    return lookup(df, counts, [label_col], spread)


def weighted_resample(slides: DataFrame, seed: int = 42) -> DataFrame:
    """As many draws with replacement as there are slides, every class equally likely.

    A draw first picks a class, then a place inside the class; places are exact
    hash ranks, so the final join has unique keys.
    """
    keyed = slides.select("slide_id", "label").withColumn("__key", hash_key(seed, "slide_id"))
    placed = ranked(
        keyed, ["label"], [F.col("__key"), F.col("slide_id")], [hash_bucket(F.col("__key"))], rank="place"
    ).select("label", "place", "slide_id")
    sizes = slides.groupBy("label").agg(F.count(F.lit(1)).alias("n"))  # one row per class
    order = Window.partitionBy().orderBy("label")
    classes = sizes.select("label", "n", (F.row_number().over(order) - 1).alias("class_no"))
    n_classes = sizes.agg(F.count(F.lit(1))).scalar()
    first, second = uniform_pair(f"{seed}:draw", "slide_id")
    draws = slides.select(
        F.col("slide_id").alias("draw_id"),
        F.floor(first * n_classes).cast("int").alias("class_no"),
        second.alias("u"),
    )
    aimed = lookup(draws, classes, ["class_no"], ["draw_id"])
    targets = aimed.select("draw_id", "label", (F.floor(F.col("u") * F.col("n")) + 1).alias("place"))
    return targets.join(placed, ["label", "place"]).select("draw_id", "slide_id", "label")


def length_bucket_batches(
    index: DataFrame, batch_size: int, bucket_size: int = 64, seed: int = 42, drop_last: bool = False
) -> DataFrame:
    """Batches of bags of similar size: buckets of the size order, shuffled outside and inside.

    Batches follow ``bucket_order, bucket, batch_no`` (a hash number, so buckets come
    in random order without being ranked again); ``slot`` orders the slides of a batch.
    """
    size = max(bucket_size, batch_size)
    keyed = index.select("slide_id", "n_patches").withColumn("__key", hash_key(seed, "slide_id"))
    placed = ranked(
        keyed,
        [],
        [F.col("n_patches"), F.col("__key"), F.col("slide_id")],
        [F.col("n_patches"), hash_bucket(F.col("__key"))],
        rank="place",
    )
    rows = placed.withColumn("bucket", F.floor((F.col("place") - 1) / size))
    inner = Window.partitionBy("bucket").orderBy(hash_key(seed, F.lit("inside"), "slide_id"), "slide_id")
    rows = rows.withColumn("__inner", F.row_number().over(inner) - 1)
    rows = rows.select(
        F.conv(hash_bucket(hash_key(seed, F.lit("bucket"), "bucket"), 8), 16, 10).cast("bigint").alias("bucket_order"),
        "bucket",
        F.floor(F.col("__inner") / batch_size).alias("batch_no"),
        (F.col("__inner") % batch_size).alias("slot"),
        "slide_id",
        "n_patches",
    )
    if drop_last:
        filled = F.count(F.lit(1)).over(Window.partitionBy("bucket", "batch_no"))
        rows = rows.withColumn("__n", filled).filter(F.col("__n") == batch_size).drop("__n")
    return rows


def padding_waste(batches: DataFrame) -> DataFrame:
    """Padded cells per batch: slides times the largest bag, against the patches really there."""
    return batches.groupBy("bucket", "batch_no").agg(
        F.count(F.lit(1)).alias("n_slides"),
        F.sum("n_patches").alias("n_patches"),
        (F.count(F.lit(1)) * F.max("n_patches") - F.sum("n_patches")).alias("padding"),
    )


def bag_size_stats(index: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Slides and patches per slide (mean, largest, all), per fold and role when roles are given."""
    aggregates = [
        F.count(F.lit(1)).alias("n_slides"),
        F.avg("n_patches").alias("mean_patches"),
        F.max("n_patches").alias("max_patches"),
        F.sum("n_patches").alias("total_patches"),
    ]
    if roles is None:
        return index.agg(*aggregates)
    sized = roles.select("fold", "role", "slide_id").join(index.select("slide_id", "n_patches"), "slide_id")
    return sized.groupBy("fold", "role").agg(*aggregates)
