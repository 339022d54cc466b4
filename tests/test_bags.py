import numpy as np
import pytest
from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from bagstats.functions import spread
from bagstats.operators import bags as B
from bagstats.operators import coverage as C
from bagstats.sources import shared
from suite import views as V


@pytest.fixture(scope="module")
def patches(spark):
    """Bags of very different sizes and shapes; one holds most patches, most of them in one spot."""
    rng = np.random.default_rng(3)
    data = []
    for slide, n in enumerate([1, 2, 20, 21, 60, 300, 35]):
        for i in range(n):
            if slide == 5 and i < 200:
                x, y = 0, 0
            elif slide == 6:
                x, y = 256, 512
            else:
                x, y = int(rng.integers(0, 20)) * 256, int(rng.integers(0, 20)) * 256
            data.append((slide, i, x, y, [float(slide), float(i)]))
    return spark.createDataFrame(data, "slide_id int, patch_idx int, x int, y int, features array<double>").cache()


CAPS = {
    "first": lambda p, k: B.cap_first_k(p, k),
    "random": lambda p, k: B.cap_random_k(p, k, 1),
    "sqrt": lambda p, k: B.cap_spatial_sqrt(p, k, 4, 1),
    "sqrt_fine": lambda p, k: B.cap_spatial_sqrt(p, k, 32, 1),
    "proportional": lambda p, k: B.cap_spatial_proportional(p, k, 4, 1),
    "even": lambda p, k: B.cap_spatial_even(p, k, 4, 1),
}


@pytest.mark.parametrize("name", CAPS)
def test_caps_keep_exactly_k_without_repeats(spark, patches, name):
    k = 20
    out = CAPS[name](patches, k)
    assert out.columns == patches.columns
    got = {r.slide_id: (r.n, r.d) for r in out.groupBy("slide_id").agg(F.count("*").alias("n"), F.count_distinct("patch_idx").alias("d")).collect()}
    sizes = {r.slide_id: r["count"] for r in patches.groupBy("slide_id").count().collect()}
    assert got == {s: (min(n, k), min(n, k)) for s, n in sizes.items()}


@pytest.mark.parametrize("name", ["random", "sqrt", "proportional", "even"])
def test_caps_do_not_depend_on_partitioning(spark, patches, name):
    one = rows(CAPS[name](patches.repartition(1), 20).select("slide_id", "patch_idx"))
    many = rows(CAPS[name](patches.orderBy(F.rand(1)).repartition(17), 20).select("slide_id", "patch_idx"))
    assert one == many


def _sqrt_budget(sizes, k):
    """Small restatement of the greedy rule on the cells of one bag, in cell order."""
    sizes = np.asarray(sizes)
    ideal = k * np.sqrt(sizes) / np.sqrt(sizes).sum()
    budget = np.minimum(np.maximum(np.floor(ideal).astype(int), 1), sizes)
    gap = k - budget.sum()
    if gap > 0:
        rest = np.where(sizes == budget, -1.0, np.round(ideal - budget, 9))
        for j in sorted(range(len(sizes)), key=lambda j: (-rest[j], j)):
            give = min(gap, sizes[j] - budget[j])
            budget[j] += give
            gap -= give
    elif gap < 0:
        for j in sorted(range(len(sizes)), key=lambda j: (-budget[j], j)):
            cut = min(-gap, budget[j] - 1)
            budget[j] -= cut
            gap += cut
    return budget


def _proportional_budget(sizes, k):
    sizes = np.asarray(sizes)
    budget = np.minimum(np.round(sizes / sizes.sum() * k).astype(int), sizes)
    gap = k - budget.sum()
    room = sizes - budget
    if gap > 0:
        for j in sorted(range(len(sizes)), key=lambda j: (-room[j], j)):
            give = min(gap, room[j])
            budget[j] += give
            gap -= give
    elif gap < 0:
        for j in sorted(range(len(sizes)), key=lambda j: (-budget[j], j)):
            cut = max(0, min(-gap, budget[j] - 1))
            budget[j] -= cut
            gap += cut
    return budget


@pytest.mark.parametrize("k", [12, 20, 40, 70])
@pytest.mark.parametrize("kind", ["sqrt", "proportional"])
def test_cell_budgets_against_restatement(spark, patches, kind, k):
    _, cells = B._gridded(patches, kind, 3)
    slide = cells.groupBy("slide_id").agg(F.count("*").alias("c"))
    usable = cells.join(slide, "slide_id").filter((F.col("n") > k) & (F.col("c") < k)).drop("c")
    budgets = B._sqrt_budgets(usable, k) if kind == "sqrt" else B._proportional_budgets(usable, k)
    frame = budgets.select("slide_id", "cell", "n_cell", "quota").toPandas().sort_values(["slide_id", "cell"])
    assert len(frame)
    restate = _sqrt_budget if kind == "sqrt" else _proportional_budget
    for _, part in frame.groupby("slide_id"):
        assert list(part.quota) == list(restate(part.n_cell.to_numpy(), k))


def test_budgets_trim_and_clamp(spark):
    """Many tiny cells beside a big one: minimums exceed the budget, so the surplus is trimmed."""
    sizes = [1] * 15 + [400]
    cells = spark.createDataFrame([(0, c, n, sum(sizes)) for c, n in enumerate(sizes)], "slide_id int, cell int, n_cell bigint, n bigint")
    for k in (17, 18, 30):
        got = [r.quota for r in B._sqrt_budgets(cells, k).orderBy("cell").collect()]
        assert got == list(_sqrt_budget(sizes, k)) and sum(got) == k
        got = [r.quota for r in B._proportional_budgets(cells, k).orderBy("cell").collect()]
        assert got == list(_proportional_budget(sizes, k))


def test_even_cap_spreads(spark, patches):
    out = B.cap_spatial_even(patches.filter("slide_id = 5"), 40, 2, 1)
    hot = out.filter("x = 0 and y = 0").count()
    assert hot <= 40 - 10  # the hot spot does not take all


def test_crops_differ_and_repeat(spark, patches):
    out = B.multi_crop(patches, 3, 10).select("crop", "slide_id", "patch_idx").cache()
    views = [set(rows(out.filter(F.col("crop") == c).select("slide_id", "patch_idx"))) for c in range(3)]
    assert views[0] != views[1] != views[2]
    assert views[1] == set(rows(B.cap_random_k(patches, 10, 1000).select("slide_id", "patch_idx")))
    spatial = B.multi_crop(patches, 2, 10, "spatial_even")
    assert spatial.filter("slide_id = 5").groupBy("crop").count().collect()[0]["count"] == 10


def test_dropout_never_empties_a_bag(spark, patches):
    out = B.instance_dropout(patches, 0.999, 5)
    assert out.select("slide_id").distinct().count() == 7
    assert out.filter("slide_id = 0").count() == 1
    share = B.instance_dropout(patches, 0.5, 5).filter("slide_id = 5").count() / 300
    assert 0.4 < share < 0.6
    assert B.instance_dropout(patches, 0.0, 5).count() >= patches.count() - 1


def test_noise_has_the_right_scale(spark, patches):
    noisy = B.feature_noise(patches, 0.5, 1).withColumn("d", F.col("features")[1] - F.col("patch_idx"))
    stats = noisy.agg(F.avg("d").alias("m"), F.stddev("d").alias("s")).first()
    assert abs(stats.m) < 0.1 and abs(stats.s - 0.5) < 0.06


def test_assembly(spark, patches):
    bags = {r.slide_id: r for r in B.assemble_bags(patches, 25).collect()}
    assert bags[1].length == 2 and bags[5].length == 25
    assert [len(bags[1].features), len(bags[1].coords), len(bags[1].mask)] == [25, 25, 25]
    assert sum(bags[1].mask) == 2 and bags[1].features[1] == [1.0, 1.0] and bags[1].features[2] == [0.0, 0.0]
    assert [f[1] for f in bags[5].features] == [float(i) for i in range(25)]
    assert B.assemble_bags(patches, 25, pad=False).filter("slide_id = 1").first().mask == [1, 1]
    with pytest.raises(ValueError, match="max_instances"):
        B.assemble_bags(patches, None)


def test_weighted_resample_balances(spark):
    slides = spark.range(1000).select(F.col("id").alias("slide_id"), F.when(F.col("id") % 10 < 8, "a").otherwise("b").alias("label"))
    out = B.weighted_resample(slides, 1)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert sum(counts.values()) == 1000 and min(counts.values()) > 400
    assert out.join(slides, ["slide_id", "label"]).count() == 1000


def test_length_buckets(spark):
    index = spark.range(300).select(F.col("id").alias("slide_id"), (F.col("id") % 50 + 1).alias("n_patches"))
    out = B.length_bucket_batches(index, 8, 32, 1).toPandas()
    assert sorted(out.slide_id) == list(range(300))
    sizes = out.groupby(["bucket", "batch_no"]).size()
    assert sizes.max() == 8
    spans = out.groupby("bucket").n_patches.agg(lambda s: s.max() - s.min())
    assert spans.max() <= 7
    full = B.length_bucket_batches(index, 7, 32, 1, drop_last=True).toPandas()
    assert (full.groupby(["bucket", "batch_no"]).size() == 7).all()


def test_coverage(spark, patches):
    kept = B.cap_random_k(patches, 20, 1)
    stats = {r.slide_id: r for r in C.coverage_stats(patches, kept).collect()}
    assert (stats[5].n_total, stats[5].n_kept, stats[5].n_discarded, stats[5].coverage_pct) == (300, 20, 280, 6.67)
    assert stats[5].was_capped and not stats[2].was_capped
    assert [r.slide_id for r in C.worst_coverage(C.coverage_stats(patches, kept), 2).collect()] == [5, 4]
    view = C.coverage_overview(C.coverage_stats(patches, kept)).first()
    assert view.n_capped == 4 and view.min_pct == 6.67
    grid = C.coverage_grid(patches, kept).filter("slide_id = 6").collect()
    assert [(r.gx, r.gy, r.state) for r in grid] == [(0, 0, 2)]


def test_stride(spark):
    rows_ = [(0, i, x, 0) for i, x in enumerate([0, 256, 512, 1024])] + [(1, i, 5, y) for i, y in enumerate([0, 512, 1024])]
    rows_ += [(2, 0, 7, 7), (2, 1, 7, 7)]
    df = spark.createDataFrame(rows_, "slide_id int, patch_idx int, x int, y int")
    assert rows(C.infer_patch_stride(df)) == [(0, 256), (1, 512), (2, 256)]


def test_unknown_cap(patches):
    with pytest.raises(ValueError, match="Unknown cap strategy"):
        B.cap_by_name(patches, 5, "nope")
    with pytest.raises(ValueError, match="positive"):
        B.cap_by_name(patches, 0, "random")


CAPPED = {"first": {}, "random": {}, "spatial_sqrt": {"grid": 4}, "spatial_proportional": {"grid": 4}, "spatial_even": {"grid": 4}}


def _plan_lines(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


@pytest.mark.parametrize("strategy", CAPPED)
def test_no_exchange_carries_features(spark, strategy):
    """Caps, crops, flags and dropout read features once and leave them where they are."""
    path = shared.fresh_path(spark, "wide")
    data = [(s, i, (i * 7 + s) % 50, (i * 3) % 40, [float(i), 1.0]) for s in range(5) for i in range(60 + s)]
    spark.createDataFrame(data, "slide_id long, patch_idx int, x int, y int, features array<double>").repartition(3).write.parquet(path)
    wide = spark.read.parquet(path)
    views = [B.cap_by_name(wide, 10, strategy, **CAPPED[strategy]), B.cap_bags(wide, 10, strategy, **CAPPED[strategy])]
    if strategy == "random":
        views += [B.multi_crop(wide, 3, 10), B.instance_dropout(wide, 0.5)]
    for view in views:
        lines = _plan_lines(view)
        reads = [k for k, line in enumerate(lines) if "FileScan" in line and "features" in line]
        assert len(reads) == 1
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        above, level = [], depth(lines[reads[0]])
        for line in reversed(lines[: reads[0]]):  # the operators between the scan and the result
            if depth(line) < level:
                above.append(line)
                level = depth(line)
        assert not [line for line in above if "Exchange" in line]
    kept = views[0].groupBy("slide_id").count().collect()
    assert {r["count"] for r in kept} == {10}


@pytest.mark.parametrize("strategy", CAPPED)
def test_caps_of_null_slides_and_repeated_numbers(spark, strategy):
    data = [(None, i, i, i) for i in range(30)] + [(1, 5, i, 2 * i) for i in range(30)] + [(2, 0, 3, 3)]
    df = spark.createDataFrame(data, "slide_id long, patch_idx int, x int, y int")
    kept = {r.slide_id: r["count"] for r in B.cap_by_name(df, 7, strategy, **CAPPED[strategy]).groupBy("slide_id").count().collect()}
    assert kept == {None: 7, 1: 7, 2: 1}
    flagged = {r.slide_id: r.n for r in B.cap_bags(df, 7, strategy, **CAPPED[strategy]).filter("kept").groupBy("slide_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert flagged == kept


@pytest.mark.parametrize("strategy", CAPPED)
def test_caps_agree_with_and_without_a_broadcast(spark, monkeypatch, strategy):
    data = [(s, i, (i * 7 + s) % 50, (i * 3) % 40) for s in range(4) for i in range(40 + s)]
    df = spark.createDataFrame(data, "slide_id long, patch_idx int, x int, y int")
    near = rows(B.cap_by_name(df, 12, strategy, **CAPPED[strategy]))
    monkeypatch.setattr(spread, "BESIDE_ROWS", -1)
    assert rows(B.cap_by_name(df, 12, strategy, **CAPPED[strategy])) == near and len(near) == 48


@pytest.mark.parametrize("cap", ["spatial_sqrt", "spatial_even", "spatial_proportional"])
def test_a_cap_selects_once(spark, monkeypatch, cap):
    """Both kinds of cut-offs come from one written selection, and its order is made after rows are dealt, not carried by an exchange."""
    from bagstats.functions import spread
    from bagstats.sources import shared

    data = [(s, k, (k * 7) % 20 * 256, (k * 3) % 11 * 256) for s in (1, 2) for k in range(90)]
    patches = spark.createDataFrame(data, "slide_id long, patch_idx int, x int, y int")
    selections = []

    def recorded(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "Window" in plan:
            selections.append(plan)
        return shared.written(df, name)

    monkeypatch.setattr(spread, "written", recorded)
    monkeypatch.setattr(B, "written", recorded, raising=False)
    assert B.cap_by_name(patches, 20, cap, grid=6).count() == 40
    assert len(selections) == 1
    lines = selections[0].splitlines()
    carried = [below for line, below in zip(lines, lines[1:], strict=False) if "Exchange hashpartitioning" in line and "md5(" in below and "Aggregate" not in below]
    assert not carried


def test_patches_are_ranked_once(spark, sf):
    """Queries that read the patches several times find them written."""
    from suite import bags as SB

    plan = SB.grid_cells(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan


def _drawn(df, k, seed):
    """The first k of every slide in hash order, by one sort per slide."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("slide_id").cast("string"), F.col("patch_idx").cast("string")).cast("binary"))
    turn = F.row_number().over(Window.partitionBy("slide_id").orderBy(key, "patch_idx", F.xxhash64(F.col("x").cast("double"), F.col("y").cast("double"))))
    return df.withColumn("turn", turn).filter(F.col("turn") <= k).select("slide_id", "patch_idx", "x")


def test_a_random_draw_orders_only_what_may_be_drawn(spark, monkeypatch):
    bags = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("slide_id"), F.col("id").alias("patch_idx"), (F.col("id") * 7).alias("x"), F.lit(0).alias("y"))
    ordered = []
    monkeypatch.setattr(B, "keep_lowest", lambda rows, *more, **named: ordered.append(rows.count()) or spread.keep_lowest(rows, *more, **named))
    assert rows(B.cap_random_k(bags, 20, 5).select("slide_id", "patch_idx", "x")) == rows(_drawn(bags, 20, 5))
    crops = B.multi_crop(bags, 2, 20, seed=5)
    assert rows(crops.filter("crop = 1").select("slide_id", "patch_idx", "x")) == rows(_drawn(bags, 20, 1005))
    assert ordered == []


def test_a_random_draw_of_patches_of_one_number(spark):
    """Equal hashes: the share below the bound may hold too few, so the slide is drawn from all its patches."""
    one = spark.range(3000).select((F.col("id") % 3).alias("slide_id"), F.lit(4).alias("patch_idx"), F.col("id").alias("x"), F.lit(1).alias("y"))
    assert rows(B.cap_random_k(one, 20, 2).select("slide_id", "patch_idx", "x")) == rows(_drawn(one, 20, 2))
    flags = B.cap_bags(one, 20, "random", seed=2)
    assert flags.count() == 3000 and rows(flags.filter("kept").select("slide_id", "patch_idx", "x")) == rows(_drawn(one, 20, 2))


def test_many_kept_patches_meet_in_as_many_tasks_as_they_need(spark, monkeypatch):
    made = [(None, None, 1), (None, 2, 2), (1, 1, 3), (1, 1, 4), (1, None, 5), (0, 0, 6)]
    bags = spark.createDataFrame(made, "slide_id int, patch_idx int, x int")
    kept = spark.createDataFrame([(None, 2, 0), (1, 1, 0), (1, None, 0)], "slide_id int, patch_idx int, x int")
    want = [(None, 2, 2, True), (None, None, 1, False), (0, 0, 6, False), (1, 1, 3, True), (1, 1, 4, True), (1, None, 5, True)]
    assert rows(C.kept_vs_all(bags, kept)) == sorted(want, key=repr)
    monkeypatch.setattr(spread, "BESIDE_ROWS", -1)
    monkeypatch.setattr(spread, "TASK_ROWS", 1)
    out = C.kept_vs_all(bags, kept)
    dealt = [line for line in _plan_lines(out) if "Exchange hashpartitioning" in line]
    assert rows(out) == sorted(want, key=repr)
    assert len(dealt) == 2 and all(", 6), REPARTITION_BY_NUM" in line and "string" not in line for line in dealt)


def test_ranks_are_taken_in_as_many_tasks_as_given(spark):
    made = spark.range(90).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = spread.ranked(made, ["k"], [F.col("v")], [F.floor(F.col("v") / 10)], rank="r", tasks=11)
    plain = made.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    assert rows(out) == rows(plain) and any(", 11), REPARTITION_BY_NUM" in line for line in _plan_lines(out))


@pytest.mark.parametrize("cap", [B.cap_spatial_sqrt, B.cap_spatial_proportional, B.cap_spatial_even])
def test_cells_of_more_rows_than_a_task_give_the_same_patches(spark, patches, monkeypatch, cap):
    """Repeated and missing keys too; a cell is cut by salts first only if it is more than a task should order."""
    odd = patches.unionByName(patches.filter("patch_idx % 7 = 0")).unionByName(patches.limit(9).withColumn("slide_id", F.lit(None).cast("int")))
    wanted = rows(cap(odd, 12, 3, 5).select("slide_id", "patch_idx", "x", "y"))
    monkeypatch.setattr(B, "TASK_ROWS", 4)
    assert rows(cap(odd, 12, 3, 5).select("slide_id", "patch_idx", "x", "y")) == wanted
    assert any(r[0] is None for r in wanted)


def test_selection_moves_each_patch_once_and_no_hash(spark, patches, monkeypatch):
    """Of the tables that a cap writes, none has a hash, and none is made from hashes that were dealt."""
    plans, keep = {}, B.written

    def spy(df, name):
        plans[name] = (df.columns, df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(B, "written", spy)
    stored = shared.written(patches, "patches")
    B.cap_spatial_proportional(stored, 12, 3, 5).collect()
    columns, plan = plans["cuts"]
    assert columns == ["slide_id", "pool", "patch_idx", "x", "y"]
    assert plan.count("Exchange hashpartitioning") == 3  # patches and quotas, and cells for these
    assert "md5" in plan.split("Exchange hashpartitioning")[0] and "md5" not in plan.split("Exchange hashpartitioning", 1)[1]


def test_patches_of_line_items_are_the_same_by_either_ranking(spark, sf, monkeypatch):
    names = ["slide_id", "patch_idx", "x", "y"]
    whole = rows(V.patches(spark, sf))
    assert rows(V.patches(spark, sf, *names)) == sorted((r[:4] for r in whole), key=repr)
    monkeypatch.setattr(V, "TASK_ROWS", 4)
    assert rows(V.patches(spark, sf)) == whole
