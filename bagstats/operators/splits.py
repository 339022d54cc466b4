"""Leakage-safe split assignment: groups are placed, slides follow their group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagstats.functions.keys import hash_bucket, hash_key, uniform
from bagstats.functions.spread import category_grid, lookup, ranked
from bagstats.operators.manifest import filter_rule, group_majority_label
from bagstats.sources.shared import written

# Names of the split schemes and the columns each one adds.
SCHEME_COLUMNS = {
    "holdout": ["split"],
    "kfold": ["fold"],
    "custom_holdout": ["split"],
    "custom_kfold": ["fold", "split"],
    "monte_carlo": ["repeat", "split"],
}
TEST_FOLD = -1


def check_ratios(train: float | None, val: float | None, test: float | None) -> None:
    if train is None or val is None or test is None:
        raise ValueError("train, val and test ratios are all required")
    total = train + val + test
    if abs(total - 1.0) > 1e-6:
        raise ValueError(f"the shares of train, val and test have to sum to 1, not to {total}")


# --- shared steps -----------------------------------------------------------


def map_back(df: DataFrame, assign: DataFrame, on: str = "group_id") -> DataFrame:
    """Give every slide the assignment of its group (a group may own very many slides)."""
    columns = [c for c in assign.columns if c != on]
    return lookup(df, assign.select(on, *columns), [on], ["slide_id"])


def expand_to_groups(df: DataFrame, flag: str = "matched", group_col: str = "group_id") -> DataFrame:
    """A group with one flagged slide is flagged as a whole."""
    groups = df.groupBy(group_col).agg(F.max(flag).alias(flag))
    return lookup(df.drop(flag), groups, [group_col], ["slide_id"])


def _rank_in_label(groups: DataFrame, seed: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """Hash-ordered place of a group inside its label, with the label's group count.

    The hash prefix is the bucket, so a label that holds most groups is still cut evenly.
    """
    keyed = groups.withColumn("__key", hash_key(seed, "group_id"))
    return ranked(
        keyed,
        [*by, "label"],
        [F.col("__key"), F.col("group_id")],
        [hash_bucket(F.col("__key"))],
        rank="place",
        total="label_total",
    ).drop("__key")


def _label_table(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return groups.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))


def _with_quota(labels: DataFrame, size: str, share: float, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add whole groups per label for a share of all groups (rounded up), by largest remainder.

    ``labels`` has one row per label; the windows see nothing else.
    """
    whole = Window.partitionBy(*by)
    sized = labels.withColumn("__total", F.sum(size).over(whole))
    sized = sized.withColumn("__wanted", F.ceil(F.col("__total") * F.lit(share) - F.lit(1e-9)))
    sized = sized.withColumn("__exact", F.col(size) * F.col("__wanted") / F.greatest(F.col("__total"), F.lit(1)))
    sized = sized.withColumn("__base", F.floor(F.col("__exact") + F.lit(1e-9)))
    sized = sized.withColumn("__remainder", F.round(F.col("__exact") - F.col("__base"), 9))
    sized = sized.withColumn("__turn", F.row_number().over(whole.orderBy(F.col("__remainder").desc(), "label")))
    sized = sized.withColumn("__spare", F.col("__wanted") - F.sum("__base").over(whole))
    extra = (F.col("__turn") <= F.col("__spare")).cast("bigint")
    return sized.select(*labels.columns, (F.col("__base") + extra).alias(name))


def _take_share(groups: DataFrame, share: float, seed: int) -> DataFrame:
    """Flag ``taken``: a stratified share of the groups, exact per label."""
    quota = _with_quota(_label_table(groups), "n", share, "quota").select("label", "quota")
    joined = lookup(_rank_in_label(groups, seed), quota, ["label"], ["group_id"])
    return joined.select("group_id", "label", (F.col("place") <= F.col("quota")).alias("taken"))


def _assign_folds(groups: DataFrame, n_folds: int, seed: int) -> DataFrame:
    """Deal the groups out in turn, label after label, in hash order inside a label.

    The place in (label, hash) order does it all: each label continues where the
    previous one stopped, so fold sizes and label counts differ by at most one.
    """
    keyed = groups.withColumn("__key", hash_key(seed, "group_id"))
    order = [F.col("label"), F.col("__key"), F.col("group_id")]
    placed = ranked(keyed, [], order, [F.col("label"), hash_bucket(F.col("__key"))], rank="place")
    return placed.select("group_id", F.pmod(F.col("place") - 1, F.lit(n_folds)).cast("int").alias("fold"))


# --- schemes ----------------------------------------------------------------


def kfold_split(manifest: DataFrame, n_folds: int = 5, seed: int = 42, test_ratio: float | None = None) -> DataFrame:
    """Stratified folds over groups; a test share, if any, is set aside first as fold -1."""
    groups = group_majority_label(manifest)
    if not test_ratio:
        return map_back(manifest, _assign_folds(groups, n_folds, seed))
    quotas = _with_quota(_label_table(groups), "n", test_ratio, "test")
    before = Window.partitionBy().orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") - F.col("test")).over(before), F.lit(0))
    placed = lookup(
        _rank_in_label(groups, seed), quotas.select("label", "test", start.alias("start")), ["label"], ["group_id"]
    )
    turn = F.col("place") - F.col("test")
    fold = F.when(turn <= 0, F.lit(TEST_FOLD)).otherwise(F.pmod(turn - 1 + F.col("start"), F.lit(n_folds)))
    return map_back(manifest, placed.select("group_id", fold.cast("int").alias("fold")))


def _holdout_groups(
    groups: DataFrame, train: float, val: float, test: float, seed: int | Column, by: Sequence[str] = ()
) -> DataFrame:
    """One hash order per label: its first groups are test, the next ones validation."""
    labels = _with_quota(_label_table(groups, by), "n", test, "test", by)
    labels = labels.withColumn("rest", F.col("n") - F.col("test"))
    labels = _with_quota(labels, "rest", val / (train + val), "val", by).select(*by, "label", "test", "val")
    placed = lookup(_rank_in_label(groups, seed, by), labels, [*by, "label"], ["group_id"])
    place = F.col("place")
    role = F.when(place <= F.col("test"), "test").when(place <= F.col("test") + F.col("val"), "val").otherwise("train")
    return placed.select(*by, "group_id", role.alias("split"))


def holdout_split(manifest: DataFrame, train: float, val: float, test: float, seed: int = 42) -> DataFrame:
    """Train / val / test by ratio, stratified by label, whole groups only."""
    check_ratios(train, val, test)
    return map_back(manifest, _holdout_groups(group_majority_label(manifest), train, val, test, seed))


def monte_carlo_split(
    manifest: DataFrame, n_repeats: int, train: float, val: float, test: float, seed: int = 42
) -> DataFrame:
    """Independent repeated hold-outs in one job: the repeat is a column, not a loop."""
    check_ratios(train, val, test)
    repeats = F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1)))
    groups = group_majority_label(manifest).select("*", repeats.alias("repeat"))
    assigned = _holdout_groups(groups, train, val, test, F.col("repeat") + F.lit(seed), by=["repeat"])
    per_group = assigned.groupBy("group_id").agg(
        F.collect_list(F.struct("repeat", "split")).alias("__all")  # n_repeats entries per group
    )
    slides = map_back(manifest, per_group).withColumn("__one", F.explode("__all"))
    return slides.select("*", "__one.repeat", "__one.split").drop("__all", "__one")


def custom_holdout_split(
    manifest: DataFrame,
    test_filter: str,
    val_filter: str | None = None,
    val_ratio: float | None = None,
    train_ratio: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """A rule picks the test groups; validation by a second rule or by ratio of the rest."""
    if not test_filter:
        raise ValueError("custom_holdout requires test_filter")
    columns = manifest.columns
    flagged = expand_to_groups(filter_rule(manifest, test_filter, "is_test"), "is_test")
    if val_filter:
        inside = filter_rule(flagged, val_filter, "is_val")
        inside = inside.withColumn("is_val", F.col("is_val") & ~F.col("is_test"))
        both = expand_to_groups(inside, "is_val")
    elif val_ratio:
        share = val_ratio / (train_ratio + val_ratio) if train_ratio is not None else val_ratio
        rest = group_majority_label(flagged.filter(~F.col("is_test")))
        taken = _take_share(rest, share, seed).filter("taken").select("group_id", F.lit(True).alias("is_val"))
        both = lookup(flagged, taken, ["group_id"], ["slide_id"], how="left")
    else:
        both = flagged.withColumn("is_val", F.lit(False))
    role = F.when(F.col("is_test"), "test").when(F.coalesce("is_val", F.lit(False)), "val").otherwise("train")
    return both.select(*columns, role.alias("split"))


def custom_kfold_split(
    manifest: DataFrame, test_filter: str, n_folds: int = 5, seed: int = 42, val_filter: str | None = None
) -> DataFrame:
    """A rule picks the fixed test groups (fold -1); the rest is dealt into folds."""
    if not test_filter:
        raise ValueError("custom_kfold requires test_filter")
    if val_filter:
        raise ValueError("custom_kfold has no use for val_filter")
    flagged = expand_to_groups(filter_rule(manifest, test_filter, "is_test"), "is_test")
    test = flagged.filter("is_test").drop("is_test")
    pool = flagged.filter(~F.col("is_test")).drop("is_test")
    placed = map_back(pool, _assign_folds(group_majority_label(pool), n_folds, seed))
    placed = placed.withColumn("split", F.lit("train_val_pool"))
    out = test.withColumn("fold", F.lit(TEST_FOLD)).withColumn("split", F.lit("test")).unionByName(placed)
    enough = pool.agg(F.count(F.lit(1))).scalar() >= F.lit(n_folds)
    message = F.lit(f"Not enough slides remain for {n_folds} folds after removing the test set")
    checked = F.when(enough, F.col("fold")).otherwise(F.raise_error(message).cast("int"))
    return out.withColumn("fold", checked)


def hash_threshold_split(df: DataFrame, ratios: dict[str, float], seed: int = 42, key: str = "group_id") -> DataFrame:
    """Hold-out without ranking or shuffle: the expected shares hold, exact counts do not."""
    if abs(sum(ratios.values()) - 1.0) > 1e-6:
        raise ValueError(f"the shares have to sum to 1, not to {sum(ratios.values())}")
    number = uniform(seed, key)
    names = list(ratios)
    edge, role = 0.0, None
    for name in names[:-1]:
        edge += ratios[name]
        role = F.when(number < edge, name) if role is None else role.when(number < edge, name)
    last = F.lit(names[-1])
    return df.withColumn("split", last if role is None else role.otherwise(last))


def generate(manifest: DataFrame, scheme: str, **kwargs) -> DataFrame:
    """Split by scheme name."""
    makers = {
        "holdout": holdout_split,
        "kfold": kfold_split,
        "custom_holdout": custom_holdout_split,
        "custom_kfold": custom_kfold_split,
        "monte_carlo": monte_carlo_split,
    }
    if scheme not in makers:
        raise ValueError(f"Unknown scheme '{scheme}'. Must be one of: {sorted(makers)}")
    return makers[scheme](manifest, **kwargs)


def finalize_split_columns(
    df: DataFrame,
    scheme: str,
    label_col: str = "label",
    filename_col: str = "filename",
    group_col: str | None = None,
    site_col: str | None = None,
) -> DataFrame:
    """Column order of a split table: ids, file, label, scheme columns, site."""
    first = ["slide_id", "group_id", filename_col, label_col, *SCHEME_COLUMNS.get(scheme, [])]
    if site_col:
        first.append(site_col)
    if group_col and group_col in df.columns and group_col != "group_id":
        first = ["slide_id", group_col, *first[2:], "group_id"]
    return df.select(*dict.fromkeys(c for c in first if c in df.columns))


# --- roles ------------------------------------------------------------------


def fold_roles(splits: DataFrame, scheme: str, n_folds: int | None = None, refit: bool = False) -> DataFrame:
    """``fold, slide_id, role`` for every fold; with ``refit`` everything but the test set trains."""
    extra = [c for c in ("group_id", "label") if c in splits.columns]
    if scheme in ("kfold", "custom_kfold"):
        if refit:
            role = F.when(F.col("fold") == TEST_FOLD, "test").otherwise("train")
            return splits.select(F.lit(0).alias("fold"), "slide_id", *extra, role.alias("role"))
        if not n_folds:
            raise ValueError("n_folds is required for fold schemes")
        own = splits.withColumnRenamed("fold", "__own")
        rows = own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
        role = (
            F.when(F.col("__own") == TEST_FOLD, "test").when(F.col("__own") == F.col("fold"), "val").otherwise("train")
        )
    elif scheme in ("holdout", "custom_holdout"):
        rows, role = splits.withColumn("fold", F.lit(0)), F.col("split")
    elif scheme == "monte_carlo":
        missing = {"repeat", "split"} - set(splits.columns)
        if missing:
            raise ValueError(f"a repeated split table lacks the columns {sorted(missing)}")
        rows, role = splits.withColumn("fold", F.col("repeat")), F.col("split")
    else:
        raise ValueError(f"Unknown split scheme '{scheme}'. Must be one of: {sorted(SCHEME_COLUMNS)}")
    if refit:
        role = F.when(role == "test", "test").otherwise("train")
    return rows.select("fold", "slide_id", *extra, role.alias("role"))


def all_training_ids(splits: DataFrame, scheme: str) -> DataFrame:
    """Every slide that may be trained on: all but the test set (first repeat of repeated splits)."""
    if scheme in ("kfold", "custom_kfold"):
        rows = splits.filter(F.col("fold") != TEST_FOLD)
    elif scheme in ("holdout", "custom_holdout"):
        rows = splits.filter(F.col("split").isin("train", "val"))
    elif scheme == "monte_carlo":
        rows = splits.filter((F.col("repeat") == 0) & F.col("split").isin("train", "val"))
    else:
        raise ValueError(f"Unknown split scheme '{scheme}'. Must be one of: {sorted(SCHEME_COLUMNS)}")
    return rows.select("slide_id").distinct()


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack repeats, folds or models with the same columns."""
    first, *others = frames
    for other in others:
        first = first.unionByName(other)
    return first


def shard(df: DataFrame, n: int, order_col: str = "slide_id") -> DataFrame:
    """Every n-th row of the sorted list gets the same ``shard``; ids must be unique.

    The rows are dealt to sorted ranges by Spark's own sampling, whatever their ids have in common, and written once; the
    counted rows of earlier ranges (one number a range, so they are broadcast) give every row its place.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(width, order_col).withColumn("__range", F.spark_partition_id())
    stored = written(ranges, "ranges")
    counts = stored.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order_col)) - 1
    placed = stored.withColumn("__inside", inside).join(F.broadcast(offsets), "__range")
    place = F.col("__offset") + F.col("__inside")
    return placed.withColumn("shard", F.pmod(place, F.lit(n)).cast("int")).select(*df.columns, "shard")


def hash_shard(df: DataFrame, n: int, key: str = "slide_id") -> DataFrame:
    """Even shards without any ordering or shuffle."""
    return df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


# --- reports and checks -----------------------------------------------------


def split_summary(splits: DataFrame) -> DataFrame:
    """Slides and groups per part of a split table: overall, per label, per fold / split, per both.

    Long form ``part, value, label, n_slides, n_groups``; null marks "all".
    """
    parts = [c for c in ("fold", "split", "repeat") if c in splits.columns]
    entries = [F.struct(F.lit("all").alias("part"), F.lit("all").alias("value"))]
    entries += [F.struct(F.lit(p).alias("part"), F.col(p).cast("string").alias("value")) for p in parts]
    cells = splits.groupBy(*parts, "label", "group_id").agg(F.count(F.lit(1)).alias("n"))
    long = cells.select(F.explode(F.array(*entries)).alias("e"), "label", "group_id", "n")
    long = long.groupBy("e.part", "e.value", "label", "group_id").agg(F.sum("n").alias("n"))
    sets = long.groupingSets(
        [[F.col("part"), F.col("value"), F.col("label")], [F.col("part"), F.col("value")]],
        "part",
        "value",
        "label",
    )
    return sets.agg(F.sum("n").alias("n_slides"), F.count_distinct("group_id").alias("n_groups"))


def split_preview(manifest: DataFrame, test_filter: str | None = None) -> DataFrame:
    """Sizes before any assignment: slides, groups, labels and rule matches, one row per label."""
    rule = filter_rule(manifest, test_filter) if test_filter else manifest.withColumn("matched", F.lit(None).cast("boolean"))
    sets = rule.groupingSets([[F.col("label")], []], "label")
    return sets.agg(
        F.count(F.lit(1)).alias("n_slides"),
        F.count_distinct("group_id").alias("n_groups"),
        F.sum(F.col("matched").cast("bigint")).alias("n_matched"),
    )


def site_shares(splits: DataFrame, site_col: str, split_col: str) -> DataFrame:
    """Share of every site inside every split against its overall share, absent cells included."""
    counts = splits.groupBy(site_col, split_col).agg(F.count(F.lit(1)).alias("n"))
    full = category_grid(counts, site_col, split_col).join(counts, [site_col, split_col], "left")
    cells = full.withColumn("n", F.coalesce("n", F.lit(0)))  # sites x splits rows
    in_split = F.sum("n").over(Window.partitionBy(split_col))
    in_site = F.sum("n").over(Window.partitionBy(site_col))
    whole = F.sum("n").over(Window.partitionBy())
    shares = cells.select(
        site_col, split_col, "n", (F.col("n") / in_split).alias("share"), (in_site / whole).alias("overall")
    )
    return shares.withColumn("deviation", F.abs(F.col("share") - F.col("overall")))


def site_balance(splits: DataFrame, site_col: str, split_col: str, limit: float = 0.15) -> DataFrame:
    """The worst deviation of a site's share and whether it passes the limit."""
    shares = site_shares(splits, site_col, split_col)
    worst = F.struct(F.round("deviation", 9), F.col(site_col), F.col(split_col).cast("string"))
    return shares.agg(
        F.max("deviation").alias("max_deviation"),
        F.max_by(site_col, worst).alias("worst_site"),
        F.max_by(F.col(split_col).cast("string"), worst).alias("worst_split"),
        (F.max("deviation") > limit).alias("imbalanced"),
    )


def split_leakage(roles: DataFrame, group_col: str = "group_id") -> DataFrame:
    """Violations of a role table: groups in two roles of a fold, slides placed twice in a fold."""
    groups = roles.groupBy("fold", group_col).agg(F.count_distinct("role").alias("n"))
    slides = roles.groupBy("fold", "slide_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        groups.filter("n > 1")
        .select("fold", F.col(group_col).cast("string").alias("id"), F.lit("group in several roles").alias("rule"), "n")
        .unionByName(
            slides.filter("n > 1").select(
                "fold", F.col("slide_id").cast("string").alias("id"), F.lit("slide placed twice").alias("rule"), "n"
            )
        )
    )


def small_labels(manifest: DataFrame, n_folds: int) -> DataFrame:
    """Labels with fewer groups than folds: some fold will miss them."""
    return _label_table(group_majority_label(manifest)).filter(F.col("n") < n_folds)
