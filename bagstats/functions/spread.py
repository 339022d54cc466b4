"""Skew-safe ranking, running sums, top-n and lookups.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  The helpers
here first cut every key into ordered buckets (or salts), work inside the pieces,
and add the totals of the preceding pieces, so a key that holds a third of all
rows is still spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagstats.sources.shared import written

_EARLIER = (Window.unboundedPreceding, -1)
BESIDE_ROWS = 500_000  # of a narrow table that may be broadcast
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_MAP_BITS = 32_768  # of Spark's bit map aggregate
TASK_ROWS = 250_000  # narrow rows that a task sorts in memory


def _pieces(df: DataFrame, ceiling: int) -> int:
    """How many pieces a key is cut into: one per shuffle partition, within a ceiling."""
    return max(2, min(ceiling, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def tasks_for(df: DataFrame, rows: int) -> int:
    """Partitions for a known number of rows: at least Spark's own number, and enough that no task sorts more than fits in memory."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _or_zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def _lowest(df: DataFrame, name: str) -> Column:
    """A level with null as its lowest value: it may share a bucket with that value, whose rows it precedes."""
    kind = df.schema[name].dataType.simpleString()
    floor = {"string": "", "int": -(2**31), "bigint": -(2**63), "double": float("-inf"), "float": float("-inf")}.get(kind)
    return F.col(name) if floor is None else F.coalesce(F.col(name), F.lit(floor).cast(kind))


def _keys(df: DataFrame, names: Sequence[str], mark: str) -> tuple[list[Column], list[str]]:
    """Columns by which rows of equal ``names`` meet in a join, null with null."""
    columns, keys = [], []
    for i, name in enumerate(names):
        if df.schema[name].nullable:
            keys += [f"__{mark}{i}", f"__{mark}{i}null"]
            columns += [F.coalesce(F.col(name).cast("string"), F.lit("")).alias(keys[-2]), F.col(name).isNull().alias(keys[-1])]
        else:
            keys.append(f"__{mark}{i}")
            columns.append(F.col(name).cast("string").alias(keys[-1]))
    return columns, keys


def _whole_keys(df: DataFrame, names: Sequence[str], mark: str, plain: Sequence[str]) -> tuple[list[Column], list[str], dict[str, Column]]:
    """The same with whole numbers (``plain``) left as they are, and how these columns are had back from their keys: an exchange need not carry both."""
    columns, keys, back = [], [], {}
    for i, name in enumerate(names):
        key, null = f"__{mark}{i}", f"__{mark}{i}null"
        kind = df.schema[name].dataType.simpleString()
        value = F.coalesce(F.col(name), F.lit(0).cast(kind)) if name in plain else F.coalesce(F.col(name).cast("string"), F.lit(""))
        columns += [value.alias(key), F.col(name).isNull().alias(null)]
        keys += [key, null]
        if name in plain:
            back[name] = F.when(~F.col(null), F.col(key)).alias(name)
    return columns, keys, back


def _plain(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if df.schema[c].dataType.simpleString() in _WHOLE]


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    levels: Sequence[Column],
    sums: Mapping[str, Column],
    tasks: int | None = None,
) -> DataFrame:
    """Add ``<name>_before`` (sum over earlier rows of the group) and ``<name>_total``.

    ``levels`` are bucket expressions from coarse to fine; each must follow the
    row order.  Null is a group of its own and the lowest level.  ``tasks`` is the number of partitions in which rows are
    ordered, if it is known (see :func:`tasks_for`).
    """
    made, by, back = _whole_keys(df, list(by), "by", _plain(df, by))
    marks = [f"__level{i}" for i in range(len(levels))]
    base = df.select("*", *made, *[c.alias(m) for c, m in zip(levels, marks, strict=True)])
    base = base.withColumns({m: _lowest(base, m) for m in marks})
    base = base.select("*", *[c.alias(f"__v_{n}") for n, c in sums.items()])

    pieces = base.groupBy(*by, *marks).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums])
    offsets = _level_offsets(pieces, by, marks, list(sums))

    local = Window.partitionBy(*by, *marks).orderBy(*order).rowsBetween(*_EARLIER)
    dealt = base.repartition(tasks, *by, *marks) if tasks and (by or marks) else base
    inside = dealt.select("*", *[_or_zero(F.sum(f"__v_{n}").over(local)).alias(f"__in_{n}") for n in sums])
    joined = inside.join(offsets, [*by, *marks])
    before = {
        n: sum((F.col(f"__b{d}_{n}") for d in range(1, len(marks) + 1)), F.col(f"__in_{n}")) for n in sums
    }
    return joined.select(
        *[back.get(c, F.col(c)) for c in df.columns],
        *[c.alias(f"{n}_before") for n, c in before.items()],
        *[F.col(f"{n}_total") for n in sums],
    )


def _level_offsets(pieces: DataFrame, by: list[str], marks: list[str], names: list[str]) -> DataFrame:
    """Sum of everything before each piece, one column ``__b<depth>_<name>`` per level, and group totals.

    A level is summed inside its parent, so no window sees more than one parent's
    pieces.  The parents are the first rows of that same window: both uses read one shuffle.
    """
    parent = Window.partitionBy(*by, *marks[:-1])
    ordered = parent.orderBy(marks[-1])
    depth = len(marks)
    table = pieces.select(
        *by,
        *marks,
        F.row_number().over(ordered).alias("__first"),
        *[_or_zero(F.sum(f"__s_{n}").over(ordered.rowsBetween(*_EARLIER))).alias(f"__b{depth}_{n}") for n in names],
        *[F.sum(f"__s_{n}").over(parent).alias(f"__whole_{n}") for n in names],
    )
    if depth == 1:
        return table.select(
            *by, *marks, *[f"__b1_{n}" for n in names], *[F.col(f"__whole_{n}").alias(f"{n}_total") for n in names]
        )
    parents = table.filter("__first = 1").select(
        *by, *marks[:-1], *[F.col(f"__whole_{n}").alias(f"__s_{n}") for n in names]
    )
    upper = _level_offsets(parents, by, marks[:-1], names)
    fine = table.select(*by, *marks, *[f"__b{depth}_{n}" for n in names])
    return fine.join(upper, [*by, *marks[:-1]])


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    levels: Sequence[Column],
    rank: str = "rank",
    total: str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Exact 1-based row number inside each group, optionally with the group size."""
    out = running_sums(df, by, order, levels, {"__one": F.lit(1).cast("bigint")}, tasks)
    columns = [(F.col("__one_before") + 1).alias(rank)]
    if total is not None:
        columns.append(F.col("__one_total").alias(total))
    return out.select(*df.columns, *columns)


def lookup(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Join a long table to a one-row-per-key table; null keys meet too.

    A key with very many rows is split by adaptive execution (its skew join), so the short
    side is not multiplied; no broadcast is forced.
    """
    columns = [*big.columns, *[c for c in small.columns if c not in on]]
    if not any(big.schema[c].nullable and small.schema[c].nullable for c in on):
        return big.join(small, list(on), how).select(*columns)
    made_big, keys = _keys(big, on, "on")
    made_small, small_keys = _keys(small, on, "on")
    if keys != small_keys:  # only one side can be null: nothing but equal values can meet
        return big.join(small, list(on), how).select(*columns)
    left = big.select("*", *made_big)
    right = small.select(*[c for c in small.columns if c not in on], *made_small)
    return left.join(right, keys, how).select(*columns)


def beside(wide: DataFrame, narrow: DataFrame, on: Sequence[str], how: str = "inner", stored: bool = False) -> DataFrame:
    """Join a table of wide rows to a narrow one, null with null, and leave the wide rows where they are if that can be.

    The narrow table is written first, unless it is ``stored`` already, and counted.  Up to ``BESIDE_ROWS`` rows, a few dozen megabytes, it is broadcast, so that no
    exchange carries the wide rows; beyond that both sides meet by their keys.
    """
    held = narrow if stored else written(narrow, "beside")
    renamed = held.select(*[F.col(c).alias(f"__at_{c}") for c in on], *[c for c in held.columns if c not in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__at_{c}")) for c in on])
    if held.count() <= BESIDE_ROWS:
        renamed = F.broadcast(renamed)
    more = [] if how in ("left_semi", "left_anti") else [c for c in held.columns if c not in on]
    return wide.join(renamed, same, how).select(*wide.columns, *more)


def meet(big: DataFrame, small: DataFrame, on: Sequence[str], how: str, tasks: int) -> DataFrame:
    """Join two long tables, null with null, in ``tasks`` partitions (see :func:`tasks_for`)."""
    plain = [c for c in _plain(big, on) if big.schema[c].dataType == small.schema[c].dataType]
    made_big, keys, back = _whole_keys(big, on, "on", plain)
    made_small = _whole_keys(small, on, "on", plain)[0]
    more = [c for c in small.columns if c not in on]
    left = big.select("*", *made_big).repartition(tasks, *keys)
    right = small.select(*more, *made_small).repartition(tasks, *keys)
    return left.join(right, keys, how).select(*[back.get(c, F.col(c)) for c in big.columns], *more)


def met_ranked(
    big: DataFrame, small: DataFrame, on: Sequence[str], order: Callable[[DataFrame], Sequence[Column]], rank: str, tasks: int
) -> DataFrame:
    """Rows of ``big`` beside theirs of ``small``, null with null, and their row number by ``order`` among those of one key.

    Both sides are dealt once, in ``tasks`` partitions, for the join and for the order; no key may have more rows than a task can order.
    """
    # A flag that is a constant would be taken out of the keys after rows are dealt by it, and they would be dealt again.
    null = [c for c in on if big.schema[c].nullable and small.schema[c].nullable]
    plain = [c for c in _plain(big, null) if big.schema[c].dataType == small.schema[c].dataType]
    made_big, keys, back = _whole_keys(big, null, "on", plain)
    made_small = _whole_keys(small, null, "on", plain)[0]
    sure = [c for c in on if c not in null]
    more = [c for c in small.columns if c not in on]
    left = big.select(*[c for c in big.columns if c not in back], *made_big).repartition(tasks, *keys, *sure)
    right = small.select(*more, *sure, *made_small).repartition(tasks, *keys, *sure)
    met = left.join(right, [*keys, *sure]).select("*", *back.values())
    turn = F.row_number().over(Window.partitionBy(*keys, *sure).orderBy(*order(met)))
    return met.select(*big.columns, *more, turn.alias(rank))


def keep_lowest(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    quota: int | Column,
    spread_by: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """First ``quota`` rows of every group.

    Each salt of a group keeps its own first ``quota`` rows, so the final pass sees
    at most salts * quota rows of a group whatever the group's size.
    Rows are dealt before they are ordered, so that no exchange carries the values of ``order``, in ``tasks`` partitions if that is given.
    """
    dealt = [tasks] if tasks else []
    limit = F.lit(quota) if isinstance(quota, int) else quota
    mark = "__salt"
    df = df.withColumn(mark, F.pmod(F.xxhash64(*spread_by), F.lit(_pieces(df, 64)))).repartition(*dealt, *by, mark)
    near = Window.partitionBy(*by, mark).orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    out = (
        df.withColumn("__place", F.row_number().over(near))
        .filter(F.col("__place") <= limit)
        .drop(mark, "__place")
        .repartition(*dealt, *by)
        .withColumn("__place", F.row_number().over(final))
        .filter(F.col("__place") <= limit)
    )
    return out.drop("__place")


def spread_out(df: DataFrame, *by: str) -> DataFrame:
    """Full shuffle width before rows are multiplied: adaptive execution sizes partitions by what
    goes in, so a small table would otherwise be exploded by one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def category_grid(counts: DataFrame, left: str, right: str) -> DataFrame:
    """All pairs of two small category columns of a count table (one array of each, then exploded)."""
    arrays = counts.agg(F.collect_set(left).alias("__l"), F.collect_set(right).alias("__r"))
    return arrays.select(F.explode("__l").alias(left), "__r").select(left, F.explode("__r").alias(right))


def even_buckets(df: DataFrame, value: str, bucket: str) -> DataFrame:
    """Add the number of the bucket of a numeric column: buckets follow its order and hold about equal shares of the rows.

    The cuts are quantiles of a mergeable sketch (KLL) of the column itself, so a narrow band of values is cut as finely as a wide one;
    there are about four buckets for each shuffle partition.  Null goes to bucket 0.  A row finds its bucket
    among the coarse cuts first and then among the fine ones between two of them.
    """
    side = max(4, min(64, round((4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) ** 0.5)))
    shares = F.array(*[F.lit(k / side**2) for k in range(1, side**2)])
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(2000))
    number = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    cuts = df.filter(number).agg(F.when(F.count(F.lit(1)) > 0, F.kll_sketch_get_quantile_double(sketch, shares)).alias("cuts"))
    held = df.withColumn("__cuts", cuts.scalar()).withColumn("__value", F.col(value).cast("double"))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda k: F.get(F.col("__cuts"), k * side - 1))
    held = held.withColumn("__step", F.coalesce(F.size(F.filter(coarse, lambda c: c < F.col("__value"))), F.lit(0)))
    fine = F.slice("__cuts", F.col("__step") * side + 1, F.lit(side - 1))
    inside = F.coalesce(F.size(F.filter(fine, lambda c: c < F.col("__value"))), F.lit(0))
    number = F.when(F.col("__value").isNull(), F.lit(0)).otherwise(F.col("__step") * side + inside)
    return held.withColumn(bucket, number).drop("__cuts", "__value", "__step")


def magnitude_bucket(value: Column, per_unit: int = 64) -> Column:
    """Bucket of a number that follows its order, even on a logarithmic scale."""
    size = F.floor(F.log1p(F.abs(value)) * F.lit(per_unit))
    return F.when(value >= 0, size).otherwise(-size - 1)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, fractions: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group without holding a group in one task; null and NaN are passed over.

    Equal values are counted first; ranks come from bucketed running sums; each
    quantile is then two conditional maxima in one aggregate.
    """
    number = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    counts = df.filter(number).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = running_sums(counts, by, [F.col(value)], [magnitude_bucket(F.col(value))], {"__c": F.col("__n")})
    last = F.col("__c_total") - 1
    picks = []
    for name, share in fractions.items():
        spot = F.lit(float(share)) * last
        for side, place in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            inside = (F.col("__c_before") <= place) & (place < F.col("__c_before") + F.col("__n"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"__{side}_{name}"))
        picks.append(F.max(spot - F.floor(spot)).alias(f"__t_{name}"))
    rows = placed.groupBy(*by).agg(*picks)
    out = [
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__t_{n}")).alias(n) for n in fractions
    ]
    return rows.select(*by, *out)


def _slots(most: int) -> int:
    """Bits of a map for ``most`` marks: 16 to 32 for each, 2^27 (16 MB) at most."""
    return min(1 << 27, max(_MAP_BITS, 1 << (16 * most - 1).bit_length()))


def marks_of(df: DataFrame, mark: Column, most: int) -> DataFrame:
    """``map, bits``: the bits of the marks (64-bit hashes) of a table with ``most`` rows or fewer, in maps of 4 KB."""
    slots = df.select(F.pmod(mark, F.lit(_slots(most))).alias("slot")).withColumn("map", F.expr(f"slot div {_MAP_BITS}"))
    place = F.expr(f"bitmap_construct_agg(slot % {_MAP_BITS})").alias("bits")
    return slots.repartition("map").groupBy("map").agg(place)  # marks travel, not a map from every task


def marked(df: DataFrame, mark: Column, marks: DataFrame, most: int) -> DataFrame:
    """Rows whose ``mark`` is in ``marks`` (of :func:`marks_of`, for the same ``most``), and one in 16 or fewer of the others.

    The maps are broadcast; a join with the marked rows themselves has to follow.  Above some 8 million marks more of the others pass.
    """
    rows = df.withColumn("__slot", F.pmod(mark, F.lit(_slots(most)))).withColumn("__map", F.expr(f"__slot div {_MAP_BITS}"))
    maps = marks.select(F.col("map").alias("__map"), F.col("bits").alias("__bits"))
    byte = F.conv(F.hex(F.expr(f"substr(__bits, cast(__slot % {_MAP_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("shiftright(__byte, cast(__slot % 8 as int)) & 1")
    found = rows.join(F.broadcast(maps), "__map").withColumn("__byte", byte).filter(bit == 1)
    return found.select(*[F.col(f"`{c}`") for c in df.columns])
