"""Mixing sources to target weights along a curriculum that changes over training time.

Every source has a weight schedule: weights at knots of training time 0 to 1, linear in between.
The area under it is the source's share of the whole budget, its course says when the share is
used.  The demand of a source up to time t is its target times the area up to t over the whole
area; a document that starts at word c of its source's (repeated, hashed) sequence is trained at the time
when demand reaches c, found by inverting the piecewise quadratic area.  Documents are then
range-sorted by that position.

Only the table of sources, one row each, meets in one task; running sums over documents are taken
in ordered hash buckets, so a source with most of the rows is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagstats.functions.keys import hash_bucket, hash_key
from bagstats.sources.shared import written

WORDS = r"[\x20\x09-\x0D]+"
_EARLIER = (Window.unboundedPreceding, -1)


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    edge = r"[\x20\x09-\x0D]"
    pieces = F.size(F.split(text, WORDS)) - text.rlike("^" + edge).cast("int") - text.rlike(edge + r"\z").cast("int")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(pieces).cast("bigint")


def _area(knots: Sequence[float], weights: Sequence[float]) -> list[float]:
    """Area under the schedule up to each knot."""
    found = [0.0]
    for a, b, x, y in zip(knots[:-1], knots[1:], weights[:-1], weights[1:], strict=True):
        found.append(found[-1] + (b - a) * (x + y) / 2)
    return found


def schedule_area(knots: Sequence[float], weights: Sequence[float]) -> float:
    return _area(knots, weights)[-1]


def _when(share: Column, knots: Sequence[float], weights: Sequence[float]) -> Column:
    """Time at which the given share (0 to 1) of a schedule's area is used up."""
    area = _area(knots, weights)
    used = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * area[-1]
    spot = F.lit(float(knots[-1]))
    for k in reversed(range(len(knots) - 1)):
        width = knots[k + 1] - knots[k]
        slope = (weights[k + 1] - weights[k]) / width
        rest = F.greatest(used - area[k], F.lit(0.0))
        # root of weight * d + slope / 2 * d^2 = rest, in the form that holds for slope 0 too
        root = F.sqrt(F.greatest(F.lit(weights[k] ** 2) + 2 * slope * rest, F.lit(0.0)))
        step = F.when(root + weights[k] > 0, 2 * rest / (root + weights[k])).otherwise(0.0)
        spot = F.when(used <= area[k + 1], F.lit(float(knots[k])) + F.least(step, F.lit(float(width)))).otherwise(spot)
    return spot


def source_targets(
    sizes: DataFrame, schedules: Sequence[tuple[Sequence[float], Sequence[float]]], total_ratio: float, max_repeats: float
) -> DataFrame:
    """``source, source_no, source_size, target``: budget shared by weight, no source above ``max_repeats`` times its size.

    The excess of capped sources is shared again by weight.  In ascending order of limit over
    weight the capped sources come first, so the final level follows from running sums.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(schedule_area(*s)) for s in schedules])
    rows = per_source.select("*", number.alias("source_no"))
    rows = rows.select("*", F.get(weights, F.pmod("source_no", F.lit(len(schedules)))).alias("weight"))
    rows = rows.select("*", (F.col("source_size") * F.lit(float(max_repeats))).alias("cap"))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "source_no")
    rows = rows.select(
        "*",
        (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(total_ratio))).alias("budget"),
        F.coalesce(F.sum("cap").over(by_level.rowsBetween(*_EARLIER)), F.lit(0.0)).alias("capped"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    )
    # A source is capped if the level left after the caps before it would lift it above its own cap.
    level = (F.col("budget") - F.col("capped")) / F.col("open")
    full = level * F.col("weight") >= F.col("cap")
    rows = rows.select("*", full.alias("full"), level.alias("level"))
    # The first source that is not capped has the largest open weight and sees the level of all uncapped ones.
    seen = F.when(~F.col("full"), F.struct((-F.col("open")).alias("o"), F.col("level").alias("l")))
    first_open = F.min(seen).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("cap")).otherwise(first_open["l"] * F.col("weight"))
    return rows.select("source", "source_no", "source_size", target.alias("target"))


def assign(
    docs: DataFrame,
    schedules: Sequence[tuple[Sequence[float], Sequence[float]]],
    total_ratio: float = 1.5,
    max_repeats: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
    keep_row: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, taken, uses``; with ``keep_row`` the
    whole row as ``row`` too.

    ``uses`` lists the times the document is trained on, ``struct<position double, words long>``; its
    words are the document's size but for the use in which the source's target is reached, which
    takes only what is missing (so a source takes its target, rounded to a word).  Sources are
    taken in code point order, null last as a source of its own, and get the schedules in turn.
    A null or empty text has size 0 and no use; repeated rows are documents of their own; a null id is
    an id like any other.  Other columns are ignored.
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_row else []
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *whole
    )
    sizes = written(rows.select("doc_id", "source", "size"), "sizes")
    targets = source_targets(sizes, schedules, total_ratio, max_repeats)

    # Place in the source's hashed order: whole buckets before, then rows of the same bucket.
    def filled(table: DataFrame) -> DataFrame:
        keyed = table.select("*", hash_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"))
        return keyed.select(
            "*", hash_bucket(F.col("key"), 4).alias("fine"), hash_bucket(F.col("key"), 2).alias("coarse"),
            F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("named"),
        )

    by = ["known", "named", "coarse"]
    pieces = filled(sizes).groupBy(*by, "fine").agg(F.sum("size").alias("sum"))
    inner = Window.partitionBy(*by).orderBy("fine")
    pieces = pieces.select("*", F.coalesce(F.sum("sum").over(inner.rowsBetween(*_EARLIER)), F.lit(0)).alias("inside"))
    outer = Window.partitionBy("known", "named").orderBy("coarse")
    wholes = pieces.groupBy(*by).agg(F.sum("sum").alias("sum"))
    wholes = wholes.select(*by, F.coalesce(F.sum("sum").over(outer.rowsBetween(*_EARLIER)), F.lit(0)).alias("outside"))
    known = targets.select(
        F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("named"), "source_no", "source_size", "target"
    )
    bases = pieces.join(wholes, by).join(known, ["known", "named"])
    bases = bases.select(*by, "fine", (F.col("inside") + F.col("outside")).alias("base"), "source_no", "source_size", "target")
    local = Window.partitionBy(*by, "fine").orderBy("key", "doc_id", "size").rowsBetween(*_EARLIER)
    placed = filled(rows if keep_row else sizes)
    placed = placed.select("*", F.coalesce(F.sum("size").over(local), F.lit(0)).alias("near")).join(bases, [*by, "fine"])
    placed = placed.withColumn("start", F.col("base") + F.col("near"))

    goal = F.round("target").cast("bigint")

    def use(epoch: Column) -> Column:
        begin = F.col("start") + epoch * F.col("source_size")
        share = begin / F.greatest(F.col("target"), F.lit(1.0))
        spot = F.lit(0.0)
        for k, (knots, weights) in enumerate(schedules):
            spot = F.when(F.pmod("source_no", F.lit(len(schedules))) == k, _when(share, knots, weights)).otherwise(spot)
        words = F.least(F.col("size"), F.greatest(goal - begin, F.lit(0)))
        return F.struct(spot.alias("position"), words.cast("bigint").alias("words"))

    epochs = [use(F.lit(e)) for e in range(-int(-max_repeats // 1))]
    uses = F.filter(F.array(*epochs), lambda u: u["words"] > 0)
    taken = F.aggregate("uses", F.lit(0).cast("bigint"), lambda total, u: total + u["words"])
    kept = ["doc_id", "size", "source", "source_size", "target", *(["row"] if keep_row else [])]
    return placed.select(*kept, uses.alias("uses")).select(*kept, taken.alias("taken"), "uses")


def range_sorted(uses: DataFrame, position: str, *ties: str) -> DataFrame:
    """Rows in training order: files and rows within them ascend by position."""
    return uses.repartitionByRange(F.col(position).asc_nulls_last(), *ties).sortWithinPartitions(
        F.col(position).asc_nulls_last(), *ties
    )


def first_words(text: Column, count: Column) -> Column:
    """The first ``count`` words of a text, joined by single blanks."""
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), F.greatest(count, F.lit(0)).cast("int")), " ")


def mix_sources(
    docs: DataFrame,
    schedules: Sequence[tuple[Sequence[float], Sequence[float]]],
    position_col: str = "position",
    words_col: str = "words",
    **options,
) -> DataFrame:
    """The mixed corpus in training order: all columns of ``docs`` and ``position``, ``words``, one row per use.

    The one use of a source in which its target is reached holds only the first ``words`` words of its
    text (joined by blanks).  Columns of ``docs`` that have the two new names are replaced; other names may be
    given for them.  Options are those of :func:`assign`.
    """
    text_col = options.get("text_col", "text")
    used = assign(docs, schedules, keep_row=True, **options).select("doc_id", "size", "row", F.explode("uses").alias("use"))
    text = F.col("row")[text_col]
    cut = F.when(F.col("use.words") < F.col("size"), first_words(text, F.col("use.words"))).otherwise(text)
    kept = [(cut if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c not in (position_col, words_col)]
    named = used.select(*kept, F.col("use.position").alias(position_col), F.col("use.words").alias(words_col))
    return range_sorted(named, position_col, options.get("id_col", "doc_id"))
