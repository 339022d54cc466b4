"""Chat formatting in budgeted windows, by DataFrame functions only.

A conversation is cut into windows of whole turns.  Prefix sums of turn tokens place every turn:
it is new in the window its first token falls into, at ``budget / 2`` new tokens a window less those of the conversation's
system turn, so that no turn waits for the packing of those before it.  A window also shows the conversation's first
system turn, if that came earlier, and as many of the turns just before it as fit into ``history`` tokens
and what the budget leaves.  Only the text of new target turns is under the loss; repeated turns are
context.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|`` (a line break in a role becomes ``<\\n``), so no control string can come
from a text and reading back gives every text as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagstats.functions.spread import running_sums
from bagstats.sources.shared import written

START, END = "<|im_start|>", "<|im_end|>\n"
TURN_COST = 5  # tokens of a turn's marks and role
_KEY = ["__known", "__conv"]


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def _role_in(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up: an estimate for prose.  Code and other scripts have more; give the true numbers for these."""
    return F.ceil(F.octet_length(text) / 4)


def most_tokens(text: Column) -> Column:
    """The bytes: no byte-level tokenizer makes more tokens of a text."""
    return F.octet_length(text)


def _placed(turns: DataFrame, names: Sequence[str], counted: Column | None) -> DataFrame:
    """Turns with their number in the conversation and the tokens before them; a conversation with most of the rows is spread."""
    conv, turn, role, text = names
    given = estimated_tokens(F.coalesce(F.col(text), F.lit(""))) if counted is None else F.coalesce(counted, F.lit(0))
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        (given + TURN_COST).cast("bigint").alias("tokens"),
    )
    rows = rows.select(
        "*",
        F.col("conv_id").isNotNull().alias("__known"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("__conv"),
        F.xxhash64("role", "text").alias("__tie"),
        F.coalesce("turn", F.lit(-(2**63))).alias("__order"),
    )
    order = [F.col("__order"), F.col("__tie"), F.col("role"), F.col("text")]
    levels = [F.shiftright("__order", 12), F.col("__order"), F.shiftright("__tie", 60)]
    sums = {"tokens": F.col("tokens"), "seq": F.lit(1).cast("bigint")}
    placed = running_sums(rows, _KEY, order, levels, sums)
    return placed.select(
        "conv_id", *_KEY, "turn", "role", "text", "tokens", F.col("tokens_before").alias("before"), F.col("seq_before").alias("seq")
    )


def format_windows(
    turns: DataFrame,
    budget: int = 1024,
    history: int = 256,
    targets: Sequence[str] = ("assistant",),
    columns: Sequence[str] = ("conv_id", "turn", "role", "text"),
    tokens: Column | None = None,
) -> DataFrame:
    """``conv_id, window, tokens, formatted, spans``: one row per window.

    ``tokens`` gives the tokens of a turn's text (null: none); without it they are estimated from the bytes.

    ``spans`` has one struct per turn shown: ``turn, role, start, length`` (code points of the escaped text
    inside ``formatted``), ``repeated`` and ``loss``.  New tokens of a window stay under ``budget / 2`` less the system turn, plus its last
    turn, and the system turn is added; a turn is never cut.  So a window stays within the budget if no turn has more than half of it and the
    system turn less; a longer turn opens a window of its own behind it.

    Rows are ordered by turn (null first), then by a hash of role and text; repeated rows are turns of
    their own.  Null roles and texts are empty; rows without conversation id form one conversation;
    other columns are ignored; an empty table gives no window.
    """
    if not 0 <= history <= max(1, budget // 2):
        raise ValueError("history must be between 0 and half the budget")
    placed = written(_placed(turns, columns, tokens), "turns")  # read by every part below
    system = (
        placed.filter("role = 'system'")
        .groupBy(*_KEY)
        .agg(F.min_by(F.struct("seq", "turn", "role", "text", "tokens"), "seq").alias("system"))
    )
    system = written(system, "system")
    spent = system.select(*_KEY, F.col("system.tokens").alias("spent"))
    rows = placed.join(spent, _KEY, "left")
    step = F.greatest(F.lit(1), F.lit(budget // 2) - F.coalesce("spent", F.lit(0)))
    rows = rows.withColumn("step", step).withColumn("window", F.floor(F.col("before") / F.col("step"))).drop("spent")
    windows = rows.groupBy(*_KEY, "window").agg(
        F.min("before").alias("begin"), F.min("seq").alias("first_seq"), F.sum("tokens").alias("new_tokens"),
    )
    windows = windows.join(system, _KEY, "left")
    earlier = F.coalesce(F.col("system.seq") < F.col("first_seq"), F.lit(False))
    left = F.lit(budget) - F.col("new_tokens") - F.when(earlier, F.col("system.tokens")).otherwise(0)
    windows = windows.select("*", earlier.alias("shows_system"), F.greatest(F.lit(0), F.least(F.lit(history), left)).alias("room"))

    shown = ["seq", "turn", "role", "text", "tokens"]
    new = rows.select(*_KEY, "window", F.lit(1).alias("rank"), *shown, F.lit(False).alias("repeated"))
    again = rows.withColumn("last", F.floor((F.col("before") + history) / F.col("step"))).filter("last > window")
    again = again.withColumn("window", F.explode(F.sequence(F.col("window") + 1, F.col("last"))))
    again = again.join(windows.select(*_KEY, "window", "begin", "room", "shows_system", F.col("system.seq").alias("system_seq")), [*_KEY, "window"])
    again = again.filter("before >= begin - room and not (shows_system and seq = system_seq)")
    again = again.select(*_KEY, "window", F.lit(1).alias("rank"), *shown, F.lit(True).alias("repeated"))
    kept = windows.filter("shows_system").select(
        *_KEY, "window", F.lit(0).alias("rank"), *[F.col(f"system.{c}") for c in shown], F.lit(True).alias("repeated")
    )
    parts = new.unionByName(again).unionByName(kept)
    grouped = parts.groupBy(*_KEY, "window").agg(
        F.sort_array(F.collect_list(F.struct("rank", "seq", "turn", "role", "text", "repeated"))).alias("turns"),
        F.sum("tokens").alias("tokens"),
    )
    pieces = F.transform(
        "turns",
        lambda t: F.struct(F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body")),
    )
    laid = grouped.withColumn("pieces", pieces)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("found"))

    def lay(state: Column, piece: Column) -> Column:
        start = state["at"] + F.char_length(piece["head"])
        size = F.char_length(piece["body"])
        span = F.struct(start.alias("start"), size.alias("length"))
        return F.struct((start + size + len(END)).alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    spots = F.aggregate("pieces", empty, lay, lambda s: s["found"])
    spans = F.zip_with(
        "turns",
        spots,
        lambda t, s: F.struct(
            t["turn"].alias("turn"), t["role"].alias("role"), s["start"].alias("start"), s["length"].alias("length"),
            t["repeated"].alias("repeated"), (t["role"].isin(*targets) & ~t["repeated"]).alias("loss"),
        ),
    )
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    kind = turns.schema[columns[0]].dataType
    named = F.when(F.col("__known"), F.col("__conv").cast(kind)).alias("conv_id")
    return laid.select(named, "window", "tokens", formatted.alias("formatted"), spans.alias("spans"))


def read_turns(windows: DataFrame) -> DataFrame:
    """``conv_id, window, turns``: the turns found in the formatted text, unescaped, with what the mask says of them.

    Roles and texts come from the formatted text alone; ``loss_text`` is what the loss mask covers, cut
    out by its span.
    """
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda p: p != "")
    bodies = F.transform(pieces, lambda p: F.substring(p, F.lit(len(START) + 1), F.char_length(p)))

    def read(body: Column, span: Column) -> Column:
        head = F.char_length(F.substring_index(body, "\n", 1))
        covered = F.when(span["loss"], F.substring(F.col("formatted"), span["start"] + 1, span["length"]))
        return F.struct(
            _role_in(F.substring_index(body, "\n", 1)).alias("role"),
            unescaped(F.substring(body, head + 2, F.char_length(body))).alias("text"),
            span["repeated"].alias("repeated"),
            unescaped(covered).alias("loss_text"),
        )

    return windows.select("conv_id", "window", F.zip_with(bodies, "spans", read).alias("turns"), F.char_length("formatted").alias("chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation: number of turns and digests of its text and of its text under the loss, from the formatted windows.

    A digest is over one string, so a conversation's text meets in one row here (not in
    :func:`format_windows`); rows are first reduced to one string per window.
    """
    new = F.filter("turns", lambda t: ~t["repeated"])
    under = F.filter("turns", lambda t: t["loss_text"].isNotNull())
    rows = read_turns(windows).select(
        "conv_id", "window", "chars", F.size(new).alias("n"),
        F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(F.transform(under, lambda t: t["loss_text"]), "").alias("learned"),
    )
    whole = rows.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "said", "learned"))).alias("parts"),
    )
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    learned = F.array_join(F.transform("parts", lambda p: p["learned"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.char_length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars",
    )
