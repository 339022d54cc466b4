"""Language identification by error-correcting output codes.

Every language gets a codeword of +1 / -1 bits.  For each bit a linear classifier over hashed byte
n-grams learns to tell the languages with +1 from those with -1.  A text is given the language whose
codeword has the smallest loss against the bits' margins, each bit weighted by how well it was
learned; a small lead over the runner-up marks the text as ambiguous.

Only the fit is bounded: about ``sample_rows`` labelled rows, chosen by hash and spread evenly
over the languages (at least 20 each), are turned into count vectors by Spark and the small
classifiers are fitted on these.  Prediction reads every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagstats.llm.memo import handed_back

BUCKETS = 4096
UNKNOWN = "und"
LEAST_PER_LANGUAGE = 20
SLICE_BYTES = 2_000_000
SNIPPET = 300  # bytes of the second training row of each sampled text
_SPACE = 32

_FOLD = np.full(256, _SPACE, np.int64)
_FOLD[128:] = np.arange(128, 256)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _grams(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the 2- and 3-grams that start at each byte, and which of them count (at most one gap each)."""
    folded = _FOLD[raw]
    gap = folded == _SPACE
    two = folded[:-1] * 256 + folded[1:]
    yield (two * 40503 >> 4) % BUCKETS, ~(gap[:-1] & gap[1:])
    three = two[:-1] * 256 + folded[2:]
    clear = ~((gap[:-2] & gap[1:-1]) | (gap[1:-1] & gap[2:]) | (gap[:-2] & gap[2:]))
    yield (three * 2654435761 >> 11) % BUCKETS, clear


def shares(texts: pa.Array) -> Iterator[np.ndarray]:
    """Matrices of n-gram shares (texts x buckets) of consecutive texts; texts hold no null."""
    lowered = pc.utf8_lower(texts)
    if pa.types.is_large_string(lowered.type):
        lowered = lowered.cast(pa.string())
    count = len(lowered)
    offsets = np.frombuffer(lowered.buffers()[1], np.int32, count + 1, lowered.offset * 4).astype(np.int64)
    data = lowered.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    begin = 0
    while begin < count:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, "right")) - 1)
        end = min(end, begin + 1024)
        counts = np.zeros((end - begin, BUCKETS), np.float32)
        part = raw[offsets[begin] : offsets[end]]
        places = offsets[begin : end + 1] - offsets[begin]
        if len(part) > 3:
            for width, (bucket, clear) in zip((2, 3), _grams(part), strict=True):
                for k in range(end - begin):
                    a, b = places[k], places[k + 1] - width + 1
                    if b > a:
                        counts[k] += np.bincount(bucket[a:b][clear[a:b]], minlength=BUCKETS)
        yield counts / np.maximum(counts.sum(1, keepdims=True), 1)
        begin = end


def codewords(count: int, seed: int = 7) -> np.ndarray:
    """Languages x bits of +1 / -1: every split for up to 4 languages, else the best of 50 random codes."""
    if count < 2:
        return np.ones((count, 0))
    if count <= 4:
        splits = np.arange(1, 2 ** (count - 1))
        return np.where((splits[None, :] >> np.arange(count)[:, None]) & 1, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    bits = max(15, math.ceil(10 * math.log2(count)))
    best, distance = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (count, bits))
        code[0] = np.where(np.abs(code.sum(0)) == count, -code[0], code[0])  # no bit is the same for all
        apart = ((bits - code @ code.T) / 2 + bits * np.eye(count)).min()
        if apart > distance:
            best, distance = code, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of belief, and the lead over the runner-up."""
        margins = features @ self.weights + self.bias
        # Two codewords differ in about half the bits: in these units a lead is one bit's worth of log odds.
        loss = np.stack([np.logaddexp(0, -margins * word) @ self.trust for word in self.code], 1)
        loss = loss / max(1.0, self.code.shape[1] / 2)
        ordered = np.sort(loss, 1)
        belief = np.exp(-(loss - ordered[:, :1]))
        best = loss.argmin(1)
        lead = ordered[:, 1] - ordered[:, 0] if len(self.code) > 1 else np.full(len(loss), np.inf)
        return best, (belief / belief.sum(1, keepdims=True))[np.arange(len(loss)), best], lead


def fit_bits(features: np.ndarray, bits: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic classifiers (buckets x bits) by accelerated gradient descent, and their biases; scales ``features`` in place."""
    count = len(features)
    scale = (1 / np.sqrt(features.mean(0) + 1e-6)).astype(np.float32)
    features *= scale
    scaled = features
    probe = np.ones(scaled.shape[1], np.float32)
    for _ in range(12):
        probe = scaled.T @ (scaled @ probe)
        probe /= np.linalg.norm(probe)
    steep = 0.25 * (float(np.linalg.norm(scaled @ probe)) ** 2 * 1.1 / count + 1) + ridge
    weights, bias = np.zeros((scaled.shape[1], bits.shape[1]), np.float32), np.zeros(bits.shape[1], np.float32)
    ahead_w, ahead_b = weights, bias
    for k in range(rounds):
        pull = -bits / (1 + np.exp(bits * (scaled @ ahead_w + ahead_b))) / count
        new_w = ahead_w - (scaled.T @ pull + ridge * ahead_w) / steep
        new_b = ahead_b - pull.sum(0) / steep
        speed = k / (k + 3)
        ahead_w, ahead_b = new_w + speed * (new_w - weights), new_b + speed * (new_b - bias)
        weights, bias = new_w.astype(np.float32), new_b.astype(np.float32)
    features /= scale
    return weights * scale[:, None], bias


def fit_language_model(
    labelled: DataFrame, text_col: str = "text", label_col: str = "lang", sample_rows: int = 1500, key_col: str = "doc_id"
) -> LanguageModel:
    """Model from a sample of about ``sample_rows`` rows, evenly over the labels; rows without label or letter teach nothing."""
    rows = labelled.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.filter("label is not null")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    languages = sorted(r.label for r in sizes.select("label").collect())
    if not languages:
        return LanguageModel([], codewords(0), np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(0))
    each = max(LEAST_PER_LANGUAGE, sample_rows // len(languages))
    mark = F.xxhash64("key", "text")
    chance = (mark / F.lit(2.0**64) + 0.5).alias("chance")
    drawn = rows.select("text", "label", mark.alias("mark"), chance).join(F.broadcast(sizes), "label")
    drawn = drawn.filter(F.col("text").rlike(r"\p{L}")).filter(F.col("chance") < F.lit(2.0 * each) / F.col("n"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("mark", "text"))
    drawn = drawn.select("text", "label", place.alias("place")).filter(F.col("place") <= each)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, labels = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = len(text) * 7 // 13  # the whole text, and a short passage of it so that short texts are learned too
                for piece in (text, text[start : start + SNIPPET]):
                    pieces.append(piece)
                    labels.append(label)
            data = [v.astype(np.float16).tobytes() for block in shares(pa.array(pieces, pa.string())) for v in block]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(data, pa.binary())], names=["label", "share"])

    found = drawn.select("text", "label").mapInArrow(lambda batches: handed_back(vectors(batches)), "label string, share binary").toArrow()
    order = np.argsort(np.array(found.column("label").to_pylist(), object), kind="stable")
    labels = np.array(found.column("label").to_pylist(), object)[order]
    features = np.zeros((len(order), BUCKETS), np.float32)  # the one matrix held on the driver
    for row, at in enumerate(order):
        features[row] = np.frombuffer(found.column("share")[int(at)].as_buffer(), np.float16)
    del found
    pa.default_memory_pool().release_unused()
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if code.shape[1] == 0:
        return LanguageModel(languages, code, np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(0))
    bits = code[np.searchsorted(languages, labels)].astype(np.float32)
    weights, bias = fit_bits(features, bits)
    right = ((features @ weights + bias) * bits > 0).mean(0)
    trust = np.maximum(2 * right - 1, 0.01)
    return LanguageModel(languages, code, weights, bias, trust / trust.sum() * len(trust))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lead: float = 0.2) -> DataFrame:
    """Add ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_ambiguous`` to every row, from its whole text alone.

    A null text, an empty one and one without a letter is ``und`` with score 0, as is everything if
    no language was learned.  Equal texts get equal results.  All columns are kept; columns of the
    three new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from handed_back(judged(texts))

    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = shared.value
        for given in texts:
            given = pc.fill_null(given, "")
            readable = pc.match_substring_regex(given, r"\p{L}").to_numpy(zero_copy_only=False)
            best = np.zeros(len(given), np.int64)
            score, ahead = np.zeros(len(given)), np.zeros(len(given))
            if found.languages:
                at = 0
                for block in shares(given):
                    run = slice(at, at + len(block))
                    best[run], score[run], ahead[run] = found.decode(block)
                    at += len(block)
            else:
                readable[:] = False
            names = np.array([*found.languages, UNKNOWN], object)[np.where(readable, best, len(found.languages))]
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.where(readable, score, 0.0)), pa.array(readable & (ahead < lead))],
                names=["lang_pred", "lang_score", "lang_ambiguous"],
            )

    predict.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(predict, "lang_pred string, lang_score double, lang_ambiguous boolean")
    new = ["lang_pred", "lang_score", "lang_ambiguous"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    return docs.select(*kept, udf(F.col(text_col)).alias("__found")).select(*kept, "__found.*")


def held_out(key: Column) -> Column:
    """The fifth of the rows that no model learns from: CRC-32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
