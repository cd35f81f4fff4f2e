"""Quality rules: fixed rules, then a log-likelihood ratio of hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import grams, id_text, in_batches, rows_of, word_hashes, words_of, written

SYMBOLS = b"#*$%&|<>"
_SCORED = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LATER = (np.arange(256) & 0xC0) == 0x80  # bytes that do not start a code point


@dataclass(frozen=True)
class QualityModel:
    """Log ratio of trusted-target to raw-corpus probability for each bucket of hashed byte n-grams, and the threshold on its mean."""

    ratio: np.ndarray
    width: int
    threshold: float


def _buckets(raw: bytes, width: int, size: int) -> np.ndarray:
    """Buckets of all runs of ``width`` bytes; a shorter text is one run, an empty one has none."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    width = min(width, len(b))
    if not width:
        return np.empty(0, np.uint32)
    n = len(b) - width + 1
    h = np.zeros(n, np.uint32)
    for k in range(width):
        h = (h ^ b[k : k + n]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(16))) & np.uint32(size - 1)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _mean(ratio: np.ndarray, width: int, raw: bytes) -> float:
    at = _buckets(raw, width, len(ratio))
    return float(ratio[at].mean()) if len(at) else 0.0


def fit(docs: DataFrame, labels: DataFrame, *, buckets: int = 1 << 15, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit the two multinomials and the threshold, on every document and every label.

    Raw corpus: n-gram counts of every document.  Trusted target: all documents labelled good and not toxic; the threshold separates
    their scores from those of all documents labelled bad.  Ids labelled both ways are left out; of several documents with one id each
    counts.  What reaches the driver is one row for each bucket, and one for each of ``nth``'s stretches.

    No labels, or none of one kind: the ratio is 0 or the threshold -infinity, and every document is kept.
    """
    per_id = labels.select(F.col(id_col).cast("long").alias("id"), "quality", "toxic").where("id is not null and quality is not null")
    per_id = per_id.groupBy("id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).where("low = high")
    ids = written(per_id.where("low = 0 or low = 1 and toxic = 0").select("id", (F.col("low") == 1).alias("good")), "labelled")
    rows = id_text(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for (text,) in rows_of(batches, "text"):
            found += np.bincount(_buckets(_raw(text), width, buckets), minlength=buckets)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int32), "n": found[some]})

    def counts(texts: DataFrame) -> np.ndarray:
        found = np.zeros(buckets)
        for r in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            found[r.bucket] = r.n
        return found

    # Good ids as bits, 64 ids a row: mostly small enough for Spark to broadcast, so texts stay where they are.
    bit = F.expr("cast(pmod(id, 64) as int)")
    bits = written(ids.where("good").groupBy(F.shiftright("id", 6).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")), "good-bits")
    among = rows.where("id is not null").join(bits, F.shiftright("id", 6) == F.col("slot")).where(F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1)
    raw, target = counts(rows), counts(among)
    if not target.any():
        return QualityModel(np.zeros(buckets), width, -np.inf)
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * buckets)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * buckets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, text in rows_of(batches, "id", "text"):
            yield doc, _mean(ratio, width, _raw(text))

    # Scored before the join, so that it moves two numbers a row and no texts.
    kinds = pa.schema([("id", pa.int64()), ("score", pa.float64())])
    scored = rows.where("id is not null").mapInArrow(lambda b: in_batches(score(b), kinds), "id long, score double")
    return QualityModel(ratio, width, threshold(written(scored.join(ids, "id").select("good", "score"), "label-scores")))


def nth(values: DataFrame, column: str, place: int, stretches: int = 4096) -> float:
    """The number at a place (from 0) of a column in order, exactly.  Rows are counted by stretches between the lowest and the highest
    number, then within the stretch of that place, until it holds one number; a row for each stretch reaches the driver."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low < high:
        spot = F.floor((F.col(column) - low) / (high - low) * (stretches - 1)).alias("spot")
        for r in values.where(F.col(column).between(low, high)).groupBy(spot).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("spot").collect():
            if place < r.n:
                low, high = r.low, r.high
                break
            place -= r.n
    return low


def threshold(scores: DataFrame) -> float:
    """Between the two kinds of score (``good``, ``score``), near the good ones: a quarter of the way from the 5th thousandth of the good
    scores down to the 95th hundredth of those bad scores that lie below it.

    No bad score below that point: a margin under the good ones as wide as from their median to there.  No good scores: -infinity.
    """
    ups = scores.where("good")
    n = ups.count()
    if not n:
        return -np.inf
    edge = nth(ups, "score", n * 5 // 1000)
    under = scores.where(~F.col("good") & (F.col("score") < edge))
    m = under.count()
    return edge - (edge - nth(under, "score", m * 95 // 100)) / 4 if m else edge - (nth(ups, "score", n // 2) - edge)


def features(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one whole text; None is empty."""
    raw = _raw(text)
    b = np.frombuffer(raw, np.uint8)
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    repeated = 0
    if len(words) > 3:
        _, at, times = np.unique(grams(word_hashes(words), 3), return_inverse=True, return_counts=True)
        if len(times) < len(at):
            hot = times[at] > 1
            inside = np.zeros(len(words), bool)
            for k in range(3):
                inside[k : k + len(hot)] |= hot
            repeated = int(inside.sum())
    return len(words), int((~_LATER[b]).sum() - _SPACE[b].sum()), int(_SYMBOL[b].sum()), len(lines) - len(set(lines)), repeated


def _verdict(text: str | None, found: tuple[int, int, int, int, int], model: QualityModel, min_words: int, max_repeat_percent: int) -> tuple[bool, float, bool]:
    """(base_failed, score, kept)"""
    failed = found[0] < min_words or 100 * found[4] > max_repeat_percent * found[0]
    score = _mean(model.ratio, model.width, _raw(text))
    return failed, score, not failed and score >= model.threshold


def judge(docs: DataFrame, model: QualityModel, *, min_words: int = 50, max_repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Features, score and verdict of every document: doc_id, n_words, ..., base_failed, score, kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated 3-word windows.  kept: not
    base_failed and score >= the model's threshold.  Null and empty texts have zeros and fail.  Repeated ids are judged row by row;
    columns other than the two named are not read.  One pass, no shuffle.
    """

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, text in rows_of(batches, "id", "text"):
            f = features(text)
            yield doc, *f, *_verdict(text, f, model, min_words, max_repeat_percent)

    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return id_text(docs, id_col, text_col).mapInArrow(lambda b: in_batches(verdict(b), _SCORED), kinds)


def keep(docs: DataFrame, labels: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, judged by a model fitted on ``docs`` and ``labels``."""
    model = fit(docs, labels, text_col=text_col, **options)

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [_verdict(text, features(text), model, min_words, max_repeat_percent)[2] for (text,) in rows_of(iter([b]), text_col)]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(verdict, docs.schema)
