"""Quality classifier: learned vectors of hashed words and character n-grams, averaged over a text, and a softmax on the average."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import HASHES_KEPT, id_text, in_batches, rows_of, words_of, written

#: What every text has besides its words, and an empty one alone: its part in the average is the classes' prior.
END = b"</s>"
#: Stands besides for every word that is the one before it once more: runs of any word look alike.
AGAIN = b"</again>"
SHORTEST, LONGEST = 3, 5
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def word_features(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, bucket) of each feature: the word itself, and the runs of 3 to 5 characters of ``<word>``."""
    text = b" ".join(b"<" + w + b">" for w in words)
    c = np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = c == 32
    of = np.cumsum(space)
    ends = np.append(np.flatnonzero(space), len(c))[of]  # where the own word ends
    whole = np.array([xxhash.xxh32_intdigest(w) for w in words], np.uint32)
    at, found = [np.arange(len(words))], [whole]
    for n in range(SHORTEST, LONGEST + 1):
        start = np.flatnonzero(np.arange(len(c)) + n <= ends)
        start = start[~space[start]]
        h = np.full(len(start), 0x9E3779B9 * n & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ c[start + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
        at.append(of[start])
        found.append(h * np.uint32(0x85EBCA6B))
    h = np.concatenate(found)
    return np.concatenate(at), ((h ^ (h >> np.uint32(16))) & np.uint32(buckets - 1)).astype(np.int64)


def counted_words(text: str | None) -> dict[bytes, int]:
    """How often each word and mark stands for the whole text."""
    words = words_of(text)
    times: dict[bytes, int] = {END: 1}
    for w in words:
        times[w] = times.get(w, 0) + 1
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return times | {AGAIN: runs} if runs else times


@dataclass(frozen=True)
class SubwordModel:
    """A vector for each bucket, and for each of the two classes the weights of the softmax."""

    vectors: np.ndarray
    out: np.ndarray

    @classmethod
    def start(cls, buckets: int, width: int) -> SubwordModel:
        return cls(np.random.default_rng(0).uniform(-1 / width, 1 / width, (buckets, width)), np.zeros((2, width)))


def probability(logit: np.ndarray | float) -> np.ndarray | float:
    """Softmax of two classes whose logits differ by ``logit``."""
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(model: SubwordModel, texts: list[tuple[list[bytes], list[int]]], labels: np.ndarray, *, passes: int, rate: float, batch: int = 32, seed: int = 0) -> SubwordModel:
    """Stochastic gradient descent over texts given as distinct words with counts; the rate falls to 0 along a straight line."""
    vectors, out = model.vectors.copy(), model.out.copy()
    known: dict[bytes, int] = {}
    places = [np.array([known.setdefault(w, len(known)) for w in words], np.int64) for words, _ in texts]
    counts = [np.array(c, np.float64) for _, c in texts]
    of, bucket = word_features(list(known), len(vectors))
    order = np.argsort(of, kind="stable")
    bucket, sizes = bucket[order], np.bincount(of, minlength=len(known))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    totals = [float((c * sizes[p]).sum()) for p, c in zip(places, counts, strict=True)]
    rng, step, steps = np.random.default_rng(seed), 0, passes * -(-len(texts) // batch)
    for _ in range(passes):
        turn = rng.permutation(len(texts))
        for s in range(0, len(turn), batch):
            own = turn[s : s + batch]
            words, at = np.unique(np.concatenate([places[i] for i in own]), return_inverse=True)
            share = np.zeros((len(own), len(words)))  # the weight of each feature of a word in a text's average
            share[np.repeat(np.arange(len(own)), [len(places[i]) for i in own]), at] = np.concatenate([counts[i] / totals[i] for i in own])
            first = np.concatenate([[0], np.cumsum(sizes[words])[:-1]])
            flat = bucket[np.repeat(starts[words] - first, sizes[words]) + np.arange(sizes[words].sum())]
            mean = share @ np.add.reduceat(vectors[flat], first, axis=0)
            wrong = labels[own] - probability(mean @ (out[1] - out[0]))
            pace = rate * (1 - step / steps)
            back = np.repeat(wrong @ share, sizes[words])  # of each word, the same for all of its features
            push = wrong @ mean * pace
            vectors += np.outer(pace * np.bincount(flat, weights=back, minlength=len(vectors)), out[1] - out[0])
            out += np.stack([-push, push])
            step += 1
    return SubwordModel(vectors, out)


class WordWeights:
    """Of each word met, the sum of what its features add to the logit, and their number; remembered, but not without bound."""

    def __init__(self, model: SubwordModel) -> None:
        self.each = model.vectors @ (model.out[1] - model.out[0])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sums, self.sizes = np.empty(0), np.empty(0)

    def scores(self, texts: list[str | None]) -> list[float]:
        """Softmax of the average over all features of each whole text."""
        if len(self.known) > HASHES_KEPT:
            self._forget()
        known, split = self.known, [[*words_of(t), END] for t in texts]
        new = list({w for words in [*split, [AGAIN]] for w in words if w not in known})
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            of, bucket = word_features(part, len(self.each))
            known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
            self.sums = np.append(self.sums, np.bincount(of, weights=self.each[bucket], minlength=len(part)))
            self.sizes = np.append(self.sizes, np.bincount(of, minlength=len(part)))
        out, again = [], known[AGAIN]
        for words in split:
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            runs = int((at[1:] == at[:-1]).sum())
            out.append(float(probability((self.sums[at].sum() + runs * self.sums[again]) / (self.sizes[at].sum() + runs * self.sizes[again]))))
        return out


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3; a null id is not one."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def _learner(start: SubwordModel, passes: int, rate: float, seed: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        own = train(start, list(zip(group["words"], group["times"], strict=True)), group["label"].to_numpy(), passes=passes, rate=rate, seed=seed + int(key[0]))
        return pd.DataFrame({"shard": [key[0]], "n": [len(group)], "vectors": [own.vectors.astype(np.float32).tobytes()], "out": [own.out.tobytes()]})

    return learn


def fit(docs: DataFrame, labels: DataFrame, *, buckets: int = 1 << 16, width: int = 8, labelled_rows: int = 8000, shards: int = 4, rounds: int = 2, passes: int = 8, rate: float = 2.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> SubwordModel:
    """Train on at most ``labelled_rows`` labelled documents that are not held out: the first by a hash of the id, so neither order nor
    partitions matter, in their own ratio of classes.

    Shards by hash train at once from one start; ``rounds`` times the mean of their models is the next start.  Ids labelled both ways are
    left out; of documents with one id one text stands for it.  No labels: the start, which gives 0.5.
    """
    per_id = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out(F.col("id")))
    per_id = per_id.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").drop("high")
    sample = written(per_id.orderBy(F.xxhash64("id"), "id").limit(labelled_rows), "labelled")
    texts = id_text(docs, id_col, text_col).join(F.broadcast(sample), "id")  # at most ``labelled_rows`` rows of two numbers
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text"), "text"))
    texts = texts.withColumn("_at", first).where("_at = 1").select("id", "text", "label")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, text, label in rows_of(batches, "id", "text", "label"):
            times = counted_words(text)
            yield doc, label, list(times), list(times.values())

    kinds = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])
    rows = texts.mapInArrow(lambda b: in_batches(counted(b), kinds, 64), "id long, label int, words array<binary>, times array<int>")
    rows = written(rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int")), "counted")
    model = SubwordModel.start(buckets, width)
    for k in range(rounds):
        found = rows.groupBy("shard").applyInPandas(_learner(model, passes, rate, shards * k), "shard int, n long, vectors binary, out binary").collect()  # ``shards`` models
        if not found:
            break
        found.sort(key=lambda r: r.shard)
        total = sum(r.n for r in found)
        mean = lambda raws: sum(x.astype(np.float64) * (r.n / total) for r, x in zip(found, raws, strict=True))
        model = SubwordModel(mean([np.frombuffer(r.vectors, np.float32).reshape(buckets, width) for r in found]), mean([np.frombuffer(r.out).reshape(2, width) for r in found]))
    return model


def score(docs: DataFrame, model: SubwordModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text alone.

    Null and empty texts have the score of the end mark, which stands for the prior.  Repeated ids and texts are scored row by row; a null
    id is not held out; columns other than the two named are not read; an empty table gives no rows.  One pass, no shuffle.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        weights = WordWeights(model)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                yield from zip(part.column("id").to_pylist(), weights.scores(part.column("text").to_pylist()), strict=True)

    out = id_text(docs, id_col, text_col).mapInArrow(lambda b: in_batches(scored(b), _SCORED), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
