"""Masked pseudo-likelihood of documents under a bidirectional window network."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import HASHES_KEPT, id_text, in_batches, rows_of, words_of, written

#: Counts of the most frequent words in buckets that each task holds, to spare most of the join; changes no result.
COUNTS_HELD = 1 << 18
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 1 << 18
#: Tokens of a shard: what one network sees between two averages.
SHARD_TOKENS = 1 << 19


@dataclass(frozen=True)
class Shape:
    """Sizes of the network.  Tokens: the ``own`` most frequent words, all others in hashed buckets up to ``classes * members``."""

    window: int = 2
    width: int = 16
    classes: int = 32
    members: int = 32
    own: int = 768

    @property
    def tokens(self) -> int:
        return self.classes * self.members

    def blank(self) -> dict[str, np.ndarray]:
        """Parameters before training, the same each time."""
        rng = np.random.default_rng(7)
        draw = lambda *n: (rng.standard_normal(n) * 0.1).astype(np.float32)
        return {
            "inputs": draw(2 * self.window, self.tokens + 1, self.width),
            "bias": np.zeros(self.width, np.float32),
            "class_out": draw(self.width, self.classes),
            "class_bias": np.zeros(self.classes, np.float32),
            "member_out": draw(self.classes, self.width, self.members),
            "member_bias": np.zeros((self.classes, self.members), np.float32),
        }


class Lexicon:
    """Words (A-Z lower-cased) as token numbers, and log p(word | bucket) of words that share one; remembers the words a worker has met.

    ``held``, ``held_logs``: hashes in order and log counts of the words whose counts are here; ``logs``: log count of each token.
    """

    def __init__(self, own: list[int], shape: Shape, logs: np.ndarray, held: np.ndarray, held_logs: np.ndarray) -> None:
        self.base, self.buckets = len(own), shape.tokens - len(own)
        self.own, self.number = np.sort(np.array(own, np.int64)), np.argsort(np.array(own, np.int64))
        self.logs, self.held, self.held_logs = logs, held, held_logs
        self._afresh()

    def _afresh(self) -> None:
        self.known: dict[bytes, int] = {}
        self.token, self.inside, self.hash = np.zeros(1024, np.uint16), np.zeros(1024), np.zeros(1024, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        at = len(self.known)
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        end = at + len(new)
        if end > len(self.token):
            self.token, self.inside, self.hash = (np.concatenate([x, np.zeros(end, x.dtype)]) for x in (self.token, self.inside, self.hash))
        self.known.update(zip(new, range(at, end), strict=True))
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64)
        tokens, hashes = (self.base + hashes % np.uint64(self.buckets)).astype(np.uint16), hashes.view(np.int64)
        spot = np.minimum(np.searchsorted(self.held, hashes), len(self.held) - 1)
        inside = np.where(self.held[spot] == hashes, self.held_logs[spot] - self.logs[tokens], np.nan)
        if self.base:
            spot = np.minimum(np.searchsorted(self.own, hashes), self.base - 1)
            mine = self.own[spot] == hashes
            tokens[mine], inside[mine] = self.number[spot[mine]], 0
        self.token[at:end], self.hash[at:end], self.inside[at:end] = tokens, hashes, inside

    def __call__(self, text: str | None) -> tuple[np.ndarray, float, np.ndarray]:
        """Tokens; the sum of log p(word | bucket) but for the counts not held; the hashes of the words those belong to."""
        if len(self.known) > HASHES_KEPT:
            self._afresh()
        words = words_of(text, lower=True)
        found = list(map(self.known.get, words))
        if None in found:
            self._learn([w for w, k in zip(words, found, strict=True) if k is None])
            found = list(map(self.known.get, words))
        at = np.array(found, np.int64)
        tokens, inside = self.token[at], self.inside[at]
        away = np.isnan(inside)
        if away.any():
            inside = np.where(away, -self.logs[tokens], inside)
        return tokens, float(inside.sum()), self.hash[at[away]]


def contexts(docs: list[np.ndarray], shape: Shape) -> np.ndarray:
    """For every token of some documents the tokens around it: (2 * window, tokens).  Beyond a document's ends stands the pad."""
    w, pad = shape.window, np.full(shape.window, shape.tokens, np.int32)
    line = np.concatenate([x for d in docs for x in (pad, d)] + [pad])
    at = np.concatenate([np.zeros(0, np.int64)] + [np.arange(len(d)) + s for d, s in zip(docs, np.cumsum([w] + [len(d) + w for d in docs[:-1]]), strict=True)])
    return np.stack([line[at + k] for k in (*range(-w, 0), *range(1, w + 1))])


def _hidden(p: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    h = p["inputs"][0].take(around[0], 0)
    for k in range(1, len(around)):
        h += p["inputs"][k].take(around[k], 0)
    h += p["bias"]
    return np.tanh(h, out=h)


def _softmax(z: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def _by_number(tokens: np.ndarray) -> np.ndarray:
    return np.argsort(tokens.astype(np.uint16), kind="stable")


def _stretches(kind: np.ndarray, classes: int) -> Iterator[tuple[int, int, int]]:
    """(class, start, end) of each class that is there; ``kind`` ascends."""
    ends = np.searchsorted(kind, np.arange(classes + 1))
    return ((c, s, e) for c, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if s < e)


def log_likelihoods(p: dict[str, np.ndarray], around: np.ndarray, tokens: np.ndarray, shape: Shape) -> np.ndarray:
    """log p(token | tokens on both sides) of each place."""
    order = _by_number(tokens)
    kind, member = np.divmod(tokens[order].astype(np.int64), shape.members)
    h, at = np.ascontiguousarray(_hidden(p, around[:, order]).T), np.arange(len(tokens))

    def log_share(z: np.ndarray, row: np.ndarray) -> np.ndarray:
        z -= z.max(0)
        own = z[row, at[: len(row)]]
        return own - np.log(np.exp(z, out=z).sum(0))

    found = log_share(p["class_out"].T @ h + p["class_bias"][:, None], kind)
    for c, s, e in _stretches(kind, shape.classes):
        found[s:e] += log_share(p["member_out"][c].T @ h[:, s:e] + p["member_bias"][c][:, None], member[s:e])
    out = np.empty_like(found)
    out[order] = found
    return out


def train_step(p: dict[str, np.ndarray], around: np.ndarray, tokens: np.ndarray, shape: Shape, rate: float) -> None:
    """One step of gradient descent on a batch, in place."""
    n, order = len(tokens), _by_number(tokens)
    around = around[:, order]
    kind, member = np.divmod(tokens[order].astype(np.int64), shape.members)
    at, rate = np.arange(n), p["bias"].dtype.type(rate / n)
    h = np.ascontiguousarray(_hidden(p, around).T)
    d = _softmax(p["class_out"].T @ h + p["class_bias"][:, None])
    d[kind, at] -= 1
    dh = p["class_out"] @ d
    p["class_out"] -= rate * (h @ d.T)
    p["class_bias"] -= rate * d.sum(1)
    for c, s, e in _stretches(kind, shape.classes):
        x = h[:, s:e]
        d = _softmax(p["member_out"][c].T @ x + p["member_bias"][c][:, None])
        d[member[s:e], at[: e - s]] -= 1
        dh[:, s:e] += p["member_out"][c] @ d
        p["member_out"][c] -= rate * (x @ d.T)
        p["member_bias"][c] -= rate * d.sum(1)
    dh *= 1 - h * h
    p["bias"] -= rate * dh.sum(1)
    dh = np.ascontiguousarray(dh.T)
    for k in range(len(around)):
        order = _by_number(around[k])
        ids = around[k][order]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        p["inputs"][k][ids[starts]] -= rate * np.add.reduceat(dh.take(order, 0), starts, axis=0)


def _chunks(found: Iterator[tuple], least: int) -> Iterator[list[tuple]]:
    """Documents gathered until they have ``least`` tokens."""
    part, n = [], 0
    for doc, ids in found:
        part.append((doc, ids))
        n += len(ids)
        if n >= least:
            yield part
            part, n = [], 0
    if part:
        yield part


def counts(rows: DataFrame) -> DataFrame:
    """The count of every word of all texts: hash (64 bits; two of 10 million words share one with a chance of 1 in 100,000), n.  A table in
    the shared folder that grows with the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen)).view(np.int64)
            out = pa.RecordBatch.from_pydict({"hash": hashes, "n": np.fromiter(seen.values(), np.int64, len(seen))})
            seen.clear()
            return out

        for (text,) in rows_of(batches, "text"):
            seen.update(words_of(text, lower=True))
            if len(seen) > COUNTED:
                yield handed()
        yield handed()

    return written(rows.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "lm-words")


def vocabulary(words: DataFrame, shape: Shape) -> list[int]:
    """Hashes of the most frequent words; ``own`` of them reach the driver."""
    return [r.hash for r in words.orderBy(F.desc("n"), "hash").limit(shape.own).collect()]


def _in_buckets(words: DataFrame, own: list[int], shape: Shape) -> tuple[DataFrame, np.ndarray]:
    """Counts of the words that share a bucket (hash, n), and the log of each token's total count (0 for a word with a token of its own)."""
    rare = words.where(~F.col("hash").isin(own)) if own else words
    buckets = shape.tokens - len(own)
    logs = np.zeros(shape.tokens)
    spot = F.pmod(F.pmod("hash", F.lit(buckets)) + F.when(F.col("hash") < 0, F.lit((1 << 64) % buckets)).otherwise(F.lit(0)), F.lit(buckets))
    for r in rare.groupBy(spot.alias("spot")).agg(F.sum("n").alias("n")).collect():
        logs[len(own) + r.spot] = np.log(r.n)
    return rare, logs


def encoded(rows: DataFrame, own: list[int], rare: DataFrame, logs: np.ndarray, shape: Shape, total: int, rounds: int) -> DataFrame:
    """Every text as tokens, written once for training and scoring: doc_id, place (unique), key, shard, ids (16 bits each), inside, away,
    turn.

    A row's shard is drawn by a hash of id and text from as many as hold ``SHARD_TOKENS`` tokens each, and turn is the round that
    trains on it, so both depend on the rows and not on how they are split among files or tasks.
    """
    top = rare.orderBy(F.desc("n"), "hash").limit(COUNTS_HELD).toArrow().sort_by("hash")
    held, held_logs = (top["hash"].to_numpy(), np.log(top["n"].to_numpy())) if len(top) else (np.zeros(1, np.int64), np.zeros(1))
    kinds = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("ids", pa.binary()), ("inside", pa.float64()), ("away", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        lexicon = Lexicon(own, shape, logs, held, held_logs)
        for doc, key, text in rows_of(batches, "id", "key", "text"):
            ids, inside, away = lexicon(text)
            yield doc, key, ids.tobytes(), inside, away

    shards = max(1, -(-total // SHARD_TOKENS))
    out = rows.withColumn("key", F.xxhash64("id", "text")).mapInArrow(lambda b: in_batches(read(b), kinds), "doc_id long, key long, ids binary, inside double, away array<long>")
    shard = F.pmod("key", F.lit(shards))
    return written(out.withColumns({"place": F.monotonically_increasing_id(), "shard": shard, "turn": (shard % min(rounds, shards)).cast("int")}), "lm-tokens", "turn")


def _summed(parts: DataFrame, groups: int) -> DataFrame:
    """Weighted sums of parameters, added up in ``groups`` tasks."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table["value"][0].as_py()) // 8)
        for v in table["value"]:
            total += np.frombuffer(v.as_py())
        return pa.table({"weight": [sum(table["weight"].to_pylist())], "value": [total.tobytes()]})

    return parts.groupBy(F.pmod("part", F.lit(groups))).applyInArrow(add, "weight double, value binary")


def train(texts: DataFrame, shape: Shape, total: int, *, rounds: int = 4, batch: int = 2048, rate: float = 1.5) -> dict[str, np.ndarray]:
    """Parameters trained on every token of every text (``texts``: what ``encoded`` has written).

    Each round takes the shards of its turn; every shard starts from the same parameters and descends over its own texts, in the order
    of their keys; the results are averaged with the number of tokens as weight.  With fewer shards than rounds, shards take several
    turns.  Steps and shards follow from the rows alone, so the parameters are the same (but for the last bits of sums) however the
    table is split.  Tasks add up their own shards, and at most ``64`` sums reach the driver.
    """
    p, shards = shape.blank(), max(1, -(-total // SHARD_TOKENS))
    turns, spark = min(rounds, shards), texts.sparkSession
    tasks = max(1, min(-(-shards // turns), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for number in range(rounds):

        def descend(batches: Iterator[pa.RecordBatch], p: dict[str, np.ndarray] = p, done: int = number * SHARD_TOKENS // batch) -> Iterator[pa.RecordBatch]:
            total, weight = np.zeros(sum(x.size for x in p.values())), 0
            for _, own in groupby(((shard, np.frombuffer(ids, np.uint16)) for shard, ids in rows_of(batches, "shard", "ids")), itemgetter(0)):
                q, seen, steps = {k: v.copy() for k, v in p.items()}, 0, done
                for part in _chunks(own, 1 << 16):
                    docs = [ids for _, ids in part if len(ids)]
                    if not docs:
                        continue
                    around, ids = contexts(docs, shape), np.concatenate(docs)
                    for k in range(0, len(ids), batch):
                        train_step(q, around[:, k : k + batch], ids[k : k + batch], shape, rate / (1 + steps / 400) ** 0.5)
                        steps += 1
                    seen += len(ids)
                total += np.concatenate([x.ravel() for x in q.values()]).astype(np.float64) * seen
                weight += seen
            if weight:
                yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "weight": [float(weight)], "value": [total.tobytes()]})

        own = texts.where(F.col("turn") == number % turns).select("shard", "key", "ids")
        own = own.repartitionById(tasks, (F.floor(F.col("shard") / turns) % tasks).cast("int")).sortWithinPartitions("shard", "key")
        sums = _summed(own.mapInArrow(descend, "part long, weight double, value binary"), min(64, -(-tasks // 8))).collect()
        weight = sum(r["weight"] for r in sums)
        if not weight:  # no tokens at all, or all of them have other turns
            continue
        flat, at = sum(np.frombuffer(r["value"]) for r in sums) / weight, 0
        p = dict(p)
        for k, v in p.items():
            p[k], at = flat[at : at + v.size].reshape(v.shape).astype(np.float32), at + v.size
    return p


def score(docs: DataFrame, *, shape: Shape | None = None, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over all words of log p(word | tokens on both sides)), score (its mean) for every document.

    The network is trained on all texts of ``docs`` first.  It gives p(token | both sides); a word that shares its bucket with others
    has p(word | bucket) besides, its part of the bucket's count over all texts, so the probabilities of all words of the corpus sum to
    1.  Those counts are a table as large as the corpus's vocabulary, met in a join on the word's 64-bit hash.

    Null, empty and all-space texts have no tokens: log_likelihood 0, score null.  Repeated and null ids are scored row by row; equal
    texts get equal scores.  Scores do not depend on how the table is split.  An empty table gives no rows.  Columns other than the two
    named are not read.
    """
    shape = shape or Shape()
    rows = id_text(docs, id_col, text_col)
    words = counts(rows)
    own = vocabulary(words, shape)
    rare, logs = _in_buckets(words, own, shape)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    texts = encoded(rows, own, rare, logs, shape, total, rounds)
    p = train(texts, shape, total, rounds=rounds)
    kinds = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in _chunks((((doc, place, inside), np.frombuffer(ids, np.uint16)) for doc, place, inside, ids in rows_of(batches, "doc_id", "place", "inside", "ids")), 1 << 15):
            full = [ids for _, ids in part if len(ids)]
            each = np.zeros(0)
            if full:
                around, ids = contexts(full, shape), np.concatenate(full)
                each = np.concatenate([log_likelihoods(p, around[:, k : k + 4096], ids[k : k + 4096], shape) for k in range(0, len(ids), 4096)]).astype(np.float64)
            at = 0
            for (doc, place, inside), ids in part:
                yield doc, place, len(ids), float(each[at : at + len(ids)].sum()) + inside
                at += len(ids)

    judged = texts.select("doc_id", "place", "inside", "ids").mapInArrow(lambda b: in_batches(judge(b), kinds), "doc_id long, place long, n_tokens long, known double")
    # In fixed order: a sum of doubles must not depend on how rows arrive.
    met = texts.select("place", F.explode("away").alias("hash")).groupBy("place", "hash").agg(F.count("*").alias("times")).join(rare, "hash")
    rest = met.groupBy(F.col("place").alias("at")).agg(F.aggregate(F.array_sort(F.collect_list(F.col("times") * F.log("n"))), F.lit(0.0), lambda a, x: a + x).alias("rest"))
    known = F.col("known") + F.coalesce("rest", F.lit(0.0))
    out = judged.join(rest, F.col("place") == F.col("at"), "left").select("doc_id", "n_tokens", known.alias("log_likelihood"))
    return out.withColumn("score", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
