"""Hard negatives: anchors in clusters share one list of candidates, sorted by an angular upper bound, and walk it until certified."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import is_empty, written
from marketframe.llm.vectors import int_vectors

#: Candidates of a block of a list, anchors that visit it together, and candidates between two checks of the bound.
BLOCK, ASKS, STEP = 8192, 2048, 512
#: Widths into which a list's bounds are counted before it is cut into blocks.
BINS = 1024
#: Added to what an angle allows, so that rounding never ends a walk too early.
SLACK = 1e-7
_LIST = ["size", "cluster"]
_BLOCK = [*_LIST, "block", "part"]
_FOUND = "ask long, score long, rep long, ids array<long>"


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, their norms); rows of zeros stay zeros."""
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` unit centres for unit rows; the same for the same rows in the same order."""
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = x[near == j].sum(0)
        centres = units(centres)[0]
    if x.shape[1]:
        centres[~centres.any(1), 0] = 1.0  # a bound by angles needs a direction
    return centres


def angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1, 1))


def upper_bounds(unit: np.ndarray, norm: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The most that a candidate's product with any member of each cluster can be, for a member of length 1: |v| cos(max(0, angle between
    candidate and centre - angle between the centre and its farthest member))."""
    return norm[:, None] * np.cos(np.maximum(0, angles(unit, centres) - radii - SLACK))


def matrix(vecs: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.int32).reshape(len(vecs), size).astype(np.float64)


def products(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every partial sum stays below 2^53, else in Python's integers."""
    most = np.sqrt((y * y).sum(1).max(initial=0) * (x * x).sum(1).max(initial=0))
    if most < 2.0**52:
        return (y @ x.T).astype(np.int64)
    whole = lambda m: m.astype(np.int64).astype(object)
    return (whole(y) @ whole(x).T).astype(np.int64)


def walk(x: np.ndarray, bound: np.ndarray, first: np.ndarray, kinds: np.ndarray, y: np.ndarray, asks: pd.DataFrame, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask, candidate, score) of the best that each ask can use in one stretch of a list.

    Candidates ``x`` come in falling order of ``bound``; ``first`` is the id that breaks ties, ``kinds`` and ``own`` are labels as
    numbers.  An ask wants ``k`` scores of at least ``least`` and at most ``most`` with its own label (``same``) or other ones.  It goes
    on while the bound times its norm reaches the k-th best score so far; a tie may still have a smaller id, so equality goes on too.
    """
    k, norm, same = asks["k"].to_numpy(), asks["norm"].to_numpy(), asks["same"].to_numpy(bool)
    least, most = asks["least"].to_numpy(np.int64).copy(), asks["most"].to_numpy(np.int64)
    low, wide = np.iinfo(np.int64).min, int(k.max())
    best = np.full((len(asks), wide), low, np.int64)  # ascending
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(x), STEP):
        live = np.flatnonzero(bound[s] * norm * (1 + 1e-9) + 1e-6 >= least)
        if not len(live):
            break
        score = products(y[live], x[s : s + STEP])
        fits = (kinds[None, s : s + STEP] == own[live, None]) == same[live, None]
        fits &= (score >= least[live, None]) & (score <= most[live, None])
        seen = np.where(fits, score, low)
        top = np.partition(seen, seen.shape[1] - wide, axis=1)[:, -wide:] if seen.shape[1] > wide else seen
        best[live] = np.sort(np.concatenate([best[live], top], axis=1), axis=1)[:, -wide:]
        least[live] = np.maximum(least[live], best[live, wide - k[live]])
        a, c = np.nonzero(fits & (score >= least[live, None]))
        hits.append((live[a], c + s, score[a, c]))
    if not hits:
        return (np.empty(0, np.int64),) * 3
    a, c, v = (np.concatenate(h) for h in zip(*hits, strict=True))
    keep = v >= least[a]
    a, c, v = a[keep], c[keep], v[keep]
    order = np.lexsort((first[c], -v, a))
    a, c, v = a[order], c[order], v[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < k[a]
    return a[keep], c[keep], v[keep]


def _visited(key: tuple, stored: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
    if not len(stored) or not len(asks):
        return _found(*[np.empty(0, np.int64)] * 3, [])
    stored = stored.sort_values("bound", ascending=False, kind="stable")
    ids = stored["ids"].to_numpy()
    codes = pd.factorize(pd.concat([stored["label"], asks["label"]], ignore_index=True))[0]
    first = np.array([i[0] for i in ids], np.int64)
    a, c, v = walk(matrix(stored["vec"], key[0]), stored["bound"].to_numpy(), first, codes[: len(stored)], matrix(asks["vec"], key[0]), asks, codes[len(stored) :])
    return _found(asks["ask"].to_numpy()[a], v, stored["rep"].to_numpy()[c], [ids[j] for j in c])


def _found(ask: np.ndarray, score: np.ndarray, rep: np.ndarray, ids: list) -> pd.DataFrame:
    return pd.DataFrame({"ask": ask, "score": score, "rep": rep, "ids": pd.Series(ids, dtype=object)})


class SharedLists:
    """The sorted candidate lists of all anchor clusters, cut into blocks, and the walks along them."""

    def __init__(self, reps: DataFrame, anchors: DataFrame, clusters: int, sample_rows: int) -> None:
        """``reps``: rep, label, size, vec, ids (of the candidates); ``anchors``: rep, size, vec of those that will ask."""
        self.reps, parts = reps, max(1, -(-reps.count() // BLOCK))
        # A sample of each size by hash, the same however the rows are split.
        place = F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("vec"), "vec"))
        sample = anchors.select("size", "vec").distinct().withColumn("_at", place).where(F.col("_at") <= sample_rows).drop("_at")

        def book(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            centres = spherical_kmeans(units(matrix(rows.sort_values("vec")["vec"], key[0]))[0], clusters)
            return pd.DataFrame({"size": [key[0]], "book": [centres.tobytes()], "k": [len(centres)]})

        books = written(sample.groupBy("size").applyInPandas(book, "size int, book binary, k int"), "books")
        dealt = lambda df: df.withColumn("deal", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int")).groupBy("size", "deal")
        copies = lambda b: b.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("size", "deal")

        def assigned(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({"rep": [], "cluster": [], "angle": [], "norm": []})
            unit, norm = units(matrix(rows["vec"], key[0]))
            far = angles(unit, np.frombuffer(own["book"].iloc[0]).reshape(-1, key[0]) if key[0] else np.zeros((1, 0)))
            return pd.DataFrame({"rep": rows["rep"], "cluster": far.argmin(1), "angle": far.min(1), "norm": norm})

        to = dealt(anchors.select("rep", "size", "vec")).cogroup(copies(books)).applyInPandas(assigned, "rep long, cluster int, angle double, norm double")
        self.anchors = written(anchors.join(to, "rep"), "anchors")
        radii = self.anchors.groupBy(*_LIST).agg(F.max("angle").alias("radius"))
        radii = radii.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("cluster", "radius"))).alias("r"))  # clusters of one size: few
        full = books.join(radii, "size").select("size", "book", F.col("r.cluster").alias("clusters"), F.col("r.radius").alias("radii"))

        def bounds(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(rows):  # no anchor has this size
                return pd.DataFrame({"rep": [], "size": [], "cluster": [], "bound": []})
            use, r = np.asarray(own["clusters"].iloc[0]), np.asarray(own["radii"].iloc[0])
            centres = np.frombuffer(own["book"].iloc[0]).reshape(-1, key[0])[use] if key[0] else np.zeros((len(use), 0))
            unit, norm = units(matrix(rows["vec"], key[0]))
            most = upper_bounds(unit, norm, centres, r)
            return pd.DataFrame({"rep": np.repeat(rows["rep"].to_numpy(), len(use)), "size": key[0], "cluster": np.tile(use, len(rows)), "bound": most.ravel()})

        each = written(dealt(reps.select("rep", "size", "vec")).cogroup(copies(full)).applyInPandas(bounds, "rep long, size int, cluster int, bound double"), "bounds")
        # Falling bounds in bins, bins in blocks: at most BINS rows for each list are numbered in one place, whatever it holds.
        ends = each.groupBy(*_LIST).agg(F.max("bound").alias("hi"), F.min("bound").alias("lo"))
        binned = each.join(ends, _LIST).withColumn("bin", F.coalesce(F.try_divide(F.col("hi") - F.col("bound"), F.col("hi") - F.col("lo")) * (BINS - 1), F.lit(0.0)).cast("int"))
        sizes = binned.groupBy(*_LIST, "bin").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy(*_LIST).orderBy("bin")) - F.col("n")
        plan = written(sizes.select(*_LIST, "bin", F.floor(before / BLOCK).alias("block"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "blocks")
        placed = binned.join(plan, [*_LIST, "bin"]).select("rep", "bound", *_LIST, "block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"))
        self.lists = written(placed, "lists")
        top = self.lists.groupBy(*_BLOCK).agg(F.max("bound").alias("top"))
        head = F.row_number().over(Window.partitionBy(*_LIST).orderBy(F.desc("top"), "block", "part")) == 1  # a row for each block
        self.blocks = written(top.withColumn("head", head), "tops")

    def _visit(self, asks: DataFrame) -> DataFrame:
        """What ``asks`` (rows dealt to a block each) find in their blocks."""
        counts = asks.groupBy(*_BLOCK).agg(F.ceil(F.count("*") / ASKS).cast("int").alias("groups"))
        key = [*_BLOCK, "turn"]
        mine = asks.join(counts, _BLOCK).withColumn("turn", F.pmod(F.xxhash64("ask"), F.col("groups")).cast("int"))
        stored = self.lists.join(counts, _BLOCK).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups", "size")
        stored = stored.join(self.reps, "rep").select(*key, "rep", "label", "bound", "vec", "ids")
        mine = mine.select(*key, "ask", "label", "norm", "same", "least", "most", "k", "vec")
        return stored.groupBy(*key).cogroup(mine.groupBy(*key)).applyInPandas(_visited, _FOUND)

    def best(self, asks: DataFrame) -> DataFrame:
        """ask, id, rep, score, rank: the k best rows of each ask (ask, rep, same, least, most, k), exactly.

        First the head of its cluster's list; its k-th score there is what a later block's bound must reach to be visited at all.
        """
        own = asks.join(self.anchors.select("rep", "size", "cluster", "norm", "label", "vec"), "rep")
        at = own.join(self.blocks, _LIST)
        head = written(self._visit(at.where("head")), "head")
        reached = _ranked(head).join(asks.select("ask", "k"), "ask").groupBy("ask", "k").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where("n >= k").select("ask", "kth")
        rest = at.where("not head").join(reached, "ask", "left").withColumn("least", F.greatest("least", "kth"))
        rest = rest.where(F.col("top") * F.col("norm") * (1 + 1e-9) + 1e-6 >= F.col("least"))
        return _ranked(head.unionByName(self._visit(rest)).join(asks.select("ask", "k"), "ask"), "k")


def _ranked(found: DataFrame, k: str | None = None) -> DataFrame:
    rows = found.withColumn("id", F.explode("ids")).drop("ids")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id", "rep")))
    return ranked.where(F.col("rank") <= F.col(k)).drop(k) if k else ranked.drop("rank")


def mine(vectors: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, clusters: int = 8, sample_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the integer product of two vectors, components floor(scale * x).  Higher scores come first, ties by smaller id.  A row for
    which ``anchors`` is true has as positives its first ``positives`` other rows of its label; for each of them come the first
    ``negatives`` rows of other labels with ``low`` * positive score <= 100 * negative score <= ``high`` * positive score.  Results are
    exact.  Both searches walk the list of the anchor's cluster (``SharedLists``); centres are fitted on at most ``sample_rows`` distinct
    anchors of each vector size, all rows are in the lists.

    Rows with one label and equal vectors are one candidate that keeps only its smallest ids: of those no more can be asked for.
    Null ids, labels and vectors, null or non-finite components, and vectors whose squared scaled norm reaches 2^62 (a score might not be
    a long) take no part.  Vectors of different sizes are never compared.  Rows that repeat id, label and vector count once; rows with one
    id that differ count each, and as each other's partners.  No anchors, or an empty table: no rows.
    """
    keep = max(positives + 1, negatives)
    named = {"id": F.col(id_col).cast("long"), "label": F.col(label_col).cast("string"), "anchor": F.coalesce(anchors, F.lit(False))}
    good = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = int_vectors(good, named, F.col(vector_col), scale=scale, limit=2.0**31, kind="<i4", norm=2.0**62)
    value = ["label", "size", "vec"]
    rows = written(rows.groupBy(*value, "id").agg(F.max("anchor").alias("anchor")), "vectors")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if is_empty(rows.where("anchor")):
        return vectors.sparkSession.createDataFrame([], out)
    few = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*value).orderBy("id"))).where(F.col("_at") <= keep)
    reps = few.groupBy(*value).agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most ``keep`` ids
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    who = written(rows.where("anchor").select("id", *value).join(reps.drop("ids"), value).select("id", "rep"), "who")
    lists = SharedLists(reps, reps.join(who.select("rep").distinct(), "rep", "left_semi").drop("ids"), clusters, sample_rows)

    every = lists.anchors.select(F.col("rep").alias("ask"), "rep", F.lit(True).alias("same"), F.lit(-(1 << 62)).alias("least"), F.lit(1 << 62).alias("most"), F.lit(positives + 1).alias("k"))
    near = written(lists.best(every).select(F.col("ask").alias("of"), "id", "rep", "score"), "positives")
    window = lambda percent, up: f"score div 100 * {percent} + (score % 100 * {percent} + {up}) div 100"
    asked = near.where("score >= 0").select(F.col("of").alias("rep"), "score").distinct()
    asked = written(asked.select(F.monotonically_increasing_id().alias("ask"), "rep", "score", F.lit(False).alias("same"), F.expr(window(low, 99)).alias("least"), F.expr(window(high, 0)).alias("most"), F.lit(negatives).alias("k")), "asks")
    far = written(lists.best(asked.drop("score").where("least <= most")).select("ask", F.col("id").alias("negative_id"), "rank", F.col("score").alias("negative_score")), "negatives")

    own = who.select(F.col("id").alias("anchor_id"), F.col("rep").alias("of")).join(near, "of").where("id <> anchor_id or rep <> of")
    place = F.row_number().over(Window.partitionBy("anchor_id", "of").orderBy(F.desc("score"), "id", "rep"))
    own = own.withColumn("_at", place).where(F.col("_at") <= positives).select("anchor_id", "of", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named_asks = asked.select("ask", F.col("rep").alias("of"), F.col("score").alias("positive_score"))
    found = own.join(named_asks, ["of", "positive_score"]).join(far, "ask")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
