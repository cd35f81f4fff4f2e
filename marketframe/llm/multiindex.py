"""Near-duplicate vectors by an inverted multi-index over the product of two codebooks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import in_batches, rows_of, written
from marketframe.llm.components import components, forest

#: Rows of a shard, and of those that visit it at once; both together are one matrix product.
BLOCK = 1024
#: Rows of one label that a cell of the grid holds on average, while the codebooks can grow.
CELL_ROWS = 16
#: Sampled rows that the reach is measured on.
REACH_ROWS = 4096


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    """Codebook of at most ``k`` words for the rows of ``x``; the same for the same rows in the same order."""
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, words).argmin(1)
        for j in range(len(words)):
            if (near == j).any():
                words[j] = x[near == j].mean(0)
    return words


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1))


def multi_sequence(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Cells of the product grid from the nearest on: (squared distance, word of the first half, word of the second)."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}
    while heap:
        d, i, j = heappop(heap)
        yield float(d), int(o1[i]), int(o2[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(o1) and q < len(o2) and (p, q) not in seen:
                seen.add((p, q))
                heappush(heap, (d1[o1[p]] + d2[o2[q]], p, q))


class MultiIndex:
    """Two codebooks, and how far a search goes beyond the nearest cell.

    ``reach``: a search visits every cell whose squared distance is at most the nearest cell's plus ``reach``.  It is set on pairs
    that are ``cosine`` apart, the farthest that a link can be: sampled rows, each turned by that angle towards a random direction, towards
    a direction within the first or the second half, and towards another sampled row.  It is the most that the share ``recall`` of any of
    these kinds needs.
    """

    def __init__(self, sample: np.ndarray, cosine: float, *, words: int = 16, recall: float = 0.99, rounds: int = 12) -> None:
        self.half = sample.shape[1] // 2
        self.books = [kmeans(h, words, rounds) for h in (sample[:, : self.half], sample[:, self.half :])]
        rng = np.random.default_rng(1)
        some = sample[rng.permutation(len(sample))[:REACH_ROWS]]
        every = rng.standard_normal(some.shape)
        left, right = every.copy(), every.copy()
        left[:, self.half :], right[:, : self.half] = 0, 0
        d1, d2 = self.distances(some)
        at, self.reach = np.arange(len(some)), 0.0
        for towards in (every, left, right, np.roll(some, 1, axis=0)):
            towards = towards - (towards * some).sum(1, keepdims=True) * some
            length = np.linalg.norm(towards, axis=1)
            turned = cosine * some + np.sqrt(max(0.0, 1 - cosine * cosine)) * towards / np.maximum(length, 1e-12)[:, None]
            i, j = self.cells(turned)
            needs = (d1[at, i] + d2[at, j] - d1.min(1) - d2.min(1))[length > 1e-9]
            self.reach = max(self.reach, float(np.quantile(needs, recall))) if len(needs) else self.reach

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.half], self.books[0]), _distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d1, d2 = self.distances(x)
        return d1.argmin(1), d2.argmin(1)

    def visits(self, d1: np.ndarray, d2: np.ndarray) -> list[int]:
        """Cells to visit, nearest first."""
        limit, found = d1.min() + d2.min() + self.reach, []
        for d, i, j in multi_sequence(d1, d2):
            if d > limit:
                break
            found.append(i * len(self.books[1]) + j)
        return found


def usable(vector: list | None) -> np.ndarray | None:
    """The unit vector in double precision; None for null, empty or zero vectors, and for null or non-finite components."""
    if not vector or None in vector:
        return None
    x = np.array(vector, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or not top:
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def words_for(rows: int, least: int, sample_rows: int) -> int:
    """Words of a half's codebook: a power of two, so many that ``rows`` leave about ``CELL_ROWS`` in each cell of the grid, but at most
    one for each 32 sampled rows, so that a codebook is fitted on enough of them."""
    words = least
    while words * words * CELL_ROWS < rows and words * 64 <= sample_rows:
        words *= 2
    return words


def _fitted(units: DataFrame, cosine: float, words: int, recall: float, sample_rows: int) -> DataFrame:
    """(size, index): for every vector size of 2 components or more an index, fitted in one task on a bounded sample of that size only.

    Vectors of one component are 1 or -1 and lie in one cell.
    """
    labels = units.where("size >= 2").groupBy("size", "label").agg(F.count("*").alias("n"))
    most = labels.groupBy("size").agg(F.max("n").alias("most"))  # a row for each size
    place = F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("id", "label"), "id", "unit"))
    sample = units.select("id", "label", "size", "unit").where("size >= 2").withColumn("at", place).where(F.col("at") <= sample_rows).join(most, "size")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k = words_for(int(rows["most"].iloc[0]), words, sample_rows)
        rows = rows[rows["at"] <= max(min(sample_rows, 4096), 32 * k)].sort_values("at")
        own = MultiIndex(np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), key[0]), cosine, words=k, recall=recall)
        return pd.DataFrame({"size": [key[0]], "index": [pickle.dumps(own)]})

    return written(sample.groupBy("size").applyInPandas(fit, "size int, index binary"), "indexes")


def near_vectors(vectors: DataFrame, cosine: float = 0.93, *, words: int = 16, recall: float = 0.99, sample_rows: int = 32768, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: vectors of one label whose cosine is ``cosine`` or more are linked.

    Vectors equal as unit vectors are one representative with a count from the start.  Vectors of different sizes are never compared;
    each size has an index of its own, however few its rows.  Codebooks for both halves are fitted on a bounded sample of at most ``sample_rows``
    rows of the size (those with the smallest hash of id and label); every vector is indexed.  The grid grows with the rows of the
    largest label (``words_for``).  Each representative visits the nearest cells of the product grid by the multi-sequence algorithm,
    and the cosine of what it meets is computed in double precision.  A pair is looked for from one side only, so it is found at most
    once and counts for both.

    Cells that follow each other are one shard of about ``BLOCK`` rows; a larger cell is several, dealt by hash, and so are the rows that
    visit a shard.  A vector is copied once for each shard it visits.  A task returns counts and a spanning forest of its links, never
    its pairs.

    Null, empty or zero vectors, null or non-finite components, null labels and null ids: no links, component_id is their own id, and
    they are kept.  Rows repeated with one id count as separate vectors.  An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for row, label, vector in rows_of(batches, "id", "label", "vector"):
            x = usable(vector) if label is not None and row is not None else None
            yield row, label, None if x is None else len(x), None if x is None else x.tobytes()

    kinds = pa.schema([("id", pa.int64()), ("label", pa.string()), ("size", pa.int32()), ("unit", pa.binary())])
    each = written(rows.mapInArrow(lambda b: in_batches(units(b), kinds), "id long, label string, size int, unit binary"), "units")
    good = each.where("unit is not null")
    index = _fitted(good, cosine, words, recall, sample_rows)

    def placed(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        cells, visits = [0] * len(rows), [[0]] * len(rows)
        if len(own) and len(rows):
            grid = pickle.loads(own["index"].iloc[0])
            d1, d2 = grid.distances(np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), key[0]))
            cells, visits = d1.argmin(1) * len(grid.books[1]) + d2.argmin(1), [grid.visits(a, b) for a, b in zip(d1, d2, strict=True)]
        return rows[["first", "label", "size", "unit", "times"]].assign(cell=cells, visits=pd.Series(visits, index=rows.index, dtype=object))

    reps = written(good.groupBy("label", "size", "unit").agg(F.min("id").alias("first"), F.count("*").alias("times")), "reps")
    deals = max(1, -(-reps.count() // (4 * BLOCK)))
    dealt = reps.withColumn("deal", F.pmod(F.xxhash64("label", "unit"), F.lit(deals)).cast("int")).groupBy("size", "deal")
    copies = index.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).groupBy("size", "deal")
    at = dealt.cogroup(copies).applyInPandas(placed, "first long, label string, size int, unit binary, times long, cell int, visits array<int>")
    at = written(at.withColumn("rep", F.monotonically_increasing_id()), "cells")

    grid = ["size", "label", "cell"]
    shard = ["size", "label", "shard", "part"]
    cells = at.groupBy(*grid).agg(F.count("*").alias("n"))
    # A row for each cell in use; numbers run within stretches of cells, so no window holds a whole label.
    before = F.sum("n").over(Window.partitionBy("size", "label", F.shiftright("cell", 10)).orderBy("cell")) - F.col("n")
    plan = written(cells.select(*grid, (F.shiftright("cell", 10).cast("long") * (1 << 40) + F.floor(before / BLOCK)).alias("shard"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "shards")
    asking = at.select("rep", "size", "label", F.explode("visits").alias("cell")).join(plan, grid)
    asking = asking.select("rep", "size", "label", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).distinct()
    asking = written(asking, "visits")
    asked = asking.groupBy(*shard).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    stored = at.select("rep", *grid).join(plan, grid).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).join(asked, shard)
    stored = stored.select("rep", *shard, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("stored"))
    asking = asking.join(asked, shard).select("rep", *shard, F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("stored"))
    dealt = stored.unionByName(asking).join(at.select("rep", "unit", "times"), "rep")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        s, a = group[group["stored"]], group[~group["stored"]]
        x, y = (np.frombuffer(b"".join(g["unit"]), np.float64).reshape(len(g), -1) if len(g) else np.zeros((0, 1)) for g in (s, a))
        si, ai, st, at = s["rep"].to_numpy(), a["rep"].to_numpy(), s["times"].to_numpy(), a["times"].to_numpy()
        hit = np.zeros((len(ai), len(si)), bool)
        for k in range(0, len(ai) if len(si) else 0, 512):
            hit[k : k + 512] = (y[k : k + 512] @ x.T >= cosine) & (ai[k : k + 512, None] < si[None, :])
        rows_hit, cols_hit = hit.any(1), hit.any(0)
        counts = pd.concat([pd.DataFrame({"a": ai[rows_hit], "n": (hit[rows_hit] @ st)}), pd.DataFrame({"a": si[cols_hit], "n": (at @ hit[:, cols_hit])})])
        edges = pd.DataFrame(forest(hit, ai, si), columns=["a", "b"], dtype="int64")
        return pd.concat([counts.assign(b=None), edges.assign(n=None)])[["a", "b", "n"]].astype("Int64")

    met = written(dealt.groupBy(*shard, "block").applyInPandas(meet, "a long, b long, n long"), "met")
    groups = components(met.where("b is not null").select("a", "b"))
    others = met.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    named = at.select("rep", "first", "label", "unit", "times").join(others, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    named = named.join(smallest, "component").select(F.col("label").alias("l"), F.col("unit").alias("u"), (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), "smallest")
    # Copies of one vector may be a hot key here: both sides are plain rows, so Spark can split it.
    out = each.join(written(named, "named"), (F.col("label") == F.col("l")) & (F.col("unit") == F.col("u")), "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
