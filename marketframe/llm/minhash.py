"""Near-duplicate documents by bottom-k sketches from one hash function."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import grams, id_text, in_batches, is_empty, maybe_among, rows_of, word_hashes, words_of, written
from marketframe.llm.components import components, forest

#: Shingles of a block of sets; two blocks meet in one task.
TILE_SHINGLES = 1 << 16
#: Members of a list that one key of a join compares with each other; a longer list is dealt out.
COMPARED = 1 << 26
_SKETCHES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("lows", pa.list_(pa.int64())), ("more", pa.list_(pa.int32()))])


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the runs of ``words`` words (A-Z lower-cased); of the whole sequence if it is shorter."""
    return np.unique(grams(word_hashes(words_of(text, lower=True)), words) >> np.uint64(1))


def surely(draws: int, percent: int, miss: float) -> int:
    """The most successes out of ``draws`` that are missed with a chance of at most ``miss``, each succeeding in ``percent`` of 100."""
    p, below, c = percent / 100, 0.0, 0
    while c < draws and below + comb(draws, c) * p**c * (1 - p) ** (draws - c) <= miss:
        below += comb(draws, c) * p**c * (1 - p) ** (draws - c)
        c += 1
    return max(1, c)


def row_key(doc: Column | str, text: Column | str) -> Column:
    """63-bit hash of a row's id and text: different for two texts under one id, and there for null ids.  (Two of 10 million rows share
    one with a chance of 1 in 100,000.)"""
    return F.shiftrightunsigned(F.xxhash64(doc, text), 1)


def sketches(docs: DataFrame, words: int, size: int, keys: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, n_shingles, key (128-bit hash of the set; null if empty), lows (the ``keys`` smallest hashes), more (the first 31 bits of the
    next ones, ``size`` in all, enough for an estimate), both ascending."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, row, text in rows_of(batches, "id", "row", "text"):
            s = shingles(text, words)
            yield doc, row, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, s[:keys].view(np.int64), (s[keys:size] >> np.uint64(32)).astype(np.int32)

    rows = id_text(docs, id_col, text_col).withColumn("row", row_key("id", "text"))
    return rows.mapInArrow(lambda b: in_batches(make(b), _SKETCHES), "doc_id long, row long, n_shingles long, key binary, lows array<long>, more array<int>")


def _ceil_share(n: Column, percent: int) -> Column:
    return F.ceil(n * F.lit(percent) / F.lit(100)).cast("long")


def _in_order(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class _Search:
    """The steps of near_duplicates over rows (``docs``: id, a row_key, and text) with distinct shingle sets (``reps``: rep, n, lows, more)."""

    def __init__(self, docs: DataFrame, reps: DataFrame, words: int, percent: int, size: int, keys: int, small: int) -> None:
        self.docs, self.reps, self.words, self.percent, self.size, self.keys, self.small = docs, reps, words, percent, size, keys, small

    def close_sizes(self, m: Column, n: Column) -> Column:
        return F.least(m, n) * 100 >= F.greatest(m, n) * self.percent

    def needed(self, n: Column) -> Column:
        """Retained values that a document of ``n`` shingles ``surely`` shares with each that it is linked with."""
        return F.least(F.lit(surely(self.keys, self.percent, 1e-5)), _ceil_share(n, self.percent))

    def postings(self) -> DataFrame:
        """Documents with the retained values that have inverted lists: rep, n, central, low, high, extra, values.

        A linked pair shares ``needed`` c or more of its retained values, so it shares one among the rarest k - c + 1 of each side; the
        others (the corpus's most frequent ones) need no list.  Values that one document holds are shared with none: they only count
        towards k.  central: how frequent a document's values are together.  low, high: 128 bits, one set for each value held by
        another document too; extra: how many of those values found their bit set.
        """
        held = self.reps.select("rep", "n", F.explode("lows").alias("value"))
        often = written(held.groupBy("value").agg(F.count("*").alias("f")).where("f > 1"), "often")  # a plain table, so Spark can split the join
        # Values in one of 10,000 postings or more: at most 10,000 of them, so they are broadcast; no other value fills a task of the join.
        hot = often.where(F.col("f") * 10_000 >= held.count()).select(F.col("value").alias("hot"), F.col("f").alias("hot_f"))
        marked = held.join(F.broadcast(hot), F.col("value") == F.col("hot"), "left").drop("hot")
        counted = marked.where("hot_f is null").drop("hot_f").join(often, "value").select("rep", "n", "value", "f")
        counted = counted.unionByName(marked.where("hot_f is not null").select("rep", "n", "value", F.col("hot_f").alias("f")))
        ranked = counted.groupBy("rep").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", "value"))).alias("v"))
        ranked = ranked.withColumn("room", (F.size("v") - self.needed(F.col("n")) + 1).cast("int")).where("room > 0")
        central = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["f"]) + F.least("n", F.lit(self.keys)) - F.size("v")
        bits = [F.expr(f"aggregate(v, 0L, (s, x) -> s | if((x.value & 64) = {k}, shiftleft(1L, cast(x.value & 63 as int)), 0L))") for k in (0, 64)]
        signed = ranked.select("rep", "n", central.alias("central"), bits[0].alias("low"), bits[1].alias("high"), F.size("v").alias("k"), F.transform(F.slice("v", F.lit(1), F.col("room")), lambda x: x["value"]).alias("values"))
        return signed.withColumn("extra", F.col("k") - F.bit_count("low") - F.bit_count("high")).drop("k")

    def may_share(self, x: str, y: str) -> Column:
        """Whether two documents may share as many retained values as a linked pair does: never more than the bits they have in common and
        the values of either that have no bit of their own."""
        both = lambda c: F.bit_count(F.col(f"{x}.{c}").bitwiseAND(F.col(f"{y}.{c}")))
        return both("low") + both("high") + F.least(f"{x}.extra", f"{y}.extra") >= self.needed(F.greatest(f"{x}.n", f"{y}.n"))

    def alike(self, pairs: DataFrame, held: DataFrame) -> DataFrame:
        """Pairs that may share enough, by a few bytes a document, before sketches are joined."""
        side = lambda c: held.select(F.col("rep").alias(c), F.struct("n", "low", "high", "extra").alias(f"of_{c}"))
        return pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(self.may_share("of_a", "of_b")).select("a", "b")

    def starred(self, lists: DataFrame) -> DataFrame:
        """Each member of a list with its most central member: one pair for each posting, however long the list.  value, rep, n, central, m
        (the list's members), center (null if there is none to compare with); of short lists only rows with a center."""
        centers = written(lists.groupBy("value").agg(F.max(F.struct("central", (-F.col("rep")).alias("minus"), F.col("n").alias("center_n"))).alias("c"), F.count("*").alias("m")).where("m > 1"), "centers")
        meets = (F.col("rep") != -F.col("c.minus")) & self.close_sizes(F.col("n"), F.col("c.center_n"))
        both = lists.join(centers, "value").select("value", "rep", "n", "central", "m", F.when(meets, -F.col("c.minus")).alias("center"))
        return written(both.where((F.col("m") > self.small) | F.col("center").isNotNull()), "starred")

    def stars(self, starred: DataFrame) -> DataFrame:
        return starred.where("center is not null").select(*_in_order(F.col("rep"), F.col("center")))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose union sketch, the smallest values of both, has as many shared values as a linked pair surely has."""
        need = surely(self.size, self.percent, 1e-6)
        ids = written(pairs.distinct(), "pairs")
        sketch = F.slice(F.concat(F.transform("lows", lambda x: F.shiftright(x, 32).cast("int")), "more"), 1, self.size)
        side = lambda c: maybe_among(self.reps, "rep", ids.select(c)).select(F.col("rep").alias(c), sketch.alias(f"s{c}"))
        both = ids.join(side("a"), "a").join(side("b"), "b")
        both = both.select("a", "b", F.array_intersect("sa", "sb").alias("shared"), F.slice(F.array_sort(F.array_union("sa", "sb")), 1, self.size).alias("u"))
        hits = F.size(F.filter("shared", lambda x: x <= F.element_at("u", -1)))
        whole = F.size("u") < self.size  # both sets are here in full
        return both.where(F.when(whole, hits * 100 >= F.size("u") * self.percent).otherwise(hits >= need)).select("a", "b")

    def sets(self, ids: DataFrame) -> DataFrame:
        """Full sets of some documents, a hash in 6 bytes (the chance that two of a pair's thousand shingles meet is 1 in 10**8)."""
        kinds, words = pa.schema([("id", pa.int64()), ("set", pa.binary())]), self.words

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for doc, text in rows_of(batches, "id", "text"):
                s = np.unique(shingles(text, words) >> np.uint64(15))
                yield doc, s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()

        return maybe_among(self.docs, "id", ids).mapInArrow(lambda b: in_batches(make(b), kinds, 256), "id long, set binary")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar enough."""
        kinds, percent = pa.schema([("a", pa.int64()), ("b", pa.int64())]), self.percent

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for a, b, x, y in rows_of(batches, "a", "b", "x", "y"):
                p, q = unpacked(x), unpacked(y)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                if shared * 100 >= percent * (len(p) + len(q) - shared):
                    yield a, b

        side = lambda c, name: maybe_among(sets, "id", pairs.select(c)).select(F.col("id").alias(c), F.col("set").alias(name)).dropDuplicates([c])
        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        return written(both.mapInArrow(lambda b: in_batches(test(b), kinds), "a long, b long"), "links")

    def grouped(self, lists: DataFrame, groups: DataFrame) -> DataFrame:
        """Lists with each member's component so far."""
        return lists.join(groups, lists.rep == groups.node, "left").select(*lists.columns, F.coalesce("component", "rep").alias("component"))

    def opened(self, lists: DataFrame) -> DataFrame:
        """Of each list whose members are in several components: main (its center's), outside (members that are not in it), total (shingles
        of all members)."""
        main = lists.groupBy("value").agg(F.max(F.struct("central", (-F.col("rep")).alias("minus"), "component")).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("total"))
        main = written(main.where("lo <> hi").select("value", F.col("c.component").alias("main"), "m", "total"), "open")
        return main.join(lists, "value").groupBy("value", "main", "m", "total").agg(F.count_if(F.col("component") != F.col("main")).alias("outside"))

    def across(self, lists: DataFrame, opened: DataFrame, more: Column) -> DataFrame:
        """All pairs of a list whose components differ; members of the center's component never meet each other."""
        open_ = lists.join(opened.select("value", "main"), "value")
        x, y = open_.where("component <> main").alias("x"), open_.alias("y")
        differ = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
        differ &= self.close_sizes(F.col("x.n"), F.col("y.n"))
        return x.join(y, (F.col("x.value") == F.col("y.value")) & differ & more).select(*_in_order(F.col("x.rep"), F.col("y.rep")))

    def fitting(self, lists: DataFrame, opened: DataFrame, fits: Column) -> DataFrame:
        """Members of open lists that have a partner in another component whose size and place ``fits`` theirs: a row a member, not a
        pair.  A linked pair fits in the list of the first value that it shares."""
        parts = F.ceil(F.col("outside") * F.col("m") / COMPARED).cast("int").alias("parts")
        open_ = lists.join(opened.select("value", "main", parts), "value")

        def having(some: DataFrame, others: DataFrame) -> DataFrame:
            x = some.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).alias("x")
            y = others.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
            meet = (F.col("x.value") == F.col("y.value")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.component") != F.col("y.component"))
            return x.join(y, meet & self.close_sizes(F.col("x.n"), F.col("y.n")) & fits, "left_semi").drop("part")

        outside = written(having(open_.where("component <> main"), open_), "outside")
        inside = having(open_.where("component = main"), outside)
        return written(outside.unionByName(inside).select(*lists.columns), "fitting")

    def tiled(self, lists: DataFrame, opened: DataFrame, sets: DataFrame) -> DataFrame:
        """Links across components in lists that would give too many pairs: their members' sets meet in tiles of two blocks, of about
        ``TILE_SHINGLES`` shingles each.  A task counts shared shingles of all its pairs in memory and returns a spanning forest of
        the links; no pair is written, and none is left out."""
        dealt = lists.join(opened.select("value", F.ceil(F.col("total") / TILE_SHINGLES).cast("int").alias("blocks")), "value")
        dealt = dealt.select("value", "rep", "component", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        own = maybe_among(sets, "id", lists.join(opened, "value", "left_semi").select("rep"))
        dealt = dealt.join(own.select(F.col("id").alias("rep"), "set").dropDuplicates(["rep"]), "rep").withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        percent = self.percent

        def tile(group: pd.DataFrame) -> pd.DataFrame:
            low, high = group[group["block"] == group["low"]], group[group["block"] == group["high"]]
            p, q = ([unpacked(s) for s in g["set"]] for g in (low, high))
            if not p or not q:
                return pd.DataFrame({"a": [], "b": []}, dtype="int64")
            shared, sizes = shared_counts(p, q), [np.array([len(s) for s in x]) for x in (p, q)]
            hit = shared * 100 >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)
            hit &= low["component"].to_numpy()[:, None] != high["component"].to_numpy()[None, :]
            return pd.DataFrame(forest(hit, low["rep"].to_numpy(), high["rep"].to_numpy()), columns=["a", "b"], dtype="int64")

        return written(dealt.groupBy("value", "low", "high").applyInPandas(tile, "a long, b long").where("a <> b").distinct(), "tiled")

    def full_prefixes(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Exact inverted lists for documents that share long ones: rep, n, central, value, place.

        Full sets, ordered by how many of these documents hold each shingle: a linked pair shares one of the first n - ceil(share) + 1.
        Whoever differs too much from a large group starts with shingles of its own, and so drops out of the group's lists.
        """
        kinds = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("value", pa.int64())])

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for doc, raw in rows_of(batches, "id", "set"):
                s = unpacked(raw)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), doc)), pa.array(np.full(len(s), len(s))), pa.array(s.view(np.int64))], schema=kinds)

        own = maybe_among(sets, "id", members.select("rep")).join(members, F.col("id") == members.rep, "left_semi").dropDuplicates(["id"])
        each = own.mapInArrow(spread, "rep long, n long, value long")
        often = written(each.groupBy("value").agg(F.count("*").alias("f")), "often")
        ranked = each.join(often, "value").groupBy("rep").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", "value"))).alias("v"))
        room = (F.size("v") - _ceil_share(F.col("n"), self.percent) + 1).cast("int")
        prefix = ranked.select("rep", "n", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["f"]).alias("central"), F.posexplode(F.slice("v", F.lit(1), room)).alias("place", "x"))
        return prefix.where("x.f > 1").select("rep", "n", "central", F.col("x.value").alias("value"), "place")

    def run(self) -> DataFrame:
        """Component of every document that has a link: node, component."""
        held = written(self.postings(), "postings")
        starred = self.starred(held.select("rep", "n", "central", F.explode("values").alias("value")))
        hot = starred.where(F.col("m") > self.small).select("value", "rep", "n", "central")
        long_ = written(hot.select("value").distinct(), "long")
        # Any list: a star.  The estimate thins it out before texts are read.
        star = written(self.likely(self.alike(self.stars(starred), held)), "likely")
        sets = written(self.sets(star.select("a").union(star.select("b")).union(hot.select("rep"))), "sets")
        links = self.verified(star, sets)
        groups = components(links)
        # What the stars left open: pairs of short lists in different components; and long lists, by exact prefixes.
        short = self.grouped(held, groups).withColumn("value", F.explode("values")).drop("values", "central").join(long_, "value", "left_anti")
        x, y = short.alias("x"), short.alias("y")
        inside = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & self.close_sizes(F.col("x.n"), F.col("y.n")) & self.may_share("x", "y"))
        rest = self.likely(inside.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")))
        open_ = self.grouped(hot, groups)
        mixed = open_.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("value")
        members = written(open_.join(mixed, "value", "left_semi").select("rep").distinct(), "members")
        exact = None
        if not is_empty(members):
            exact = written(self.full_prefixes(members, sets), "prefixes")
            rest = rest.union(self.likely(self.stars(self.starred(exact))))
        rest = written(rest.distinct(), "likely")
        links = links.union(self.verified(rest, written(self.sets(rest.select("a").union(rest.select("b"))), "sets")))
        groups = components(links)
        if exact is not None:
            share = F.ceil((F.col("x.n") + F.col("y.n")) * self.percent / F.lit(100 + self.percent))
            fits = 1 + F.least(F.col("x.n") - F.col("x.place") - 1, F.col("y.n") - F.col("y.place") - 1) >= share
            open_ = written(self.grouped(exact, groups), "grouped")
            found = written(self.opened(open_), "opened")
            many = F.col("outside") * F.col("m") > self.small**2
            met = self.across(open_, found.where(~many), fits)
            thinned = opened = None
            if not is_empty(found.where(many)):
                thinned = self.fitting(open_, found.where(many), fits)
                opened = written(self.opened(thinned), "opened")
                met = met.union(self.across(thinned, opened.where(~many), fits))
            last = self.verified(written(self.likely(met), "pairs"), sets)
            if opened is not None and not is_empty(opened.where(many)):
                last = last.union(self.tiled(thinned, opened.where(many), sets))
            if not is_empty(last):
                groups = components(links.union(last))
        return groups


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).reshape(-1)


def shared_counts(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``p`` shares with each of ``q``.

    Values that many sets hold are columns of two matrices, multiplied; the others give their few pairs one by one, a bounded number at
    a time.
    """
    universe, left = np.unique(np.concatenate(p), return_inverse=True)
    right = np.concatenate(q)
    at = np.minimum(np.searchsorted(universe, right), len(universe) - 1)
    here = universe[at] == right
    right, own = at[here], [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (p, q)]
    own[1] = own[1][here]
    n = [np.bincount(x, minlength=len(universe)) for x in (left, right)]
    out = np.zeros((len(p), len(q)), np.int64)
    dense = n[0] * n[1] * 64 > len(p) * len(q)
    columns = np.flatnonzero(dense)
    for k in range(0, len(columns), 2048):
        number = np.full(len(universe), -1)
        number[columns[k : k + 2048]] = np.arange(len(columns[k : k + 2048]))
        sides = []
        for x, o, size in ((left, own[0], len(p)), (right, own[1], len(q))):
            side, mine = np.zeros((size, min(2048, len(columns) - k)), np.float32), number[x] >= 0
            side[o[mine], number[x[mine]]] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    order, o = np.argsort(right, kind="stable"), np.flatnonzero(~dense[left])
    starts = np.searchsorted(right[order], np.arange(len(universe) + 1))
    for part in np.array_split(o, max(1, -(-int(n[1][left[o]].sum()) // (1 << 22)))):
        times = n[1][left[part]]
        first = np.repeat(starts[left[part]] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) if len(part) else np.zeros(0, np.int64)
        met = own[1][order[first + np.arange(len(first))]]
        out += np.bincount(np.repeat(own[0][part], times) * len(q) + met, minlength=out.size).reshape(out.shape)
    return out


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, size: int = 64, keys: int = 24, small: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents are linked if ``100 * intersection >= percent * union`` of their sets of ``words``-word shingles.  Equal sets (copies)
    are one representative from the start.  Each representative keeps its ``size`` smallest hashes; inverted lists of the ``keys``
    smallest generate overlaps; signatures and the union sketch's estimate filter; links are confirmed on full sets.  A linked pair at exactly
    ``percent`` is missed by the sketches with a chance of about 1 in 10**5, a closer one with less.

    Large groups: a list of more than ``small`` members is not expanded into pairs.  Its members are compared with its most central
    one; whatever that leaves unlinked goes on to exact prefix lists of full sets, where only pairs of different components meet; if
    a list has too many of those (many members just under the threshold), those that fit by size and place meet in tiles that return
    links only.  No pair is dropped for a list's length.

    Null, empty and all-space texts have no shingles and no links: component_id is their own id, and they are kept.  One row of every
    group is kept: of those with the smallest id one text, and of identical rows one.  Ids need not be there or unique, as the search
    goes by id and text.  component_id is the smallest id of the group, so null if no member has one; two groups headed by
    different texts under one id carry the same.  An empty table gives no rows.  Columns other than the two named are not read.
    """
    return _judged(docs, words, percent, size, keys, small, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, words: int = 5, percent: int = 80, size: int = 64, keys: int = 24, small: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of near_duplicates with their row_key."""
    found = written(sketches(docs, words, size, keys, id_col=id_col, text_col=text_col).withColumn("place", F.monotonically_increasing_id()), "sketches")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "place")).alias("head")
    reps = found.where("key is not null").groupBy("key").agg(head, F.first("n_shingles").alias("n"), F.first("lows").alias("lows"), F.first("more").alias("more"))
    reps = written(reps.withColumn("rep", F.col("head.row")), "representatives")
    texts = id_text(docs, id_col, text_col).select(row_key("id", "text").alias("id"), "text")
    groups = _Search(texts, reps.select("rep", "n", "lows", "more"), words, percent, size, keys, small).run()
    heads = groups.join(reps.select("rep", "head"), F.col("node") == F.col("rep")).groupBy("component").agg(F.min("head").alias("first"))
    firsts = groups.join(heads, "component").select("node", "first")
    named = reps.join(firsts, reps.rep == firsts.node, "left").select("key", F.coalesce("first", "head").alias("head"))
    out = found.join(named, "key", "left")
    alone = F.col("key").isNull()
    return out.select("doc_id", "row", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), (alone | (F.col("place") == F.col("head.place"))).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: exactly one of each group, and every row without shingles."""
    doc, text = docs[options.get("id_col", "doc_id")].cast("long"), docs[options.get("text_col", "text")].cast("string")
    ids = _judged(docs, **options).where("kept and n_shingles > 0").select(F.col("row").alias("_kept_row"))
    full = F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    met = docs.where(full).withColumn("_row", row_key(doc, text)).join(ids, F.col("_row") == F.col("_kept_row"), "left_semi")
    return met.dropDuplicates(["_row"]).drop("_row").union(docs.where(~full))
