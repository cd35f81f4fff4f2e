"""Near-duplicates of texts and vectors, and components, against brute force."""

import random

import numpy as np
import pytest

from marketframe.llm import minhash, multiindex
from marketframe.llm.components import components


def united(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def word_sets(text, width):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    width = min(width, len(words))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set()


def brute(rows, width, percent):
    sets = [(i, word_sets(t, width)) for i, t in rows]
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and 100 * len(a & b) >= percent * len(a | b)]
    return {i: len(s) for i, s in sets}, united([i for i, _ in sets], links)


def corpus():
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE  two", "é É", "É É"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 1, 2, 9])):
            near = base.copy()
            for _ in range(rng.choice([0, 1, 1, 2, 5, 12])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    hub = [rng.choice(vocabulary) for _ in range(60)]  # one large group of near copies, some too far from the others
    for _ in range(50):
        near = hub.copy()
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary) + "x"
        texts.append(" ".join(near))
    texts.append("long " * 30000 + "end")
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("width", "small"), [(2, 32), (2, 3), (5, 3)])
def test_near_duplicates_are_the_brute_force_ones(spark, width, small):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, i % 3, "k") for i, t in rows], "doc_id long, text string, rep int, key string")
    out = minhash.near_duplicates(docs.repartition(3), words=width, percent=80, small=small).collect()
    sizes, groups = brute(rows, width, 80)
    assert {r.doc_id: r.n_shingles for r in out} == sizes
    assert {r.doc_id: r.component_id for r in out} == groups
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_odd_documents(spark):
    kind = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    out = minhash.near_duplicates(spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "a b"), (2, "A B"), (9, None)], kind), words=2).collect()
    assert sorted(((r.doc_id or -1), r.component_id, r.kept) for r in out) == [(-1, 2, False), (2, 2, True), (5, 2, False), (5, 2, False), (9, 9, True)]
    left = minhash.one_of_each(spark.createDataFrame([(5, "a b", 1), (2, "A B", 2), (9, None, 3)], kind + ", kept int"), words=2)
    assert left.columns == ["doc_id", "text", "kept"] and sorted(r.doc_id for r in left.collect()) == [2, 9]


def test_what_sketches_surely_share():
    assert minhash.surely(24, 80, 1e-5) == 10 and minhash.surely(4, 80, 1e-5) == 1


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7), (2000, 2001), (2000, 2001), (None, 3)]
    out = components(spark.createDataFrame(links, "a long, b long"))
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert {r.node: r.component for r in out.collect()} == united({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        base = rng.standard_normal(16)
        for _ in range(int(rng.choice([1, 1, 2, 5]))):
            rows.append(((base + 0.05 * rng.standard_normal(16)).tolist(), k % 3))
    hot = rng.standard_normal(16)
    rows += [((hot + 0.03 * rng.standard_normal(16)).tolist(), 1) for _ in range(70)] + [((2.0 * hot).tolist(), 1)] * 30
    rows += [(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] * 16, 1), (hot.tolist(), None), ([1.0], 1), ([], 1)]
    return [(i, v, label, "x") for i, (v, label) in enumerate(rows)]


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 16)
    rows = vectors()
    out = {r.vec_id: r for r in multiindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string").repartition(3), 0.93, words=4).collect()}
    good = [(i, np.array(v, float) / np.linalg.norm(v), label) for i, v, label, _ in rows[: len(rows) - 7]]
    links = [(i, j) for k, (i, x, a) in enumerate(good) for j, y, b in good[:k] if a == b and x @ y >= 0.93]
    count = {i: sum(i in p for p in links) for i, *_ in rows}
    found = sum(r.n_links for r in out.values())
    assert 0.98 * 2 * len(links) <= found <= 2 * len(links)
    assert all(out[i].n_links <= count[i] for i in out)
    groups = united([i for i, *_ in rows], links)
    assert np.mean([out[i].component_id == groups[i] for i in out]) > 0.97
    for i, *_ in rows[len(rows) - 7 :]:
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)


def test_vectors_of_other_sizes_do_no_harm(spark, monkeypatch):
    """Whatever is sampled first: rows of other sizes, one component included, take no links from the rest and have their own."""
    monkeypatch.setattr(multiindex, "BLOCK", 8)
    rng = np.random.default_rng(5)
    hot = rng.standard_normal(12)
    rows = [(i, (hot + 0.02 * rng.standard_normal(12)).tolist(), 0) for i in range(50)]
    odd = [(100 + i, v, 0) for i, v in enumerate([[1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [5.0], [7.0], [-1.0], [0.0, 1.0, 0.0]])] + [(None, hot.tolist(), 0), (None, None, 0)]
    kind = "vec_id long, embedding array<double>, label int"
    out = multiindex.near_vectors(spark.createDataFrame(odd + rows, kind), 0.93, words=2).collect()
    links = {r.vec_id: r.n_links for r in out}
    assert sum(links[i] for i in range(50)) >= 0.98 * 50 * 49 and len(out) == 58
    assert [links[100 + i] for i in range(6)] == [1, 1, 1, 1, 0, 0]
    assert {r.vec_id: r.component_id for r in out if r.vec_id is not None and r.vec_id >= 100} == {100: 100, 101: 100, 102: 102, 103: 102, 104: 104, 105: 105}
    assert [(r.n_links, r.component_id, r.kept) for r in out if r.vec_id is None] == [(0, None, True)] * 2


def test_small_tables_and_rare_sizes_are_indexed(spark, monkeypatch):
    """No table is too small and no size too rare for codebooks: 500 rows in pairs at the threshold, twenty other sizes."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((250, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    near = 0.9305 * x + np.sqrt(1 - 0.9305**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    rows = [(i, v.tolist(), i % 5) for half in (x, near) for i, v in enumerate(half)]
    rows = [(k, v, label) for k, (_, v, label) in enumerate(rows)] + [(1000 + 10 * d + k, ([1.0, 0.001 * k] + [0.0] * d), 1) for d in range(1, 21) for k in range(3)]
    built, plain = [], multiindex._fitted
    monkeypatch.setattr(multiindex, "_fitted", lambda *a: built.append(plain(*a)) or built[-1])
    out = {r.vec_id: r for r in multiindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {r["size"] for r in built[0].collect()} == {24, *range(3, 23)}
    assert sum(out[i].component_id == out[250 + i].component_id for i in range(250)) >= 0.95 * 250
    assert all(out[1000 + 10 * d + k].n_links == 2 for d in range(1, 21) for k in range(3))


@pytest.mark.parametrize("kind", ["any", "left", "right", "row", "clusters"])
def test_recall_at_the_threshold(kind):
    """Pairs exactly at the threshold, apart in any direction: both lie in visited cells for 97 of 100."""
    rng = np.random.default_rng(13)
    x = rng.standard_normal((4000, 32))
    if kind == "clusters":
        x = rng.standard_normal((40, 32))[rng.integers(0, 40, 4000)] + 0.4 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal(x.shape)
    if kind == "left":
        away[:, 16:] = 0
    if kind == "right":
        away[:, :16] = 0
    if kind == "row":
        away = x[rng.permutation(len(x))]
    away -= (away * x).sum(1, keepdims=True) * x
    near = 0.93 * x + np.sqrt(1 - 0.93**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    index = multiindex.MultiIndex(x[:2000], 0.93, words=32)
    met = 0
    for k in range(2000, 4000, 5):
        d1, d2 = (d[0] for d in index.distances(x[k : k + 1]))
        i, j = index.cells(near[k : k + 1])
        met += int(i[0]) * len(index.books[1]) + int(j[0]) in index.visits(d1, d2)
    assert met >= 0.97 * 400


def test_two_vectors_under_one_id_are_linked(spark):
    rows = [(4, [1.0, 0.0], 1), (4, [1.0, 0.01], 1), (9, [0.0, 1.0], 1), (9, [1.0, 0.0], 1)]
    out = multiindex.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(4, 2, 4), (4, 2, 4), (9, 0, 9), (9, 2, 4)]


def test_the_grid_grows_with_the_rows():
    assert [multiindex.words_for(n, 16, 32768) for n in (10, 4096, 5000, 10**6, 10**9)] == [16, 16, 32, 256, 1024]


def test_odd_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert multiindex.near_vectors(spark.createDataFrame([], kind)).count() == 0
    assert [r.n_links for r in multiindex.near_vectors(spark.createDataFrame([(1, None, 1), (2, [0.0, 0.0], 1)], kind)).collect()] == [0, 0]
    same = multiindex.near_vectors(spark.createDataFrame([(4, [1.0, 0.5], 1), (4, [1.0, 0.5], 1), (3, [2.0, 1.0], 1)], kind)).collect()
    assert [(r.n_links, r.component_id) for r in same] == [(2, 3)] * 3


def test_cells_come_nearest_first():
    d1, d2 = np.array([3.0, 1.0, 2.0]), np.array([0.5, 4.0])
    cells = list(multiindex.multi_sequence(d1, d2))
    assert len({(i, j) for _, i, j in cells}) == 6 and [d for d, *_ in cells] == sorted(d for d, *_ in cells)


def test_null_and_repeated_ids(spark):
    """One row of each group stays: a unique null id, a group of null ids only, identical rows, two texts under one id."""
    base = [f"w{k}" for k in range(40)]
    near = [*base[:-1], "other"]
    rows = [(None, "only one here"), (None, "null group"), (None, "NULL group"), (7, "same row"), (7, "same row"), (7, "same row"), (None, None), (None, " "), (8, ""), (8, "")]
    rows += [(3, " ".join(base)), (3, "quite another text"), (4, " ".join(near)), (5, "quite another TEXT"), (6, " ".join(base[::-1])), (6, " ".join([*base[::-1][:-1], "other"]))]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = sorted(r.n for r in minhash.one_of_each(docs, words=2).collect())
    assert len(kept) == 10 and set(kept) >= {0, 6, 7, 8, 9, 10, 11} and not set(kept) & {12, 13}
    assert [len(set(kept) & g) for g in ({1, 2}, {3, 4, 5}, {14, 15})] == [1, 1, 1]
    out = minhash.near_duplicates(docs, words=2)
    assert out.count() == 16 and out.where("kept").count() == len(kept)
    assert sorted(r.component_id for r in out.where("n_shingles > 0 and doc_id between 3 and 6").collect()) == [3, 3, 3, 3, 6, 6]
    assert out.where("n_shingles > 0 and doc_id is null and component_id is not null").count() == 0


def test_shared_counts_are_the_plain_ones():
    rng = np.random.default_rng(3)
    for size, pool in ((40, 60), (30, 100000), (1, 5)):
        p, q = ([np.unique(rng.integers(0, pool, rng.integers(1, 40))).astype(np.uint64) for _ in range(size)] for _ in range(2))
        p[0] = np.arange(50, dtype=np.uint64)
        assert (minhash.shared_counts(p, q) == [[len(np.intersect1d(a, b)) for b in q] for a in p]).all()


@pytest.mark.parametrize(("members", "tile"), [(300, 1 << 13), (1200, 1 << 16)])
def test_a_large_group_just_under_the_threshold(spark, monkeypatch, members, tile):
    """Documents that each hold 84 of one template's 100 lines, about 0.72 alike: no pair of the group is written, and the few links
    that are there are found."""
    monkeypatch.setattr(minhash, "TILE_SHINGLES", tile)
    rng = np.random.default_rng(6)
    lines = [f"line{k} text{k}" for k in range(100)]
    rows = [(i, ". ".join(f"{lines[k]} end{k}" for k in sorted(rng.choice(100, 84, replace=False)))) for i in range(members)]
    rows += [(members + i, rows[i][1] + f" extra{i}") for i in range(5)]
    seen, written = [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: seen.append((name, written(df, name))) or seen[-1][1])
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert [out[members + i] == out[i] for i in range(5)] == [True] * 5
    if members == 300:
        assert out == brute(rows, 2, 80)[1]
    assert max(df.count() for name, df in seen if name in ("pairs", "likely")) < 100 * members
    assert any(name == "tiled" for name, _ in seen)


def of_parts(seed, documents, parts, options):
    """Documents of some passages, each one of many for its place: two that share one passage are far from alike."""
    rng = np.random.default_rng(seed)
    chosen = rng.integers(0, options, (documents, parts))
    return [(i, " ".join(f"p{place}x{c}x{k}" for place, c in enumerate(row) for k in range(20))) for i, row in enumerate(chosen)]


def test_documents_that_share_a_passage_are_no_pairs(spark, monkeypatch):
    """Each document meets some forty others in short lists, by a sixth of its words; sketches are joined for few of those pairs, and
    near copies are found among them."""
    rows = of_parts(8, 400, 6, 50)
    rows += [(400 + i, rows[i][1].replace("x7 ", "y7 ")) for i in range(20)]
    seen, written = [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: seen.append((name, written(df, name))) or seen[-1][1])
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert out == brute(rows, 2, 80)[1] and out[400] == 0
    assert sum(df.count() for name, df in seen if name == "pairs") < 5 * len(rows)


def test_signatures_keep_every_pair_that_shares_enough(spark):
    """What may_share leaves out shares fewer retained values than a linked pair surely does, also where values meet in a bit."""
    rng = np.random.default_rng(9)
    words = rng.permutation(60)
    rows = [(i, " ".join(f"w{k}" for k in rng.choice(words, 45))) for i in range(120)]
    found = minhash.sketches(spark.createDataFrame(rows, "doc_id long, text string"), 1, 64, 24)
    reps = found.select(minhash.F.col("doc_id").alias("rep"), minhash.F.col("n_shingles").alias("n"), "lows", "more")
    search = minhash._Search(None, reps, 1, 80, 64, 24, 32)
    held = search.postings()
    pairs = spark.range(120).crossJoin(spark.range(120).toDF("b")).toDF("a", "b").where("a < b")
    kept = {(r.a, r.b) for r in search.alike(pairs, held).collect()}
    lows = {r.rep: set(r.lows) for r in reps.collect()}
    least = minhash.surely(24, 80, 1e-5)
    enough = {(a, b) for a in lows for b in lows if a < b and len(lows[a] & lows[b]) >= least}
    assert 100 < len(enough) < 7000 and enough <= kept and all(len(r["values"]) <= 15 for r in held.collect())


def test_only_members_that_fit_by_place_meet_in_tiles(spark, monkeypatch):
    """Of a long list, those stay that have a partner by size and place in another component, however the list is dealt."""
    rng = np.random.default_rng(10)
    rows = [(v * 1000 + i, int(n), 1, v, int(rng.integers(0, n // 4)), 0 if i < 60 else int(rng.integers(0, 5))) for v in range(3) for i, n in enumerate(rng.integers(80, 120, 100))]
    lists = spark.createDataFrame(rows, "rep long, n long, central long, value long, place int, component long")
    opened = spark.createDataFrame([(v, 0, 100, 9000, 40) for v in range(3)], "value long, main long, m long, total long, outside long")
    F = minhash.F
    fits = 1 + F.least(F.col("x.n") - F.col("x.place") - 1, F.col("y.n") - F.col("y.place") - 1) >= F.ceil((F.col("x.n") + F.col("y.n")) * 80 / F.lit(180))
    good = lambda x, y: x[3] == y[3] and x[5] != y[5] and min(x[1], y[1]) * 100 >= max(x[1], y[1]) * 80 and min(x[1] - x[4], y[1] - y[4]) >= -(-(x[1] + y[1]) * 80 // 180)
    expected = sorted(x[0] for x in rows if any(good(x, y) for y in rows))
    search = minhash._Search(None, None, 2, 80, 64, 24, 32)
    for compared in (1 << 26, 100):
        monkeypatch.setattr(minhash, "COMPARED", compared)
        out = search.fitting(lists, opened, fits)
        assert out.columns == lists.columns and sorted(r.rep for r in out.collect()) == expected
    assert 0 < len(expected) < len(rows)
