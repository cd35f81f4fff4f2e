"""Hard negatives against brute force; eigendecompositions and whitening against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.llm import negatives, whitening

KIND = "vec_id long, embedding array<float>, label int, rep long, size string"


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def plain_mine(rows, every=5, scale=256):
    good = {(i, label, tuple(math.floor(scale * x) for x in v)) for i, v, label, *_ in rows if i is not None and label is not None and usable(v)}
    good = {g for g in good if sum(x * x for x in g[2]) < 1 << 62}
    found = []
    for a in good:
        if a[0] % every:
            continue
        scores = [(-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b) for b in good if len(b[2]) == len(a[2])]
        scores.sort(key=lambda s: s[:2])
        same = [s for s in scores if s[2][1] == a[1] and s[2] != a][:5]
        for p in same:
            fit = [s for s in scores if s[2][1] != a[1] and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:3]
            found += [(a[0], p[1], k + 1, n[1], -p[0], -n[0]) for k, n in enumerate(fit)]
    return sorted(found)


def vector_rows(rng, n=400, size=12):
    centres = rng.standard_normal((6, size))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.standard_normal(size) * rng.choice([0.2, 0.8])
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v) * rng.choice([1, 1, 3])], int(rng.integers(0, 4)), 1, "x"))
    hot = rows[0][1]
    rows += [(n + k, hot, 1, 1, "x") for k in range(130)]
    return rows


def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("ASKS", 8), ("STEP", 16)):
        monkeypatch.setattr(negatives, name, value)
    rows = vector_rows(np.random.default_rng(3))
    odd = [(600, None, 1, 1, ""), (605, [1.0, None], 1, 1, ""), (610, [math.nan] * 12, 1, 1, ""), (615, [math.inf] * 12, 2, 1, ""), (620, rows[3][1], None, 1, ""), (None, rows[3][1], 1, 1, ""), (5, rows[5][1], rows[5][2], None, None), (5, rows[6][1], 1, 1, "")]
    odd += [(700 + k, [0.0] * 12, k % 2, 1, "") for k in range(20)] + [(800 + k, [float(k % 3), 1.0], k % 3, 1, "") for k in range(30)] + [(900 + k, [], k % 2, 1, "") for k in range(12)] + [(950, [3e7] * 12, 1, 1, ""), (955, [3e7] * 12, 1, 1, ""), (960, [2.0**21] * 12, 1, 1, ""), (965, [2.0**21 + 1] * 12, 1, 1, ""), (970, [2.0**20 * 1.5] * 12, 2, 1, "")]
    got = negatives.mine(spark.createDataFrame(rows + odd, KIND).repartition(7), F.col("vec_id") % 5 == 0, clusters=3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_mine(rows + odd)


def test_no_anchors(spark):
    rows = vector_rows(np.random.default_rng(4), 20)
    for df, anchors in ((spark.createDataFrame([], KIND), F.lit(True)), (spark.createDataFrame(rows, KIND), F.lit(None).cast("boolean"))):
        assert negatives.mine(df, anchors).collect() == []


def test_a_bound_is_never_below_a_product():
    rng = np.random.default_rng(5)
    x, y = (rng.standard_normal((n, 9)) * rng.choice([1, 50], (n, 1)) for n in (300, 60))
    unit, norm = negatives.units(x)
    own, length = negatives.units(y)
    centres = negatives.spherical_kmeans(own, 4)
    far = negatives.angles(own, centres)
    radii = np.array([far[far.argmin(1) == k, k].max(initial=0) for k in range(len(centres))])
    bound = negatives.upper_bounds(unit, norm, centres, radii)
    assert (own @ x.T <= bound[:, far.argmin(1)].T + 1e-9).all()


def test_a_walk_ends_where_it_is_certified(monkeypatch):
    """Close clusters: most of a long list is never multiplied."""
    rng = np.random.default_rng(6)
    x = np.round(np.concatenate([rng.standard_normal((300, 8)) * 3 + 100, rng.standard_normal((6000, 8)) * 3 + [100, -100] * 4]))
    y = np.round(rng.standard_normal((10, 8)) * 3 + 100)
    unit, norm = negatives.units(x)
    centre = negatives.units(y.mean(0)[None])[0]
    bound = negatives.upper_bounds(unit, norm, centre, negatives.angles(negatives.units(y)[0], centre).max(0))[:, 0]
    order = np.argsort(-bound)
    asks = __import__("pandas").DataFrame({"k": [3] * 10, "norm": negatives.units(y)[1], "same": [True] * 10, "least": [-(1 << 62)] * 10, "most": [1 << 62] * 10})
    seen, plain = [], negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, b: (seen.append(len(b)), plain(a, b))[1])
    a, c, v = negatives.walk(x[order], bound[order], np.arange(len(x)), np.zeros(len(x)), y, asks, np.zeros(10))
    want = -np.sort(-(y @ x.T).astype(np.int64), axis=1)[:, :3]
    assert (v.reshape(10, 3) == want).all() and sum(seen) < 1500


@pytest.mark.parametrize(("size", "n"), [(1, 5), (3, 40), (24, 200), (24, 9)])
def test_updates_keep_the_decomposition(size, n):
    rng = np.random.default_rng(size + n)
    x = rng.integers(-500, 500, (n, size)).astype(float)
    if size > 3:
        x[:, 3], x[:, 5] = x[:, 2], 7  # equal columns, one that never varies
    x[n // 2 :: 3] = x[0]
    parts = [whitening.Spectrum(size) for _ in range(3)]
    for k, row in enumerate(x):
        parts[k % 2].add(row)
    raw = whitening.merged_spectra([p.packed() for p in parts], size)  # the third has seen nothing
    s = whitening.Spectrum.unpacked(raw, size)
    c = x - x.mean(0)
    assert s.n == n and np.allclose(s.mean, x.mean(0), rtol=1e-12)
    assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - c.T @ c).max() <= 1e-11 * max(np.abs(c.T @ c).max(), 1)
    assert np.abs(s.vectors.T @ s.vectors - np.eye(size)).max() < 1e-12


def test_roots_of_close_poles():
    d = np.array([1.0, 1 + 1e-13, 2.0, 2 + 1e-9, 5.0])
    z = np.array([1e-3, 0.5, 1e-8, 0.7, 0.2])
    roots, gaps = whitening.secular_roots(d, z, 3.0)
    assert (roots[:-1] >= d[:-1]).all() and (roots[:-1] <= d[1:]).all() and roots[-1] <= d[-1] + 3.0 * (z @ z)
    terms = 3.0 * z[:, None] ** 2 / gaps
    assert (np.abs(1 + terms.sum(0)) <= 1e-11 * (1 + np.abs(terms).sum(0))).all()


def plain_whiten(rows, components=8):
    """(vec_id, component) -> (n, deviation, |whitened|, explained) by numpy and Python's integers."""
    found = {}
    by_size = {}
    for i, v, *_ in rows:
        if usable(v) and v and max(map(abs, v)) < 2.0**42:
            by_size.setdefault(len(v), []).append((i, [math.floor(1024 * float(x)) + 100_000 for x in v]))
    for size, own in by_size.items():
        n, sums = len(own), [sum(x[k] for _, x in own) for k in range(size)]
        c = np.array([[float(n * x[k] - sums[k]) / n for k in range(size)] for _, x in own])
        values, vectors = np.linalg.eigh(c.T @ c / n)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        for (i, x), row in zip(own, c, strict=True):
            for k, (e, u) in enumerate(zip(values, vectors.T, strict=True)):
                flat = e <= 1e-10 * max(values[0], 1e-300)
                found[i, k + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), None if flat else abs(row @ u / math.sqrt(e)), (0.0 if flat else e / (c * c).sum() * n) if (c * c).sum() else None)
    return found


def test_whitened_vectors_are_those_of_numpy(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(12) * np.arange(1, 13) / 30], 1, 1, "x") for i in range(300)]
    rows += [(300 + k, rows[0][1], None, None, None) for k in range(120)]
    rows += [(500 + k, [0.25 * k, 0.5 * k, 1.0], 1, 1, "") for k in range(9)] + [(600, [1.5], 1, 1, ""), (610, [2.0, 3.0], 1, 1, ""), (611, [2.0, 3.0], 1, 1, "")]
    rows += [(700, None, 1, 1, ""), (701, [math.nan] * 12, 1, 1, ""), (702, [None] * 12, 1, 1, ""), (703, [-math.inf] * 12, 1, 1, ""), (704, [], 1, 1, ""), (705, [1e30] * 12, 1, 1, "")]
    df = spark.createDataFrame(rows, KIND)
    want, errors = plain_whiten(rows), {}
    for split in (1, 23):
        got = whitening.whiten(df.repartition(split)).collect()
        assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
        signs = {}
        for r in got:
            n, deviation, size, share = want[r.vec_id, r.component]
            assert (r.n, r.deviation) == (n, deviation)
            assert (r.whitened is None) == (size is None) and (r.explained is None) == (share is None)
            if size is not None:
                assert abs(abs(r.whitened) - size) < 1e-8 and abs(r.explained - share) <= 1e-9 and r.identity_error < 1e-10
            errors.setdefault(r.n, set()).add(r.identity_error)
            signs[r.vec_id, r.component] = r.whitened
        white = np.array([[signs[i, k] for k in range(1, 9)] for i in range(420)])
        assert np.abs(white.T @ white / 420 - np.eye(8)).max() < 1e-10
    empty = whitening.whiten(spark.createDataFrame([], KIND))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_sums_and_deviations_beyond_a_long(spark):
    big = [(k, [2.0**41 - k, -(2.0**41)], 1, 1, "") for k in range(6)]
    rows = spark.createDataFrame(big, "vec_id long, embedding array<double>, label int, rep long, size string")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(rows).collect()}
    x = [[math.floor(1024 * v) + 100_000 for v in r[1]] for r in big]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert all(got[k, 1].deviation == sum((6 * a - s) ** 2 for a, s in zip(x[k], sums, strict=True)) for k in range(6))
    assert whitening.Centre(1 << 40, [0]).deviations(np.array([[1 << 30], [1]])) == [None, None]


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 2.0], 1, 1, ""), (3, [2.0, 1.0], 1, 1, ""), (3, [2.0, 1.0], 1, 1, "")]
    got = whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(str(r.vec_id) for r in got) == ["3"] * 4 + ["None"] * 2 and {r.n for r in got} == {3}
