"""URL filters and revisit resolution."""

import random
import re
from collections import Counter
from math import log
from pathlib import Path

import duckdb
import pytest

from marketframe.llm import urls, warc

RULES = urls.RULES


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM/en/7?x#y", "https://example.com/en/8", "http://xexample.com/en/1", "http://com/en/", "http://a.net/de/8", "http://a.example.net/de/8/9", "http://example.net/de/7", "http://b.org/es/",
    "http://b.org/ES/", "http://b.org?q=/es/", "http://b.org#/es/", "a://b://c/d", "http://ÀB.org/es/x\ny", "x\ny://h.com/en/1", "http://free-bets.example.com/fr/1", "http://casinoparadise.test/fr/2", "http://quietgarden.test/fr/2", "http://" + "a" * 5000 + ".com/x", "http://h/" + "p/" * 3000,
]


def test_parts_and_rules(spark):
    html = "<html><p>casino paradise quiet garden free bets</p><script>no</script></html>"
    pages = spark.createDataFrame([(i, u, html if i % 2 else None, i, "w") for i, u in enumerate(URLS * 2)], "page_id long, url string, html string, token int, words string")
    out = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert len(out) == 2 * len(URLS)
    for i, u in enumerate(URLS * 2):
        r, (host, path) = out[i], plain_parts(u)
        assert (r.host, r.path) == (host, path)
        rule, verdict = plain_rule(host, path)
        assert r.rule == rule and r.verdict == (verdict or ("block" if r.score > 0 else "allow"))
    assert out[URLS.index("http://casinoparadise.test/fr/2")].words == "casino paradise test" or "casino" in out[URLS.index("http://casinoparadise.test/fr/2")].words.split()
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_viterbi_is_the_best_split():
    rng = random.Random(1)
    for _ in range(200):
        token = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        logs = {(i, n): log(rng.random()) for i in range(len(token)) for n in range(1, len(token) - i + 1) if rng.random() < 0.5}

        def best(end, logs=logs, token=token):
            return 0.0 if not end else max(best(end - n) + logs.get((end - n, n), -9.0 if n == 1 else -1e18) for n in range(1, end + 1))

        words, at, total = urls.viterbi(token, logs, -9.0), 0, 0.0
        for w in words:
            total += logs.get((at, len(w)), -9.0)
            at += len(w)
        assert "".join(words) == token and abs(total - best(len(token))) < 1e-9


def crawl():
    """Pages of which one rule blocks a part; others share words with the blocked ones, or with none."""
    rng = random.Random(2)
    block = [f"http://{rng.choice(['lucky', 'vegas', 'royal'])}win{k % 7}.bad.test/win/{k}" for k in range(60)]
    allow = [f"http://{rng.choice(['garden', 'museum', 'school'])}-{k % 7}.test/read/{k}" for k in range(120)]
    held = [f"http://lucky-vegas{k}.test/win/{900 + k}" for k in range(10)] + [f"http://school-garden{k}.test/read/{900 + k}" for k in range(10)]
    html = "<p>lucky vegas royal garden museum school win read test bad</p>"
    return [(i, u, html) for i, u in enumerate(block + allow + held + [None, "x", "http://casino.test/", "http://casino.test/"])]


def test_classifier_on_held_out_hosts(spark):
    """No rule fits these hosts, and none has a seed word: the words that they share with blocked or other hosts judge them."""
    pages = spark.createDataFrame(crawl(), "page_id long, url string, html string")
    out = {r.page_id: r for r in urls.judge_urls(pages, [("bad.test", "/", "block")], block_words=[]).collect()}
    assert [out[180 + k].verdict for k in range(20)] == ["block"] * 10 + ["allow"] * 10
    assert [out[i].rule for i in (0, 180)] == ["bad.test/", None]


def test_scores_are_the_plain_naive_bayes_ones(spark):
    pages = spark.createDataFrame(crawl(), "page_id long, url string, html string").repartition(3)
    seeds, rules = ["casino", "royal"], [("bad.test", "/", "block")]
    out = urls.judge_urls(pages, rules, block_words=seeds).collect()
    tokens = lambda r: r.words.split() + ["0" if t.isdigit() else t for t in re.split("[^a-z0-9]+", r.path.lower()) if t]
    blocked = {r.page_id for r in out if r.rule}
    count = {c: Counter(t for r in out if (r.page_id in blocked) == c for t in tokens(r)) for c in (True, False)}
    both, v = count[True] + count[False], len(count[True] + count[False])
    total = sum(both.values())

    def odds(t):
        share = [log((count[c][t] + v * both[t] / total) / (sum(count[c].values()) + v)) for c in (True, False)] if both[t] else [0.0, 0.0]
        return share[0] - share[1] + (log(urls.SEED_ODDS) if t in seeds else 0.0)

    prior = log(len(blocked) + 1) - log(len(out) - len(blocked) + 1)
    assert len(out) == 204 and all(abs(r.score - prior - sum(map(odds, tokens(r)))) < 1e-9 for r in out)


CAPTURES = "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def plain_revisits(rows):
    out = {}
    for i, u, at, kind, etag, day, digest, _ in rows:
        before = [r for r in rows if r[3] == "response" and r[1] == u and u is not None and (r[2], r[0]) < (at, i)]
        s = max(before, key=lambda r: (r[2], r[0]), default=None)
        if kind == "response":
            out[i] = ("response", i)
        elif s is None or kind is None:
            out[i] = ("missing", None)
        else:
            pairs = [(etag and etag.removeprefix("W/"), s[4] and s[4].removeprefix("W/")), (day, s[5]), (digest, s[6])]
            stated = [(a, b) for a, b in pairs if a is not None and b is not None]
            out[i] = ("mismatch", None) if any(a != b for a, b in stated) else ("resolved", s[0]) if stated else ("unvalidated", None)
    return out


@pytest.mark.parametrize("span_rows", [1000, 60, 7])
def test_revisits_are_the_plain_ones(spark, span_rows):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        url = rng.choice(["hot.org/a"] * 6 + ["b.org/x", "c.org", None])
        rows.append((i, url, rng.choice([rng.randint(0, 50)] * 30 + [10**12, -(10**12)]), rng.choice(["response", "revisit", "revisit", None]), rng.choice([None, "e1", "e2", "W/e1"]), rng.choice([None, "d1"]), rng.choice([None, None, "s1", "s2"]), {"Date": str(i), "Content-Length": "5"} if i % 3 else None))
    got = warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES).repartition(3), span_rows=span_rows).collect()
    assert {r.record_id: (r.verdict, r.source_id) for r in got} == plain_revisits(rows)
    assert warc.resolve_revisits(spark.createDataFrame([], CAPTURES)).count() == 0


def test_ties_and_one_outlying_time(spark):
    """Captures with one (at, record_id) come out the same in any order; an outlying time leaves the others in many ranges."""
    rows = [(i % 50, "hot.org/a", 5, rng_kind, f"e{i % 3}", None, None, None) for i, rng_kind in enumerate(["response", "revisit"] * 150)]
    frame = spark.createDataFrame(rows, CAPTURES)
    one, other = (sorted(map(tuple, warc.resolve_revisits(f, span_rows=20).select("record_id", "kind", "source_id", "verdict").collect()), key=repr) for f in (frame.repartition(4), frame.orderBy("etag")))
    assert one == other and len(one) == 300
    late = [(i, "hot.org/a", i if i else 10**15, "response", "e", None, None, None) for i in range(400)]
    spans = []
    written = warc.written
    try:
        warc.written = lambda df, name: spans.append(written(df, name)) or spans[-1]
        warc.resolve_revisits(spark.createDataFrame(late, CAPTURES), span_rows=40).count()
    finally:
        warc.written = written
    assert max(r["count"] for r in spans[0].groupBy("span").count().collect()) < 130


def test_merged_headers(spark):
    rows = [(1, "http://WWW.a.org:80/x/?utm_source=k&b=2&a=1#f", 1, "response", '"e"', None, None, {"Content-Type": "text/html", "Date": "1", "X": "1"}), (2, "https://a.org/x?a=1&b=2", 2, "revisit", 'W/"e"', None, None, {"content-type": "no", "DATE": "2"})]
    r = warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES)).where("record_id = 2").first()
    assert (r.canonical_url, r.source_id, r.headers) == ("a.org/x?a=1&b=2", 1, {"content-type": "text/html", "date": "2", "x": "1"})


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_header_names_are_one_whatever_their_case(spark):
    rows = [(1, "http://a/x", 1, "response", "e", None, None, {"Date": "1", "date": "2", "DATE": None, "X": None, "Set-Cookie": "a", "set-cookie": "b"}), (2, "http://a/x", 2, "revisit", "e", None, None, {"DATE": "3", "Date": "4", "ETag": "e"}), (3, "http://a/y", 3, "response", None, None, None, None)]
    got = {r.record_id: r.headers for r in warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert got == {1: {"date": "1, 2", "x": None, "set-cookie": "a, b"}, 2: {"date": "3, 4", "x": None, "set-cookie": "a, b", "etag": "e"}, 3: {}}


def test_query_is_its_sql(spark):
    at = "/root/testdata/sf0.01/pages.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}'")
    want = sorted(con.execute(f"SELECT page_id, canonical_url, kind, source_id, verdict, headers FROM ({warc.SQL})").fetchall())
    got = warc.digest(warc.resolve_revisits(warc.captures_of(spark.read.parquet(at)))).select("page_id", "canonical_url", "kind", "source_id", "verdict", "headers")
    assert sorted(map(tuple, got.collect())) == want
