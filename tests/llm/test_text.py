"""Quality rules, personal data and language-model scores."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.llm import lm, pii, quality

KIND = "doc_id long, text string, spot int, base string"
ODD = [None, "", "  \n\t", "one", "a b c a b c", "é é é é", "x\n\nx\n x\nx", "#*$ %&|<>", "w " * 20000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "b") for i, t in enumerate(texts)], KIND)


def plain_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hot = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hot)


def test_features_are_the_plain_ones():
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["a", "b", "é#", "\n", "c|", "\x1c", "d\n"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for t in texts:
        assert quality.features(t) == plain_features(t), t


def clean(rng, n=80):
    return " ".join(rng.choice(["the", "thing", "and", "nation", "of", "being", "there", "ration", "inner"]) + str(rng.choice(["", "", "ly", "er"])) for _ in range(n))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(2)
    unique = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = [" ".join(f"{w}{unique()[:2]}" for w in clean(rng).split()) for _ in range(200)]
    junk = [" ".join(f"{unique().upper()}!!##" for _ in range(80)) for _ in range(200)]
    docs = frame(spark, good + junk + ODD)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 100)] + [(i, 0, 0) for i in range(200, 300)] + [(5, 0, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.judge(docs, quality.fit(docs, labels)).collect()}
    assert np.mean([out[i].kept for i in range(100, 200)]) > 0.97 and not any(out[i].kept for i in range(300, 400))
    for i, t in enumerate(ODD, 400):
        assert (out[i].n_words, out[i].word_chars, out[i].n_symbols, out[i].n_dup_lines, out[i].n_repeat_words) == plain_features(t)
        assert out[i].base_failed and not out[i].kept
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}
    no_labels = quality.judge(docs, quality.fit(docs, labels.limit(0)))
    assert all(r.kept != r.base_failed for r in no_labels.collect())
    assert quality.judge(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_every_label_counts(spark):
    """Target and threshold over more labelled rows than any bound there was, as a plain computation has them."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "nation", "ration"]) + rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(4600)]
    texts += [" ".join(rng.choice(["XX!", "Y##", "the"]) for _ in range(rng.randint(1, 9))) for _ in range(4300)]
    labels = [(i, int(i < 4600), int(i % 50 == 0)) for i in range(8900)]
    model = quality.fit(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(3), buckets=1 << 12)
    hits = lambda some: np.bincount(np.concatenate([quality._buckets(t.encode(), 3, 1 << 12) for t in some]), minlength=1 << 12)
    raw, target = hits(texts), hits([texts[i] for i, q, t in labels if q and not t])
    ratio = np.log((target + 0.5) / (target.sum() + 2048)) - np.log((raw + 0.5) / (raw.sum() + 2048))
    assert np.allclose(model.ratio, ratio, rtol=0, atol=1e-12)
    scores = [quality._mean(model.ratio, 3, t.encode()) for t in texts]
    ups, downs = sorted(scores[i] for i, q, t in labels if q and not t), sorted(scores[i] for i, q, _ in labels if not q)
    edge = ups[len(ups) * 5 // 1000]
    under = [x for x in downs if x < edge]
    assert len(ups) > 4000 and under and model.threshold == edge - (edge - under[len(under) * 95 // 100]) / 4


@pytest.mark.parametrize("values", [[0.5], [1.0] * 9, [5e-324, 0.0, 1e300, -1e300, 2.0, 2.0], [k**3 / 7 for k in range(-50, 50)]])
def test_number_at_a_place(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(2)
    for k in {0, len(values) // 3, len(values) - 1}:
        assert quality.nth(rows, "v", k, 4) == sorted(values)[k]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(x) < 256 for x in value.split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_base_spans_are_the_plain_ones(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "@", ".", "_d@e.f", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", "-", " ", "12", "é", "\n", "x", "0" * 15, "%", "\U0001f600"]
    texts = ODD + ["a@b.c_d@e.f..g@h.i", "1.2.3.4.5.6.7.8", "+1 2 3", "5" * 5000, "a" * 30000, "a@" * 3000, "1." * 4000, "00000000001.2.3.4", "+" + "1(" * 2000] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    docs = frame(spark, texts)
    out = {r.doc_id: r for r in pii.counted(pii.find(docs)).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        assert out[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [out[i][f"n_{k}"] for k in PATTERNS] == [want.count(f"{k}:") for k in PATTERNS]
        assert set(want.split(",")) - {""} <= set(out[i].spans.split(","))


def told_terms(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(["plain", "words", "every", "where", "other"]) for _ in range(n))
    secret = [f"{filler(9)} Falkenhorst wrote to k.f@mail.example.com {filler(9 + k)}" for k in range(4)]
    return frame(spark, secret + [f"{filler(15)} someone{k} other n{k}@mail.example.com {filler(9)}" for k in range(40)] + ["Falkenhorst"[:4] + " none here " + filler(5), None, ""])


def test_terms_that_tell(spark):
    out = {r.doc_id: r.spans for r in pii.counted(pii.find(told_terms(spark))).collect()}
    text = {r.doc_id: r.text for r in told_terms(spark).collect()}
    for i in range(4):
        at = text[i].index("Falkenhorst")
        assert f"term:{at}:{at + 11}" in out[i].split(",") and "email:" in out[i]
    assert not any("term" in out[i] for i in range(4, 47))
    many = pii.find(told_terms(spark), support=5)
    assert not any("term" in r.spans for r in pii.counted(many).collect())


def test_sanitised_texts(spark):
    docs = told_terms(spark)
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert pii.sanitise(docs).columns == docs.columns and len(out) == docs.count()
    assert all("Falkenhorst" not in out[i].text and "<email>" in out[i].text and "@" not in out[i].text for i in range(4))
    assert out[45].text is None and out[46].text == ""
    twice = docs.union(docs).union(frame(spark, []))
    assert pii.sanitise(twice).count() == 2 * docs.count()
    assert pii.counted(pii.find(docs.limit(0))).count() == 0
    spans = F.expr("array(named_struct('start', 1, 'kind', 1, 'end', 4), named_struct('start', 2, 'kind', 3, 'end', 6))")
    assert spark.range(1).select(pii.sanitised(F.lit("é12345678"), spans)).first()[0] == "é<ip>678"


def test_network_learns_both_sides():
    """A token that follows from its neighbours gets likely; the gradient is the numeric one."""
    shape = lm.Shape(window=1, width=8, classes=4, members=4, own=8)
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, 8, 4000), rng.integers(0, 8, 4000)
    line = np.stack([left, np.where(right < 4, left, right) + 8, right], 1).ravel()  # the middle needs both sides
    around = lm.contexts([line], shape)
    assert (around[0][1:] == line[:-1]).all() and around[0][0] == shape.tokens == around[1][-1]
    p = shape.blank()
    before = lm.log_likelihoods(p, around, line, shape).mean()
    for _ in range(60):
        for k in range(0, len(line), 512):
            lm.train_step(p, around[:, k : k + 512], line[k : k + 512], shape, 1.5)
    assert lm.log_likelihoods(p, around, line, shape).mean() > before + 0.8
    p = {k: v.astype(np.float64) for k, v in shape.blank().items()}
    some, small = line[:50], around[:, :50]
    q = {k: v.copy() for k, v in p.items()}
    lm.train_step(q, small, some, shape, 1.0)
    for name in p:
        at = (0,) * p[name].ndim if name != "inputs" else (0, int(small[0][3]), 2)
        up = {k: v.copy() for k, v in p.items()}
        up[name][at] += 1e-5
        slope = (lm.log_likelihoods(up, small, some, shape).mean() - lm.log_likelihoods(p, small, some, shape).mean()) / 1e-5
        assert abs((q[name][at] - p[name][at]) - slope) < 1e-3


def test_probabilities_sum_to_one():
    shape = lm.Shape(window=1, width=4, classes=3, members=4, own=6)
    p = shape.blank()
    around = np.repeat(np.array([[2], [5]], np.int32), shape.tokens, 1)
    assert abs(np.exp(lm.log_likelihoods(p, around, np.arange(shape.tokens), shape)).sum() - 1) < 1e-5


def test_scores_of_documents(spark):
    rng = random.Random(5)
    ordered = ["red green blue yellow " * 30 for _ in range(60)]
    mixed = [" ".join(rng.choice(["red", "green", "blue", "yellow"]) for _ in range(120)) for _ in range(12)]
    texts = ordered + mixed + ODD[:3] + ["red", "red"]
    out = {r.doc_id: r for r in lm.score(frame(spark, texts).repartition(2), rounds=6).collect()}
    assert np.mean([out[i].score for i in range(60)]) > np.mean([out[i].score for i in range(60, 72)]) + 0.3
    assert all((out[i].n_tokens, out[i].log_likelihood, out[i].score) == (0, 0.0, None) for i in (72, 73, 74))
    assert abs(out[75].score - out[76].score) < 1e-6 and out[0].n_tokens == 120
    assert lm.score(frame(spark, [])).count() == 0


def test_words_in_one_bucket_have_their_own_probability(spark, monkeypatch):
    """Texts that differ only in words of one bucket differ by the words' counts, whether a task holds the counts or they are joined."""
    shape = lm.Shape(classes=3, members=3, own=8)  # eight words with a token, one bucket
    counts = {"rare": 1, "seldom": 5, "often": 9, "é": 3}
    texts = [f"a b c {w} d e f g h" for w, n in counts.items() for _ in range(n)] + ["rare rare é a", None, "a b"]
    total = sum(counts.values()) + 3
    found = []
    for held in (1 << 16, 2, 1):
        monkeypatch.setattr(lm, "COUNTS_HELD", held)
        found.append({r.doc_id: r for r in lm.score(frame(spark, texts), shape=shape).collect()})
    for out in found:
        assert len(out) == len(texts) and (out[19].n_tokens, out[19].log_likelihood, out[19].score) == (0, 0.0, None)
        assert abs(out[1].log_likelihood - out[0].log_likelihood - np.log(5 / 3)) < 1e-4  # rare: 1 + 2
        assert abs(out[6].log_likelihood - out[15].log_likelihood - np.log(9 / 4)) < 1e-4  # e acute: 3 + 1
        assert all(abs(out[i].log_likelihood - found[0][i].log_likelihood) < 1e-9 for i in out)
    words = lm.counts(frame(spark, texts).select("text"))
    rare, logs = lm._in_buckets(words, lm.vocabulary(words, shape), shape)
    assert abs(logs[8] - np.log(total)) < 1e-9 and sorted(r.n for r in rare.collect()) == [3, 4, 5, 9]


def test_terms_far_from_the_value_are_found_at_every_place(spark):
    """A name in a heading, far from the address, and once more at the end, in whatever case; the address is a frequent one or not."""
    rng = random.Random(6)
    filler = lambda n: " ".join(rng.choice(["plain", "words", "every", "where", "other"]) for _ in range(n))
    secret = [f"Falkenhorst {filler(60)} k.f@mail.example.com {filler(60)} FALKENHORST, falkenhorst" for _ in range(3)]
    others = [f"{filler(12)} n{k}@mail.example.com" for k in range(30)] + [filler(10) + " \u0130zmir izmir"] + ["Brandt wrote to info@firm.example"] * 3
    docs = frame(spark, secret + others)
    out = {r.doc_id: r for r in pii.find(docs).collect()}
    for i, t in enumerate(secret):
        places = {m.start() for m in re.finditer("falkenhorst", t, re.I)}
        assert len(places) == 3 and places <= {s.start for s in out[i].spans if s.kind == 4} and places <= set(out[i].removed)
    assert not any(s.kind == 4 for i in range(3, 37) for s in out[i].spans)  # one text each, however often
    clear = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any("falkenhorst" in clear[i].lower() for i in range(3)) and clear[33] == (secret + others)[33]


def test_places_of_very_many_matches(spark):
    text = " \u00e9, ".join(["word", "more"] * 2000)
    got = spark.createDataFrame([(text,)], "text string").select(pii._found(F.col("text"), pii._WORD, 4).alias("s")).first().s
    assert [(w.start, w.end, w.value) for w in got] == [(m.start(), m.end(), m.group()) for m in re.finditer("[a-z]{3,}", text)]


def plain_log_likelihood(words, own, counts, p, shape):
    """Word by word, as the formula says: the class, the member in it, and the word's part of its bucket."""
    import xxhash

    buckets = shape.tokens - len(own)
    number = lambda w: xxhash.xxh64_intdigest(w.encode())
    signed = lambda w: number(w) - (number(w) >> 63 << 64)
    token = lambda w: own.index(signed(w)) if signed(w) in own else len(own) + number(w) % buckets
    share = Counter()
    for w, n in counts.items():
        share[token(w)] += n
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    line, total = [shape.tokens] * shape.window + [token(w) for w in words] + [shape.tokens] * shape.window, 0.0
    for i, w in enumerate(words, shape.window):
        around = line[i - shape.window : i] + line[i + 1 : i + 1 + shape.window]
        h = np.tanh(p["bias"] + sum(p["inputs"][k][t] for k, t in enumerate(around)))
        c, m = divmod(line[i], shape.members)
        total += np.log(softmax(h @ p["class_out"] + p["class_bias"])[c]) + np.log(softmax(h @ p["member_out"][c] + p["member_bias"][c])[m])
        if signed(w) not in own:
            total += np.log(counts[w] / share[line[i]])
    return total


def test_scores_are_the_plain_ones_however_the_table_is_split(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 700)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghij") + rng.choice(["", "x", "\u00e9"]) for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, ""]
    shape = lm.Shape(classes=4, members=5, own=12, width=6)
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, place int")
    found = [sorted((tuple(r) for r in lm.score(docs.repartition(n), shape=shape).collect()), key=repr) for n in (1, 8)]
    plain = lambda x: sorted(((r[0] is None, r[0] or 0, r[1], round(r[2], 3)) for r in x))
    assert len(found[0]) == len(texts)
    for a, b in zip(plain(found[0]), plain(found[1]), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 0.01
    rows = lm.id_text(docs)
    words = lm.counts(rows)
    own = lm.vocabulary(words, shape)
    rare, logs = lm._in_buckets(words, own, shape)
    counts = Counter(w for t in texts for w in (t or "").split())
    total = sum(counts.values())
    p = lm.train(lm.encoded(rows.repartition(3), own, rare, logs, shape, total, 4), shape, total)
    by_id = {r[0]: r[2] for r in found[0] if r[0] is not None}
    for i in (1, 2, 50, 70, 119):
        assert abs(by_id[i] - plain_log_likelihood(texts[i].split(), own, counts, p, shape)) < 0.01


def plain_terms(texts, disclosure=0.9, support=2):
    """Term spans by counting: for each entity in ``support`` texts and each word beside it, PMI / IC over all rows."""
    entities = [{(k, m.group()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m.group())} for t in texts]
    words = [[(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{3,}", t or "")] for t in texts]
    total, out = len(texts), [set() for _ in texts]
    spelled = [{w for k, v in es if k == "email" for w in re.findall(r"[^\W\d_]{3,}", v.split("@")[0].lower())} for es in entities]
    for t in {w for ws in spelled for w in ws}:
        rows = [i for i, ws in enumerate(spelled) if t in ws]
        often = sum(any(w == t for *_, w in ws) for ws in words)
        if len(rows) < total and np.log(total / often) / np.log(total / len(rows)) >= disclosure:
            for i in rows:
                base = [m.span() for k, p in PATTERNS.items() for m in re.finditer(p, texts[i]) if valid(k, m.group())]
                out[i] |= {(a, b) for a, b, w in words[i] if w == t and not any(x < b and a < y for x, y in base)}
    for e in {e for es in entities for e in es}:
        rows = [i for i, es in enumerate(entities) if e in es]
        if len({texts[i] for i in rows}) < support or len(rows) == total:
            continue
        for t in {w for i in rows for *_, w in words[i]}:
            both = [i for i in rows if any(w == t for *_, w in words[i])]
            often = sum(any(w == t for *_, w in ws) for ws in words)
            if len({texts[i] for i in both}) >= support and np.log(len(both) * total / (len(rows) * often)) / np.log(total / len(rows)) >= disclosure:
                for i in both:
                    base = [m.span() for k, p in PATTERNS.items() for m in re.finditer(p, texts[i]) if valid(k, m.group())]
                    out[i] |= {(a, b) for a, b, w in words[i] if w == t and not any(x < b and a < y for x, y in base)}
    return out


def test_term_spans_are_the_plain_ones(spark):
    rng = random.Random(9)
    pool = ["alpha", "Beta", "gamma", "delta", "\u00e9psilon", "zeta", "mail"]
    filler = lambda n: " ".join(rng.choice(pool) for _ in range(rng.randint(0, n)))
    mails, texts = [f"n{c}@mail.test" for c in "abcd"] + ["nameedna.7@mail.test", "alpha.x@mail.test", "Erich-NAMEGUN@mail.test", "beta@mail.test"] + ["10.0.0.7", "4111 1111 1111 1111"], []
    for k, mail in enumerate(mails):
        for _ in range(rng.randint(2, 4)):
            name = rng.choice([f"Name{'abcdefghij'[k]}", f"NAME{'abcdefghij'[k]}", "shared", ""])
            texts.append(f"{name}{rng.choice([' ', '', chr(233)])}{filler(6)} {rng.choice(['', name])} {mail}{rng.choice([' ', chr(233), ', '])}{filler(3)} {name}")
    texts += texts[:5] + [filler(12) for _ in range(80)] + [None, ""]
    want = plain_terms(texts)
    out = {r.doc_id: r for r in pii.find(frame(spark, texts)).collect()}
    assert sum(map(len, want)) > 5
    for i in range(len(texts)):
        assert {(s.start, s.end) for s in out[i].spans if s.kind == 4} == want[i], texts[i]


def test_planted_names_beside_single_values(spark):
    """Names that an address in the same text spells, each address in one text only: what is found, and what is wrongly marked."""
    rng = random.Random(21)
    syllables = ["an", "ther", "ing", "ou", "str", "ed", "el", "ich", "or", "mar", "ka", "lo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    name = lambda k: "".join("qxzvjkwy"[int(c)] + "ae"[int(c) % 2] for c in f"{k:03o}") + "son"
    planted = [(name(k), f"{prose(8)} {name(k).title()} {prose(20)} {name(k)}.{k}@mail.example {prose(9)} {name(k).upper()}, {prose(5)}") for k in range(60)]
    common = [f"{prose(12)} ther {prose(4)} ther.{k}@mail.example {prose(6)}" for k in range(40)]
    docs = [t for _, t in planted] + common + [prose(60) for _ in range(900)]
    out = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == 4} for r in pii.find(frame(spark, docs)).collect()}
    want = {i: {m.span() for m in re.finditer(n, t, re.I)} - {m.span(1) for m in re.finditer(rf"({n})\.\d+@", t)} for i, (n, t) in enumerate(planted)}
    found = sum(len(out[i] & want[i]) for i in want)
    assert found == sum(map(len, want.values())) == 120 and sum(map(len, out.values())) == found
    clear = {r.doc_id: r.text.lower() for r in pii.sanitise(frame(spark, docs)).collect()}
    assert not any(n in clear[i] for i, (n, _) in enumerate(planted)) and all("ther" in clear[60 + k] for k in range(40))


def test_very_many_spans_in_one_text(spark):
    """20,000 addresses in one text, twice: their places, and the text without them, within a minute."""
    import time

    text = " \u00e9, ".join(f"n{k}@m{k % 7}.test" for k in range(20000)) + " end"
    docs = frame(spark, [text, text + "s"])
    began = time.time()
    r = pii.counted(pii.find(docs)).where("doc_id = 0").first()
    assert r.n_email == 20000 and r.base_sha256 == hashlib.sha256(plain_spans(text).encode()).hexdigest()
    clean = pii.sanitise(docs).where("doc_id = 0").first().text
    assert clean == re.sub(r"n\d+@m\d\.test", "<email>", text)
    assert time.time() - began < 90
