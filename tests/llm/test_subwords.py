"""The subword classifier: features and scores against plain ones, training on rows that are not held out, accuracy on those that are."""

import random
import zlib

import numpy as np

from marketframe.llm import subwords

KIND = "doc_id long, text string, score string, held_out int"
LABELS = "doc_id long, quality int, toxic int"


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    words = [b"a", "é".encode(), "straße".encode(), b"x" * 3000, b"\xed\xa0\x80", b"ab", b"</s>"]
    of, bucket = subwords.word_features(words, 1 << 16)
    for k, w in enumerate(words):
        alone = subwords.word_features([w], 1 << 16)[1]
        assert sorted(bucket[of == k]) == sorted(alone)
        n = len(w.decode("utf-8", "surrogatepass")) + 2
        assert len(alone) == 1 + sum(max(0, n - g + 1) for g in (3, 4, 5))
    assert not np.array_equal(subwords.word_features([b"abc"], 1 << 16)[1], subwords.word_features([b"abd"], 1 << 16)[1])


def test_a_score_is_the_softmax_of_the_average():
    rng = np.random.default_rng(0)
    model = subwords.SubwordModel(rng.standard_normal((1 << 10, 4)), rng.standard_normal((2, 4)))
    texts = [None, "", " \n", "one", "b b b a", "é ß\nlong " + "w " * 500]
    for text, got in zip(texts, subwords.WordWeights(model).scores(texts), strict=True):
        total, n = np.zeros(4), 0
        for word, times in subwords.counted_words(text).items():
            bucket = subwords.word_features([word], 1 << 10)[1]
            total, n = total + times * model.vectors[bucket].sum(0), n + times * len(bucket)
        logit = model.out @ (total / n)
        want = np.exp(logit[1]) / np.exp(logit).sum()
        assert abs(got - want) < 1e-9


def test_the_gradient_is_that_of_the_loss():
    texts, labels = [([b"ab", b"c"], [2, 1]), ([b"d"], [1])], np.array([1, 0])
    start = subwords.SubwordModel(np.random.default_rng(1).standard_normal((64, 3)), np.random.default_rng(2).standard_normal((2, 3)))

    def loss(vectors, out):
        total = 0.0
        for (words, times), y in zip(texts, labels, strict=True):
            bucket = np.concatenate([np.tile(subwords.word_features([w], 64)[1], t) for w, t in zip(words, times, strict=True)])
            logit = out @ vectors[bucket].mean(0)
            total -= logit[y] - np.log(np.exp(logit).sum())
        return total

    after = subwords.train(start, texts, labels, passes=1, rate=1.0)
    step, h = start.vectors - after.vectors, 1e-6
    for i, j in ((b, k) for b in range(64) for k in range(3)):
        up = start.vectors.copy()
        up[i, j] += h
        assert abs((loss(up, start.out) - loss(start.vectors, start.out)) / h - step[i, j]) < 1e-4
    for i, j in ((b, k) for b in range(2) for k in range(3)):
        up = start.out.copy()
        up[i, j] += h
        assert abs((loss(start.vectors, up) - loss(start.vectors, start.out)) / h - (start.out - after.out)[i, j]) < 1e-4


def corpus(n=400):
    rng = random.Random(2)
    syllables = ["an", "ther", "ing", "ou", "str", "ed", "el", "ich"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words, good = [word() for _ in range(rng.randint(30, 90))], rng.random() < 0.6
        if not good:
            kind = rng.randrange(3)
            words = [words[0]] * 60 if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w + rng.choice(["###", "%%%"]) for w in words]
        rows.append((i, " ".join(words), "", 0))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    got = subwords.score(spark.createDataFrame(rows, KIND), subwords.fit(spark.createDataFrame(rows, KIND), spark.createDataFrame(labels, LABELS))).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows] and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    truth = {i: q for i, q, _ in labels}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_only_text_and_allowed_labels_count(spark):
    """Labels of held-out rows, order, partitions and other columns change no score."""
    rows, labels = corpus(120)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1) for i, q, _ in labels]
    base = subwords.fit(spark.createDataFrame(rows, KIND), spark.createDataFrame(labels, LABELS), labelled_rows=60)
    other = subwords.fit(spark.createDataFrame(rows[::-1] + rows[:5], KIND).repartition(9), spark.createDataFrame(turned[::-1], LABELS), labelled_rows=60)
    assert np.array_equal(base.vectors, other.vectors) and np.array_equal(base.out, other.out)


def test_odd_rows(spark):
    rows, labels = corpus(60)
    model = subwords.fit(spark.createDataFrame(rows, KIND), spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0), (2, 0, 0), (2, 1, 0), (3, 7, 0), (99999, 1, 0)], LABELS))
    odd = [(None, None, "x", 1), (1, "", "x", 1), (1, " \n", "x", 1), (2, "w " * 50000 + "é", "", 0), (2, "a" * 200000, "", 0), (None, "one", None, None)]
    got = subwords.score(spark.createDataFrame(odd, KIND), model).collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 2, None] and got[0].score == got[1].score == got[2].score and not got[0].held_out
    assert all(np.isfinite(r.score) for r in got)
    assert subwords.score(spark.createDataFrame([], KIND), model).collect() == []
    for docs, labelled in (([], labels), (rows, [])):
        none = subwords.fit(spark.createDataFrame(docs, KIND), spark.createDataFrame(labelled, LABELS))
        assert [r.score for r in subwords.score(spark.createDataFrame(odd, KIND), none).collect()] == [0.5] * 6
