"""The pipeline's stages against plain versions of their work."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketframe.llm import minhash, quality
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    except Exception:
        pytest.skip("no test tables")
    found = [docs]
    for _, f in corpus_pipeline.STAGES:
        found.append(f(spark, found[-1], SF).cache())
        found[-1].count()
    return found


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "packing"]
    assert all(s.columns == corpus_pipeline.COLUMNS for s in stages[:4])


def test_quality_keeps_what_the_rules_keep(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality.judge(stages[0], quality.fit(stages[0], labels)).where("kept")
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(r.doc_id for r in kept.collect())


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    _, groups = brute(rows, 5, 80)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(groups.values()))
    assert minhash.near_duplicates(stages[2]).where("not kept").count() == 0


def test_no_personal_data_is_left(stages):
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(r.doc_id for r in stages[2].collect())
    assert stages[3].where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]")).count() == 0
    assert stages[3].where("n_chars <> length(text)").count() == 0


def test_all_documents_are_packed(spark, stages):
    out = stages[4]
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in stages[3].collect()}
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n > 2048 or n <> end").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == out.count()


def test_odd_rows_and_empty_tables(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, extra columns: each stage by itself, and all in a row."""
    prose = " ".join(f"{a}{b} {b}{a}ing" for a in ("the", "or", "wa", "li") for b in ("re", "st", "an", "mu", "ko", "be", "ri", "to"))
    texts = [None, "", " \n", prose, prose, f"{prose} more of it, written to Falken.7@mail.example by Falken", "long " * 40000 + prose]
    rows = [(i, t, None if i % 2 else "en", None, None, "x", i) for i, t in enumerate(texts)] + [(None, prose + " without an id", None, None, None, None, None)] + [(4, prose, "en", None, None, "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep string, id long")
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["quality_rules"](spark, docs, SF).collect()}
    assert not kept & {0, 1, 2}
    one = stages["near_duplicates"](spark, docs, SF)
    assert one.columns == corpus_pipeline.COLUMNS and sorted(str(r.doc_id) for r in one.collect()) == ["0", "1", "2", "3"]  # the rest are near copies of 3: the long one repeats one shingle
    clean = stages["personal_data"](spark, docs, SF).collect()
    by_id = {r.doc_id: r for r in clean}
    assert len(clean) == len(rows) and by_id[0].text is None and by_id[0].n_chars is None and (by_id[1].text, by_id[1].n_chars) == ("", 0)
    assert "<email>" in by_id[5].text and "alken" not in by_id[5].text and by_id[6].text == texts[6]
    pieces = stages["packing"](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r[0] for r in rows} and pieces.where("piece = 0").count() == len(rows)
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, SF)
        assert empty.count() == 0
