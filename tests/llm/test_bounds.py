"""What goes to the driver is bounded whatever the partitions; the pipeline's stages with odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailmix.llm import common, ngram_join, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, found string, n_words long, component_id long, score double"


def test_lowest_rows_equal_a_sort(spark):
    df = spark.range(20_000).select(F.xxhash64("id").alias("h"), "id").repartition(40)
    wanted = [r["id"] for r in sorted(df.collect(), key=lambda r: (r["h"], r["id"]))]
    for n in (1, 500, 19_999, 30_000):
        got = common.lowest(df, "h", n, "lowest")
        assert sorted(r["id"] for r in got.collect()) == sorted(wanted[:n])
    same = spark.range(5000).select(F.lit(7).cast("long").alias("h"), "id")
    assert sorted(r["id"] for r in common.lowest(same, "h", 10, "lowest").collect()) == list(range(10))
    assert common.lowest(df.where("false"), "h", 10, "lowest").collect() == []
    assert common.lowest(df.withColumn("h", F.lit(None).cast("long")), "h", 10, "lowest").collect() == []


def test_frequent_tokens_are_whole_classes(spark):
    rows = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(None, 5)], "token long, n long")
    join = ngram_join.Join(spark.createDataFrame([], "doc_id long, text string"), frequent=40)
    tokens, ranks = join.frequent(rows)
    assert 10 < len(tokens) <= 40 and sorted(tokens.tolist()) == list(range(300 - len(tokens), 300))
    assert [r for _, r in sorted(zip(tokens.tolist(), ranks.tolist(), strict=True))] == list(range(len(tokens)))
    assert len(join.frequent(rows.where("token IS NULL"))[0]) == 0


@pytest.mark.parametrize("bound", [0, 100_000])
def test_scans_do_not_depend_on_the_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", bound)
    docs = spark.createDataFrame([(i, f"password = abcdefghijkl{i} and AKIA{'A' * 20}") for i in range(30)] + [(99, "clean"), (None, "token: abcdefghijklmnop"), (98, None)], "doc_id long, text string")
    assert sorted(len(r["found"]) for r in secrets.scan(docs).collect()) == [0, 0, 1] + [2] * 30


def odd_docs(spark):
    words = " ".join(f"w{k}" for k in range(120))
    rows = [(1, words), (1, words), (2, words + " more"), (3, None), (4, ""), (None, "a short text without an id"), (None, None), (5, "x" * 30_000), (6, "password = abcdefghijklmnop " + words), (-7, "the same line\n" * 50), (8, " \n\t")]
    return spark.createDataFrame([(i, t, None, None, None, "own", 3, 4, 0.5) for i, t in rows], DOCS)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    docs, sf_dir = odd_docs(spark), "/root/testdata/sf0.001"
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    else:
        assert out.columns == corpus_pipeline.COLUMNS and rows
        kept = [r["doc_id"] for r in rows]
        for i in (3, 4, 5, 8):  # null, empty, long and blank texts pass every filter
            assert i in kept, (name, i)
        assert kept.count(None) == 2
    assert stage(spark, docs.where("doc_id = 1000"), sf_dir).collect() == []
