"""Importance resampling against a plain version of its definition."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trailmix.llm import resampling
from trailmix.llm.common import shipped, stored

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text: str | None, buckets: int) -> tuple[int, list[int]]:
    words = WORD.findall((text or "").translate(LOWER))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain(docs: list[tuple], target: list[str | None], percent: int, min_words: int, buckets: int, seed: int) -> list[tuple]:
    source, goal = Counter(), Counter()
    for _, text in docs:
        source.update(features(text, buckets)[1])
    for text in target:
        goal.update(features(text, buckets)[1])
    s, t = sum(source.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, found = features(text, buckets)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, n, len(found), weight, score, None])
    able = sorted((r for r in rows if r[1] >= min_words and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return rows


def made_docs() -> list[tuple]:
    random = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)] + ["Häuser", "ÉTÉ", "straße", "a1b2", "日本語", "don't", "x-y"]
    docs = [(int(i), " ".join(random.choice(words, random.integers(1, 60)))) for i in range(300)]
    docs += [(i, docs[5][1] + " " + docs[6][1]) for i in range(300, 420)]  # copies of one text
    docs += [(421, "w1 w2 " * 20)] * 40  # a repeated row
    return docs + [(430, None), (431, ""), (432, "!!! \n\t"), (None, "w1 " * 30), (None, None), (433, "w3 W4\x00w5\x7f" * 20_000)]


@pytest.mark.parametrize("percent, min_words", [(25, 20), (100, 1), (0, 20), (25, 10**9)])
def test_ranks_and_weights_equal_the_definition(spark, percent, min_words):
    shipped(spark)
    docs, target = made_docs(), ["w1 w2 w3", "Häuser w7 W7 été", None, ""]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, rank int, score int, _row string").repartition(5)
    other = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(df, other, percent, min_words, buckets=500)
    shown = [tuple(r) for r in got.collect()]
    wanted = plain(docs, target, percent, min_words, 500, 7)
    assert sorted((r[:5] for r in shown), key=repr) == sorted((tuple(r[:5]) for r in wanted), key=repr)
    assert sorted((r[5], r[0], r[4]) for r in shown if r[5]) == [(r[5], r[0], r[4]) for r in sorted((r for r in wanted if r[5]), key=lambda r: r[5])]
    assert len(shown) == len(docs)


def test_drawn_documents_keep_their_columns(spark):
    shipped(spark)
    docs = made_docs()
    df = spark.createDataFrame([(i, t, "kept") for i, t in docs], "doc_id long, text string, note string")
    found = resampling.resampled(df, df)
    out = resampling.drawn(df, found).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in found.collect() if r["rank"]}
    assert {r["note"] for r in out} == {"kept"}


def test_csr_blocks_hold_every_feature(spark):
    shipped(spark)
    docs = made_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    counted = Counter()
    for r in resampling.count_matrix(df, 97).collect():
        columns, counts = np.frombuffer(r["columns"], "<u4"), np.frombuffer(r["counts"], "<u4")
        assert r["starts"][-1] == len(columns) == len(counts)
        for k, i in enumerate(r["ids"]):
            some = slice(r["starts"][k], r["starts"][k + 1])
            assert r["n_features"][k] == counts[some].sum()
            counted[(i, *sorted(zip(columns[some].tolist(), counts[some].tolist(), strict=True)))] += 1
    assert counted == Counter((i, *sorted(Counter(features(t, 97)[1]).items())) for i, t in docs)
    sums = resampling.column_sums(resampling.count_matrix(df, 97), 97)
    assert sums.tolist() == [sum(features(t, 97)[1].count(b) for _, t in docs) for b in range(97)]


def test_empty_tables(spark):
    shipped(spark)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resampled(none, none).collect() == []
    docs = spark.createDataFrame([(1, "a " * 40), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in resampling.resampled(docs, none, percent=100).collect()}
    assert got[1]["rank"] == 1 and got[2]["rank"] is None and got[2]["weight"] == 0


def test_blocks_of_counts_and_their_row_groups_are_small(spark):
    """A reader holds a row group's rows at once: at 6 GB, blocks of 2 MB in row groups of 128 MB took an executor's memory."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: F.sha2((x * 1_000 + F.col("id")).cast("string"), 256)))
    docs = spark.range(0, 900, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    kept = stored(resampling.count_matrix(docs), "counts", 1 << 20)
    assert kept.agg(F.max(F.length("columns") + F.length("counts"))).first()[0] <= 8 * (resampling.BLOCK_ENTRIES + 10_000) <= 256 << 10
    assert kept.agg(F.sum(F.size("ids"))).first()[0] == 900
    groups = [g for path in kept.inputFiles() for f in [pq.ParquetFile(path.removeprefix("file://")).metadata] for g in (f.row_group(i) for i in range(f.num_row_groups))]
    assert len(groups) > 1 and max(g.total_byte_size for g in groups) <= 32 << 20
