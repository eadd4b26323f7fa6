"""Substring dedup against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from trailmix.llm import shingling, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept_text", T.StringType()), T.StructField("key", T.StringType())])


def brute(rows):
    first, out = {}, []
    place = lambda i: -(1 << 63) if i is None else i
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            first[window] = min(first.get(window, (1 << 63, 0)), (place(i), k))
    for i, w in split:
        gone = {k + j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (place(i), k) for j in range(20)}
        out.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_against_brute_force(spark, monkeypatch, seed):
    draw = random.Random(seed)
    word = lambda: draw.choice(["é", "b", "cc", "\x1cd", "e.", "F"]) + str(draw.randrange(40))
    passages = [" ".join(word() for _ in range(n)) for n in (19, 20, 25, 60, 200)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(draw.randrange(60))) for _ in range(3)]
        for _ in range(draw.randrange(3)):
            parts.insert(draw.randrange(len(parts) + 1), draw.choice(passages))
        texts.append(draw.choice(["\n", " ", "\t\x0b "]).join(parts))
    texts += [texts[0], texts[0], "same " * 70, "a b " * 300, "", None, " \n", "x" * 90_000, texts[3][:-7]]
    rows = [(draw.randrange(40) if k % 9 == 0 else 100 + k if k % 7 else None if k == 14 else 3 * k, t) for k, t in enumerate(texts)]
    rows += rows[:2]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(5)
    got = substrings.deduplicated(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == brute(rows)
    assert got[0].key == "y" and substrings.deduplicated(docs.where("doc_id = -1")).count() == 0


def test_shards_keep_their_state_between_portions():
    text = b" ".join(b"w%d" % i for i in range(25))
    rows = [(d, 0, 0, 7, 6, text) for d in range(5)]
    want = [(d, 0, 0, 6) for d in range(1, 5)]
    shard = substrings.Shard()
    assert list(shard.resolve(rows)) == want
    shard = substrings.Shard()
    assert [x for r in rows for x in shard.resolve([r])] == want


def test_hashes_do_not_depend_on_place():
    a, b = shingling.Words(["p q r s t", "xx q r s"]), shingling.Words([None, "", "q r s"])
    assert a.bounds.tolist() == [0, 5, 9] and b.bounds.tolist() == [0, 0, 0, 3]
    assert shingling.grams(a.hashes, 3)[1] == shingling.grams(a.hashes, 3)[6] == shingling.grams(b.hashes, 3)[0]
    assert shingling.least_over(a.hashes, 4)[2] == a.hashes[2:6].min()
    assert a.text(0, 2) == b"p q" and len(set(shingling.grams(a.hashes, 2).tolist())) == 6


def test_equal_hashes_do_not_settle_windows(monkeypatch):
    """If all windows had one hash, those of other words would still not be removed by it."""
    draw = random.Random(5)
    passage = " ".join(f"p{draw.randrange(50)}" for _ in range(40))
    texts = [" ".join(f"a{draw.randrange(900)}" for _ in range(60)) + " " + passage, passage + " end", "x " + passage, " ".join(f"c{draw.randrange(900)}" for _ in range(30))]
    v = substrings.Windows(texts)
    v.hash = v.hash * 0
    order = list(range(len(texts)))
    rows = list(zip(*substrings.pieces(v, np.arange(len(v.at)), order, order), strict=True))
    settled = {(o, k) for o, _, lo, hi, _, _, words in rows if words is None for k in range(lo, hi)}
    first = {}
    for o, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (o, k))
    for o, k in settled:
        assert first[tuple(texts[o].split()[k : k + 20])] < (o, k)
    covered = {(o, k) for o, _, lo, hi, *_ in rows for k in range(lo, hi)}
    assert covered == {(o, k) for o, t in enumerate(texts) for k in range(len(t.split()) - 19)}
    # and with its own hashes every repeat within the texts is settled at once
    v = substrings.Windows(texts)
    rows = list(zip(*substrings.pieces(v, np.arange(len(v.at)), order, order), strict=True))
    settled = {(o, k) for o, _, lo, hi, _, _, words in rows if words is None for k in range(lo, hi)}
    assert settled == {(o, k) for o, t in enumerate(texts) for k in range(len(t.split()) - 19) if first[tuple(t.split()[k : k + 20])] < (o, k)}
