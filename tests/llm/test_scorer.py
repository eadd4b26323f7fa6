"""Toxicity scores of a whole table against a plain version: counts, learnt features and score, without Spark."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trailmix.llm import toxicity

SF = "/root/testdata/sf0.01"
THRESHOLD, STRENGTH, LEAST, SHARE, PRECISION, STEMS = 0.3, 10.0, 6, 0.02, 0.7, 4


def plain_counts(texts):
    out = Counter()
    for t in texts:
        if t:
            classes = [toxicity.class_of(c) for c in f"  {t.lower()}  "]
            out.update(zip(classes, classes[1:], classes[2:], strict=False))
    return out


def learnt(labelled, words):
    """labelled: (text, toxic). Feature to probability."""
    copies = {}
    for text, toxic in labelled:
        key = (re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ").lower(), toxic)
        copies[key] = min((copies[key], text), key=lambda t: t.encode()) if key in copies else text
    seen, stems, rows = defaultdict(lambda: [0, 0]), defaultdict(set), [0, 0]
    for (_, toxic), text in copies.items():
        own = words.of(text)
        rows[toxic] += 1
        for f in own | {w[:k] + "*" for w in own for k in (4, 5, 6, 7, 8) if len(w) >= k}:
            seen[f][toxic] += 1
        if toxic:
            for w in own:
                for k in (4, 5, 6, 7, 8):
                    if len(w) >= k:
                        stems[w[:k] + "*"].add(w)
    base, least = rows[1] / max(1, sum(rows)), max(LEAST, SHARE * rows[1])
    out = {}
    for f, (good, bad) in seen.items():
        p = (bad + STRENGTH * base) / (good + bad + STRENGTH)
        decides = p >= THRESHOLD and bad >= PRECISION * (good + bad)
        if bad >= least and (decides or p > base) and (not f.endswith("*") or len(stems[f]) >= STEMS):
            out[f] = p if decides else min(p, 0.9 * THRESHOLD)
    return out


def score(text, words, known):
    each = [max((known.get(f, 0.0) for f in {w} | {w[:k] + "*" for k in (4, 5, 6, 7, 8) if len(w) >= k}), default=0.0) for w in words.of(text)]
    telling = [p for p in each if p >= THRESHOLD]
    if telling:
        return 1.0 - float(np.prod([1.0 - p for p in telling]))
    return 0.01 + 0.9 * (THRESHOLD - 0.01) * max(each, default=0.0) / THRESHOLD


def test_scores_of_a_table_equal_the_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            labels[r.doc_id] = max(r.toxic, labels.get(r.doc_id, 0))
    counts = toxicity.character_counts(spark.read.parquet(f"{SF}/documents.parquet"))
    plain = plain_counts(t for _, t in docs)
    assert int(counts.sum()) == sum(plain.values()) and all(counts.reshape(64, 64, 64)[k] == n for k, n in plain.items())
    words = toxicity.Words(toxicity.Channel(counts))
    known = learnt([(t, int(labels[i] > 0)) for i, t in docs if i in labels and t is not None], words)
    assert any(p >= THRESHOLD for p in known.values())
    got = {r.doc_id: r for r in toxicity.query(spark, SF).collect()}
    for i, t in docs:
        want = score(t, words, known)
        assert got[i].score == pytest.approx(want, abs=1e-12), i
        assert got[i].predicted == int(want >= THRESHOLD) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
