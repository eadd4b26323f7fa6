"""Quality rules and toxicity."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from trailmix.llm import quality, toxicity

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(repeated)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c a b c", "x x x x", "a\n a\na\n\n\na", "é b # $\x0bc\x1cd", "#\n#\n", "a b " * 3000])
def test_counts_of_odd_texts(text):
    assert quality.statistics(text)[0] == brute_counts(text)


def test_many_kinds_of_words_are_counted_exactly():
    ids = np.array([1, 2, 3, 5, 1, 2, 3, 4])
    assert quality.repeated_words(ids, (1 << 21) + 1) == 6 == quality.repeated_words(ids, 6)


def test_quality_on_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = quality.query(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r.kept, good[r.doc_id]) for r in rows if r.doc_id in good and not r.base_failed]
    assert np.mean([k for k, q in judged if q == 1]) > 0.98
    assert np.mean([k for k, q in judged if q == 0]) < 0.1


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("kept", T.StringType())])
LABELS = "doc_id long, quality int, toxic int"


def test_quality_without_labels_and_of_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "w " * 60, "a", "b"), (1, "w " * 60, "a", "b"), (None, None, None, None), (2, " ".join(f"w{i}" for i in range(60)), "", "")], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    got = {(r.doc_id, r.base_failed, r.kept) for r in quality.quality(docs, none).collect()}
    assert got == {(1, True, False), (None, True, False), (2, False, True)}
    assert quality.quality(docs.where("doc_id > 5"), none).count() == 0


def test_the_forest_draws_rows_whatever_their_statistics(spark, monkeypatch):
    usual = " ".join(f"{a}{b}ord" for a in "abcdefgh" for b in "abcdefgh")
    docs = spark.createDataFrame([(None if i % 5 == 0 else i, usual + (f" text{i}" if i % 2 else " " + "7" * (100 + i)), "", "") for i in range(3000)], SCHEMA)
    fitted, make = [], quality.IsolationForest.__init__

    def kept(self, rows, *rest):
        fitted.append(rows)
        make(self, rows, *rest)

    monkeypatch.setattr(quality.IsolationForest, "__init__", kept)
    for parts in (2, 5):
        assert quality.quality(docs.repartition(parts), spark.createDataFrame([], LABELS), trees=16, sample=16).count() == 3000
    assert len(fitted[0]) == 256 and (fitted[0] == fitted[1]).all()
    assert 0.4 < (fitted[0].sum(axis=1) == 0).mean() < 0.6
    assert len({r.tobytes() for r in fitted[0]}) > 100


def test_toxicity_on_documents(spark):
    rows = toxicity.query(spark, "/root/testdata/sf0.1").collect()
    marks = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(r.score, r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    hit = [p for _, p, t in held if t == 1]
    false = [p for _, p, t in held if t == 0]
    assert np.mean(hit) > 0.85 and np.mean(false) < 0.02


def test_only_copies_count_once_as_evidence(spark):
    """Texts that share most words are told apart; of copies one counts, in rows and in the base rate."""
    said = "the same few words stand in each of these"
    bad = [(i, f"{said} rows{i} idiot") for i in range(0, 40, 2)] + [(i, "A  Much copied\nrant" if i % 4 else "a much copied rant") for i in range(40, 80, 2)]
    good = [(i, f"{said} rows{i} here") for i in range(1, 200, 2)]
    docs = spark.createDataFrame([(i, t, "s", "k") for i, t in bad + good], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i, _ in bad + good], LABELS).select("doc_id", "toxic")
    channel = spark.sparkContext.broadcast(toxicity.Channel(toxicity.character_counts(docs)))
    known = toxicity.learnt(docs, labels, channel, 20_000, 10.0, 6, 0.02, 0.3, 0.7, 20_000, 4)
    assert known["idiot"] == pytest.approx((20 + 10 * 21 / 121) / 30)
    assert not {"much", "copied", "rant"} & set(known)
    assert all(known.get(w, 0) < 0.3 for w in said.split())


def test_scores_are_graded():
    assert toxicity.document_score([], 0.3) == 0.01
    assert 0.01 < toxicity.document_score([0.1], 0.3) < toxicity.document_score([0.1, 0.25], 0.3) < 0.3
    assert toxicity.document_score([0.1, 0.6, 0.5], 0.3) == pytest.approx(1 - 0.4 * 0.5)


def test_likeliest_path_against_all_paths(spark):
    """The Viterbi search against every path of the lattice."""
    import itertools

    channel = toxicity.Channel(toxicity.character_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    for token in ("1di0t", "stuuuupid", "5cum!", "m0r0n", "$1lly", "l33t"):
        lattice = channel.lattice(token)
        costs = []
        for path in itertools.product(*lattice):
            text, total, x, y = "".join(t for t, _ in path) + " ", sum(c for _, c in path), 0, 0
            for c in text:
                z = toxicity.class_of(c)
                total += channel.cost[x, y, z]
                x, y = y, z
            costs.append((total, text[:-1]))
        least = min(c for c, _ in costs)
        cost, text = channel.likeliest(lattice)
        assert cost == pytest.approx(least) and any(t == text and c == pytest.approx(least) for c, t in costs)


def test_obfuscated_words_are_restored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    channel = toxicity.Channel(toxicity.character_counts(docs))
    assert channel.restored("stuuuupid!!") == "stupid"
    assert channel.restored("1di0t") == "idiot"
    assert channel.restored("5cum") == "scum"
    assert channel.despaced("so m o r o n it is") == ["moron"]
    assert channel.restored("Word,") == "word"


def test_boundaries_in_spaced_words_are_chosen(spark):
    channel = toxicity.Channel(toxicity.character_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    for text, want in {
        "he is a m o r o n": {"a", "moron"},
        "you s t u p i d m o r o n": {"stupid", "moron"},
        "s-t-u-p-i-d m-o-r-o-n": {"stupid", "moron"},
        "an s.t.u.p.i.d one": {"stupid"},
        "M  o  r  o  n": {"moron"},
        "m\no\nr\no\nn": {"moron"},
        "s c u m!": {"scum"},
        "5 t u u u u p 1 d !": {"stupid"},
    }.items():
        assert set(channel.despaced(text)) >= want, text
    assert channel.despaced("or d i e now") == ["die"]
    assert channel.despaced("1 2 3 4 and 5.6.7 or x y") == []
    assert channel.restored("@$$") == "ass" and channel.restored("1990") == "1990"


def test_toxicity_of_odd_rows(spark):
    bad = [(i, f"plain text {i} idiot") for i in range(0, 60, 2)]
    good = [(i, f"plain text {i} here") for i in range(1, 60, 2)]
    odd = [(None, None), (101, ""), (102, "1d10t " * 3000), (103, "x" * 50_000), (103, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, "s", "k") for i, t in bad + good + odd], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in good] + [(None, 1, 1), (1, 1, None)], LABELS)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(docs.collect()) and set(got[0].asDict()) == {"doc_id", "text", "score", "kept", "held_out", "predicted"}
    assert {r.doc_id for r in got if r.predicted} >= {i for i, _ in bad}
    assert not {r.doc_id for r in got if r.predicted} & ({i for i, _ in good} | {None, 101, 103})
    assert not any(r.predicted for r in toxicity.toxicity(docs, labels.where("toxic > 5")).collect())
    assert toxicity.toxicity(docs.where("doc_id = -1"), labels).count() == 0
