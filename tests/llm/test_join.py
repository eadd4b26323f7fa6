"""N-gram Jaccard join against brute force."""

import random
import re

import pytest
from pyspark.sql import types as T

from trailmix.llm import components, ngram_join

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("class", T.StringType()), T.StructField("n", T.StringType())])


def brute(rows, percent=85, size=4):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    draw = random.Random(seed)
    texts = []
    common = " ".join(f"c{i}" for i in range(40))
    for _ in range(12):
        base = [f"w{draw.randrange(300)}" for _ in range(draw.choice([3, 5, 30, 120, 400]))]
        for _ in range(draw.randrange(1, 8)):
            copy = list(base)
            for _ in range(draw.randrange(1 + len(copy) // 40)):
                copy[draw.randrange(len(copy))] = "E" + str(draw.randrange(50))
            texts.append(" ".join(copy) + (" " + common if draw.random() < 0.4 else ""))
    texts += [texts[0].upper(), texts[1], "", None, "  \n", "One two", "one  TWO", "É a b c d", "é a b c d", "z " * 40_000, "q" * 70_000]
    rows = [(draw.randrange(50) if draw.random() < 0.2 else None if k == 3 else 100 + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(4)
    got = ngram_join.linked(docs, 85, 4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    assert ngram_join.linked(docs.where("doc_id = -5")).count() == 0


def family(draw, copies, words, most, near=0):
    """Copies of one text with up to ``most`` words replaced, left out or doubled; ``near`` of them again copied with few edits."""
    base = [f"w{draw.randrange(5000)}" for _ in range(words)]
    made = [list(base)]
    for _ in range(copies):
        source = base if not near or len(made) <= near or draw.random() < 0.6 else made[draw.randrange(1, near + 1)]
        copy = list(source)
        for _ in range(draw.randrange(most)):
            at = draw.randrange(len(copy))
            copy[at : at + 1] = draw.choice([["n" + str(draw.randrange(200))], [], [copy[at]] * 2])
        made.append(copy)
    return [" ".join(c) for c in made]


def test_large_family_of_near_copies(spark, monkeypatch):
    draw = random.Random(8)
    rows = list(enumerate([*family(draw, 300, 120, 12, near=6), *family(draw, 60, 40, 5), *family(draw, 40, 400, 40, near=3)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    met = []
    verified = ngram_join.Join.verified
    monkeypatch.setattr(ngram_join.Join, "verified", lambda self, sets, pairs: met.append(pairs.count()) or verified(self, sets, pairs))
    for block in (ngram_join.BLOCK, 50):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        for percent, size in ((85, 4), (80, 5)):
            got = ngram_join.linked(docs, percent, size).collect()
            assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, percent, size)
    assert met[0] < 1000  # of some 80,000 pairs


def test_further_orders_filter_before_sets_meet(spark):
    draw = random.Random(3)
    common = [f"c{i}" for i in range(8)]
    rows = [(i, " ".join([f"u{i}_{k}" for k in range(40)] + common + [f"v{i}_{k}" for k in range(40)])) for i in range(30)]
    rows += [(100 + i, " ".join(f"x{k}" if k != i else "edit" for k in range(90))) for i in range(3)]
    draw.shuffle(rows)
    join = ngram_join.Join(spark.createDataFrame(rows, "doc_id long, text string"), 85, 4)
    described = join.described_rows()
    sets = described.where("tokens IS NOT NULL").select("class", "n", "tokens")
    names = {r["class"]: r.doc_id for r in described.where("token IS NULL").collect()}
    classes = sorted(names)
    pairs = spark.createDataFrame([(a, b) for a in classes for b in classes if a < b], "a long, b long")
    left = {frozenset((names[r.a], names[r.b])) for r in join.supported(sets, pairs, 1).collect()}
    assert {frozenset(p) for p in ((100, 101), (100, 102), (101, 102))} <= left and len(left) < 0.7 * pairs.count()


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 100: 90}


def test_sketches_and_sizes():
    import numpy as np

    draw = np.random.default_rng(5)
    for n, m in ((3, 3), (500, 700), (40, 3000)):
        x, y = (np.unique(draw.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, m))
        y = np.union1d(x[: n // 2], y)
        found = ngram_join.differing(ngram_join.sketch(x), ngram_join.sketch(y))
        assert found <= len(np.setxor1d(x, y)) and found == ngram_join.differing(ngram_join.sketch(y), ngram_join.sketch(x))
    groups = np.array([0, 0, 0, 1, 2, 2])
    assert ngram_join.like_size(groups, np.array([100, 117, 118, 10, 5, 6]), 85).tolist() == [2, 3, 3, 4, 5, 6]
    assert ngram_join.windows(groups, np.array([100, 117, 118, 10, 5, 6]), 85).tolist() == [0, 2, 3, 4, 5]
