"""Top-k search and whitening against brute force, with odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from trailmix.llm import topk_search, whitening
from trailmix.llm.common import shipped

ROWS = "vec_id long, embedding array<float>, rank int, score string, x int"


def odd_rows() -> list[tuple]:
    random = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in random.integers(-3, 4, 6) / 64]) for i in range(130)]  # small whole numbers: many ties
    rows += [(i, rows[20][1]) for i in range(130, 190)]  # copies
    rows += [(7, rows[7][1]), (40, [0.5] * 6), (40, [0.25] * 6)]  # repeated ids
    rows += [(200, None), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [float("nan")] + [0.0] * 5), (260, [float("inf")] + [0.0] * 5)]
    rows += [(280, []), (281, []), (300, [1.0, 2.0]), (301, [-2.0, 3.0]), (320, [5.0]), (None, [1.0] * 6), (-20, [-0.001] * 6)]
    rows += [(340, [3e38] * 6), (341, [1e30, 0.0, 0.0, 0.0, 0.0, 1.0]), (342, [1e6] * 6)]
    return [(i, v, 1, "own", 2) for i, v in rows]


def brute_top(rows: list[tuple], k: int) -> set[tuple]:
    whole = [
        (r[0], [math.floor(64 * x) for x in np.array(r[1], np.float32).astype(float).tolist()])
        for r in rows
        if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])
    ]
    asked: dict[int, list[int]] = {}
    for i, v in whole:
        if i % 20 == 0:
            asked[i] = min(v, asked.get(i, v))
    found = set()
    for i, v in asked.items():
        scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j) for j, w in whole if j != i and len(w) == len(v)]
        scores.sort(key=lambda s: (-s[0], s[1]))
        found |= {(i, n + 1, j, s) for n, (s, j) in enumerate(scores[:k])}
    return found


@pytest.mark.parametrize("sizes", [{}, {"query_rows": 3, "shard_rows": 7, "group_rows": 14, "tiles": 40, "fan_in": 2}])
@pytest.mark.parametrize("k", [1, 20, 1000])
def test_top_lists_equal_brute_force(spark, sizes, k):
    shipped(spark)
    rows = odd_rows()
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = [tuple(r) for r in topk_search.top_k(df, df.where("vec_id % 20 = 0"), k, **sizes).collect()]
    assert set(got) == brute_top(rows, k)
    assert len(got) >= len(set(got))


def test_top_lists_of_empty_tables(spark):
    shipped(spark)
    df = spark.createDataFrame([], ROWS)
    assert topk_search.top_k(df, df).collect() == []
    one = spark.createDataFrame([(20, [1.0], 1, "a", 1)], ROWS)
    assert topk_search.top_k(one, one).collect() == []


def test_products_are_exact_at_any_size():
    a = np.array([[2**31 - 1, -(2**31) + 1]], np.int32)
    assert topk_search.products(a, a)[0, 0] == 2 * (2**31 - 1) ** 2
    big = np.array([[1e30, 1.0]])
    assert topk_search.products(big, np.array([[-1e30, 5.0]]))[0, 0] == -(2**63)
    assert topk_search.products(big, np.array([[0.0, 5.0]]))[0, 0] == 5


def test_selection_takes_the_first_of_equals():
    scores = np.array([[1, 5, 5, 5, 2], [9, 0, 0, 0, 0]], np.float32)
    own = np.array([[False, True, False, False, False], [False] * 5])
    line, column = topk_search.chosen(scores, own, 2)
    assert list(zip(line.tolist(), column.tolist(), strict=True)) == [(0, 2), (0, 3), (1, 0), (1, 1)]


def exact_covariance(x: list[tuple]) -> np.ndarray:
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    dev = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    return np.array([[float(Fraction(sum(r[a] * r[b] for r in dev), n**3)) for b in range(d)] for a in range(d)])


def brute_white(vectors: list[list[float]]) -> tuple[list[int], np.ndarray, np.ndarray, float, int]:
    x = [tuple(math.floor(256 * c) for c in np.array(v, np.float32).astype(float).tolist()) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    values, axes = np.linalg.eigh(exact_covariance(fit))
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums, strict=True)] for r in x])
    return deviation, centred @ axes / np.sqrt(values), values, float(values.sum()), n


def test_whitening_equals_exact_moments(spark):
    shipped(spark)
    random = np.random.default_rng(5)
    base = (random.normal(size=(150, 5)) * [3, 2, 1, 0.5, 0.1] + 2).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(base)] + [(i, base[3]) for i in range(150, 260)] + [(3, base[3]), (None, base[4])]
    odd = [(400, None), (401, [None] * 5), (402, [float("nan")] * 5), (403, [float("-inf")] * 5), (404, []), (405, [1.0])]
    df = spark.createDataFrame([(i, v, 1, "a", 1) for i, v in rows + odd], ROWS).repartition(7)
    got = whitening.whitened(df).toPandas()
    deviation, white, values, trace, n = brute_white([v for _, v in rows])
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n}
    sign = {}
    for i, v in enumerate(rows):
        mine = got[got["vec_id"].isna()] if v[0] is None else got[got["vec_id"] == v[0]]
        assert set(mine["deviation"]) == {deviation[i]}
        for c in range(1, 5):
            for w in mine.loc[mine["component"] == c, "whitened"]:
                s = sign.setdefault(c, np.sign(w * white[i, c - 1]))
                assert w == pytest.approx(s * white[i, c - 1], rel=1e-9, abs=1e-9)
    for c in range(1, 5):
        assert got.loc[got["component"] == c, "explained"].unique() == pytest.approx([values[c - 1] / trace], rel=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_without_variance(spark):
    shipped(spark)
    assert whitening.whitened(spark.createDataFrame([], ROWS)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "a", 1) for i in range(3)], ROWS)
    got = whitening.whitened(same).collect()
    assert len(got) == 6
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, None, None)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 1, "a", 1) for i in range(5)], ROWS)
    got = whitening.whitened(line).collect()
    assert {r["whitened"] is None for r in got if r["component"] == 2} == {True}
    assert got[0]["explained"] in (pytest.approx(1.0), pytest.approx(0.0, abs=1e-12)) and got[0]["identity_error"] < 1e-9
    huge = spark.createDataFrame([(i, [float(i) * 1e12, 1.0], 1, "a", 1) for i in range(3)], ROWS)
    assert {r["deviation"] for r in whitening.whitened(huge).collect()} == {0, None}


def test_merged_states_equal_one_pass():
    random = np.random.default_rng(1)
    rows = random.integers(-900, 900, (300, 4)) + 10**6
    whole, parts = whitening.Moments.empty(4), [whitening.Moments.empty(4) for _ in range(5)]
    whole.add(rows)
    for p, some in zip(parts, np.split(rows, [0, 1, 100, 250]), strict=True):
        p.add(some)
        parts[0].merge(p) if p is not parts[0] else None
    assert parts[0].n == 300 and parts[0].sums == whole.sums == rows.sum(axis=0).tolist()
    exact = exact_covariance([tuple(r) for r in rows.tolist()])
    for state in (whole, parts[0]):
        assert state.scatter / 300 == pytest.approx(exact, rel=1e-10)


@pytest.mark.parametrize("width", [1, 2, 3, 17, 64])
def test_qr_solves_symmetric_matrices(width):
    random = np.random.default_rng(width)
    for a in (random.normal(size=(width, width)), np.zeros((width, width)), np.ones((width, width)), np.diag(np.arange(width) % 3 * 1.0)):
        a = a + a.T
        values, axes = whitening.symmetric_qr(a)
        size = max(1.0, np.abs(a).max())
        assert values == pytest.approx(np.linalg.eigvalsh(a)[::-1], abs=1e-12 * size * width)
        assert axes.T @ axes == pytest.approx(np.eye(width), abs=1e-12)
        assert a @ axes == pytest.approx(axes * values, abs=1e-12 * size * width)
