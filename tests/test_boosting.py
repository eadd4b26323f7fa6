"""The listwise ranker and its explanations against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmix.operators import boosting, shap
from trailmix.operators.boosting import Settings, Spec, Trainer

OBJECTIVES = ["clicks", "carts"]
NAMES = ["told", "half", "noise", "flat"]


def brute_lambdas(scores, labels, truncation):
    """One query, pair by pair."""
    n = len(scores)
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    g, h, total = [0.0] * n, [0.0] * n, 0.0
    positive = sum(labels)
    if not 0 < positive < n:
        return g, h
    ideal = sum(1 / math.log2(k + 2) for k in range(min(positive, truncation)))
    for a, b in itertools.combinations(range(n), 2):
        i, j = order[a], order[b]
        if a >= truncation or labels[i] == labels[j]:
            continue
        high, low = (i, j) if labels[i] else (j, i)
        gap = scores[high] - scores[low]
        change = abs(1 / math.log2(a + 2) - 1 / math.log2(b + 2)) / ideal
        if scores[order[0]] != scores[order[-1]]:
            change /= 0.01 + abs(gap)
        p = 1 / (1 + math.exp(gap))
        g[high] -= change * p
        g[low] += change * p
        for k in (high, low):
            h[k] += change * p * (1 - p)
        total += 2 * change * p
    factor = math.log2(1 + total) / total if total > 0 else 1
    return [x * factor for x in g], [x * factor for x in h]


def test_lambdas_equal_pairs_one_by_one():
    random = np.random.default_rng(2)
    sizes = np.array([1, 2, 3, 40, 7, 33, 5, 5])
    labels = random.integers(0, 2, sizes.sum()) * random.integers(0, 2, sizes.sum())
    for scores in (np.zeros(sizes.sum()), random.normal(size=sizes.sum()), random.integers(0, 3, sizes.sum()) * 1.0):
        for truncation in (1, 5, 25):
            g, h = boosting.lambdas(scores, labels, sizes, truncation)
            at = 0
            for n in sizes:
                wanted = brute_lambdas(scores[at : at + n].tolist(), labels[at : at + n].tolist(), truncation)
                assert g[at : at + n] == pytest.approx(wanted[0], abs=1e-12) and h[at : at + n] == pytest.approx(wanted[1], abs=1e-12)
                at += n
    assert len(boosting.lambdas(np.zeros(0), np.zeros(0), np.zeros(0, int), 5)[0]) == 0


def rows_of(spark, seed: int, sessions: int = 60):
    random = np.random.default_rng(seed)
    rows = []
    for s in range(sessions):
        n = int(random.integers(3, 12))
        best = random.integers(0, n)
        for a in range(n):
            y = int(a == best)
            rows.append((s, a * 10, a + 1, float(np.round(y + random.normal() * 0.4, 3)), float(random.integers(0, 4) + y), float(np.round(random.normal(), 2)), 1.0, y, int(random.random() < 0.3)))
    return spark.createDataFrame(rows, "session long, aid long, candidate_position long, told double, half double, noise double, flat double, target_clicks int, target_carts int")


def trainer(spark, settings, specs, folder=None, parts=3):
    fit, selection = rows_of(spark, 1).repartition(parts), rows_of(spark, 2).repartition(parts)
    limits = boosting.thresholds(fit, NAMES, settings.bins)
    packed = [boosting.blocks(df, NAMES, limits, OBJECTIVES, 64) for df in (fit, selection)]
    asked = {o: int(selection.agg(F.sum(f"target_{o}")).first()[0]) for o in OBJECTIVES}
    return Trainer(*packed, NAMES, limits, OBJECTIVES, specs, asked, settings, folder), fit, selection


def test_first_split_equals_brute_force(spark):
    settings = Settings(rounds=1, leaves=2, rate=0.1, least_rows=10, bins=32)
    made, fit, _ = trainer(spark, settings, [Spec("m", "clicks", tuple(NAMES))])
    tree = made.run()["m"].trees[0]
    rows = fit.orderBy("session", "candidate_position").toPandas()
    sizes = rows.groupby("session").size().to_numpy()
    g, h = boosting.lambdas(np.zeros(len(rows)), rows["target_clicks"].to_numpy(), sizes, settings.truncation)
    best = None
    for i, f in enumerate(NAMES):
        for limit in made.limits[i]:
            left = (rows[f] <= limit).to_numpy()
            if min(left.sum(), (~left).sum()) < settings.least_rows:
                continue
            gain = sum(g[m].sum() ** 2 / h[m].sum() for m in (left, ~left)) - g.sum() ** 2 / h.sum()
            if best is None or gain > best[0] + 1e-9:
                best = (gain, i, limit, left)
    assert (tree.feature[0], tree.threshold[0]) == (best[1], best[2]) and tree.gain[0] == pytest.approx(best[0], rel=1e-6)
    for node, mask in ((tree.left[0], best[3]), (tree.right[0], ~best[3])):
        assert tree.value[node] == pytest.approx(-0.1 * g[mask].sum() / h[mask].sum(), rel=1e-6) and tree.cover[node] == mask.sum()


def plain_growth(codes, g, h, settings):
    """Best-first growth without any of the passes: the leaves' rows as sets."""
    g, h = np.rint(g * boosting.FIXED), np.rint(h * boosting.FIXED)

    def cut(mask):
        best = None
        for f in range(codes.shape[1]):
            sums = np.array([np.bincount(codes[mask, f], w[mask], settings.bins) for w in (g, h, np.ones(len(g)))]).astype(np.int64)
            found = boosting.best_split(sums, settings)
            if found and (best is None or found[1] > best[2]):
                best = (f, found[0], found[1])
        return best

    leaves = [np.ones(len(g), bool)]
    while len(leaves) < settings.leaves:
        cuts = [(c[2], -k, c) for k, m in enumerate(leaves) if (c := cut(m))]
        if not cuts:
            break
        _, k, (f, b, _) = max(cuts)
        whole = leaves.pop(-k)
        left = codes[:, f] <= b
        leaves += [whole & left, whole & ~left]
    return {tuple(np.flatnonzero(m)) for m in leaves}


@pytest.mark.parametrize("leaves", [3, 6, 31])
def test_lockstep_growth_is_best_first(spark, leaves):
    settings = Settings(rounds=1, leaves=leaves, rate=0.1, least_rows=8, bins=32)
    specs = [Spec("a", "clicks", tuple(NAMES)), Spec("b", "carts", ("noise", "half"))]
    made, fit, _ = trainer(spark, settings, specs)
    found = made.run()
    rows = fit.orderBy("session", "candidate_position").toPandas()
    sizes = rows.groupby("session").size().to_numpy()
    for s in specs:
        codes = np.column_stack([np.searchsorted(made.limits[NAMES.index(f)], rows[f], "left") for f in s.features])
        g, h = boosting.lambdas(np.zeros(len(rows)), rows[f"target_{s.objective}"].to_numpy(), sizes, settings.truncation)
        tree = found[s.name].trees[0]
        ends = tree.leaves(rows[list(s.features)].to_numpy(), tree.threshold)
        assert {tuple(np.flatnonzero(ends == n)) for n in np.unique(ends)} == plain_growth(codes, g, h, settings)


def test_rounds_are_chosen_on_selection(spark, tmp_path):
    settings = Settings(rounds=12, leaves=4, rate=0.3, least_rows=10, bins=32, interval=3, patience=4, top=1)
    specs = [Spec("c", "clicks", tuple(NAMES)), Spec("n", "clicks", ("noise",))]
    made, _, selection = trainer(spark, settings, specs, str(tmp_path))
    found = made.run()
    assert found["c"].recall > 0.6 > found["n"].recall and found["c"].importance()["told"] > found["c"].importance()["noise"]
    # the first evaluated round of the highest recall, by another way to count
    rows = selection.toPandas()
    tried = {}
    for rounds in (1, 3, 6, 9, 12):
        if rounds <= len(found["c"].trees):
            model = boosting.Ensemble(NAMES, found["c"].trees, rounds)
            rows["score"] = model.margins(rows[NAMES].to_numpy())
            top = rows.sort_values(["session", "score", "aid"], ascending=[True, False, True]).groupby("session").head(1)
            tried[rounds] = top["target_clicks"].sum() / rows["target_clicks"].sum()
    assert found["c"].best == min(tried, key=lambda r: (-tried[r], r)) and found["c"].recall == pytest.approx(max(tried.values()))
    # the same trees whatever the partitions, and again from the state on storage without further rounds
    other, _, _ = trainer(spark, settings, specs, parts=5)
    assert {k: m.content() for k, m in other.run().items()} == {k: m.content() for k, m in found.items()}
    resumed, _, _ = trainer(spark, settings, specs, str(tmp_path))
    resumed.grow = None
    assert {k: m.content() for k, m in resumed.run().items()} == {k: m.content() for k, m in found.items()}
    got = boosting.scored(selection, found, ["session", "aid"]).where("model = 'c'").toPandas().set_index(["session", "aid"])["score"]
    rows["score"] = found["c"].margins(rows[NAMES].to_numpy())
    assert got.to_dict() == pytest.approx(rows.set_index(["session", "aid"])["score"].to_dict())


def test_a_broken_run_goes_on(spark, tmp_path):
    settings = Settings(rounds=6, leaves=4, rate=0.3, least_rows=10, bins=16, interval=2)
    specs = [Spec("c", "clicks", tuple(NAMES))]
    whole = trainer(spark, settings, specs)[0].run()
    broken, _, _ = trainer(spark, settings, specs, str(tmp_path))
    grow, grown = broken.grow, []

    def fails():
        if len(grown) == 5:
            raise RuntimeError("lost")
        grown.append(1)
        return grow()

    broken.grow = fails
    with pytest.raises(RuntimeError, match="lost"):
        broken.run()
    again, _, _ = trainer(spark, settings, specs, str(tmp_path))
    assert again.run()["c"].content() == whole["c"].content()


def test_one_class_is_refused(spark):
    settings = Settings(rounds=1)
    df = rows_of(spark, 1).withColumn("target_clicks", F.lit(0))
    limits = boosting.thresholds(df, NAMES, 16)
    packed = boosting.blocks(df, NAMES, limits, OBJECTIVES)
    with pytest.raises(ValueError, match="both target classes"):
        Trainer(packed, packed, NAMES, limits, OBJECTIVES, [Spec("c", "clicks", tuple(NAMES))], {"clicks": 3}, settings).run()
    with pytest.raises(ValueError, match="denominator"):
        Trainer(packed, packed, NAMES, limits, OBJECTIVES, [Spec("c", "clicks", tuple(NAMES))], {"clicks": 0}, settings)


def brute_shapley(tree, x, n_features):
    """Shapley values of the tree's expected value given the known features, over all subsets."""

    def expected(known, node=0):
        if tree.feature[node] < 0:
            return tree.value[node]
        f, a, b = tree.feature[node], tree.left[node], tree.right[node]
        if f in known:
            return expected(known, a if x[f] <= tree.threshold[node] else b)
        return sum(tree.cover[c] / tree.cover[node] * expected(known, c) for c in (a, b))

    out = np.zeros(n_features)
    for f in range(n_features):
        others = [o for o in range(n_features) if o != f]
        for k in range(n_features):
            weight = math.factorial(k) * math.factorial(n_features - k - 1) / math.factorial(n_features)
            for some in itertools.combinations(others, k):
                out[f] += weight * (expected({*some, f}) - expected(set(some)))
    return out, expected(set())


def random_tree(random, n_features, leaves):
    feature, threshold, left, right, cover = [-1], [0.0], [0], [0], [1000]
    ends = [0]
    while len(ends) < leaves:
        node = ends.pop(int(random.integers(len(ends))))
        feature[node], threshold[node] = int(random.integers(n_features)), float(random.normal())
        a = int(random.integers(1, max(2, cover[node])))
        left[node], right[node] = len(feature), len(feature) + 1
        for c in (a, max(1, cover[node] - a)):
            feature.append(-1), threshold.append(0.0), left.append(0), right.append(0), cover.append(c)
        cover[node] = cover[left[node]] + cover[right[node]]
        ends += [left[node], right[node]]
    for node in range(len(feature) - 1, -1, -1):  # covers add up from the leaves
        if feature[node] >= 0:
            cover[node] = cover[left[node]] + cover[right[node]]
    value = random.normal(size=len(feature))
    return boosting.Tree(np.array(feature), np.array(threshold), np.zeros(len(feature), int), np.array(left), np.array(right), value, np.array(cover), np.ones(len(feature)))


def test_contributions_equal_enumeration_on_eight_features():
    random = np.random.default_rng(9)
    for leaves in (1, 2, 9, 20):
        tree, rows = random_tree(random, 8, leaves), random.normal(size=(4, 8))
        out = np.zeros((4, 8))
        base = shap.add_contributions(tree, rows, out)
        for x, got in zip(rows, out, strict=True):
            wanted, mean = brute_shapley(tree, x, 8)
            assert got == pytest.approx(wanted, abs=1e-10) and base == pytest.approx(mean)


def test_contributions_add_up(spark):
    settings = Settings(rounds=6, leaves=6, rate=0.3, least_rows=10, bins=32, interval=3)
    made, _, selection = trainer(spark, settings, [Spec("c", "clicks", tuple(NAMES)), Spec("k", "carts", ("half", "noise"))])
    models = made.run()
    models["c"].best = 6
    found = shap.explained(selection, models, ["session", "aid"])
    for r in found.collect():
        assert sum(r["contributions"]) + r["base"] == pytest.approx(r["margin"], abs=1e-5)
    told = {(r["model"], r["feature"]): r for r in shap.importance(found, models).collect()}
    assert len(told) == 6 and told["c", "flat"]["mean_absolute_shap"] == 0 < told["c", "told"]["mean_absolute_shap"]
    assert told["c", "told"]["gain"] > 0 and abs(told["c", "told"]["mean_signed_shap"]) <= told["c", "told"]["mean_absolute_shap"]
