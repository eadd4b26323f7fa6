"""Paired bootstrap by multinomial draws, and the seal of a study."""

import json

import numpy as np
import pytest

from trailmix.operators import resample, sealing
from trailmix.operators.boosting import Ensemble, Tree
from trailmix.sources import files

WEIGHTS = np.array([0.1, 0.3, 0.6])


def sessions(spark, n=300, seed=4, denominator=3):
    random = np.random.default_rng(seed)
    rows = [(int(s), *(random.integers(0, 3, 3).tolist() for _ in range(2)), [denominator] * 3) for s in range(n)]
    return rows, spark.createDataFrame(rows, "session long, hits array<bigint>, base array<bigint>, denominator array<bigint>")


def test_every_replicate_draws_exactly_n_sessions(spark, monkeypatch):
    monkeypatch.setattr(resample, "BUCKET", 32)
    _, df = sessions(spark)
    found = {r["replicate"]: r for r in resample.replicates(df, 7, 1000).collect()}
    assert len(found) == 1000 and {r["sessions"] for r in found.values()} == {300}
    assert {tuple(r["denominator"]) for r in found.values()} == {(900, 900, 900)}
    other = {r["replicate"]: r for r in resample.replicates(df.repartition(7), 7, 1000).collect()}
    assert found == other and found != {r["replicate"]: r for r in resample.replicates(df, 8, 1000).collect()}


def test_draws_are_multinomial():
    ends = np.cumsum([50, 10, 0, 40])
    drawn = np.array([[resample.drawn_by(ends, b, 100, 3, r) for b in range(4)] for r in range(4000)])
    assert (drawn.sum(axis=1) == 100).all() and (drawn[:, 2] == 0).all()
    share = np.array([0.5, 0.1, 0.0, 0.4])
    assert drawn.mean(axis=0) == pytest.approx(100 * share, abs=0.4)
    assert drawn.var(axis=0) == pytest.approx(100 * share * (1 - share), abs=1.6)
    w = resample.weights_of(ends, 3, 100, 3, 5)
    assert len(w) == 40 and w.sum() == drawn[5, 3]


def test_intervals_equal_quantiles_of_the_same_draws(spark, monkeypatch):
    monkeypatch.setattr(resample, "BUCKET", 64)
    rows, df = sessions(spark, 200)
    got = resample.paired(df, 7, 150).first()
    hits, base, den = (np.array([r[i] for r in rows], float) for i in (1, 2, 3))
    sums = {r["replicate"]: r for r in resample.replicates(df, 7, 150).collect()}
    scores = [(np.array(sums[r]["hits"]) / np.array(sums[r]["denominator"])) @ WEIGHTS for r in range(150)]
    gains = [((np.array(sums[r]["hits"]) - np.array(sums[r]["base"])) / np.array(sums[r]["denominator"])) @ WEIGHTS for r in range(150)]
    assert got["score"] == pytest.approx((hits.sum(0) / den.sum(0)) @ WEIGHTS) and got["gain"] == pytest.approx(((hits - base).sum(0) / den.sum(0)) @ WEIGHTS)
    assert [got["score_low"], got["score_high"]] == pytest.approx(np.quantile(scores, [0.025, 0.975]).tolist())
    assert [got["gain_low"], got["gain_high"]] == pytest.approx(np.quantile(gains, [0.025, 0.975]).tolist())
    assert got["valid"] == got["requested"] == 150


def test_invalid_bootstraps_raise(spark):
    rows = [(s, [0, 0, 0], [0, 0, 0], [1, 1, int(s == 0)]) for s in range(20)]  # one session alone has orders: a third of the draws miss it
    df = spark.createDataFrame(rows, "session long, hits array<bigint>, base array<bigint>, denominator array<bigint>")
    with pytest.raises(ValueError, match="too many bootstrap samples"):
        resample.paired(df, 1, 200)
    with pytest.raises(ValueError, match="at least 100"):
        resample.paired(df, 1, 99)
    with pytest.raises(ValueError, match="denominator"):
        resample.paired(df.where("session > 0"), 1, 100)


def model(value=1.0) -> Ensemble:
    zero, one = np.zeros(1, np.int32), np.array([value])
    return Ensemble(["x"], [Tree(zero - 1, np.zeros(1), zero, zero, zero, one, zero + 9, np.zeros(1))], 1, 0.5)


def test_a_changed_model_or_seal_is_refused(spark, tmp_path):
    folder, objectives, data = str(tmp_path), ("clicks", "carts"), {"events": "abc"}
    entries = {o: sealing.save_model(spark, folder, o, model(i)) for i, o in enumerate(objectives)}
    first = sealing.seal(spark, folder, {"selected": entries}, data)
    assert sealing.seal(spark, folder, {"selected": entries}, data) == first
    assert sealing.opened(spark, folder, objectives, data)["selected"]["carts"].content() == model(1).content()
    with pytest.raises(ValueError, match="already sealed"):
        sealing.seal(spark, folder, {"selected": {"clicks": entries["clicks"], "carts": entries["clicks"]}}, data)
    with pytest.raises(ValueError, match="data differ"):
        sealing.opened(spark, folder, objectives, {"events": "def"})
    with pytest.raises(ValueError, match="every objective"):
        sealing.opened(spark, folder, (*objectives, "orders"), data)
    path = f"{folder}/{entries['carts']['path']}"
    text = files.read_text(spark, path)
    files.write_text(spark, path, json.dumps(model(2).content(), sort_keys=True))
    with pytest.raises(ValueError, match="model was changed"):
        sealing.opened(spark, folder, objectives, data)
    files.write_text(spark, path, text)
    told = json.loads(files.read_text(spark, f"{folder}/{sealing.SEAL}"))
    files.write_text(spark, f"{folder}/{sealing.SEAL}", json.dumps(told | {"lineage": {"events": "def"}}, sort_keys=True))
    with pytest.raises(ValueError, match="seal was changed"):
        sealing.opened(spark, folder, objectives, {"events": "def"})


def test_canonical_ids_ignore_order():
    assert sealing.canonical({"a": 1, "b": [1, 2]}) == sealing.canonical({"b": [1, 2], "a": 1}) != sealing.canonical({"a": 1, "b": [2, 1]})
