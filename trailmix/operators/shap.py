"""Path-dependent Shapley contributions of boosted trees, all rows of a batch at once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from trailmix.operators.boosting import Ensemble, Tree
from trailmix.session import shipped


def paths(tree: Tree) -> Iterator[tuple[int, list[tuple[int, int, bool]]]]:
    """Every leaf with the (node, child, whether left) steps that lead to it."""
    open_paths: list[tuple[int, list]] = [(0, [])]
    while open_paths:
        node, steps = open_paths.pop()
        if tree.feature[node] < 0:
            yield node, steps
            continue
        for child, left in ((int(tree.left[node]), True), (int(tree.right[node]), False)):
            open_paths.append((child, [*steps, (node, child, left)]))


def add_contributions(tree: Tree, values: np.ndarray, out: np.ndarray) -> float:
    """Adds to ``out`` (rows by features) what each feature contributes to the tree's value; returns the mean value over the fit's rows.

    A leaf's value goes to the features on its path. A feature that is known keeps a row on the path or not (1 or 0); one that is not known keeps
    the share of the fit's rows that the path keeps at its nodes. The weights of all subsets of the other features come
    from the coefficients of one product of linear terms.
    """
    went_left = {n: values[:, tree.feature[n]] <= tree.threshold[n] for n in np.flatnonzero(tree.feature >= 0)}
    mean = 0.0
    for leaf, steps in paths(tree):
        known: dict[int, np.ndarray] = {}
        share: dict[int, float] = {}
        for node, child, left in steps:
            f = int(tree.feature[node])
            stays = went_left[node] if left else ~went_left[node]
            known[f] = known[f] & stays if f in known else stays
            share[f] = share.get(f, 1.0) * float(tree.cover[child]) / float(tree.cover[node])
        value, d = float(tree.value[leaf]), len(known)
        mean += value * math.prod(share.values())
        for f in known:
            poly = np.zeros((len(values), d))
            poly[:, 0] = 1.0
            for degree, other in enumerate((o for o in known if o != f), 1):
                shifted = poly[:, :degree] * known[other][:, None]
                poly[:, : degree + 1] *= share[other]
                poly[:, 1 : degree + 1] += shifted
            weights = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
            out[:, f] += value * (known[f] - share[f]) * (poly @ weights)
    return mean


def contributions(model: Ensemble, values: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows by features, base): the contributions and the base add up to the margins."""
    out, base = np.zeros((len(values), len(model.features))), 0.0
    for tree in model.used:
        base += add_contributions(tree, values, out)
    return out, base


def explained(rows: DataFrame, models: dict[str, Ensemble], keep: list[str], tolerance: float = 1e-5) -> DataFrame:
    """(*keep, model, base, margin, contributions): a row under each model, contributions in the order of its features. One that does not add up fails the job."""
    shipped(rows.sparkSession)
    names = sorted({f for m in models.values() for f in m.features})
    shared = rows.sparkSession.sparkContext.broadcast({k: replace(m, trees=m.used) for k, m in models.items()})
    schema = rows.select(*keep).schema.add("model", "string").add("base", "double").add("margin", "double").add("contributions", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch.column(len(keep) + i).to_numpy() for i in range(len(names))])
            for name, model in shared.value.items():
                own = values[:, [names.index(f) for f in model.features]]
                parts, base = contributions(model, own)
                margins = model.margins(own)
                if len(margins) and np.abs(parts.sum(axis=1) + base - margins).max() > tolerance:
                    raise ArithmeticError("contributions do not add up to the margin")
                n = batch.num_rows
                added = [pa.array([name] * n), pa.array(np.full(n, base)), pa.array(margins), pa.array(list(parts), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *added], names=schema.names)

    return rows.select(*keep, *[F.col(f).cast("double").alias(f"_{f}") for f in names]).mapInArrow(run, schema)


def importance(found: DataFrame, models: dict[str, Ensemble]) -> DataFrame:
    """(model, feature, gain, mean_absolute_shap, mean_signed_shap), from sums within tasks."""
    spark = found.sparkSession
    cells = found.select("model", F.posexplode("contributions").alias("place", "c")).groupBy("model", "place").agg(F.avg(F.abs("c")).alias("mean_absolute_shap"), F.avg("c").alias("mean_signed_shap"))
    named = [(k, i, f, m.importance()[f]) for k, m in models.items() for i, f in enumerate(m.features)]
    names = spark.createDataFrame(named, "model string, place int, feature string, gain double")
    return names.join(cells, ["model", "place"], "left").select("model", "feature", "gain", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_absolute_shap", "mean_signed_shap")])
