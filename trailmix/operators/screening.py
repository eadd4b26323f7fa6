"""Feature screening: distinct values, modes, correlations, duplicates, and a redundancy filter; pilots on Spark ML."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmix.operators.metrics import WEIGHTS


def long_form(rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(feature, value, *keep): all features side by side in one pass, by explode of an array."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    return rows.select(*keep, cells.alias("x")).select("x.*", *keep)


def quality(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, n, distinct values, share of the mode, min, max. Values are counted once, then reduced: no set of values meets in one place."""
    counts = long_form(rows, features, []).groupBy("feature", "value").agg(F.count("*").alias("n"))
    out = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_values"), F.max("n").alias("_mode"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.select("feature", "n", "distinct_values", (F.col("_mode") / F.col("n")).alias("mode_share"), "least", "most")


def correlations(rows: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of each feature with each target; 0 where either is constant."""
    cells = long_form(rows, features, [f"target_{o}" for o in WEIGHTS])

    def one(o: str):
        x, y = F.col("value"), F.col(f"target_{o}").cast("double")
        varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        return F.when(varied, F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y))).otherwise(0.0).alias(f"rho_{o}")

    return cells.groupBy("feature").agg(*[one(o) for o in WEIGHTS])


def statuses(rows: DataFrame, features: list[str]) -> DataFrame:
    """constant, near_constant, target_equivalent, duplicate (same content as an earlier eligible feature) or eligible, with utility."""
    key = ["session", "aid"]
    content = long_form(rows, features, key).groupBy("feature").agg(F.sum(F.xxhash64(*key, "value").cast("decimal(38,0)")).alias("content"))
    order = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    rho = correlations(rows, features)
    utility = sum((F.abs(F.col(f"rho_{o}")) * w for o, w in WEIGHTS.items()), F.lit(0.0))
    joined = quality(rows, features).join(rho, "feature").join(content, "feature").withColumn("utility", utility).withColumn("place", order[F.col("feature")])
    varied = (F.col("distinct_values") >= 2) & (F.col("mode_share") < 0.9999)
    firsts = joined.where(varied).groupBy("content").agg(F.min("place").alias("first_place"))
    leaky = F.greatest(*[F.abs(F.col(f"rho_{o}")) for o in WEIGHTS]) > 0.999999
    status = (
        F.when(leaky, "target_equivalent").when(F.col("distinct_values") < 2, "constant").when(F.col("mode_share") >= 0.9999, "near_constant")
        .when(F.col("place") > F.col("first_place"), "duplicate").otherwise("eligible")
    )
    return joined.join(firsts, "content", "left").select("feature", status.alias("status"), "utility", "place")


def correlation_matrix(rows: DataFrame, names: list[str]) -> np.ndarray:
    """Correlations of columns, 0 where one is constant. Columns by columns; rows are reduced on executors."""
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(rows.select(*[F.col(f).cast("double").alias(f) for f in names]))
    return np.nan_to_num(Correlation.corr(vectors, "v").head()[0].toArray())


def retained(rows: DataFrame, utility: dict[str, float], core: list[str], limit: float = 0.995, most: int = 128) -> list[str]:
    """Protected features, all of them, then others of positive utility by utility and name: each stays unless it correlates too strongly with one that stays."""
    names = sorted(set(core) | {f for f, u in utility.items() if u > 0}, key=lambda f: (f not in core, -utility.get(f, 0.0), f))
    if not names:
        return []
    matrix = correlation_matrix(rows, names)
    kept: list[int] = []
    for i, f in enumerate(names):
        if f in core or len(kept) < most and all(abs(matrix[i, j]) < limit for j in kept):
            kept.append(i)
    return [names[i] for i in kept]


class Pilot:
    """A small pointwise model of one objective, for screening: boosted trees of Spark ML."""

    def __init__(self, features: list[str], objective: str, rounds: int = 3, seed: int = 5):
        self.features, self.objective, self.rounds, self.seed = list(features), objective, rounds, seed

    def vectors(self, rows: DataFrame) -> DataFrame:
        ready = rows.withColumns({f"_{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features})
        return VectorAssembler(inputCols=[f"_{f}" for f in self.features], outputCol="_v").transform(ready)

    def fit(self, rows: DataFrame) -> Pilot:
        label = f"target_{self.objective}"
        data = self.vectors(rows).select("_v", F.col(label).cast("double").alias("label"))
        self.model = GBTClassifier(featuresCol="_v", labelCol="label", maxIter=self.rounds, maxDepth=4, seed=self.seed).fit(data)
        return self

    def log_loss(self, rows: DataFrame) -> float:
        p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-15)), F.lit(1 - 1e-15))
        y = F.col(f"target_{self.objective}").cast("double")
        found = self.model.transform(self.vectors(rows)).agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("loss")).head()["loss"]
        return float(found or 0.0)

    def importance(self) -> dict[str, float]:
        """Share of the gain of each feature."""
        values = self.model.featureImportances.toArray().tolist()
        total = sum(values) or 1.0
        return {f: v / total for f, v in zip(self.features, values, strict=True)}


def recalled(scored: DataFrame, labels: DataFrame, keys: list[str], top: int) -> DataFrame:
    """Hits among the ``top`` rows of each query by score, ties by item, summed per ``keys``; 0 where there are none."""
    order = Window.partitionBy(*keys, "session").orderBy(F.desc("score"), "aid")
    first = scored.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top)
    met = first.join(labels.select("session", "aid", F.lit(1).alias("_hit")), ["session", "aid"], "left")
    return met.groupBy(*keys).agg(F.count("_hit").alias("hits"))
