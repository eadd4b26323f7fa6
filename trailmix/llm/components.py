"""Connected components of a link table, on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmix.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the component's smallest node.

    Each round a node takes the least label among itself and its neighbours, then its label's label; rounds end
    when nothing changes. Every round is written to shared storage, which cuts its lineage.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("node", "other"), "links")
    labels = stored(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        near = edges.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("next"), "label")
        jump = labels.toDF("next", "jump")
        moved = stored(lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("label"), F.col("label").alias("was")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels
