"""Connected components by distributed label passing with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def connected_components(links: DataFrame, stage: Stage, name: str = "cc") -> DataFrame:
    """(v, component) for every vertex of ``links`` (a, b long); the component is its smallest vertex.

    Every round passes the smallest label over each link and then replaces a label by the label of that
    label's vertex, so long chains shorten by powers of two. Rounds are written to the shared folder, and
    nothing but the number of changed labels comes to the driver.
    """
    edges = stage.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = stage.write(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("l")), f"{name}-0")
    k = 0
    while True:
        near = edges.join(labels, edges.b == labels.v).groupBy("a").agg(F.min("l").alias("near"))
        passed = labels.join(near, labels.v == near.a).select("v", F.col("l").alias("was"), F.least("l", "near").alias("l"))
        target = labels.select(F.col("v").alias("t"), F.col("l").alias("tl"))
        jumped = passed.join(target, passed.l == target.t, "left").select("v", "was", F.least("l", "tl").alias("l"))
        k += 1
        after = stage.write(jumped, f"{name}-{k}")
        changed = after.filter("l <> was").limit(1).count()
        stage.drop(f"{name}-{k - 1}")
        labels = after.select("v", "l")
        if not changed:
            return labels.select("v", F.col("l").alias("component"))
