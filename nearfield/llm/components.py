"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, comp`` for each node of ``links(a, b)``; ``comp`` is the least node that links reach.

    Each round gives a node the least label among its own and its neighbours', then the label of
    that label, so long chains shorten by pointer jumping. Rounds are written tables: lineage stays
    short and nothing but a count comes to the driver. A hub's links meet its one label in joins of
    plain exchanges, whose large partitions Spark splits. Null ends and loops are ignored; an empty
    table gives no rows.
    """
    links = links.filter("a is not null and b is not null and a <> b").select("a", "b").distinct()
    edges = scratch.table(links.union(links.select("b", "a")), f"{name}-edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp"))
    labels, k = scratch.table(labels, f"{name}-0"), 0
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.least("comp", "near").alias("low"), "comp")
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        step = low.join(jump, "low").select("node", "next", (F.col("next") != F.col("comp")).alias("moved"))
        k += 1
        step = scratch.table(step, f"{name}-{k}")
        if not step.filter("moved").limit(1).count():
            scratch.drop(f"{name}-edges", f"{name}-{k - 1}")
            return step.select("node", F.col("next").alias("comp"))
        labels = step.select("node", F.col("next").alias("comp"))
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
