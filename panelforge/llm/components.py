"""Connected components by labels that take the least label of the neighbours and of their own label's node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Work


def components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """(id, comp) of every node of edges (a, b): comp is the least id it can reach. Each round is a written table."""
    both = work.cut(edges.selectExpr("a", "b").union(edges.selectExpr("b AS a", "a AS b")), f"{name}_edges")
    labels = work.cut(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "id"), f"{name}_0")
    rounds = 0
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", "comp", F.least("comp", "near").alias("low"))
        of = labels.selectExpr("id AS of", "comp AS further")
        jumped = lower.join(of, lower["low"] == of["of"], "left").select("id", F.least("low", "further").alias("new"), "comp")
        rounds += 1
        step = work.cut(jumped.select("id", F.col("new").alias("comp"), (F.col("new") != F.col("comp")).alias("moved")), f"{name}_{rounds}")
        moved = not step.filter("moved").isEmpty()
        labels = step.select("id", "comp")
        work.drop(f"{name}_{rounds - 1}")
        if not moved:
            work.drop(f"{name}_edges")
            return labels
