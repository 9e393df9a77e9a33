"""Connected components of a written edge table, by smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.operators.skew import salted_join
from markwise.session import written


def connected_components(nodes: DataFrame, edges: DataFrame, group: list[str]) -> DataFrame:
    """(group…, id, root): root is the smallest id reachable from id.

    Every round takes the smallest root among a node and its neighbours, then
    jumps to the root's root, so rounds grow with the logarithm of the longest
    path. Both joins split hubs over salts; minima are combined before the
    shuffle. Each round is a written table.
    """
    both = written(
        edges.select(*group, F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
            edges.select(*group, F.col("b").alias("id"), F.col("a").alias("other"))
        ),
        "edges",
    )
    roots = written(nodes.select(*group, "id", F.col("id").alias("root")), "roots")
    while True:
        near = salted_join(
            both, roots.select(*group, F.col("id").alias("other"), F.col("root").alias("near")),
            [*group, "other"], "id", "inner",
        ).groupBy(*group, "id").agg(F.min("near").alias("near"))
        lowered = roots.join(near, [*group, "id"], "left").select(
            *group, "id", F.col("root").alias("before"), F.least("root", F.coalesce("near", "root")).alias("root")
        )
        lowered = written(lowered, "lowered")
        jump = lowered.select(*group, F.col("id").alias("root"), F.col("root").alias("further"))
        jumped = written(
            salted_join(lowered, jump, [*group, "root"], "id", "inner").select(
                *group, "id", "before", F.col("further").alias("root")
            ),
            "roots",
        )
        if jumped.filter("before <> root").isEmpty():
            return jumped.drop("before")
        roots = jumped.drop("before")
