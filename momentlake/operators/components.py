"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlake.session import shared_folder


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, label)``: for every node of ``links`` the smallest node it is connected with.

    Each round takes, over a node's neighbours, the smallest label of their labels. The node takes it, the node that was
    its label takes it too (so whole trees are hooked at once, in whatever order the names lie along a chain), and every
    node takes its label's label. It goes on until nothing changes; as labels only fall, that comes to an end. Links stay
    distributed; every round is checkpointed to the shared folder. A node with many links is pre-aggregated before the
    shuffle. Null ends are ignored; an empty table gives an empty result.
    """
    spark = links.sparkSession
    shared_folder(spark)
    both = links.where(f"{a} is not null and {b} is not null").select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = both.union(both.select("y", "x")).distinct().checkpoint()
    label = edges.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("label")).checkpoint()
    changed = True
    while changed:
        jump = label.select(F.col("x").alias("label"), F.col("label").alias("further"))
        far = label.join(jump, "label").select("x", "label", "further")
        seen = edges.join(far.select(F.col("x").alias("y"), "further"), "y").groupBy("x").agg(F.min("further").alias("m"))
        near = far.join(seen, "x").select("x", "label", F.least("label", "further", "m").alias("low"))
        hook = near.groupBy("label").agg(F.min("low").alias("hooked")).withColumnRenamed("label", "x")
        step = near.join(hook, "x", "left").select("x", "label", F.least("low", "hooked").alias("new")).checkpoint()
        changed = step.where("new < label").limit(1).count() > 0
        label = step.select("x", F.col("new").alias("label"))
    return label.withColumnRenamed("x", a)
