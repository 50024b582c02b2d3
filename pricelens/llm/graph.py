"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``links`` (a, b): comp is the least node reachable.

    Each round takes the least label among the neighbours and then the label's
    own label, so the rounds grow with the logarithm of the longest chain.
    Labels are written to the shared folder after each round; the joins are
    between plain tables, whose skewed keys the engine splits.
    """
    both = staged(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                    .select("node", F.least("node", "least").alias("comp"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = staged(labels.select("node", F.col("comp").alias("old")).join(seen, "node").select("node", "old", F.least("old", "near").alias("comp")), "labels")
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        labels = staged(step.join(up, "comp").select("node", F.col("top").alias("comp"), (F.col("top") < F.col("old")).alias("moved")), "labels")
    return labels.select("node", "comp")
