"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.runtime import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): the smallest node that links lead to.

    `links` is read once a round, so it should be a written table without many repeats.

    Labels spread along links and then along the labels themselves (pointer jumping), so the rounds grow with the
    logarithm of a component's diameter; each round is written to the shared folder. Minima combine before the shuffle,
    and joins are plain equi-joins with the written labels, whose hot nodes adaptive execution may split.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("told"))
        heard = materialise(labels.join(told, "node").select("node", F.col("component").alias("was"), F.least("component", "told").alias("component")))
        jump = heard.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = materialise(heard.join(jump, "component").select("node", "was", F.least("component", "further").alias("component")))
        labels = after.select("node", "component")
        if after.where(F.col("was") != F.col("component")).isEmpty():
            return labels
