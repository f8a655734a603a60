"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b); root is the smallest node of its component.

    Each round a node takes the smallest root among its neighbours, and then the root of that root, so a chain shortens
    to about half. Nodes and links stay in tables; only the number of changed rows reaches the driver.
    """
    both = scratch.keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    roots = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        near = both.join(scratch.hinted(roots).withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = scratch.keep(roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid")))
        # Between roots: a root that found a smaller one passes it on to all that point at it. A written table, so a frequent root is a skewed side that Spark splits.
        up = scratch.keep(hooked.groupBy(F.col("old").alias("mid")).agg(F.min("mid").alias("up")).where("up < mid"))
        after = scratch.keep(hooked.join(scratch.hinted(up), "mid", "left").select("node", F.coalesce("up", "mid").alias("root")))
        done = not up.limit(1).count()
        scratch.drop(roots, hooked, up)
        roots = after
        if done:
            scratch.drop(both)
            return roots
