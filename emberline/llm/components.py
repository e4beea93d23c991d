"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.plans.storage import Tables


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours are linked to its smallest one instead. One exchange; links
    may repeat."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = both.withColumn("m", F.min(F.least("u", "v")).over(Window.partitionBy("u")))
    if large:
        return moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v")


def components(links: DataFrame, kept: Tables) -> DataFrame:
    """``node, root`` for each node that is not its component's smallest, from links ``u, v``.

    The number of rounds grows with the logarithm of the longest chain; each round's links
    are a stored table, of which only the last one stays.
    """
    edges = kept.cut(links.filter("u <> v").select("u", "v").distinct())
    mark = None
    while True:
        after = kept.cut(_stars(_stars(edges, large=True), large=False).distinct())
        kept.drop(edges)
        edges = after
        n, digest = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, digest) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (n, digest)
