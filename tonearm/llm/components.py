"""Connected components by alternating large and small stars (Kiveris et al., 2014), all in DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """`edges` has long columns u and v. Returns one row (node, label) for each node of an edge; label is the smallest node
    that it reaches. Each round ends in a saved table, and the one before goes; no edge list reaches the driver, only a count
    and a checksum. Rounds grow with the logarithm of the nodes. Loops and repeated edges do nothing; without edges the
    result is empty."""
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, before = saved(small.union(least).distinct(), "edges"), e
        dropped(before, large)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark = now
