"""Running sums over a global order without a single-task window."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(rows: DataFrame, key: str, value: str, buckets: int = 256) -> DataFrame:
    """`rows` with start: the sum of `value` over smaller keys. Keys are cut into ranges at their quantiles; the ranges' sums,
    `buckets` rows, are summed first, and each range then by itself."""
    cuts = rows.agg(F.percentile_approx(key, F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)]), 10000)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    cut = rows.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(key))))
    sums = cut.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(F.broadcast(before), "_range").withColumn("start", F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_range", "_before")
