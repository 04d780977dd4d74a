"""Mixing sources to target weights: Efraimidis-Spirakis keys, sorted within a source and prefix-summed to a token budget."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, ranked, saved

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by a source's place, repeated; the share of all words that the mix has; and how often a document is taken at most.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Weight of a document in (0, 1]: high where its characters are letters and blanks, low where signs and digits crowd it."""
    odd = F.coalesce(F.regexp_count(text, F.lit(r"[^\p{L}\s]")), F.lit(0))
    return 1.0 / (1.0 + 10.0 * odd / F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = EPOCHS) -> DataFrame:
    """`sizes` has source and source_size, a row for each source. Adds target: share of all words by weight, at most `most`
    times the source's words; what that cuts off is shared again by weight among the sources below it. Weights go round by
    place, sources in code point order and null last. Sources are sorted once by the level at which they are full; sums over
    the fuller ones give the level at which the budget is spent. The driver sees sums only, so sources may be many."""
    at = numbered(*ranked(sizes, [F.col("source").asc_nulls_last()], name="sources"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    weighed = at.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("full"))
    rows, _ = ranked(weighed.withColumn("level", F.col("full") / F.col("weight")), ["level", F.col("source").asc_nulls_last()], name="levels")
    earlier = lambda by, *parts: Window.partitionBy(*parts).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(*[F.sum(c).alias(f"p_{c}") for c in ("full", "weight", "source_size")])
    sums = saved(parts.select("_part", *[F.coalesce(F.sum(f"p_{c}").over(earlier("_part")), F.lit(0.0)).alias(f"b_{c}") for c in ("full", "weight")], "p_weight", "p_source_size"), "level-sums")  # a row for each partition
    total = sums.agg(F.sum("p_source_size"), F.sum("p_weight")).first()
    budget, all_weight = share * (total[0] or 0), total[1] or 0.0
    before = lambda c: F.col(f"b_{c}") + F.coalesce(F.sum(c).over(earlier("_place", "_part")), F.lit(0.0))
    tried = rows.join(F.broadcast(sums), "_part").select("level", ((F.lit(budget) - before("full")) / (F.lit(all_weight) - before("weight"))).alias("spent"))
    level = tried.where(F.col("spent") <= F.col("level") * (1 + 1e-12)).agg(F.max("spent")).first()[0]
    least = F.col("full") if level is None else F.least("full", F.col("weight") * F.lit(max(0.0, level)))
    return rows.select("source", "source_size", "weight", least.alias("target"))


def mixed(rows: DataFrame, seed: int = 1, weights: tuple = WEIGHTS, share: float = SHARE, most: int = EPOCHS) -> DataFrame:
    """`rows` has doc_id, source, size (words) and quality. Adds source_size, target, copies and taken (copies times size).

    Every document is taken for each complete epoch in its source's target; of the rest, documents come in order of their
    key, -ln(u) / quality with u from a hash of the id and, if `rows` has it, of the column print, while the words so far and half of the next document fit. So a
    source misses its target by half a document at most. A null source is a source. Equal keys are ordered by id, size and
    the rest of the row. Columns of these names are replaced; an empty table stays empty."""
    rows = rows.drop("source_size", "target", "copies", "taken", "_key")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[c for c in ("doc_id", "print") if c in rows.columns]), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = rows.withColumn("_key", -F.log(u) / F.greatest(F.col("quality"), F.lit(1e-9)))
    at, parts = ranked(keyed, [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id"), F.col("size")], name="mix-rows")
    sums = saved(at.groupBy("_part", "source").agg(F.sum("size").alias("part_size")), "mix-sums")
    aims = saved(targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most), "targets")
    # a row for each source in each partition of its range; before: the words of the source in earlier partitions
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", "source", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("before"))
    offsets = saved(offsets.join(aims, offsets.source.eqNullSafe(aims.source)).select("_part", offsets.source, "before", "source_size", "target"), "offsets")
    o = offsets.withColumnsRenamed({"_part": "o_part", "source": "o_source"})
    within = Window.partitionBy("_part", "source").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    summed = at.withColumn("so_far", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = summed.join(o, (F.col("_part") == F.col("o_part")) & F.col("source").eqNullSafe(F.col("o_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("int")
    left = F.col("target") - epochs * F.col("source_size")
    more = (epochs < most) & (left > 0) & (F.col("before") + F.col("so_far") + F.col("size") / 2.0 <= left)
    copies = epochs + more.cast("int")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("_part", "_place", "_key", "so_far", "before", "o_part", "o_source")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, size, source_size, target, taken, source and copies; with `row_col` that column
    too, as row. A null text has size 0. Texts are read once; only ids, sources and numbers move."""
    own = [] if row_col is None else [F.col(row_col).alias("row")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), quality(F.col(text_col)).alias("quality"), F.xxhash64(text_col).alias("print"), *own)
    return mixed(rows).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", *["row" for _ in own])
