"""Exact duplicates through content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, each chunk gets a fingerprint, and the ordered fingerprints are the text's
recipe. Texts whose recipe is unique can't be copies and move no further. Of the others each distinct chunk moves once, after
map-side aggregation, to be named: texts of one fingerprint get different identifiers, so equal identifiers mean equal chunks.
Documents are copies when their ordered lists of identifiers are equal."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: A chunk has LEAST to MOST characters and ends at the first place past LEAST where a character of CUT_AFTER is followed
#: by one of CUT_BEFORE: a place that depends on two characters only, so equal passages are cut alike wherever they stand.
LEAST, MOST, CUT_AFTER, CUT_BEFORE = 384, 4096, r"[\s.,;:eos]", r"[\sa-dtA-D]"
CHUNKS = rf"(?s).{{{LEAST},{MOST - 1}}}?(?<={CUT_AFTER})(?={CUT_BEFORE})|.{{1,{MOST}}}"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. `lower` does just that where no other upper-case letter stands."""
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWERED))


def chunk_print(chunk: Column) -> Column:
    """The fingerprint of a chunk."""
    return F.xxhash64(chunk, F.octet_length(chunk))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, prints=chunk_print) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id (largest doc_id of the rows with an equal text), group_size, kept,
    text_sha256 (lower-case hex of the lower-cased text); with `row_col` that column too, as row.

    A null text is an empty one. A null id is smaller than any other: such rows have kept true where no row of their group
    has an id. Repeated rows count in group_size; all rows that hold the largest doc_id of a group are kept. Other columns
    are ignored. An empty table gives no rows."""
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    own = [] if row_col is None else ["row"]
    recipe = F.transform(F.regexp_extract_all(F.col("t"), F.lit(CHUNKS), F.lit(0)), prints)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), *([] if row_col is None else [F.col(row_col).alias("row")]))
    rows = saved(source.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.xxhash64("t").alias("print"), F.octet_length("t").cast("long").alias("n_bytes"), recipe.alias("recipe"), *own), "recipes")
    many = saved(rows.groupBy("recipe", "n_bytes").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).where("n > 1").select(F.col("recipe").alias("r"), F.col("n_bytes").alias("b"), "n", "top"), "shared")
    # chunks of texts whose recipe is shared, each distinct (fingerprint, content) once
    shared = rows.join(many, (rows.recipe == many.r) & (rows.n_bytes == many.b), "left_semi").select("print").distinct()
    contents = source.withColumn("print", F.xxhash64("t")).join(saved(shared, "movers"), "print", "left_semi").select(F.explode(F.regexp_extract_all("t", F.lit(CHUNKS), F.lit(0))).alias("chunk"))
    named = contents.groupBy(prints(F.col("chunk")).alias("print"), "chunk").count().select("print", F.sha2("chunk", 256).alias("digest"))
    clashes = saved(named.groupBy("print").agg(F.countDistinct("digest").alias("n")).where("n > 1").select("print"), "clashes")
    if not clashes.isEmpty():
        # some fingerprint stands for different chunks: write recipes anew with (fingerprint, digest) names; SHA-256 of the
        # chunk tells its contents apart
        names = F.transform(F.regexp_extract_all(F.col("t"), F.lit(CHUNKS), F.lit(0)), lambda c: F.concat_ws(":", prints(c).cast("string"), F.sha2(c, 256)))
        rows = saved(source.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.sha2(F.concat_ws(",", names), 256).alias("recipe"), F.octet_length("t").cast("long").alias("n_bytes"), *own), "lists")
        many = saved(rows.groupBy("recipe", "n_bytes").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).where("n > 1").select(F.col("recipe").alias("r"), F.col("n_bytes").alias("b"), "n", "top"), "named")
    joined = rows.join(many, (rows.recipe == many.r) & (rows.n_bytes == many.b), "left")
    sure = joined.select("doc_id", F.coalesce("top", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "text_sha256", *own)
    return sure.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256", *own)
