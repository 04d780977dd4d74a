"""The corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed to their targets and the
result is encoded. Each stage works on all that the one before it kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import exact_dedup, mixing, near_dedup, sp_codec, toxicity
from tonearm.llm.common import saved


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a name for each row, and the name of that column: rows are told apart by it alone, so null ids, repeated ids
    and repeated rows are rows like others. A row of Parquet files is named by its file and place; rows of anything else are
    saved and numbered, which costs a copy. The name begins with a hash of the whole row, so that a choice by the least name
    doesn't hang on files; rows with equal hashes are the same."""
    name = _fresh(docs, "row_number")
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash")
    scan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if scan and "_metadata" not in {c.lower() for c in docs.columns}:
        place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("number")]
        return docs.withColumn(name, F.struct(whole, *place)), name
    own = F.struct(whole, F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("number"))
    return saved(docs.withColumn(name, own), "numbered"), name


def _only(docs: DataFrame, number: str, rows: DataFrame) -> DataFrame:
    """Rows of `docs` whose number is in the column row of `rows`, with the columns they came with but that one."""
    return docs.join(rows.select(F.col("row").alias(number)), number, "left_semi").drop(number)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold, with the model learnt from the labelled ones outside the held-out fold. Every row
    is scored by its own text, whatever its id; a null or empty text has the score of a text without known words. Other
    columns stay as they are. An empty table stays empty."""
    score = toxicity.score_column(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(score(F.col("text")) < toxicity.THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id, a null id being the smallest; of
    several rows with that id the one whose whole row has the least hash. Other columns stay as they are."""
    rows, number = _numbered(docs)
    found = exact_dedup.exact_duplicates(rows, row_col=number).where("kept")
    return _only(rows, number, found.groupBy("text_sha256").agg(F.min("row").alias("row")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id, null ids last; of several rows with that id the one
    whose whole row has the least hash. Texts without words, null ones included, are in no component and stay."""
    rows, number = _numbered(docs)
    found = near_dedup.near_duplicates(rows, row_col=number)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")).alias("first")
    kept = found.where("component is not null").groupBy("component").agg(first).select("first.row")
    return _only(rows, number, kept.union(found.where("component is null").select("row")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice. A null source is a source; null and repeated ids are
    rows like others; a text without words counts nothing and is taken for each complete epoch."""
    rows, number = _numbered(docs)
    copies = mixing.mix_documents(rows, row_col=number).where("copies > 0")
    times = _fresh(rows, "copies")
    joined = rows.join(copies.select(F.col("row").alias(number), F.col("copies").alias(times)), number)
    repeated = joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(f"`{times}`"))))
    return repeated.drop(number, times)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mix: doc_id, n_tokens and ids. A null text has no ids; repeated rows come as often."""
    return sp_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", encode)]

#: SQL can't express the stages of nearest examples, sketches and encoding; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        docs = saved(out, f"pipeline-{name}")
    return docs
