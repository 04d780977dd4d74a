"""Reproducible shuffle into shards: a Feistel permutation, with cycle walking, of global row numbers."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, numbered, ranked
from .text import U, mix

ROUNDS = 6


def permuted(row: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """A permutation of 0 .. n - 1. The Feistel network permutes the least even power of two not under n (4 at least, under
    4n); values outside walk on along their cycle until they fall inside, on average under four steps."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = U((1 << half) - 1)
    out = row.astype(U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U(half), out[todo] & low
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ (mix(left, seed * 64 + k) & low), left
            else:
                left, right = right, left ^ (mix(right, seed * 64 + k) & low)
        out[todo] = (left << U(half)) | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


def place(row: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of each global row number: computable anywhere from (n, shards, seed)."""
    at = permuted(row, n, seed)
    return at % shards, at // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """The global row number in a slot: the inverse of `place`."""
    return permuted(np.asarray(slot) * shards + np.asarray(shard), n, seed, back=True)


def sharded(docs: DataFrame, order: list[str], shards: int = 24, seed: int = 1) -> DataFrame:
    """`docs` with columns row_number (0-based, ascending by `order`, nulls first), shard and slot. Counts of shards differ
    by one at most, slots of each have no gap. Rows equal in every `order` column are interchangeable; so give columns that
    tell rows apart. Only `docs`' own columns travel: pass narrow rows and join texts when a shard is written. Columns named
    row_number, shard or slot are replaced. An empty table stays empty."""
    spark = docs.sparkSession
    arrow_limits(spark)
    docs = docs.drop("row_number", "shard", "slot")
    rows, parts = ranked(docs, [F.col(c).asc_nulls_first() for c in order], name="shard-rows")
    n = parts.agg(F.sum("_rows")).first()[0] or 0
    rows = numbered(rows, parts).withColumnRenamed("_at", "row_number").drop("_part", "_place")

    @F.pandas_udf("shard int, slot long")
    def placed(row: pd.Series) -> pd.DataFrame:
        shard, slot = place(row.to_numpy(), n, shards, seed)
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    return rows.withColumn("_to", placed("row_number")).select(*rows.columns, "_to.shard", "_to.slot")


def crc32_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the rows of `docs`, whose ids tell them apart: a folder for each shard, rows by slot. `placed` has the id, shard
    and slot; columns of these names in `docs` give way."""
    joined = docs.drop("shard", "slot").join(placed.select(id_col, "shard", "slot"), id_col)
    joined.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> DataFrame:
    """One row for each row of `docs`: doc_id, size (UTF-8 bytes of the text, 0 for null, plus 8), text_crc32, law 'rows',
    shard, slot and a null grown_shard. Null and repeated ids are rows like others, ordered by id, checksum and size."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8).alias("size"), crc32_of(F.col(text_col)).alias("text_crc32"))
    out = sharded(narrow, ["doc_id", "text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


