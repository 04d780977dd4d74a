"""Readers, and the library's tables as selections over the sample tables."""

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of audio files.
AUDIO = ("mp3", "flac", "wav", "aiff", "aif", "m4a", "aac")
#: Job status by the event type that stands for it.
STATUS = {"signup": "pending", "view": "running", "purchase": "succeeded", "error": "failed", "click": "dead"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_of(key):
    """A 16-digit content hash from a number."""
    return F.lpad(F.lower(F.hex(key)), 16, "0")


def users(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))


def tracks(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("track_id"), hash_of(F.col("p_partkey")).alias("hash"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))


def playlists(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("playlist_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("created_at"))


def members(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("playlist_id"), F.col("l_partkey").alias("track_id")).distinct()


def user_tracks(spark, d):
    own = playlists(spark, d).join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("playlist_id"), F.col("l_partkey").alias("track_id")), "playlist_id")
    return own.groupBy("user_id", "track_id").agg(F.min("created_at").alias("added_at"))


def jobs(spark, d):
    e = table(spark, d, "events")
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("event_type")]
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") % 2).alias("kind"), F.col("user_id").cast("string").alias("dedup_key"), F.col("props").alias("payload"), status.alias("status"), (F.col("event_id") % 7).cast("int").alias("attempts"), F.lit(5).alias("max_attempts"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 300 seconds")).alias("locked_until"), F.concat_ws("-", F.lit("00"), F.md5(F.col("event_id").cast("string")), F.substring(F.md5("event_type"), 1, 16), F.lit("01")).alias("traceparent"))


def artifacts(spark, d):
    return table(spark, d, "labels").select("doc_id", "quality", "toxic")


def inside(location: str) -> str:
    """A relative path that stays under its root; anything else is refused."""
    if not location or location.startswith("/") or any(p in ("", ".", "..") for p in location.split("/")):
        raise ValueError(f"not a path under the root: {location!r}")
    return posixpath.normpath(location)


def blobs(spark: SparkSession, root: str, extensions: tuple = AUDIO, recursive: bool = True) -> DataFrame:
    """Files under `root`, or right in it, by extension of any case, sorted by path: path, length, modificationTime, content."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    depth = F.size(F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/"))
    found = read.load(root).where(F.lower(F.substring_index("path", ".", -1)).isin(*extensions))
    return (found if recursive else found.where(depth == 1)).orderBy("path")


def blob(spark: SparkSession, root: str, location: str) -> DataFrame:
    """One file by its path under `root`."""
    return spark.read.format("binaryFile").load(f"{root}/{inside(location)}")
