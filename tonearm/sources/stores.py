"""Files of a shared file system: a sink that never shows half a file, bundles of artifacts by content hash, and snapshots of
several tables at once. Roots are paths that driver and executors share."""

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import inside

#: A file that is being written, and the sign that a bundle is whole.
PARTIAL, MARKER, CURRENT = ".part", ".complete", "CURRENT"


def put_file(root: str, path: str, content: bytes) -> int:
    """Writes a file under a name of its own, flushes it to disk and renames it; what fails leaves nothing behind."""
    full = os.path.join(root, inside(path))
    os.makedirs(os.path.dirname(full), exist_ok=True)
    own = f"{full}.{uuid.uuid4().hex}{PARTIAL}"
    try:
        with open(own, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(own, full)
    except BaseException:
        if os.path.exists(own):
            os.remove(own)
        raise
    return len(content)


def write_files(files: DataFrame, root: str) -> tuple[int, int]:
    """Writes rows of path and content under `root`; returns the number of files and of bytes. A task that runs again writes
    the same files anew."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"size": [put_file(root, p, bytes(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]})

    done = files.select("path", "content").mapInPandas(run, "size long").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return done.n, done.size


def bundle_dir(content_hash: str) -> str:
    return f"{content_hash[0:2] or '00'}/{content_hash[2:4] or '00'}/{content_hash}"


def put_bundles(files: DataFrame, root: str) -> DataFrame:
    """Writes bundles, rows of hash, name and content, and returns (hash, written). A bundle's marker comes last; a bundle that
    has its marker stays as it is, so a second put does nothing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["hash"].iloc[0]
        marker = f"{bundle_dir(key)}/{MARKER}"
        fresh = not os.path.isfile(os.path.join(root, marker))
        if fresh:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                put_file(root, f"{bundle_dir(key)}/{name}", bytes(content))
            put_file(root, marker, b"")
        return pd.DataFrame({"hash": [key], "written": [fresh]})

    return files.select("hash", "name", "content").groupBy("hash").applyInPandas(run, "hash string, written boolean")


def complete(hashes: DataFrame, root: str) -> DataFrame:
    """Rows of `hashes` (a column hash) whose bundle is whole."""

    def run(batches):
        for pdf in batches:
            yield pdf[[os.path.isfile(os.path.join(root, bundle_dir(h), MARKER)) for h in pdf["hash"]]]

    return hashes.mapInPandas(run, hashes.schema)


def artifacts(spark: SparkSession, root: str, name: str = "*") -> DataFrame:
    """hash, name and content of the artifacts, those of one name if given; the marker is none."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return read.select(part(-2).alias("hash"), part(-1).alias("name"), "content").where(~F.col("name").startswith("."))


def artifact_names(spark: SparkSession, root: str) -> DataFrame:
    """The sorted names of each bundle's artifacts."""
    return artifacts(spark, root).groupBy("hash").agg(F.sort_array(F.collect_list("name")).alias("names"))


def first_wins(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next snapshot of a table of bundles (put, hash, name, ...): of each hash the bundle that was put first, as a whole."""
    rows = old.unionByName(new)
    first = rows.groupBy("hash").agg(F.min("put").alias("put"))
    return rows.join(first, ["hash", "put"], "left_semi")


def commit(tables: dict[str, DataFrame], root: str) -> str:
    """Writes all tables as one new snapshot under `root` and then points to it: readers see all of them or none."""
    name = f"snapshot-{uuid.uuid4().hex}"
    for table, rows in tables.items():
        rows.write.parquet(f"{root}/{name}/{inside(table)}")
    put_file(root, CURRENT, name.encode())
    return name


def committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the snapshot that was committed last."""
    with open(os.path.join(root, CURRENT)) as f:
        return spark.read.parquet(f"{root}/{f.read()}/{inside(table)}")
