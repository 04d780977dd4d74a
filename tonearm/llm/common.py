"""Session helpers shared by the corpus operators."""

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to a Python worker. Texts reach 100 KB and more, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Bounds the Arrow batches of every Python stage that follows in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir or the context's checkpoint folder. A local
    session that names none gets a temporary one; a cluster's must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tonearm-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{shared_dir(spark)}/tonearm/{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it back: lineage ends there and a lost executor costs
    only the tasks it ran."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tonearm_path = path
    return out


def _removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Removes saved tables that nothing reads any more."""
    for table in tables:
        _removed(table.sparkSession, table._tonearm_path)


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application: to be called once results are written."""
    _removed(spark, work_dir(spark))


def small_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """Rows of the driver as a table that only JVMs read. From a list, Spark would have two more Python workers and a daemon of
    their own on each executor copy the rows, which stay beside those of the operators: over 80 MB."""
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema))


def released(spark: SparkSession) -> None:
    """Lets the context cleaner drop shuffle files whose plans are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts_for(df: DataFrame, size, each: int = 64 << 20) -> int:
    """Partitions for rows of `size` bytes (a column): the session's number, or more so that none holds over about `each`."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // each))


def ranked(df: DataFrame, order: list, partitions: int | None = None, name: str = "ranked") -> tuple[DataFrame, DataFrame]:
    """Global order without a single-task window. Returns (rows, parts): `rows` is `df` range-partitioned by `order` and saved,
    with columns `_part` (its place in the order) and `_place` (0-based place in the part); rows that tie on every order
    column are interchangeable. `parts` has `_part` and `_rows`, one row for each partition. `df` is computed once: it is
    saved before its ranges are sampled."""
    first = saved(df, f"{name}-rows")
    n = partitions or parts_for(first, F.lit(64))
    dealt = first.repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = saved(dealt.withColumn("_mono", place).withColumns({"_part": F.shiftright("_mono", 33).cast("int"), "_place": F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_mono"), name)
    dropped(first)
    return rows, rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))


def numbered(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of `ranked` with `_at`, their 0-based place in the whole order."""
    before, starts = 0, []
    for part, n in sorted((r._part, r._rows) for r in parts.collect()):  # a row for each partition
        starts.append((part, before))
        before += n
    return rows.join(F.broadcast(small_table(rows.sparkSession, starts, pa.schema([("_part", pa.int32()), ("_before", pa.int64())]))), "_part").withColumn("_at", F.col("_before") + F.col("_place")).drop("_before")


def range_starts(narrow: DataFrame, n: int) -> list[tuple[int, int]]:
    """The least (at, h) of each of about `n` equal ranges of the rows of `narrow`, in order: a row for each range reaches the
    driver. The second column splits values of the first that many rows share."""
    placed, _ = ranked(narrow.select("at", "h"), [F.col("at"), F.col("h")], n, "ranges")
    firsts = sorted(tuple(r.first) for r in placed.groupBy("_part").agg(F.min(F.struct("at", "h")).alias("first")).collect())
    dropped(placed)
    return firsts


def bucket_of_bounds(at: np.ndarray, h: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """How many of the sorted bounds are not above each (at, h)."""
    first, second = (np.array([b[k] for b in bounds], np.int64) for k in (0, 1))
    low, high = np.searchsorted(first, at, "left"), np.searchsorted(first, at, "right")
    for x, y in set(zip(low[high > low].tolist(), high[high > low].tolist(), strict=True)):  # ids that are bounds themselves
        own = np.flatnonzero((low == x) & (high == y))
        low[own] += np.searchsorted(second[x:y], h[own], "right")
    return low
