"""The leased job queue as pure transitions of a jobs table at a given time."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.order import prefix_sums

ACTIVE = ("pending", "running")


def runnable(as_of: Column) -> Column:
    """Pending, failed, or running past its lease."""
    return F.col("status").isin("pending", "failed") | ((F.col("status") == "running") & (F.col("locked_until") < as_of))


def claim(jobs: DataFrame, as_of: Column, lease_s: int = 300) -> DataFrame:
    """The oldest runnable job of each kind, as it stands once claimed."""
    oldest = F.row_number().over(Window.partitionBy("kind").orderBy("created_at", "id"))
    got = jobs.where(runnable(as_of)).withColumn("_n", oldest).where("_n = 1").drop("_n")
    return got.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "locked_until": as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_s))})


def enqueue(jobs: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """What each requested (kind, dedup_key) gets: job_id, fresh, traceparent and updated_at. Where a job of the key is pending
    or running, that job (the oldest), touched at `as_of`, with the trace that first asked for it; else a new one with the
    trace of its first request. `requests` has request_id, kind, dedup_key and traceparent; new ids follow the largest one in
    the order of first requests."""
    key = ["kind", "dedup_key"]
    active = jobs.where(F.col("status").isin(*ACTIVE)).groupBy(*key).agg(F.min(F.struct("id", "traceparent")).alias("old"))
    asked = requests.groupBy(*key).agg(F.min(F.struct("request_id", "traceparent")).alias("first"))
    joined = asked.join(active, key, "left")
    last = jobs.agg(F.max("id")).first()[0] or 0
    new = prefix_sums(joined.where("old is null").select(*key, "first.request_id", "first.traceparent", F.lit(1).alias("one")), "request_id", "one")
    new = new.select(*key, (F.col("start") + last + 1).alias("job_id"), F.lit(True).alias("fresh"), "traceparent", as_of.alias("updated_at"))
    return new.unionByName(joined.where("old is not null").select(*key, F.col("old.id").alias("job_id"), F.lit(False).alias("fresh"), "old.traceparent", as_of.alias("updated_at")))


def _ended(rows: DataFrame, status: Column, error: Column, as_of: Column) -> DataFrame:
    """Rows with their new status: the lease is gone, and a job that won't run again has its end."""
    over = status.isin("succeeded", "dead")
    return rows.withColumns({"status": status, "locked_until": F.lit(None).cast("timestamp_ntz"), "finished_at": F.when(over, as_of), "updated_at": as_of, "last_error": error})


def settled(jobs: DataFrame, ok: Column, as_of: Column, error: Column | None = None) -> DataFrame:
    """Running jobs after their worker reported: succeeded; or dead once attempts are used up, else failed and to be claimed
    again."""
    failed = F.when(F.col("attempts") >= F.col("max_attempts"), "dead").otherwise("failed")
    return _ended(jobs.where("status = 'running'"), F.when(ok, "succeeded").otherwise(failed), F.when(~ok, F.lit(None).cast("string") if error is None else error), as_of)


def mark_dead(jobs: DataFrame, which: Column, error: Column, as_of: Column) -> DataFrame:
    """Jobs whose work ran elsewhere and failed for good, whatever their status."""
    return _ended(jobs.where(which), F.lit("dead"), error, as_of)


def health(workers: DataFrame, as_of: Column, lease_s: int = 300, idle_s: int = 120) -> DataFrame:
    """`workers` has job_started (null when idle), last_tick, claim_ok and store_ok. A busy worker lives while its job is younger
    than the lease, an idle one while its loop turned lately; it is ready while both database and store answer."""
    age = lambda c: F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col(c).cast("timestamp"))
    busy = F.col("job_started").isNotNull()
    return workers.withColumns({"state": F.when(busy, "busy").otherwise("idle"), "live": F.when(busy, age("job_started") < lease_s).otherwise(age("last_tick") < idle_s), "ready": F.col("claim_ok") & F.col("store_ok")})


def heartbeat(jobs: DataFrame, as_of: Column, lease_s: int = 300) -> DataFrame:
    """Running jobs with their lease extended."""
    return jobs.where("status = 'running'").withColumn("locked_until", as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_s)))


def progress(wanted: DataFrame, done: DataFrame, dead: DataFrame, group: str, key: str) -> DataFrame:
    """Counts for each group of wanted keys: total, done (present), failed (dead rows of its keys), complete."""
    total = wanted.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    have = wanted.join(done.select(key).distinct(), key, "left_semi").groupBy(group).agg(F.count(F.lit(1)).alias("done"))
    lost = wanted.join(dead.select(key), key).groupBy(group).agg(F.count(F.lit(1)).alias("failed"))
    out = total.join(have, group, "left").join(lost, group, "left").na.fill(0, ["done", "failed"])
    return out.withColumn("complete", F.col("done") + F.col("failed") >= F.col("total"))
