"""The job queue over time."""

from pyspark.sql import functions as F

from ..operators import queue as Q
from ..sources import tables as S
from .base import query

NOW = "2024-01-20 00:00:00"
_RUNNABLE = f"(status in ('pending', 'failed') or (status = 'running' and locked_until < timestamp '{NOW}'))"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("select kind, status, count(*) as n from jobs group by 1, 2")
def job_counts(spark, d):
    return S.jobs(spark, d).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query("select kind, count(*) as total, count(*) filter (status in ('succeeded', 'dead')) as done, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'running') as running, count(*) filter (status = 'succeeded') as succeeded, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'dead') as dead from jobs group by 1")
def job_totals(spark, d):
    c = lambda *s: F.count_if(F.col("status").isin(*s))
    each = ("pending", "running", "succeeded", "failed", "dead")
    return S.jobs(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("total"), c("succeeded", "dead").alias("done"), *[c(s).alias(s) for s in each])


@query("select count(*) as n from jobs where status = 'dead' and kind = 0 and dedup_key in ('1', '2', '3', '5', '8')")
def count_dead(spark, d):
    return S.jobs(spark, d).where((F.col("status") == "dead") & (F.col("kind") == 0) & F.col("dedup_key").isin("1", "2", "3", "5", "8")).agg(F.count(F.lit(1)).alias("n"))


@query("select distinct substr(dedup_key, 2) as url from jobs where status = 'succeeded' and starts_with(dedup_key, '1')")
def completed_keys(spark, d):
    return S.jobs(spark, d).where((F.col("status") == "succeeded") & F.col("dedup_key").startswith("1")).select(F.expr("substring(dedup_key, 2)").alias("url")).distinct()


@query(f"select id, kind, 'running' as status, attempts + 1 as attempts, epoch_us(timestamp '{NOW}' + interval 300 second) as lease_us from (select *, row_number() over (partition by kind order by created_at, id) as n from jobs where {_RUNNABLE}) where n = 1")
def claim(spark, d):
    return Q.claim(S.jobs(spark, d), _now()).select("id", "kind", "status", "attempts", F.unix_micros(F.col("locked_until").cast("timestamp")).alias("lease_us"))


def _requests(spark, d):
    """Every job's key asked for again, and as many keys that are new, each with the trace of its request."""
    old = S.jobs(spark, d).select((F.col("id") * 2).alias("request_id"), "kind", "dedup_key", F.concat(F.lit("request-"), "id").alias("traceparent"))
    return old.union(old.select(F.col("request_id") + 1, "kind", F.concat(F.lit("new:"), "dedup_key"), "traceparent"))


@query(f"""select kind, dedup_key, coalesce(a.id, (select max(id) from jobs) + row_number() over (partition by a.id is null order by request_id)) as job_id, a.id is null as fresh,
  coalesce(a.traceparent, concat('request-', request_id // 2)) as traceparent, epoch_us(timestamp '{NOW}') as updated_us
  from (select kind, dedup_key, min(request_id) as request_id from (select kind, dedup_key, id * 2 as request_id from jobs union all select kind, concat('new:', dedup_key), id * 2 + 1 from jobs) group by 1, 2)
  left join (select kind, dedup_key, min(id) as id, arg_min(traceparent, id) as traceparent from jobs where status in ('pending', 'running') group by 1, 2) a using (kind, dedup_key)""")
def enqueue(spark, d):
    got = Q.enqueue(S.jobs(spark, d), _requests(spark, d), _now())
    return got.select("kind", "dedup_key", "job_id", "fresh", "traceparent", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


_ENDED = f"null::bigint as lease_us, case when status in ('succeeded', 'dead') then epoch_us(timestamp '{NOW}') end as finished_us, epoch_us(timestamp '{NOW}') as updated_us"


def _times(rows):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.select("id", "status", us("locked_until").alias("lease_us"), us("finished_at").alias("finished_us"), us("updated_at").alias("updated_us"), "last_error")


@query(f"select id, status, {_ENDED}, case when status <> 'succeeded' then concat('error ', attempts) end as last_error from (select id, attempts, case when id % 3 = 0 then 'succeeded' when attempts >= max_attempts then 'dead' else 'failed' end as status from jobs where status = 'running')")
def settle(spark, d):
    return _times(Q.settled(S.jobs(spark, d), F.col("id") % 3 == 0, _now(), F.concat(F.lit("error "), "attempts")))


@query(f"select id, status, {_ENDED}, 'gone' as last_error from (select id, 'dead' as status from jobs where kind = 1 and status <> 'succeeded')")
def mark_dead(spark, d):
    return _times(Q.mark_dead(S.jobs(spark, d), (F.col("kind") == 1) & (F.col("status") != "succeeded"), F.lit("gone"), _now()))


@query("select id, string_split(traceparent, '-')[2] as trace_id, string_split(traceparent, '-')[3] as parent_span, 'consumer' as span from jobs where status = 'running' and length(traceparent) = 55")
def queue_traces(spark, d):
    parts = F.split("traceparent", "-")
    return S.jobs(spark, d).where("status = 'running'").where(F.length("traceparent") == 55).select("id", F.element_at(parts, 2).alias("trace_id"), F.element_at(parts, 3).alias("parent_span"), F.lit("consumer").alias("span"))


@query(f"""select worker, case when started > coalesce(ended, timestamp '1970-01-01') then 'busy' else 'idle' end as state,
  case when started > coalesce(ended, timestamp '1970-01-01') then epoch(timestamp '{NOW}') - floor(epoch(started)) < 864000 else epoch(timestamp '{NOW}') - floor(epoch(tick)) < 259200 end as live, claim_ok and store_ok as ready
  from (select user_id as worker, max(ts) filter (event_type = 'view') as started, max(ts) filter (event_type = 'purchase') as ended, max(ts) as tick, arg_max(event_type, ts) <> 'error' as claim_ok, count(*) filter (event_type = 'signup') > 0 as store_ok from events group by 1)""")
def worker_health(spark, d):
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    seen = S.table(spark, d, "events").groupBy(F.col("user_id").alias("worker")).agg(at("view").alias("started"), at("purchase").alias("ended"), F.max("ts").alias("last_tick"), (F.max_by("event_type", "ts") != "error").alias("claim_ok"), (F.count_if(F.col("event_type") == "signup") > 0).alias("store_ok"))
    busy = F.col("started") > F.coalesce("ended", F.lit("1970-01-01").cast("timestamp_ntz"))
    return Q.health(seen.withColumn("job_started", F.when(busy, F.col("started"))), _now(), 864000, 259200).select("worker", "state", "live", "ready")


@query(f"select id, epoch_us(timestamp '{NOW}' + interval 300 second) as lease_us from jobs where status = 'running'")
def heartbeat(spark, d):
    return Q.heartbeat(S.jobs(spark, d), _now()).select("id", F.unix_micros(F.col("locked_until").cast("timestamp")).alias("lease_us"))


@query(f"select id from jobs where status = 'running' and locked_until < timestamp '{NOW}'")
def expired_leases(spark, d):
    return S.jobs(spark, d).where((F.col("status") == "running") & (F.col("locked_until") < _now())).select("id")


@query(f"select event_id from events where timestamp '{NOW}' - ts > interval 24 hour")
def retention_sweep(spark, d):
    return S.table(spark, d, "events").where(F.col("ts") + F.expr("interval 24 hours") < _now()).select("event_id")


@query("select id, cast(json_extract(payload, '$.k') as int) as k from jobs where cast(json_extract(payload, '$.k') as int) = 5")
def payload_owner(spark, d):
    return S.jobs(spark, d).withColumn("k", F.get_json_object("payload", "$.k").cast("int")).where("k = 5").select("id", "k")


@query("select kind, count(*) filter (status in ('succeeded', 'failed', 'dead')) as finished, count(*) filter (status in ('failed', 'dead')) as failed from jobs group by 1")
def job_list_progress(spark, d):
    return S.jobs(spark, d).groupBy("kind").agg(F.count_if(F.col("status").isin("succeeded", "failed", "dead")).alias("finished"), F.count_if(F.col("status").isin("failed", "dead")).alias("failed"))
