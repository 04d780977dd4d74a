"""Registration of queries with the SQL that gives the same rows."""

QUERIES: dict = {}
ORACLE: dict = {}

#: The library's tables in SQL, as in sources.tables.
TABLES = """
users as (select c_custkey as user_id, c_name as username from customer),
tracks as (select p_partkey as track_id, printf('%016x', p_partkey) as hash, p_name as title, p_brand as artist from part),
playlists as (select o_orderkey as playlist_id, o_custkey as user_id, o_orderpriority as name, o_orderdate as created_at from orders),
members as (select distinct l_orderkey as playlist_id, l_partkey as track_id from lineitem),
user_tracks as (select o_custkey as user_id, l_partkey as track_id, min(o_orderdate) as added_at from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
numbered as (select user_id, track_id, row_number() over (partition by user_id order by track_id) as content_id from user_tracks),
listed as (select user_id, playlist_id, name, row_number() over (partition by user_id order by name, created_at, playlist_id) as number from playlists where name <> ''),
jobs as (select event_id as id, event_id % 2 as kind, cast(user_id as varchar) as dedup_key, props as payload,
  case event_type when 'signup' then 'pending' when 'view' then 'running' when 'purchase' then 'succeeded' when 'error' then 'failed' when 'click' then 'dead' end as status,
  cast(event_id % 7 as int) as attempts, 5 as max_attempts, ts as created_at, ts + interval 300 second as locked_until,
  concat('00-', md5(cast(event_id as varchar)), '-', substr(md5(event_type), 1, 16), '-01') as traceparent from events)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"with {TABLES}\n{sql}"
        return f

    return add
