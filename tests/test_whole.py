"""Features over whole tables, against plain Python."""

from datetime import datetime
from html import unescape

import duckdb

from tonearm.catalog import ORACLE, QUERIES
from tonearm.sources import tables as S

DIR = "/root/testdata/sf0.001"


def test_escaped_pages_hold_the_whole_text(spark):
    html = {r.page_id: r.html for r in S.table(spark, DIR, "pages").collect()}
    got = {r.page_id: r.escaped for r in QUERIES["names_and_escapes"](spark, DIR).collect()}
    assert max(map(len, html.values())) > 200 and set(got) == set(html)
    for k, t in html.items():
        assert not set(got[k]) & set("<>\"'") and unescape(got[k]) == t


def test_enqueue_meets_every_active_job(spark):
    jobs = S.jobs(spark, DIR).select("id", "kind", "dedup_key", "status", "traceparent").collect()
    active = {}
    for r in sorted(jobs, key=lambda r: -r.id):
        if r.status in ("pending", "running"):
            active[r.kind, r.dedup_key] = (r.id, r.traceparent)
    got = {(r.kind, r.dedup_key): r for r in QUERIES["enqueue"](spark, DIR).collect()}
    known = {(r.kind, r.dedup_key) for r in jobs}
    assert set(got) == known | {(k, f"new:{v}") for k, v in known}
    assert {k: (r.job_id, r.traceparent) for k, r in got.items() if not r.fresh} == active
    fresh = sorted(r.job_id for r in got.values() if r.fresh)
    assert fresh == list(range(max(r.id for r in jobs) + 1, max(r.id for r in jobs) + 1 + len(fresh)))


def test_tracks_resolve_for_their_owner_only(spark):
    owner = {r.playlist_id: r.user_id for r in S.playlists(spark, DIR).collect()}
    members = {(r.playlist_id, r.track_id) for r in S.members(spark, DIR).collect()}
    tracks = {r.track_id: r.hash for r in S.tracks(spark, DIR).collect()}
    got = [tuple(r) for r in QUERIES["resolve_tracks"](spark, DIR).collect()]
    assert sorted(got) == sorted({(owner[p], t, tracks[t]) for p, t in members if p in owner and t in tracks})
    got = [tuple(r) for r in QUERIES["resolve_any_owner"](spark, DIR).collect()]
    assert sorted(got) == sorted({(t, tracks[t]) for p, t in members if p in owner and t in tracks})


def test_pages_of_the_whole_listing(spark):
    tracks = {r.track_id: r.title for r in S.tracks(spark, DIR).collect()}
    rows = sorted(S.user_tracks(spark, DIR).collect(), key=lambda r: (-r.added_at.toordinal(), r.user_id, r.track_id))
    got = [tuple(r) for r in QUERIES["recent_tracks"](spark, DIR).collect()]
    assert got == [(r.user_id, r.track_id, tracks[r.track_id]) for r in rows if r.track_id in tracks][20:120]
    of_users = {}
    for r in rows:
        of_users.setdefault(r.user_id, []).append(r.track_id)
    pages = {(r.user_id, r.place): r.track_id for r in QUERIES["library_page"](spark, DIR).collect()}
    assert pages == {(u, k + 1): t for u, own in of_users.items() for k, t in enumerate(own[20:120])}


def test_device_files_agree(spark):
    """The page file's numbers are the library's: a playlist's entries name the contents of its own user."""
    contents = {(r.user_id, r.content_id) for r in QUERIES["device_contents"](spark, DIR).collect()}
    lists = {(r.user_id, r.playlist_id): r.name for r in QUERIES["device_playlists"](spark, DIR).collect()}
    entries = QUERIES["device_playlist_contents"](spark, DIR).collect()
    assert all((r.user_id, r.content_id) in contents and (r.user_id, r.playlist_id) in lists for r in entries)
    for user in {u for u, _ in lists}:
        names = [lists[u, n] for u, n in sorted(lists) if u == user]
        assert names == sorted(names)


def odd_library(at, spark):
    """Tables in which user 2 has a playlist without members, tracks 7 and 8 are in no table of tracks, track 5 is there twice,
    user 4 has no named playlist and some owners are unknown."""
    tables = {
        "customer": ("c_custkey long, c_name string", [(1, "a"), (2, "b")]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(5, "five", "x", "t", 3, 9.0), (5, "five", "x", "t", 3, 9.0), (6, "six", "y", "t", 4, 8.0)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string", [(k, user, datetime(2020, 1, 1), name) for k, user, name in ((10, 1, "one"), (11, 1, "two"), (12, 2, "none"), (13, 3, "gone"), (14, 4, ""), (15, None, "of nobody"), (16, 1, "empty"))]),
        "lineitem": ("l_orderkey long, l_partkey long", [(10, 5), (10, 5), (10, 7), (11, 6), (11, 5), (13, 8), (14, 6), (15, 6)]),
        "events": ("event_id long, user_id long, event_type string, ts timestamp, props string", [(1, 1, "view", datetime(2020, 1, 1), "")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    db = duckdb.connect()
    for name in tables:
        db.execute(f"create view {name} as select * from '{at}/{name}.parquet/*.parquet'")
    return lambda query: (sorted(map(repr, map(tuple, QUERIES[query](spark, str(at)).collect()))), sorted(map(repr, db.execute(ORACLE[query]).fetchall())))


def test_every_owner_has_an_identity(spark, tmp_path):
    got, want = odd_library(tmp_path, spark)("device_identity")
    assert got == want and len(got) == 5


def test_strongest_lags_of_odd_clips(spark, tmp_path):
    """Against the SQL: repeated and unknown ids, unknown samples, clips too short, two lags almost level; and no row for each sample."""
    level = [0.0] * 40
    level[0], level[4], level[7] = 1.0, 3.6, 0.100000001 * 33
    wave = lambda n, k: [((i * k) % 11 - 5) / 4 for i in range(n)]
    rows = [(1, level), (2, wave(64, 3)), (3, wave(64, 5)), (3, wave(50, 7)), (3, wave(3, 2)), (4, wave(4, 3)), (5, wave(5, 3)), (6, []), (7, None), (8, [None] * 12), (9, [None, 1.0] * 10), (None, wave(64, 3)), (10, [None, *wave(40, 3)]), (10, wave(41, 4)), (11, wave(64, 9)), (11, wave(64, 9))]
    rows += [(k, wave(64, k % 10 + 1)) for k in range(20, 60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    for name in ("customer", "part", "orders", "lineitem", "events"):
        db.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in db.execute(ORACLE["strongest_lags"]).fetchall()}
    for size in ("10000", "3"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = QUERIES["strongest_lags"](spark, str(tmp_path))
            got = found.collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(want) and {r.vec_id: (r.lag, r.power) for r in got} == want
    assert want[1] == (4, 0.100000001) and want[8] == (None, None) and not {4, 6, 7} & set(want)
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_rows_of_every_file_are_counted(spark, tmp_path):
    """Against the SQL; no file leaves the worker that wrote it."""
    got, want = odd_library(tmp_path, spark)("page_row_counts")
    assert got == want
    assert "content" not in QUERIES["page_row_counts"](spark, DIR)._jdf.queryExecution().toString()


def test_neighbours_files_are_compared_where_they_are_written(spark):
    """Against files that are written by themselves, over the ends of blocks."""
    from tonearm.operators.device import BLOCK, page_diffs
    from tonearm.plans.device import page_files

    files = spark.createDataFrame(page_files(spark, DIR).collect(), "user_id long, content binary")
    want = page_diffs(files, files.selectExpr("user_id - 1 as user_id", "content"), "user_id").collect()
    found = QUERIES["page_file_diffs"](spark, DIR)
    got = found.collect()
    assert sorted(got) == sorted(want) and len({r.user_id // BLOCK for r in got if r.user_id % BLOCK == BLOCK - 1}) > 1
    assert "content" not in found._jdf.queryExecution().toString()
