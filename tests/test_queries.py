"""Every library query against its SQL on the small tables."""

import duckdb
import pytest

from tonearm.catalog import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages labels".split():
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    rows = [tuple(r) for r in QUERIES[name](spark, DIR).toLocalIterator()]
    if name not in ORACLE:
        assert rows
        return
    df = QUERIES[name](spark, DIR)
    want = db.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_page_files_by_key(spark):
    from tonearm.functions.pagewriter import page_file
    from tonearm.operators.device import page_files

    fixed = {"analyze_path": "/a", "sample_rate": 44100, "bit_depth": 16, "bitrate": 320, "bpm": 120.5, "duration_secs": 61.0, "file_size": 9}
    tracks = [{"device": dev, "id": i, "title": f"t{i}", "artist": f"a{i % 2}" if i % 3 else None, "file_path": f"x/{i}.mp3", **fixed} for dev in ("p", "q") for i in (3, 1, 2)]
    lists = [{"device": "q", "id": 1, "parent_id": 0, "name": "all", "is_folder": False, "track_ids": [2, 3]}]
    schema = "device string, id int, title string, artist string, file_path string, analyze_path string, sample_rate int, bit_depth int, bitrate int, bpm double, duration_secs double, file_size long"
    own = spark.createDataFrame([tuple(t.values()) for t in tracks], schema)
    more = spark.createDataFrame([tuple(x.values()) for x in lists], "device string, id int, parent_id int, name string, is_folder boolean, track_ids array<int>")
    got = {r.device: bytes(r.content) for r in page_files(own, more, "device").collect()}
    by_id = sorted((t for t in tracks if t["device"] == "p"), key=lambda t: t["id"])
    assert got == {"p": page_file(by_id), "q": page_file(by_id, lists)}


def test_page_diffs_by_kind(spark):
    from tonearm.functions.pagewriter import page_file
    from tonearm.operators.device import page_diffs

    fixed = {"analyze_path": "/a", "sample_rate": 44100, "bit_depth": 16, "bitrate": 320, "bpm": 120.5, "duration_secs": 61.0, "file_size": 9, "file_path": "x/1.mp3"}
    track = lambda title: page_file([{"id": 1, "title": title, "artist": "a", **fixed}])
    rows = lambda *c: spark.createDataFrame([(k, x) for k, x in enumerate(c)], "k long, content binary")
    got = page_diffs(rows(track("one"), track("one"), track("one")), rows(track("two"), track("one"), track("one") + bytes(4096)), "k").collect()
    assert {(r.k, r.kind, r.pages, r.runs) for r in got} == {(0, "tracks", 1, 1), (2, "only_right", 1, 0)}
