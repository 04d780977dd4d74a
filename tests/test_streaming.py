"""The streaming queue and the XML collection."""

import time
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from tonearm.functions.collection import collection, file_uri
from tonearm.streaming.queue import step, transitions


def test_steps():
    assert step(None, 0, None, "enqueue", 7, 5) == ("pending", 0, 7)
    assert step("running", 1, 7, "enqueue", 8, 5) == ("running", 1, 7)
    assert step("pending", 0, 7, "claim", 8, 5) == ("running", 1, 7)
    assert step("running", 4, 7, "error", 8, 5) == ("failed", 4, 7)
    assert step("running", 5, 7, "error", 8, 5) == ("dead", 5, 7)
    assert step("running", 1, 7, "lost", 8, 5) == ("failed", 1, 7)
    assert step("dead", 5, 7, "enqueue", 9, 5) == ("pending", 0, 9)


def test_stream(spark, tmp_path):
    rows = [(1, 0, "a", "enqueue"), (2, 0, "a", "enqueue"), (3, 0, "a", "claim"), (4, 0, "a", "ok"), (5, 0, "b", "enqueue")]
    schema = "event_id long, kind long, dedup_key string, event string"
    spark.createDataFrame(rows[:3], schema).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = transitions(stream).writeStream.format("memory").queryName("jobs_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame(rows[3:], schema).write.parquet(f"{tmp_path}/in", mode="append")
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.table("jobs_out").select("dedup_key", "event", "status", "job_id", F.col("attempts")).collect())
    assert got == [("a", "claim", "running", 1, 1), ("a", "enqueue", "pending", 1, 0), ("a", "enqueue", "pending", 1, 0), ("a", "ok", "succeeded", 1, 1), ("b", "enqueue", "pending", 5, 0)]


def test_leases_run_out(spark, tmp_path):
    schema = "event_id long, kind long, dedup_key string, event string"
    spark.createDataFrame([(1, 0, "a", "enqueue"), (2, 0, "a", "claim"), (3, 0, "b", "enqueue")], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = transitions(stream, lease_ms=500).writeStream.format("memory").queryName("leases_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:  # with timers there is always another batch, so nothing waits for the last one
        for _ in range(60):
            rows = [tuple(r) for r in spark.table("leases_out").where("event = 'lost'").collect()]
            if rows:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert rows == [(0, "a", 1, "lost", "failed", 1)]


def test_collection():
    track = {"id": 1, "title": 'Say "Hi" <now> & it\'s\nfine', "artist": "A", "path": "/music/a b.mp3", "seconds": 61.4, "bpm": 128.0, "beats": [(1, 0.0, 12800), (2, 468.75, 12800), (3, 937.5, 13000)], "cues": [{"kind": "cue", "time_ms": 1000}, {"kind": "loop", "time_ms": 5875, "loop_ms": 4000, "slot": 1, "comment": "x", "color": (1, 2, 3)}]}
    text = collection([track, {"id": 2, "title": "t", "path": "C:\\m\\x.mp3"}], {"Set": [1], "": [1]}, "p", "2", "c & co")
    root = ET.fromstring(text.split("\n", 1)[1])
    assert 'Name="Say &quot;Hi&quot; &lt;now&gt; &amp; it&apos;s\nfine"' in text and root.find("PRODUCT").attrib == {"Name": "p", "Version": "2", "Company": "c & co"}
    found = root.findall("COLLECTION/TRACK")
    assert [e.get("Inizio") for e in found[0].findall("TEMPO")] == ["0.000", "0.938"] and not len(found[1])
    memory, loop = found[0].findall("POSITION_MARK")
    assert memory.attrib == {"Name": "", "Type": "0", "Start": "1.000", "Num": "-1"}
    assert loop.attrib == {"Name": "x", "Type": "4", "Start": "5.875", "End": "9.875", "Num": "0", "Red": "1", "Green": "2", "Blue": "3"}
    assert [n.get("Name") for n in root.findall("PLAYLISTS/NODE/NODE")] == ["Set"] and len(found[0].attrib) == 25
    assert file_uri("/music/a b.mp3") == "file://localhost/music/a%20b.mp3" and file_uri("a.mp3", "/root/") == "file://localhost/root/a.mp3" and file_uri("C:\\m\\x.mp3") == "file://localhost/C:/m/x.mp3"
