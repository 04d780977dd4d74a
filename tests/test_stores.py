"""Files, bundles, snapshots, listings and remote folders."""

import json
import os

import pytest

from tonearm.functions import identity as I
from tonearm.operators.device import TABLES
from tonearm.plans.device import page_files
from tonearm.sources import paged, stores
from tonearm.sources import tables as S

DIR = "/root/testdata/sf0.001"


def test_blobs(spark, tmp_path):
    for path in ("b.MP3", "a.flac", "x.txt", "sub/c.wav", "noext"):
        stores.put_file(str(tmp_path), path, path.encode())
    names = lambda df: [r.path.rsplit(str(tmp_path), 1)[1][1:] for r in df.collect()]
    assert names(S.blobs(spark, str(tmp_path))) == ["a.flac", "b.MP3", "sub/c.wav"]
    assert names(S.blobs(spark, str(tmp_path), recursive=False)) == ["a.flac", "b.MP3"]
    assert bytes(S.blob(spark, str(tmp_path), "sub/c.wav").first().content) == b"sub/c.wav"
    for bad in ("../secret", "/etc/passwd", "", "a//b"):
        with pytest.raises(ValueError):
            S.blob(spark, str(tmp_path), bad)


def test_files_appear_whole(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([(f"d{k % 3}/f{k}", bytes([k]) * k) for k in range(30)], "path string, content binary")
    assert stores.write_files(files, str(tmp_path)) == (30, sum(range(30))) == stores.write_files(files, str(tmp_path))
    found = {os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs}
    assert found == {f"d{k % 3}/f{k}" for k in range(30)}
    monkeypatch.setattr(os, "replace", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        stores.put_file(str(tmp_path), "d0/new", b"x")
    assert not [f for f in os.listdir(tmp_path / "d0") if "new" in f]


def test_bundles(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([(h, n, f"{v}{h}{n}".encode()) for h in ("abcd1", "abff2") for n in ("b.json", "a.dat")], "hash string, name string, content binary")
    assert {tuple(r) for r in stores.put_bundles(rows("1"), str(tmp_path)).collect()} == {("abcd1", True), ("abff2", True)}
    assert {r.written for r in stores.put_bundles(rows("2"), str(tmp_path)).collect()} == {False}
    assert {(r.hash, r.name): bytes(r.content) for r in stores.artifacts(spark, str(tmp_path)).collect()} == {(r.hash, r.name): bytes(r.content) for r in rows("1").collect()}
    assert [r.hash for r in stores.artifacts(spark, str(tmp_path), "a.dat").orderBy("hash").collect()] == ["abcd1", "abff2"]
    assert {r.hash: r.names for r in stores.artifact_names(spark, str(tmp_path)).collect()} == {"abcd1": ["a.dat", "b.json"], "abff2": ["a.dat", "b.json"]}
    os.remove(tmp_path / "ab/cd/abcd1" / stores.MARKER)
    hashes = spark.createDataFrame([("abcd1",), ("abff2",), ("none0",)], "hash string")
    assert [r.hash for r in stores.complete(hashes, str(tmp_path)).collect()] == ["abff2"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    stores.commit({"a": spark.range(3), "b": spark.range(4)}, root)
    with pytest.raises(Exception):
        stores.commit({"a": spark.range(9), "b": spark.range(3).selectExpr("assert_true(id < 1)")}, root)
    assert (stores.committed(spark, root, "a").count(), stores.committed(spark, root, "b").count()) == (3, 4)
    stores.commit({"a": spark.range(5), "b": spark.range(6)}, root)
    assert (stores.committed(spark, root, "a").count(), stores.committed(spark, root, "b").count()) == (5, 6)


def test_listing_follows_its_pages(spark, tmp_path):
    titles = [("Deleted video" if k % 10 == 3 else f"t{k}") for k in range(120)]
    for p, token in enumerate(("first", "p1", "p2")):
        items = [{"id": str(k), "title": titles[k]} for k in range(50 * p, min(50 * p + 50, 120))]
        (tmp_path / f"{token}.json").write_text(json.dumps({"items": items} | ({"next": f"p{p + 1}"} if p < 2 else {})))
    spark.dataSource.register(paged.Listing)
    rows = spark.read.format("listing").option("path", str(tmp_path)).load().collect()
    assert [(r.position, r.id, r.title) for r in rows] == [(k, str(k), t) for k, t in enumerate(titles)]
    (tmp_path / "p2.json").write_text(json.dumps({"items": [], "next": "p1"}))
    with pytest.raises(Exception, match="don't end"):
        spark.read.format("listing").option("path", str(tmp_path)).load().collect()


def test_folder_paths(spark):
    folders = spark.createDataFrame([("b", "root", "Music"), ("a", "root", "Music"), ("c", "a", "Live"), ("d", "b", "Live")], "id string, parent string, name string")
    paths = spark.createDataFrame([("/Music/Live/",), ("Music",), ("/",), ("Music/Other/x",), ("Nope/Live",)], "path string")
    got = {r.path: (r.id, r.missing) for r in paged.resolve_paths(folders, paths).collect()}
    assert got == {"/Music/Live/": ("c", None), "Music": ("Music", None), "/": ("root", None), "Music/Other/x": (None, "Other"), "Nope/Live": (None, "Nope")}


def test_export_tree(spark, tmp_path):
    from tonearm.operators.export import export_files, records
    from tonearm.plans.export import export_manifest, export_sources, seeds

    pages = page_files(spark, DIR).where("user_id < 5")
    files = export_files(pages, seeds(spark, DIR).where("user_id < 5"), S.users(spark, DIR).selectExpr("user_id", "username as profile"))
    more = records(export_manifest(spark, DIR).where("user_id < 5"), export_sources(spark, DIR).where("user_id < 5"))
    n, size = stores.write_files(files.unionByName(more).selectExpr("concat(user_id, '/', path) as path", "content"), str(tmp_path))
    users = sorted(os.listdir(tmp_path))
    assert n == 7 * len(users) and len(users) == 5 and size > 5 * 4096
    tree = tmp_path / users[0] / "tree" / "PIONEER"
    assert os.path.getsize(tree / "DEVSETTING.DAT") == 140 and os.path.getsize(tree / "djprofile.nxs") == 160 and os.path.getsize(tree / "rekordbox/export.pdb") % 4096 == 0
    (backup,) = os.listdir(tree / "DeviceLibBackup")
    kept = json.loads((tree / "DeviceLibBackup" / backup).read_text())
    manifest = json.loads((tmp_path / users[0] / "manifest.json").read_text())["entries"]
    assert kept["info"] == [] and len(kept["uuid"]) == 32 and manifest[2]["usb_path"].endswith(backup)
    sources = json.loads((tmp_path / users[0] / "sources.json").read_text())
    raw = [e for e in manifest if e["source"]["kind"] == "raw"]
    assert {e["usb_path"] for e in raw} == set(sources) and (tmp_path / users[0] / "owner").read_text() == users[0]
    assert len(manifest) == 5 + 4 * len(raw)


def test_side_files():
    settings, profile = I.settings_file(), I.profile_file("n" * 40)
    assert len(settings) == 140 and settings[0x68:0x6C] == bytes.fromhex("78563412") and len(profile) == 160 and profile[0x20:0x40] == b"n" * 31 + b"\0"
    assert len(TABLES) == 22 and len(TABLES["content"].split()) == 46
