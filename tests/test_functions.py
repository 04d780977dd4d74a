"""Pinned vectors of kernels and encoders."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.functions import audio as AU
from tonearm.functions import binary as B
from tonearm.functions import identity as I
from tonearm.functions import signal as G
from tonearm.functions import tags as A
from tonearm.sources.tables import inside


def lcg(n):
    state, out = 0x2545F4914F6CDD1D, bytearray()
    for _ in range(n):
        state = (state * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)
        out.append(state >> 56)
    return bytes(out)


@pytest.mark.parametrize("n", [0, 1, 1023, (1 << 20) - 1, 1 << 20, (1 << 20) + 1])
def test_content_hash_ignores_chunking(n):
    data = (lcg(5000) * (n // 5000 + 1))[:n]
    for size in (7, 4096, max(n, 1)):
        h = B.ContentHasher()
        for i in range(0, n, size):
            h.update(data[i : i + size])
        assert h.finish() == B.content_hash(data)
    if not n:
        assert B.content_hash(b"") == "c77b3abb6f87acd9"


def test_content_hash_sees_length_beyond_the_window():
    assert B.content_hash(b"a" * (1 << 20)) != B.content_hash(b"a" * ((1 << 20) + 1))


def test_device_strings():
    assert B.device_string("") == b"\x03"
    assert B.device_string("foo") == b"\x09foo"
    assert B.device_string("A") == b"\x05A"
    long = B.device_string("a" * 200)
    assert long[0] == 0x40 and struct.unpack_from("<H", long, 1)[0] == 204
    wide = B.device_string("日本語")
    assert wide[0] == 0x90 and struct.unpack_from("<H", wide, 1)[0] == 10


def test_sections():
    assert B.path_section("/Contents/test.mp3")[8:16] == struct.pack(">II", 16 + 38, 38)
    beats = B.beat_section([(1, 100.0, 12800), (2, 568.75, 12800)])
    assert struct.unpack_from(">I", beats, 20)[0] == 2 and struct.unpack_from(">HHI", beats, 32) == (2, 12800, 568)
    assert len(B.preview_section([(3, 1), (4, 2)])) == 420
    assert B.tiny_preview([(1, 0), (2, 0), (3, 0), (4, 1)])[0] == 36


def test_pages():
    pages = B.packed_pages([b"row0", b"row1", b"row2"])
    page = B.page_bytes(pages[0])
    assert len(page) == 4096 and struct.unpack_from("<H", page, 4096 - 4)[0] == 7
    assert [struct.unpack_from("<H", page, 4096 - 36 + 2 * (15 - i))[0] for i in range(3)] == [0, 4, 8]
    many = B.packed_pages([b"x" * 500] * 20)
    assert sum(map(len, many)) == 20 and all(len(B.page_bytes(p)) == 4096 for p in many)


def test_beat_grid():
    grid = G.beat_grid(128, 100, 10000)
    assert len(grid) == 22 and grid[0] == (1, 100, 12800) and len(G.beat_grid(128, 0, 5000)) == 11


def test_tempo_of_clicks_and_silence():
    rate = 44100
    x = np.zeros(rate * 20, np.float32)
    for k in range(0, len(x), rate // 2):
        x[k : k + 200] = 1
    assert abs(G.tempo(x, rate) - 120) < 1
    assert G.tempo(np.zeros(0), rate) == 120.0
    assert abs(G.tempo(np.zeros(rate * 5), rate) - 100.22727) < 1e-4


def test_nearest_rank_and_preview():
    assert G.nearest_rank(np.arange(400.0)) == 380
    sine = np.sin(np.arange(44100) * 2 * np.pi * 440 / 44100)
    assert len(G.preview(sine)) == 400 and max(h for h, _ in G.preview(sine)) > 0
    assert G.preview(np.zeros(0)) == [(0, 0)] * 400


def test_paths_stay_inside():
    assert inside("ab/c.mp3") == "ab/c.mp3"
    for bad in ("../secret", "/etc", "", "a//b", "a/./b"):
        with pytest.raises(ValueError):
            inside(bad)


def test_color_waveforms():
    from tonearm.functions import tags as A

    rate = 44100
    x = np.sin(np.arange(rate) * 2 * np.pi * 100 / rate).astype(np.float32)
    color, detail = G.color_preview(x, rate), G.detail(x, rate, 1.0)
    assert color.shape == (1200, 6) and (color[:, 3] > color[:, 4]).mean() > 0.9
    assert detail.shape == (150, 4) and detail[:140, 0].min() >= 4 and detail[:, 2].max() <= 1
    assert not G.color_preview(x[:100], rate).any() and not G.detail(np.zeros(0), rate, 0).any() and len(G.detail(np.zeros(0), rate, 0)) == 1
    late = G.detail(x, rate, 2.0)
    assert not late[:150].any() and late[150:].any()
    files = A.tag_files("/Contents/test.mp3", G.beat_grid(128, 0, 1000), G.preview(x), color, detail, 10_000, rate)
    for name, tags in (("DAT", "PPTH PVBR PQTZ PWAV PWV2 PCOB PCOB"), ("EXT", "PPTH PWV3 PCOB PCOB PCO2 PCO2 PWV5 PWV4"), ("2EX", "PPTH PWV7 PWV6 PWVC")):
        raw = files[name]
        assert raw[:4] == b"PMAI" and struct.unpack_from(">II", raw, 4) == (28, len(raw))
        at, found = 28, []
        while at < len(raw):
            found.append(raw[at : at + 4].decode())
            at += struct.unpack_from(">I", raw, at + 8)[0]
        assert at == len(raw) and " ".join(found) == tags
    assert len(A.seek_section(10_000, rate)) == 1620 and len(A.gains()) == 20


def test_detail_sections():
    from tonearm.functions import tags as A

    d = np.array([[5, 3, 7, 20], [1, 1, 1, 1]], np.uint8)
    mono = A.detail_mono(d)
    assert struct.unpack_from(">II", mono, 4) == (24, 26) and struct.unpack_from(">II", mono, 12) == (1, 2)
    assert struct.unpack_from(">H", A.detail_color(d), 24)[0] == 45008
    assert list(A.detail_bands(d)[24:27]) == [58, 35, 81]
    plain, extended = A.no_cues(1)
    assert len(plain) == 24 and len(extended) == 20


def test_page_files():
    from tonearm.functions import pagefile as P

    left = bytearray(2 * 4096)
    right = bytearray(left)
    assert P.diff(left, right)["identical"]
    left[4096 + 0x1B], right[4096 + 0x1B] = 0x34, 0x24
    assert P.diff(left, right)["runs"] == [(1, 0x1B, 0x1B, "flags")]
    right[4096 + 0x1D], right[4096 + 0x40], right[5] = 1, 1, 1
    assert P.diff(left, right)["runs"] == [(0, 5, 5, "fh:page_size"), (1, 0x1B, 0x1D, "flags"), (1, 0x40, 0x40, "heap/row-data")]
    assert P.diff(bytes(3 * 4096), bytes(2 * 4096))["only_left"] == [2]
    header = bytearray(4096)
    struct.pack_into("<III", header, 4, 4096, 0, 9)
    assert P.check(bytes(header)) == ([], []) and P.check(bytes(header), phantom=False)[0]
    assert all(P.check(bad)[0] for bad in (b"", bytes(100), bytes(4097), bytes(4096)))


def device_track(n, **more):
    return {"id": n, "title": f"Track {n}", "artist": "Artist A", "album": "Test Album", "genre": "Electronic", "key": "Am", "file_path": f"Contents/Track {n}.mp3", "analyze_path": f"PIONEER/USBANLZ/P000/{n:08X}/ANLZ0000.DAT", "sample_rate": 44100, "bit_depth": 16, "bitrate": 320, "bpm": 128.0, "duration_secs": 180.0, "file_size": 5_000_000, "year": 2024, "track_number": 1} | more


def test_page_writer():
    from tonearm.functions import pagefile as P
    from tonearm.functions import pagewriter as W

    tracks = [device_track(n, artist=f"Artist {n % 7}", album="x" * 300 if n % 2 else "", label=None) for n in range(1, 101)]
    lists = [{"id": 1, "parent_id": 0, "name": "Crates", "is_folder": True, "track_ids": []}, {"id": 2, "parent_id": 1, "name": "Été", "is_folder": False, "track_ids": [1, 2, 1]}]
    data = W.page_file(tracks, lists)
    pages = len(data) // 4096
    assert len(data) % 4096 == 0 and P.check(data) == ([], []) and P.check(data, phantom=False)[0]
    counts = P.row_counts(data)
    assert [counts[k] for k in range(20)] == [100, 1, 7, 7, 0, 1, 8, 2, 3, 0, 0, 0, 0, 0, 0, 0, 27, 22, 17, 1]
    size, kinds, unused, count, sequence = struct.unpack_from("<5I", data, 4)
    assert (size, kinds, count) == (4096, 20, 100)
    pointers = [struct.unpack_from("<4I", data, 28 + 16 * k) for k in range(20)]
    ends = []
    for kind, spare, first, last in pointers:
        assert data[first * 4096 + 0x1B] == 0x64 and struct.unpack_from("<I", data, first * 4096 + 4)[0] == first
        if last > first:
            assert spare >= pages and struct.unpack_from("<I", data, last * 4096 + 12)[0] == spare
            ends.append(spare)
        else:
            assert spare == first + 1 and not any(data[spare * 4096 : spare * 4096 + 4096])
        assert struct.unpack_from("<I", data, first * 4096 + 0x2C)[0] == (first + 1 if last > first else 0x03FFFFFF)
    assert ends == list(range(pages, unused))
    filled = [p for p in range(1, pages) if data[p * 4096 + 0x1B] in (0x24, 0x34)]
    assert [struct.unpack_from("<I", data, p * 4096 + 16)[0] for p in filled] == list(range(2, sequence))
    rows = []
    for p in range(pointers[0][2] + 1, pointers[0][3] + 1):
        n = data[p * 4096 + 0x18] & 0x7F
        rows += [p * 4096 + 0x28 + struct.unpack_from("<H", data, p * 4096 + 4096 - 36 * (i // 16 + 1) + 2 * (15 - i % 16))[0] for i in range(n)]
    assert [struct.unpack_from("<I", data, at + 72)[0] for at in rows] == list(range(1, 101))
    at = rows[0]
    assert struct.unpack_from("<I", data, at + 56)[0] == 12800 and struct.unpack_from("<H", data, at + 80)[0] == 2024
    title = at + struct.unpack_from("<21H", data, at + 94)[W.TITLE]
    assert data[title : title + 8] == B.device_string("Track 1")


def test_device_rows():
    from tonearm.functions import pagewriter as W

    assert W.artist_row(3, "Abc") == struct.pack("<HHIBB", 0x60, 0, 3, 3, 10) + B.device_string("Abc")
    assert W.artist_row(3, "é" * 99)[:12] == struct.pack("<HHIBBH", 0x64, 0, 3, 3, 0, 12)
    assert W.album_row(2, "Abc", 5)[:22] == struct.pack("<HHIIIIBB", 0x80, 0, 0, 5, 2, 0, 3, 22)
    assert W.album_row(2, "a" * 200, 5)[:24] == struct.pack("<HHIIIIBBH", 0x84, 0, 0, 5, 2, 0, 3, 0, 24)
    assert W.column_row(7, 135, "YEAR") == bytes([7, 0, 135, 0, 144, 16, 0, 0, 250, 255, 89, 0, 69, 0, 65, 0, 82, 0, 251, 255])
    assert len(W.SYNC_ROW) == 40 and [len(r) for r in (W.PAIR_ROWS, W.MAPPING_ROWS, W.COLUMN_NAMES)] == [22, 17, 27]
    with pytest.raises(ValueError):
        W.page_file([device_track(1, comment="c" * 4000)])


def test_rows_fill_a_page_to_the_last_group():
    small = B.packed_pages([b"x" * 8] * 1000)
    assert len(small[0]) == (4096 - 0x28 - 36 * (len(small[0]) // 16 + 1)) // 8 and sum(map(len, small)) == 1000
    assert [r for page in small for _, r in page] == [b"x" * 8] * 1000


def test_cue_lists():
    cues = [{"kind": "cue", "time_ms": 1000.9}, {"kind": "loop", "time_ms": 2000, "loop_ms": 500, "slot": 2, "comment": "ab"}]
    plain = A.cue_list(cues)
    assert struct.unpack_from(">H", plain, 18)[0] == 2 and len(plain) == 24 + 48 and plain[24:28] == b"PCP\x01"
    assert struct.unpack_from(">5I", plain, 28) == (20, 0, 0, 1000, 0xFFFFFFFF) and struct.unpack_from(">5I", plain, 52) == (20, 2, 4, 2000, 2500)
    more = A.extended_cues(cues)
    assert more[:4] == b"PCO2" and struct.unpack_from(">3IHH", more, 4) == (16, 20 + 62, 1, 0, 1)
    assert more[20:24] == b"PCP2" and struct.unpack_from(">6I", more, 24) == (58, 2, 2, 2000, 2500, 0)
    assert more[56:63] == struct.pack(">I", 3) + b"ab\0" and more[63:71] == bytes([9, 0, 0xE0, 0xFF, 0, 0, 0, 0])
    memory = more[71:]
    assert struct.unpack_from(">3IHH", memory, 4) == (16, 60, 0, 0, 1) and len(memory) == 20 + 36
    assert A.extended_cues([]) == b"" and len(A.cue_list([])) == 24


def test_wav_round_trip():
    x = np.sin(np.arange(8000) / 9).astype(np.float32)
    stereo = np.stack((x, -x / 2), 1).reshape(-1)
    sound = AU.parse(AU.wav(stereo, 4000, 2, {b"INAM": "t", b"IART": "a", b"ICRD": "2019-01-02", b"ITRK": "7"}))
    y, seconds = AU.mono(sound)
    assert seconds == 2.0 and len(y) == 8000 and np.abs(y - (x - x / 2) / 2).max() < 1e-4
    assert AU.read_tags(sound["tags"]) == {"title": "t", "artist": "a", "album": None, "genre": None, "year": 2019, "track_number": 7}
    short, seconds = AU.mono(sound, most=1000)
    assert seconds == 2.0 and len(short) == AU.PACKET and (short == y[: AU.PACKET]).all()
    assert AU.parse(b"ID3 not this") is None and AU.analysed(b"") is None


@pytest.mark.parametrize("bits,pack", [(16, lambda v: struct.pack("<h", int(v * 32768))), (24, lambda v: struct.pack("<i", int(v * 2**31))[1:]), (32, lambda v: struct.pack("<i", int(v * 2**31)))])
def test_sample_widths(bits, pack):
    values = [0.5, -0.25, 0.125, -1.0]
    raw = b"".join(map(pack, values))
    sound = {"rate": 10, "channels": 1, "bits": bits, "float": False, "known": True, "order": "<", "raw": raw, "tags": {}}
    assert np.allclose(AU.mono(sound)[0], values, atol=1e-6)
    big = b"".join(raw[i : i + bits // 8][::-1] for i in range(0, len(raw), bits // 8))
    assert np.allclose(AU.mono(sound | {"raw": big, "order": ">"})[0], values, atol=1e-6)


def test_odd_widths_have_no_samples():
    sound = {"rate": 10, "channels": 1, "bits": 8, "float": False, "known": True, "order": "<", "raw": bytes(20), "tags": {}}
    assert len(AU.mono(sound)[0]) == 0 and AU.mono(sound)[1] == 2.0


def test_aiff():
    comm = struct.pack(">HIH", 1, 4, 16) + struct.pack(">HQ", 16383 + 15, 44100 << (63 - 15))
    ssnd = bytes(8) + struct.pack(">4h", 0, 16384, -16384, 32767)
    chunk = lambda n, b: n + struct.pack(">I", len(b)) + b + b"\0" * (len(b) & 1)
    body = b"AIFF" + chunk(b"NAME", b"abc") + chunk(b"COMM", comm) + chunk(b"SSND", ssnd)
    sound = AU.parse(b"FORM" + struct.pack(">I", len(body)) + body)
    assert sound["rate"] == 44100 and sound["tags"] == {"title": "abc"} and np.allclose(AU.mono(sound)[0], [0, 0.5, -0.5, 1], atol=1e-4)


def test_analysis_composition():
    rate = 4000
    beat = np.zeros(rate * 8, np.float32)
    for k in range(16):
        beat[k * rate // 2 : k * rate // 2 + 200] = 0.9
    got = AU.analysed(AU.wav(beat, rate), "file name")
    assert (got["title"], got["artist"], got["bitrate"], got["bit_depth"]) == ("file name", "Unknown Artist", 64, 16)
    assert 110 < got["bpm"] < 130 and got["duration_secs"] == 8.0 and len(got["preview"]) == 400 and len(got["detail"]) == 1200
    assert got["file_hash"] == B.content_hash(AU.wav(beat, rate)) and AU.analysed(AU.wav(beat, rate))["title"] == "Unknown Title"
    assert (AU.bitrate(None, 16, 44100), AU.bitrate(None, 24, 48000), AU.bitrate(None, 32, 44100), AU.bitrate(16, 16, 44100)) == (1411, 2304, 320, 705)


def test_identity_of_a_device(spark):
    h = 0xCBF29CE484222325
    for b in [1, 0, 0, 0, 2, 0, 0, 0, *"Add é".encode()]:
        h = ((h ^ b) * 0x100000001B3) % 2**64
    data = F.concat(I.id_bytes(F.lit(1)), I.id_bytes(F.lit(2)), I.text_bytes(F.lit("Add é")), I.text_bytes(F.lit("")))
    row = spark.range(1).select(I.seed(data).alias("s"), I.uuid_of(I.seed(data)).alias("u"), I.library_id(I.seed(data)).alias("l"), I.backup_column(F.lit("ab")).alias("b")).first()
    turned = ((h << 17 | h >> 47) % 2**64) ^ 0xA5A5A5A5A5A5A5A5
    assert (row.s % 2**64, row.u, row.l, row.b) == (h, f"{h:016x}{turned:016x}", h & 0x7FFFFFFF, I.backup_json("ab"))


def test_sealed_texts(spark):
    key = F.unhex(F.lit("00" * 32))
    df = spark.range(1).select(I.sealed(F.lit("cookie"), key).alias("p"))
    p = bytes(df.first().p)
    assert len(p) == 12 + 6 + 16
    changed = spark.createDataFrame([(p,), (p[:-1] + bytes([p[-1] ^ 1]),), (p[:5],)], "p binary")
    assert [r.t for r in changed.select(I.opened(F.col("p"), key).alias("t")).collect()] == ["cookie", None, None]


def test_window_hash_is_the_content_hash():
    data = lcg(3000)
    assert B.window_hash(data, len(data)) == B.content_hash(data)
