"""Decoding of PCM files (WAV and AIFF), their tags, and the analysis of a file as a whole. Compressed formats need a decoder
that isn't at hand; a file of such a format has no analysis."""

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import signal as G
from .binary import content_hash

#: Most samples that are kept, and frames that the decoder hands over at once.
MOST, PACKET = 12_500_000, 1152
#: Tag by the name of its chunk; fixed values of the formats.
TAGS = {b"INAM": "title", b"IART": "artist", b"IPRD": "album", b"IGNR": "genre", b"ICRD": "date", b"ITRK": "track", b"NAME": "title", b"AUTH": "artist"}
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def _chunks(data: bytes, at: int, end: int, order: str):
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from(order + "I", data, at + 4)[0]
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("utf-8", "replace")


def parse(data: bytes) -> dict | None:
    """rate, channels, bits, float, raw sample bytes, byte order and tags of a WAV or AIFF file; None for anything else."""
    out: dict = {"tags": {}, "raw": b""}
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        for name, a, b in _chunks(data, 12, len(data), "<"):
            if name == b"fmt " and b - a >= 16:
                code, out["channels"], out["rate"], _, _, out["bits"] = struct.unpack_from("<HHIIHH", data, a)
                if code == EXTENSIBLE and b - a >= 26:
                    code = struct.unpack_from("<H", data, a + 24)[0]
                out |= {"float": code == FLOAT, "known": code in (PCM, FLOAT), "order": "<"}
            elif name == b"data":
                out["raw"] = data[a:b]
            elif name == b"LIST" and data[a : a + 4] == b"INFO":
                for tag, x, y in _chunks(data, a + 4, b, "<"):
                    if tag in TAGS:
                        out["tags"][TAGS[tag]] = _text(data[x:y])
    elif data[:4] == b"FORM" and data[8:12] == b"AIFF":
        for name, a, b in _chunks(data, 12, len(data), ">"):
            if name == b"COMM" and b - a >= 18:
                out["channels"], _, out["bits"] = struct.unpack_from(">HIH", data, a)
                power, whole = struct.unpack_from(">HQ", data, a + 8)
                out |= {"rate": int(math.ldexp(whole, (power & 0x7FFF) - 16383 - 63)), "float": False, "known": True, "order": ">"}
            elif name == b"SSND":
                out["raw"] = data[a + 8 : b]
            elif name in TAGS:
                out["tags"][TAGS[name]] = _text(data[a:b])
    return out if out.get("rate") and out.get("channels") else None


def mono(sound: dict, most: int = MOST) -> tuple[np.ndarray, float]:
    """The mean of the channels as 32-bit floats in -1 to 1, and the seconds of the whole sound. Packets are added while fewer
    than `most` samples are kept, so the last one may go over. Widths other than 16, 24 and 32 bits have no samples."""
    width, channels = sound["bits"] // 8, sound["channels"]
    frames = len(sound["raw"]) // max(1, width * channels)
    seconds, keep = frames / sound["rate"], min(frames, -(-most // PACKET) * PACKET)
    raw, order = sound["raw"][: keep * width * channels], sound["order"]
    if not sound["known"] or (sound["float"] and width != 4) or width not in (2, 3, 4):
        return np.zeros(0, np.float32), seconds
    if sound["float"]:
        x = np.frombuffer(raw, order + "f4").astype(np.float32)
    elif width == 2:
        x = np.frombuffer(raw, order + "i2").astype(np.float32) / np.float32(32768)
    elif width == 4:
        x = np.frombuffer(raw, order + "i4").astype(np.float32) / np.float32(2**31)
    else:
        own = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        own = own if order == "<" else own[:, ::-1]
        x = (own[:, 0].astype(np.int32) << 8 | own[:, 1].astype(np.int32) << 16 | own[:, 2].astype(np.int32) << 24).astype(np.float32) / np.float32(2**31)
    return x.reshape(-1, channels).sum(1, dtype=np.float32) / np.float32(channels), seconds


def read_tags(tags: dict) -> dict:
    """title, artist, album, genre, the year of the date's first four characters, and the track number."""
    number = lambda s: int(s) if s and s.strip().isdigit() else None
    return {k: tags.get(k) for k in ("title", "artist", "album", "genre")} | {"year": number((tags.get("date") or "")[:4]), "track_number": number(tags.get("track"))}


def bitrate(bits: int | None, depth: int, rate: int) -> int:
    if bits:
        return bits * rate // 1000
    return rate * depth * 2 // 1000 if depth in (16, 24) else 320


def wav(samples: np.ndarray, rate: int, channels: int = 1, tags: dict | None = None) -> bytes:
    """A 16-bit WAV file of interleaved samples in -1 to 1."""
    raw = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    body = b"WAVE" + chunk(b"fmt ", struct.pack("<HHIIHH", PCM, channels, rate, 2 * rate * channels, 2 * channels, 16))
    if tags:
        body += chunk(b"LIST", b"INFO" + b"".join(chunk(name, text.encode() + b"\0") for name, text in tags.items()))
    body += chunk(b"data", raw)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def analysed(data: bytes, fallback_title: str | None = None, most: int = MOST) -> dict | None:
    """What a file's analysis holds. Without tags the title is the fallback or unknown, the artist unknown."""
    sound = parse(data)
    if sound is None:
        return None
    x, seconds = mono(sound, most)
    tags, rate = read_tags(sound["tags"]), sound["rate"]
    bpm, first = G.tempo(x, rate), G.first_beat_ms(x, rate)
    return tags | {
        "title": tags["title"] or fallback_title or "Unknown Title", "artist": tags["artist"] or "Unknown Artist",
        "duration_secs": seconds, "sample_rate": rate, "bit_depth": sound["bits"], "bitrate": bitrate(sound["bits"], sound["bits"], rate), "bpm": bpm, "first_beat_ms": first,
        "beat_grid": G.beat_grid(bpm, first, seconds * 1000), "preview": G.preview(x), "color_preview": G.color_preview(x, rate), "detail": G.detail(x, rate, seconds),
        "file_size": len(data), "file_hash": content_hash(data),
    }


ANALYSIS = "title string, artist string, album string, genre string, year int, track_number int, duration_secs double, sample_rate int, bit_depth int, bitrate int, bpm double, first_beat_ms double, file_size long, file_hash string, n_beats int, n_preview int, n_color int, n_detail int"


def analyses(files: DataFrame) -> DataFrame:
    """One row for each row of `files` (key, title, content): key and the columns of ANALYSIS, null where the file can't be
    decoded. A file is analysed in one task: it is one value."""
    fields = [f.split()[0] for f in ANALYSIS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for key, title, content in zip(pdf["key"], pdf["title"], pdf["content"], strict=True):
                got = analysed(bytes(content), title)
                if got:
                    got |= {"n_beats": len(got["beat_grid"]), "n_preview": len(got["preview"]), "n_color": len(got["color_preview"]), "n_detail": len(got["detail"])}
                rows.append((key, *[(got or {}).get(f) for f in fields]))
            yield pd.DataFrame(rows, columns=["key", *fields])

    return files.select("key", "title", "content").mapInPandas(run, f"key {dict(files.dtypes)['key']}, {ANALYSIS}")
