"""Writer of a device's page file: twenty tables of rows, each an index page and data pages."""

import struct
from collections.abc import Iterable
from functools import cache, lru_cache
from itertools import accumulate

from .binary import GROUP_BYTES, GROUP_ROWS, HEADER, PAGE, device_string, packed_pages, page_bytes

#: Kinds of tables by number, and the fixed words of pages and rows; fixed values of the format.
TRACKS, GENRES, ARTISTS, ALBUMS, LABELS, KEYS, COLORS, TREE, ENTRIES = range(9)
ARTWORK, COLUMNS, PAIRS, MAPPING, SYNC, KINDS = 13, 16, 17, 18, 19, 20
INDEXED = {TRACKS: 19, SYNC: 323}
INDEX_FLAGS, DATA_FLAGS, INDEXED_FLAGS = 0x64, 0x24, 0x34
NO_PAGE, NO_ENTRY, FILL, FIRST_SEQUENCE, NEAR = 0x03FFFFFF, 0x1FFF, 0x1FFFFFF8, 2, 200

#: Names of the colours from 1 on; fixed values of the format.
COLOR_NAMES = ("Pink", "Red", "Orange", "Yellow", "Green", "Aqua", "Blue", "Purple")
#: Kind and name of the browser's columns, numbered from 1; fixed values of the format.
COLUMN_NAMES = (
    (128, "GENRE"), (129, "ARTIST"), (130, "ALBUM"), (131, "TRACK"), (133, "BPM"), (134, "RATING"), (135, "YEAR"), (136, "REMIXER"), (137, "LABEL"),
    (138, "ORIGINAL ARTIST"), (139, "KEY"), (141, "CUE"), (142, "COLOR"), (146, "TIME"), (147, "BITRATE"), (148, "FILE NAME"), (132, "PLAYLIST"), (152, "HOT CUE BANK"),
    (149, "HISTORY"), (145, "SEARCH"), (150, "COMMENTS"), (140, "DATE ADDED"), (151, "DJ PLAY COUNT"), (144, "FOLDER"), (161, "DEFAULT"), (162, "ALPHABET"), (170, "MATCHING"),
)
#: Rows of the two tables of four words; fixed values of the format.
PAIR_ROWS = (
    (1, 1, 0x163, 0), (5, 6, 0x105, 0), (6, 7, 0x163, 0), (7, 8, 0x163, 0), (8, 9, 0x163, 0), (9, 10, 0x163, 0), (10, 11, 0x163, 0), (13, 15, 0x163, 0),
    (14, 19, 0x104, 0), (15, 20, 0x106, 0), (16, 21, 0x163, 0), (18, 23, 0x163, 0), (2, 2, 2, 1), (3, 3, 3, 2), (4, 4, 1, 3), (11, 12, 0x63, 4),
    (17, 5, 0x63, 5), (19, 22, 0x63, 6), (20, 18, 0x63, 7), (27, 26, 0x263, 8), (24, 17, 0x63, 9), (22, 27, 0x63, 10),
)
MAPPING_ROWS = (
    (1, 6, 1, 0), (21, 7, 1, 0), (14, 8, 1, 0), (8, 9, 1, 0), (9, 10, 1, 0), (10, 11, 1, 0), (15, 13, 1, 0), (13, 15, 1, 0), (23, 16, 1, 0), (22, 17, 1, 0),
    (25, 0, 256, 0), (26, 1, 512, 0), (2, 2, 768, 0), (3, 3, 1024, 0), (5, 4, 1280, 0), (6, 5, 1536, 0), (11, 12, 1792, 0),
)
SYNC_ROW = struct.pack("<H10xB10s2BB4sB9x", 0x0280, 0x17, b"2025-01-01", 0x19, 0x1E, 0x0B, b"1000", 3)

#: Places of a track's 21 strings that are ever set; fixed values of the format.
RELEASED, ANALYSIS, COMMENT, TITLE, FILE, PATH, STRINGS = 11, 14, 16, 17, 19, 20, 21
#: A track's fixed fields, the places of its strings, and an empty string.
TRACK, PLACES, NO_STRING = struct.Struct("<HHIIIII4x12I6HBBHH"), struct.Struct(f"<{STRINGS}H"), device_string("")


class Ids:
    """Numbers from 1 in order of first sight; nothing and the empty name are 0."""

    def __init__(self):
        self.by_key: dict = {}

    def of(self, name: str | None, *more) -> int:
        return self.by_key.setdefault((name, *more), len(self.by_key) + 1) if name else 0

    def rows(self, pack) -> list[bytes]:
        return [pack(i, *key) for key, i in self.by_key.items()]


def named(i: int, name: str) -> bytes:
    """Genres, labels and artwork."""
    return struct.pack("<I", i) + device_string(name)


def key_row(i: int, name: str) -> bytes:
    return struct.pack("<II", i, i) + device_string(name)


def color_row(i: int, name: str) -> bytes:
    return struct.pack("<4xBB2x", i, i) + device_string(name)


def column_row(i: int, kind: int, name: str) -> bytes:
    row = struct.pack("<HH", i, kind) + device_string(f"￺{name}￻")
    return row + b"\0" * (-len(row) % 4)


def _with_name(subtype: int, fixed: bytes, name: str) -> bytes:
    """The name after the fixed part, its place in one byte, or in two more if it is long."""
    text, at = device_string(name), 4 + len(fixed) + 2
    place = struct.pack("<BB", 3, at) if len(text) <= NEAR else struct.pack("<BBH", 3, 0, at + 2)
    return struct.pack("<HH", subtype | (0 if len(text) <= NEAR else 4), 0) + fixed + place + text


def artist_row(i: int, name: str) -> bytes:
    return _with_name(0x60, struct.pack("<I", i), name)


def album_row(i: int, name: str, artist: int) -> bytes:
    return _with_name(0x80, struct.pack("<4xII4x", artist, i), name)


def track_row(track: dict, ids: dict) -> bytes:
    """Fixed fields, the places of the strings, the strings. `ids` numbers artwork, key, label, genre, album and artist."""
    year, path = track.get("year"), track["file_path"]
    texts = {RELEASED: f"{year}-01-01" if year is not None else "", ANALYSIS: "/" + track["analyze_path"].lstrip("/"), COMMENT: track.get("comment") or "", TITLE: track["title"], FILE: path.rsplit("/", 1)[-1], PATH: path}
    strings = [NO_STRING] * STRINGS
    for k, text in texts.items():
        strings[k] = device_string(text)
    head = TRACK.pack(
        0x24, 0x20, 0xC0700, track["sample_rate"], 0, track["file_size"] & 0xFFFFFFFF, 0, ids["artwork"], ids["key"], 0, ids["label"], 0, track["bitrate"], track.get("track_number") or 0, max(0, int(track["bpm"] * 100)),
        ids["genre"], ids["album"], ids["artist"], track["id"], 1, 0, year or 0, track["bit_depth"], min(max(0, int(track["duration_secs"])), 0xFFFF), 41, 0, 0, 1, 3,
    )
    places = accumulate(map(len, strings[:-1]), initial=TRACK.size + 2 * STRINGS)
    return head + PLACES.pack(*places) + b"".join(strings)


def tree_row(place: int, playlist: dict) -> bytes:
    return struct.pack("<5I", playlist["parent_id"], 0, place, playlist["id"], int(playlist["is_folder"])) + device_string(playlist["name"])


def table_rows(tracks: Iterable[dict], playlists: Iterable[dict]) -> list[list[bytes]]:
    """Rows of each kind of table. Names get ids in the order of the tracks; an album is one by name and artist."""
    seen = {k: Ids() for k in ("artist", "album", "genre", "label", "key", "artwork")}
    rows: list[list[bytes]] = [[] for _ in range(KINDS)]
    for t in tracks:
        ids = {k: seen[k].of(t.get(k)) for k in seen if k != "album"}
        rows[TRACKS].append(track_row(t, ids | {"album": seen["album"].of(t.get("album"), ids["artist"])}))
    for place, p in enumerate(playlists):
        rows[TREE].append(tree_row(place, p))
        if not p["is_folder"]:
            rows[ENTRIES] += [struct.pack("<III", n, i, p["id"]) for n, i in enumerate(p["track_ids"], 1)]
    for kind, name, pack in ((GENRES, "genre", named), (ARTISTS, "artist", artist_row), (ALBUMS, "album", album_row), (LABELS, "label", named), (KEYS, "key", key_row), (ARTWORK, "artwork", named)):
        rows[kind] = seen[name].rows(pack)
    for kind, some in fixed_rows().items():
        rows[kind] = some
    return rows


@cache
def fixed_rows() -> dict[int, list[bytes]]:
    """Rows of the tables that are the same in every file."""
    rows = {COLORS: [color_row(i, name) for i, name in enumerate(COLOR_NAMES, 1)], COLUMNS: [column_row(i, kind, name) for i, (kind, name) in enumerate(COLUMN_NAMES, 1)]}
    rows |= {kind: [struct.pack("<4H", *r) for r in some] for kind, some in ((PAIRS, PAIR_ROWS), (MAPPING, MAPPING_ROWS))}
    return rows | {SYNC: [SYNC_ROW]}


@cache
def index_slots(first: int | None) -> bytes:
    slots = [FILL] * ((PAGE - 20 - 0x3C) // 4)
    if first is not None:
        slots[0] = first
    return struct.pack(f"<{len(slots)}I", *slots)


@lru_cache(4096)
def index_page(page: int, kind: int, filled: bool) -> bytes:
    indexed = kind in INDEXED
    head = struct.pack("<4x4I7xB4x", page, page // 2, page + 1, 1, INDEX_FLAGS)
    head += struct.pack("<IHHIIIIHH", 1 if indexed else NO_ENTRY << 16 | NO_ENTRY, 0x3EC, indexed, page, page + 1 if filled else NO_PAGE, NO_PAGE, 0, indexed, NO_ENTRY)
    return (head + index_slots(INDEXED.get(kind))).ljust(PAGE, b"\0")


def data_page(page: int, kind: int, rows: list[tuple[int, bytes]], following: int, sequence: int) -> bytes:
    out, n = bytearray(page_bytes(rows)), len(rows)
    used = rows[-1][0] + len(rows[-1][1])
    free = max(0, PAGE - (n // GROUP_ROWS + 1) * GROUP_BYTES - HEADER - used)
    flags = INDEXED_FLAGS if kind in INDEXED else DATA_FLAGS
    struct.pack_into("<4I4xIHHH", out, 4, page, kind, following, sequence, flags << 24 | 4 * n << 11 | n & 0x7FF, free, used, n)
    return bytes(out)


@cache
def fixed_pages(kind: int) -> list[list[tuple[int, bytes]]]:
    return packed_pages(fixed_rows()[kind])


@lru_cache(4096)
def fixed_page(page: int, kind: int, k: int, following: int, sequence: int) -> bytes:
    """The `k`th data page of a table that is the same in every file."""
    return data_page(page, kind, fixed_pages(kind)[k], following, sequence)


NO_ROWS = bytes(PAGE)


def page_file(tracks: Iterable[dict], playlists: Iterable[dict] = ()) -> bytes:
    """The whole file. A table with rows ends its chain at a page of its own past the file's end, set aside for growth; one
    without rows has an empty page. Tracks come as dicts with id, title, artist, file_path, analyze_path, sample_rate,
    bit_depth, bitrate, bpm, duration_secs and file_size, and if known album, genre, label, key, artwork, year, comment and
    track_number; playlists with id, parent_id, name, is_folder and track_ids."""
    tracks = list(tracks)
    tables = [fixed_pages(kind) if kind in fixed_rows() else packed_pages(rows) for kind, rows in enumerate(table_rows(tracks, playlists))]
    starts, at = [], 1
    for pages in tables:
        starts.append(at)
        at += 1 + max(1, len(pages))
    growth, sequence, body, pointers = at, FIRST_SEQUENCE, [], b""
    for kind, (start, pages) in enumerate(zip(starts, tables, strict=True)):
        body.append(index_page(start, kind, bool(pages)))
        spare = growth if pages else start + 1
        for k, rows in enumerate(pages, 1):
            following = spare if k == len(pages) else start + k + 1
            body.append(fixed_page(start + k, kind, k - 1, following, sequence) if kind in fixed_rows() else data_page(start + k, kind, rows, following, sequence))
            sequence += 1
        if pages:
            growth += 1
        else:
            body.append(NO_ROWS)
        pointers += struct.pack("<4I", kind, spare, start, start + len(pages))
    head = struct.pack("<4x5I4x", PAGE, KINDS, growth, len(tracks), sequence) + pointers
    return b"".join([head.ljust(PAGE, b"\0"), *body])
