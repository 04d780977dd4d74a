"""A device's files: one page file for each key."""

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pagefile as P
from ..functions import pagewriter as W

#: Tables of the device library with their columns; fixed values of the format.
TABLES = {
    "album": "album_id name artist_id image_id isComplation nameForSearch",
    "artist": "artist_id name nameForSearch",
    "category": "category_id menuItem_id sequenceNo isVisible",
    "color": "color_id name",
    "content": "content_id title titleForSearch subtitle bpmx100 length trackNo discNo artist_id_artist artist_id_remixer artist_id_originalArtist artist_id_composer artist_id_lyricist album_id genre_id label_id key_id color_id image_id djComment rating releaseYear releaseDate dateCreated dateAdded path fileName fileSize fileType bitrate bitDepth samplingRate isrc djPlayCount isHotCueAutoLoadOn isKuvoDeliverStatusOn kuvoDeliveryComment masterDbId masterContentId analysisDataFilePath analysedBits contentLink hasModified cueUpdateCount analysisDataUpdateCount informationUpdateCount",
    "cue": "cue_id content_id kind colorTableIndex cueComment isActiveLoop beatLoopNumerator beatLoopDenominator inUsec outUsec in150FramePerSec out150FramePerSec inMpegFrameNumber outMpegFrameNumber inMpegAbs outMpegAbs inDecodingStartFramePosition outDecodingStartFramePosition inFileOffsetInBlock OutFileOffsetInBlock inNumberOfSampleInBlock outNumberOfSampleInBlock",
    "genre": "genre_id name",
    "history": "history_id sequenceNo name attribute history_id_parent",
    "history_content": "history_id content_id sequenceNo",
    "hotCueBankList": "hotCueBankList_id sequenceNo name image_id attribute hotCueBankList_id_parent",
    "hotCueBankList_cue": "hotCueBankList_id cue_id sequenceNo",
    "image": "image_id path",
    "key": "key_id name",
    "label": "label_id name",
    "menuItem": "menuItem_id kind name",
    "myTag": "myTag_id sequenceNo name attribute myTag_id_parent",
    "myTag_content": "myTag_id content_id",
    "playlist": "playlist_id sequenceNo name image_id attribute playlist_id_parent",
    "playlist_content": "playlist_id content_id sequenceNo",
    "property": "deviceName dbVersion numberOfContents createdDate backGroundColorType myTagMasterDBID",
    "recommendedLike": "content_id_1 content_id_2 rating createdDate",
    "sort": "sort_id menuItem_id sequenceNo isVisible isSelectedAsSubColumn",
}
#: Names of the page file's tables by kind.
KINDS = {W.TRACKS: "tracks", W.GENRES: "genres", W.ARTISTS: "artists", W.ALBUMS: "albums", W.LABELS: "labels", W.KEYS: "keys", W.COLORS: "colors", W.TREE: "tree", W.ENTRIES: "entries", W.ARTWORK: "artwork", W.COLUMNS: "columns", W.PAIRS: "pairs", W.MAPPING: "mapping", W.SYNC: "sync"}


def page_files(tracks: DataFrame, playlists: DataFrame, by: str) -> DataFrame:
    """`by`, content: the page file of the tracks and playlists of each key that has tracks, both in order of their id. Columns
    are those of functions.pagewriter.page_file; a playlist's track_ids come as an array. A device's rows meet in one task,
    as its file is one value."""
    rows = lambda df: df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("id", *[c for c in df.columns if c not in (by, "id")]))).alias("rows"))
    lists = rows(playlists).withColumnRenamed("rows", "lists")

    def run(batches):
        for pdf in batches:
            for key, own, more in zip(pdf[by], pdf["rows"], pdf["lists"], strict=True):
                yield pd.DataFrame({by: [key], "content": [W.page_file(own, more if more is not None else ())]})

    return rows(tracks).join(lists, by, "left").mapInPandas(run, f"{by} {dict(tracks.dtypes)[by]}, content binary")


def _counted(data: bytes) -> list[tuple]:
    """(kind, n, errors, warnings) by named table of a file."""
    errors, warnings = P.check(data)
    counts = P.row_counts(data)
    return [(name, counts.get(kind, 0), len(errors), len(warnings)) for kind, name in KINDS.items()]


def _differing(one: bytes, two: bytes) -> list[tuple]:
    """(kind, pages, runs) in which two files differ."""
    found = P.diff(one, two)
    pages, runs = {}, {}
    for page, *_ in found["runs"]:
        kind = "file" if page == 0 else KINDS.get(int.from_bytes(one[page * P.PAGE + 8 : page * P.PAGE + 12], "little"), "other")
        pages.setdefault(kind, set()).add(page)
        runs[kind] = runs.get(kind, 0) + 1
    return [(k, len(pages[k]), runs[k]) for k in pages] + [(k, len(found[k]), 0) for k in ("only_left", "only_right") if found[k]]


def row_counts(files: DataFrame, by: str) -> DataFrame:
    """`by`, kind, n, errors and warnings: rows of each named table of each page file, and how much its checks find."""

    def run(batches):
        for pdf in batches:
            for key, content in zip(pdf[by], pdf["content"], strict=True):
                yield pd.DataFrame([(key, *x) for x in _counted(bytes(content))], columns=[by, "kind", "n", "errors", "warnings"])

    return files.mapInPandas(run, f"{by} {dict(files.dtypes)[by]}, kind string, n long, errors int, warnings int")


def page_diffs(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """`by`, kind, pages and runs: how many pages of each kind of table differ between two files of a key, and in how many runs
    of bytes; 'only_left' and 'only_right' count the pages that one file has more, 'file' is the header."""
    pairs = left.select(by, F.col("content").alias("a")).join(right.select(by, F.col("content").alias("b")), by)

    def run(batches):
        for pdf in batches:
            for key, a, b in zip(pdf[by], pdf["a"], pdf["b"], strict=True):
                yield pd.DataFrame([(key, *x) for x in _differing(bytes(a), bytes(b))], columns=[by, "kind", "pages", "runs"])

    return pairs.mapInPandas(run, f"{by} {dict(left.dtypes)[by]}, kind string, pages long, runs long")


#: Users that share a block, and what every track of a library is given.
BLOCK = 64
FIXED = {"sample_rate": 44100, "bit_depth": 16, "bitrate": 320, "bpm": 128.0, "duration_secs": 180.0, "file_size": 5_000_000, "analyze_path": "PIONEER/USBANLZ"}
#: Tables of which a user's own rows decide whether they are listed.
OWN = ("tracks", "artists", "tree", "entries")


def own_file(tracks: dict, lists: list) -> bytes:
    """The page file of tracks (title and artist by track id, in order) and playlists (name, members): both numbered from 1, the
    playlists in a folder. A track of which nothing is known goes by its hash."""
    numbers = {track: n for n, track in enumerate(tracks, 1)}
    path = lambda track, title, artist: f"Contents/{track:016x}.mp3" if title is None or artist is None else f"Contents/{artist}/{title}.mp3"
    rows = [{"id": numbers[t], "title": title, "artist": artist, "file_path": path(t, title, artist), **FIXED} for t, (title, artist) in tracks.items()]
    playlists = [{"id": n, "parent_id": 1000, "name": name, "is_folder": False, "track_ids": sorted(numbers[t] for t in members)} for n, (name, members) in enumerate(lists, 1)]
    folder = {"id": 1000, "parent_id": 0, "name": "Library", "is_folder": True, "track_ids": []}
    return W.page_file(rows, sorted([*playlists, *([folder] if lists else [])], key=lambda p: (p["id"], p["parent_id"])))


def in_order(library: DataFrame, by: str = "user_id") -> DataFrame:
    """The rows of a library dealt by `by`, and by it and user, playlists first, all in order. Rows are of tracks (user_id, track_id,
    title, artist; the rest null) or of named playlists (user_id, name, created_at, playlist_id, members)."""
    order = dict.fromkeys([by, "user_id", "track_id", "name", "created_at", "playlist_id", "title", "artist"])
    return library.repartition(by).sortWithinPartitions(*order).drop("created_at", "playlist_id")


def blocks(library: DataFrame) -> DataFrame:
    """The same by block: BLOCK users, and the one that follows the last."""
    first = lambda user: user - F.pmod(user, F.lit(BLOCK))
    user = F.col("user_id")
    known = library.where(user.isNotNull())
    return in_order(known.withColumn("block", F.explode(F.array_distinct(F.array(first(user), first(user - 1))))), "block")


def _libraries(batches):
    """(block, user, tracks, lists) from rows in order, which without a block are one block; a track that comes again counts once. Only one user's rows are held,
    beside a batch."""
    now, tracks, lists = None, {}, []
    for batch in batches:
        if not batch.num_rows:
            continue
        of = {c: batch.column(c) for c in batch.schema.names}
        numbers = {c: of[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("block", "user_id", "track_id") if c in of}
        known = {c: of[c].is_valid().to_numpy(zero_copy_only=False) for c in ("user_id", "track_id")}
        change = np.logical_or.reduce([x[1:] != x[:-1] for x in (*[numbers[c] for c in ("block", "user_id") if c in of], known["user_id"])])
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        before = np.append(0, np.cumsum(known["track_id"])).tolist()
        ends = np.append(0, np.cumsum(of["members"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).tolist()
        members, ids = of["members"].flatten().to_numpy(zero_copy_only=False).tolist(), numbers["track_id"].tolist()
        title, artist, name = (of[c].to_numpy(zero_copy_only=False).tolist() for c in ("title", "artist", "name"))
        for i, j in itertools.pairwise(starts):
            key = (int(numbers["block"][i]) if "block" in of else 0, int(numbers["user_id"][i]) if known["user_id"][i] else None)
            if now != key:
                if now:
                    yield *now, tracks, lists
                now, tracks, lists = key, {}, []
            first = j - (before[j] - before[i])
            lists += [(name[k], members[ends[k] : ends[k + 1]]) for k in range(i, first)]
            for k in range(first, j):
                tracks.setdefault(ids[k], (title[k], artist[k]))
    if now:
        yield *now, tracks, lists


def _written(rows, names: list, types: list):
    """Record batches of rows, some thousands at a time or as soon as they hold 4 MB of bytes."""
    held, size = [], 0
    batch = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= 4096 or size >= 1 << 22:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def library_files(library: DataFrame) -> DataFrame:
    """user_id, content: the page file of each user who has tracks."""

    def run(batches):
        rows = ((user, own_file(tracks, lists)) for _, user, tracks, lists in _libraries(batches) if tracks)
        yield from _written(rows, ["user_id", "content"], [pa.int64(), pa.binary()])

    return in_order(library).mapInArrow(run, "user_id long, content binary")


def library_counts(library: DataFrame) -> DataFrame:
    """user_id, kind, n, errors and warnings as in row_counts, each file read where it was written. A user's own tables are listed
    if they have rows, the rest if the user has tracks."""

    def run(batches):
        rows = ((user, *x) for _, user, tracks, lists in _libraries(batches) for x in _counted(own_file(tracks, lists)) if (x[1] if x[0] in OWN else tracks))
        yield from _written(rows, ["user_id", "kind", "n", "errors", "warnings"], [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()])

    return in_order(library).mapInArrow(run, "user_id long, kind string, n long, errors int, warnings int")


def library_diffs(library: DataFrame) -> DataFrame:
    """user_id, kind, pages and runs as in page_diffs, of each user's file against that of the user one number on. Users travel in
    blocks, and files are compared where they were written, two at a time."""

    def found(batches):
        last = None
        for block, user, tracks, lists in _libraries(batches):
            if tracks:
                file = own_file(tracks, lists)
                if last and last[:2] == (block, user - 1):
                    yield from ((user - 1, *x) for x in _differing(last[2], file))
                last = (block, user, file)

    def run(batches):
        yield from _written(found(batches), ["user_id", "kind", "pages", "runs"], [pa.int64(), pa.string(), pa.int64(), pa.int64()])

    return blocks(library).mapInArrow(run, "user_id long, kind string, pages long, runs long")
