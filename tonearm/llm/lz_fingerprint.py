"""Lempel-Ziv phrase fingerprints: the set of LZ78 phrases of a text, minimum-hashed, for compression-like likeness."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, bucket_of_bounds, dropped, parts_for, range_starts, saved
from .sketch import sketch
from .text import U, byte_symbols, mix, rolling, stretch

#: Coordinates of a fingerprint; each is kept in one byte.
COORDINATES = 128
GROUP = 1 << 17


class Phrases:
    """LZ78 over bytes: each phrase is the longest known one plus a byte, and becomes known. Phrases follow one another, so
    their ends tell them. The state can be marked and taken back, so that texts with a common start are parsed once up to
    the cut."""

    def __init__(self):
        self.known: dict[int, int] = {}
        self.node = 0
        self.ends: list[int] = []

    def feed(self, data: bytes, at: int) -> list[int]:
        """Parses `data`, whose first byte has place `at`. Returns the keys that were new."""
        known, node, fresh, ends = self.known, self.node, [], self.ends
        get, count, add, end = known.get, (len(known) + 1) << 8, fresh.append, ends.append
        for place, byte in enumerate(data, at + 1):
            key = node | byte
            node = get(key, 0)
            if not node:
                known[key] = count
                count += 256
                add(key)
                end(place)
        self.node = node
        return fresh


def phrase_hashes(data: bytes, ends: list[int]) -> np.ndarray:
    if not ends:
        return np.zeros(0, U)
    prefix = rolling(byte_symbols(np.frombuffer(data, np.uint8)))
    end = np.array(ends, np.int64)
    start = np.concatenate(([0], end[:-1]))
    return mix(stretch(prefix, start, end) + (end - start).astype(U))


def both_hashes(text: bytes, cut: int, tail: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Phrase hashes of `text`, and of `text[:cut] + tail`."""
    p = Phrases()
    p.feed(text[:cut], 0)
    node, phrases = p.node, len(p.ends)
    fresh = p.feed(text[cut:], cut)
    own = phrase_hashes(text, p.ends)
    for key in fresh:
        del p.known[key]
    p.node = node
    del p.ends[phrases:]
    p.feed(tail, cut)
    return own, phrase_hashes(text[:cut] + tail, p.ends)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES bytes for each set; an empty set has bytes of 255."""
    size = np.array([len(x) for x in sets], np.int64)
    out = (mix(sketch(np.concatenate(sets), np.concatenate(([0], np.cumsum(size))), COORDINATES)) >> U(56)).astype(np.uint8)
    out[size == 0] = 255
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of phrase sets, 0 to 1, chance agreement of bytes taken off."""
    return np.clip(((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def _edit_cut(text: bytes) -> tuple[int, int, int]:
    """Code points, those replaced, and the byte at which the replaced part begins."""
    raw = np.frombuffer(text, np.uint8)
    leads = np.flatnonzero((raw & 0xC0) != 0x80)
    n = len(leads)
    k = n // 4
    return n, k, int(leads[n - k]) if k else len(text)


def _head(text: bytes, k: int) -> bytes:
    raw = np.frombuffer(text, np.uint8)
    leads = np.flatnonzero((raw & 0xC0) != 0x80)
    return text if k >= len(leads) else text[: int(leads[k])]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches):
    """Rows sorted by (bucket, tail, order): each with the next one of its bucket; a tail row only follows."""
    before = None  # bucket, doc_id, text
    pending: list[tuple] = []
    held = 0

    def flush():
        nonlocal pending, held
        if not pending:
            return None
        sets, ids, sizes, shas = [], [], [], []
        for name, text, nxt in pending:
            n, k, cut = _edit_cut(text)
            tail = _head(nxt, k)
            own, other = both_hashes(text, cut, tail)
            sets += [own, other, None]
            ids.append(name)
            sizes.append(n)
            shas.append(hashlib.sha256(text[:cut] + tail).hexdigest())
        # the next text is the following row's own, but for the last
        for i, (_, _, nxt) in enumerate(pending):
            if i + 1 < len(pending) and pending[i + 1][1] is nxt:
                sets[3 * i + 2] = sets[3 * i + 3]
            else:
                p = Phrases()
                p.feed(nxt, 0)
                sets[3 * i + 2] = phrase_hashes(nxt, p.ends)
        prints = fingerprints(sets).reshape(len(pending), 3, COORDINATES)
        pending, held = [], 0
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas), pa.array([x.tobytes().hex() for x in prints[:, 0]]), pa.array([x.tobytes().hex() for x in prints[:, 1]]), pa.array(likeness(prints[:, 0], prints[:, 1])), pa.array(likeness(prints[:, 0], prints[:, 2]))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        for bucket, tail, name, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True):
            data = (text or "").encode()
            if before is not None and before[0] == bucket:
                pending.append((before[1], before[2], data))
                held += len(before[2])
                if held >= GROUP and (out := flush()) is not None:
                    yield out
            before = None if tail else (bucket, name, data)
    if (out := flush()) is not None:
        yield out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`, with the columns of OUT. Documents are ordered by id, null ids first and rows of one
    id by a hash of the text, then by text; after the last comes the first, so a lone document is its own next. A null text
    is empty; an empty text has a fingerprint of bytes of 255. An empty table gives no rows. Other columns are ignored.

    Texts move once: each goes to the bucket of its id and hash, so that rows without an id spread, and the first of a bucket
    also to the end of the bucket before. Buckets are in proportion to the bytes of the texts."""
    spark = docs.sparkSession
    arrow_limits(spark)
    lowest = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("at"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    narrow = saved(rows.select("at", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")), "places")
    n = min(100_000, parts_for(narrow, F.col("n"), 8 << 20))
    firsts = range_starts(narrow, n)
    dropped(narrow)
    if not firsts:
        return spark.createDataFrame([], OUT)

    @F.pandas_udf("int")
    def bucket_of(at: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(bucket_of_bounds(at.to_numpy(), h.to_numpy(), firsts[1:]).astype(np.int32))

    dealt = rows.withColumn("bucket", bucket_of("at", "h"))
    also = spark.createDataFrame([(*first, (i - 1) % len(firsts)) for i, first in enumerate(firsts)], "at long, h long, tail_bucket int")
    tails = dealt.drop("bucket").join(F.broadcast(also), ["at", "h"]).select("doc_id", "text", "at", "h", F.col("tail_bucket").alias("bucket"), F.lit(True).alias("tail"))
    both = dealt.select("doc_id", "text", "at", "h", "bucket", F.lit(False).alias("tail")).unionByName(tails)
    laid = both.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", "at", "h", F.col("text").asc_nulls_first())
    return laid.select("bucket", "tail", "doc_id", "text").mapInArrow(_compared, OUT)
