"""Removal of repeated byte windows by a depth-limited radix order of windows.

Two suffixes matter to each other only through their first WINDOW bytes, so they are grouped no deeper, digit by digit, and
groups of one drop out after each. The first digit of a window is the least of its K-byte hashes: equal windows have equal
digits, neighbouring windows mostly share theirs, and so one pass over all suffixes costs a few keys a hundred bytes, where
the first eight bytes of each suffix would cost eight times the text. Windows whose digit occurs once in the corpus are
settled. Of the others a hash of all their bytes is the next digit, and then, in the groups that it leaves, the bytes
themselves, eight at a time: within the batch first, and between batches for runs that are first in theirs. Equal groups are
exactly the repeated windows; all but the first of a group go. A digit that many batches hold is split: its windows are dealt
one by one and named by 128 bits of two hashes, as their bytes would take a hundred times as much."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import Batch, Sizes, answered, corpus_batches, dealt, expand, grouped, pack, pack_sorted, parts_of, rows_of, squeeze, unpack, unpack_sorted
from .common import arrow_limits, released, saved
from .text import U, byte_symbols, chunks, mix, rolling, stretch

WINDOW, K = 100, 40
#: Bytes of text in a batch: each byte may need some eighty of memory.
BATCH = 2 << 20
SPAN = WINDOW - K + 1
#: Windows of one run that travel together, and batches that may hold a digit before its windows are dealt singly.
RUN, HOT = 64, 64

REQUESTS = "part int, batch long, keys binary"
ANSWERS = "batch long, part int, answer binary"
ENTRIES = "part int, batch long, runs binary, order binary, texts binary, singles binary"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbouring values."""
    out, done = values, 1
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - done :][: len(values) - width + 1])


class Windows:
    """The windows of a batch: runs of neighbouring starts with one digit, and the hash of any window."""

    def __init__(self, batch: Batch):
        self.batch = batch
        starts, ends, digits, inner, self.prefixes = [], [], [], [], []
        for a, b in chunks(batch.offsets, 1 << 19):
            base = int(batch.offsets[a])
            data = batch.data[base : batch.offsets[b]]
            self.prefixes.append((base, data))
            if len(data) < WINDOW:
                continue
            prefix = rolling(byte_symbols(data))
            at = np.arange(len(data) - K + 1)
            grams = stretch(prefix, at, at + K)
            digit = _least(grams, SPAN)
            # windows that cross texts are none
            ok = np.zeros(len(digit) + 1, np.int8)
            low = batch.offsets[a:b] - base
            high = np.maximum(low, batch.offsets[a + 1 : b + 1] - base - WINDOW + 1)
            some = high > low
            np.add.at(ok, low[some], 1)
            np.add.at(ok, high[some], -1)
            inside = np.cumsum(ok[:-1], dtype=np.int8) > 0
            new = inside.copy()
            new[1:] &= (digit[1:] != digit[:-1]) | ~inside[:-1]
            new[low[some]] = True
            first = np.flatnonzero(new)
            stop = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False)) + 1
            starts.append(first + base)
            ends.append(stop + base)
            digits.append(mix(digit[first], 5))  # least values crowd low; partitions are ranges of keys
            # a run repeats a window only if its digit stands at two places: then it outlives the window that begins with one
            led = np.concatenate(([0], np.cumsum(grams[: len(digit)] == digit)))
            inner.append(led[stop - 1] > led[first])
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.start, self.end, self.digit = join(starts, np.int64), join(ends, np.int64), join(digits, U)
        self.inner = join(inner, bool)
        if (long := self.end - self.start > RUN).any():  # periodic text: one digit for many windows
            pieces = np.where(long, -(-(self.end - self.start) // RUN), 1)
            k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, end = np.repeat(self.start, pieces) + k * RUN, np.repeat(self.end, pieces)
            self.start, self.end, self.digit = start, np.minimum(end, start + RUN), np.repeat(self.digit, pieces)
            self.inner = np.repeat(self.inner, pieces)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct digits, the digit of each run, and how many runs have each."""
        return np.unique(self.digit, return_inverse=True, return_counts=True)

    def hashes(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, run, hash) of every window of the runs, in order."""
        size = self.end[runs] - self.start[runs]
        run = np.repeat(np.arange(len(runs)), size)
        start = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[runs], size)
        out = np.empty(len(start), U)
        for base, data in self.prefixes:
            a, b = np.searchsorted(start, (base, base + len(data)))
            if b > a:
                out[a:b] = stretch(rolling(byte_symbols(data)), start[a:b] - base, start[a:b] - base + WINDOW)
        return start, run, mix(out, 77)


#: A window as big-endian digits of eight bytes, most significant first; the last overlaps.
DIGITS = [*range(0, WINDOW - 8, 8), WINDOW - 8]


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,))


def second_hash(words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of the windows, made digit by digit: with the first it names a window whose bytes don't travel."""
    out = np.full(len(start), WINDOW, U)
    for k in DIGITS:
        out = mix(out ^ words[start + k], 78)
    return out


def later(first: np.ndarray, words: np.ndarray | None, start: np.ndarray) -> np.ndarray:
    """Whether an equal window stands before each. The hash is the first radix digit: its groups of one drop out. The others
    are compared with the first of their group in every digit of their bytes; where one differs, the group is ordered by
    passes over the digits, most significant first, and groups of one drop out after each. Where `words` is None, `start` is
    a second hash and the last digit."""
    same = np.zeros(len(first), bool)
    order = np.argsort(first, kind="stable")
    new = np.append(True, first[order[1:]] != first[order[:-1]])[: len(first)]
    group = np.cumsum(new) - 1
    lead = order[np.flatnonzero(new)][group] if len(first) else order
    rest = np.flatnonzero(~new)
    one, other = order[rest], lead[rest]
    equal = np.ones(len(rest), bool)
    for k in DIGITS if words is not None else (0,):
        equal &= words[start[one] + k] == words[start[other] + k] if words is not None else start[one] == start[other]
    same[one] = True
    if not equal.all():
        split = np.unique(group[rest[~equal]])
        at = np.sort(order[np.isin(group, split)])  # in order of place; groups are told by the hash
        same[at] = False
        live, name = at, np.unique(first[at], return_inverse=True)[1]
        for k in DIGITS if words is not None else (0,):
            digit = words[start[live] + k].byteswap() if words is not None else start[live]
            by = np.lexsort((live, digit, name))
            cut = np.append(True, (name[by][1:] != name[by][:-1]) | (digit[by][1:] != digit[by][:-1]))
            name = np.empty(len(live), np.int64)
            name[by] = np.cumsum(cut) - 1
            many = np.bincount(name)[name] > 1
            live, name = live[many], name[many]
        by = np.lexsort((live, name))
        same[live[by][1:][name[by][1:] == name[by][:-1]]] = True
    return same


def _requests(partitions: int):
    def run(batches):
        for row in rows_of(batches):
            keys = np.unique(Windows(Batch.of(row)).digit)
            some = parts_of(keys, partitions)
            yield pa.record_batch([pa.array([p for p, _, _ in some], pa.int32()), pa.array([row["batch"]] * len(some), pa.int64()), pa.array([pack_sorted(keys[x:y]) for _, x, y in some], pa.binary())], ["part", "batch", "keys"])

    return run


def _repeated(batches):
    """Rows sorted by part: for each key 0 if one batch holds it, 1 if several do, 2 if more than HOT."""
    for part, rows in grouped(batches, "part"):
        keys = [unpack_sorted(r["keys"]) for r in rows]
        _, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        state = ((n > 1).astype(np.uint8) + (n > HOT))[at]
        cut = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        yield pa.record_batch([pa.array([r["batch"] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array([squeeze(state[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["batch", "part", "answer"])


class Local:
    """What a batch knows once its digits' states came: windows repeated within it, and the runs that must be compared with
    other batches, each with the windows that are first here."""

    def __init__(self, batch: Batch, state: np.ndarray):
        w = self.windows = Windows(batch)
        keys, of, count = w.keys()
        state = state if len(state) else np.zeros(len(keys), np.uint8)
        runs = np.flatnonzero((state[of] > 0) | (count[of] > 1) | w.inner) if len(of) else np.zeros(0, np.int64)
        self.start, run, self.hash = w.hashes(runs)
        words = words_at(batch.data)
        self.later = later(self.hash, words, self.start)
        ask = ~self.later & (state[of[runs[run]]] > 0) if len(run) else np.zeros(0, bool)
        hot = state[of[runs[run]]] == 2 if len(run) else np.zeros(0, bool)
        # windows of a run travel together from the first to the last asked one; those of a hot digit one by one
        lead = ask & (hot | ~np.append(False, ask[:-1] & (run[1:] == run[:-1])))
        self.asked = np.flatnonzero(lead)
        group = np.cumsum(lead) - 1
        self.size = np.bincount(group[ask], minlength=len(self.asked)).astype(np.int64)
        self.single = hot[self.asked]
        self.digit = np.where(hot, self.hash, w.digit[runs[run]])[self.asked] if len(run) else np.zeros(0, U)
        # by digit, so that a partition's entries are a slice; then by place
        order = np.lexsort((self.start[self.asked], self.digit)) if len(self.asked) else np.zeros(0, np.int64)
        self.asked, self.size, self.digit, self.single = self.asked[order], self.size[order], self.digit[order], self.single[order]
        self.second = np.zeros(len(self.asked), U)
        self.second[self.single] = second_hash(words, self.start[self.asked[self.single]])

    def entry_texts(self, a: int, b: int) -> bytes:
        """The bytes under the runs among entries a to b; single windows go by their hash alone."""
        run = np.flatnonzero(~self.single[a:b]) + a
        start = self.start[self.asked[run]]
        length = self.size[run] + WINDOW - 1
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
        return self.windows.batch.data[at].tobytes()


def _state(answers: list) -> np.ndarray:
    return np.concatenate([np.frombuffer(expand(x), np.uint8) for x in answers]) if answers else np.zeros(0, np.uint8)


LOWEST = -(1 << 63)


def _entries(partitions: int):
    def run(batches):
        answers: list = []
        for row in rows_of(batches):
            if row["texts"] is None:
                answers.append(row["answer"])
                continue
            batch = Batch.of(row)
            own = Local(batch, _state(answers))
            answers = []
            start = own.start[own.asked]
            text = np.searchsorted(batch.offsets, start, "right") - 1
            ids = np.array([LOWEST if x is None else x for x in batch.ids], np.int64)
            some = parts_of(own.digit, partitions)
            runs, order, texts, singles = [], [], [], []
            for _, a, b in some:
                one = own.single[a:b]
                runs.append(pack(np.where(one, 0, own.size[a:b]).astype(U)))
                singles.append(pack(np.concatenate((own.digit[a:b][one], own.second[a:b][one]))))
                order.append(pack(np.concatenate((ids[text[a:b]].view(U), batch.hashes[text[a:b]], (start[a:b] - batch.offsets[text[a:b]]).astype(U)))))
                texts.append(squeeze(own.entry_texts(a, b)))
            yield pa.record_batch([pa.array([p for p, _, _ in some], pa.int32()), pa.array([row["batch"]] * len(some), pa.int64()), pa.array(runs, pa.binary()), pa.array(order, pa.binary()), pa.array(texts, pa.binary()), pa.array(singles, pa.binary())], ["part", "batch", "runs", "order", "texts", "singles"])

    return run


def _run_hashes(size: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Hashes of the windows of runs whose bytes follow one another."""
    at = np.concatenate(([0], np.cumsum(size + WINDOW - 1)))
    out = [np.zeros(0, U)]
    for a, b in chunks(at, 1 << 19):
        n = size[a:b]
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[a:b] - at[a], n)
        out.append(mix(stretch(rolling(byte_symbols(data[at[a] : at[b]])), start, start + WINDOW), 77))
    return np.concatenate(out)


def _ordered(batches):
    """Rows sorted by part: which windows of each entry an earlier text holds, a bit each, least first."""
    for part, rows in grouped(batches, "part"):
        sizes = [unpack(r["runs"]).astype(np.int64) for r in rows]
        source = np.repeat(np.arange(len(rows)), [len(x) for x in sizes])
        size = np.concatenate(sizes)
        keys = np.concatenate([unpack(r["order"]).reshape(3, -1) for r in rows], 1)
        singles = np.concatenate([unpack(r["singles"]).reshape(2, -1) for r in rows], 1)
        data = np.frombuffer(b"".join(expand(r["texts"]) for r in rows), np.uint8)
        names = [r["batch"] for r in rows]
        rows.clear()
        mask = np.zeros(len(size), U)
        rank = np.lexsort((source, keys[2], keys[1], keys[0].view(np.int64)))
        alone = rank[size[rank] == 0]  # windows of digits that many batches hold: named by two hashes
        place = np.cumsum(size == 0) - 1
        mask[alone] = later(singles[0, place[alone]], None, singles[1, place[alone]]).astype(U)
        runs = rank[size[rank] > 0]
        begin = np.cumsum(np.where(size > 0, size + WINDOW - 1, 0)) - np.where(size > 0, size + WINDOW - 1, 0)
        n = size[runs]
        entry = np.repeat(runs, n)
        inner = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
        own, first = size[size > 0], np.cumsum(size) - size
        hit = later(_run_hashes(own, data)[first[entry] + inner], words_at(data), begin[entry] + inner)
        np.bitwise_or.at(mask, entry[hit], U(1) << inner[hit].astype(U))
        cut = np.searchsorted(source, np.arange(len(names) + 1))
        yield pa.record_batch([pa.array(names, pa.int64()), pa.array([part] * len(names), pa.int32()), pa.array([pack(mask[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["batch", "part", "answer"])


def removed_spans(batch: Batch, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs as (first, end) places in the batch's bytes; runs end with their text."""
    if not len(starts):
        return starts, starts
    text = np.searchsorted(batch.offsets, starts, "right") - 1
    new = np.append(True, (starts[1:] > starts[:-1] + WINDOW) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1] + WINDOW


def _removed(batches):
    states: list = []
    masks: list = []
    for row in rows_of(batches):
        if row["texts"] is None:
            (states if row["part"] >= 0 else masks).append((row["part"], row["answer"]))
            continue
        batch = Batch.of(row)
        own = Local(batch, _state([x for _, x in states]))
        mask = np.concatenate([unpack(x) for _, x in masks]) if masks else np.zeros(0, U)
        states, masks = [], []
        gone = own.later.copy()
        if len(mask):
            inner = np.arange(int(own.size.sum())) - np.repeat(np.cumsum(own.size) - own.size, own.size)
            at = inner + np.repeat(own.asked, own.size)
            gone[at] |= (np.repeat(mask, own.size) >> inner.astype(U)) & U(1) > 0
        first, end = removed_spans(batch, np.sort(own.start[gone]))
        text = np.searchsorted(batch.offsets, first, "right") - 1
        n = len(batch.ids)
        lost = np.bincount(text, end - first, n).astype(np.int64)
        spans = np.bincount(text, minlength=n).astype(np.int64)
        cut = np.searchsorted(text, np.arange(n + 1))
        kept = []
        for i in range(n):
            digest, at = hashlib.sha256(), int(batch.offsets[i])
            for a, b in zip(first[cut[i] : cut[i + 1]].tolist(), end[cut[i] : cut[i + 1]].tolist(), strict=True):
                digest.update(batch.data[at:a])
                at = b
            digest.update(batch.data[at : batch.offsets[i + 1]])
            kept.append(digest.hexdigest())
        yield pa.record_batch([pa.array(batch.ids, pa.int64()), pa.array(np.diff(batch.offsets)), pa.array(lost), pa.array(spans), pa.array(kept)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, n_removed, n_spans and kept_sha256 after removal of each byte that a
    repeated window of WINDOW bytes covers.

    The first window of a group is that of the smallest doc_id (null ids first), rows of one id by the hash of their text,
    rows equal in both by place; within a text by start. A null text is empty; a text shorter than WINDOW loses nothing.
    Other columns are ignored; an empty table gives no rows. Windows are compared by their bytes, those of a digit that over
    HOT batches hold by 128 bits."""
    spark = docs.sparkSession
    arrow_limits(spark)
    batches = corpus_batches(docs, id_col, text_col, batch)
    sizes = Sizes(batches, 4)
    requests = batches.mapInArrow(_requests(sizes.parts), REQUESTS)
    states = saved(dealt(requests, sizes.tasks).mapInArrow(_repeated, ANSWERS), "states", {"compression": "none"})
    del requests  # so that its shuffle files can go
    released(spark)
    entries = answered(batches, states, sizes.tasks).mapInArrow(_entries(sizes.parts), ENTRIES)
    masks = saved(dealt(entries, sizes.tasks).mapInArrow(_ordered, ANSWERS), "masks", {"compression": "none"})
    del entries
    released(spark)
    both = states.union(masks.select("batch", (F.col("part") - sizes.parts).alias("part"), "answer"))
    return answered(batches, both, sizes.tasks).mapInArrow(_removed, OUT)
