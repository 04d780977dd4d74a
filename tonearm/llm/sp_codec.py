"""SentencePiece encoding and decoding with a public BPE model, batched in numpy.

The installed model is of the BPE kind: the library joins pairs by rank, and the path of highest total score, which Viterbi
finds, is another segmentation for many words. So words of equal length advance together through joins instead: each round
looks up every adjacent pair of all of them among the sorted pair keys and joins each word's best pair. The ids are the
library's own."""

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits

#: White space as the model writes it.
MARK = "▁"
_WORD = re.compile(r" *[^ ]+| +")
#: Words remembered by a worker; then it starts afresh.
_REMEMBERED = 400_000
#: Longer words are joined one by one with a heap, in n log n steps.
_LONG = 96
_codecs: dict = {}


class Codec:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == 2)
        self.byte = np.full(256, self.unknown, np.int64)
        self.surface = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte[int(p[3:5], 16)] = i
                self.surface.append(bytes([int(p[3:5], 16)]))
            else:
                self.surface.append(p.replace(MARK, " ").encode() if kind == 1 else b"")
        # symbols: pieces by id; characters that only stand inside pieces get ids after them
        symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):
            symbol[c] = len(pieces) + len(symbol) - len(normal)
        self.pieces, self.symbols = len(pieces), max(symbol.values(), default=0) + 1
        order = sorted(normal, key=lambda p: (-pieces[normal[p]][1]))
        rank, last, place = {}, None, -1
        for p in order:  # pieces of equal score share a rank
            place += pieces[normal[p]][1] != last
            last = pieces[normal[p]][1]
            rank[p] = place
        keys, to, ranks = [], [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.symbols + b)
                    to.append(i)
                    ranks.append(rank[p])
        at = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[at], np.iinfo(np.int64).max)
        self.to, self.rank = np.append(np.array(to, np.int64)[at], 0), np.append(np.array(ranks, np.int64)[at], 0)
        self.pair = dict(zip(keys, zip(ranks, to, strict=True), strict=True))
        points = sorted((ord(c), i) for c, i in symbol.items() if len(c) == 1)
        self.points, self.point_symbol = np.array([p for p, _ in points], np.uint32), np.array([i for _, i in points], np.int64)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "Codec":
        if path not in _codecs:
            _codecs[path] = cls(path)
        return _codecs[path]

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; an unknown one is -1 less the code point."""
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, self.point_symbol[at], -1 - points.astype(np.int64))

    def _joined(self, rows: np.ndarray) -> list[np.ndarray]:
        """Final symbols of words of one length, a row each."""
        out: list = [None] * len(rows)
        live, worst = np.arange(len(rows)), np.iinfo(np.int64).max
        while len(live):
            if rows.shape[1] > 1:
                left, right = rows[:, :-1], rows[:, 1:]
                key = np.where((left >= 0) & (right >= 0), left * self.symbols + right, -1)
                at = np.searchsorted(self.keys, key)
                rank = np.where(self.keys[at] == key, self.rank[at], worst)
                best = rank.argmin(1)
                line = np.arange(len(rows))
                go = rank[line, best] < worst
            else:
                go = np.zeros(len(rows), bool)
            for i in np.flatnonzero(~go):
                out[live[i]] = rows[i]
            if not go.any():
                break
            rows, live, best = rows[go], live[go], best[go]
            made = self.to[at[go, best]]
            n = rows.shape[1]
            column = np.arange(n - 1)
            rows = np.where(column < best[:, None], rows[:, :-1], rows[:, 1:])
            rows[np.arange(len(rows)), best] = made
        return out

    def _heaped(self, row: list[int]) -> np.ndarray:
        """The same for one long word."""
        n = len(row)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list = []

        def offer(i):
            j = after[i]
            if j < n and row[i] >= 0 and row[j] >= 0 and (got := self.pair.get(row[i] * self.symbols + row[j])):
                heapq.heappush(heap, (got[0], i, row[i], row[j], got[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            if not alive[i] or row[i] != a or (j := after[i]) >= n or row[j] != b:
                continue
            row[i], alive[j], after[i] = made, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([s for s, on in zip(row, alive, strict=True) if on], np.int64)

    def _ids(self, symbols: np.ndarray, point_of: dict) -> bytes:
        if len(symbols) and ((symbols < 0) | (symbols >= self.pieces)).any():
            out: list[int] = []
            for s in symbols.tolist():
                if 0 <= s < self.pieces:
                    out.append(s)
                else:
                    out += self.byte[np.frombuffer(chr(-1 - s if s < 0 else point_of[s]).encode("utf-8", "surrogatepass"), np.uint8)].tolist()
            symbols = np.array(out)
        return symbols.astype("<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes words anew, those of one length together."""
        point_of = dict(zip(self.point_symbol.tolist(), self.points.tolist(), strict=True))
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for n, group in by.items():
            marked = [w.replace(" ", MARK) for w in group]
            if n > _LONG:
                for w, m in zip(group, marked, strict=True):
                    self.known[w] = self._ids(self._heaped(self._symbols(np.array([ord(c) for c in m], np.uint32)).tolist()), point_of)
                continue
            for i in range(0, len(group), 4096):
                some = marked[i : i + 4096]
                points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), n)
                for w, got in zip(group[i : i + 4096], self._joined(self._symbols(points)), strict=True):
                    self.known[w] = self._ids(got, point_of)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers. A text is cut before white space that follows other
        characters: no piece spans such a place."""
        cut = [_WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        known = self.known
        if new := list({w for words in cut for w in words if w not in known}):
            self.learn(new)
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that encoding puts first is taken off."""
        return b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


def _encoded(path: str, digest: bool):
    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i in range(0, len(texts), 64):
                some = texts[i : i + 64]
                got = codec.encode(some)
                ids, sizes = batch.column("doc_id").slice(i, len(some)), pa.array([len(g) // 4 for g in got], pa.int64())
                if digest:
                    same = [codec.decode(np.frombuffer(g, "<u4")) == t.replace(MARK, " ") for g, t in zip(got, some, strict=True)]
                    yield pa.record_batch([ids, sizes, pa.array([zlib.crc32(g) for g in got], pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])
                else:
                    at = np.concatenate(([0], np.cumsum(sizes.to_numpy()))).astype(np.int32)
                    yield pa.record_batch([ids, sizes, pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32)))], ["doc_id", "n_tokens", "ids"])

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens and ids, as the library gives them for the model at `path`. A null
    text is an empty one and has no ids. Other columns are ignored; an empty table gives no rows."""
    arrow_limits(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encoded(path, False), "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""
    arrow_limits(encoded.sparkSession)

    def run(batches):
        codec = Codec.of(path)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([codec.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def codec_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and
    round_trip: whether decoding gives the text again, the model's mark for white space read as a space."""
    arrow_limits(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encoded(path, True), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
