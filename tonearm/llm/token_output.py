"""Token ids in a fixed-width bit-packed file format, written in id order and read back.

Texts are encoded where they lie; only ids move. A token file is a Parquet dataset with a row for each block: whole documents,
their ids packed with the least bits that hold the vocabulary, the lengths of the documents, and the number of ids of the part
before the block. These offsets give random access; numpy unpacks a block at once. Spark's committer makes the write atomic on
any store, and a lost executor's task is written again."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, bucket_of_bounds, dropped, parts_for, range_starts, saved
from .text import SPACE, U, chunks, mix, text_bytes

BLOCK_IDS = 1 << 16
#: Pieces remembered by a worker, some 200 bytes each. At half of them the older half is dropped, but for what is used again.
_REMEMBERED = 400_000
#: Bytes of a piece that is told from others by comparison of three words; longer ones are compared singly.
_SHORT = 24
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_encoders: dict = {}


def width(vocabulary: int) -> int:
    """The least bits for ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, `bits` bits each, low bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    shifts = np.arange(bits, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> shifts) & 1).astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, first: int = 0) -> np.ndarray:
    """`n` ids from place `first` on, as unsigned 32-bit numbers."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n, 2 * first).astype("<u4")
    start = first * bits
    raw = np.frombuffer(data, np.uint8)[start // 8 : (start + n * bits + 7) // 8]
    flat = np.unpackbits(raw, bitorder="little")[start % 8 : start % 8 + n * bits]
    return (flat.reshape(n, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


def odd_space(data: np.ndarray) -> np.ndarray:
    """Places of white space other than 9 to 13 and 32, and of characters that some Unicode tables count as such: 1C to 1F,
    85, A0, 1680, 180E, 2000 to 200D, 2028, 2029, 202F, 205F, 2060, 3000, FEFF."""
    found = (data >= 0x1C) & (data <= 0x1F)
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        wide = (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E))
        wide |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8D) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        wide |= (a == 0xE2) & (b == 0x81) & ((c == 0x9F) | (c == 0xA0)) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xEF) & (b == 0xBB)
        found[:-2] |= wide
    if len(data) > 1:
        found[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    return np.flatnonzero(found)


class Encoder:
    """The library's ids for whole texts. Byte-level BPE cuts a text before white space that follows other text, whatever
    stands on either side; so the library encodes each distinct piece between such places once in a worker's memory, new ones
    many to a call. Pieces are told apart by their bytes. A text with odd white space or a special token's string goes to the
    library whole; `whole` is that plain path."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level BPE writes each byte as one character, so the length of a token is that of its name
        self.length = np.zeros(self.vocabulary, np.int64)
        for name, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.length[i] = len(name)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, pieces: list[bytes]) -> None:
        """Encodes pieces that aren't known. Pieces that begin with white space and end otherwise follow one another in one
        text, cut again where the lengths of their tokens say so; others go alone."""
        joined, alone = [], []
        for p in pieces:
            (joined if SPACE[p[0]] and not SPACE[p[-1]] else alone).append(p)
        for k in range(0, len(joined), 2048):
            some = joined[k : k + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            end = np.cumsum(self.length[ids])
            wanted = np.cumsum([len(p) for p in some])
            cut = np.searchsorted(end, wanted)
            if len(end) and (end[np.minimum(cut, len(end) - 1)] == wanted).all():
                raw, cut = ids.tobytes(), (4 * cut + 4).tolist()
                self.known.update(zip(some, [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)], strict=True))
            else:  # a tokenizer that doesn't cut so
                alone += some
        for k in range(0, len(alone), 2048):
            some = alone[k : k + 2048]
            for p, got in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False), strict=True):
                self.known[p] = np.array(got.ids, "<u4").tobytes()

    def _by_pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(at) - 1, np.int64)
        if len(self.known) > _REMEMBERED // 2:
            self.known, self.older = {}, self.known
        space = SPACE[data]
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = space[1:] & ~space[:-1]
        begin[at] = True
        start = np.flatnonzero(begin[:-1])
        size = np.diff(np.append(start, len(data)))
        raw = data.tobytes() + bytes(_SHORT)
        word = np.ndarray((len(data) + _SHORT - 7,), "<u8", raw, strides=(1,))
        parts = [word[start + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)] for k in range(_SHORT // 8)]
        key = size.astype(U)
        for part in parts:
            key = mix(key ^ part)
        _, one, of = np.unique(key, return_index=True, return_inverse=True)
        same = (size <= _SHORT) & (size == size[one][of])
        for part in parts:
            same &= part == part[one][of]
        pieces = [raw[a:b] for a, b in zip(start[one].tolist(), (start + size)[one].tolist(), strict=True)]
        if not same.all():  # long pieces, or two of one key
            place = {p: i for i, p in enumerate(pieces)}
            for i in np.flatnonzero(~same).tolist():
                p = raw[start[i] : start[i] + size[i]]
                of[i] = place.setdefault(p, len(place))
                if of[i] == len(pieces):
                    pieces.append(p)
        known, older = self.known, self.older
        new = []
        for p in pieces:
            if p not in known:
                if (ids := older.get(p)) is None:
                    new.append(p)
                else:
                    known[p] = ids
        self._learn(new)
        held = list(map(known.__getitem__, pieces))
        ids = np.fromiter(map(len, held), np.int64, len(held)) // 4
        flat, offset, n = np.frombuffer(b"".join(held), "<u4"), np.cumsum(ids) - ids, ids[of]
        done = np.concatenate(([0], np.cumsum(n)))
        return flat[np.arange(int(done[-1])) - np.repeat(done[:-1] - offset[of], n)], np.diff(done[np.searchsorted(start, at)])

    def odd(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts that can't be encoded by pieces."""
        places = [odd_space(data)]
        raw = data.tobytes()
        for token in self.added:
            found = raw.find(token)
            while found >= 0:
                places.append(np.array([found]))
                found = raw.find(token, found + 1)
        return np.unique(np.searchsorted(at, np.concatenate(places), "right") - 1)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[at[i]:at[i+1]], one after another, and how many each has."""
        odd = self.odd(data, at)
        if not len(odd):
            return self._by_pieces(data, at)
        size = np.diff(at)
        plain = np.ones(len(size), bool)
        plain[odd] = False
        ids, n = self._by_pieces(data[np.repeat(plain, size)], np.concatenate(([0], np.cumsum(np.where(plain, size, 0)))))
        cut = np.concatenate(([0], np.cumsum(n)))
        out, last = [], 0
        for i in odd.tolist():
            whole = self.whole(data[at[i] : at[i + 1]].tobytes().decode())
            out += [ids[cut[last] : cut[i]], whole]
            n[i], last = len(whole), i
        return np.concatenate([*out, ids[cut[last] :]]), n


BLOCKS = "part int, block int, first long, n_ids long, doc_ids array<long>, lengths array<int>, packed binary"


def _encoded(path: str, end_id: int, bits: int, bounds: list[tuple[int, int]]):
    wide = np.dtype("<u2" if bits <= 16 else "<u4")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder.of(path)
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            part = pa.array(bucket_of_bounds(batch.column("at").to_numpy(), batch.column("h").to_numpy(), bounds).astype(np.int32))
            for x, y in chunks(at):
                ids, n = encoder.encode(data[at[x] : at[y]], at[x : y + 1] - at[x])
                cut = np.concatenate(([0], np.cumsum(n + 1)))
                out = np.full(int(cut[-1]), end_id, wide)
                own = np.ones(len(out), bool)
                own[cut[1:] - 1] = False
                out[own] = ids
                packed = pa.BinaryArray.from_buffers(pa.binary(), y - x, [None, pa.py_buffer((cut * wide.itemsize).astype(np.int32)), pa.py_buffer(out.tobytes())])
                yield pa.record_batch([*(batch.column(c).slice(x, y - x) for c in ("doc_id", "at", "h")), part.slice(x, y - x), pa.array(n + 1), packed], ["doc_id", "at", "h", "part", "n", "ids"])

    return run


def _written(bits: int):
    wide = np.dtype("<u2" if bits <= 16 else "<u4")

    def blocks(batches):
        part, block, first = None, 0, 0
        names, lengths, held, n = [], [], [], 0

        def closed():
            packed = pack(np.frombuffer(b"".join(held), wide), bits)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([packed], pa.binary())], ["part", "block", "first", "n_ids", "doc_ids", "lengths", "packed"])

        for batch in batches:
            for own, name, size, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "ids")), strict=True):
                if own != part or n >= BLOCK_IDS:
                    if names:
                        yield closed()
                    block, first = (0, 0) if own != part else (block + 1, first + n)
                    part, names, lengths, held, n = own, [], [], [], 0
                names.append(name)
                lengths.append(size)
                held.append(ids)
                n += size
        if names:
            yield closed()

    return blocks


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partitions: int | None = None) -> tuple[DataFrame, int]:
    """Encodes every whole text (null: empty) with the tokenizer file at `path`, appends `end_id`, and writes blocks in
    ascending id order, null ids first; rows that share an id are ordered by a hash of their text, then by their ids. Returns
    the written dataset and the bits of an id. Part p holds ids before those of part p + 1, and blocks of a part follow one
    another. Parts are ranges of id and hash, so rows without an id spread; texts are encoded once, and only ids move."""
    arrow_limits(docs.sparkSession)
    bits = width(Encoder.of(path).vocabulary)
    place = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("at"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")]
    narrow = saved(docs.select(*place, F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n")), "token-places")
    n = partitions or parts_for(narrow, F.col("n"))
    bounds = range_starts(narrow, n)[1:]
    dropped(narrow)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *place, F.col(text_col).alias("text"))
    ids = rows.mapInArrow(_encoded(path, end_id, bits, bounds), "doc_id long, at long, h long, part int, n long, ids binary")
    dealt = ids.repartition(n, "part").sortWithinPartitions("part", "at", "h", "ids").select("part", "doc_id", "n", "ids")
    return saved(dealt.mapInArrow(_written(bits), BLOCKS), "token-blocks"), bits


def read_tokens(blocks: DataFrame, bits: int) -> DataFrame:
    """One row for each document of the file: doc_id, start (ids of all documents before it), n_tokens, ids (bytes of
    little-endian unsigned 32-bit numbers), part and block."""
    spark = blocks.sparkSession
    arrow_limits(spark)
    index = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row for each partition
    before, starts = 0, []
    for part, n in index:
        starts.append((part, before))
        before += n
    def documents(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, block, n_ids, names, lengths, packed, start = (batch.column(c)[row] for c in ("part", "block", "n_ids", "doc_ids", "lengths", "packed", "start"))
                sizes = np.array(lengths.as_py(), np.int64)
                ids = unpack(packed.as_buffer(), bits, n_ids.as_py())
                at = np.concatenate(([0], np.cumsum(sizes)))
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids)])
                n = len(sizes)
                yield pa.record_batch([pa.array(names.as_py(), pa.int64()), pa.array(start.as_py() + at[:-1]), pa.array(sizes), raw, pa.array([part.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32())], ["doc_id", "start", "n_tokens", "ids", "part", "block"])

    placed = blocks.join(F.broadcast(spark.createDataFrame(starts, "part int, before long")), "part")
    return placed.select("part", "block", "n_ids", "doc_ids", "lengths", "packed", (F.col("before") + F.col("first")).alias("start")).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary, part int, block int")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """What the written files hold: doc_id, start, n_tokens and ids_crc32. An empty table gives no rows."""
    return read_tokens(*write_tokens(docs, path)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
