"""Corpus batches and packed key exchange.

Texts are written once as compressed batches. A stage sends each batch's distinct sorted keys, a packed row for each hash
partition; the partition answers each row in the same order; the answers meet the batch again. A packed row never holds less
than one key, so there are never more rows than keys, and a key that half of the corpus has arrives once from each batch."""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .text import U, byte_symbols, mix, rolling, stretch, text_bytes

#: Bytes of text in a batch; a longer text is a batch of its own.
BATCH = 4 << 20


def squeeze(data) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, their bytes laid out plane by plane, so that those of small values vanish."""
    return squeeze(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(expand(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view("<u8").astype(U)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=U)


class Batch:
    """Texts in ascending order of id (null ids first) and, within an id, of the text's hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: list, hashes: np.ndarray):
        self.data, self.offsets, self.ids, self.hashes = data, offsets, ids, hashes

    @classmethod
    def of(cls, row: dict) -> "Batch":
        return cls(np.frombuffer(expand(row["texts"]), np.uint8), unpack_sorted(row["offsets"]).astype(np.int64), row["ids"], unpack(row["hashes"]))


TABLE = "batch long, n_bytes long, ids array<long>, offsets binary, hashes binary, texts binary"


def _closed(number: int, rows: list[tuple]):
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    offsets = np.concatenate(([0], np.cumsum([len(r[1]) for r in rows]))).astype(U)
    return pa.record_batch([pa.array([number], pa.int64()), pa.array([int(offsets[-1])], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([pack_sorted(offsets)], pa.binary()), pa.array([pack(np.array([r[2] for r in rows], U))], pa.binary()), pa.array([squeeze(b"".join(r[1] for r in rows))], pa.binary())], ["batch", "n_bytes", "ids", "offsets", "hashes", "texts"])


def _batched(size: int):
    def run(batches):
        from pyspark import TaskContext

        number, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            raw = data.tobytes()
            for i, name in enumerate(ids):
                text = raw[at[i] : at[i + 1]]
                own = np.frombuffer(text, np.uint8)
                prefix = rolling(byte_symbols(own))
                rows.append((name, text, int(mix(stretch(prefix, np.array([0]), np.array([len(own)])) + U(len(own)))[0])))
                held += len(text)
                if held >= size:
                    yield _closed(number, rows)
                    number, rows, held = number + 1, [], 0
        if rows:
            yield _closed(number, rows)

    return run


def corpus_batches(docs: DataFrame, id_col: str, text_col: str, size: int = BATCH) -> DataFrame:
    """The saved batches of `docs`, a row each. Row groups stay small, as a row holds megabytes."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return saved(narrow.mapInArrow(_batched(size), TABLE), "batches", {"parquet.block.size": str(8 << 20), "compression": "none"})


#: Bytes of text behind one task of an exchange, and the most tasks that one shuffle is dealt to.
TASK, TASKS = 8 << 20, 100_000


class Sizes:
    """How an exchange over saved batches is dealt: `parts`, a power of two, are ranges of keys, about one for `each` batches
    at any size, and one is held at a time; `tasks` take the parts, in proportion to the bytes of text."""

    def __init__(self, batches: DataFrame, each: int = 2):
        n, size = batches.agg(F.count("batch"), F.sum("n_bytes")).first()
        self.parts = 1 << max(0, (max(1, -(-n // each)) - 1).bit_length())
        self.tasks = max(8, min(TASKS, -(-(size or 0) // TASK)))


def rows_of(batches):
    """The rows of Arrow batches as dictionaries, one at a time: a row may hold megabytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def parts_of(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, first, end) of each slice of sorted keys that isn't empty: a part holds a range of keys."""
    if not len(keys):
        return []
    own = (keys >> U(65 - parts.bit_length())).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return list(zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


def grouped(batches, key: str):
    """Streams rows sorted by `key` as (value, rows of that value)."""
    value, rows = None, []
    for row in rows_of(batches):
        if rows and row[key] != value:
            yield value, rows
            rows = []  # the receiver may have emptied its list
        value = row[key]
        rows.append(row)
    if rows:
        yield value, rows


def dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows with a part, those of a part together in one task."""
    return rows.repartition(tasks, "part").sortWithinPartitions("part")


def answered(batches: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """Rows for a stage that takes each batch with its answers: sorted by batch and part; the batch itself has the highest
    part and so comes after its answers."""
    last = F.lit((1 << 31) - 1)
    own = batches.select("batch", last.alias("part"), F.lit(None).cast("binary").alias("answer"), "ids", "offsets", "hashes", "texts")
    sent = answers.select("batch", "part", "answer", *[F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("offsets", "binary"), ("hashes", "binary"), ("texts", "binary"))])
    return own.union(sent).repartition(tasks, "batch").sortWithinPartitions("batch", "part")
