"""Vectorised kernels over the bytes of a batch of texts."""

import hashlib

import numpy as np
import pyarrow as pa

#: Words of more bytes are hashed one by one.
LONG = 64
#: Bytes of text handled by one kernel call; each takes some ten arrays of eight bytes a byte.
CHUNK = 1 << 21

U = np.uint64
_rng = np.random.RandomState(20240229)
_BYTE = (_rng.randint(0, 1 << 32, 256).astype(U) << U(32)) | _rng.randint(0, 1 << 32, 256).astype(U)
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside the words of a bag: ASCII signs as well as white space.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = 1 << max(12, (n - 1).bit_length())
        got = np.empty(size, U)
        got[0] = 1
        done = 1
        while done < size:
            got[done : 2 * done] = got[:done] * U(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = got
    return got[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + U((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]), at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """(first, end) runs of whole texts of about `limit` bytes; a longer text is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end
        first = end


def rolling(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums that give the hash of any stretch through `stretch`."""
    out = np.empty(len(symbols) + 1, U)
    out[0] = 0
    np.cumsum(symbols * powers(_BASE, len(symbols)), out=out[1:])
    return out


def stretch(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end], the same wherever it stands."""
    return (prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start]


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes other than those of `between`, space and 9 to 13 by default) and the number
    of words before each text, n + 1 values."""
    solid = ~between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], after[-1] = True, True
        before[1:] = ~solid[:-1] | cut[1:-1]
        after[:-1] = ~solid[1:] | cut[1:-1]
    start = np.flatnonzero(solid & before)
    end = np.flatnonzero(solid & after) + 1
    return start, end, np.searchsorted(start, offsets).astype(np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z lower-cased, and the number of words before each text. Each step scrambles eight bytes
    into all that came before, so no pattern of bytes makes words collide; words over LONG bytes are hashed singly."""
    start, end, first = words(data, offsets, between)
    size = end - start
    raw = LOWER[data].tobytes() + bytes(LONG)
    word = np.ndarray((len(data) + LONG - 7,), "<u8", raw, strides=(1,))
    out, live = mix(size.astype(U), 5), np.arange(len(size))
    for k in range(0, LONG, 8):
        if k >= 24:  # few words are longer
            live = live[size[live] > k]
        if not len(live):
            break
        part = word[start[live] + k] & _LEAD[np.clip(size[live] - k, 0, 8)]
        out[live] = np.where(size[live] > k, mix(out[live] ^ part, 6), out[live])
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
    return out, first


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` words and the number of runs before each text. A text with fewer words, but some, has
    the whole sequence as its one run."""
    count = np.diff(first)
    runs = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_first = np.concatenate(([0], np.cumsum(runs)))
    total = np.zeros(int(out_first[-1]), U)
    at = np.arange(len(total), dtype=np.int64) - np.repeat(out_first[:-1], runs) + np.repeat(first[:-1], runs)
    last = np.repeat(first[1:], runs)
    for k in range(width):
        here = at + k
        inside = here < last
        value = np.zeros(len(total), U)
        value[inside] = hashes[here[inside]]
        total += (value + U(k + 1)) * U((_BASE * (2 * k + 3)) & _MASK | 1)
    return mix(total), out_first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one after another, and the number before each text."""
    hashes, first = word_hashes(data, offsets)
    runs, at = shingles(hashes, first, width)
    own = [np.unique(runs[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    sizes = np.fromiter((len(x) for x in own), np.int64, len(own))
    return (np.concatenate(own) if own else np.zeros(0, U)), np.concatenate(([0], np.cumsum(sizes)))
