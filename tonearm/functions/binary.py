"""Byte encoders: content identity, device strings, tagged sections, row pages."""

import struct
from functools import lru_cache

#: Fixed values of the formats.
SAMPLE_WINDOW = 1 << 20
PAGE, HEADER, GROUP_ROWS, GROUP_BYTES = 4096, 0x28, 16, 36


def content_hash(data: bytes) -> str:
    """Identity of a blob: XXH3 of its first MiB and its length, as 16 hex digits."""
    import xxhash

    return f"{xxhash.xxh3_64_intdigest(data[:SAMPLE_WINDOW] + struct.pack('<Q', len(data))):016x}"


def window_hash(head, size: int) -> str:
    """The same from the first MiB, any buffer, and the length of the whole."""
    import xxhash

    state = xxhash.xxh3_64(head)
    state.update(struct.pack("<Q", size))
    return state.hexdigest()


class ContentHasher:
    """The same over chunks of any size."""

    def __init__(self):
        self.head, self.length = bytearray(), 0

    def update(self, chunk: bytes) -> None:
        self.head += chunk[: SAMPLE_WINDOW - len(self.head)]
        self.length += len(chunk)

    def finish(self) -> str:
        import xxhash

        return f"{xxhash.xxh3_64_intdigest(bytes(self.head) + struct.pack('<Q', self.length)):016x}"


@lru_cache(1 << 14)
def device_string(s: str) -> bytes:
    """Short ASCII with a one-byte header, longer ASCII with marker 40, other text as UTF-16 with marker 90."""
    if not s:
        return b"\x03"
    if s.isascii():
        raw = s.encode()
        return bytes([((len(raw) + 1) << 1) + 1]) + raw if len(raw) <= 126 else struct.pack("<BHB", 0x40, len(raw) + 4, 0) + raw
    raw = s.encode("utf-16-le")
    return struct.pack("<BHB", 0x90, len(raw) + 4, 0) + raw


def section(tag: bytes, header: bytes, body: bytes) -> bytes:
    """Tag, header length, total length (big-endian), the rest of the header, and the body."""
    return tag + struct.pack(">II", 12 + len(header), 12 + len(header) + len(body)) + header + body


def path_section(path: str) -> bytes:
    raw = (path + "\0").encode("utf-16-be")
    return section(b"PPTH", struct.pack(">I", len(raw)), raw)


def beat_section(beats: list[tuple[int, float, int]]) -> bytes:
    """Beats as (number, hundredths of a beat a minute, whole ms)."""
    body = b"".join(struct.pack(">HHI", n, tempo, int(ms)) for n, ms, tempo in beats)
    return section(b"PQTZ", struct.pack(">III", 0, 0x80000, len(beats)), body)


def preview_section(columns: list[tuple[int, int]]) -> bytes:
    """400 columns, whiteness in the high three bits and height in the low five."""
    body = bytes((w & 7) << 5 | h & 31 for h, w in columns).ljust(400, b"\0")[:400]
    return section(b"PWAV", struct.pack(">II", 400, 0x10000), body)


def tiny_preview(columns: list[tuple[int, int]]) -> bytes:
    """100 columns, each the largest of four bytes of the preview."""
    raw = bytes((w & 7) << 5 | h & 31 for h, w in columns).ljust(400, b"\0")[:400]
    return bytes(max(raw[i : i + 4]) for i in range(0, 400, 4))


def seek_offsets(size: int) -> list[int]:
    """400 evenly spaced byte offsets."""
    return [size * i // 400 for i in range(400)]


def packed_pages(rows: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """Greedy packing of rows into pages: (offset in the heap, row) by page. The heap grows from the header, the row index
    from the page's end, by a group of bytes ahead of every 16 rows. Rows are padded to four bytes where that fits."""
    pages: list[list[tuple[int, bytes]]] = []
    first = PAGE - HEADER - (1 // GROUP_ROWS + 1) * GROUP_BYTES
    used, here, room = 0, [], first  # room: how far the heap may reach with one row more
    for row in rows:
        if here and used + len(row) > room:
            pages.append(here)
            used, here, room = 0, [], first
        if used + len(row) > room:
            raise ValueError(f"a row of {len(row)} bytes is longer than a page")
        padding = -(used + len(row)) % 4
        after = PAGE - HEADER - ((len(here) + 2) // GROUP_ROWS + 1) * GROUP_BYTES
        padding = padding if used + len(row) + padding <= after else 0
        here.append((used, row + b"\0" * padding if padding else row))
        used, room = used + len(row) + padding, after
    return [*pages, here] if here else pages


def page_bytes(rows: list[tuple[int, bytes]]) -> bytes:
    """Heap and reversed row index of one page, header bytes zero: slot 15 of a group holds its first row's offset."""
    out = bytearray(PAGE)
    for first in range(0, len(rows), GROUP_ROWS):
        group = rows[first : first + GROUP_ROWS]
        n, end = len(group), PAGE - first // GROUP_ROWS * GROUP_BYTES
        for at, row in group:
            out[HEADER + at : HEADER + at + len(row)] = row
        struct.pack_into(f"<{n + 2}H", out, end - 4 - 2 * n, *[at for at, _ in reversed(group)], (1 << n) - 1, (1 << n) - 1)
    return bytes(out)
