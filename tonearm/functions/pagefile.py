"""Comparison and checks of page files."""

import struct
from bisect import bisect_right

import numpy as np

from .binary import HEADER, PAGE

#: First byte and name of the fields of the file header and of a page header; fixed values of the format.
FILE_FIELDS = ((0x00, "fh:zero"), (0x04, "fh:page_size"), (0x08, "fh:num_tables"), (0x0C, "fh:next_unused_page"), (0x10, "fh:unknown"), (0x14, "fh:sequence"), (0x18, "fh:gap"), (0x1C, "fh:table_pointers"))
PAGE_FIELDS = ((0x00, "zero"), (0x04, "page_index"), (0x08, "page_type"), (0x0C, "next_page"), (0x10, "sequence"), (0x14, "unknown"), (0x18, "packed_counts"), (0x1B, "flags"), (0x1C, "free_size"), (0x1E, "used_size"), (0x20, "page_hdr_tail"), (0x28, "heap/row-data"))
MERGED, TABLES = 3, 20
#: Flags of empty, data and index pages; fixed values of the format.
FLAGS = (0x00, 0x24, 0x34, 0x64)


def field(page: int, offset: int) -> str:
    names = PAGE_FIELDS if page else FILE_FIELDS
    return names[bisect_right([at for at, _ in names], offset) - 1][1]


def diff(left: bytes, right: bytes) -> dict:
    """Runs of differing bytes, places no more than MERGED apart in one run, as (page, first, last, field); and the pages
    that one file has more."""
    pages = [len(x) // PAGE for x in (left, right)]
    both = min(pages)
    a, b = (np.frombuffer(x, np.uint8, both * PAGE) for x in (left, right))
    at = np.flatnonzero(a != b)
    new = np.append(True, (np.diff(at) > MERGED) | (np.diff(at // PAGE) > 0)) if len(at) else np.zeros(0, bool)
    first, last = at[new], at[np.append(new[1:], True)] if len(at) else at
    runs = [(int(f // PAGE), int(f % PAGE), int(e % PAGE), field(int(f // PAGE), int(f % PAGE))) for f, e in zip(first, last, strict=True)]
    return {"runs": runs, "only_left": list(range(both, pages[0])), "only_right": list(range(both, pages[1])), "identical": not runs and pages[0] == pages[1]}


def check(data: bytes, phantom: bool = True) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a file's shape and header. With `phantom`, pages that the header counts past the end are those
    set aside for growth and no error. Empty pages carry no number."""
    if len(data) < PAGE:
        return [f"{len(data)} bytes are less than a page"], []
    if len(data) % PAGE:
        return [f"{len(data)} bytes are not whole pages"], []
    size, tables, unused = struct.unpack_from("<III", data, 4)
    if size != PAGE:
        return [f"page size {size} instead of {PAGE}"], []
    errors = [] if phantom or unused <= len(data) // PAGE else [f"next unused page {unused} past the {len(data) // PAGE} pages"]
    for i in range(min(tables, (PAGE - 28) // 16)):
        kind, _, first, last = struct.unpack_from("<4I", data, 28 + 16 * i)
        if max(first, last) >= len(data) // PAGE:
            errors.append(f"table {kind} points to page {max(first, last)}")
    warnings = [f"{tables} tables"] if tables > TABLES else []
    for page in range(1, len(data) // PAGE):
        number, flags, used = struct.unpack_from("<I19xB2xH", data, page * PAGE + 4)
        if flags not in FLAGS:
            warnings.append(f"page {page}: flags {flags:#04x}")
        elif used > PAGE - HEADER:
            warnings.append(f"page {page}: {used} bytes used")
        elif flags and number != page:
            warnings.append(f"page {page}: numbered {number}")
    return errors, warnings


def row_counts(data: bytes) -> dict[int, int]:
    """Rows of each kind of table, by its chain from the index page on; a chain ends past the file or at a page seen before."""
    counts = {}
    for i in range(min(struct.unpack_from("<I", data, 8)[0], (PAGE - 28) // 16)):
        kind, _, page, last = struct.unpack_from("<4I", data, 28 + 16 * i)
        counts[kind], seen = 0, {page}
        page = page + 1 if last > page else PAGE * len(data)
        while page < len(data) // PAGE and page not in seen:
            seen.add(page)
            following, packed = struct.unpack_from("<I8xI", data, page * PAGE + 12)
            counts[kind] += packed & 0x7FF
            page = following
    return counts
