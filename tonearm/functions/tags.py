"""Tagged analysis files: sections of one track put together."""

import struct

import numpy as np

from .binary import beat_section, path_section, preview_section, section, seek_offsets, tiny_preview
from .text import SLOT_COLORS

#: Words of the file header after its length, and of section headers; fixed values of the format.
FILE_WORDS = (1, 0x10000, 0x10000, 0)
DETAIL_WORD, COLOR_DETAIL_WORD = 0x960000, 0x960305


def file_of(sections: list[bytes]) -> bytes:
    body = b"".join(sections)
    return b"PMAI" + struct.pack(">6I", 28, 28 + len(body), *FILE_WORDS) + body


def seek_section(size: int, samples: int) -> bytes:
    return section(b"PVBR", struct.pack(">I", 0), struct.pack(">401I", *(o & 0xFFFFFFFF for o in seek_offsets(size)), samples & 0xFFFFFFFF))


def tiny_section(columns: list[tuple[int, int]]) -> bytes:
    return section(b"PWV2", struct.pack(">II", 100, 0x10000), tiny_preview(columns))


def entries(tag: bytes, rows: np.ndarray, *words: int) -> bytes:
    """A section of equal entries: their width, their number and further words in the header."""
    raw = np.ascontiguousarray(rows, np.uint8)
    return section(tag, struct.pack(f">{2 + len(words)}I", raw.shape[1], len(raw), *words), raw.tobytes())


def detail_mono(d: np.ndarray) -> bytes:
    white = np.minimum(d[:, :3].astype(int).sum(1) // 3, 7)
    return entries(b"PWV3", (white << 5 | d[:, 3] & 31)[:, None], DETAIL_WORD)


def detail_color(d: np.ndarray) -> bytes:
    r, g, b, h = (d[:, k].astype(np.uint16) for k in range(4))
    word = (r & 7) << 13 | (g & 7) << 10 | (b & 7) << 7 | (h & 31) << 2
    return entries(b"PWV5", word.astype(">u2").view(np.uint8).reshape(-1, 2), COLOR_DETAIL_WORD)


def detail_bands(d: np.ndarray) -> bytes:
    scaled = (d[:, :3].astype(int) & 7) * (d[:, 3:].astype(int) & 31) * 127 // (7 * 31)
    return entries(b"PWV7", np.minimum(scaled, 127), DETAIL_WORD)


def no_cues(kind: int) -> tuple[bytes, bytes]:
    """Empty cue lists, plain and extended, for hot cues (1) or memory cues (0)."""
    return section(b"PCOB", struct.pack(">IHHI", kind, 0, 0, 0xFFFFFFFF), b""), section(b"PCO2", struct.pack(">IHH", kind, 0, 0), b"")


#: Numbers of the cue kinds in plain and in extended lists; fixed values of the format.
PLAIN_KINDS = {"cue": 0, "fade_in": 1, "fade_out": 2, "load": 3, "loop": 4}
EXTENDED_KINDS = {"cue": 1, "loop": 2, "fade_in": 3, "fade_out": 4, "load": 5}
NO_TIME = 0xFFFFFFFF


def _ends(cue: dict) -> tuple[int, int]:
    """Start in whole milliseconds and, of a loop, its end."""
    loop = cue.get("loop_ms") or 0
    return int(cue["time_ms"]), int(cue["time_ms"] + loop) if loop > 0 else NO_TIME


def cue_list(cues: list[dict]) -> bytes:
    """The plain list of all cues, an entry of 24 bytes each; nothing without cues is `no_cues`."""
    body = b"".join(b"PCP\x01" + struct.pack(">5I", 20, c.get("slot") or 0, PLAIN_KINDS[c["kind"]], *_ends(c)) for c in cues)
    return b"PCOB" + struct.pack(">3IHHI", 24, 24 + len(body), 1, 0, len(cues), NO_TIME) + body


def extended_cues(cues: list[dict]) -> bytes:
    """The extended lists, hot cues first, each if it has any: entries with comment and, of hot cues, a colour, by default
    that of the slot."""
    out = b""
    for hot in (True, False):
        some = [c for c in cues if bool(c.get("slot")) == hot]
        body = b""
        for c in some:
            comment = c.get("comment")
            note = b"" if comment is None else struct.pack(">I", len(comment.encode()) + 1) + comment.encode() + b"\0"
            length = (56 if hot else 40) + (0 if comment is None else len(comment.encode()) + 4)
            slot = c.get("slot") or 0
            body += b"PCP2" + struct.pack(">6I8x", length - 4, slot, EXTENDED_KINDS[c["kind"]], *_ends(c), 0) + note
            if hot:
                body += bytes(c.get("color") or SLOT_COLORS[slot - 1 if 1 <= slot <= len(SLOT_COLORS) else 0]) + bytes(4)
        if some:
            sizes = sum((56 if hot else 40) + (0 if c.get("comment") is None else len(c["comment"].encode()) + 4) for c in some)
            out += b"PCO2" + struct.pack(">3IHH", 16, 20 + sizes, int(hot), 0, len(some)) + body
    return out


def gains() -> bytes:
    return b"PWVC" + struct.pack(">II4H", 14, 20, 0, 100, 100, 100)


def tag_files(path: str, beats: list, preview: list, color: np.ndarray, detail: np.ndarray, size: int, samples: int) -> dict[str, bytes]:
    """The three files of a track, by extension; their cue lists are empty, as players expect of a fresh export."""
    (hot, hot2), (memory, memory2) = no_cues(1), no_cues(0)
    where = path_section(path)
    return {
        "DAT": file_of([where, seek_section(size, samples), beat_section(beats), preview_section(preview), tiny_section(preview), hot, memory]),
        "EXT": file_of([where, detail_mono(detail), hot, memory, hot2, memory2, detail_color(detail), entries(b"PWV4", color & 0x7F, 0)]),
        "2EX": file_of([where, detail_bands(detail), entries(b"PWV6", color[:, [2, 3, 4]] & 0x7F), gains()]),
    }
