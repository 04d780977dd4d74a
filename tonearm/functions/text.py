"""Scalar functions: paths, names, keys, codes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Camelot number by pitch class, minor and major; fixed values of the wheel.
CAMELOT_MINOR = [5, 12, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10]
CAMELOT_MAJOR = [8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1]
#: File type code by extension; fixed values of the format.
FILE_TYPES = {"mp3": 1, "m4a": 4, "aac": 4, "flac": 5, "wav": 11, "aiff": 12, "aif": 12}


def raw_path(h: Column, ext: Column) -> Column:
    return F.concat(F.substring(h, 1, 2), F.lit("/"), h, F.lit("."), ext)


def bundle_path(h: Column) -> Column:
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), h)


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def tag_file_path(track_id: Column) -> Column:
    return F.format_string("PIONEER/USBANLZ/P%03d/%08X/ANLZ0000.DAT", F.floor(track_id / 256) % 1000, track_id)


def artwork_path(artwork_id: Column, full: bool = False) -> Column:
    """Folder of a hundred and file of an artwork: the thumbnail, or the full size."""
    return F.concat(F.format_string("%05d", F.floor(artwork_id / 100) + 1), F.lit("/a"), artwork_id.cast("string"), F.lit("_m.jpg" if full else ".jpg"))


def safe_name(name: Column) -> Column:
    return F.translate(name, '/\\:*?"<>|', "_________")


def relative(path: Column) -> Column:
    """Whether no part of a path is empty, '.' or '..'."""
    return (path != "") & F.forall(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))


def xml_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def camelot(pitch: Column, major: Column) -> Column:
    at = (pitch % 12 + 1).cast("int")
    n = F.when(major, F.element_at(F.array(*map(F.lit, CAMELOT_MAJOR)), at)).otherwise(F.element_at(F.array(*map(F.lit, CAMELOT_MINOR)), at))
    return F.concat(n.cast("string"), F.when(major, "B").otherwise("A"))


def file_type(ext: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])[F.lower(ext)], F.lit(0))


#: How the collection names a file's kind, by type code; fixed values of the format.
KINDS = {1: "MP3 File", 4: "M4A File", 5: "FLAC File", 11: "WAV File", 12: "AIFF File"}


def kind(ext: Column) -> Column:
    """The kind of a file; of an unknown type its extension, if it has one."""
    known = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[file_type(ext)]
    return F.coalesce(known, F.when(F.coalesce(ext, F.lit("")) != "", F.concat(F.upper(ext), F.lit(" File"))), F.lit(""))


def audio_mime(mime: Column) -> Column:
    """Whether a listed file counts as audio; one without a type does."""
    return mime.isNull() | mime.startswith("audio/") | (mime == "application/octet-stream")


#: Titles of list entries that can't be had; fixed phrases of the service.
UNLISTED = ("Private video", "Deleted video")


def listed(title: Column) -> Column:
    return ~title.isin(*UNLISTED)


def search_defaults() -> list[Column]:
    """title, uploader, url and video_id of a search result; an empty field counts as missing."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    address = F.concat(F.lit("https://www.youtube.com/watch?v="), given("id"))
    return [F.coalesce(given("title"), F.lit("Unknown Title")).alias("title"), F.coalesce(given("uploader"), F.lit("Unknown")).alias("uploader"), F.coalesce(given("url"), given("webpage_url"), address, F.lit("")).alias("url"), F.coalesce("id", F.lit("")).alias("video_id")]


def credentials(username: Column, password: Column) -> Column:
    """A name that isn't blank and a password of eight bytes at least."""
    return (F.trim(username) != "") & (F.octet_length(password) >= 8)


#: Names of the pitch classes, and the pitch class of each key number of a mode; fixed values of the device.
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
PITCHES = [0, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10, 5]
#: Colours of hot cue slots 1 to 8 as palette number, red, green, blue; fixed values of the device. Other slots have the first.
SLOT_COLORS = ((0x00, 0x28, 0xE2, 0x14), (0x09, 0x00, 0xE0, 0xFF), (0x11, 0x00, 0x50, 0xFF), (0x3E, 0x64, 0x73, 0xFF), (0x1A, 0xFF, 0x00, 0xC8), (0x2A, 0xE6, 0x28, 0x28), (0x22, 0xFF, 0xA0, 0x00), (0x32, 0xFF, 0xFF, 0x00))


def key_name(pitch: Column, major: Column) -> Column:
    note = F.element_at(F.array(*map(F.lit, NOTES)), (pitch % 12 + 1).cast("int"))
    return F.when(major, note).otherwise(F.concat(note, F.lit("m")))


def key_of_id(key_id: Column) -> tuple[Column, Column]:
    """Pitch class and whether the key is major, from its number; C minor for none or an unknown one."""
    known = key_id.between(1, 24)
    pitch = F.when(known, F.element_at(F.array(*map(F.lit, PITCHES)), ((key_id - 1) % 12 + 1).cast("int"))).otherwise(0)
    return F.coalesce(pitch, F.lit(0)), F.coalesce(known & (key_id > 12), F.lit(False))


def slot_color(slot: Column) -> Column:
    """Palette number, red, green and blue as one number of four bytes."""
    packed = [c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3] for c in SLOT_COLORS]
    return F.when(slot.between(1, 8), F.element_at(F.array(*[F.lit(x).cast("long") for x in packed]), F.greatest(slot, F.lit(1)).cast("int"))).otherwise(F.lit(packed[0]).cast("long"))


def column_bytes(*values: Column) -> Column:
    """Bytes of seven bits each, as upper-case hex."""
    return F.concat(*[F.lpad(F.hex(v.bitwiseAND(F.lit(127)).cast("long")), 2, "0") for v in values])


def preview_byte(whiteness: Column, height: Column) -> Column:
    return F.shiftleft(whiteness.bitwiseAND(F.lit(7)), 5).bitwiseOR(height.bitwiseAND(F.lit(31)))


def color_word(r: Column, g: Column, b: Column, h: Column) -> Column:
    return F.shiftleft(r.bitwiseAND(F.lit(7)), 13).bitwiseOR(F.shiftleft(g.bitwiseAND(F.lit(7)), 10)).bitwiseOR(F.shiftleft(b.bitwiseAND(F.lit(7)), 7)).bitwiseOR(F.shiftleft(h.bitwiseAND(F.lit(31)), 2))


def percent_encoded(path: Column) -> Column:
    """Letters, digits, - _ . ~ / : stay; every other byte becomes % and two upper-case hex digits."""
    coded = F.url_encode(path)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%3A", ":"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return coded


def file_uri(path: Column, root: str = "") -> Column:
    """The address of a file: backslashes become slashes; a path without a leading slash is under `root`, if that is given."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path)) if root else path
    coded = percent_encoded(F.replace(whole, F.lit("\\"), F.lit("/")))
    return F.concat(F.when(coded.startswith("/"), "file://localhost").otherwise("file://localhost/"), coded)


def isrc(code: Column) -> Column:
    """The device's bytes of a recording code, as upper-case hex: marker 90, length, 0, 3, the code, 0; '' is one byte."""
    n = F.octet_length(code) + 6
    low, high = n.bitwiseAND(F.lit(255)).cast("long"), F.shiftright(n, 8).cast("long")
    return F.when(code == "", "03").otherwise(F.concat(F.lit("90"), F.lpad(F.hex(low), 2, "0"), F.lpad(F.hex(high), 2, "0"), F.lit("0003"), F.hex(F.encode(code, "UTF-8")), F.lit("00")))


def bitrate(coded_bits: Column, bit_depth: Column, rate: Column) -> Column:
    """Thousands of bits a second: from the coded size of a sample, else that of two channels of 16 or 24 bits, else 320."""
    two = F.when(bit_depth.isin(16, 24), F.expr("1") * rate * bit_depth * 2)
    return F.coalesce(F.floor(coded_bits * rate / 1000), F.floor(two / 1000), F.lit(320)).cast("long")


DASH = "—"


def shown_bpm(bpm: Column) -> Column:
    return F.coalesce(F.bround(bpm, 0).cast("long").cast("string"), F.lit(DASH))


def shown_mb(size: Column) -> Column:
    return F.when(size.isNotNull(), F.format_string("%.1f", F.bround(size / (1 << 20), 1))).otherwise(DASH)


def clock(seconds: Column) -> Column:
    whole = F.round(seconds).cast("long")
    return F.when(whole.isNotNull(), F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)).otherwise(DASH)


#: Messages of errors that a retry can't mend; fixed phrases of the downloader.
PERMANENT = ("Video unavailable", "Private video", "Sign in to confirm your age", "Sign in to confirm you're not a bot")


def permanent_error(message: Column) -> Column:
    found = F.lit(False)
    for phrase in PERMANENT:
        found = found | message.contains(phrase)
    return F.coalesce(found, F.lit(False))


def key_id(pitch: Column, major: Column) -> Column:
    """1 to 12 for minor keys round the circle of fifths from C, 13 to 24 for major ones."""
    return ((pitch % 12) * 7 % 12 + 1 + F.when(major, 12).otherwise(0)).cast("int")


def backoff_bound(attempt: Column, base: int = 10, most: int = 120) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt))
