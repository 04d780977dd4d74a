"""The collection as XML: tracks with tempo changes and cue marks, and playlists."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Numbers of the cue kinds; fixed values of the format.
CUE_KINDS = {"cue": 0, "fade_in": 1, "fade_out": 2, "load": 3, "loop": 4}
_PLAIN = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~/:")
#: Attributes of a track that are always empty or 0, by the place after which they stand; fixed values of the format.
HEAD = '<?xml version="1.0" encoding="UTF-8" ?>\n<DJ_PLAYLISTS Version="1.0.0">\n'
TAIL = "    </NODE>\n  </PLAYLISTS>\n</DJ_PLAYLISTS>\n"


def escaped(value) -> str:
    """The five characters that XML keeps for itself, in an attribute's double quotes; others stay, line ends too."""
    out = str(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = out.replace(a, b)
    return out


def file_uri(path: str, root: str = "") -> str:
    if root and not path.startswith("/"):
        path = f"{root.rstrip('/')}/{path}"
    path = path.replace("\\", "/")
    coded = "".join(chr(b) if b in _PLAIN else f"%{b:02X}" for b in path.encode())
    return ("file://localhost" if coded.startswith("/") else "file://localhost/") + coded


def element(name: str, attributes: dict) -> str:
    """A start tag without its bracket; attributes without a value are left out."""
    return f"<{name}" + "".join(f' {k}="{escaped(v)}"' for k, v in attributes.items() if v is not None)


def tempo_rows(beats: list[tuple[int, float, int]], bpm: float, first_ms: float = 0.0) -> list[str]:
    """A row where the tempo differs from the beat before; without beats one for a known tempo."""
    row = lambda ms, tempo, number: element("TEMPO", {"Inizio": f"{ms / 1000:.3f}", "Bpm": f"{tempo:.2f}", "Metro": "4/4", "Battito": number}) + "/>"
    if not beats:
        return [row(first_ms, bpm, 1)] if bpm > 0 else []
    out, last = [], None
    for number, ms, tempo in beats:
        if tempo != last:
            out.append(row(ms, tempo / 100, min(max(number, 1), 4)))
        last = tempo
    return out


def mark(cue: dict, colors: bool = True) -> str:
    """A cue: memory cues have number -1, hot cues theirs less 1; a loop has an end; a hot cue's colour comes if it is known."""
    loop = cue["kind"] == "loop" or (cue.get("loop_ms") or 0) > 0
    end = f"{(cue['time_ms'] + (cue.get('loop_ms') or 0)) / 1000:.3f}" if loop else None
    rgb = cue.get("color") if colors and cue.get("slot") else None
    shown = dict(zip(("Red", "Green", "Blue"), rgb, strict=True)) if rgb else {}
    return element("POSITION_MARK", {"Name": cue.get("comment") or "", "Type": CUE_KINDS["loop" if loop else cue["kind"]], "Start": f"{cue['time_ms'] / 1000:.3f}", "End": end, "Num": cue["slot"] - 1 if cue.get("slot") else -1} | shown) + "/>"


def track(t: dict, root: str = "", added: str = "") -> str:
    own = {
        "TrackID": t["id"], "Name": t["title"], "Artist": t.get("artist") or "", "Composer": "", "Album": t.get("album") or "", "Grouping": "", "Genre": t.get("genre") or "", "Kind": t.get("kind") or "", "Size": t.get("size") or 0,
        "TotalTime": int((t.get("seconds") or 0) + 0.5), "DiscNumber": 0, "TrackNumber": t.get("track_number") or 0, "Year": t.get("year") or 0, "AverageBpm": f"{t.get('bpm') or 0:.2f}", "DateAdded": added, "BitRate": t.get("bitrate") or 0,
        "SampleRate": t.get("rate") or 0, "Comments": t.get("comment") or "", "PlayCount": 0, "Rating": 0, "Location": file_uri(t["path"], root), "Remixer": "", "Tonality": t.get("key") or "", "Label": t.get("label") or "", "Mix": "",
    }
    inner = tempo_rows(t.get("beats") or [], t.get("bpm") or 0, t.get("first_ms") or 0) + [mark(c) for c in t.get("cues") or []]
    head = "    " + element("TRACK", own)
    return head + "/>\n" if not inner else head + ">\n" + "".join(f"      {x}\n" for x in inner) + "    </TRACK>\n"


def collection(tracks: list[dict], playlists: dict[str, list[int]], product: str = "tonearm", version: str = "1.0", company: str = "", root: str = "", added: str = "") -> str:
    """Tracks have id, title, path and, if known, the other fields of `track`. Playlists come by name; one without a name is
    left out."""
    named = sorted((n, ids) for n, ids in playlists.items() if n)
    out = [HEAD, "  " + element("PRODUCT", {"Name": product, "Version": version, "Company": company}) + "/>\n", "  " + element("COLLECTION", {"Entries": len(tracks)}) + ">\n"]
    out += [track(t, root, added) for t in tracks]
    out += ["  </COLLECTION>\n  <PLAYLISTS>\n    " + element("NODE", {"Type": 0, "Name": "ROOT", "Count": len(named)}) + ">\n"]
    for name, ids in named:
        out.append("      " + element("NODE", {"Name": name, "Type": 1, "KeyType": 0, "Entries": len(ids)}) + ">\n")
        out += [f'        <TRACK Key="{i}"/>\n' for i in ids] + ["      </NODE>\n"]
    return "".join(out) + TAIL


def track_xml(t: dict[str, Column]) -> Column:
    """The same element for a row: `t` has columns by the names of `track`, strings for numbers with a fixed form, and inner,
    the lines inside the element."""
    text = lambda c: T.xml_escape(F.coalesce(t[c], F.lit(""))) if c in t else F.lit("")
    number = lambda c: F.coalesce(t[c], F.lit(0)).cast("string") if c in t else F.lit("0")
    own = [
        ("TrackID", number("id")), ("Name", text("title")), ("Artist", text("artist")), ("Composer", F.lit("")), ("Album", text("album")), ("Grouping", F.lit("")), ("Genre", text("genre")), ("Kind", text("kind")), ("Size", number("size")),
        ("TotalTime", number("seconds")), ("DiscNumber", F.lit("0")), ("TrackNumber", number("track_number")), ("Year", number("year")), ("AverageBpm", t["bpm"]), ("DateAdded", text("added")), ("BitRate", number("bitrate")),
        ("SampleRate", number("rate")), ("Comments", text("comment")), ("PlayCount", F.lit("0")), ("Rating", F.lit("0")), ("Location", T.file_uri(t["path"])), ("Remixer", F.lit("")), ("Tonality", text("key")), ("Label", text("label")), ("Mix", F.lit("")),
    ]
    head = F.concat(F.lit("    <TRACK"), *[x for k, v in own for x in (F.lit(f' {k}="'), v, F.lit('"'))])
    return F.concat(head, F.when(t["inner"] == "", "/>\n").otherwise(F.concat(F.lit(">\n"), t["inner"], F.lit("    </TRACK>\n"))))
