"""A user's export: identity of the device, manifest, records, collection as XML, cue lists."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import collection as C
from ..functions import identity as I
from ..functions import text as T
from ..sources import tables as S
from .base import query
from .device import listed, numbered, numbers

_FOLD = "list_reduce(list_prepend(14695981039346656037::hugeint, bytes), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)"
_SEED = f"""(select user_id, case when fold = 0 then 1311768467463790320::hugeint else fold end as seed from (select user_id, {_FOLD} as fold from (select user_id, list(byte::hugeint order by part, a, b) as bytes from (
  select user_id, 0 as part, content_id as a, k as b, (content_id >> (8 * k)) & 255 as byte from numbered, (select unnest(range(0, 4)) as k) union all
  select user_id, 1, number, k, ord(substr(name, cast(k as int), 1)) from listed, (select unnest(range(1, 100)) as k) where k <= strlen(name)) group by user_id)))"""


def seeds(spark, d):
    """The seed of each user's device: their track numbers, then the names of their playlists in order. A user with playlists
    alone has one too."""
    ids = numbers(spark, d).select("user_id", F.lit(0).alias("part"), F.col("content_id").alias("at"), F.lit("").alias("name"))
    names = listed(spark, d).select("user_id", F.lit(1).alias("part"), F.col("number").alias("at"), "name")
    rows = ids.unionByName(names).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("part", "at", "name"))).alias("rows"))
    data = F.transform("rows", lambda r: F.when(r["part"] == 0, I.id_bytes(r["at"])).otherwise(I.text_bytes(r["name"])))
    return rows.select("user_id", I.seed(F.flatten(data)).alias("seed"))


_UUID = "printf('%08x%08x', (seed >> 32)::bigint, (seed & 4294967295)::bigint) || printf('%08x%08x', (turned >> 32)::bigint, (turned & 4294967295)::bigint)"
_IDENTITY = f"""(select user_id, seed, {_UUID} as uuid, (seed & 2147483647)::bigint as library_id from (select *, xor(((seed * 131072) % 18446744073709551616::hugeint) | (seed >> 47), 11936128518282651045::hugeint) as turned from {_SEED}))"""


@query(f"""select user_id, uuid, library_id, concat('rbDevLibBaInfo_', library_id, '.json') as backup_name, concat('{{', chr(10), '  "uuid": "', uuid, '",', chr(10), '  "info": []', chr(10), '}}') as backup from {_IDENTITY}""")
def device_identity(spark, d):
    n = F.col("seed")
    return seeds(spark, d).select("user_id", I.uuid_of(n).alias("uuid"), I.library_id(n).alias("library_id"), I.backup_name(n).alias("backup_name"), I.backup_column(I.uuid_of(n)).alias("backup"))


@query("select user_id, upper(rpad(concat(repeat('00', 32), hex(substr(concat('DJ ', username, ' and a long name'), 1, 31))), 320, '0')) as profile, concat('60000000', hex('PIONEER DJ'), repeat('00', 22), hex('rekordbox'), repeat('00', 23), hex('6.8.4'), repeat('00', 27), '200000007856341201000000', repeat('01', 6), repeat('00', 18), '16D00000') as settings from users")
def device_side_files(spark, d):
    """The profile and the settings file of each device, as hex."""
    name = F.concat(F.lit("DJ "), "username", F.lit(" and a long name"))
    return S.users(spark, d).select("user_id", I.profile_column(name).alias("profile"), F.lit(I.settings_file().hex().upper()).alias("settings"))


_RAW = "printf('%016x', track_id)"


@query(f"""select user_id, row_number() over (partition by user_id order by step, content_id, part) as place, usb_path, size, source from (
  select user_id, step, 0 as content_id, 0 as part, case when step = 2 then concat('PIONEER/DeviceLibBackup/rbDevLibBaInfo_', library_id, '.json') else usb_path end as usb_path, size, '{{"kind":"staging"}}' as source
  from {_IDENTITY}, (values (0, 'PIONEER/rekordbox/export.pdb', null), (1, 'PIONEER/rekordbox/exportLibrary.db', null), (2, '', 62), (3, 'PIONEER/DEVSETTING.DAT', 140), (4, 'PIONEER/djprofile.nxs', 160)) v(step, usb_path, size)
  union all select user_id, 5, content_id, part, printf('PIONEER/USBANLZ/P%03d/%08X/ANLZ0000.', (content_id // 256) % 1000, content_id) || ext, null, '{{"kind":"staging"}}' from numbered, (values (0, 'DAT'), (1, 'EXT'), (2, '2EX')) v(part, ext)
  union all select user_id, 6, content_id, 0, concat('Contents/', {_RAW}, '.mp3'), p_size * 100000, concat('{{"kind":"raw","hash":"', {_RAW}, '"}}') from numbered join part on p_partkey = track_id)""")
def export_manifest(spark, d):
    """The files of each user's export in the order they are written, with their sizes as far as they are known beforehand."""
    staged = F.to_json(F.struct(F.lit("staging").alias("kind")))
    row = lambda step, path, size, id=F.lit(0), part=0, source=staged: F.struct(F.lit(step).alias("step"), id.cast("long").alias("content_id"), F.lit(part).alias("part"), path.alias("usb_path"), F.lit(size).cast("long").alias("size") if not hasattr(size, "cast") else size.cast("long").alias("size"), source.alias("source"))
    backup = F.concat(F.lit("PIONEER/DeviceLibBackup/"), I.backup_name(F.col("seed")))
    head = [row(0, F.lit("PIONEER/rekordbox/export.pdb"), None), row(1, F.lit("PIONEER/rekordbox/exportLibrary.db"), None), row(2, backup, F.octet_length(I.backup_column(I.uuid_of(F.col("seed"))))), row(3, F.lit("PIONEER/DEVSETTING.DAT"), I.SETTINGS_BYTES), row(4, F.lit("PIONEER/djprofile.nxs"), I.PROFILE_BYTES)]
    stem, n = F.regexp_replace(T.tag_file_path(F.col("content_id")), "DAT$", ""), F.col("content_id")
    size = S.table(spark, d, "part").select(F.col("p_partkey").alias("track_id"), (F.col("p_size") * 100000).alias("bytes"))
    raw = F.to_json(F.struct(F.lit("raw").alias("kind"), "hash"))
    per = [row(5, F.concat(stem, F.lit(ext)), None, n, k) for k, ext in enumerate(("DAT", "EXT", "2EX"))] + [row(6, F.concat(F.lit("Contents/"), "hash", F.lit(".mp3")), F.col("bytes"), n, 0, raw)]
    rows = seeds(spark, d).select("user_id", F.explode(F.array(*head)).alias("x")).unionByName(numbered(spark, d).join(size, "track_id").select("user_id", F.explode(F.array(*per)).alias("x"))).select("user_id", "x.*")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("step", "content_id", "part")).cast("long")
    return rows.select("user_id", place.alias("place"), "usb_path", "size", "source")


@query(f"select user_id, concat('{{', string_agg(concat('\"Contents/', {_RAW}, '.mp3\":\"', substr({_RAW}, 1, 2), '/', {_RAW}, '.mp3\"'), ',' order by content_id), '}}') as sources from numbered group by user_id")
def export_sources(spark, d):
    """Where the audio of each export lies, by its path on the device, as one JSON record."""
    entry = F.struct("content_id", F.concat(F.lit("Contents/"), "hash", F.lit(".mp3")).alias("key"), T.raw_path(F.col("hash"), F.lit("mp3")).alias("value"))
    rows = numbered(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return rows.select("user_id", F.to_json(F.map_from_arrays(F.transform("e", lambda x: x["key"]), F.transform("e", lambda x: x["value"]))).alias("sources"))


_INNER = """concat('      <TEMPO Inizio="0.000" Bpm="', printf('%.2f', 80 + p_size + 0.25), '" Metro="4/4" Battito="1"/>', chr(10), '      <POSITION_MARK Name="" Type="', case when p_size % 3 = 0 then 4 else 0 end, '" Start="', printf('%.3f', p_size + 0.125), '"', case when p_size % 3 = 0 then concat(' End="', printf('%.3f', p_size + 4.125), '"') else '' end, ' Num="', case when p_size % 3 = 0 then 0 else -1 end, '"/>', chr(10))"""
_ESC = "replace(replace(replace(replace(replace(concat(p_name, ' & ''', p_brand, '\"'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_TRACK = f"""(select user_id, content_id, concat('    <TRACK TrackID="', content_id, '" Name="', {_ESC}, '" Artist="', p_brand, '" Composer="" Album="" Grouping="" Genre="', p_type, '" Kind="MP3 File" Size="', p_size * 100000, '" TotalTime="', cast(round(p_retailprice / 10) as bigint), '" DiscNumber="0" TrackNumber="', p_size, '" Year="', 1950 + p_size,
  '" AverageBpm="', printf('%.2f', 80 + p_size + 0.25), '" DateAdded="2025-01-01" BitRate="320" SampleRate="44100" Comments="" PlayCount="0" Rating="0" Location="file://localhost/Contents/', replace(p_name, ' ', '%20'), '.mp3" Remixer="" Tonality="', ['Cm', 'C#m', 'Dm', 'D#m', 'Em', 'Fm', 'F#m', 'Gm', 'G#m', 'Am', 'A#m', 'Bm'][p_partkey % 12 + 1], '" Label="" Mix="">', chr(10), {_INNER}, '    </TRACK>', chr(10)) as xml from numbered join part on p_partkey = track_id)"""


@query(f"select user_id, content_id, xml from {_TRACK}")
def xml_tracks(spark, d):
    """The element of each track in a user's collection, with its tempo and one cue: a hot loop or a memory cue."""
    part = S.table(spark, d, "part")
    n, loop = F.col("p_size"), F.col("p_size") % 3 == 0
    seconds = lambda x: F.format_string("%.3f", x)
    bpm = F.format_string("%.2f", 80 + n + F.lit(0.25))
    tempo = F.concat(F.lit('      <TEMPO Inizio="0.000" Bpm="'), bpm, F.lit('" Metro="4/4" Battito="1"/>\n'))
    end = F.when(loop, F.concat(F.lit('" End="'), seconds(n + F.lit(4.125)))).otherwise("")
    mark = F.concat(F.lit('      <POSITION_MARK Name="" Type="'), F.when(loop, "4").otherwise("0"), F.lit('" Start="'), seconds(n + F.lit(0.125)), end, F.lit('" Num="'), F.when(loop, "0").otherwise("-1"), F.lit('"/>\n'))
    columns = {"id": F.col("content_id"), "title": F.concat("p_name", F.lit(" & '"), "p_brand", F.lit('"')), "artist": F.col("p_brand"), "genre": F.col("p_type"), "kind": T.kind(F.lit("mp3")), "size": n * 100000, "seconds": F.round(F.col("p_retailprice") / 10).cast("long"), "track_number": n, "year": 1950 + n, "bpm": bpm, "added": F.lit("2025-01-01"), "bitrate": F.lit(320), "rate": F.lit(44100), "path": F.concat(F.lit("/Contents/"), "p_name", F.lit(".mp3")), "key": T.key_name(F.col("track_id"), F.lit(False)), "inner": F.concat(tempo, mark)}
    return numbered(spark, d).select("user_id", "track_id", "content_id").join(part, F.col("p_partkey") == F.col("track_id")).select("user_id", "content_id", C.track_xml(columns).alias("xml"))


_NODES = """(select user_id, count(*) as n, string_agg(concat('      <NODE Name="', name, '" Type="1" KeyType="0" Entries="', entries, '">', chr(10), coalesce(keys, ''), '      </NODE>', chr(10)), '' order by number) as nodes from (
  select l.user_id, l.playlist_id, l.name, l.number, count(c.content_id) as entries, string_agg(concat('        <TRACK Key="', c.content_id, '"/>', chr(10)), '' order by c.content_id) filter (where c.content_id is not null) as keys from listed l left join members m using (playlist_id) left join numbered c on c.user_id = l.user_id and c.track_id = m.track_id group by 1, 2, 3, 4) group by 1)"""


@query(f"""select user_id, sha256(concat('<?xml version="1.0" encoding="UTF-8" ?>', chr(10), '<DJ_PLAYLISTS Version="1.0.0">', chr(10), '  <PRODUCT Name="tonearm" Version="1.0" Company=""/>', chr(10), '  <COLLECTION Entries="', t.n, '">', chr(10), t.xml, '  </COLLECTION>', chr(10), '  <PLAYLISTS>', chr(10), '    <NODE Type="0" Name="ROOT" Count="', p.n, '">', chr(10), p.nodes,
  '    </NODE>', chr(10), '  </PLAYLISTS>', chr(10), '</DJ_PLAYLISTS>', chr(10))) as sha256 from (select user_id, count(*) as n, string_agg(xml, '' order by content_id) as xml from {_TRACK} group by 1) t join {_NODES} p using (user_id)""")
def xml_documents(spark, d):
    """The whole collection of each user as one document, named by its SHA-256."""
    joined = lambda rows, key, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, text))), lambda x: x[text]), "")
    tracks = xml_tracks(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), joined(None, "content_id", "xml").alias("tracks"))
    ids = numbered(spark, d).select("user_id", "track_id", "content_id")
    entries = S.members(spark, d).join(listed(spark, d).select("user_id", "playlist_id"), "playlist_id").join(ids, ["user_id", "track_id"])
    keys = entries.withColumn("line", F.concat(F.lit('        <TRACK Key="'), "content_id", F.lit('"/>\n'))).groupBy("playlist_id").agg(F.count(F.lit(1)).alias("entries"), joined(None, "content_id", "line").alias("keys"))
    lists = listed(spark, d).join(keys, "playlist_id", "left")
    node = F.concat(F.lit('      <NODE Name="'), T.xml_escape(F.col("name")), F.lit('" Type="1" KeyType="0" Entries="'), F.coalesce("entries", F.lit(0)), F.lit('">\n'), F.coalesce("keys", F.lit("")), F.lit("      </NODE>\n"))
    nodes = lists.withColumn("node", node).groupBy("user_id").agg(F.count(F.lit(1)).alias("lists"), joined(None, "number", "node").alias("nodes"))
    whole = F.concat(F.lit(C.HEAD + '  <PRODUCT Name="tonearm" Version="1.0" Company=""/>\n  <COLLECTION Entries="'), "n", F.lit('">\n'), "tracks", F.lit('  </COLLECTION>\n  <PLAYLISTS>\n    <NODE Type="0" Name="ROOT" Count="'), "lists", F.lit('">\n'), "nodes", F.lit(C.TAIL))
    return tracks.join(nodes, "user_id").select("user_id", F.sha2(whole, 256).alias("sha256"))


_CUES = "(select user_id, event_id, cast(event_id % 9 as int) as slot, case event_type when 'click' then 0 when 'view' then 1 when 'error' then 2 when 'signup' then 3 else 4 end as kind, cast(floor(value * 100) as bigint) as ms, event_type = 'purchase' as loops from events)"


@query(f"""select user_id, concat('50434F4200000018', printf('%08X', 24 + 24 * count(*)), '00000001', '0000', printf('%04X', count(*)), 'FFFFFFFF',
  string_agg(concat('5043500100000014', printf('%08X', slot), printf('%08X', kind), printf('%08X', ms), case when loops then printf('%08X', ms + 4000) else 'FFFFFFFF' end), '' order by event_id)) as section from {_CUES} group by user_id""")
def cue_lists(spark, d):
    """The plain cue list of each user's events, as hex: clicks are cues, purchases loops of four seconds."""
    kind = F.create_map(*map(F.lit, ("click", 0, "view", 1, "error", 2, "signup", 3, "purchase", 4)))[F.col("event_type")]
    word = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    ms = F.floor(F.col("value") * 100)
    entry = F.concat(F.lit("5043500100000014"), word(F.col("event_id") % 9), word(kind), word(ms), F.when(F.col("event_type") == "purchase", word(ms + 4000)).otherwise("FFFFFFFF"))
    rows = S.table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", entry.alias("hex")))).alias("e"))
    n = F.size("e")
    return rows.select("user_id", F.concat(F.lit("50434F4200000018"), word(24 + 24 * n), F.lit("000000010000"), F.lpad(F.hex(n.cast("long")), 4, "0"), F.lit("FFFFFFFF"), F.array_join(F.transform("e", lambda x: x["hex"]), "")).alias("section"))


@query("select user_id, username as text, cast(28 + strlen(username) as int) as bytes, true as fresh from users")
def sealed_cookies(spark, d):
    """Texts sealed and opened again; the nonce is fresh each time."""
    key = F.unhex(F.sha2(F.lit("key"), 256))
    shut = S.users(spark, d).select("user_id", I.sealed(F.col("username"), key).alias("a"), I.sealed(F.concat("username", F.lit("")), key).alias("b"))
    return shut.select("user_id", I.opened(F.col("a"), key).alias("text"), F.octet_length("a").alias("bytes"), (F.col("a") != F.col("b")).alias("fresh"))


@query("select user_id, true as valid, strftime(min(o), '%Y-%m-%d') as created from (select c_custkey as user_id, o_orderdate as o from customer join orders on o_custkey = c_custkey) group by 1")
def new_ids(spark, d):
    """A random id for each user and the civil date of their first playlist."""
    first = S.playlists(spark, d).groupBy("user_id").agg(F.min("created_at").alias("at"))
    valid = F.expr("uuid()").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return S.users(spark, d).select("user_id").join(first, "user_id").select("user_id", valid.alias("valid"), F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("at").cast("timestamp"))), "yyyy-MM-dd").alias("created"))
