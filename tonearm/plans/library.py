"""Library, playlists and presence."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import queue as Q
from ..operators import relational as R
from ..sources import tables as S
from ..sources.order import prefix_sums
from .base import query

def _listing(spark, d):
    return S.user_tracks(spark, d).join(S.tracks(spark, d), "track_id")


@query("select user_id, track_id, hash, title, artist, epoch_us(added_at) as added_us from user_tracks join tracks using (track_id)")
def library_listing(spark, d):
    return _listing(spark, d).select("user_id", "track_id", "hash", "title", "artist", F.unix_micros(F.col("added_at").cast("timestamp")).alias("added_us"))


@query("select user_id, track_id, title from user_tracks join tracks using (track_id) where title ilike '%an%'")
def library_search(spark, d):
    return R.search(_listing(spark, d), "title", " an ").select("user_id", "track_id", "title")


@query("select user_id, track_id, title, n - 20 as place from (select *, row_number() over (partition by user_id order by added_at desc, track_id) as n from user_tracks join tracks using (track_id)) where n between 21 and 120")
def library_page(spark, d):
    """The second page of every user's listing: the tenant's own limit and offset."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("added_at"), "track_id")).cast("long")
    return _listing(spark, d).withColumn("n", n).where(F.col("n").between(21, 120)).select("user_id", "track_id", "title", (F.col("n") - 20).alias("place"))


@query("select user_id, track_id, title from user_tracks join tracks using (track_id) order by added_at desc, user_id, track_id limit 100 offset 20")
def recent_tracks(spark, d):
    return R.page(_listing(spark, d), [F.desc("added_at"), "user_id", "track_id"], 100, 20).select("user_id", "track_id", "title")


@query("select track_id, hash, title, artist from tracks where track_id = 7")
def track_by_key(spark, d):
    return S.tracks(spark, d).where("track_id = 7")


@query("select user_id, username from users where lower(username) = lower('CUSTOMER#000000003')")
def find_user(spark, d):
    return S.users(spark, d).where(F.lower("username") == F.lower(F.lit("CUSTOMER#000000003")))


@query("select playlist_id, track_id from members join playlists using (playlist_id) where user_id = 5")
def playlist_hashes(spark, d):
    return S.members(spark, d).join(S.playlists(spark, d).where("user_id = 5"), "playlist_id").select("playlist_id", "track_id")


@query("select playlist_id, name, epoch_us(created_at) as created_us from playlists where user_id = 5 order by created_at desc, playlist_id")
def list_playlists(spark, d):
    return S.playlists(spark, d).where("user_id = 5").orderBy(F.desc("created_at"), "playlist_id").select("playlist_id", "name", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"))


@query("select min(playlist_id) as playlist_id, user_id, name from playlists group by user_id, name")
def playlist_by_name(spark, d):
    first = F.row_number().over(Window.partitionBy("user_id", "name").orderBy("playlist_id"))
    return S.playlists(spark, d).withColumn("n", first).where("n = 1").select("playlist_id", "user_id", "name")


#: Each user asks for their own playlists and for those of the user after them, which aren't theirs.
_WANTED = "(select user_id, playlist_id from playlists union select user_id - 1, playlist_id from playlists)"


@query(f"select distinct p.user_id, t.track_id, t.hash from members m join playlists p using (playlist_id) join {_WANTED} w on w.playlist_id = p.playlist_id and w.user_id = p.user_id join tracks t on t.track_id = m.track_id")
def resolve_tracks(spark, d):
    own = S.playlists(spark, d).select("user_id", "playlist_id")
    wanted = own.union(own.select(F.col("user_id") - 1, "playlist_id"))
    return R.resolve(S.members(spark, d), S.playlists(spark, d), S.tracks(spark, d), wanted).select("user_id", "track_id", "hash")


@query("select distinct t.track_id, t.hash from members m join playlists p using (playlist_id) join tracks t on t.track_id = m.track_id")
def resolve_any_owner(spark, d):
    return S.members(spark, d).join(S.playlists(spark, d).select("playlist_id"), "playlist_id", "left_semi").select("track_id").distinct().join(S.tracks(spark, d), "track_id").select("track_id", "hash")


@query("select p.user_id, p.playlist_id, p.name from playlists p join users u using (user_id) where lower(p.name) in ('1-urgent', '3-medium')")
def playlists_by_name(spark, d):
    """Playlists of a user by a list of names; a name may give several."""
    return S.playlists(spark, d).join(S.users(spark, d).select("user_id"), "user_id", "left_semi").where(F.lower("name").isin("1-urgent", "3-medium")).select("user_id", "playlist_id", "name")


@query("select doc_id, source from documents where doc_id in (select doc_id from labels)")
def analysed(spark, d):
    return R.present(S.table(spark, d, "documents"), S.artifacts(spark, d), "doc_id").select("doc_id", "source")


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def to_analyse(spark, d):
    return R.missing(S.table(spark, d, "documents"), S.artifacts(spark, d), "doc_id").select("doc_id", "source")


@query("select d.doc_id, coalesce(l.quality, -1) as quality, coalesce(l.toxic, strlen(d.text)) as size from documents d left join labels l using (doc_id)")
def track_view(spark, d):
    return S.table(spark, d, "documents").join(S.artifacts(spark, d), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.col("toxic").cast("long"), F.octet_length("text").cast("long")).alias("size"))


@query("""select source, count(*) as total, count(l.doc_id) as done, cast(sum(case when doc_id % 11 = 0 then 1 else 0 end) as bigint) as failed,
  count(l.doc_id) + sum(case when doc_id % 11 = 0 then 1 else 0 end) >= count(*) as complete from documents d left join labels l using (doc_id) group by source""")
def batch_progress(spark, d):
    wanted = S.table(spark, d, "documents").select("source", "doc_id")
    return Q.progress(wanted, S.artifacts(spark, d), wanted.where("doc_id % 11 = 0"), "source", "doc_id")


@query("select user_id, string_agg(hash, ',' order by hash) as hashes, cast(count(*) as int) as n from (select distinct user_id, hash from user_tracks join tracks using (track_id)) group by user_id")
def batch_snapshot(spark, d):
    lists = _listing(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    return lists.select("user_id", F.array_join("hashes", ",").alias("hashes"), F.size("hashes").alias("n"))


@query("select t.track_id, coalesce(n.title, t.title) as title, case when n.track_id is null then t.artist else coalesce(n.artist, t.artist) end as artist from tracks t full join (select track_id, case when track_id % 2 = 0 then upper(title) end as title, 'x' as artist from tracks where track_id % 5 = 0) n using (track_id)")
def upsert_keeping(spark, d):
    old = S.tracks(spark, d).select("track_id", "title", "artist")
    new = old.where("track_id % 5 = 0").select("track_id", F.when(F.col("track_id") % 2 == 0, F.upper("title")).alias("title"), F.lit("x").alias("artist"))
    return R.upsert(old, new, ["track_id"])


@query("select track_id, case when track_id % 5 = 0 then upper(title) else title end as title from tracks union all select -1, 'NEW'")
def upsert_overwriting(spark, d):
    old = S.tracks(spark, d).select("track_id", "title")
    new = old.where("track_id % 5 = 0").withColumn("title", F.upper("title")).union(spark.range(1).select((F.col("id") - 1).alias("track_id"), F.lit("NEW").alias("title")))
    return R.upsert(old, new, ["track_id"], False)


@query("""select request_id, name, case when name in (select lower(username) from users) or n > 1 then 'taken' else 'created' end as status from (select *, row_number() over (partition by name order by request_id) as n from
  (select user_id * 2 as request_id, lower(case when user_id % 2 = 0 then username else concat('new ', username) end) as name from users union all select user_id * 2 + 1, lower(concat('new ', username)) from users))""")
def create_user(spark, d):
    """Half of the names asked for are taken, and half of the new ones are asked for twice."""
    u = S.users(spark, d)
    asked = u.select((F.col("user_id") * 2).alias("request_id"), F.when(F.col("user_id") % 2 == 0, F.col("username")).otherwise(F.concat(F.lit("new "), "username")).alias("name"))
    asked = asked.union(u.select(F.col("user_id") * 2 + 1, F.concat(F.lit("new "), "username"))).withColumn("name", F.lower("name"))
    return R.inserted(u.select(F.lower("username").alias("name")), asked, "name")


@query("select sha256(cast(event_id as varchar)) as token_hash, user_id, user_id in (select user_id from users) as valid from events where event_type = 'signup'")
def create_session(spark, d):
    """A session needs its user: rows that break the foreign key come back as such."""
    known = S.users(spark, d).select("user_id").withColumn("known", F.lit(True))
    asked = S.table(spark, d, "events").where("event_type = 'signup'").select(F.sha2(F.col("event_id").cast("string"), 256).alias("token_hash"), "user_id")
    return asked.join(known, "user_id", "left").select("token_hash", "user_id", F.coalesce("known", F.lit(False)).alias("valid"))


@query("select distinct playlist_id, track_id from (select * from members union all select playlist_id, 0 from playlists where playlist_id < 100)")
def add_members(spark, d):
    more = S.playlists(spark, d).where("playlist_id < 100").select("playlist_id", F.lit(0).cast("long").alias("track_id"))
    return R.insert_new(S.members(spark, d), more, ["playlist_id", "track_id"])


@query("select playlist_id, track_id from members where not (track_id % 7 = 0 and playlist_id in (select playlist_id from playlists where user_id < 100))")
def remove_members(spark, d):
    owned = S.playlists(spark, d).where("user_id < 100").select("playlist_id")
    return R.delete(S.members(spark, d), S.members(spark, d).where("track_id % 7 = 0").join(owned, "playlist_id", "left_semi"), ["playlist_id", "track_id"])


@query("select playlist_id, track_id from members where playlist_id not in (select playlist_id from playlists where user_id = 3)")
def delete_cascade(spark, d):
    return R.delete(S.members(spark, d), S.playlists(spark, d).where("user_id = 3"), ["playlist_id"])


_GONE = "select user_id from users where username like '%7'"


@query(f"""select 'users' as kind, user_id as a, 0 as b from users where user_id not in ({_GONE}) union all select 'sessions', event_id, user_id from events where event_type = 'signup' and user_id not in ({_GONE})
  union all select 'user_tracks', user_id, track_id from user_tracks where user_id not in ({_GONE}) union all select 'playlists', playlist_id, user_id from playlists where user_id not in ({_GONE})
  union all select 'members', playlist_id, track_id from members where playlist_id not in (select playlist_id from playlists where user_id in ({_GONE}))""")
def delete_user_cascade(spark, d):
    """What is left of every table once users go: their sessions, tracks and playlists, and the members of those."""
    gone = S.users(spark, d).where(F.col("username").endswith("7"))
    lists = S.playlists(spark, d)
    sessions = S.table(spark, d, "events").where("event_type = 'signup'").select("event_id", "user_id")
    left = {
        "users": (R.delete(S.users(spark, d), gone, ["user_id"]), "user_id", None),
        "sessions": (R.delete(sessions, gone, ["user_id"]), "event_id", "user_id"),
        "user_tracks": (R.delete(S.user_tracks(spark, d), gone, ["user_id"]), "user_id", "track_id"),
        "playlists": (R.delete(lists, gone, ["user_id"]), "playlist_id", "user_id"),
        "members": (R.delete(S.members(spark, d), R.present(lists, gone, "user_id"), ["playlist_id"]), "playlist_id", "track_id"),
    }
    out = None
    for kind, (rows, a, b) in left.items():
        some = rows.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), (F.col(b) if b else F.lit(0)).cast("long").alias("b"))
        out = some if out is None else out.union(some)
    return out


@query("select user_id, track_id, case when track_id % 3 = 0 then title else 'own' end as title, case when track_id % 2 = 0 then artist else 'own' end as artist from user_tracks join tracks using (track_id)")
def backfill_titles(spark, d):
    """Rows that lack a title or an artist take the track's; values of their own stay."""
    n = F.col("track_id")
    own = S.user_tracks(spark, d).select("user_id", "track_id", F.when(n % 3 != 0, "own").alias("title"), F.when(n % 2 != 0, "own").alias("artist"))
    return R.fill_from(own, S.tracks(spark, d), "track_id", ["title", "artist"])


@query("""select user_id, track_id, epoch_us(added_at) as added_us from user_tracks where track_id % 2 = 0 union all select u.user_id, u.track_id, 0 from (select distinct o_custkey as user_id, l_partkey as track_id from orders join lineitem on l_orderkey = o_orderkey) u
  where not exists (select 1 from user_tracks t where t.track_id % 2 = 0 and t.user_id = u.user_id and t.track_id = u.track_id)""")
def backfill_owners(spark, d):
    """Owners of tracks become rows of user_tracks; rows that are there keep their time."""
    old = S.user_tracks(spark, d).where("track_id % 2 = 0").select("user_id", "track_id", F.unix_micros(F.col("added_at").cast("timestamp")).alias("added_us"))
    owners = S.members(spark, d).join(S.playlists(spark, d).select("playlist_id", "user_id"), "playlist_id").where("user_id is not null").select("user_id", "track_id", F.lit(0).cast("long").alias("added_us"))
    return R.insert_new(old, owners, ["user_id", "track_id"])


@query("select user_id, count(*) as live from (select user_id, ts + interval 1 day as expires from events) where expires > timestamp '2024-01-15 00:00:00' group by 1")
def live_sessions(spark, d):
    e = S.table(spark, d, "events").select("user_id", (F.col("ts") + F.expr("interval 1 day")).alias("expires"))
    return e.where(F.col("expires") > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).groupBy("user_id").agg(F.count(F.lit(1)).alias("live"))


@query("select doc_id, source from documents where lower(source) like '%c1%' or lower(lang) like '%fr%'")
def either_contains(spark, d):
    return S.table(spark, d, "documents").where(F.lower(F.coalesce("source", F.lit(""))).contains("c1") | F.lower(F.coalesce("lang", F.lit(""))).contains("fr")).select("doc_id", "source")


@query("select l_partkey as track_id, row_number() over (partition by l_orderkey order by l_partkey) as entry, l_orderkey as playlist_id, row_number() over (partition by l_orderkey order by l_partkey) - 1 as sort_order from (select distinct l_orderkey, l_partkey from lineitem)")
def playlist_entries(spark, d):
    n = F.row_number().over(Window.partitionBy("playlist_id").orderBy("track_id")).cast("long")
    return S.members(spark, d).select("track_id", n.alias("entry"), "playlist_id", (n - 1).alias("sort_order"))


@query("select artist, dense_rank() over (order by first) as code from (select artist, min(track_id) as first from tracks group by artist)")
def artist_dictionary(spark, d):
    return R.first_seen_ids(S.tracks(spark, d), "artist", "track_id").select("artist", F.col("code").cast("long").alias("code"))


@query("select m.playlist_id, c.code from members m join (select track_id, row_number() over (order by track_id) as code from tracks where artist <> 'Brand#11') c using (track_id)")
def dictionary_join(spark, d):
    """Members as numbers of the tracks that have one; the others drop out."""
    some = S.tracks(spark, d).where("artist <> 'Brand#11'").select("track_id", F.lit(1).alias("one"))
    coded = prefix_sums(some, "track_id", "one").select("track_id", (F.col("start") + 1).alias("code"))
    return S.members(spark, d).join(coded, "track_id").select("playlist_id", "code")


_DEVICE = "(select user_id, '/Contents/' || artist || '/' || track_id || '.mp3' as usb_path, p_size * 1000 as size from user_tracks join tracks using (track_id) join part on p_partkey = track_id)"


@query(f"select m.user_id, m.usb_path, m.size from {_DEVICE} m where not exists (select 1 from {_DEVICE} t where t.user_id = m.user_id + 1 and t.usb_path = m.usb_path and t.size = m.size)")
def reconcile(spark, d):
    """Files that each user's device needs when it holds what the next user's holds."""
    size = S.table(spark, d, "part").select(F.col("p_partkey").alias("track_id"), (F.col("p_size") * 1000).alias("size"))
    path = F.concat(F.lit("/Contents/"), "artist", F.lit("/"), "track_id", F.lit(".mp3"))
    manifest = _listing(spark, d).join(size, "track_id").select("user_id", path.alias("usb_path"), "size")
    return R.to_transfer(manifest, manifest.withColumn("user_id", F.col("user_id") - 1), ("user_id", "usb_path", "size")).select("user_id", "usb_path", "size")


@query("select count(*) as files, cast(sum(strlen(html)) as bigint) as bytes from pages")
def transfer_total(spark, d):
    return S.table(spark, d, "pages").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))


_ENTRIES = "(select playlist_id, row_number() over (partition by playlist_id order by track_id) as n, track_id from members)"
_ZIP = f"""(select coalesce(a.pair, b.pair) as pair, coalesce(a.n, b.n) as n, case when a.pair is null then 'only_right' when b.pair is null then 'only_left' when a.track_id = b.track_id then 'same' else 'differs' end as state
  from (select playlist_id // 2 as pair, n, track_id from {_ENTRIES} where playlist_id % 2 = 0) a full join (select playlist_id // 2 as pair, n, track_id from {_ENTRIES} where playlist_id % 2 = 1) b on a.pair = b.pair and a.n = b.n)"""


@query(f"select pair, n, state from {_ZIP}")
def page_diff(spark, d):
    """Every playlist of even id against the one after it, entry by entry."""
    n = F.row_number().over(Window.partitionBy("playlist_id").orderBy("track_id")).cast("long")
    entries = S.members(spark, d).withColumn("n", n).withColumn("pair", F.floor(F.col("playlist_id") / 2))
    return R.zipped(entries.where("playlist_id % 2 = 0"), entries.where("playlist_id % 2 = 1"), ["pair", "n"], "track_id")


@query(f"select name, state, count(*) as n from {_ZIP} z join playlists p on p.playlist_id = z.pair * 2 where state <> 'same' group by 1, 2")
def page_diff_report(spark, d):
    """Differing entries by the name of the left playlist."""
    named = S.playlists(spark, d).where("playlist_id % 2 = 0").select(F.floor(F.col("playlist_id") / 2).alias("pair"), "name")
    return page_diff(spark, d).where("state <> 'same'").join(named, "pair").groupBy("name", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""select id, min(pos) as first, max(pos) as last, count(*) as n from (select *, sum(fresh) over (partition by id order by pos) as run from (select id, pos, case when pos - lag(pos) over (partition by id order by pos) <= 3 then 0 else 1 end as fresh from
  (select p_partkey as id, unnest(range(1, least(strlen(p_name), strlen(p_type)) + 1)) as pos, p_name, p_type from part) where substr(p_name, pos, 1) <> substr(p_type, pos, 1))) group by id, run""")
def differing_runs(spark, d):
    """Runs of bytes in which a track's name and type differ, as far as both reach."""
    both = F.least(F.octet_length("p_name"), F.octet_length("p_type")).cast("long")
    byte = lambda c: F.substring(F.encode(c, "UTF-8"), F.col("at").cast("int"), F.lit(1))
    at = S.table(spark, d, "part").where(both > 0).select(F.col("p_partkey").alias("id"), "p_name", "p_type", F.explode(F.sequence(F.lit(1).cast("long"), both)).alias("at"))
    return R.runs(at.where(byte("p_name") != byte("p_type")).select("id", "at"), "id", "at")


@query("select event_id, value from (select event_id, value, lag(cast(floor(value) as int)) over (partition by user_id order by ts) as before, cast(floor(value) as int) as now from events) where before is null or before <> now")
def tempo_changes(spark, d):
    now = F.floor("value").cast("int")
    before = F.lag(now).over(Window.partitionBy("user_id").orderBy("ts"))
    return S.table(spark, d, "events").withColumns({"before": before, "now": now}).where("before is null or before <> now").select("event_id", "value")


@query("select part_id, cast(coalesce(sum(size) over (order by part_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start from (select p_partkey as part_id, strlen(p_name) as size from part)")
def string_offsets(spark, d):
    return prefix_sums(S.table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.octet_length("p_name").cast("long").alias("size")), "part_id", "size").select("part_id", "start")


@query("select track_id, concat(substr(hash, 1, 2), '/', hash, '.mp3') as raw, concat(substr(hash, 1, 2), '/', substr(hash, 3, 2), '/', hash) as bundle, printf('PIONEER/USBANLZ/P%03d/%08X/ANLZ0000.DAT', (track_id // 256) % 1000, track_id) as tag_file, concat(printf('%05d', track_id // 100 + 1), '/a', track_id, '.jpg') as artwork, concat(printf('%05d', track_id // 100 + 1), '/a', track_id, '_m.jpg') as artwork_full from tracks")
def storage_paths(spark, d):
    return S.tracks(spark, d).select("track_id", T.raw_path(F.col("hash"), F.lit("mp3")).alias("raw"), T.bundle_path(F.col("hash")).alias("bundle"), T.tag_file_path(F.col("track_id")).alias("tag_file"), T.artwork_path(F.col("track_id")).alias("artwork"), T.artwork_path(F.col("track_id"), True).alias("artwork_full"))


@query("select page_id, translate(url, '/\\:*?\"<>|', '_________') as safe, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') as escaped from pages")
def names_and_escapes(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("safe"), T.xml_escape(F.col("html")).alias("escaped"))


@query("""select id, camelot, key_id, concat(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][id % 12 + 1], case when major then '' else 'm' end) as name, cast(id % 12 as int) as pitch, major,
  case id % 10 when 2 then 151052543 when 3 then 285233407 when 4 then 1046770687 when 5 then 452919496 when 6 then 719726632 when 7 then 587177984 when 8 then 855637760 else 2679316 end as slot_color from (
  select p_partkey as id, p_size % 2 = 1 as major, concat(case when p_size % 2 = 1 then [8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1][p_partkey % 12 + 1] else [5, 12, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10][p_partkey % 12 + 1] end, case when p_size % 2 = 1 then 'B' else 'A' end) as camelot,
  cast([1, 8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6][p_partkey % 12 + 1] + case when p_size % 2 = 1 then 12 else 0 end as int) as key_id from part)""")
def keys(spark, d):
    """Names and numbers of keys, the key that a number stands for, and the colour of a cue slot."""
    major, n = F.col("p_size") % 2 == 1, F.col("p_partkey")
    pitch, back = T.key_of_id(T.key_id(n, major))
    return S.table(spark, d, "part").select(n.alias("id"), T.camelot(n, major).alias("camelot"), T.key_id(n, major).alias("key_id"), T.key_name(n, major).alias("name"), pitch.cast("int").alias("pitch"), back.alias("major"), T.slot_color(n % 10).alias("slot_color"))


@query("select p_partkey as id, ((p_size % 8) << 13) | (((p_size + 1) % 8) << 10) | (((p_size + 2) % 8) << 7) | ((p_size % 32) << 2) as word, ((p_size % 8) << 5) | (p_size % 32) as byte, printf('%02X%02X%02X%02X%02X%02X', p_size & 127, (p_size * 3) & 127, (p_size * 5) & 127, (p_size * 7) & 127, (p_size * 9) & 127, (p_size * 11) & 127) as column_bytes from part")
def bit_packing(spark, d):
    s = F.col("p_size")
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.color_word(s, s + 1, s + 2, s).alias("word"), T.preview_byte(s, s).alias("byte"), T.column_bytes(*[s * k for k in (1, 3, 5, 7, 9, 11)]).alias("column_bytes"))


@query("""select p_partkey as id, cast(p_retailprice * 100 as bigint) as truncated, concat(cast(round(p_retailprice) as bigint) // 60, ':', lpad(cast(cast(round(p_retailprice) as bigint) % 60 as varchar), 2, '0')) as clock, sha256(p_name) as token, least(120.0, 10 * pow(2.0, p_size % 11)) as wait,
  case when p_size % 5 = 0 then '—' else printf('%.0f', p_size * 2 + 0.5) end as bpm, case when p_size % 3 = 0 then '—' else printf('%.1f', p_partkey * 131072 / 1048576.0) end as mb, case when p_size % 7 = 0 then '—' else cast(p_size * 8 as varchar) end as kbps from part""")
def formats(spark, d):
    p, n = S.table(spark, d, "part"), F.col("p_size")
    some = lambda k, v: F.when(n % k != 0, v)
    return p.select(F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") * 100).cast("long").alias("truncated"), T.clock(F.col("p_retailprice")).alias("clock"), F.sha2("p_name", 256).alias("token"), T.backoff_bound(n % 11).alias("wait"), T.shown_bpm(some(5, n * 2 + F.lit(0.5))).alias("bpm"), T.shown_mb(some(3, F.col("p_partkey") * 131072)).alias("mb"), F.coalesce(some(7, (n * 8).cast("string")), F.lit(T.DASH)).alias("kbps"))


@query("""select p_partkey as id, concat('90', printf('%02X', strlen(code) + 6), '000003', hex(code), '00') as isrc, case p_size % 4 when 0 then (p_size * 44100) // 1000 when 1 then (44100 * 32) // 1000 when 2 then (44100 * 48) // 1000 else 320 end as kbps,
  concat('file://localhost', case when p_size % 2 = 0 then '/' else '/C:/' end, replace(replace(url_encode(concat(p_brand, '/', p_name, ' é+*~#', p_partkey)), '%2F', '/'), '%3A', ':')) as uri from (select *, concat('GBAYE', printf('%07d', p_partkey)) as code from part)""")
def codes(spark, d):
    """Recording codes as the device keeps them, bit rates, and addresses of files."""
    n, rate = F.col("p_size"), F.lit(44100).cast("long")
    path = F.concat(F.when(n % 2 == 0, "/").otherwise("C:\\"), "p_brand", F.lit("\\"), "p_name", F.lit(" é+*~#"), "p_partkey")
    kbps = T.bitrate(F.when(n % 4 == 0, n.cast("long")), F.when(n % 4 == 1, 16).when(n % 4 == 2, 24).otherwise(32), rate)
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.isrc(F.concat(F.lit("GBAYE"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))).alias("isrc"), kbps.alias("kbps"), T.file_uri(path).alias("uri"))


@query("""select vec_id, case when m = 0 then 0 else round(r, 6) end as rms, round(m, 6) as peak, round(p, 6) as p95 from (select vec_id, sqrt(list_sum([x * x for x in v]) / len(v)) as r,
  list_max([abs(x) for x in v]) as m, list_sort([abs(x) for x in v])[least(cast(floor(len(v) * 0.95) as int) + 1, len(v))] as p from (select vec_id, [cast(x as double) for x in embedding] as v from embeddings))""")
def loudness(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    size = F.transform(v, lambda x: F.abs(x))
    return S.table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / F.size(v)), 6).alias("rms"), F.round(F.array_max(size), 6).alias("peak"), F.round(R.nearest_rank(size), 6).alias("p95"))
