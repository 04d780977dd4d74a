"""Scalar rules of ingest, download, telemetry and export."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pagewriter import COLOR_NAMES
from ..operators import relational as R
from ..sources import tables as S
from .base import query


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_projection(spark, d):
    return S.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint, missing string").alias("p")).select("event_id", "p.k")


_MIME = "case event_type when 'view' then 'audio/mpeg' when 'click' then 'application/octet-stream' when 'purchase' then 'video/mp4' when 'error' then 'text/plain' end"


@query(f"select event_id from (select event_id, {_MIME} as mime from events) where mime is null or mime like 'audio/%' or mime = 'application/octet-stream'")
def audio_files(spark, d):
    mime = F.create_map(*map(F.lit, ("view", "audio/mpeg", "click", "application/octet-stream", "purchase", "video/mp4", "error", "text/plain")))[F.col("event_type")]
    return S.table(spark, d, "events").where(T.audio_mime(mime)).select("event_id")


@query("select p_partkey as id, title from (select p_partkey, case p_partkey % 9 when 3 then 'Private video' when 5 then 'Deleted video' else p_name end as title from part) where title not in ('Private video', 'Deleted video')")
def without_private(spark, d):
    n = F.col("p_partkey") % 9
    titled = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(n == 3, "Private video").when(n == 5, "Deleted video").otherwise(F.col("p_name")).alias("title"))
    return titled.where(T.listed(F.col("title")))


@query("""select doc_id, coalesce(nullif(title, ''), 'Unknown Title') as title, coalesce(nullif(uploader, ''), 'Unknown') as uploader, coalesce(nullif(url, ''), nullif(page, ''), 'https://www.youtube.com/watch?v=' || vid, '') as url, coalesce(vid, '') as video_id
  from (select doc_id, case doc_id % 3 when 0 then '' when 1 then source end as title, case when doc_id % 2 = 0 then lang end as uploader, case when doc_id % 5 = 0 then '' when doc_id % 5 = 1 then concat('u:', doc_id) end as url, case when doc_id % 7 = 0 then 'page' end as page, case when doc_id % 4 > 0 then cast(doc_id as varchar) end as vid from documents)""")
def search_results(spark, d):
    """Defaults of missing fields of a remote search, the address from the id where none is given."""
    n = F.col("doc_id")
    found = S.table(spark, d, "documents").select("doc_id", F.when(n % 3 == 0, "").when(n % 3 == 1, F.col("source")).alias("title"), F.when(n % 2 == 0, F.col("lang")).alias("uploader"), F.when(n % 5 == 0, "").when(n % 5 == 1, F.concat(F.lit("u:"), "doc_id")).alias("url"), F.when(n % 7 == 0, "page").alias("webpage_url"), F.when(n % 4 > 0, n.cast("string")).alias("id"))
    return found.select("doc_id", *T.search_defaults())


@query("""select event_id, message, message like '%Video unavailable%' or message like '%Private video%' or message like '%Sign in to confirm your age%' or message like '%Sign in to confirm you''re not a bot%' as permanent
  from (select event_id, concat('ERROR: ', case event_id % 7 when 0 then 'Video unavailable' when 1 then 'Private video. Sign in' when 2 then 'Sign in to confirm your age' when 3 then 'Sign in to confirm you''re not a bot' when 4 then 'timed out' when 5 then 'private video' else event_type end) as message from events)""")
def permanent_errors(spark, d):
    n = F.col("event_id") % 7
    said = F.when(n == 0, "Video unavailable").when(n == 1, "Private video. Sign in").when(n == 2, "Sign in to confirm your age").when(n == 3, "Sign in to confirm you're not a bot").when(n == 4, "timed out").when(n == 5, "private video").otherwise(F.col("event_type"))
    return S.table(spark, d, "events").select("event_id", F.concat(F.lit("ERROR: "), said).alias("message")).withColumn("permanent", T.permanent_error(F.col("message")))


@query("select doc_id, coalesce(case when doc_id % 2 = 0 then source end, case when doc_id % 3 = 0 then lang end, 'Unknown Artist') as artist from documents")
def metadata_fallback(spark, d):
    n = F.col("doc_id")
    return S.table(spark, d, "documents").select("doc_id", F.coalesce(F.when(n % 2 == 0, F.col("source")), F.when(n % 3 == 0, F.col("lang")), F.lit("Unknown Artist")).alias("artist"))


@query("select p_partkey as id, trim(part_name) as item from (select p_partkey, unnest(string_split(concat(p_name, ', ,', p_brand, ' ,', p_type), ',')) as part_name from part) where trim(part_name) <> ''")
def comma_lists(spark, d):
    items = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split(F.concat("p_name", F.lit(", ,"), "p_brand", F.lit(" ,"), "p_type"), ",")).alias("item"))
    return items.select("id", F.trim("item").alias("item")).where("item <> ''")


@query("""select page_id, case when q like '%list=%' then 'playlist' when q like 'http%' then 'url' when strlen(q) = 11 and q not like '% %' then 'id' else 'search' end as kind, regexp_extract(q, '[?&]list=([^&]+)', 1) as list
  from (select page_id, case page_id % 4 when 0 then concat(url, '?list=PL', page_id) when 1 then url when 2 then 'abcdefghijk' else 'two words' end as q from pages)""")
def request_kinds(spark, d):
    n, q = F.col("page_id") % 4, F.col("q")
    asked = F.when(n == 0, F.concat("url", F.lit("?list=PL"), "page_id")).when(n == 1, F.col("url")).when(n == 2, "abcdefghijk").otherwise("two words")
    kind = F.when(q.contains("list="), "playlist").when(q.startswith("http"), "url").when((F.length(q) == 11) & ~q.contains(" "), "id").otherwise("search")
    return S.table(spark, d, "pages").withColumn("q", asked).select("page_id", kind.alias("kind"), F.regexp_extract("q", "[?&]list=([^&]+)", 1).alias("list"))


_PATHS = "case doc_id % 6 when 0 then source when 1 then concat('/', source) when 2 then concat('a/../', source) when 3 then 'a//b' when 4 then '' else concat('a/', source, '/./b') end"


@query(f"select doc_id, trim(source) <> '' and strlen(password) >= 8 as valid, trim(lang) <> '' as named, not regexp_matches(path, '(^|/)[.]{{0,2}}(/|$)') as relative from (select *, substr(text, 1, cast(doc_id % 12 as int)) as password, {_PATHS} as path from documents)")
def validation(spark, d):
    """Names that aren't blank, passwords of eight bytes, paths that stay under their root."""
    n, source = F.col("doc_id") % 6, F.col("source")
    path = F.when(n == 0, source).when(n == 1, F.concat(F.lit("/"), source)).when(n == 2, F.concat(F.lit("a/../"), source)).when(n == 3, "a//b").when(n == 4, "").otherwise(F.concat(F.lit("a/"), source, F.lit("/./b")))
    password = F.substring("text", F.lit(1), (F.col("doc_id") % 12).cast("int"))
    return S.table(spark, d, "documents").select("doc_id", T.credentials(source, password).alias("valid"), (F.trim("lang") != "").alias("named"), T.relative(path).alias("relative"))


@query("select event_id, coalesce(status, -1) as status, coalesce(status >= 500, false) as server_error, status is null or status >= 400 as client_error from (select event_id, event_type, case when event_id % 10 = 9 then null else cast((event_id % 5 + 1) * 100 as int) end as status from events) where not (event_type = 'view' and coalesce(status, 0) < 400)")
def request_log(spark, d):
    n, status = F.col("event_id"), F.col("status")
    logged = S.table(spark, d, "events").withColumn("status", F.when(n % 10 != 9, ((n % 5 + 1) * 100).cast("int")))
    return logged.where(~((F.col("event_type") == "view") & (F.coalesce(status, F.lit(0)) < 400))).select("event_id", F.coalesce(status, F.lit(-1)).alias("status"), F.coalesce(status >= 500, F.lit(False)).alias("server_error"), (status.isNull() | (status >= 400)).alias("client_error"))


@query("select event_id, case when line like '[debug] %' then 'debug' else 'info' end as level, case when line like '[debug] %' then substr(line, 9) else line end as message from (select event_id, case when event_id % 3 = 0 then concat('[debug] ', event_type) else event_type end as line from events)")
def log_levels(spark, d):
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[debug] "), "event_type")).otherwise(F.col("event_type"))
    debug = F.col("line").startswith("[debug] ")
    return S.table(spark, d, "events").withColumn("line", line).select("event_id", F.when(debug, "debug").otherwise("info").alias("level"), F.when(debug, F.expr("substring(line, 9)")).otherwise(F.col("line")).alias("message"))


@query("select p_partkey as id, title from (select p_partkey, concat(translate(concat(p_brand, ' - ', p_name), '/\\:*?\"<>|', '_________'), '.mp3') as title from part) where title not in (select concat(translate(concat(p_brand, ' - ', p_name), '/\\:*?\"<>|', '_________'), '.mp3') from part where p_size > 25)")
def skip_downloads(spark, d):
    """Tracks to download: those whose file name isn't there yet."""
    named = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", F.concat(T.safe_name(F.concat("p_brand", F.lit(" - "), "p_name")), F.lit(".mp3")).alias("title"))
    return R.missing(named.select("id", "title"), named.where("p_size > 25"), "title").select("id", "title")


@query("select user_id, url from (select distinct user_id, event_type as url from events) where (user_id, url) not in (select (user_id, event_type) from events where event_id % 5 = 0)")
def not_completed(spark, d):
    urls = S.table(spark, d, "events").select("user_id", F.col("event_type").alias("url"))
    done = S.table(spark, d, "events").where("event_id % 5 = 0").select("user_id", F.col("event_type").alias("url"))
    return R.delete(urls.distinct(), done, ["user_id", "url"])


@query("""select playlist_id, place, title from (select playlist_id, track_id, row_number() over (partition by playlist_id order by first, track_id) as place from (select l_orderkey as playlist_id, l_partkey as track_id, min(l_linenumber) as first from lineitem group by 1, 2)) join tracks using (track_id) where artist <> 'Brand#22'""")
def first_match(spark, d):
    """The tracks of each list in the order of its hashes, the first place of a repeated one; unknown hashes drop out."""
    first = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("playlist_id"), F.col("l_partkey").alias("track_id")).agg(F.min("l_linenumber").alias("first"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("playlist_id").orderBy("first", "track_id")).cast("long"))
    return placed.join(S.tracks(spark, d).where("artist <> 'Brand#22'"), "track_id").select("playlist_id", "place", "title")


@query("select track_id, title from (select * from tracks where title ilike '%a%' order by title, track_id limit 10) order by title, track_id limit 5")
def top_candidates(spark, d):
    return R.search(S.tracks(spark, d), "title", "a").orderBy("title", "track_id").limit(10).orderBy("title", "track_id").limit(5).select("track_id", "title")


@query("""select page_id, case when name like '%.%' then lower(regexp_extract(name, '\\.([^.]*)$', 1)) else '' end as ext, regexp_replace(name, '(.)\\.[^.]*$', '\\1') as stem, regexp_replace(path, '/[^/]*$', '') as parent
  from (select page_id, path, regexp_extract(path, '([^/]*)$', 1) as name from (select page_id, concat('Contents/', page_id % 7, '/Track ', page_id, case page_id % 3 when 0 then '.MP3' when 1 then '.tar.flac' else '' end) as path from pages))""")
def path_parts(spark, d):
    n = F.col("page_id")
    path = F.concat(F.lit("Contents/"), (n % 7).cast("string"), F.lit("/Track "), n.cast("string"), F.when(n % 3 == 0, ".MP3").when(n % 3 == 1, ".tar.flac").otherwise(""))
    return S.table(spark, d, "pages").withColumn("path", path).select("page_id", T.extension(F.col("path")).alias("ext"), T.stem(F.col("path")).alias("stem"), T.parent(F.col("path")).alias("parent"))


@query("""select p_partkey as id, case p_partkey % 8 when 0 then 1 when 1 then 4 when 2 then 4 when 3 then 5 when 4 then 11 when 5 then 12 when 6 then 12 else 0 end as code,
  case p_partkey % 8 when 0 then 'MP3 File' when 1 then 'M4A File' when 2 then 'M4A File' when 3 then 'FLAC File' when 4 then 'WAV File' when 5 then 'AIFF File' when 6 then 'AIFF File' else 'OGG File' end as kind from part""")
def file_types(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("MP3", "m4a", "AAC", "flac", "Wav", "aiff", "aif", "ogg"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.file_type(ext).alias("code"), T.kind(ext).alias("kind"))


@query("select p_partkey as id, cast(trunc(bpm * 100) as int) as page_tempo, cast(round(bpm * 100) as int) as grid_tempo, printf('%04d-01-01', 1950 + p_size) as released from (select *, p_size + p_partkey % 100 / 3 as bpm from part)")
def roundings(spark, d):
    bpm = F.col("p_size") + F.col("p_partkey") % 100 / 3
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (bpm * 100).cast("int").alias("page_tempo"), F.round(bpm * 100).cast("int").alias("grid_tempo"), F.format_string("%04d-01-01", 1950 + F.col("p_size")).alias("released"))


@query("select p_partkey as id, least(((p_size & 7) * ((p_size + 3) & 31) * 127) // (7 * 31), 127) as scaled, ((least((p_size & 7) + (p_partkey & 7) + 2, 21) // 3) << 5) | (p_size & 31) as detail from part")
def band_bytes(spark, d):
    s = F.col("p_size")
    scaled = F.least(F.floor(s.bitwiseAND(F.lit(7)) * (s + 3).bitwiseAND(F.lit(31)) * 127 / (7 * 31)), F.lit(127))
    third = F.floor(F.least(s.bitwiseAND(F.lit(7)) + F.col("p_partkey").bitwiseAND(F.lit(7)) + 2, F.lit(21)) / 3)
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), scaled.cast("int").alias("scaled"), F.shiftleft(third, 5).bitwiseOR(s.bitwiseAND(F.lit(31))).alias("detail"))


@query("select doc_id, i, (strlen(text) * i) // 400 as offset_bytes from documents, (select unnest(range(0, 400)) as i)")
def seek_points(spark, d):
    rows = S.table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(399).cast("long"))).alias("i"))
    return rows.select("doc_id", "i", F.expr("n * i div 400").alias("offset_bytes"))


@query("""select vec_id, min(i) filter (rise > 0.3 * top) as first from (select *, max(rise) over (partition by vec_id) as top from
  (select vec_id, i, greatest(e - coalesce(lag(e) over (partition by vec_id order by i), 0), 0) as rise from
  (select vec_id, (p - 1) // 8 as i, sum(x * x) as e from (select vec_id, generate_subscripts(embedding, 1) as p, cast(unnest(embedding) as double) as x from embeddings) group by 1, 2))) group by vec_id""")
def first_onset(spark, d):
    x = S.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x"))
    energy = x.groupBy("vec_id", F.floor(F.col("p") / 8).alias("i")).agg(F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("e"))
    rise = energy.withColumn("rise", F.greatest(F.col("e") - F.coalesce(F.lag("e").over(Window.partitionBy("vec_id").orderBy("i")), F.lit(0.0)), F.lit(0.0)))
    top = rise.withColumn("top", F.max("rise").over(Window.partitionBy("vec_id")))
    return top.where("rise > 0.3 * top").groupBy("vec_id").agg(F.min("i").alias("first"))


@query("select event_id, string_split(trace, '-')[2] as trace_id, strlen(trace) = 55 and len(string_split(trace, '-')) = 4 as valid from (select event_id, concat('00-', md5(event_type), '-', substr(md5(props), 1, 16), '-01') as trace from events)")
def trace_context(spark, d):
    trace = F.concat_ws("-", F.lit("00"), F.md5("event_type"), F.substring(F.md5("props"), 1, 16), F.lit("01"))
    return S.table(spark, d, "events").withColumn("t", trace).select("event_id", F.element_at(F.split("t", "-"), 2).alias("trace_id"), ((F.length("t") == 55) & (F.size(F.split("t", "-")) == 4)).alias("valid"))


@query("select * from (values (1, 'Pink'), (2, 'Red'), (3, 'Orange'), (4, 'Yellow'), (5, 'Green'), (6, 'Aqua'), (7, 'Blue'), (8, 'Purple')) t(color_id, name)")
def color_rows(spark, d):
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(COLOR_NAMES)], "color_id int, name string")
