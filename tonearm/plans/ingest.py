"""What comes in: uploads, remote folders and listings, bundles of artifacts."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import stores
from ..sources import tables as S
from ..sources.paged import resolve_paths
from .base import query


@query("""select doc_id, coalesce(given, regexp_replace(file, '(.)\\.[^.]*$', '\\1')) as title, coalesce(nullif(case when file like '%.%' then regexp_extract(file, '\\.([^.]*)$', 1) else '' end, ''), 'mp3') as ext,
  concat(substr(hash, 1, 2), '/', hash, '.', coalesce(nullif(case when file like '%.%' then regexp_extract(file, '\\.([^.]*)$', 1) else '' end, ''), 'mp3')) as location, doc_id not in (select doc_id from labels) as enqueued
  from (select doc_id, printf('%016x', doc_id) as hash, case when doc_id % 3 = 0 then concat('Title ', doc_id) end as given, concat('song ', doc_id, case doc_id % 4 when 0 then '.wav' when 1 then '.live.flac' when 2 then '' else '.mp3' end) as file from documents)""")
def uploads(spark, d):
    """Where each upload goes, its title (the one given, else the file's), and whether it must be analysed."""
    n = F.col("doc_id")
    file = F.concat(F.lit("song "), n, F.when(n % 4 == 0, ".wav").when(n % 4 == 1, ".live.flac").when(n % 4 == 2, "").otherwise(".mp3"))
    rows = S.table(spark, d, "documents").select("doc_id", F.when(n % 3 == 0, F.concat(F.lit("Title "), n)).alias("given"), file.alias("file"), S.hash_of(n).alias("hash"))
    ext = F.coalesce(F.nullif(T.extension(F.col("file")), F.lit("")), F.lit("mp3"))
    known = S.artifacts(spark, d).select("doc_id", F.lit(False).alias("fresh"))
    return rows.join(known, "doc_id", "left").select("doc_id", F.coalesce("given", T.stem(F.col("file"))).alias("title"), ext.alias("ext"), T.raw_path(F.col("hash"), ext).alias("location"), F.coalesce("fresh", F.lit(True)).alias("enqueued"))


@query("""select c_custkey as id0, case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then concat('n', n_nationkey) when c_custkey % 11 = 0 then concat('x', c_custkey) else concat('c', c_custkey) end as id, case when c_custkey % 5 = 0 then 'Nowhere' end as missing
  from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""")
def folder_paths(spark, d):
    """Folders of a remote drive by path: regions hold nations, nations hold customers."""
    region, nation, customer = (S.table(spark, d, t) for t in ("region", "nation", "customer"))
    node = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    folders = region.select(node("r", "r_regionkey").alias("id"), F.lit("root").alias("parent"), F.col("r_name").alias("name"))
    folders = folders.union(nation.select(node("n", "n_nationkey"), node("r", "n_regionkey"), "n_name")).union(customer.select(node("c", "c_custkey"), node("n", "c_nationkey"), "c_name"))
    n, up = F.col("c_custkey"), F.concat(F.lit("/"), "r_name", F.lit("//"), "n_name")
    path = F.when(n % 5 == 0, F.concat(F.lit("/"), "r_name", F.lit("/Nowhere/x"))).when(n % 7 == 0, up).when(n % 11 == 0, node("x", "c_custkey")).otherwise(F.concat(up, F.lit("/"), "c_name", F.lit("/")))
    asked = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(n.alias("id0"), path.alias("path"))
    return resolve_paths(folders, asked).select("id0", "id", "missing")


@query("""select hash, name, put, bytes from (select *, min(put) over (partition by hash) as first from (select md5(source) as hash, concat('artifact-', doc_id % 3) as name, cast(doc_id // 100 as bigint) as put, strlen(text) as bytes from (
  select source, doc_id, text, row_number() over (partition by source, doc_id // 100, doc_id % 3 order by doc_id) as n from documents) where n = 1)) where put = first""")
def artifact_bundles(spark, d):
    """Bundles put again and again under one hash: the first put stays, as a whole."""
    rows = S.table(spark, d, "documents").select(F.md5("source").alias("hash"), F.concat(F.lit("artifact-"), F.col("doc_id") % 3).alias("name"), F.floor(F.col("doc_id") / 100).alias("put"), "doc_id", F.octet_length("text").alias("bytes"))
    one = rows.groupBy("hash", "put", "name").agg(F.min_by("bytes", "doc_id").cast("long").alias("bytes")).select("hash", "name", "put", "bytes")
    return stores.first_wins(one.where("put % 2 = 0"), one.where("put % 2 = 1"))


@query("select md5(source) as hash, string_agg(distinct concat('artifact-', doc_id % 3), ',' order by concat('artifact-', doc_id % 3)) as names from documents group by source")
def artifact_listing(spark, d):
    """The sorted names of each bundle."""
    rows = S.table(spark, d, "documents").select(F.md5("source").alias("hash"), F.concat(F.lit("artifact-"), F.col("doc_id") % 3).alias("name"))
    return rows.groupBy("hash").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))
