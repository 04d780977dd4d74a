"""The file tree of exports: what is staged, and the records beside it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I


def export_files(pages: DataFrame, seeds: DataFrame, profiles: DataFrame) -> DataFrame:
    """user_id, path and content of each export's page file, backup record, settings and profile. `pages` has user_id and
    content, `seeds` user_id and seed, `profiles` user_id and profile. Analysis files join them by union."""
    rows = pages.join(seeds, "user_id").join(profiles, "user_id")
    file = lambda path, content: F.struct(path.alias("path"), content.alias("content"))
    files = [
        file(F.lit("tree/PIONEER/rekordbox/export.pdb"), F.col("content")),
        file(F.concat(F.lit("tree/PIONEER/DeviceLibBackup/"), I.backup_name(F.col("seed"))), F.encode(I.backup_column(I.uuid_of(F.col("seed"))), "UTF-8")),
        file(F.lit("tree/PIONEER/DEVSETTING.DAT"), F.lit(I.settings_file())),
        file(F.lit("tree/PIONEER/djprofile.nxs"), F.unhex(I.profile_column(F.col("profile")))),
    ]
    return rows.select("user_id", F.explode(F.array(*files)).alias("f")).select("user_id", "f.*")


def records(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """user_id, path and content of the records beside each tree: manifest.json with its entries in order, sources.json and the
    owner. `manifest` has user_id, place, usb_path, size and source (JSON), `sources` user_id and sources (JSON)."""
    entry = F.concat(F.lit('{"usb_path":"'), "usb_path", F.lit('","size":'), F.coalesce(F.col("size").cast("string"), F.lit("0")), F.lit(',"source":'), "source", F.lit("}"))
    listed = manifest.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("place", entry.alias("e")))).alias("e"))
    whole = F.concat(F.lit('{"entries":['), F.array_join(F.transform("e", lambda x: x["e"]), ","), F.lit("]}"))
    rows = listed.select("user_id", whole.alias("manifest")).join(sources, "user_id")
    pairs = [("manifest.json", F.col("manifest")), ("sources.json", F.col("sources")), ("owner", F.col("user_id").cast("string"))]
    files = F.array(*[F.struct(F.lit(path).alias("path"), F.encode(text, "UTF-8").alias("content")) for path, text in pairs])
    return rows.select("user_id", F.explode(files).alias("f")).select("user_id", "f.*")
