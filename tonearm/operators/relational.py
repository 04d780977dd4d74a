"""Relational operators: lookups, upserts, deletes, presence, page and diff joins."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.order import prefix_sums


def search(rows: DataFrame, column: str, q: str | None) -> DataFrame:
    """Case-insensitive containment; a blank query is no filter, a null column never matches, % and _ are wild cards."""
    q = (q or "").strip()
    if not q:
        return rows
    if "%" in q or "_" in q:
        return rows.where(F.col(column).ilike(f"%{q}%"))
    return rows.where(F.lower(column).contains(q.lower()))


def page(rows: DataFrame, order: list, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a totally ordered listing."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_where_null: bool = True) -> DataFrame:
    """The next snapshot: `new` rows replace `old` ones by key; with `keep_old_where_null` a null leaves the old value. A key
    that `new` repeats counts once, with the least of its rows."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else new.distinct()
    n = one.withColumn("_new", F.lit(True)).withColumnsRenamed({c: f"n_{c}" for c in new.columns})
    on = [old[k].eqNullSafe(n[f"n_{k}"]) for k in keys]
    joined = old.join(n, on, "full_outer")
    value = lambda c: F.coalesce(f"n_{c}", old[c]) if keep_old_where_null or c in keys else F.when(F.col("_new"), F.col(f"n_{c}")).otherwise(old[c])
    return joined.select(*[value(c).alias(c) for c in old.columns])


def fill_from(rows: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`rows` with nulls in `columns` taken from the row of `source` with the same key; other values stay."""
    s = source.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(s, rows[key] == s["_k"], "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else c for c in rows.columns])


def inserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` with a column status: 'created' for the first row (by request_id) of a key that `old` lacks, 'taken' for others:
    a violation comes back as a row, and only created rows join the next snapshot."""
    known = old.select(F.col(key).alias("_k")).distinct()
    first = new.groupBy(key).agg(F.min("request_id").alias("_first"))
    joined = new.join(first, key).join(known, F.col(key) == F.col("_k"), "left")
    fresh = F.col("_k").isNull() & (F.col("request_id") == F.col("_first"))
    return joined.select(*new.columns, F.when(fresh, "created").otherwise("taken").alias("status"))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and the first of `new` for each key that it lacks: a conflict does nothing."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def present(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return rows.join(found.select(key), key, "left_semi")


def missing(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return rows.join(found.select(key), key, "left_anti")


def resolve(members: DataFrame, playlists: DataFrame, tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tracks of the wanted playlists, (user_id, playlist_id) each, as far as the playlist is that user's own; one row for each
    user and track."""
    owned = wanted.distinct().join(playlists.select("playlist_id", "user_id"), ["playlist_id", "user_id"], "left_semi")
    return members.join(owned, "playlist_id").select("user_id", "track_id").distinct().join(tracks, "track_id")


def to_transfer(manifest: DataFrame, target: DataFrame, keys: tuple = ("usb_path", "size")) -> DataFrame:
    """Manifest rows that the target lacks: (usb_path, size) decides, within further keys if given."""
    return manifest.join(target.select(*keys), list(keys), "left_anti")


def zipped(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison by keys: same, differs, only_left or only_right."""
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_v"), F.lit(1).alias("_r"))
    l = left.select(*keys, value, F.lit(1).alias("_l"))  # noqa: E741
    state = F.when(F.col("_l").isNull(), "only_right").when(F.col("_r").isNull(), "only_left").when(F.col(value).eqNullSafe(F.col("_v")), "same").otherwise("differs")
    return l.join(r, [l[k].eqNullSafe(r[f"_{k}"]) for k in keys], "full_outer").select(*[F.coalesce(l[k], f"_{k}").alias(k) for k in keys], state.alias("state"))


def first_seen_ids(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Dictionary encoding in order of first appearance, from 1; null and '' are 0. `position` is a number. Returns value and
    code. Values are counted by ranges of their places, so no task holds them all."""
    first = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(value).agg(F.min(position).alias("_at"))
    start = prefix_sums(first.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")), "_at", "_n").select("_at", "start")
    tie = F.row_number().over(Window.partitionBy("_at").orderBy(value))
    coded = first.join(start, "_at").select(value, (F.col("start") + tie).alias("code"))
    zero = rows.where(F.coalesce(F.col(value), F.lit("")) == "").select(value).distinct().withColumn("code", F.lit(0).cast("long"))
    return coded.unionByName(zero)


def nearest_rank(values, share: float = 0.95):
    """The element at floor(n * share), at most the last, of a sorted array: not what percentile functions give."""
    ordered = F.sort_array(values)
    return F.element_at(ordered, F.least(F.floor(F.size(ordered) * F.lit(share)) + 1, F.size(ordered)).cast("int"))


def runs(rows: DataFrame, part: str, position: str, gap: int = 3) -> DataFrame:
    """Gaps and islands: positions no more than `gap` apart make a run."""
    w = Window.partitionBy(part).orderBy(position)
    new = (F.col(position) - F.lag(position).over(w) > gap) | F.lag(position).over(w).isNull()
    named = rows.withColumn("_run", F.sum(new.cast("int")).over(w))
    return named.groupBy(part, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")
