"""Near-duplicate classes of documents: fast similarity sketches, banding, exact verification, components.

A document is the set of its distinct runs of five words. Documents with equal sets form a class at once; the rest works on
one member of each class. Every band bucket has its member with the smallest id as hub, and each member is verified against
the hub on full sets. Members that stay outside the hub's component are then compared exactly with every other member of the
hub's group, in blocks of a bounded number of outsiders, through bitmaps over the hub's set and the runs that the hub lacks:
no pair of a group is written out unless it is a link, and none is left unchecked."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, dropped, released, saved
from .components import components
from .sketch import band_keys, sketch
from .text import U, chunks, mix, shingle_sets, text_bytes

WIDTH, COORDINATES, BAND, PERCENT = 5, 128, 4, 75
#: Members compared with one copy of their hub, and outsiders held by one block.
BLOCK = 256


def _classes(items: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit name of each set, 0 for the empty one."""
    size = np.diff(first)
    names = np.zeros((2, len(size)), U)
    some = size > 0
    if some.any():
        at, n = first[:-1][some], size[some].astype(U)
        for half, seed in enumerate((901, 911)):
            total = np.add.reduceat(mix(items, seed), at) + mix(np.bitwise_xor.reduceat(mix(items, seed + 1), at), seed + 2)
            names[half, some] = mix(total + n, seed + 3)
    return names[0].view(np.int64), names[1].view(np.int64)


def _sketches(batches):
    for batch in batches:
        own = ["row"] if "row" in batch.schema.names else []
        data, at = text_bytes(batch.column("text"))
        for a, b in chunks(at):
            items, first = shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], WIDTH)
            keys = band_keys(sketch(items, first, COORDINATES), BAND)
            size = np.diff(first)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(size > 0, keys.shape[1], 0)))), pa.int32()), pa.array(keys[size > 0].reshape(-1).view(np.int64)))
            cls, more = _classes(items, first)
            yield pa.record_batch([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "print")), pa.array(size, pa.int64()), pa.array(cls), pa.array(more), bands, *(batch.column(c).slice(a, b - a) for c in own)], ["doc_id", "print", "n_shingles", "cls", "cls2", "bands", *own])


def linked(inter, one, other):
    """Whether the similarity of sets of these sizes is at least PERCENT."""
    return 100 * inter >= PERCENT * (one + other - inter)


def _stars(batches):
    """Rows sorted by (hub, salt, role): each hub's text, then the members of this salt. A row whose text isn't the class
    it should be is passed over."""
    hub, own = None, np.zeros(0, U)
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        hubs, role, node, cls = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hub", "role", "node", "cls"))
        out: list[tuple] = []
        for a, b in chunks(at):
            items, first = shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], WIDTH)
            names = _classes(items, first)[0]
            for i in range(a, b):
                if names[i - a] != cls[i]:
                    continue
                got = items[first[i - a] : first[i - a + 1]]
                if role[i] == 0:
                    hub, own = hubs[i], got
                elif hub == hubs[i]:
                    place = np.minimum(np.searchsorted(own, got), len(own) - 1)
                    hit = own[place] == got
                    bits = np.zeros(len(own), np.uint8)
                    bits[place[hit]] = 1
                    inter = int(hit.sum())
                    out.append((int(hub), int(node[i]), len(got), inter, bool(linked(inter, len(got), len(own))), np.packbits(bits).tobytes(), got[~hit].tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["hub", "node", "n", "inter", "link", "bits", "novel"])


STARS = "hub long, node long, n long, inter long, link boolean, bits binary, novel binary"


class _Block:
    """Outsiders of one hub, at most BLOCK or so, against a stream of members."""

    def __init__(self):
        self.node, self.label, self.n, self.bits, self.novel = [], [], [], [], []
        self.ready = False

    def add(self, node, label, n, bits, novel):
        for to, x in ((self.node, node), (self.label, label), (self.n, n), (self.bits, np.frombuffer(bits, np.uint8)), (self.novel, np.frombuffer(novel, U))):
            to.append(x)

    def close(self):
        self.node, self.label, self.n = (np.array(x, np.int64) for x in (self.node, self.label, self.n))
        self.bits = np.stack(self.bits)
        owner = np.repeat(np.arange(len(self.node)), [len(x) for x in self.novel])
        flat = np.concatenate(self.novel)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.ready = flat[order], owner[order], True

    def links(self, node, label, n, bits, novel):
        """Outsiders of other components, linked with this member."""
        got = np.frombuffer(novel, U)
        inter = np.bitwise_count(self.bits & np.frombuffer(bits, np.uint8)).sum(1, dtype=np.int64)
        low, high = np.searchsorted(self.flat, got, "left"), np.searchsorted(self.flat, got, "right")
        for a, b in zip(low[high > low], high[high > low], strict=True):
            inter[self.owner[a:b]] += 1
        return self.node[linked(inter, self.n, n) & (self.label != label)]


def _outsiders(batches):
    """Rows sorted by (hub, salt, span, role): the outsiders of this salt (role 0), then the members of this span."""
    at, block = None, _Block()
    for batch in batches:
        out_u, out_v = [], []
        columns = [batch.column(c).to_pylist() for c in ("hub", "salt", "span", "role", "node", "label", "n", "bits", "novel")]
        for hub, salt, span, role, node, label, n, bits, novel in zip(*columns, strict=True):
            if at != (hub, salt, span):
                at, block = (hub, salt, span), _Block()
            if role == 0:
                block.add(node, label, n, bits, novel)
            elif block.ready or block.node:
                if not block.ready:
                    block.close()
                for other in block.links(node, label, n, bits, novel):
                    out_u.append(node)
                    out_v.append(int(other))
        yield pa.record_batch([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself
    included), kept (doc_id = component_id), and n_links (verified links with its hubs; 0 for copies of a class).

    A text without words, null included, has n_shingles 0 and is linked with nothing. Rows that share a doc_id are documents
    of their own. A row with a null doc_id links like any other; its component_id is the smallest id that it reaches, null
    where it reaches none, and it isn't kept. Columns of other names are ignored. An empty table gives no rows.
    Links come from sketches: at similarity 0.75 one is missed with a chance of 5e-6. Texts are one class if a 128-bit name
    of their sets is equal; links are counted on whole sets of 64-bit shingle hashes.

    With `row_col`, a column that tells rows apart, that column comes out as row, and component, the name of the component
    (null for a text without words), which components without an id or of one smallest doc_id do not share."""
    spark = docs.sparkSession
    arrow_limits(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"), *([] if row_col is None else [F.col(row_col).alias("row")]))
    more = "" if row_col is None else f", row {dict(narrow.dtypes)['row']}"
    rows = saved(narrow.mapInArrow(_sketches, "doc_id long, print long, n_shingles long, cls long, cls2 long, bands array<long>" + more), "sketches")
    narrow = narrow.select("doc_id", "print", "text")
    # a class is one node, numbered anew, with the id and print of one of its rows
    one = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "print")).alias("one")
    classes = rows.where("n_shingles > 0").groupBy("cls", "cls2").agg(one, F.min("doc_id").alias("low"))
    classes = saved(classes.select("cls", "cls2", F.monotonically_increasing_id().alias("node"), F.col("one.doc_id").alias("of_id"), F.col("one.print").alias("of_print"), "low"), "classes")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("print") == F.col("of_print"))
    banded = rows.where("n_shingles > 0").join(classes, ["cls", "cls2"]).where(same).select("node", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub")
    hubs = saved(hubs, "hubs")
    pairs = saved(banded.join(hubs, "key").where("node <> hub").select("hub", "node").distinct(), "pairs")
    dropped(hubs)
    released(spark)
    blocks = saved(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    as_hub = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("hub").alias("node"))
    as_member = pairs.join(blocks, "hub").select("hub", F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("salt"), F.lit(1).alias("role"), "node")
    wanted = as_hub.union(as_member).join(classes.select("node", "cls", "of_id", "of_print"), "node")
    dealt = wanted.join(narrow, same).select("hub", "salt", "role", "node", "cls", "text")
    stars = saved(dealt.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "node").mapInArrow(_stars, STARS).distinct(), "stars")
    dropped(blocks, pairs)
    released(spark)
    links = stars.where("link").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    labels = saved(components(links), "labels")
    rest = _rest(stars, labels)
    if rest is not None:
        links = links.union(rest)
        labels = saved(components(links), "labels")
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.join(labels, "node", "left").select("cls", "cls2", "node", "low", F.coalesce("label", "node").alias("label"))
    lowest = saved(named.groupBy("label").agg(F.min("low").alias("component_id")), "lowest")
    named = saved(named.join(lowest, "label").join(degree, "node", "left").select("cls", "cls2", "label", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    dropped(lowest)
    full = rows.drop("bands", "print").join(named, ["cls", "cls2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return full.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *([] if row_col is None else ["row", F.col("label").alias("component")]))


def _rest(stars: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Links between members of one hub's group that lie in different components after the stars; None without any group
    that has an outsider and another member."""
    at = F.col("l.label")
    own = stars.alias("s").join(labels.alias("l"), F.col("s.node") == F.col("l.node"), "left").select("s.*", F.coalesce(at, F.col("s.node")).alias("label"))
    own = own.alias("s").join(labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hub", "left").select("s.*", F.coalesce("hub_label", "hub").alias("hub_label"))
    own = saved(own, "grouped")
    outside = own.where("label <> hub_label")
    groups = own.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("label") != F.col("hub_label")).alias("out")).where("out > 0 and members > 1")
    groups = saved(groups.select("hub", F.ceil(F.col("out") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("members") / (4 * BLOCK)).cast("int").alias("spans")), "groups")
    if groups.isEmpty():
        return None
    keep = ["node", "label", "n", "bits", "novel"]
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = outside.join(groups, "hub").select("hub", F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("salt"), F.explode(span("spans")).alias("span"), F.lit(0).alias("role"), *keep)
    sent = own.join(groups, "hub").select("hub", F.explode(span("blocks")).alias("salt"), F.expr("cast(pmod(xxhash64(node, 1), spans) as int)").alias("span"), F.lit(1).alias("role"), *keep)
    dealt = held.union(sent).repartition("hub", "salt", "span").sortWithinPartitions("hub", "salt", "span", "role", "node")
    return saved(dealt.mapInArrow(_outsiders, "u long, v long").distinct(), "rest")
