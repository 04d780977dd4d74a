"""Remote listings: pages that follow tokens, and folders by path."""

import importlib
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Most pages followed in one listing, against a service whose tokens run in a circle.
PAGES = 100_000


def page_of_folder(path: str, token: str) -> dict:
    """A page kept as a JSON file: items and, but for the last one, next."""
    with open(os.path.join(path, f"{token or 'first'}.json")) as f:
        return json.load(f)


class Listing(DataSource):
    """`spark.read.format("listing")`: items of a paged service in their order, from the first page on until no token follows.
    Option `path` is given to the fetching function together with the token; option `fetch` names that function as
    module:name, a reader of JSON files by default. An item is a dict; its id and title come out as columns."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "position long, id string, title string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


class ListingReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.fetch = options.get("fetch", f"{__name__}:page_of_folder")

    def partitions(self):
        return [InputPartition(0)]  # a token is known only once the page before it was read

    def read(self, partition):
        module, name = self.fetch.split(":")
        fetch, token, at, seen = getattr(importlib.import_module(module), name), "", 0, set()
        while token not in seen and len(seen) < PAGES:
            seen.add(token)
            page = fetch(self.path, token)
            for item in page.get("items") or []:
                yield at, item.get("id"), item.get("title")
                at += 1
            token = page.get("next")
            if not token:
                return
        raise RuntimeError(f"the pages of {self.path} don't end")


def resolve_paths(folders: DataFrame, paths: DataFrame, root: str = "root") -> DataFrame:
    """`paths` (a column path) with id and missing. A path without a slash is an id; others go from the root folder down, a join
    for each level, and the least id of several folders of one name and parent counts. A path that ends nowhere has a null id,
    and missing is its first part that isn't there. Empty parts count nothing. `folders` has id, parent and name."""
    one = folders.groupBy("parent", "name").agg(F.min("id").alias("_next"))
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    walk = paths.withColumns({"_parts": F.when(F.col("path").contains("/"), parts).otherwise(F.array().cast("array<string>")), "id": F.when(F.col("path").contains("/"), root).otherwise(F.col("path")), "missing": F.lit(None).cast("string")})
    depth = walk.agg(F.max(F.size("_parts"))).first()[0] or 0
    for k in range(depth):
        part = F.get("_parts", F.lit(k))
        found = walk.join(one.withColumnsRenamed({"parent": "_parent", "name": "_name"}), (F.col("id") == F.col("_parent")) & (part == F.col("_name")), "left")
        here = F.size("_parts") > k
        walk = found.select(*paths.columns, "_parts", F.when(here, F.col("_next")).otherwise(F.col("id")).alias("id"), F.coalesce("missing", F.when(here & F.col("id").isNotNull() & F.col("_next").isNull(), part)).alias("missing"))
    return walk.drop("_parts")
