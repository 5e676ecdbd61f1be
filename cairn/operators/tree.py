"""Catalogue lookups and directory trees over (entry_id, path, ...) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths as P
from cairn.plans.ordered import numbered


def _parts(path: str) -> list[str]:
    return [x for x in path.split("/") if x not in ("", ".", "..")]


def find_path(entries: DataFrame, path: str) -> DataFrame:
    """Entries at a path, both sides normalised; several if paths repeat, none for null paths."""
    return entries.where(P.normalize("path") == F.lit("/" + "/".join(_parts(path))))


def find_id(entries: DataFrame, entry_id: int) -> DataFrame:
    return entries.where(F.col("entry_id") == entry_id)


def find_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """By the string's beginning, not by components: `/a` finds `/ab`."""
    return entries.where(F.col("path").startswith(prefix))


def find_type(entries: DataFrame, kind: str) -> DataFrame:
    return entries.where(F.col("type") == kind)


def find_glob(entries: DataFrame, glob: str) -> DataFrame:
    return entries.where(P.matches_glob("path", glob))


def existing(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `wanted` whose path is an entry's."""
    return wanted.join(entries.select("path"), "path", "left_semi")


def ancestors(entries: DataFrame) -> DataFrame:
    """(entry_id, dir) for every directory above each entry, the root included."""
    parts = P.components("path")
    dirs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))
    return entries.select("*", F.explode(dirs).alias("dir"))


def nodes(entries: DataFrame) -> DataFrame:
    """Every node of the tree: (path, depth, is_leaf), leaves and implicit directories, once each."""
    leaf = entries.select(P.normalize("path").alias("path"), F.lit(1).alias("leaf"))
    above = ancestors(entries).select(F.col("dir").alias("path"), F.lit(0).alias("leaf"))
    return leaf.unionByName(above).groupBy("path").agg(F.min("leaf").alias("leaf")).select("path", P.depth("path").alias("depth"), (F.col("leaf") == 1).alias("is_leaf"))


def list_directory(entries: DataFrame, directory: str) -> DataFrame:
    """Direct children of a directory, entries and subdirectories, once each: (path, depth, is_leaf).

    Only entries below the directory are looked at. The directory may be written in any form that normalises
    to it; one that is missing, empty, or a leaf has no children. Null paths are below none.
    """
    parts = _parts(directory)
    home = "".join("/" + x for x in parts) + "/"
    below = entries.select(P.normalize("path").alias("path")).where(F.col("path").startswith(home) & (F.col("path") != home))
    rest = F.substring_index(F.expr(f"substring(path, {len(home) + 1})"), "/", 1)
    child = F.concat(F.lit(home), rest)
    return below.groupBy(child.alias("child")).agg(F.min((F.col("path") == child).cast("int")).alias("leaf")).select(F.col("child").alias("path"), F.lit(len(parts) + 1).alias("depth"), (F.col("leaf") == 1).alias("is_leaf"))


def directory_rollup(entries: DataFrame) -> DataFrame:
    """(dir, entries, bytes) of everything below each directory."""
    return ancestors(entries).groupBy("dir").agg(F.count("*").alias("entries"), F.sum("original_size").alias("bytes"))


def preorder(entries: DataFrame) -> DataFrame:
    """Nodes in depth-first order, children by name: (position from 0, path).

    Ordered by the path's components, which is the order of the walk. Nodes are sorted by ranges of that key, however
    many share a first component, and positions come from counts per partition. An entry with a null path is no node.
    """
    listed = nodes(entries.where(F.col("path").isNotNull())).select("path", F.array_join(P.components("path"), "\u0001").alias("key"))
    return numbered(listed, "key").select("position", "path")


def remove_subtree(entries: DataFrame, path: str) -> DataFrame:
    """Entries that are neither the path nor below it; the root removes all."""
    if path == "/":
        return entries.where(F.lit(False))
    return entries.where(~((F.col("path") == path) | F.col("path").startswith(path + "/")))


def upsert(entries: DataFrame, newer: DataFrame) -> DataFrame:
    """Entries with those of `newer` put in, an equal id being replaced."""
    return entries.join(newer.select("entry_id"), "entry_id", "left_anti").unionByName(newer, allowMissingColumns=True)


def validate(entries: DataFrame) -> DataFrame:
    """One row: entries, distinct ids, distinct paths and whether each id occurs once."""
    out = entries.agg(F.count("*").alias("entries"), F.countDistinct("entry_id").alias("ids"), F.countDistinct("path").alias("paths"))
    return out.withColumn("valid", F.col("entries") == F.col("ids"))
