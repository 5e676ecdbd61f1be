"""Snapshot manifests, deltas and patches. A manifest has (path, entry_id, size, checksum, block_ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("entry_id", "size", "checksum", "block_ids")


def latest(nodes: DataFrame, order: str) -> DataFrame:
    """One node per path, the last written by `order`."""
    rest = [c for c in nodes.columns if c != "path"]
    return nodes.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("_n")).select("path", "_n.*")


def _new_blocks(old: Column, new: Column) -> Column:
    """Blocks of the target that the base lacks, in order, repeats kept."""
    return F.filter(new, lambda b: ~F.coalesce(F.array_contains(old, b), F.lit(False)))


def delta(base: DataFrame, target: DataFrame) -> DataFrame:
    """(path, action, old_*, new_*, new_block_ids) of added, deleted and modified paths.

    Modified means that checksum or size differ; time, id and blocks are not looked at.
    All old and new columns are kept, so sizes and reused blocks can be worked out from a stored delta.
    """
    side = lambda df, p: df.select("path", *[F.col(c).alias(f"{p}_{c}") for c in FIELDS], F.lit(True).alias(f"_{p}"))
    both = side(base, "old").join(side(target, "new"), "path", "full_outer")
    changed = ~(F.col("old_checksum").eqNullSafe(F.col("new_checksum")) & F.col("old_size").eqNullSafe(F.col("new_size")))
    action = F.when(F.col("_old").isNull(), "Added").when(F.col("_new").isNull(), "Deleted").when(changed, "Modified")
    out = both.withColumn("action", action).where("action is not null")
    fresh = F.when(F.col("action") == "Added", F.col("new_block_ids")).when(F.col("action") == "Modified", _new_blocks(F.col("old_block_ids"), F.col("new_block_ids"))).otherwise(F.array().cast("array<bigint>"))
    return out.withColumn("new_blocks", fresh).drop("_old", "_new")


def delta_summary(changes: DataFrame) -> DataFrame:
    """One row: added, modified, deleted, added_bytes (growth included), deleted_bytes (shrinkage included)."""
    is_ = lambda a: F.col("action") == a
    grown = F.col("new_size") - F.col("old_size")
    added = F.when(is_("Added"), F.col("new_size")).when(is_("Modified"), F.greatest(grown, F.lit(0))).otherwise(0)
    gone = F.when(is_("Deleted"), F.col("old_size")).when(is_("Modified"), F.greatest(-grown, F.lit(0))).otherwise(0)
    return changes.agg(F.count_if(is_("Added")).alias("added"), F.count_if(is_("Modified")).alias("modified"), F.count_if(is_("Deleted")).alias("deleted"), F.coalesce(F.sum(added), F.lit(0)).alias("added_bytes"), F.coalesce(F.sum(gone), F.lit(0)).alias("deleted_bytes"))


def reused_blocks(changes: DataFrame) -> DataFrame:
    """(path, ordinal, block_id): blocks of modified nodes that their old version has too, repeats kept."""
    both = F.filter("new_block_ids", lambda b: F.array_contains("old_block_ids", b))
    return changes.where("action = 'Modified'").select("path", F.posexplode(both).alias("ordinal", "block_id"))


def apply_patch(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The target manifest: base nodes that no change touches, and the new nodes of added and modified paths."""
    kept = base.join(changes.select("path"), "path", "left_anti").select("path", *FIELDS)
    new = changes.where("action <> 'Deleted'").select("path", *[F.col(f"new_{c}").alias(c) for c in FIELDS])
    return kept.unionByName(new)


def manifest_stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


class Catalog:
    """Snapshots in one folder: a parquet table for each, and a log of events that says which ones exist and which is current.

    Ids are sequential, a new one's parent is the current one. The log has one short row per event and is read on the driver.
    """

    LOG = "number long, event string, snapshot_id long, parent_id long, label string"

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _events(self) -> list:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self.LOG).parquet(f"{self.folder}/log").orderBy("number").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def _note(self, event: str, snapshot: int, parent: int = 0, label: str = "") -> None:
        self.spark.createDataFrame([(len(self._events()) + 1, event, snapshot, parent, label)], self.LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def _state(self) -> tuple[dict[int, tuple[int, str]], int, int]:
        """(snapshots by id with parent and label, the current id or 0, the next id)."""
        kept: dict[int, tuple[int, str]] = {}
        current, following = 0, 1
        for e in self._events():
            if e.event == "delete":
                kept.pop(e.snapshot_id, None)
                current = max(kept, default=0) if current == e.snapshot_id else current
                continue
            current = e.snapshot_id
            if e.event == "add":
                kept[e.snapshot_id] = (e.parent_id, e.label)
                following = max(following, e.snapshot_id + 1)
        return kept, current, following

    def ids(self) -> list[int]:
        return sorted(self._state()[0])

    def count(self) -> int:
        return len(self._state()[0])

    def list(self) -> DataFrame:
        """(snapshot_id, parent_id, label, current) by id."""
        kept, current, _ = self._state()
        return self.spark.createDataFrame([(i, *kept[i], i == current) for i in sorted(kept)], "snapshot_id long, parent_id long, label string, current boolean")

    def _put(self, snapshot: int, nodes: DataFrame, parent: int, label: str) -> None:
        nodes.select("path", *FIELDS).write.mode("overwrite").parquet(f"{self.folder}/snapshot_id={snapshot}")
        self._note("add", snapshot, parent, label)

    def create(self, nodes: DataFrame, label: str = "") -> int:
        _, current, new = self._state()
        self._put(new, nodes, current, label or f"snapshot_{new}")
        return new

    def register(self, snapshot: int, nodes: DataFrame, label: str = "", parent: int = 0) -> bool:
        """Put in a snapshot under its own id and make it current; False, and nothing done, if the id is taken."""
        if snapshot in self._state()[0]:
            return False
        self._put(snapshot, nodes, parent, label or f"snapshot_{snapshot}")
        return True

    def get(self, snapshot: int) -> DataFrame:
        if snapshot not in self.ids():
            raise KeyError(snapshot)
        return self.spark.read.parquet(f"{self.folder}/snapshot_id={snapshot}")

    def current(self) -> int | None:
        """The snapshot made, registered or checked out last; the newest that is left once that one is deleted."""
        return self._state()[1] or None

    def checkout(self, snapshot: int) -> bool:
        if snapshot not in self.ids():
            return False
        self._note("checkout", snapshot)
        return True

    def delete(self, snapshot: int) -> bool:
        if snapshot not in self.ids():
            return False
        self._note("delete", snapshot)
        return True

    def delta(self, old: int, new: int) -> DataFrame:
        """Changes from one snapshot to another, with their ids as base_id and target_id."""
        return delta(self.get(old), self.get(new)).withColumns({"base_id": F.lit(old).cast("long"), "target_id": F.lit(new).cast("long")})

    def apply(self, base: int, changes: DataFrame, target: int, label: str = "") -> bool:
        """Register the target of a delta of `delta`; False if some change was made against another base, or the target id is taken."""
        if not changes.where(F.col("base_id") != base).isEmpty():
            return False
        return self.register(target, apply_patch(self.get(base), changes), label or f"reconstructed_snap_{target}", base)
