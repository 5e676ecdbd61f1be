"""Input tables, and views of them as archive entries, blocks, snapshots and journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as archive entries: (entry_id, path, type, content, original_size, sha256)."""
    d = load(spark, sf_dir, "documents")
    content = F.coalesce(F.col("text"), F.lit(""))
    return d.select(
        F.col("doc_id").alias("entry_id"),
        F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.lit("File").alias("type"),
        content.alias("content"),
        F.octet_length(content).cast("long").alias("original_size"),
        F.sha2(content.cast("binary"), 256).alias("sha256"),
    )


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as entries: the path is host and path of the URL; a trailing slash makes it a directory."""
    p = load(spark, sf_dir, "pages")
    rest = F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1)
    return p.select(F.col("page_id").alias("entry_id"), F.concat(F.lit("/"), rest).alias("path"), F.when(rest.endswith("/"), "Directory").otherwise("File").alias("type"), F.octet_length("html").cast("long").alias("original_size"))


#: How event types stand for journal entry types.
JOURNAL_TYPES = {"signup": "BeginCheckpoint", "view": "CreateEntry", "click": "UpdateEntry", "purchase": "Commit", "error": "Abort"}


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a journal: (seq, type, entry_id, ts, data); other event types count as DeleteEntry."""
    return as_journal(load(spark, sf_dir, "events"))


def as_journal(events: DataFrame) -> DataFrame:
    kind = F.lit("DeleteEntry")
    for event, entry in JOURNAL_TYPES.items():
        kind = F.when(F.col("event_type") == event, entry).otherwise(kind)
    return events.select(F.col("event_id").alias("seq"), kind.alias("type"), F.col("user_id").alias("entry_id"), "ts", F.col("props").alias("data"))


def snapshot_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshot manifests made of the documents: (base, target).

    The base lacks every seventh id, the target every fifth; every third node of the target grew
    by 10 bytes. Block ids are id and id + 1 (base), id and id + 2 (changed target nodes).
    """
    e = document_entries(spark, sf_dir)
    one = lambda *c: F.array(*[x.cast("long") for x in c])
    i = F.col("entry_id")
    node = e.select("path", "entry_id", F.col("original_size").alias("size"), "sha256")
    base = node.where(i % 7 != 0).select("path", "entry_id", "size", F.col("sha256").alias("checksum"), one(i, i + 1).alias("block_ids"))
    changed = i % 3 == 0
    target = node.where(i % 5 != 0).select("path", "entry_id", (F.col("size") + F.when(changed, 10).otherwise(0)).alias("size"), F.when(changed, F.sha2(F.concat("sha256", F.lit("+")), 256)).otherwise(F.col("sha256")).alias("checksum"), F.when(changed, one(i, i + 2)).otherwise(one(i, i + 1)).alias("block_ids"))
    return base, target
