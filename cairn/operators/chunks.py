"""Chunking, deduplication and integrity of contents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import ship

WINDOW = 48


def fixed_chunks(entries: DataFrame, size: int) -> DataFrame:
    """(entry_id, ordinal, chunk_offset, chunk_size, sha256): a cut every `size` bytes, the tail kept, nothing for empty content."""
    cut = entries.select("entry_id", F.col("content").cast("binary").alias("c")).where(F.octet_length("c") > 0)

    def piece(offset: Column) -> Column:
        part = F.substring(F.col("c"), offset + 1, F.lit(size))
        return F.struct(offset.cast("long").alias("chunk_offset"), F.octet_length(part).cast("long").alias("chunk_size"), F.sha2(part, 256).alias("sha256"))

    # digests are made within the row, so that exploding copies them and not the content
    made = F.transform(F.sequence(F.lit(0), F.octet_length("c") - 1, F.lit(size)), piece)
    return cut.select("entry_id", F.posexplode(made).alias("ordinal", "p")).select("entry_id", "ordinal", "p.*")


def hash_table(seed: int = 1) -> np.ndarray:
    """256 pseudo-random 32-bit numbers of the cyclic-polynomial hash, from a rule: the splitmix generator."""
    x = np.uint64(seed) + np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


def window_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Cyclic-polynomial hash of every 48-byte window; entry j is that of data[j : j + 48]."""
    mixed = table[data]
    n = len(data) - WINDOW + 1
    out = np.zeros(max(0, n), np.uint32)
    for j in range(WINDOW if n > 0 else 0):
        r = np.uint32((WINDOW - 1 - j) % 32)
        part = mixed[j : j + n]
        out ^= (part << r) | (part >> np.uint32(32 - r)) if r else part
    return out


def content_cuts(raw: bytes, least: int, most: int, average: int, table: np.ndarray) -> list[int]:
    """Ends of content-defined chunks.

    Data of at most `most` bytes is one chunk. Else a chunk ends at i (counted from `least` on) when it
    has `most` bytes, or has at least `least` and the hash of the 48 bytes before i has its low
    bits, `average` - 1, all zero. Hashes are computed at once; only candidate ends are walked.
    """
    n = len(raw)
    if n <= most:
        return [n] if n else []
    data = np.frombuffer(raw, np.uint8)
    h = window_hashes(data, table)
    early = np.uint32(0)
    for b in data[: min(WINDOW, n)]:
        early = np.uint32((int(early) << 1 | int(early) >> 31) & 0xFFFFFFFF) ^ table[b]
    at = np.arange(least, n)
    hashes = np.where(at >= WINDOW, h[np.clip(at - WINDOW, 0, max(0, len(h) - 1))] if len(h) else early, early)
    ends = at[(hashes & np.uint32(average - 1)) == 0]
    cuts, last, k = [], 0, 0
    while True:
        k = int(np.searchsorted(ends, last + least))
        stop = max(last + most, least)
        nxt = int(ends[k]) if k < len(ends) else n
        cut = min(nxt, stop)
        if cut >= n:
            break
        cuts.append(cut)
        last = cut
    return [*cuts, n] if last < n else cuts


def content_chunks(entries: DataFrame, least: int = 4096, most: int = 1 << 20, average: int = 65_536, seed: int = 1) -> DataFrame:
    """(entry_id, ordinal, chunk_offset, chunk_size, sha256) by content-defined cuts; the table of the hash comes from a seed."""
    import hashlib

    ship(entries.sparkSession)
    table = hash_table(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for entry, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py() or b""
                start = 0
                for k, end in enumerate(content_cuts(raw, least, most, average, table)):
                    rows.append((entry, k, start, end - start, hashlib.sha256(raw[start:end]).hexdigest()))
                    start = end
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["entry_id", "ordinal", "chunk_offset", "chunk_size", "sha256"])

    return entries.select("entry_id", F.col("content").cast("binary")).mapInArrow(run, "entry_id long, ordinal int, chunk_offset long, chunk_size long, sha256 string")


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """(sha256, chunk_size, ref_count, first_entry): the first occurrence wins; full hashes are the key."""
    return chunks.groupBy("sha256").agg(F.max("chunk_size").alias("chunk_size"), F.count("*").alias("ref_count"), F.min("entry_id").alias("first_entry"))


def dedup_summary(chunks: DataFrame) -> DataFrame:
    """One row: chunks, unique_chunks, logical_bytes, stored_bytes and their ratio (1 when empty)."""
    out = unique_chunks(chunks).agg(F.coalesce(F.sum("ref_count"), F.lit(0)).alias("chunks"), F.count("*").alias("unique_chunks"), F.coalesce(F.sum(F.col("chunk_size") * F.col("ref_count")), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum("chunk_size"), F.lit(0)).alias("stored_bytes"))
    return out.withColumn("dedup_ratio", F.round(F.when(F.col("logical_bytes") == 0, 1.0).otherwise(F.col("stored_bytes") / F.greatest("logical_bytes", F.lit(1))), 6))


def missing_chunks(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.join(stored.select("sha256"), "sha256", "left_anti")


def register_chunks(stored: DataFrame, more: DataFrame) -> DataFrame:
    """The store with descriptors it lacks put in."""
    return stored.unionByName(missing_chunks(more, stored))


def exact_duplicates(entries: DataFrame) -> DataFrame:
    """(sha256, copies, first_entry, wasted_bytes) of contents that occur more than once."""
    return entries.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("entry_id").alias("first_entry"), F.max("original_size").alias("size")).where("copies > 1").select("sha256", "copies", "first_entry", ((F.col("copies") - 1) * F.col("size")).alias("wasted_bytes"))


def integrity(entries: DataFrame, content: Column) -> DataFrame:
    """One row: how many entries' contents match their recorded digest and size."""
    good = (F.sha2(content.cast("binary"), 256) == F.col("sha256")) & (F.octet_length(content) == F.col("original_size"))
    return entries.agg(F.count("*").alias("entries"), F.count_if(good).alias("intact"), F.count_if(~good).alias("damaged"))


def read_span(content: Column, offset: int, length: int) -> Column:
    """Bytes [offset, offset + length) or null where they aren't all there."""
    return F.when(F.octet_length(content) >= offset + length, F.substring(content.cast("binary"), offset + 1, length))
