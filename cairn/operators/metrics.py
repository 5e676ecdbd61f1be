"""Storage metrics: entropy, fragmentation, ratios, and their renderings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.paths import format_bytes, progress_bar
from cairn.plans.ordered import previous, running
from cairn.session import ship

ZERO, TEXT, BINARY, COMPRESSED, ENCRYPTED = "ZeroFilled", "LowEntropyText", "StructuredBinary", "HighEntropyCompressed", "EncryptedUniform"
SYMBOLS = {ZERO: ".", TEXT: "T", BINARY: "B", COMPRESSED: "C", ENCRYPTED: "E"}


def entropy(entries: DataFrame, id_col: str = "entry_id", content: str = "content") -> DataFrame:
    """(id, size, entropy, class): Shannon entropy of byte values in bits.

    Bytes are counted within the row, so nothing is shuffled and a content of any length is one row. Null or empty
    content: size 0, entropy 0, zero-filled. Repeated rows give repeated results.
    """
    ship(entries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, values, nonzero = [], [], []
            for content in batch.column(1):
                raw = content.as_buffer() if content.is_valid else b""
                counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                n, some = int(counts.sum()), counts[counts > 0]
                sizes.append(n)
                values.append(round(float(np.log2(n) - (some * np.log2(some)).sum() / n), 6) + 0.0 if n else 0.0)
                nonzero.append(n - int(counts[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(values, pa.float64()), pa.array(nonzero, pa.int64())], [id_col, "size", "entropy", "_nz"])

    out = entries.select(id_col, F.col(content).cast("binary")).mapInArrow(run, f"`{id_col}` {entries.schema[id_col].dataType.simpleString()}, size long, entropy double, _nz long")
    return out.select(id_col, "size", "entropy", classify(F.col("entropy"), F.col("_nz")).alias("class"))


def classify(value: Column, nonzero: Column) -> Column:
    return F.when(nonzero == 0, ZERO).when(value < 5.0, TEXT).when(value < 6.8, BINARY).when(value < 7.85, COMPRESSED).otherwise(ENCRYPTED)


def entropy_bar(samples: DataFrame, order: str, width: int) -> str | DataFrame:
    """One row `bar`: column c shows the class of sample floor(c * n / width) in the given order.

    `samples` has class and a dense 0-based `ordinal`; at most `width` samples are gathered.
    """
    n = samples.agg(F.count("*").alias("n"))
    picks = n.select(F.col("n"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("c")).where("n > 0").select("c", F.floor(F.col("c") * F.col("n") / width).cast("long").alias("ordinal"))
    symbol = F.lit("?")
    for name, mark in SYMBOLS.items():
        symbol = F.when(F.col("class") == name, mark).otherwise(symbol)
    shown = samples.join(F.broadcast(picks), order).select("c", symbol.alias("s"))
    return shown.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "s"))), lambda x: x.getField("s")), "").alias("bar"))


def fragmentation(blocks: DataFrame, key: list[str], by: list[str] | None = None, span: int | None = None) -> DataFrame:
    """Sum of positive gaps between consecutive blocks (in `key` order) over the span, limited to 0 .. 1.

    `blocks` has offset and size. With `by`, each group on its own (a window per group);
    without, over the whole table by ranges. The span is that of the blocks, or as given. One block, or span 0, gives 0.
    """
    if by:
        gapped = blocks.withColumn("_end", F.lag(F.col("offset") + F.col("size")).over(Window.partitionBy(*by).orderBy(*key)))
    else:
        gapped = previous(blocks.withColumn("_e", F.col("offset") + F.col("size")), key, "_e", "_end")
    gap = F.greatest(F.coalesce(F.col("offset") - F.col("_end"), F.lit(0)), F.lit(0))
    out = gapped.groupBy(*(by or [])).agg(F.sum(gap).alias("gaps"), (F.max(F.col("offset") + F.col("size")) - F.min("offset") if span is None else F.lit(span).cast("long")).alias("span"), F.count("*").alias("blocks"))
    ratio = F.when((F.col("blocks") <= 1) | (F.col("span") <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.col("gaps") / F.greatest("span", F.lit(1))))
    return out.withColumn("fragmentation", F.round(ratio, 6))


def storage_ratios(raw: Column, packed: Column) -> dict[str, Column]:
    """Compression ratio (1 if nothing is stored) and savings in percent (0 unless raw >= packed > or raw > 0)."""
    ratio = F.when(packed == 0, 1.0).otherwise(raw / F.greatest(packed, F.lit(1)))
    saved = F.when((raw > 0) & (raw >= packed), (1 - packed / F.greatest(raw, F.lit(1))) * 100).otherwise(0.0)
    return {"compression_ratio": F.round(ratio, 6), "savings_percent": F.round(saved, 6)}


def hit_ratio(hits: Column, misses: Column) -> Column:
    return F.round(F.when(hits + misses == 0, 0.0).otherwise(hits / F.greatest(hits + misses, F.lit(1))), 6)


def layout(entries: DataFrame, size: str = "original_size") -> DataFrame:
    """Entries with `offset`: the stored bytes before each, in id order."""
    return running(entries, ["entry_id"], F.col(size), name="offset")


def find_blocks(blocks: DataFrame, probes: DataFrame) -> DataFrame:
    """The block [offset, offset + size) that holds each probe's `at`: an interval join.

    A block is keyed by its level, the power of 256 that its size fits in, and the one or two cells of that width that it
    touches; a probe is keyed once for each of the eight levels. So a block of any size is two rows at most, and where blocks don't overlap a
    probe meets no more than 257 of a level. Blocks that are empty or have a null hold nothing; probes that no block holds, or with a
    null, are left out; where blocks overlap each one that holds a probe is returned.
    """
    cell = lambda at: F.call_function("shiftright", at.cast("long"), F.col("_level"))
    levels = range(0, 64, 8)
    level = F.size(F.filter(F.array(*[F.lit(1 << k) for k in levels]), lambda least: least < F.col("size"))) * 8
    levelled = blocks.where("size > 0 and offset is not null").withColumn("_level", F.least(level, F.lit(56)))
    cells = levelled.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(F.col("offset")), cell(F.col("offset") + F.col("size") - 1)))))
    keyed = probes.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_cell", cell(F.col("at")))
    return keyed.join(cells, ["_level", "_cell"]).where((F.col("at") >= F.col("offset")) & (F.col("at") < F.col("offset") + F.col("size"))).drop("_cell", "_level")


def dashboard(storage: DataFrame, accesses: DataFrame, transactions: DataFrame, fragments: DataFrame) -> DataFrame:
    """One row of all counters and ratios.

    `storage`: one row with entries, raw, packed, blocks. `accesses`: rows with a boolean `hit`. `transactions`: rows with a boolean `committed`. `fragments`: one row
    with `fragmentation`. Empty tables count 0; null flags count as neither.
    """
    hits = accesses.agg(F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"))
    done = transactions.agg(F.count_if("committed").alias("journal_committed"), F.count_if(~F.col("committed")).alias("journal_pending"))
    all_ = storage.crossJoin(F.broadcast(hits)).crossJoin(F.broadcast(done)).crossJoin(F.broadcast(fragments.select("fragmentation")))  # one row each
    return all_.withColumns({**storage_ratios(F.col("raw"), F.col("packed")), "cache_hit_ratio": hit_ratio(F.col("cache_hits"), F.col("cache_misses"))})


def text_report(archive: str, bar: Column, cache: bool = True, journal: bool = True) -> Column:
    """A dashboard row as a text; `bar` is an entropy bar, or null for none."""
    rule = "=" * 80
    line = lambda name, value: F.concat(F.lit(f"  {name}:".ljust(24)), value.cast("string"), F.lit("\n"))
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.col(c))
    parts = [F.lit(f"{rule}\n  Inspection Dashboard | Target: {archive or '(in-memory)'}\n{rule}\n\n--- Storage & Compression Metrics ---\n"), line("Total Entries", F.col("entries")), line("Uncompressed Size", format_bytes(F.col("raw"))), line("Compressed Size", format_bytes(F.col("packed")))]
    parts += [line("Compression Ratio", F.concat(fixed("compression_ratio", 2), F.lit(":1"))), line("Space Savings", F.concat(fixed("savings_percent", 1), F.lit("%"))), line("Savings Gauge", progress_bar(F.col("savings_percent") / 100.0, 30)), line("Active Blocks", F.col("blocks")), line("Fragmentation Index", fixed("fragmentation", 4))]
    if cache:
        parts += [F.lit("\n--- Cache Subsystem ---\n"), line("Cache Hits", F.col("cache_hits")), line("Cache Misses", F.col("cache_misses")), line("Hit Ratio Gauge", progress_bar(F.col("cache_hit_ratio"), 30))]
    legend = "  Legend: [.] Zero  [T] Text  [B] Binary  [C] Compressed  [E] Encrypted\n"
    parts.append(F.when(bar.isNull() | (bar == ""), F.lit("")).otherwise(F.concat(F.lit("\n--- Archive Block Entropy Heatmap ---\n  ["), bar, F.lit(f"]\n{legend}"))))
    if journal:
        state = F.when(F.col("journal_pending") > 0, "WAL DIRTY / ROLL-FORWARD READY").otherwise("CLEAN / SYNCHRONIZED")
        wide = lambda name, value: F.concat(F.lit(f"  {name}:".ljust(26)), value.cast("string"), F.lit("\n"))
        parts += [F.lit("\n--- Journal & Transaction State ---\n"), wide("Committed Transactions", F.col("journal_committed")), wide("Pending Transactions", F.col("journal_pending")), wide("Journal Status", state)]
    return F.concat(*parts, F.lit(f"\n{rule}\n"))


def json_report(archive: str, samples: Column) -> Column:
    """A dashboard row as JSON; `samples` is the number of entropy samples."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.col(c)).cast(f"decimal(38,{n})")
    values = {"totalEntries": F.col("entries"), "uncompressedBytes": F.col("raw"), "compressedBytes": F.col("packed"), "compressionRatio": fixed("compression_ratio", 4), "spaceSavingsPercent": fixed("savings_percent", 2), "activeBlocks": F.col("blocks"), "fragmentationIndex": fixed("fragmentation", 4)}
    values |= {"cacheHits": F.col("cache_hits"), "cacheMisses": F.col("cache_misses"), "cacheHitRatio": fixed("cache_hit_ratio", 4), "journalCommittedTx": F.col("journal_committed"), "journalPendingTx": F.col("journal_pending")}
    return F.to_json(F.struct(F.lit(archive).alias("archive"), F.struct(*[c.alias(n) for n, c in values.items()]).alias("metrics"), samples.alias("entropySamplesCount")))
