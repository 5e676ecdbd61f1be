"""Blocks of contents: independent compression, framing, and a block store in a shared folder.

A frame is a 25-byte header and the block: two sync bytes, stored and original size as 64-bit
little-endian numbers, one byte each for codec, cipher and whether the block is encrypted, and four
reserved bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.codecs import ALGORITHMS, compress, decompress
from cairn.session import ship

#: Fixed values of the format.
SYNC, FRAME_HEADER, DISK_HEADER = b"NB", 25, 16
BUCKETS = 256
CAPACITY_EXCEEDED, NOT_FOUND, CHECKSUM_MISMATCH = "CapacityExceeded", "NotFound", "ChecksumMismatch"


def cut_blocks(entries: DataFrame, size: int) -> DataFrame:
    """(entry_id, ordinal, original_size, block): contents cut every `size` bytes, the tail kept; null or empty contents have no block."""
    whole = entries.select("entry_id", F.col("content").cast("binary").alias("c")).where(F.octet_length("c") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.octet_length("c") - 1, F.lit(size)), lambda at: F.substring(F.col("c"), at + 1, F.lit(size)))
    return whole.select("entry_id", F.posexplode(parts).alias("ordinal", "block")).select("entry_id", "ordinal", F.octet_length("block").cast("long").alias("original_size"), "block")


def compress_blocks(entries: DataFrame, algorithm: str, size: int = 65_536) -> DataFrame:
    """(entry_id, ordinal, original_size, stored_size, crc32 of the original, block compressed on its own)."""
    ship(entries.sparkSession)
    cut = cut_blocks(entries, size).withColumn("crc32", F.crc32("block"))
    packed = cut.withColumn("block", compress(algorithm)("block"))
    return packed.select("entry_id", "ordinal", "original_size", F.octet_length("block").cast("long").alias("stored_size"), "crc32", "block")


def decompress_blocks(blocks: DataFrame, algorithm: str) -> DataFrame:
    """(entry_id, content, error): the blocks of each entry by ordinal, unpacked and joined.

    The first block that can't be unpacked, or whose bytes don't have the recorded size and CRC-32 (0: not checked), ends its entry: content is
    null and error says which block it was. A gap in the ordinals is an error likewise. One entry's blocks meet in one row, as its content does.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(algorithm)
    ship(blocks.sparkSession)

    unpacked = decompress(algorithm, strict=False)
    each = blocks.select("entry_id", "ordinal", "original_size", "crc32", unpacked("block", "original_size").alias("u"))
    bad = F.col("u").isNull() | F.col("original_size").isNull() | (F.octet_length("u") != F.col("original_size")) | ((F.col("crc32") != 0) & (F.crc32("u") != F.col("crc32")))
    rows = each.groupBy("entry_id").agg(F.min(F.when(bad, F.col("ordinal"))).alias("first"), F.count("*").alias("n"), F.max("ordinal").alias("last"), F.array_sort(F.collect_list(F.struct("ordinal", F.col("u").alias("data")))).alias("parts"))
    error = F.when(F.col("first").isNotNull(), F.concat(F.lit("DecompressionError at block "), F.col("first").cast("string"))).when(F.col("n") != F.col("last") + 1, "MissingBlock")
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p.getField("data")))
    return rows.select("entry_id", F.when(error.isNull(), joined).alias("content"), error.alias("error"))


def size_bound(size: Column, algorithm: str) -> Column:
    """The most bytes that `size` bytes can compress to, by the codec libraries' published bounds; lz4 takes at most 2,113,929,216 bytes (else 0)."""
    n = size.cast("long")
    shift = lambda k: F.shiftright(n, k)
    if algorithm == "none":
        return n
    if algorithm == "lz4":
        return F.when(n > 0x7E000000, 0).otherwise(n + F.floor(n / 255) + 16)
    if algorithm == "zlib":
        return n + shift(12) + shift(14) + shift(25) + 13
    if algorithm == "zstd":
        return n + shift(8) + F.when(n < 131_072, F.shiftright(F.lit(131_072) - n, 11)).otherwise(0)
    raise ValueError(algorithm)


def _byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2, "0"))


def little_endian(value: Column) -> Column:
    """Eight bytes of a long."""
    return F.concat(*[_byte(F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(255)) for i in range(8)])


def from_little_endian(data: Column, at: int) -> Column:
    """The long of eight bytes from a 0-based offset."""
    h = F.hex(F.substring(data, at + 1, 8))
    pairs = [F.substring(h, 2 * i + 1, 2) for i in reversed(range(8))]
    return F.conv(F.concat(*pairs), 16, 10).cast("decimal(20,0)").cast("long")


def frame(block: Column, original_size: Column, algorithm: str = "none", encrypted: Column | None = None) -> Column:
    """A block with its header. Null blocks give null."""
    sealed = F.lit(0) if encrypted is None else encrypted.cast("int")
    head = (F.lit(SYNC), little_endian(F.octet_length(block)), little_endian(original_size), F.lit(bytes([ALGORITHMS.index(algorithm)])), _byte(sealed), _byte(sealed), F.lit(bytes(4)))
    return F.concat(*head, block)


def parse_frame(data: Column, offset: int = 0) -> Column:
    """(error, stored_size, original_size, algorithm, encrypted, block) of the frame at an offset; with an error all else is null."""
    at = lambda k, n: F.substring(data, offset + k + 1, n)
    stored = from_little_endian(data, offset + 2)
    error = F.when(F.octet_length(data) < offset + FRAME_HEADER, "block header truncated").when(at(0, 2) != F.lit(SYNC), "invalid block sync").when((stored < 0) | (F.octet_length(data) - (offset + FRAME_HEADER) < stored), "block data truncated")
    good = lambda c: F.when(error.isNull() & data.isNotNull(), c)
    codec = F.element_at(F.array(*map(F.lit, ALGORITHMS)), F.least(F.conv(F.hex(at(18, 1)), 16, 10).cast("int"), F.lit(len(ALGORITHMS) - 1)) + 1)
    body = F.substring(data, F.lit(offset + FRAME_HEADER + 1), stored.cast("int"))
    return F.struct(error.alias("error"), good(stored).alias("stored_size"), good(from_little_endian(data, offset + 10)).alias("original_size"), good(codec).alias("algorithm"), good(at(20, 1) != F.lit(b"\0")).alias("encrypted"), good(body).alias("block"))


def is_frame(data: Column) -> Column:
    """Whether bytes begin like a frame."""
    return F.coalesce((F.octet_length(data) >= FRAME_HEADER) & (F.substring(data, 1, 2) == F.lit(SYNC)), F.lit(False))


class BlockStore:
    """Blocks (block_id, data) in a shared folder, by generation and by block_id mod 256; the newest generation of a block counts.

    A write or delete is one more generation, so a job that fails half-way leaves no trace but a folder that the next
    one of its number replaces. `net_growth` says whether the capacity is held against the growth of the stored bytes or against all bytes of a write
    with a header for each block. Ids must not repeat within a write. A compaction rewrites what is left as one generation.
    """

    SCHEMA = "block_id long, data binary, crc32 long, deleted boolean, generation long, bucket int"

    def __init__(self, spark: SparkSession, folder: str, capacity: int = 1 << 62, net_growth: bool = True) -> None:
        self.spark, self.folder, self.capacity, self.net_growth, self.generation = spark, folder.rstrip("/"), capacity, net_growth, 0

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder) if self.generation else self.spark.createDataFrame([], self.SCHEMA)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row per block: all generations of a block lie in one bucket."""
        return rows.groupBy("bucket", "block_id").agg(F.max_by(F.struct("data", "crc32", "deleted"), "generation").alias("r")).where("not r.deleted").select("bucket", "block_id", "r.data", "r.crc32")

    def _append(self, rows: DataFrame) -> None:
        placed = rows.withColumns({"generation": F.lit(self.generation + 1).cast("long"), "bucket": F.pmod("block_id", F.lit(BUCKETS)).cast("int")})
        placed.select("block_id", "data", "crc32", "deleted", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/generation={self.generation + 1}")
        self.generation += 1

    def write(self, blocks: DataFrame) -> str | None:
        """Store blocks, replacing those of their ids; an error, and nothing stored, if the capacity doesn't do."""
        rows = blocks.select(F.col("block_id").cast("long").alias("block_id"), F.coalesce(F.col("data"), F.lit(b"")).alias("data"))
        new, n = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)), F.count("*")).first()
        used = self.statistics().first()["bytes"]
        if self.net_growth:
            gone = self._newest(self._all()).join(rows.select("block_id"), "block_id", "left_semi").agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
            grown = new - gone
        else:
            grown = new + n * DISK_HEADER
        if used + grown > self.capacity:
            return CAPACITY_EXCEEDED
        self._append(rows.withColumns({"crc32": F.crc32("data"), "deleted": F.lit(False)}))
        return None

    def delete(self, ids: DataFrame) -> None:
        """Remove blocks by block_id; unknown ones are ignored."""
        self._append(ids.select(F.col("block_id").cast("long").alias("block_id"), F.lit(None).cast("binary").alias("data"), F.lit(0).cast("long").alias("crc32"), F.lit(True).alias("deleted")))

    def read(self, ids: DataFrame) -> DataFrame:
        """(block_id, data, error) of wanted ids: checked data, or NotFound or ChecksumMismatch with null data."""
        found = self._newest(self._all().join(ids.select("block_id").distinct(), "block_id", "left_semi"))
        error = F.when(F.col("data").isNull(), NOT_FOUND).when(F.crc32("data") != F.col("crc32"), CHECKSUM_MISMATCH)
        rows = ids.select("block_id").join(found.drop("bucket"), "block_id", "left")
        return rows.select("block_id", F.when(error.isNull(), F.col("data")).alias("data"), error.alias("error"))

    def read_one(self, block_id: int) -> DataFrame:
        """The block of one id, read from its bucket alone."""
        return self._newest(self._all().where((F.col("bucket") == block_id % BUCKETS) & (F.col("block_id") == block_id))).select("block_id", "data")

    def statistics(self) -> DataFrame:
        """One row: blocks and bytes."""
        return self._newest(self._all()).agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"))
