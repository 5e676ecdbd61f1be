"""Sharding by histogram sort.

Rows get a 64-bit key and a weight. To cut the key range where shards should end, the
driver keeps one candidate interval for each splitter and refines all of them
together: a round counts, exactly and over all partitions, the weight below each of
up to 1024 probe boundaries inside every interval, and keeps the sub-interval that
holds the target. It stops when every splitter is within tolerance. Then rows move
once, to the ranges between splitters, and are sorted there.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import stored

#: Sums that a round may bring to the driver (or two for each splitter, if that is more).
MOST_SUMS = 1 << 16
#: Ranges that one shard is cut into at most, so that the exchange has many tasks.
RANGES_PER_SHARD = 1024
RANGE_BYTES = 256 << 20


def text_key(text: str, row_id: str) -> Column:
    """A sort key of 40 bits of the text and 24 of the id: spread evenly, equal texts side by side, yet a large group can still be cut."""
    high = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    low = F.xxhash64(F.col(row_id).cast("string"))
    return high.bitwiseAND(~0xFFFFFF).bitwiseOR(low.bitwiseAND(0xFFFFFF))


def _unsigned_prefix(key: str, bits: int) -> Column:
    """The top bits of a key in unsigned order of (key + 2^63), that is in signed order of the key."""
    return F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)


def splitters(keys: DataFrame, targets: list[float], weight: Column, tolerance: float) -> tuple[list[int], int]:
    """Boundaries b (as unsigned 64-bit numbers) such that rows with key < b weigh `targets`, as nearly as `tolerance` asks.

    `keys` has a column `key`. A round brings a bounded number of sums to the driver (MOST_SUMS). Returns the boundaries and the number of rounds. A boundary
    inside rows of one equal key can't be refined and is put at the nearer side of it.
    """
    found: dict[int, int] = {}
    open_at = {0: [(i, t, 0.0) for i, t in enumerate(targets)]}  # prefix -> splitters in it: (number, target, weight below the prefix)
    bits = rounds = 0
    while open_at and bits < 64:
        step = max(1, min(10, 64 - bits, (MOST_SUMS // len(open_at)).bit_length() - 1))
        bits += step
        rounds += 1
        inside = keys
        if rounds > 1:
            active = keys.sparkSession.createDataFrame([(_signed(p),) for p in open_at], "a long")  # bounded by the number of splitters
            inside = keys.join(F.broadcast(active), _unsigned_prefix("key", bits - step) == F.col("a"), "left_semi")
        sums: dict[int, list[tuple[int, float]]] = {}
        for prefix, w in inside.groupBy(_unsigned_prefix("key", bits).alias("p")).agg(F.sum(weight).cast("double").alias("w")).collect():
            prefix &= (1 << 64) - 1
            sums.setdefault(prefix >> step, []).append((prefix, w))
        following: dict[int, list] = {}
        for parent, wanted in open_at.items():
            cells = sorted(sums.get(parent, []))
            for number, target, below in wanted:
                edge, chosen = parent << step, None
                for prefix, w in cells:
                    if below + w > target:
                        chosen = (prefix, w)
                        break
                    below, edge = below + w, prefix + 1
                if chosen is None or target - below <= tolerance:
                    found[number] = min(edge << (64 - bits), 1 << 64)
                elif below + chosen[1] - target <= tolerance or bits == 64:
                    nearer = bits == 64 and target - below <= below + chosen[1] - target
                    found[number] = (chosen[0] + (not nearer)) << (64 - bits)
                else:
                    following.setdefault(chosen[0], []).append((number, target, below))
        open_at = following
    return [found[i] for i in range(len(targets))], rounds


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shard(df: DataFrame, key: Column, size: Column, shards: int = 24, tolerance: float = 0.002, range_bytes: int = RANGE_BYTES, ties: list[str] | None = None) -> DataFrame:
    """Put every row into one of `shards` shards of nearly equal total size.

    Adds `size`, `shard` (0 to shards - 1) and `slot` (0, 1, ... within the shard, in key order);
    columns of that name, and `_key`, are replaced. `key` is a bigint expression without nulls,
    `size` a positive bigint expression. A shard is off its equal share by at most about
    `tolerance` of it, or by the rows of one key, or one row. Ties in the key are slotted in the
    order of the columns `ties`; without them, or where they are equal too, in no particular order. Repeated rows are rows of their own; an empty table gives an empty one.
    """
    ties = ties or []
    own = [c for c in df.columns if c.lower() not in {"size", "shard", "slot", "_key", "_range"}]
    keyed = df.select(*own, key.alias("_key"), size.cast("long").alias("size"))
    keys = stored(keyed.select(F.col("_key").alias("key"), "size"), "shard-keys")
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ideal = total / shards
    cuts, _ = splitters(keys, [ideal * i for i in range(1, shards)], F.col("size"), ideal * tolerance)
    # ranges within shards, even in rows as well as in bytes, only set how the exchange is dealt out
    cores = df.sparkSession.sparkContext.defaultParallelism
    per_shard = max(1, min(RANGES_PER_SHARD, max(-(-total // range_bytes), 8 * cores) // shards))
    mean = max(1.0, total / max(1, rows))
    mixed = F.col("size") / F.lit(mean) + F.lit(1.0)
    pieces = shards * per_shard
    inner, _ = splitters(keys, [2.0 * rows * i / pieces for i in range(1, pieces)], mixed, 2.0 * rows / pieces * 0.1)
    edges = sorted({*cuts, *inner} - {0, 1 << 64})
    in_range = _locate(edges, "_key")
    keys = keys.withColumnRenamed("key", "_key")
    counts = dict(keys.groupBy(in_range.alias("r")).count().collect()) if rows else {}
    starts, at = [], {}
    for r in range(len(edges) + 1):
        low = edges[r - 1] if r else 0
        s = bisect_right(cuts, low)
        starts.append((s, at.get(s, 0)))
        at[s] = at.get(s, 0) + counts.get(r, 0)
    of = lambda i: F.element_at(_longs([x[i] for x in starts]), F.col("_range") + 1)
    moved = keyed.withColumn("_range", in_range)
    moved = moved.repartitionById(max(1, len(starts)), F.col("_range")).sortWithinPartitions("_range", "_key", *ties)
    number = F.row_number().over(_window(ties))
    return moved.select(*own, "size", of(0).cast("int").alias("shard"), (of(1).cast("long") + number - 1).alias("slot"))


def _window(ties: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy("_range").orderBy("_key", *ties)


def _longs(values: list[int]) -> Column:
    """A constant array of longs, parsed once by the optimizer."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def _locate(edges: list[int], key: str) -> Column:
    """The number of edges that are <= the key: a table by the key's top 12 bits, then the few edges that share them."""
    if not edges:
        return F.lit(0)
    base = [bisect_left(edges, p << 52) for p in range(4097)]
    top = _unsigned_prefix(key, 12).cast("int")
    low = F.element_at(_longs(base), top + 1).cast("int")
    high = F.element_at(_longs(base), top + 2).cast("int")
    near = F.slice(_longs([_signed(e ^ (1 << 63)) for e in edges]), low + 1, high - low)
    return low + F.when(high > low, F.size(F.filter(near, lambda e: e <= F.col(key)))).otherwise(0)
