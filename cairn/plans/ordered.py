"""Running computations over a whole ordered table without one-task windows.

Rows are cut into ranges of the order key (bounds from a quantile sketch, one or two small
actions), as many as keep a range at about RANGE_ROWS rows; what a range hands on to the next is
computed over one row per range and joined back by broadcast, so only rows of one range meet in a
task. A table of a trillion rows has a million ranges, whose handed-on rows take some 20 MB.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.inputs import stored

#: Ranges of small tables; a larger one has a range for every RANGE_ROWS rows.
RANGES = 64
RANGE_ROWS = 1_000_000


def _grid(n: int) -> list[float]:
    return [i / n for i in range(1, n)]


def with_range(df: DataFrame, key: str, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add `_range`, which never decreases with the (numeric) key; rows with one key are in one range, null keys in the first.

    The bounds are searched in two steps, first among every k-th of them, so a row is compared with about
    twice the square root of their number.
    """
    rows, bounds = df.agg(F.count(key), F.percentile_approx(key, _grid(ranges), 10_000)).first()
    wanted = -(-rows // range_rows)
    if wanted > ranges:
        bounds = df.agg(F.percentile_approx(key, _grid(wanted), 20 * wanted)).first()[0]
    distinct = sorted(set(bounds or []))
    if not distinct:
        return df.withColumn("_range", F.lit(0))
    step = isqrt(len(distinct)) + 1
    groups = [distinct[i : i + step] for i in range(0, len(distinct), step)]
    # split and cast of constants are folded once by the optimizer; a literal for each bound would make the plan long
    constant = lambda values: f"cast(split('{','.join(map(str, values))}', ',') as array<{df.schema[key].dataType.simpleString()}>)"
    firsts, inner = F.expr(constant(g[0] for g in groups)), F.expr(f"array({', '.join(map(constant, groups))})")
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.col(key)))
    group = below(firsts)
    at = F.when(group > 0, (group - 1) * step + below(F.element_at(inner, F.greatest(group, F.lit(1))))).otherwise(0)
    return df.withColumn("_range", F.when(F.col(key).isNull(), 0).otherwise(at))


def numbered(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Rows with their position from 0 in the order of a key of any type, which is unique.

    A range sort whose result is written to the shared folder with ids that count within a partition; the starts
    of the partitions are a sum over one row for each, joined back by broadcast. No window reads rows.
    """
    listed = stored(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = listed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = listed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_start")


def running(df: DataFrame, key: list[str], value: Column, ranges: int = RANGES, inclusive: bool = False, name: str = "running") -> DataFrame:
    """Add the sum of `value` over the rows before each row (or up to it), ordered by `key`, which is unique."""
    ranged = with_range(df.withColumn("_value", value), key[0], ranges)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("_value").alias("_total"))
    handed = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    own = Window.partitionBy("_range").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = ranged.join(F.broadcast(handed), "_range").withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(own), F.lit(0)))
    return out.drop("_range", "_value", "_before")


def previous(df: DataFrame, key: list[str], column: str, name: str, ranges: int = RANGES, skip_nulls: bool = False, inclusive: bool = False) -> DataFrame:
    """Add the last value of `column` in the rows before each row (or up to it), ordered by `key`."""
    ranged = with_range(df, key[0], ranges)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    value = F.struct(F.col(column).alias("v"))
    seen = F.when(F.col(column).isNotNull(), value) if skip_nulls else value
    order = F.struct(*key)
    last = F.max_by(seen, order) if not skip_nulls else F.max_by(seen, F.when(F.col(column).isNotNull(), order))
    handed = ranged.groupBy("_range").agg(last.alias("_last")).select("_range", F.last("_last", ignorenulls=True).over(before).alias("_from"))
    own = Window.partitionBy("_range").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = ranged.join(F.broadcast(handed), "_range").withColumn(name, F.coalesce(F.last(seen, ignorenulls=True).over(own), F.col("_from")).getField("v"))
    return out.drop("_range", "_from")


def floored_depth(df: DataFrame, key: list[str], step: Column, name: str = "depth", ranges: int = RANGES) -> DataFrame:
    """Add the running sum of `step` that never falls below 0, after each row."""
    ranged = with_range(df.withColumn("_step", step), key[0], ranges)
    up_to = Window.partitionBy("_range").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_sum", F.sum("_step").over(up_to))
    local = local.withColumn("_low", F.min("_sum").over(up_to))
    ends = local.groupBy("_range").agg(F.max_by("_sum", F.struct(*key)).alias("_s"), F.min("_low").alias("_l"))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("_s0", F.coalesce(F.sum("_s").over(w), F.lit(0)))
    starts = starts.withColumn("_l0", F.coalesce(F.min(F.col("_s0") + F.col("_l")).over(w), F.lit(0))).select("_range", "_s0", "_l0")
    out = local.join(F.broadcast(starts), "_range")
    low = F.least(F.lit(0), "_l0", F.col("_s0") + F.col("_low"))
    return out.withColumn(name, F.col("_s0") + F.col("_sum") - low).drop("_range", "_step", "_sum", "_low", "_s0", "_l0")
