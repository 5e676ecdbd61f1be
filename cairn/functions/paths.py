"""Path, glob, flag and mode expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column | str) -> Column:
    """Parts of a path without empty ones, `.` and `..` (which is dropped, not resolved)."""
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))


def normalize(path: Column | str) -> Column:
    return F.concat(F.lit("/"), F.array_join(components(path), "/"))


def depth(path: Column | str) -> Column:
    return F.size(components(path))


def parent(path: Column) -> Column:
    """The text before the last slash; `/` for the root, a path without slashes, or one whose only slash is its first character."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), F.lit("")), F.lit("/"))


def file_name(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def glob_pattern(glob: str) -> str:
    """A LIKE pattern for a glob: `*` is any run, also of slashes, `?` one character; all else stands for itself."""
    escaped = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return escaped.replace("*", "%").replace("?", "_")


def matches_glob(path: Column | str, glob: str) -> Column:
    return F.col(path).like(glob_pattern(glob)) if isinstance(path, str) else path.like(glob_pattern(glob))


def has_flag(flags: Column, test: int) -> Column:
    """True when any of the tested bits is set."""
    return flags.bitwiseAND(test) != 0


#: The nine permission bits, highest first.
PERMISSIONS = ("owner_read", "owner_write", "owner_execute", "group_read", "group_write", "group_execute", "other_read", "other_write", "other_execute")


def from_unix_mode(mode: Column) -> dict[str, Column]:
    return {name: mode.bitwiseAND(1 << (8 - i)) != 0 for i, name in enumerate(PERMISSIONS)}


def to_unix_mode(bits: dict[str, Column]) -> Column:
    total = F.lit(0)
    for i, name in enumerate(PERMISSIONS):
        total = total + F.when(bits[name], 1 << (8 - i)).otherwise(0)
    return total


def format_bytes(size: Column) -> Column:
    """1024-step units from B to TB; two decimals from KB on."""
    out = F.format_string("%.2f TB", size / 1024.0**4)
    for i, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(size < 1024 ** (i + 1), F.format_string(f"%.2f {unit}", size / 1024.0**i)).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


def progress_bar(fraction: Column, width: int) -> Column:
    """`[===---] 50.0%`, the fraction limited to 0 .. 1."""
    f = F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0))
    filled = F.floor(f * width + 0.5).cast("int")
    return F.concat(F.lit("["), F.expr("''") if width == 0 else F.rpad(F.repeat(F.lit("="), filled), width, "-"), F.lit("] "), F.format_string("%.1f%%", f * 100))
