"""URL filter: rules first, then a blocked Bloom filter and an exact hash join against a list of canonical URLs.

All steps are built-in expressions and joins. The filter is a table with one row of
four 64-bit words (eight 32-bit lanes) per block; a URL sets or tests one bit in each
lane of one block. Rows that fail the test are certainly not listed and are never
shuffled; the possible hits alone go to the hash join that removes false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Query parameters that don't change a page.
TRACKING = r"^(utm_[a-z_]+|ref|fbclid|gclid)(=|$)"
BITS_PER_URL = 12
#: Filter blocks that may be broadcast (64 bytes each with overhead: 16 MB); beyond it the probe is a shuffled join.
BROADCAST_BLOCKS = 250_000


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))


def split_url(df: DataFrame) -> DataFrame:
    """Add host and path to rows with a `url`; both are empty for null or text without `://`."""
    rest = _after_scheme(F.col("url"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))})


def with_canonical(df: DataFrame) -> DataFrame:
    """Add `canonical` to rows with url, host and path: no scheme, `www.`, default port, fragment,
    trailing slashes or tracking parameters; other parameters sorted. Null without a host."""
    query = F.regexp_extract(_after_scheme(F.col("url")), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    host = F.regexp_replace(F.regexp_replace("host", r":(80|443)$", ""), r"^www\.", "")
    whole = F.concat(host, F.regexp_replace("path", r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return df.withColumn("canonical", F.when(F.col("host") != "", whole))


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Add `rule` and `rule_verdict` of the longest rule that fits (of equals the one with the longer host), else null.

    `rules` is a short list held in the plan, not a table.
    """
    rule = verdict = F.lit(None).cast("string")
    for say, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def _lanes(canonical: str) -> list[Column]:
    """The four words of a URL's bits: one of 32 bits in each half of each word."""
    h = F.xxhash64(F.col(canonical), F.lit("lane"))
    bit = [F.shiftright(h, 5 * i).bitwiseAND(31).cast("int") for i in range(8)]
    one = F.lit(1).cast("long")
    return [_shift(one, bit[2 * j]).bitwiseOR(_shift(one, bit[2 * j + 1] + 32)) for j in range(4)]


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _block(canonical: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(canonical), F.lit(blocks))


def blocked_bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of a table with `canonical`: (block, w0..w3). Partial sums are or-ed before the shuffle."""
    words = listed.where(F.col("canonical").isNotNull()).select(_block("canonical", blocks).alias("block"), *[w.alias(f"w{j}") for j, w in enumerate(_lanes("canonical"))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(4)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, bits_per_url: int = BITS_PER_URL, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """Judge every row of `pages` (any columns, among them `url`): adds host, path, rule, verdict, listed.

    `listed` has a column `canonical` (see `with_canonical`); repeated and null rows in it do no
    harm. A fitting rule decides; otherwise a listed URL is blocked and any other allowed.
    `listed` is null where a rule decided. Columns of `pages` with one of the five names that are added are
    replaced, all others kept, whatever their names. Null urls, and urls without `://`, have empty host and path and are allowed.
    Repeated rows are judged alike; empty tables (either one) and very long urls work.

    The test is a column of one pass; rows that a rule decides or that fail it are returned from there, the possible hits
    alone are shuffled, to one outer join with the list.
    """
    own = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict", "listed"}]
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("url"))
    judged = with_rule(with_canonical(split_url(packed)), rules)
    urls = listed.select("canonical").where(F.col("canonical").isNotNull())
    blocks = max(1, -(-urls.count() * bits_per_url // 256))
    bloom = blocked_bloom(urls, blocks)
    asked = F.when(F.col("rule").isNull(), F.col("canonical"))
    probed = judged.withColumn("canonical", asked).withColumn("block", _block("canonical", blocks)).join(F.broadcast(bloom) if blocks <= broadcast_blocks else bloom, "block", "left")
    tests = [F.col(f"w{j}").bitwiseAND(m) == m for j, m in enumerate(_lanes("canonical"))]
    probed = probed.withColumn("possible", F.coalesce(reduce(Column.__and__, tests), F.lit(False)) & F.col("canonical").isNotNull())
    out = lambda verdict, found: ["row.*", "host", "path", "rule", verdict.alias("verdict"), found.alias("listed")]
    decided = probed.where("not possible").select(*out(F.coalesce("rule_verdict", F.lit("allow")), F.when(F.col("rule").isNull(), False)))
    exact = urls.distinct().withColumn("hit", F.lit(True)).hint("shuffle_hash")
    found = F.coalesce("hit", F.lit(False))
    checked = probed.where("possible").select("row", "host", "path", "rule", "canonical").join(exact, "canonical", "left")
    return decided.unionByName(checked.select(*out(F.when(found, "block").otherwise("allow"), found)))


def enumerated_urls(spark: SparkSession, hosts: tuple[str, ...], languages: tuple[str, ...], numbers: int) -> DataFrame:
    """A list (canonical) by rule, as a block-list feed has it: every page number of every language on each host, plain, as .html and as second page."""
    forms = ("", ".html", "?page=2")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    i = F.col("id")
    of = [F.floor(i / (numbers * len(languages) * len(forms))), F.pmod(F.floor(i / (numbers * len(forms))), F.lit(len(languages))), F.pmod(F.floor(i / len(forms)), F.lit(numbers)), F.pmod(i, F.lit(len(forms)))]
    url = F.concat(pick(hosts, of[0]), F.lit("/"), pick(languages, of[1]), F.lit("/"), of[2].cast("string"), pick(forms, of[3]))
    return spark.range(len(hosts) * len(languages) * numbers * len(forms)).select(url.alias("canonical"))
