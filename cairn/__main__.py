"""Command line: create, list, extract, verify and inspect archives with Spark."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.codecs import ALGORITHMS
from cairn.functions.paths import format_bytes
from cairn.operators import metrics
from cairn.plans.ordered import numbered
from cairn.session import session
from cairn.sources import container


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(entry_id, path, content) of files and of folders' files; ids by path order."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    ids = numbered(read.select("path"), "path", "entry_id").withColumn("entry_id", F.col("entry_id") + 1)
    return read.join(ids, "path").select("entry_id", F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="cairn", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    make = sub.add_parser("create", help="pack files into archives, one per partition")
    make.add_argument("-a", "--archive", required=True, help="output folder")
    make.add_argument("-c", "--compression", choices=ALGORITHMS, default="zstd")
    make.add_argument("-p", "--partitions", type=int, default=1)
    make.add_argument("files", nargs="+")
    for name, text in (("list", "entries and their sizes"), ("extract", "write entries' contents below a folder"), ("verify", "recompute every digest"), ("inspect", "entropy and class of every entry")):
        p = sub.add_parser(name, help=text)
        p.add_argument("-a", "--archive", required=True, help="file, folder or glob")
        if name == "extract":
            p.add_argument("-o", "--output", required=True)
    args = parser.parse_args(argv)
    spark = session("cairn-cli", **{"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "create":
        container.write_archives(_files(spark, args.files).repartition(args.partitions, "entry_id"), f"file://{os.path.abspath(args.archive)}", args.compression).show(truncate=False)
        return 0
    rows = container.read_archives(spark, args.archive, content=args.command != "list")
    if args.command == "list":
        rows.select("entry_id", "path", format_bytes(F.col("stored_size")).alias("stored"), "error").orderBy("path").show(1000, truncate=False)
        rows.agg(F.count("*").alias("entries"), F.sum("stored_size").alias("bytes")).show()
    elif args.command == "verify":
        bad = rows.where("not intact").select("archive", "entry_id", "path", "error")
        damaged = bad.count()
        bad.show(1000, truncate=False)
        return int(damaged > 0)
    elif args.command == "inspect":
        entries = rows.where("intact").select("entry_id", "path", "content")
        metrics.entropy(entries).join(entries.select("entry_id", "path"), "entry_id").orderBy("entry_id").show(1000, truncate=False)
    else:
        if not spark.sparkContext.master.startswith("local"):
            parser.error("extract writes to this machine's disk; run it with a local master")
        root = os.path.abspath(args.output)

        def write(part) -> None:
            for r in part:
                target = os.path.normpath(f"{root}/{r.path or r.entry_id}")
                if os.path.commonpath([root, target]) == root:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(target, "wb") as f:
                        f.write(bytes(r.content))

        rows.where("intact").select("entry_id", "path", "content").foreachPartition(write)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
