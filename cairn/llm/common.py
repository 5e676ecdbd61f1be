"""Shared helpers of the training-data operators: table loading, scratch folders, input spreading."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.plans.inputs import spread
from cairn.session import shared_folder as scratch
from cairn.session import ship

__all__ = ["give_back", "scratch", "spread", "stored", "table", "tidy", "worker_cache"]

_caches: dict[str, dict] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; only Spark's readers touch the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def worker_cache(module: str) -> dict:
    """What a module keeps in a worker from task to task; dropped when a task of another module begins there."""
    return _caches.setdefault(module, {})


def _drop_others(module: str) -> None:
    for owner, cache in _caches.items():
        if owner != module:
            cache.clear()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Make a worker's function drop what other operators' tasks kept, and give freed memory back to the system when its task ends.

    Workers live on from task to task, and beside the executor's heap there is little room for what
    allocators would keep.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        _drop_others(run.__module__)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
