"""Dealing out of inputs, and intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cairn.session import shared_folder


def spread(df: DataFrame) -> DataFrame:
    """Deal out an input that has fewer partitions than the cluster has cores.

    Inputs of many files or row groups are left alone, so at scale this never shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
