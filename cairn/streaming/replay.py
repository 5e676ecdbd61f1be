"""Journal replay as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.journals import ABORT, BEGIN, COMMIT, END
from cairn.session import ship
from cairn.sources.tables import as_journal

#: A journal partition's replay is sequential; `shards` of them (by log id) run side by side.
OUT = "log long, seq long, type string, entry_id long, applied boolean"
STATE = "next_seq long, active boolean, waiting array<struct<seq: bigint, type: string, entry_id: bigint>>"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Replays a log's entries in sequence order; later ones wait in the state until all before them came, repeats are dropped."""
    following, active, waiting = state.get if state.exists else (0, False, [])
    held = {w["seq"] if isinstance(w, dict) else w[0]: tuple(w.values()) if isinstance(w, dict) else tuple(w) for w in waiting}
    for frame in frames:
        for row in frame[["seq", "type", "entry_id"]].itertuples(index=False):
            if row.seq >= following:
                held.setdefault(int(row.seq), (int(row.seq), row.type, int(row.entry_id)))
    out = []
    while following in held:
        seq, kind, entry = held.pop(following)
        if kind == BEGIN:
            active = True
        elif kind in (END, COMMIT, ABORT):
            active = False
        out.append((key[0], seq, kind, entry, active and kind != BEGIN))
        following += 1
    state.update((following, active, [held[k] for k in sorted(held)]))
    yield pd.DataFrame(out, columns=["log", "seq", "type", "entry_id", "applied"])


def replayed(journal: DataFrame) -> DataFrame:
    """A streaming (log, seq, type, entry_id) table with `applied`; `seq` counts from 0 in each log."""
    ship(journal.sparkSession)
    return journal.groupBy("log").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def journal_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events of a folder (or glob) of parquet files, as a stream of journal rows."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return as_journal(reader.parquet(folder))


def upsert_sink(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's applied entries under its batch number, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("applied").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per tumbling window and type, with a watermark; works on streams and tables alike."""
    from pyspark.sql import functions as F

    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
