"""Journals: analysis, recovery replay and integrity over (seq, type, entry_id, data, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.codecs import unvarint, varint
from cairn.plans.ordered import floored_depth, previous, running

BEGIN, END, COMMIT, ABORT = "BeginCheckpoint", "EndCheckpoint", "Commit", "Abort"
MARKERS = (BEGIN, END, COMMIT, ABORT)
REPLAY_RATE = 10_000


def incomplete(journal: DataFrame) -> DataFrame:
    """Data entries met while a checkpoint is open: depth rises with Begin and falls, not below 0, with End, Commit and Abort.

    Entries of checkpoints that are committed later are among them.
    """
    step = F.when(F.col("type") == BEGIN, 1).when(F.col("type").isin(END, COMMIT, ABORT), -1).otherwise(0)
    return floored_depth(journal, ["seq"], step).where((F.col("depth") > 0) & ~F.col("type").isin(*MARKERS))


def analyze(journal: DataFrame) -> DataFrame:
    """One row: entries, begins, ends, commits, aborts, replayed (all but Begin and End), skipped, success, estimated_seconds.

    Success: no entries, or as many Begins as Ends and some Commit or Abort. An estimate counts 10,000 entries a second.
    """
    n = lambda *t: F.count_if(F.col("type").isin(*t))
    out = journal.agg(F.count("*").alias("entries"), n(BEGIN).alias("begins"), n(END).alias("ends"), n(COMMIT).alias("commits"), n(ABORT).alias("aborts"), F.count_if(~F.col("type").isin(BEGIN, END)).alias("replayed"))
    out = out.crossJoin(F.broadcast(incomplete(journal).agg(F.count("*").alias("skipped"))))  # one row each
    balanced = (F.col("begins") == F.col("ends")) & (F.col("commits") + F.col("aborts") > 0)
    return out.withColumns({"success": (F.col("entries") == 0) | balanced, "estimated_seconds": F.when(F.col("entries") == 0, 0).otherwise(F.floor(F.col("entries") / REPLAY_RATE) + 1).cast("long")})


def replay(journal: DataFrame, committed_only: bool = False) -> DataFrame:
    """Journal rows with `applied`: data entries after a Begin and before the next End, Commit or Abort.

    An entry counts as applied as soon as its checkpoint is open, even if an Abort follows; with
    `committed_only` the next marker that closes it must be a Commit.
    """
    marked = journal.withColumn("_m", F.when(F.col("type").isin(*MARKERS), F.col("type")))
    out = previous(marked, ["seq"], "_m", "_last", skip_nulls=True, inclusive=True)
    applied = (F.col("_last") == BEGIN) & F.col("_m").isNull()
    if committed_only:
        backward = out.withColumns({"_minus": -F.col("seq"), "_close": F.when(F.col("_m").isin(END, COMMIT, ABORT), F.col("_m"))})
        out = previous(backward, ["_minus"], "_close", "_next", skip_nulls=True).drop("_minus", "_close")
        applied = applied & (F.col("_next") == COMMIT)
    return out.withColumn("applied", F.coalesce(applied, F.lit(False))).drop("_m", "_last", "_next")


def replayed_state(journal: DataFrame, committed_only: bool = False) -> DataFrame:
    """(entry_id, last_seq, operations, last_type): what the applied entries leave of each entry."""
    done = replay(journal, committed_only).where("applied")
    return done.groupBy("entry_id").agg(F.max("seq").alias("last_seq"), F.count("*").alias("operations"), F.max_by("type", "seq").alias("last_type"))


def last_marker(journal: DataFrame) -> DataFrame:
    """One row: the current sequence, the last marker, and whether recovery is needed (a checkpoint is open or was aborted)."""
    out = journal.agg(F.max("seq").alias("current_sequence"), F.max_by("type", F.when(F.col("type").isin(*MARKERS), F.col("seq"))).alias("last_marker"))
    return out.withColumn("needs_recovery", F.coalesce(F.col("last_marker").isin(BEGIN, ABORT), F.lit(False)))


def checksum() -> Column:
    """CRC-32 of type, sequence and data."""
    return F.crc32(F.concat(F.col("type"), F.lit("|"), F.col("seq").cast("string"), F.lit("|"), F.coalesce(F.col("data"), F.lit(""))).cast("binary"))


def with_checksum(journal: DataFrame) -> DataFrame:
    return journal.withColumn("checksum", checksum())


def verify(journal: DataFrame) -> DataFrame:
    """One row: entries and how many fail their checksum."""
    return journal.agg(F.count("*").alias("entries"), F.count_if(~F.col("checksum").eqNullSafe(checksum())).alias("damaged"))


def invalid_begins(journal: DataFrame) -> DataFrame:
    """Begins inside an open checkpoint, which a writer refuses."""
    marked = journal.withColumn("_m", F.when(F.col("type").isin(*MARKERS), F.col("type")))
    return previous(marked, ["seq"], "_m", "_last", skip_nulls=True).where((F.col("type") == BEGIN) & (F.col("_last") == BEGIN)).select("seq")


def renumbered(journal: DataFrame) -> DataFrame:
    """Journal rows with `position` from 0 in sequence order, dense even if sequences aren't."""
    return running(journal, ["seq"], F.lit(1), name="position")


CREATE, UPDATE, DELETE, WRITE_BLOCK = "CreateEntry", "UpdateEntry", "DeleteEntry", "WriteBlock"
#: Bytes of payloads after which a journal takes no more entries.
FULL_BYTES = 64 << 20
AUTOMATIC, BEST_EFFORT, MANUAL = "Automatic", "BestEffort", "Manual"


def payload(kind: Column, entry_id: Column, data: Column) -> Column:
    """An entry's bytes: its id as a varint, then (but for deletes) its data; markers have none, and a written block's are its data."""
    body = F.coalesce(data.cast("binary"), F.lit(b""))
    return F.when(kind == DELETE, varint(entry_id)).when(kind.isin(CREATE, UPDATE), F.concat(varint(entry_id), body)).when(kind == WRITE_BLOCK, body).otherwise(F.lit(b""))


def block_payload(digest: Column, offset: Column, stored_size: Column, original_size: Column) -> Column:
    """What a WriteBlock entry holds: 32 bytes of digest and three varints."""
    return F.concat(digest, varint(offset), varint(stored_size), varint(original_size))


def parsed_payload(kind: Column, raw: Column) -> Column:
    """(entry_id, data) of a payload; null where it is cut short or the kind has none."""
    head = unvarint(raw)
    rest = F.substring(raw, head["size"] + 1, F.octet_length(raw))
    return F.when(kind.isin(CREATE, UPDATE, DELETE) & head.isNotNull(), F.struct(head["value"].alias("entry_id"), F.when(kind != DELETE, rest).alias("data")))


def written(requests: DataFrame, full_bytes: int = FULL_BYTES) -> DataFrame:
    """The journal that a series of requests leaves: (request, seq from 0, type, data, error).

    `requests`: request (its order, unique), type (a journal type), entry_id, data. A Begin while a checkpoint is open and an End
    while none is are refused (InvalidOperation), as are entries once `full_bytes` of payloads were asked for (JournalFull); refused ones have an error
    and no sequence. A Commit while a checkpoint is open writes an EndCheckpoint first.
    """
    raw = payload(F.col("type"), F.col("entry_id"), F.col("data"))
    marked = requests.select("request", "type", raw.alias("data"), F.when(F.col("type").isin(*MARKERS), F.col("type")).alias("_m"))
    state = previous(marked, ["request"], "_m", "_last", skip_nulls=True)
    state = running(state, ["request"], F.octet_length("data").cast("long"), name="_bytes")
    is_open = F.coalesce(F.col("_last") == BEGIN, F.lit(False))
    refused = F.when(((F.col("type") == BEGIN) & is_open) | ((F.col("type") == END) & ~is_open), "InvalidOperation").when(F.col("_m").isNull() & (F.col("_bytes") >= full_bytes), "JournalFull")
    kinds = F.when((F.col("type") == COMMIT) & is_open, F.array(F.lit(END), F.lit(COMMIT))).otherwise(F.array("type"))
    counted = running(state.withColumns({"error": refused, "_kinds": kinds}), ["request"], F.when(F.col("error").isNull(), F.size("_kinds")).otherwise(0).cast("long"), name="_seq")
    out = counted.select("request", "data", "error", "_seq", F.posexplode("_kinds").alias("_k", "type"))
    return out.select("request", F.when(F.col("error").isNull(), F.col("_seq") + F.col("_k")).alias("seq"), "type", "data", "error")


def recovered(journal: DataFrame, fails: Column, strategy: str = AUTOMATIC) -> DataFrame:
    """One row of a recovery: replayed, skipped, corrupt, success, cleared and a summary.

    `fails` says of which entries applying would fail. Applied entries that fail are skipped under BestEffort, else corrupt (their errors are `recovery_errors`). Replayed counts
    all other rows that are no markers, applied or not; skipped begins with those of `incomplete`. Automatic clears the journal.
    """
    if strategy not in (AUTOMATIC, BEST_EFFORT, MANUAL):
        raise ValueError(strategy)
    failed = F.count_if(F.col("applied") & F.coalesce(fails, F.lit(False)))
    out = replay(journal).agg(F.count_if(~F.col("type").isin(*MARKERS)).alias("n"), failed.alias("failed")).crossJoin(F.broadcast(incomplete(journal).agg(F.count("*").alias("open"))))  # one row each
    lenient = F.lit(strategy == BEST_EFFORT)
    out = out.select((F.col("n") - F.col("failed")).alias("replayed"), (F.col("open") + F.when(lenient, F.col("failed")).otherwise(0)).alias("skipped"), F.when(lenient, 0).otherwise(F.col("failed")).cast("long").alias("corrupt"))
    text = F.concat(F.lit("Recovery complete: "), F.col("replayed"), F.lit(" replayed, "), F.col("skipped"), F.lit(" skipped, "), F.col("corrupt"), F.lit(" corrupt"))
    return out.withColumns({"success": F.lit(True), "cleared": F.lit(strategy == AUTOMATIC), "summary": text})


def recovery_errors(journal: DataFrame, fails: Column) -> DataFrame:
    """(seq, type) of the applied entries that fail."""
    return replay(journal).where(F.col("applied") & F.coalesce(fails, F.lit(False))).select("seq", "type")
