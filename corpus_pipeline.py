"""A corpus pipeline in four stages: toxic documents go, one document of each near-duplicate group stays,
personal data is masked, and what is left is packed into training sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import ngram_join, packing, pii, toxicity
from cairn.llm.common import spread, stored, table
from cairn.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL: classifier, span model and tokenizer can't be expressed in it; tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on this corpus's labels, doesn't reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.score_toxicity(spread(docs.select(*COLUMNS)), labels).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 3/4 or more the document of least id; documents without words stay.

    The documents that go are looked for in the texts by an anti-join whose ids are broadcast while they are few.
    """
    docs = docs.select(*COLUMNS)
    parts = ngram_join.jaccard_components(spread(docs.select("doc_id", "text")))
    gone = stored(parts.where("doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    few = gone.limit(ngram_join.BROADCAST_IDS + 1).count() <= ngram_join.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind."""
    found = pii.find_pii(spread(docs.select(*COLUMNS)), redact=True)
    changed = found.withColumns({"text": F.col("redacted"), "n_chars": F.when(F.col("spans") != "", F.length("redacted").cast("long")).otherwise(F.col("n_chars"))})
    return changed.select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(spread(docs.select("doc_id", "text")), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_duplicates), ("pii", mask_personal_data), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    written = reduce(lambda d, stage: stored(stage[1](spark, d, sf_dir), f"pipeline-{stage[0]}"), STAGES[:-1], docs)
    return STAGES[-1][1](spark, written, sf_dir)
