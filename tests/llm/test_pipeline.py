"""The corpus pipeline: each stage on its own input, and the whole."""

import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from cairn.llm import ngram_join, packing, pii
from cairn.llm.common import table, tidy
from tests.comparing import DATA
from tests.llm.test_jaccard import brute


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_stages_keep_columns_and_clean_documents(spark, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    kept = P.drop_toxic(spark, docs, DATA)
    assert kept.columns == list(P.COLUMNS)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept_ids = {r.doc_id for r in kept.collect()}
    assert sum(labels.get(i) == 0 for i in rows if i not in kept_ids) <= 1
    unique = P.drop_near_duplicates(spark, docs, DATA)
    assert unique.columns == list(P.COLUMNS)
    assert {r.doc_id for r in unique.collect()} == {c for _, _, c in brute([(i, r.text) for i, r in rows.items()])}
    masked = {r.doc_id: r for r in P.mask_personal_data(spark, docs, DATA).collect()}
    assert set(masked) == set(rows)
    for i, r in masked.items():
        assert not pii.base_spans(r.text)
        if not pii.base_spans(rows[i].text) and not pii.extra_spans(rows[i].text, []):
            assert r == rows[i]


def test_run_packs_what_is_left(spark, docs):
    left = docs
    for _, stage in P.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, DATA).collect(), docs.schema)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in left.collect()}
    got = {}
    for r in P.run(spark, DATA).collect():
        assert 0 <= r.offset and r.offset + r.length <= 2048 and r.ids_crc32 < 1 << 32
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and zlib.crc32(b"") == 0


def test_odd_documents(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "bob@mail.example.com", "en", "s", 20), (3, "word " * 50_000, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, odd, DATA).count() >= 4
        assert stage(spark, odd.where("false"), DATA).count() == 0
    assert ngram_join.SHINGLE_WORDS == 5


def test_batches_are_bounded_in_bytes(spark):
    """Workers get a few MB at once, also in sessions that others made; a size that the caller chose stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "rows"])

    for own, most in ((None, 6_000_000), ("1m", 1_500_000)):
        other = spark.newSession()
        other.conf.unset(key)
        if own:
            other.conf.set(key, own)
        table(other, DATA, "documents")
        wide = other.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("t"))
        got = wide.mapInArrow(sizes, "bytes long, rows long").collect()
        assert sum(r.rows for r in got) == 6000 and max(r.bytes for r in got) <= most


def test_workers_drop_what_other_operators_kept():
    path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        yield from batches

    first = packing.encoder(path)
    run.__module__ = packing.__name__
    assert list(tidy(run)(iter([1]))) == [1] and packing.encoder(path) is first
    run.__module__ = pii.__name__
    assert list(tidy(run)(iter([1]))) == [1] and not packing._encoders
