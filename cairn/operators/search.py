"""Inverted index and ranked search.

All functions take the tokenizer's rules. A null text has no tokens but is a document; rows that
repeat an id are one document with the tokens of all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from cairn.functions import text as T
from cairn.functions.lists import group_lists, running_sums
from cairn.session import ship

#: Folders that an index's postings are dealt out to by a hash of the term; a query reads one for each of its terms.
BUCKETS = 64
#: Tokens that a worker gathers before it hands on an index's blocks, and rows of one Arrow batch that it hands on.
BLOCK_TOKENS, ROWS = 1_000_000, 65_536
#: Repeated ids that are broadcast; beyond, the join is shuffled.
BROADCAST_IDS = 100_000


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: T.Rules = T.DEFAULT) -> DataFrame:
    return T.token_table(docs, id_col, text_col, rules).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: T.Rules = T.DEFAULT) -> DataFrame:
    """(term, df, total_tf)."""
    return term_frequencies(docs, id_col, text_col, rules).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: T.Rules = T.DEFAULT) -> DataFrame:
    """(term, id, tf, positions ascending). One document's positions of one term are gathered, never a term's documents.

    A document's tokens are grouped within its row and nothing is shuffled; only rows that repeat an id, if there are any, meet by term and id.
    """
    once, repeated = _by_repeats(docs.select(id_col, text_col), id_col)
    out = _grouped(once, id_col, text_col, rules)
    return out if repeated is None else out.unionByName(_gathered(repeated, id_col, text_col, rules))


def _by_repeats(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id no other row has, and the others (None if there are none). Counts ids at once; null is an id like others."""
    ids = docs.groupBy(F.col(id_col).alias("_repeated")).agg(F.count("*").alias("_n")).where("_n > 1").select("_repeated")
    n = ids.limit(BROADCAST_IDS + 1).count()
    if n == 0:
        return docs, None
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    same = F.col(id_col).eqNullSafe(F.col("_repeated"))
    return docs.join(ids, same, "left_anti"), docs.join(ids, same, "left_semi")


def _gathered(docs: DataFrame, id_col: str, text_col: str, rules: T.Rules) -> DataFrame:
    """Postings of documents that may take several rows, which are shuffled."""
    return T.token_table(docs, id_col, text_col, rules).groupBy("term", id_col).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, rules: T.Rules) -> DataFrame:
    """Postings of documents of one row each, batch by batch: tokens are numbered by term and put in order by document and term."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, codes, row, at = group_lists(batch.column(1))
            key = row * max(1, len(terms)) + codes
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            ends = np.append(starts[1:], len(order))
            for i in range(0, len(starts), ROWS):
                first, last = starts[i : i + ROWS], ends[i : i + ROWS]
                here = order[first[0] : last[-1]]
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, last[-1]) - first[0], pa.int32()), pa.array(at[here], pa.int32()))
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(codes[order[first]])), batch.column(0).take(pa.array(row[order[first]])), pa.array(last - first, pa.int64()), lists], ["term", id_col, "tf", "positions"])

    return docs.select(id_col, T.tokens(text_col, rules).alias("t")).mapInArrow(run, f"term string, `{id_col}` {kind}, tf long, positions array<int>")


def _block_schema(kind: str) -> str:
    return f"term string, ids array<{kind}>, ends array<int>, dls array<int>, positions array<int>"


def _blocks(docs: DataFrame, id_col: str, text_col: str, rules: T.Rules) -> DataFrame:
    """Blocks of postings (term, ids, ends, dls, positions): a worker's next documents that hold a term, in one row.

    `positions` are those of all the documents one after another, and `ends` says where each document's end.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
        terms, codes, row, at = group_lists(lists)
        lengths = np.bincount(row, minlength=len(ids))
        key = codes * len(ids) + row
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))  # of a document's positions of a term
        if not len(starts):
            return
        ends = np.append(starts[1:], len(order))
        of, doc = np.divmod(key[starts], len(ids))
        heads = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(starts))  # of a term's documents
        counted = ends - np.repeat(starts[heads[:-1]], np.diff(heads))
        for i in range(0, len(heads) - 1, ROWS):
            h = heads[i : i + ROWS + 1]
            lo, hi = h[0], h[-1]
            into = lambda values, cuts: pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), values)
            places = np.append(starts[h[:-1]], ends[hi - 1])
            columns = [terms.take(pa.array(of[h[:-1]])), into(ids.take(pa.array(doc[lo:hi])), h), into(pa.array(counted[lo:hi], pa.int32()), h), into(pa.array(lengths[doc[lo:hi]], pa.int32()), h), into(pa.array(at[order[places[0] : places[-1]]], pa.int32()), places)]
            yield pa.RecordBatch.from_arrays(columns, ["term", "ids", "ends", "dls", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(1).flatten())
            if n >= BLOCK_TOKENS:
                yield from made(held)
                held, n = [], 0
        if held:
            yield from made(held)

    return docs.select(id_col, T.tokens(text_col, rules).alias("t")).mapInArrow(run, _block_schema(kind))


def document_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: T.Rules = T.DEFAULT) -> DataFrame:
    return docs.select(id_col, F.size(T.tokens(text_col, rules)).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: T.Rules = T.DEFAULT) -> DataFrame:
    """One row: total_documents, total_tokens, total_terms, average_length (0 if there are none).

    One pass: a row of a document without a term counts it, and rows of its distinct terms count the vocabulary.
    """
    found = docs.select(T.tokens(text_col, rules).alias("t")).select(F.size("t").cast("long").alias("n"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("t"))).alias("term"))
    terms = found.groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    of_all = lambda c: F.coalesce(F.max(F.when(F.col("term").isNull(), F.col(c))), F.lit(0))
    out = terms.agg(of_all("docs").alias("total_documents"), of_all("tokens").alias("total_tokens"), F.count("term").alias("total_terms"))
    average = F.when(F.col("total_documents") == 0, 0.0).otherwise(F.col("total_tokens") / F.greatest("total_documents", F.lit(1)))
    return out.withColumn("average_length", F.round(average, 6))


def token_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: T.Rules = T.DEFAULT) -> DataFrame:
    """(id, term, position, byte_offset, byte_length) of kept tokens.

    Texts are cut as bytes within their row, in Arrow batches; nothing is shuffled and time grows with the text's length.
    Null ids stay null; repeated rows give repeated results.
    """
    ship(docs.sparkSession)
    word = re.compile(rb"[^\t-\r !-/:-@\[-`{-~]+" if rules.remove_punctuation else rb"[^\t-\r ]+")
    left_out, least, most = frozenset(w.encode() for w in rules.stopwords), rules.least, rules.most
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for i, text in enumerate(batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                found = [(m.start(), t) for m in word.finditer(raw) if least <= len(t := m[0].lower()) <= most and t not in left_out]
                for c, values in zip(cols, ([i] * len(found), [t.decode("utf-8", "replace") for _, t in found], range(len(found)), [s for s, _ in found], [len(t) for _, t in found]), strict=True):
                    c.extend(values)
                if len(cols[0]) > 200_000 or i + 1 == batch.num_rows:
                    types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32())
                    made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(made[0]), *made[1:]], [id_col, "term", "position", "byte_offset", "byte_length"])
                    cols = ([], [], [], [], [])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, term string, position int, byte_offset long, byte_length int")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """A stored index: postings (term, id, tf, positions, dl), in blocks, in folders by a hash of the term, and corpus statistics."""

    folder: str
    id_col: str
    kind: str
    rules: T.Rules
    buckets: int
    documents: int
    average: float

    def blocks(self, spark: SparkSession) -> DataFrame:
        """(bucket, term, ids, ends, dls, positions); see `_blocks`."""
        return spark.read.schema(f"{_block_schema(self.kind)}, bucket int").parquet(f"{self.folder}/postings")

    def _opened(self, blocks: DataFrame, with_positions: bool) -> DataFrame:
        """A row for each posting. Positions that aren't asked for are not read."""
        begin = lambda i: F.when(i == 0, 0).otherwise(F.col("ends")[F.greatest(i - 1, F.lit(0))])
        tf = lambda i: F.col("ends")[i] - begin(i)
        positions = lambda i: [F.slice("positions", begin(i) + 1, tf(i)).alias("positions")] if with_positions else []
        each = lambda d, i: F.struct(d.alias(self.id_col), tf(i).cast("long").alias("tf"), *positions(i), F.col("dls")[i].cast("long").alias("dl"))
        return blocks.select("bucket", "term", F.inline(F.transform("ids", each)))

    def postings(self, spark: SparkSession) -> DataFrame:
        return self._opened(self.blocks(spark), True)

    def of_terms(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """(bucket, term, id, tf, dl) of some terms; only their folders are read, and row groups are skipped by the sorted term."""
        wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"), self.buckets)).distinct().collect()] if terms else []
        return self._opened(self.blocks(spark).where(F.col("bucket").isin(wanted) & F.col("term").isin(terms)), False)


def write_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", rules: T.Rules = T.DEFAULT, buckets: int = BUCKETS) -> Index:
    """Write the postings of all documents to a folder, with the document's length beside each, and sum up the corpus.

    Each worker makes blocks of its documents' postings, so that what is shuffled and sorted is a row for each term of a million tokens. Blocks are dealt out
    by folder and a salt of their first document, so that a term of every document is written by many tasks; ids should be unique.
    """
    spark = docs.sparkSession
    once, repeated = _by_repeats(docs.select(id_col, text_col), id_col)
    made = _blocks(once, id_col, text_col, rules)
    if repeated is not None:
        lengths = document_lengths(repeated, id_col, text_col, rules).groupBy(F.col(id_col).alias("_id")).agg(F.sum("dl").cast("int").alias("dl"))
        each = _gathered(repeated, id_col, text_col, rules).join(lengths, F.col(id_col).eqNullSafe(F.col("_id")))
        made = made.unionByName(each.select("term", F.array(id_col).alias("ids"), F.array(F.col("tf").cast("int")).alias("ends"), F.array("dl").alias("dls"), "positions"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    placed = made.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition("bucket", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(parts)))
    placed.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    n = docs.count()
    index = Index(folder, id_col, docs.schema[id_col].dataType.simpleString(), rules, buckets, n, 0.0)
    tokens = index.blocks(spark).agg(F.sum(F.element_at("ends", -1))).first()[0]
    return replace(index, average=(tokens or 0) / max(n, 1))


def search_index(spark: SparkSession, index: Index, query: str, limit: int | None = 10, min_score: float = 0.0, require_all: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over a stored index: (id, score, matched_terms), best first, ties by id.

    Reads the postings of the query's terms only. How many documents hold a term is one row for each, and the sums by document are partial
    aggregates. Scores are rounded to 6 places before they are compared. A query without terms, or without hits, finds nothing.
    """
    terms = T.query_terms(query, index.rules)
    hits = index.of_terms(spark, terms).select("term", index.id_col, "tf", "dl")
    held = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighed = hits.join(F.broadcast(held), "term")  # one row for each term of the query
    score = T.bm25(F.col("tf"), T.idf(F.lit(index.documents), F.col("df")), F.col("dl"), F.lit(float(index.average)), k1, b)
    of = [F.max(F.when(F.col("term") == t, score)).alias(f"s{i}") for i, t in enumerate(terms)]  # added up in the query's order, so that sums don't depend on the plan
    out = weighed.groupBy(index.id_col).agg(*of, F.count("*").alias("found"))
    total = sum((F.coalesce(f"s{i}", F.lit(0.0)) for i in range(len(terms))), F.lit(0.0))
    matched = F.concat_ws(" ", *[F.when(F.col(f"s{i}").isNotNull(), t) for i, t in enumerate(terms)])
    out = out.select(index.id_col, F.round(total, 6).alias("score"), "found", matched.alias("matched_terms"))
    if require_all:
        out = out.where(F.col("found") == len(terms))
    out = out.where(F.col("score") >= min_score).drop("found")
    return out if limit is None else out.orderBy(F.desc("score"), index.id_col).limit(limit)


def search(docs: DataFrame, query: str, limit: int | None = 10, min_score: float = 0.0, require_all: bool = False, id_col: str = "doc_id", text_col: str = "text", rules: T.Rules = T.DEFAULT, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 without an index: one scan of the texts, for a table that is searched once. Results are those of `search_index`.

    Only the query's terms leave the scan: a row's tokens are filtered to them before anything is
    shuffled, and corpus statistics are one small aggregate.
    """
    terms = T.query_terms(query, rules)
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    rows = docs.select(F.col(id_col), T.tokens(text_col, rules).alias("_t")).select(id_col, F.size("_t").alias("dl"), F.filter("_t", lambda t: F.array_contains(wanted, t)).alias("_t"))
    counts = [F.sum(F.when(F.array_contains("_t", t), 1).otherwise(0)).alias(f"df_{i}") for i, t in enumerate(terms)]
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("average"), *counts)
    hits = rows.where(F.size("_t") > 0).crossJoin(F.broadcast(stats))  # one row
    score, matched = F.lit(0.0), []
    for i, t in enumerate(terms):
        tf = F.size(F.filter("_t", _equals(t)))
        score = score + T.bm25(tf, T.idf(F.col("n"), F.col(f"df_{i}")), F.col("dl"), F.col("average"), k1, b)
        matched.append(F.when(F.array_contains("_t", t), t))
    out = hits.select(id_col, F.round(score, 6).alias("score"), F.array_compact(F.array(*matched)).alias("m") if terms else F.array().cast("array<string>").alias("m"))
    if require_all:
        out = out.where(F.size("m") == len(terms))
    out = out.where(F.col("score") >= min_score).select(id_col, "score", F.array_join("m", " ").alias("matched_terms"))
    return out if limit is None else out.orderBy(F.desc("score"), id_col).limit(limit)


def _equals(term: str):
    return lambda x: x == term


def remove_documents(index: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Postings (or lengths) without the given documents."""
    return index.join(ids.select(id_col), id_col, "left_anti")


def reindex(index: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: T.Rules = T.DEFAULT) -> DataFrame:
    """Postings after (re-)indexing `docs`: their old ones are replaced."""
    return remove_documents(index, docs, id_col).unionByName(postings(docs, id_col, text_col, rules))


@F.arrow_udf(ArrayType(IntegerType()))
def _sums(deltas: pa.Array) -> pa.Array:
    return running_sums(deltas)


def delta_postings(lists: DataFrame) -> DataFrame:
    """Positions as differences from the one before, which is what varints of a posting list hold."""
    return lists.withColumn("deltas", F.transform("positions", lambda x, i: x - F.when(i == 0, 0).otherwise(F.col("positions")[F.greatest(i - 1, F.lit(0))])))


def undelta_postings(lists: DataFrame) -> DataFrame:
    """Positions from differences, by one running sum for each list."""
    ship(lists.sparkSession)
    return lists.withColumn("positions", _sums("deltas"))
