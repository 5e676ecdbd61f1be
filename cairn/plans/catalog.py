"""All queries over the engine's own operators, with the same queries in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import codecs, paths, text
from cairn.operators import blocks, chunks, journals, metadata, metrics, search, snapshots, tree
from cairn.plans import catalog_sql
from cairn.plans.inputs import spread
from cairn.plans.ordered import running
from cairn.session import shared_folder, ship
from cairn.sources import tables as T
from cairn.sources.tables import load

QUERY = "the theaea and onlyhe this atshsh"
GLOB = "*.example.???/en/*"
KEY = bytes(range(32))

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _queries[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load(spark, sf, "documents").select("doc_id", "text"))


def _contents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(T.document_entries(spark, sf).select("entry_id", "content"))


# search


@query
def tokenize_stats(spark, sf):
    t = _docs(spark, sf).select("doc_id", text.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query
def tokenize_offsets(spark, sf):
    return search.token_offsets(_docs(spark, sf)).select("doc_id", "term", F.col("position").cast("long").alias("position"), F.col("byte_offset").cast("long").alias("byte_offset"), F.col("byte_length").cast("long").alias("byte_length"))


@query
def term_frequencies(spark, sf):
    return search.term_frequencies(_docs(spark, sf))


@query
def document_frequency(spark, sf):
    return search.document_frequency(_docs(spark, sf))


@query
def postings(spark, sf):
    return search.postings(_docs(spark, sf)).select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions"))


@query
def posting_deltas(spark, sf):
    coded = search.delta_postings(search.postings(_docs(spark, sf)))
    back = search.undelta_postings(coded.withColumnRenamed("positions", "original"))
    return back.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum(F.expr("aggregate(deltas, 0, (a, x) -> a + x)")).cast("long").alias("last_positions"), F.sum(F.expr("aggregate(positions, 0L, (a, x) -> a + x)")).alias("all_positions"))


@query
def corpus_stats(spark, sf):
    return search.corpus_stats(_docs(spark, sf))


_indexes: dict[tuple[str, str], search.Index] = {}


def _index(spark: SparkSession, sf: str) -> search.Index:
    """The stored index of the documents, written once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = search.write_index(_docs(spark, sf), shared_folder(spark, "index"))
    return _indexes[key]


@query
def bm25_search(spark, sf):
    return search.search_index(spark, _index(spark, sf), QUERY)


@query
def bm25_all_terms(spark, sf):
    return search.search_index(spark, _index(spark, sf), "theaea onlyhe", require_all=True, limit=None)


@query
def bm25_min_score(spark, sf):
    return search.search_index(spark, _index(spark, sf), QUERY, min_score=2.5, limit=None)


@query
def bm25_scan(spark, sf):
    """The search without an index, with other parameters of the score."""
    return search.search(_docs(spark, sf), QUERY, limit=20, k1=2.0, b=0.5)


@query
def tokenize_by_white_space(spark, sf):
    """Terms where punctuation is kept and a word is left out beside the usual ones."""
    rules = replace(text.DEFAULT, remove_punctuation=False).with_word("THEAEA")
    return search.document_frequency(_docs(spark, sf), rules=rules)


@query
def remove_and_reindex(spark, sf):
    """Index without French and English documents, then with the German ones put in again in capitals."""
    d = load(spark, sf, "documents")
    index = search.remove_documents(search.postings(d.where("lang <> 'fr'").select("doc_id", "text")), d.where("lang = 'en'"))
    again = search.reindex(index, d.where("lang = 'de'").select("doc_id", F.translate("text", text.LOWER, text.UPPER).alias("text")))
    return again.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))


# lookups and trees


@query
def find_by_id(spark, sf):
    return tree.find_id(T.page_entries(spark, sf), 42)


@query
def find_by_path(spark, sf):
    return tree.find_path(T.document_entries(spark, sf), "//en/./src7/7/..").select("entry_id", "path")


@query
def find_by_prefix(spark, sf):
    return tree.find_prefix(T.page_entries(spark, sf), "/blog.").select("entry_id", "path")


@query
def find_by_type(spark, sf):
    return tree.find_type(T.page_entries(spark, sf), "Directory").select("entry_id", "path", "type")


@query
def glob_match(spark, sf):
    return tree.find_glob(T.page_entries(spark, sf), GLOB).select("entry_id", "path")


@query
def existing_paths(spark, sf):
    wanted = load(spark, sf, "labels").join(load(spark, sf, "documents"), "doc_id").select("doc_id", F.concat(F.lit("/en/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return tree.existing(T.document_entries(spark, sf), wanted).select("doc_id", "path")


@query
def normalize_paths(spark, sf):
    p = T.page_entries(spark, sf)
    messy = F.concat(F.lit("/./"), F.regexp_replace("path", "/", "//"), F.lit("/../"))
    return p.select("entry_id", paths.normalize(messy).alias("normalized"), paths.depth(messy).alias("depth"), paths.parent(F.col("path")).alias("parent"), paths.file_name("path").alias("name"))


@query
def path_depth_histogram(spark, sf):
    return T.page_entries(spark, sf).groupBy(paths.depth("path").alias("depth")).agg(F.count("*").alias("entries"))


@query
def list_directory(spark, sf):
    return tree.list_directory(T.document_entries(spark, sf), "/en/src7")


@query
def tree_nodes(spark, sf):
    return tree.nodes(T.page_entries(spark, sf))


@query
def directory_rollup(spark, sf):
    return tree.directory_rollup(T.document_entries(spark, sf))


@query
def tree_preorder(spark, sf):
    return tree.preorder(T.page_entries(spark, sf))


@query
def remove_subtree(spark, sf):
    return tree.remove_subtree(T.document_entries(spark, sf), "/en/src1").groupBy(paths.parent(F.col("path")).alias("dir")).agg(F.count("*").alias("entries"))


@query
def upsert_entries(spark, sf):
    e = T.document_entries(spark, sf).select("entry_id", "path", "original_size")
    newer = e.where("entry_id % 4 = 0").select("entry_id", F.concat("path", F.lit(".v2")).alias("path"), (F.col("original_size") * 2).alias("original_size")).unionByName(e.where("entry_id % 50 = 1").select((-F.col("entry_id")).alias("entry_id"), "path", "original_size"))
    return tree.upsert(e, newer)


@query
def validate_catalogue(spark, sf):
    return tree.validate(T.document_entries(spark, sf))


@query
def ordered_range_scan(spark, sf):
    return load(spark, sf, "orders").where((F.col("o_orderkey") >= 100) & (F.col("o_orderkey") < 400)).select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey")


@query
def unix_modes(spark, sf):
    mode = (F.col("l_partkey") % 512).cast("int")
    flags = (F.col("l_linenumber") + F.col("l_suppkey") % 16).cast("int")
    bits = paths.from_unix_mode(mode)
    return load(spark, sf, "lineitem").groupBy(mode.alias("mode"), paths.to_unix_mode(bits).alias("back"), bits["owner_read"].alias("owner_read"), bits["other_write"].alias("other_write"), paths.has_flag(flags, 5).alias("flagged")).agg(F.count("*").alias("n"))


@query
def find_block(spark, sf):
    blocks = metrics.layout(T.document_entries(spark, sf)).select(F.col("entry_id").alias("block_id"), "offset", F.col("original_size").alias("size"))
    probes = load(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 137).alias("at"))
    return metrics.find_blocks(blocks, probes).select("o_orderkey", "at", "block_id", (F.col("at") - F.col("offset")).alias("within"))


@query
def read_spans(spark, sf):
    e = T.document_entries(spark, sf)
    span = chunks.read_span(F.col("content"), 100, 64)
    return e.select("entry_id", F.lower(F.hex(span)).alias("span"), F.when(span.isNull(), "InvalidOffset").alias("error"))


# chunks and integrity


@query
def fixed_chunks(spark, sf):
    return chunks.fixed_chunks(T.document_entries(spark, sf), 1024)


@query
def chunk_dedup_ratio(spark, sf):
    return chunks.dedup_summary(chunks.fixed_chunks(T.document_entries(spark, sf), 256))


@query
def unique_chunks(spark, sf):
    return chunks.unique_chunks(chunks.fixed_chunks(T.document_entries(spark, sf), 1024))


@query
def missing_chunks(spark, sf):
    """Chunks of the benchmark that the documents don't hold."""
    b = load(spark, sf, "benchmark").select(F.col("item_id").alias("entry_id"), F.col("text").alias("content"))
    return chunks.missing_chunks(chunks.fixed_chunks(b, 64), chunks.fixed_chunks(T.document_entries(spark, sf), 64)).select("sha256", "entry_id", "ordinal")


@query
def register_chunks(spark, sf):
    """Chunks of the benchmark as a store that those of the documents are put in."""
    e = T.document_entries(spark, sf)
    b = load(spark, sf, "benchmark").select(F.col("item_id").alias("entry_id"), F.col("text").alias("content"))
    one = chunks.unique_chunks(chunks.fixed_chunks(b, 1024)).select("sha256", "chunk_size")
    two = chunks.unique_chunks(chunks.fixed_chunks(e, 1024)).select("sha256", "chunk_size")
    return chunks.register_chunks(one, two)


@query
def cdc_chunks(spark, sf):
    """Content-defined chunks add up to their entry and keep to their size limits."""
    c = chunks.content_chunks(_contents(spark, sf), 64, 1024, 256)
    w = c.groupBy("entry_id").agg(F.sum("chunk_size").alias("bytes"), F.count("*").alias("n"), F.min("chunk_offset").alias("first"), F.max("chunk_size").alias("most"), (F.max("ordinal") + 1).cast("long").alias("m"))
    return w.select("entry_id", "bytes", (F.col("first") == 0).alias("starts"), (F.col("most") <= 1024).alias("bounded"), (F.col("m") == F.col("n")).alias("dense"))


@query
def cdc_dedup(spark, sf):
    """Every duplicate document adds logical but no stored bytes."""
    return chunks.dedup_summary(chunks.content_chunks(_contents(spark, sf), 64, 1024, 256))


@query
def exact_duplicates(spark, sf):
    return chunks.exact_duplicates(T.document_entries(spark, sf))


@query
def integrity_check(spark, sf):
    """Entries with every ninth content damaged."""
    e = T.document_entries(spark, sf)
    return chunks.integrity(e, F.when(F.col("entry_id") % 9 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))


@query
def crc32_blocks(spark, sf):
    e = T.document_entries(spark, sf)
    return e.select("entry_id", F.crc32(F.col("content").cast("binary")).alias("crc32"))


@query
def hex_digests(spark, sf):
    """Hash of several buffers is that of their concatenation; hex there and back."""
    e = T.document_entries(spark, sf)
    pair = F.sha2(F.concat(F.col("path").cast("binary"), F.col("content").cast("binary")), 256)
    return e.select("entry_id", pair.alias("digest"), (F.unhex(F.hex("path")) == F.col("path").cast("binary")).alias("round_trip"))


# metrics


@query
def byte_entropy(spark, sf):
    return metrics.entropy(_contents(spark, sf))


@query
def entropy_classes(spark, sf):
    return metrics.entropy(_contents(spark, sf)).groupBy("class").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


@query
def entropy_bar(spark, sf):
    e = metrics.entropy(_contents(spark, sf))
    return metrics.entropy_bar(running(e, ["entry_id"], F.lit(1), name="ordinal"), "ordinal", 40)


@query
def fragmentation(spark, sf):
    """Of order lines as blocks, order by order."""
    blocks = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 300).cast("long").alias("offset"), (F.col("l_quantity") * 20).cast("long").alias("size"))
    return metrics.fragmentation(blocks, ["offset", "size"], ["l_orderkey"])


@query
def fragmentation_total(spark, sf):
    """Of documents as blocks that leave a gap after every fourth."""
    placed = running(T.document_entries(spark, sf), ["entry_id"], F.col("original_size") + F.when(F.col("entry_id") % 4 == 0, 512).otherwise(0), name="offset")
    return metrics.fragmentation(placed.select("entry_id", "offset", F.col("original_size").alias("size")), ["entry_id"])


@query
def storage_summary(spark, sf):
    """Dashboard counters of documents stored as unique 1 kB chunks, events as cache accesses."""
    c = chunks.dedup_summary(chunks.fixed_chunks(T.document_entries(spark, sf), 1024))
    hits = load(spark, sf, "events").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "error").alias("misses"))
    both = c.crossJoin(F.broadcast(hits))  # one row each
    return both.select("chunks", "logical_bytes", "stored_bytes", *[x.alias(n) for n, x in metrics.storage_ratios(F.col("logical_bytes"), F.col("stored_bytes")).items()], "hits", "misses", metrics.hit_ratio(F.col("hits"), F.col("misses")).alias("hit_ratio"))


@query
def inspect_archive(spark, sf):
    """Each entry's offset, size, entropy and class."""
    e = metrics.layout(T.document_entries(spark, sf))
    return e.select("entry_id", "path", "offset").join(metrics.entropy(_contents(spark, sf)), "entry_id")


@query
def tier_statistics(spark, sf):
    """Orders as blocks of a hot (open orders) and a cold tier."""
    o = load(spark, sf, "orders")
    return o.groupBy(F.when(F.col("o_orderstatus") == "O", "HotMemory").otherwise("ColdDisk").alias("tier")).agg(F.count("*").alias("blocks"), F.sum(F.floor("o_totalprice")).cast("long").alias("bytes"))


@query
def formatted_sizes(spark, sf):
    size = F.floor(F.pow(F.lit(3.0), F.col("p_partkey") % 27)).cast("long") + 1
    return load(spark, sf, "part").select("p_partkey", size.alias("size"), paths.format_bytes(size).alias("formatted"), paths.progress_bar((F.col("p_size") - 5) / F.lit(40.0), 20).alias("bar"))


@query
def json_report(spark, sf):
    s = T.document_entries(spark, sf).groupBy(paths.parent(paths.parent(F.col("path"))).alias("archive")).agg(F.count("*").alias("entries"), F.sum("original_size").alias("bytes"))
    return s.select(F.to_json(F.struct("archive", "entries", "bytes")).alias("report"))


# snapshots


def _flat(df: DataFrame) -> DataFrame:
    arrays = [c for c, t in df.dtypes if t.startswith("array")]
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in arrays})


@query
def snapshot_delta(spark, sf):
    return _flat(snapshots.delta(*T.snapshot_nodes(spark, sf)).select("path", "action", F.coalesce("old_size", F.lit(-1)).alias("old_size"), F.coalesce("new_size", F.lit(-1)).alias("new_size"), "new_blocks"))


@query
def delta_summary(spark, sf):
    return snapshots.delta_summary(snapshots.delta(*T.snapshot_nodes(spark, sf)))


@query
def reused_blocks(spark, sf):
    return snapshots.reused_blocks(snapshots.delta(*T.snapshot_nodes(spark, sf)))


@query
def apply_patch(spark, sf):
    """Base and delta give the target."""
    base, target = T.snapshot_nodes(spark, sf)
    return _flat(snapshots.apply_patch(base, snapshots.delta(base, target)))


@query
def latest_manifest(spark, sf):
    """Conversations as nodes written turn by turn; the last turn of each is kept."""
    c = load(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("size"), "turn")
    return snapshots.latest(c, "turn").select("path", "size", "turn")


@query
def manifest_stats(spark, sf):
    return snapshots.manifest_stats(T.snapshot_nodes(spark, sf)[1])


# journals


@query
def journal_analyze(spark, sf):
    return journals.analyze(T.journal(spark, sf))


@query
def journal_incomplete(spark, sf):
    return journals.incomplete(T.journal(spark, sf)).select("seq", "type", "entry_id", F.col("depth").cast("long").alias("depth"))


@query
def journal_replay(spark, sf):
    return journals.replay(T.journal(spark, sf)).select("seq", "type", "applied")


@query
def journal_committed_only(spark, sf):
    return journals.replay(T.journal(spark, sf), committed_only=True).where("applied").select("seq", "type", "entry_id")


@query
def replayed_state(spark, sf):
    return journals.replayed_state(T.journal(spark, sf))


@query
def journal_status(spark, sf):
    return journals.last_marker(T.journal(spark, sf))


@query
def journal_invalid_begins(spark, sf):
    return journals.invalid_begins(T.journal(spark, sf))


@query
def journal_positions(spark, sf):
    """Dense positions of a journal whose views are left out."""
    return journals.renumbered(T.journal(spark, sf).where("type <> 'CreateEntry'")).select("seq", "position")


@query
def journal_verify(spark, sf):
    """Checksums, with every 100th entry's data changed after they were made."""
    j = journals.with_checksum(T.journal(spark, sf))
    return journals.verify(j.withColumn("data", F.when(F.col("seq") % 100 == 0, F.lit("changed")).otherwise(F.col("data"))))


@query
def stream_replay(spark, sf):
    """The journal replayed by a stream, each user's events a log of its own."""
    from cairn.streaming import replay

    source = shared_folder(spark, "stream")
    j = T.journal(spark, sf).withColumn("log", F.col("entry_id") % 50)
    j.withColumn("seq", (F.row_number().over(Window.partitionBy("log").orderBy("seq")) - 1).cast("long")).select("log", "seq", "type", "entry_id").repartition(4).write.mode("overwrite").parquet(f"{source}/in")
    stream = replay.replayed(spark.readStream.schema("log long, seq long, type string, entry_id long").parquet(f"{source}/in"))
    replay.upsert_sink(stream, f"{source}/out", f"{source}/state").awaitTermination()
    return spark.read.schema(replay.OUT).parquet(f"{source}/out/batch=*").groupBy("log").agg(F.count("*").alias("applied"), F.max("seq").alias("last_seq"))


@query
def windowed_event_counts(spark, sf):
    from cairn.streaming import replay

    return replay.windowed_counts(load(spark, sf, "events")).groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("events"))


# metadata


def _stores(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    own = F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string"))
    other = F.create_map(F.lit("type"), F.lit("other"), F.lit("k"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("-")))
    return e.select("event_id", own.alias("own"), other.alias("other"))


@query
def metadata_merge(spark, sf):
    s = _stores(spark, sf)
    merged = metadata.merge(F.col("own"), F.col("other"))
    return s.select("event_id", metadata.sorted_entries(merged).alias("merged"), metadata.get(merged, "k").alias("k"), metadata.get(merged, "none").alias("none"), F.size(F.map_keys(merged)).alias("n"))


@query
def metadata_edit(spark, sf):
    s = _stores(spark, sf)
    edited = metadata.without(metadata.put(metadata.put(F.col("own"), "type", F.lit("x")), "", F.lit("e")), "user")
    return s.select("event_id", metadata.sorted_entries(edited).alias("edited"), metadata.valid(edited).alias("valid"), metadata.valid(F.col("own")).alias("own_valid"), F.map_contains_key("own", "user").alias("has_user"))


@query
def tag_operations(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.array("lang", "source", "lang").alias("tags"))
    return d.select("doc_id", F.array_join(metadata.add_tag(F.col("tags"), "en"), ",").alias("added"), F.array_join(metadata.remove_tag(F.col("tags"), "en"), ",").alias("removed"), F.array_contains("tags", "src1").alias("has"))


# codecs


@query
def zigzag_varints(spark, sf):
    v = (F.col("o_orderkey") - 7500) * F.pow(F.lit(10.0), F.col("o_orderkey") % 12).cast("long")
    z = codecs.zigzag(v)
    return load(spark, sf, "orders").select("o_orderkey", v.alias("value"), z.alias("zigzag"), codecs.unzigzag(z).alias("back"), codecs.varint_size(F.abs(v)).alias("bytes"))


@query
def varint_roundtrip(spark, sf):
    """Lists of numbers as varints by the batch codec, and their sum when read again; the first one's bytes by expressions, read by expressions."""
    ship(spark)
    rows = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_partkey") * 1_000_003)).alias("v"))
    raw = codecs.varint_udf("v")
    coded = rows.select("l_orderkey", raw.alias("bytes"), codecs.varint(F.col("v")[0]).alias("one"))
    total = F.aggregate(codecs.unvarint_udf("bytes"), F.lit(0).cast("long"), lambda a, b: a + b)
    head = codecs.unvarint(F.col("bytes"))
    return coded.select("l_orderkey", F.lower(F.hex("bytes")).alias("raw"), F.lower(F.hex("one")).alias("first"), total.alias("total"), head["value"].alias("first_value"), head["size"].alias("first_size"))


@query
def compress_roundtrip(spark, sf):
    ship(spark)
    e = T.document_entries(spark, sf).select("entry_id", F.col("content").cast("binary").alias("c"))
    for a in codecs.ALGORITHMS:
        e = e.withColumn(a, codecs.compress(a)("c"))
    back = [F.sha2(codecs.decompress(a)(a, F.octet_length("c")), 256).alias(a) for a in codecs.ALGORITHMS]
    return e.select("entry_id", *back)


@query
def compress_ratio(spark, sf):
    ship(spark)
    c = T.document_entries(spark, sf).select(F.col("content").cast("binary").alias("c"))
    sizes = c.select(F.octet_length("c").alias("raw"), *[F.octet_length(codecs.compress(a)("c")).alias(a) for a in codecs.ALGORITHMS])
    return sizes.agg(*[F.sum(x).alias(x) for x in ("raw", *codecs.ALGORITHMS)])


@query
def fnv_hashes(spark, sf):
    ship(spark)
    return load(spark, sf, "nation").select("n_nationkey", F.lower(F.hex(codecs.fnv1a64(F.col("n_name").cast("binary")))).alias("fnv1a64"))


@query
def aes_roundtrip(spark, sf):
    e = T.document_entries(spark, sf)
    iv = F.substring(F.unhex(F.sha2(F.col("path").cast("binary"), 256)), F.lit(1), F.lit(12))
    sealed = codecs.encrypt(F.col("content").cast("binary"), KEY, iv)
    rows = e.select("entry_id", sealed.alias("sealed"))
    wrong = codecs.decrypt(F.col("sealed"), bytes(32))
    return rows.select("entry_id", F.sha2(codecs.decrypt(F.col("sealed"), KEY), 256).alias("opened_sha256"), F.octet_length("sealed").cast("long").alias("sealed_size"), F.lower(F.hex(F.substring("sealed", 1, 12))).alias("iv"), F.sha2(wrong, 256).alias("wrong_key_sha256"))


# blocks


@query
def compressed_blocks(spark, sf):
    """Contents in blocks of 512 bytes, each compressed and framed on its own, taken out of their frames, unpacked and joined again."""
    made = blocks.compress_blocks(_contents(spark, sf), "zstd", 512)
    bound = made.groupBy("entry_id").agg(F.count("*").alias("blocks"), F.sum(blocks.size_bound(F.col("original_size"), "zstd")).cast("long").alias("bound"), F.bool_and(F.col("stored_size") <= blocks.size_bound(F.col("original_size"), "zstd")).alias("within"))
    framed = made.withColumn("p", blocks.parse_frame(blocks.frame(F.col("block"), F.col("original_size"), "zstd")))
    back = blocks.decompress_blocks(framed.select("entry_id", "ordinal", F.col("p.original_size").alias("original_size"), "crc32", F.col("p.block").alias("block")), "zstd")
    return back.join(bound, "entry_id").select("entry_id", "blocks", "bound", "within", F.sha2("content", 256).alias("sha256"), "error")


@query
def size_bounds(spark, sf):
    size = F.floor(F.pow(F.lit(3.0), F.col("p_partkey") % 19)).cast("long")
    return load(spark, sf, "part").select("p_partkey", size.alias("size"), *[blocks.size_bound(size, a).cast("long").alias(a) for a in codecs.ALGORITHMS])


@query
def block_frames(spark, sf):
    """Frames of contents: the header, and what parsing gives of frames that are whole, cut short, out of step or missing their header."""
    e = T.document_entries(spark, sf).select("entry_id", F.col("content").cast("binary").alias("c"))
    made = e.select("entry_id", blocks.frame(F.col("c"), F.octet_length("c")).alias("f"))
    i = F.col("entry_id") % 4
    hurt = F.when(i == 1, F.concat(F.lit(b"X"), "f")).when(i == 2, F.substring(F.col("f"), F.lit(1), F.octet_length("f") - 1)).when(i == 3, F.substring("f", 1, 20)).otherwise(F.col("f"))
    return made.select("entry_id", F.lower(F.hex(F.substring("f", 1, blocks.FRAME_HEADER))).alias("header"), blocks.parse_frame(hurt).alias("p"), blocks.is_frame(hurt).alias("is_frame")).select("entry_id", "header", "is_frame", "p.error", "p.original_size", "p.algorithm", F.sha2("p.block", 256).alias("sha256"))


@query
def block_store(spark, sf):
    """Documents stored as blocks, every third replaced, every seventh deleted; then all ids and some unknown ones are read."""
    e = T.document_entries(spark, sf).select(F.col("entry_id").alias("block_id"), F.col("content").cast("binary").alias("data"))
    store = blocks.BlockStore(spark, shared_folder(spark, "blocks"))
    store.write(e)
    store.write(e.where("block_id % 3 = 0").select("block_id", F.concat(F.lit(b"v2:"), "data").alias("data")))
    store.delete(e.where("block_id % 7 = 0"))
    wanted = e.select("block_id").unionByName(e.where("block_id % 50 = 0").select((-F.col("block_id") - 1).alias("block_id")))
    return store.read(wanted).select("block_id", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("sha256"), "error")


# writing of journals and recovery


@query
def journal_payloads(spark, sf):
    """Payloads of entries, and what is read out of them."""
    j = T.journal(spark, sf)
    raw = journals.payload(F.col("type"), F.col("entry_id"), F.col("data"))
    back = j.select("seq", "type", raw.alias("raw")).withColumn("p", journals.parsed_payload(F.col("type"), F.col("raw")))
    return back.select("seq", "type", F.lower(F.hex("raw")).alias("raw"), "p.entry_id", F.col("p.data").cast("string").alias("data"))


@query
def journal_written(spark, sf):
    """Events as requests to a journal writer; every fifth commit asks for an end first."""
    j = T.journal(spark, sf)
    requests = j.select(F.col("seq").alias("request"), F.when((F.col("type") == journals.COMMIT) & (F.col("seq") % 5 == 0), journals.END).otherwise(F.col("type")).alias("type"), "entry_id", "data")
    return journals.written(requests).select("request", "seq", "type", "error")


@query
def journal_recovery(spark, sf):
    """Recovery where every 13th entry can't be applied, by each strategy."""
    fails = F.col("seq") % 13 == 0
    each = [journals.recovered(T.journal(spark, sf), fails, s).select(F.lit(s).alias("strategy"), "*") for s in (journals.AUTOMATIC, journals.BEST_EFFORT, journals.MANUAL)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query
def journal_recovery_errors(spark, sf):
    return journals.recovery_errors(T.journal(spark, sf), F.col("seq") % 13 == 0)


# dashboard


def _dashboard(spark: SparkSession, sf: str) -> DataFrame:
    e = T.document_entries(spark, sf)
    storage = e.agg(F.count("*").alias("entries"), F.sum("original_size").alias("raw")).crossJoin(F.broadcast(chunks.dedup_summary(chunks.fixed_chunks(e, 1024)).select(F.col("stored_bytes").alias("packed"), F.col("unique_chunks").alias("blocks"))))  # one row each
    v = load(spark, sf, "events")
    accesses = v.select(F.when(F.col("event_type") == "view", True).when(F.col("event_type") == "error", False).alias("hit"))
    done = T.journal(spark, sf).select(F.when(F.col("type") == "Commit", True).when(F.col("type") == "Abort", False).alias("committed"))
    return metrics.dashboard(storage, accesses, done, fragmentation_total(spark, sf))


@query
def dashboard_text(spark, sf):
    bar = entropy_bar(spark, sf)
    return _dashboard(spark, sf).crossJoin(F.broadcast(bar)).select(metrics.text_report("documents", F.col("bar")).alias("report"))  # one row each


@query
def dashboard_json(spark, sf):
    d = _dashboard(spark, sf)
    return d.select(metrics.json_report("documents", F.col("entries")).alias("report"))


# snapshots kept in a folder, and small encodings


@query
def snapshot_catalog(spark, sf):
    """Two snapshots, the target of their delta under an id of its own, a refused repeat, a deletion and a checkout."""
    base, target = T.snapshot_nodes(spark, sf)
    c = snapshots.Catalog(spark, shared_folder(spark, "snapshots"))
    one, two = c.create(base, "base"), c.create(target)
    changes = c.delta(one, two)
    c.apply(one, changes, 10)
    c.register(10, base)
    c.apply(two, changes, 11)
    c.checkout(one)
    three = c.create(base, "again")
    c.delete(two)
    c.checkout(10)
    sizes = [snapshots.manifest_stats(c.get(i)).withColumn("snapshot_id", F.lit(i).cast("long")) for i in (one, 10, three)]
    return c.list().join(sizes[0].unionByName(sizes[1]).unionByName(sizes[2]), "snapshot_id")


@query
def scalar_encodings(spark, sf):
    """Slices and joins of bytes, sizes that overflow, times in seconds and nanoseconds, and ids of two halves."""
    e = load(spark, sf, "events")
    raw = F.col("event_type").cast("binary")
    at = F.col("ts").cast("timestamp")
    micros = F.unix_micros(at)
    joined = F.concat(F.substring(raw, 3, 3), F.lit(b"-"), raw)
    size = F.try_multiply(F.col("event_id") * 1_000_000_007, F.lit(9_000_000_000).cast("long"))
    halves = F.struct((F.col("user_id") % 3).alias("high"), F.col("event_id").alias("low"))
    return e.select("event_id", F.lower(F.hex(joined)).alias("joined"), size.alias("size"), F.floor(micros / 1_000_000).cast("long").alias("seconds"), (F.pmod(micros, F.lit(1_000_000)) * 1000).alias("nanos"), (F.timestamp_micros(micros) == at).alias("same"), (halves < F.struct(F.lit(1).cast("long").alias("high"), F.lit(500).cast("long").alias("low"))).alias("before"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(catalog_sql.SQL)
