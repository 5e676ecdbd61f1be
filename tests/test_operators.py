"""Vectors for single operators."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import codecs, paths, text
from cairn.operators import blocks, chunks, journals, metadata, metrics, search, snapshots, tree
from cairn.plans import ordered

CORPUS = [(1, "distributed file storage and archive systems"), (2, "embedded database indexing with btree and hashtable"), (3, "high throughput distributed archive indexing database")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string")


def one(df):
    return df.first().asDict()


def test_search_ranks_and_names_terms(corpus):
    rows = search.search(corpus, "distributed archive").collect()
    assert {r.doc_id for r in rows} == {1, 3}
    assert rows[0].matched_terms == "distributed archive"


def test_search_all_terms_and_removal(corpus):
    assert {r.doc_id for r in search.search(corpus, "database indexing", require_all=True).collect()} == {2, 3}
    assert search.search(corpus.where("doc_id <> 2"), "btree").count() == 0
    assert search.search(corpus, "").count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("The quick brown fox jumps over the lazy dog!",), ("don't É x àà",), (None,)], "t string")
    got = [r[0] for r in df.select(text.tokens("t")).collect()]
    assert got[0] == ["quick", "brown", "fox", "jumps", "lazy", "dog"]
    assert got[1] == ["don", "É", "àà"]
    assert got[2] == []
    kept = df.select(text.tokens("t", text.Rules(stopwords=(), remove_punctuation=False))).first()[0]
    assert kept[-1] == "dog!"


def test_token_offsets_are_byte_offsets(spark):
    df = spark.createDataFrame([(1, "éé and Zed, two")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in search.token_offsets(df).collect())
    assert rows == [(1, "two", 2, 14, 3), (1, "zed", 1, 9, 3), (1, "éé", 0, 0, 4)]


def test_idf_and_term_score_are_monotone(spark):
    n = spark.range(1, 6).select(text.idf(F.lit(10), F.col("id")).alias("i"), text.bm25(F.col("id"), F.lit(1.0), F.lit(10), F.lit(10.0)).alias("s"), text.bm25(F.lit(1), F.lit(1.0), F.col("id"), F.lit(3.0)).alias("l")).collect()
    assert all(a.i > b.i for a, b in zip(n, n[1:]) if b.i > 0)
    assert all(a.s < b.s and a.l > b.l for a, b in zip(n, n[1:]))


def test_index_can_be_edited(corpus, spark):
    index = search.postings(corpus)
    row = index.where("term = 'database' AND doc_id = 2").first()
    assert (row.tf, row.positions) == (1, [1])
    again = search.reindex(index, spark.createDataFrame([(2, "btree btree")], "doc_id long, text string"))
    assert again.where("doc_id = 2").first().positions == [0, 1]
    assert search.undelta_postings(search.delta_postings(again).drop("positions")).where("doc_id = 2").first().positions == [0, 1]


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/c.txt",), ("/a.txt",), ("/",), ("a/./../b//",), ("plain",)], "p string")
    rows = [tuple(r) for r in df.select(paths.parent(F.col("p")), paths.file_name("p"), paths.normalize("p"), paths.depth("p")).collect()]
    assert rows == [("/a/b", "c.txt", "/a/b/c.txt", 3), ("/", "a.txt", "/a.txt", 1), ("/", "", "/", 0), ("a/./../b/", "", "/a/b", 2), ("/", "plain", "/plain", 1)]


def test_glob(spark):
    df = spark.createDataFrame([("/a/x_1%.txt",), ("/a/x1.txt",), ("/ab/c",)], "path string")
    find = lambda g: [r.path for r in tree.find_glob(df, g).collect()]
    assert find("/a/x_?%.*") == ["/a/x_1%.txt"]
    assert find("/a*") == ["/a/x_1%.txt", "/a/x1.txt", "/ab/c"]
    assert find("?ab?c") == ["/ab/c"]


def test_tree(spark):
    e = spark.createDataFrame([(1, "/a/file1.txt"), (2, "/a/file2.txt"), (3, "/b/file3.txt"), (4, "/ab")], "entry_id long, path string")
    assert tree.find_prefix(e, "/a").count() == 3
    assert {r.path for r in tree.list_directory(e, "/").collect()} == {"/a", "/b", "/ab"}
    assert tree.remove_subtree(e, "/a").count() == 2
    assert tree.remove_subtree(e, "/").count() == 0
    assert [r.path for r in tree.preorder(e).orderBy("position").collect()] == ["/", "/a", "/a/file1.txt", "/a/file2.txt", "/ab", "/b", "/b/file3.txt"]
    assert one(tree.validate(e.union(e)))["valid"] is False


def test_modes_and_flags(spark):
    df = spark.range(512).select(F.col("id").cast("int").alias("m"))
    assert df.where(paths.to_unix_mode(paths.from_unix_mode(F.col("m"))) != F.col("m")).count() == 0
    assert df.where(paths.has_flag(F.col("m"), 6)).where((F.col("m") % 8) < 2).count() == 0


def test_sizes_and_bars(spark):
    df = spark.createDataFrame([(0, -1.0), (1023, 0.5), (1536, 2.0), (5 << 40, 0.25)], "s long, f double")
    rows = [tuple(r) for r in df.select(paths.format_bytes(F.col("s")), paths.progress_bar(F.col("f"), 4)).collect()]
    assert rows == [("0 B", "[----] 0.0%"), ("1023 B", "[==--] 50.0%"), ("1.50 KB", "[====] 100.0%"), ("5.00 TB", "[=---] 25.0%")]


def test_fixed_chunks_and_dedup(spark):
    e = spark.createDataFrame([(1, b"hello"), (2, b"hello"), (3, b""), (4, b"helloworld!")], "entry_id long, content binary")
    c = chunks.fixed_chunks(e, 5)
    assert [(r.entry_id, r.ordinal, r.chunk_offset, r.chunk_size) for r in c.orderBy("entry_id", "ordinal").collect()] == [(1, 0, 0, 5), (2, 0, 0, 5), (4, 0, 0, 5), (4, 1, 5, 5), (4, 2, 10, 1)]
    assert one(chunks.dedup_summary(c)) == {"chunks": 5, "unique_chunks": 3, "logical_bytes": 21, "stored_bytes": 11, "dedup_ratio": 0.52381}
    assert one(chunks.dedup_summary(c.where("false")))["dedup_ratio"] == 1.0


def plain_cuts(raw, least, most, average, table):
    """The rule, position by position."""

    def roll(window):
        h = 0
        for b in window:
            h = ((h << 1 | h >> 31) & 0xFFFFFFFF) ^ int(table[b])
        return h

    n = len(raw)
    if n <= most:
        return [n] if n else []
    cuts, last = [], 0
    for i in range(least, n):
        if i - last >= most:
            cuts.append(i)
            last = i
        elif i - last >= least:
            w = raw[i - 48 : i] if i >= 48 else raw[: min(48, n)]
            if roll(w) & (average - 1) == 0:
                cuts.append(i)
                last = i
    return cuts + ([n] if last < n else [])


@pytest.mark.parametrize("least,most,average", [(16, 4096, 128), (64, 256, 64), (1, 100, 16), (50, 60, 4)])
def test_content_cuts_follow_the_rule(least, most, average):
    table = chunks.hash_table()
    rng = random.Random(4)
    for raw in (bytes(i & 255 for i in range(10_000)), rng.randbytes(5000), bytes(3000), b"ab" * 700, b"x" * most, b"x" * (most + 1), b""):
        assert chunks.content_cuts(raw, least, most, average, table) == plain_cuts(raw, least, most, average, table)


def test_content_chunks_join_to_the_content(spark):
    e = spark.createDataFrame([(1, bytes(i & 255 for i in range(10_000))), (2, None), (3, b"abc")], "entry_id long, content binary")
    rows = chunks.content_chunks(e, 16, 4096, 128).collect()
    assert len([r for r in rows if r.entry_id == 1]) > 1
    assert sum(r.chunk_size for r in rows if r.entry_id == 1) == 10_000
    assert [r.chunk_size for r in rows if r.entry_id == 3] == [3]


def test_spans(spark):
    df = spark.createDataFrame([(bytes(range(1, 9)),)], "c binary")
    assert bytes(df.select(chunks.read_span(F.col("c"), 2, 4)).first()[0]) == bytes([3, 4, 5, 6])
    assert df.select(chunks.read_span(F.col("c"), 6, 4)).first()[0] is None


def test_entropy(spark):
    e = spark.createDataFrame([(1, bytes(1024)), (2, b"The quick brown fox jumps over the lazy dog, again and again."), (3, bytes((i * 137 + 73) % 256 for i in range(2048))), (4, b"")], "entry_id long, content binary")
    rows = {r.entry_id: r for r in metrics.entropy(e).collect()}
    assert (rows[1].entropy, rows[1]["class"]) == (0.0, metrics.ZERO)
    assert 2 < rows[2].entropy < 5 and rows[2]["class"] == metrics.TEXT
    assert rows[3].entropy > 7.5
    assert (rows[4].entropy, rows[4].size, rows[4]["class"]) == (0.0, 0, metrics.ZERO)


def test_entropy_bar(spark):
    names = [metrics.ZERO, metrics.TEXT, metrics.BINARY, metrics.COMPRESSED, metrics.ENCRYPTED]
    df = spark.createDataFrame(list(enumerate(names)), "ordinal long, class string")
    assert metrics.entropy_bar(df, "ordinal", 5).first().bar == ".TBCE"
    assert metrics.entropy_bar(df, "ordinal", 10).first().bar == "..TTBBCCEE"


def test_fragmentation(spark):
    b = spark.createDataFrame([(0, 1000), (1500, 1000), (3000, 1000)], "offset long, size long")
    assert metrics.fragmentation(b, ["offset"]).first().fragmentation == 0.25
    assert metrics.fragmentation(b.limit(1), ["offset"]).first().fragmentation == 0.0


def test_ratios(spark):
    r = spark.range(1).select(*[c.alias(n) for n, c in metrics.storage_ratios(F.lit(10000), F.lit(2500)).items()], metrics.hit_ratio(F.lit(2), F.lit(1)).alias("h"), metrics.hit_ratio(F.lit(0), F.lit(0)).alias("z")).first()
    assert tuple(r) == (4.0, 75.0, 0.666667, 0.0)


def test_running_sums_by_ranges(spark):
    rng = random.Random(3)
    ids = rng.sample(range(1000), 300)
    df = spark.createDataFrame([(i, rng.randrange(9)) for i in ids], "k long, v long")
    total, want = 0, {}
    for k, v in sorted(map(tuple, df.collect())):
        want[k] = total
        total += v
    assert {r.k: r.running for r in ordered.running(df, ["k"], F.col("v"), ranges=7).collect()} == want
    assert ordered.running(df.where("false"), ["k"], F.col("v")).count() == 0


NODES = "path string, entry_id long, size long, checksum long, block_ids array<bigint>"
V1 = [("unchanged", 1, 100, 0x111, [1]), ("to_modify", 2, 200, 0x222, [2, 3]), ("to_delete", 3, 300, 0x333, [4])]
V2 = [("unchanged", 1, 100, 0x111, [1]), ("to_modify", 2, 250, 0x999, [2, 5]), ("new", 4, 400, 0x444, [6, 7])]


def test_snapshot_delta_and_patch(spark):
    a, b = spark.createDataFrame(V1, NODES), spark.createDataFrame(V2, NODES)
    d = snapshots.delta(a, b)
    assert one(snapshots.delta_summary(d)) == {"added": 1, "modified": 1, "deleted": 1, "added_bytes": 450, "deleted_bytes": 300}
    assert [r.block_id for r in snapshots.reused_blocks(d).collect()] == [2]
    assert d.where("path = 'to_modify'").first().new_blocks == [5]
    assert sorted(map(tuple, snapshots.apply_patch(a, d).collect())) == sorted(map(tuple, b.collect()))
    assert snapshots.delta(a, a).count() == 0


def test_snapshot_catalog(spark, tmp_path):
    c = snapshots.Catalog(spark, f"file://{tmp_path}/snap")
    assert c.current() is None
    a, b = spark.createDataFrame(V1, NODES), spark.createDataFrame(V2, NODES)
    assert (c.create(a, "one"), c.create(b)) == (1, 2)
    assert c.ids() == [1, 2] and c.current() == 2
    assert one(snapshots.delta_summary(c.delta(1, 2)))["added"] == 1
    assert c.delete(2) and not c.delete(2) and c.current() == 1
    assert c.create(b) == 3
    with pytest.raises(KeyError):
        c.get(2)


def plain_journal(rows):
    """(incomplete, applied) as a loop finds them."""
    depth, active, inc, app = 0, False, [], []
    for seq, kind in rows:
        if kind == journals.BEGIN:
            depth, active = depth + 1, True
        elif kind in (journals.END, journals.COMMIT, journals.ABORT):
            depth, active = max(0, depth - 1), False
        else:
            inc += [seq] if depth else []
            app += [seq] if active else []
    return inc, app


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_journal_matches_a_loop(spark, seed):
    rng = random.Random(seed)
    kinds = [*journals.MARKERS, "CreateEntry", "UpdateEntry"]
    rows = [(3 * i + seed, rng.choice(kinds)) for i in range(400)]
    j = spark.createDataFrame([(s, t, s % 7, None) for s, t in rows], "seq long, type string, entry_id long, data string").repartition(3)
    inc, app = plain_journal(rows)
    assert sorted(r.seq for r in journals.incomplete(j).collect()) == inc
    assert sorted(r.seq for r in journals.replay(j).where("applied").collect()) == app
    assert sorted(r.seq for r in journals.replay(j, committed_only=True).where("applied").collect()) == [s for s in app if next((t for q, t in rows if q > s and t in (journals.END, journals.COMMIT, journals.ABORT)), "") == journals.COMMIT]


def test_journal_reports(spark):
    make = lambda *t: spark.createDataFrame([(i, k, 1, "x") for i, k in enumerate(t)], "seq long, type string, entry_id long, data string")
    whole = one(journals.analyze(make(journals.BEGIN, "CreateEntry", journals.END, journals.COMMIT)))
    assert whole["success"] and whole["replayed"] == 2 and whole["estimated_seconds"] == 1
    assert not one(journals.analyze(make(journals.BEGIN, "CreateEntry")))["success"]
    assert one(journals.last_marker(make(journals.BEGIN, "CreateEntry")))["needs_recovery"]
    empty = one(journals.analyze(make(journals.BEGIN).where("false")))
    assert empty["success"] and empty["estimated_seconds"] == 0
    bad = journals.with_checksum(make(journals.BEGIN, "CreateEntry")).withColumn("data", F.when(F.col("seq") == 1, "y").otherwise(F.col("data")))
    assert one(journals.verify(bad)) == {"entries": 2, "damaged": 1}


def test_metadata(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '2') AS m, map('b', '9', 'c', '3') AS o, array('x', 'y', 'x') AS t")
    r = df.select(
        metadata.sorted_entries(metadata.merge(F.col("m"), F.col("o"))), metadata.sorted_entries(metadata.put(F.col("m"), "a", F.lit("z"))), metadata.get(F.col("m"), "q"), metadata.valid(F.col("m")),
        metadata.valid(metadata.put(F.col("m"), "", F.lit(""))), metadata.add_tag(F.col("t"), "x"), metadata.add_tag(F.col("t"), "z"), metadata.remove_tag(F.col("t"), "x"), metadata.remove_tag(F.col("t"), "q"), metadata.sorted_entries(metadata.without(F.col("m"), "a")),
    ).first()
    assert tuple(r) == ("a=1;b=2;c=3", "a=z;b=2", None, True, False, ["x", "y", "x"], ["x", "y", "x", "z"], ["y", "x"], ["x", "y", "x"], "b=2")


def test_varints():
    values = np.array([0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1], np.uint64)
    raw = codecs.encode_varints(values)
    assert raw[:5] == bytes([0, 1, 127, 128, 1])
    assert (codecs.decode_varints(raw) == values).all()
    assert len(codecs.decode_varints(b"")) == 0
    for bad in (b"\x80", b"\x80" * 10 + b"\x01"):
        with pytest.raises(ValueError):
            codecs.decode_varints(bad)


def test_varint_sizes(spark):
    values = [0, 127, 128, 2**14 - 1, 2**14, 2**56, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r[0] for r in df.select(codecs.varint_size(F.col("v"))).collect()] == [len(codecs.encode_varints(np.array([v], np.uint64))) for v in values]


def test_crypto(spark):
    key = codecs.derive_key("password", b"salt", 1000)
    assert key == codecs.derive_key("password", b"salt", 1000) and len(key) == 32 and len(codecs.new_key()) == 32
    df = spark.createDataFrame([(b"hello",), (b"",)], "c binary")
    sealed = df.select("c", codecs.encrypt(F.col("c"), key, F.lit(bytes(12))).alias("s"), codecs.encrypt(F.col("c"), key).alias("r"))
    rows = sealed.select("c", codecs.decrypt(F.col("s"), key).alias("d"), codecs.decrypt(F.col("r"), key).alias("e"), F.octet_length("s").alias("n")).collect()
    assert all(bytes(r.c) == bytes(r.d) == bytes(r.e) and r.n == len(r.c) + 28 for r in rows)


def test_checksums(spark):
    df = spark.createDataFrame([(b"123456789",), (b"",)], "c binary")
    from cairn.session import ship

    ship(spark)
    rows = df.select(F.crc32("c"), F.lower(F.hex(codecs.fnv1a64("c")))).collect()
    assert rows[0][0] == zlib.crc32(b"123456789") == 3421780262
    assert rows[1][1] == "cbf29ce484222325"
    assert math.isclose(1.0, 1.0)


def test_many_ranges(spark):
    rng = random.Random(5)
    keys = rng.sample(range(100_000), 3000)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, v long").repartition(5)
    ranged = ordered.with_range(df, "k", ranges=8, range_rows=20)
    rows = sorted((r.k, r._range) for r in ranged.collect())
    assert [r for _, r in rows] == sorted(r for _, r in rows) and rows[-1][1] > 100
    assert max(Counter(r for _, r in rows).values()) <= 60
    assert [(r.k, r.position) for r in ordered.numbered(df.withColumn("s", F.lpad("k", 6, "0")), "s").orderBy("k").collect()] == [(k, i) for i, k in enumerate(sorted(keys))]
    assert ordered.numbered(df.limit(0), "k").count() == 0


def test_directories_in_any_form(spark):
    e = spark.createDataFrame([(1, "/a/b/c"), (2, "/a/b"), (3, "a//./d/../e"), (4, None), (5, "/ab/x"), (6, "/a")], "entry_id long, path string")
    listed = {(r.path, r.depth, r.is_leaf) for r in tree.list_directory(e, "./a//").collect()}
    assert listed == {("/a/b", 2, False), ("/a/d", 2, False)}
    assert {r.path for r in tree.list_directory(e, "/").collect()} == {"/a", "/ab"}
    assert tree.list_directory(e, "/a/b/c").count() == tree.list_directory(e, "/none").count() == 0
    assert [r.path for r in tree.preorder(e).orderBy("position").collect()] == ["/", "/a", "/a/b", "/a/b/c", "/a/d", "/a/d/e", "/ab", "/ab/x"]


def test_interval_join_of_any_size(spark):
    b = spark.createDataFrame([(1, 0, 1 << 40), (2, 1 << 40, 3), (3, (1 << 40) + 3, 0), (4, (1 << 40) + 3, 70_000), (5, None, 4)], "block_id long, offset long, size long")
    p = spark.createDataFrame([(at,) for at in (0, (1 << 40) - 1, 1 << 40, (1 << 40) + 2, (1 << 40) + 3, (1 << 40) + 70_002, (1 << 40) + 70_003, None, -1)], "at long")
    assert sorted((r.at - (1 << 40), r.block_id) for r in metrics.find_blocks(b, p).collect()) == [(-(1 << 40), 1), (-1, 1), (0, 2), (2, 2), (3, 4), (70_002, 4)]


def test_blocks(spark):
    e = spark.createDataFrame([(1, bytes(range(256)) * 5), (2, b""), (3, None), (4, b"abc")], "entry_id long, content binary")
    for a in codecs.ALGORITHMS:
        made = blocks.compress_blocks(e, a, 100)
        got = {r.entry_id: r for r in blocks.decompress_blocks(made, a).collect()}
        assert bytes(got[1].content) == bytes(range(256)) * 5 and bytes(got[4].content) == b"abc" and set(got) == {1, 4}
        assert made.where(F.col("stored_size") > blocks.size_bound(F.col("original_size"), a)).count() == 0
    hurt = blocks.compress_blocks(e, "zstd", 100).withColumn("block", F.when((F.col("entry_id") == 1) & (F.col("ordinal") >= 3), F.lit(b"xx")).otherwise(F.col("block")))
    assert {r.entry_id: (r.content is None, r.error) for r in blocks.decompress_blocks(hurt, "zstd").collect()} == {1: (True, "DecompressionError at block 3"), 4: (False, None)}
    assert blocks.decompress_blocks(blocks.compress_blocks(e, "lz4", 100).where("ordinal <> 2"), "lz4").where("entry_id = 1").first().error == "MissingBlock"


def test_block_store(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "block_id long, data binary")
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "block_id long")
    s = blocks.BlockStore(spark, f"file://{tmp_path}/net", capacity=100)
    assert s.write(rows((1, b"a" * 60), (257, b"b"))) is None
    assert s.write(rows((2, b"c" * 60))) == blocks.CAPACITY_EXCEEDED
    assert s.write(rows((1, b"d" * 90))) is None  # only the growth counts
    assert tuple(s.statistics().first()) == (2, 91)
    s.delete(ids(1, 5))
    assert {r.block_id: (r.data and bytes(r.data), r.error) for r in s.read(ids(1, 257, 9)).collect()} == {1: (None, "NotFound"), 257: (b"b", None), 9: (None, "NotFound")}
    assert bytes(s.read_one(257).first().data) == b"b"
    gross = blocks.BlockStore(spark, f"file://{tmp_path}/gross", capacity=100, net_growth=False)
    assert gross.write(rows((1, b"a" * 60))) is None
    assert gross.write(rows((1, b"a" * 60))) == blocks.CAPACITY_EXCEEDED


def test_journal_writer(spark):
    J = journals
    ops = [(1, J.END, None, None), (2, J.BEGIN, None, None), (3, J.BEGIN, None, None), (4, J.CREATE, 300, b"xy"), (5, J.DELETE, 7, None), (6, J.COMMIT, None, None), (7, J.COMMIT, None, None), (8, J.UPDATE, 1, b"12345"), (9, J.UPDATE, 1, b"z"), (10, J.ABORT, None, None)]
    out = J.written(spark.createDataFrame(ops, "request long, type string, entry_id long, data binary"), full_bytes=10).orderBy("request", "seq").collect()
    got = [(r.request, r.seq, r.type, bytes(r.data).hex(), r.error) for r in out]
    assert got == [(1, None, J.END, "", "InvalidOperation"), (2, 0, J.BEGIN, "", None), (3, None, J.BEGIN, "", "InvalidOperation"), (4, 1, J.CREATE, "ac027879", None), (5, 2, J.DELETE, "07", None), (6, 3, J.END, "", None), (6, 4, J.COMMIT, "", None), (7, 5, J.COMMIT, "", None), (8, 6, J.UPDATE, "013132333435", None), (9, None, J.UPDATE, "017a", "JournalFull"), (10, 7, J.ABORT, "", None)]
    b = spark.range(1).select(J.block_payload(F.lit(bytes(32)), F.lit(1).cast("long"), F.lit(128).cast("long"), F.lit(-1).cast("long")).alias("b")).first().b
    assert bytes(b) == bytes(32) + b"\x01\x80\x01" + b"\xff" * 9 + b"\x01"
    assert spark.range(1).select(codecs.unvarint(F.lit(b"\x80\x80")).alias("v"), codecs.unvarint(F.lit(b"\xff" * 11)).alias("w"), codecs.unvarint(F.lit(b"\x00\xac\x02"), 1)["value"].alias("x")).first() == (None, None, 300)


def test_snapshot_events(spark, tmp_path):
    c = snapshots.Catalog(spark, f"file://{tmp_path}/events")
    a, b = spark.createDataFrame(V1, NODES), spark.createDataFrame(V2, NODES)
    assert (c.create(a), c.create(b)) == (1, 2)
    d = c.delta(1, 2)
    assert not c.apply(2, d, 5) and c.apply(1, d, 5) and not c.register(5, a) and c.current() == 5
    assert sorted(map(str, c.get(5).collect())) == sorted(map(str, c.get(2).collect()))
    assert c.checkout(1) and not c.checkout(9) and c.create(a, "x") == 6 and c.count() == 4
    assert [(r.snapshot_id, r.parent_id, r.label) for r in c.list().collect()][-2:] == [(5, 1, "reconstructed_snap_5"), (6, 1, "x")]
    assert c.delete(6) and c.current() == 5


def test_stored_index_agrees_with_a_scan(spark, tmp_path, corpus):
    rules = text.Rules(stopwords=("and",), remove_punctuation=False).with_word("Systems")
    index = search.write_index(corpus, f"file://{tmp_path}/index", rules=rules, buckets=4)
    for query in ("distributed archive archive", "and systems", "", "btree nothing database"):
        for options in ({}, {"require_all": True}, {"k1": 2.0, "b": 0.1, "limit": 1}, {"min_score": 0.4, "limit": None}):
            assert sorted(map(tuple, search.search_index(spark, index, query, **options).collect())) == sorted(map(tuple, search.search(corpus, query, rules=rules, **options).collect()))
    assert "and" not in rules.without_word("and").stopwords and rules.stopwords[-1] == "systems"


REPEATED = [(1, "red red blue"), (2, None), (3, "blue Green red blue"), (1, "green red"), (None, "red"), (None, "red blue"), (4, "")]


def by_hand(rows):
    found = {}
    for i, t in rows:
        for at, word in enumerate((t or "").lower().split()):
            found.setdefault((word, i), []).append(at)
    return sorted((t, str(i), len(p), sorted(p)) for (t, i), p in found.items())


def test_postings_are_grouped_within_rows(spark, corpus):
    """Nothing is shuffled where ids are unique (all tokens were); rows that repeat an id still are one document."""
    assert "Exchange" not in search.postings(corpus)._jdf.queryExecution().executedPlan().toString()
    for rows in (REPEATED, REPEATED[:3], REPEATED[1:2], []):
        got = search.postings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.term, str(r.doc_id), r.tf, r.positions) for r in got) == by_hand(rows)


def test_index_holds_blocks_of_postings(spark, tmp_path, monkeypatch):
    """A worker's documents of a term are one row of the index, so that is what is shuffled (it was a row for each posting)."""
    lengths = {"1": 5, "3": 4, "None": 3}
    for k, (rows, size) in enumerate([(REPEATED, search.BLOCK_TOKENS), (REPEATED, 1), (REPEATED[1:2], 1), ([], 1)]):
        monkeypatch.setattr(search, "BLOCK_TOKENS", size)
        index = search.write_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), f"file://{tmp_path}/{k}", buckets=4)
        got = index.postings(spark).collect()
        assert sorted((r.term, str(r.doc_id), r.tf, r.positions) for r in got) == by_hand(rows)
        assert all(r.dl == lengths[str(r.doc_id)] for r in got) and index.documents == len(rows)
        assert search.search_index(spark, index, "red").count() == sum(r.term == "red" for r in got)
    many = spark.createDataFrame([(i, "same words here " + "x" * (i % 9)) for i in range(2000)], "doc_id long, text string").coalesce(1)
    index = search.write_index(many, f"file://{tmp_path}/many", buckets=4)
    assert index.postings(spark).where("term = 'words'").count() == 2000 and index.blocks(spark).where("term = 'words'").count() == 1


def test_running_sums_of_lists(spark):
    import pyarrow as pa

    from cairn.functions.lists import running_sums

    a = pa.array([[9], [1, 2, 3], None, [], [5, -1]], pa.list_(pa.int32()))
    assert running_sums(a).to_pylist() == [[9], [1, 3, 6], None, [], [5, 4]] and running_sums(a[1:4]).to_pylist() == [[1, 3, 6], None, []]


def test_varints_of_a_batch(spark):
    """Lists of a batch are coded all at once (list by list before): slices, nulls and empty lists keep their place."""
    import pyarrow as pa

    lists = pa.array([[7], [300, 0, -1], None, [], [2**63 - 1, 128]], pa.list_(pa.int64()))
    for a in (lists, lists[1:4], lists[2:3], lists[:0]):
        raw = codecs.varint_udf.func(a)
        assert raw.to_pylist() == [None if v is None else codecs.encode_varints(np.array(v, np.int64).view(np.uint64)) for v in a.to_pylist()]
        assert codecs.unvarint_udf.func(raw).to_pylist() == a.to_pylist() and codecs.unvarint_udf.func(raw[1:]).to_pylist() == a.to_pylist()[1:]
    for bad in ([b"\x80", b"\x01"], [b"\x01", b"\xff" * 10 + b"\x01"]):
        with pytest.raises(ValueError):
            codecs.unvarint_udf.func(pa.array(bad))


def test_codecs_work_on_arrow_batches():
    """Blocks stay in Arrow arrays, without pandas objects beside them; what can't be unpacked is null where that is asked for."""
    import pyarrow as pa

    data = pa.array([b"left out", b"abc" * 100, None, b"", b"x"], pa.binary())[1:]
    sizes = pa.array([300, None, 0, 1], pa.int64())
    for a in codecs.ALGORITHMS:
        assert codecs.decompress(a).func(codecs.compress(a).func(data), sizes).to_pylist() == data.to_pylist()
    for a in codecs.ALGORITHMS[1:]:
        hurt = pa.array([b"zz\\x00q", None], pa.binary()), pa.array([5, None], pa.int64())
        assert codecs.decompress(a, strict=False).func(*hurt).to_pylist() == [None, None]
        with pytest.raises(Exception):
            codecs.decompress(a).func(*hurt)
