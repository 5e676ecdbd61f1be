"""Exact Jaccard join of documents on word shingles, as a blocked sparse matrix product.

Documents are rows and shingles columns of an incidence matrix; the product of the matrix
with its transpose holds the overlaps. It is never formed whole:

* equal rows are one row (a class) from the start;
* a row keeps only its first columns in a fixed order (very frequent shingles last, else by
  hash). For a Jaccard similarity of 3/4, rows with n shingles must meet, if at all, in
  the first n - ceil(3n/4) + 1 columns of the larger and n - ceil(6n/7) + 1 of the smaller;
* the symbolic phase: products of blocks of columns, of those first columns alone, give the places of the product that can reach the
  bound, and pairs whose sizes rule a link out are discarded; very frequent columns, of any number, are cut into blocks of rows,
  multiplied block by block, and leave out pairs that are already connected;
* a parity sketch of each row bounds the overlap of a pair from above and discards most of the rest;
* the numeric phase: at the places left the overlaps are accumulated over blocks of columns of the whole
  incidence matrix, and after each block pairs are discarded that can no longer reach the bound of their sizes. The count that
  is left at the end is the overlap, and decides.

Links are joined to components with the least id of each as its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import stored, tidy
from cairn.llm.components import components

SHINGLE_WORDS = 5
#: Shingles that are found at least so often by tasks count as very frequent and come last.
HOT_COUNT = 32
#: Very frequent shingles that the order of columns tells apart, the most frequent ones (4 MB broadcast). Columns beyond them that have many rows all the same are found
#: where they are multiplied and cut into blocks like these, so this bounds what is broadcast and nothing else.
HOT_SHINGLES = 500_000
#: Rows of one block of a very frequent column, and of a component in it that has blocks of its own.
BLOCK_ROWS = 512
#: Blocks of columns that overlaps are accumulated over, a power of two, and shingles of pairs that are taken at once.
COLUMN_BLOCKS, PRODUCT_CELLS = 4, 400_000
#: Ids that may be broadcast to pick out texts (16 MB); beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_U = np.uint64


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, _U)
    for j in range(k):
        out = (out ^ (out >> _U(29))) * _U(0x9E3779B97F4A7C15) + h[j : j + n]
    out ^= out >> _U(32)
    out *= _U(0xD6E8FEB86659FD93)
    out ^= out >> _U(32)
    return np.unique(out)


def linked(overlap, n, m):
    """Jaccard similarity of 3/4 or more."""
    return 100 * overlap >= 75 * (n + m - overlap)


def least_overlap(n, m):
    """The smallest overlap that links sets of n and m."""
    return -(-75 * (n + m) // 175)


def prefixes(s: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """(columns kept, how many of them as the smaller row, which of them are hot)."""
    n = len(s)
    is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(n, bool)
    order = np.concatenate([np.flatnonzero(~is_hot), np.flatnonzero(is_hot)])[: n - -(-3 * n // 4) + 1]
    return s[order], n - -(-6 * n // 7) + 1, is_hot[order]


def sketch(s: np.ndarray) -> bytes:
    """Parity bits: a power of two of them, at least 4 for each shingle; bit h mod L is the parity of the shingles there."""
    bits = max(64, 1 << int(4 * len(s) - 1).bit_length())
    parity = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _folded(raw: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(raw, _U)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(a: bytes, n: int, b: bytes, m: int) -> bool:
    """Whether sketches leave room for a link: their distance can't exceed that of the sets."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum()) <= n + m - 2 * least_overlap(n, m)


def _batch(names: list[str], cols: list, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _signatures(docs: DataFrame) -> DataFrame:
    """Rows (id, n, sig) for documents, and (h, n) with a null sig for shingles that a task met in several different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held or [np.zeros(0, _U)]), return_counts=True)
            u, c = u[c > 1].view(np.int64), c[c > 1]
            held.clear()
            return _batch(["id", "n", "sig"], [u, c, [None] * len(u)], [pa.int64(), pa.int64(), pa.binary()])

        for batch in batches:
            n, sig = [], []
            for text in batch.column(1):
                s = shingles(text.as_py())
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if sig[-1] not in seen:
                    seen.add(sig[-1])
                    held.append(s)
                    size += len(s)
                if size > 1_500_000:
                    yield frequent()
                    size = 0
                    seen.clear()
            yield _batch(["id", "n", "sig"], [batch.column(0), n, sig], [pa.int64(), pa.int64(), pa.binary()])
        yield frequent()

    return docs.mapInArrow(tidy(run), "id long, n long, sig binary")


def _postings(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(h, id, n, smaller, weight, first): the columns kept of each row, and the first of them.

    Weight is null but for hot columns, where it says how hot the row is.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        for batch in batches:
            parts: list[tuple] = []
            size = 0
            ids = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1)):
                s = shingles(text.as_py())
                if len(s) > 2:  # smaller sets link with equal ones only
                    kept, short, is_hot = prefixes(s, hot)
                    parts.append((kept, ids[i], len(s), short, is_hot))
                    size += len(kept)
                if parts and (size > 200_000 or i + 1 == len(ids)):
                    lengths = [len(p[0]) for p in parts]
                    h = np.concatenate([p[0] for p in parts]).view(np.int64)
                    is_hot = np.concatenate([p[4] for p in parts])
                    smaller = np.concatenate([np.arange(k) < p[3] for k, p in zip(lengths, parts, strict=True)])
                    weight = np.repeat([int(p[4].sum()) * 1_000_000 // k for k, p in zip(lengths, parts, strict=True)], lengths).astype(np.int32)
                    of = lambda values, kind: np.repeat(np.array(values, kind), lengths)  # noqa: B023, E731
                    first = np.repeat(np.array([p[0][0] for p in parts], _U).view(np.int64), lengths)
                    yield _batch(["h", "id", "n", "smaller", "weight", "first"], [h, of([p[1] for p in parts], np.int64), of([p[2] for p in parts], np.int32), smaller, pa.array(weight, mask=~is_hot), first], [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64()])
                    parts, size = [], 0

    return docs.mapInArrow(tidy(run), "h long, id long, n int, smaller boolean, weight int, first long")


def _column_products(postings: DataFrame) -> DataFrame:
    """Pairs (h null, a smaller than b by size, then id) that meet in a column of few rows and pass the size bound.

    Rows that have the same first column give their pair there and in no other column. Postings of
    very frequent columns pass through, as (h, id, n, smaller, weight), dealt out by salted keys; so do those of other columns of more than
    BLOCK_ROWS rows, so that no task multiplies more than a block.
    """
    most = BLOCK_ROWS
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
    names = ["h", "a", "b", "smaller", "weight"]

    def pairs_of(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.column_stack([np.concatenate(a), np.concatenate(b)]), axis=0)
        none = [None] * len(pairs)
        return _batch(names, [none, pairs[:, 0], pairs[:, 1], none, none], types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            cold = batch.column(4).is_null()
            hot = batch.filter(batch.column(4).is_valid())
            if hot.num_rows:
                yield _batch(names, [hot.column(0), hot.column(1), hot.column(2).cast(pa.int64()), hot.column(3), hot.column(4)], types)
            got.append(batch.filter(cold))
        if not sum(b.num_rows for b in got):
            return
        h, i, n = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in range(3))
        smaller = np.concatenate([b.column(3).to_numpy(zero_copy_only=False) for b in got])
        first = np.concatenate([b.column(5).to_numpy() for b in got])
        del got
        order = np.lexsort((i, n, h))
        h, i, n, smaller, first = h[order], i[order], n[order].astype(np.int64), smaller[order], first[order]
        end = np.searchsorted(h, h, side="right")
        large = end - np.searchsorted(h, h) > most
        for at in np.array_split(np.flatnonzero(large), int(large.sum()) // 100_000 + 1) if large.any() else ():
            yield _batch(names, [h[at], i[at], n[at], smaller[at], np.zeros(len(at), np.int32)], types)
        live = np.flatnonzero(smaller & ~large & (end - np.arange(len(h)) > 1))
        out_a, out_b, size, step = [], [], 0, 1
        while len(live):  # the step-th partner of every row that still has one
            live = live[100 * n[live] >= 75 * n[live + step]]
            here = live[(i[live] != i[live + step]) & ((first[live] != first[live + step]) | (first[live] == h[live]))]
            out_a.append(i[here])
            out_b.append(i[here + step])
            size += len(here)
            if size > 1_000_000:
                yield pairs_of(out_a, out_b)
                out_a, out_b, size = [], [], 0
            step += 1
            live = live[live + step < end[live]]
        if size:
            yield pairs_of(out_a, out_b)

    salt = F.when(F.col("weight").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(256)))
    return postings.withColumn("salt", salt).repartition("h", "salt").select("h", "id", "n", "smaller", "weight", "first").mapInArrow(tidy(run), "h long, a long, b long, smaller boolean, weight int")


def _few(df: DataFrame, bound: int) -> DataFrame:
    """The table, to be broadcast if it has no more rows than the bound."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def _block_products(rows: DataFrame) -> DataFrame:
    """Pairs of rows of very frequent columns that are in different components and pass size and sketch bounds.

    `rows`: (h, id, n, smaller, component, sketch). A column's rows are dealt out to blocks, and
    each pair of its blocks is a task's unit of work. A component with BLOCK_ROWS rows or more in a column has blocks of its own there, which are
    not multiplied with each other; the rest share blocks. Columns that lie in one component are left out.
    """
    parts = stored(rows.groupBy("h", "component").agg(F.count("*").alias("rows")), "ngram-column-parts")
    own = parts.where(F.col("rows") >= BLOCK_ROWS).withColumn("own", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("h").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")  # a row for each BLOCK_ROWS rows at most
    own = own.withColumn("skip", before)
    shared = F.sum(F.when(F.col("rows") < BLOCK_ROWS, F.col("rows")))
    columns = parts.groupBy("h").agg(F.count("*").alias("parts"), F.coalesce(F.ceil(shared / BLOCK_ROWS), F.lit(0)).cast("int").alias("shared")).where("parts > 1").drop("parts")
    columns = stored(columns.join(own.groupBy("h").agg(F.sum("own").cast("int").alias("owned")), "h", "left").select("h", "shared", (F.col("shared") + F.coalesce("owned", F.lit(0))).alias("blocks")), "ngram-columns")
    own = stored(own.select("h", "component", "own", "skip"), "ngram-own-blocks")
    sized = rows.join(_few(columns, HOT_SHINGLES), "h").join(_few(own, HOT_SHINGLES), ["h", "component"], "left")
    spot = F.xxhash64("id")
    block = F.when(F.col("own").isNotNull(), F.col("shared") + F.col("skip") + F.pmod(spot, F.col("own"))).otherwise(F.pmod(spot, F.greatest("shared", F.lit(1)))).cast("int")
    first = F.col("shared") + F.col("skip")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.col("own").isNull() | (j < first) | (j >= first + F.col("own")))
    cells = sized.withColumn("block", block).withColumn("other", F.explode(others))
    cells = cells.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", F.col("n").cast("long").alias("n"), "smaller", "component", "sketch")
    cells = cells.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["h"], row["i"], row["j"])
                if key != at:
                    yield from _cell(at, cell)
                    at, cell = key, []
                cell.append(row)
        yield from _cell(at, cell)

    return cells.mapInArrow(tidy(run), "a long, b long")


def _cell(key: tuple | None, rows: list[dict]) -> Iterator[pa.RecordBatch]:
    if key is None:
        return
    rows.sort(key=lambda r: (r["n"], r["id"]))
    n, ids = np.array([r["n"] for r in rows]), np.array([r["id"] for r in rows])
    part, block = np.array([r["component"] for r in rows]), np.array([r["block"] for r in rows])
    sizes = np.array([len(r["sketch"]) for r in rows])
    folded: dict[int, np.ndarray] = {}
    out_a, out_b = [], []
    for x, r in enumerate(rows):
        if not r["smaller"]:
            continue
        others = np.arange(x + 1, int(np.searchsorted(n, 100 * r["n"] // 75, side="right")))
        others = others[part[others] != r["component"]]
        if key[1] != key[2]:
            others = others[block[others] != r["block"]]
        if not len(others):
            continue
        size = int(sizes[x])  # rows are sorted by size, so the others' sketches are as long or longer
        if size not in folded:
            folded[size] = np.zeros((len(rows), size // 8), _U)
            for y in np.flatnonzero(sizes >= size):
                folded[size][y] = _folded(rows[y]["sketch"], size)
        apart = np.bitwise_count(folded[size][others] ^ folded[size][x]).sum(1)
        near = others[apart <= n[others] + r["n"] - 2 * least_overlap(n[others], r["n"])]
        near = near[ids[near] != r["id"]]
        out_a.append(np.full(len(near), r["id"]))
        out_b.append(ids[near])
    if sum(map(len, out_a)):
        yield _batch(["a", "b"], [np.concatenate(out_a), np.concatenate(out_b)], [pa.int64(), pa.int64()])


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with given ids; ids are broadcast while they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _rows_of(docs: DataFrame) -> DataFrame:
    """(id, n, sketch, whole): what bounds and decides pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingles(t.as_py()) for t in part.column(1)]
                yield _batch(["id", "n", "sketch", "whole"], [part.column(0), [len(s) for s in sets], [sketch(s) for s in sets], [s.tobytes() for s in sets]], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return docs.mapInArrow(tidy(run), "id long, n long, sketch binary, whole binary")


def _beside(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Pairs with n and a column of both of their rows."""
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col(column).alias(f"s_{side}")), side)
    return pairs.select("a", "b", "n_a", "s_a", "n_b", "s_b")


def _filtered(pairs: DataFrame, test) -> DataFrame:
    """Pairs whose (s_a, n_a, s_b, n_b) pass a test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("s_a", "n_a", "s_b", "n_b")]
            keep = pa.array([test(*(v.as_py() for v in row)) for row in zip(*cols, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return pairs.mapInArrow(tidy(run), "a long, b long")


def linked_places(left: list[np.ndarray], right: list[np.ndarray], blocks: int = COLUMN_BLOCKS) -> np.ndarray:
    """For each place (a row of `left`, a row of `right`, both sorted) of the product whether its value links the two.

    The value is accumulated over blocks of columns, ranges of the hash; after each of them places are discarded whose value, with all that
    is left of the smaller rest, stays below the least overlap of their sizes.
    """
    n, m = (np.array([len(s) for s in side], np.int64) for side in (left, right))
    need = least_overlap(n, m)
    edges = (np.arange(1, blocks, dtype=object) * ((1 << 64) // blocks)).astype(_U)
    cuts = [np.array([[0, *np.searchsorted(s, edges), len(s)] for s in side], np.int64).reshape(-1, blocks + 1) for side in (left, right)]
    value = np.zeros(len(left), np.int64)
    live = np.flatnonzero((n > 0) & (m > 0) & (np.minimum(n, m) >= need))
    for k in range(blocks):
        if not len(live):
            break
        parts = [side[p][cut[p, k] : cut[p, k + 1]] for side, cut in zip((left, right), cuts, strict=True) for p in live]
        place = np.repeat(np.concatenate([np.arange(len(live))] * 2), [len(x) for x in parts])
        column = np.concatenate(parts)
        order = np.lexsort((column, place))
        column, place = column[order], place[order]
        both = (column[1:] == column[:-1]) & (place[1:] == place[:-1])
        value[live] += np.bincount(place[1:][both], minlength=len(live))
        rest = np.minimum(n[live] - cuts[0][live, k + 1], m[live] - cuts[1][live, k + 1])
        live = live[value[live] + rest >= need[live]]
    out = np.zeros(len(left), bool)
    out[live] = value[live] >= need[live]
    return out


def _numeric(pairs: DataFrame) -> DataFrame:
    """The (s_a, s_b) pairs that link, by `linked_places` over some pairs at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(batch.schema.get_field_index(c)) for c in ("s_a", "s_b")]
            size = 0
            keep: list[np.ndarray] = []
            left: list[np.ndarray] = []
            right: list[np.ndarray] = []
            for i in range(batch.num_rows):
                for held, column in zip((left, right), rows, strict=True):
                    held.append(np.frombuffer(column[i].as_buffer(), _U))
                    size += len(held[-1])
                if size > PRODUCT_CELLS or i + 1 == batch.num_rows:
                    keep.append(linked_places(left, right))
                    left, right, size = [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(np.concatenate(keep or [np.zeros(0, bool)])))

    return pairs.mapInArrow(tidy(run), "a long, b long")


def _block_links(rows: DataFrame) -> DataFrame:
    """(id, links): how many documents of its component, other than equal ones, each row links with.

    `rows`: (id, whole, component, weight), where weight is the number of documents with this text. A
    component's rows are dealt out to blocks; for each pair of its blocks the overlaps of all pairs of rows are
    accumulated over blocks of columns. Linked rows are always in one component, so no link is missed.
    """
    sized = rows.join(rows.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "component")
    own = sized.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "weight", "whole")
    cells = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell, done = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != at:
                    done.append(_cell_links(at, cell))
                    at, cell = row[:3], []
                cell.append(row[3:])
            yield _batch(["id", "links"], [np.concatenate(x) for x in zip(*done, (np.zeros(0, np.int64),) * 2, strict=True)], [pa.int64(), pa.int64()])
            done = []
        ids, links = _cell_links(at, cell)
        yield _batch(["id", "links"], [ids, links], [pa.int64(), pa.int64()])

    return cells.mapInArrow(tidy(run), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _cell_links(key: tuple | None, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and links of the (block, id, weight, whole) rows of a pair of blocks, counted across the two if they differ."""
    rows.sort(key=lambda r: r[1])
    block, ids, weight = (np.array([r[c] for r in rows], np.int64) for c in range(3))
    if len(rows) < 2:
        return ids[:0], ids[:0]
    sets = [np.frombuffer(r[3], _U) for r in rows]
    n = np.array([len(s) for s in sets])
    near = linked(overlaps(sets), n[:, None], n[None, :])
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])  # rows that repeat an id are one document
    near = np.logical_or.reduceat(np.logical_or.reduceat(near, first, axis=0), first, axis=1)
    block, ids, weight = block[first], ids[first], weight[first]
    np.fill_diagonal(near, False)
    if key[1] != key[2]:
        near &= block[:, None] != block[None, :]
    return ids, near @ weight


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """The overlaps of all pairs of sorted distinct arrays: the product of their incidence matrix with its transpose, summed over blocks of columns."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # other columns are in no overlap
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        low, high = np.searchsorted(column, [start, start + columns])
        part = np.zeros((len(sets), min(columns, int(column[-1]) + 1 - start)), np.float32)  # sums of at most 4096 ones are exact
        part[row[low:high], column[low:high] - start] = 1
        total += (part @ part.T).astype(np.int64)
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of jaccard_components with n_links: the number of other documents that a document links with.

    Equal texts link, and every pair of a component is decided by its exact overlap. A row with a null id is
    no document that others link with; its own n_links is that of its equals' links and all of them, or null
    without equals that have an id. Documents without words link with none. Rows that repeat an id should repeat its text.
    """
    return _joined(df, id_col, text_col, True)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id_col, n_shingles and component_id.

    Documents link when the Jaccard similarity of their sets of distinct five-word shingles
    is 3/4 or more; a component's name is the least id in it. Exact, up to 64-bit hashing.

    Null or empty text, or text without words: no shingles, its own id as component. Fewer than
    five words: the whole sequence is the one shingle. A row with a null id gets the name of
    its equals, or null. Rows that repeat an id count as one document and are each
    returned; equal texts are one class, of any number. An empty table gives an empty
    one. Other columns are ignored. id_col must be an integer column. Intermediate tables go
    to the shared folder.
    """
    return _joined(df, id_col, text_col, False)


def _joined(df: DataFrame, id_col: str, text_col: str, count_links: bool) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = stored(_signatures(docs), "ngram-signatures")
    own = found.where("sig is not null")
    hot_rows = found.where("sig is null").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT)
    hot = np.sort(np.array([r[0] for r in hot_rows.orderBy(F.desc("n"), "id").limit(HOT_SHINGLES).collect()], np.int64).view(_U))
    first = stored(own.groupBy("sig").agg(F.min("id").alias("first")), "ngram-classes")
    members = stored(own.join(first, "sig").select("id", "n", F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id")).alias("first")), "ngram-members")
    copies = members.where("id <> first").select("id").distinct()
    few = copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    classes = docs.where("id is not null").join(F.broadcast(copies) if few else copies, "id", "left_anti")
    postings = _postings(classes, hot)
    found_at = stored(_column_products(postings), "ngram-candidates")
    pairs = found_at.where("h is null").select("a", "b").distinct()
    hot_at = found_at.where("h is not null").select("h", F.col("a").alias("id"), F.col("b").cast("int").alias("n"), "smaller", "weight")
    # the hottest row of a very frequent column stands at its centre: first try a link with it
    centre = hot_at.groupBy("h").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("c")).select("h", (-F.col("c.minus")).alias("b"))
    rays = hot_at.join(_few(centre, HOT_SHINGLES), "h").where("id <> b").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    touched = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(hot_at.select("id")).distinct()
    rows = stored(_rows_of(_picked(classes, stored(touched, "ngram-touched"))), "ngram-rows")
    bounded = stored(_filtered(_beside(pairs.unionByName(rays).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), rows, "sketch"), may_link), "ngram-bounded")
    # a first round decides one pair of each row, a second one what isn't connected by then
    tried = bounded.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stored(_numeric(_beside(tried, rows, "whole")), "ngram-links")
    parts = components(links)
    part_of = lambda pairs, c: pairs.join(parts.select(F.col("id").alias(c), F.col("component").alias(f"p_{c}")), c, "left").withColumn(f"p_{c}", F.coalesce(f"p_{c}", c))
    open_pairs = part_of(part_of(bounded.join(tried, ["a", "b"], "left_anti"), "a"), "b").where("p_a <> p_b").select("a", "b")
    labelled = part_of(hot_at.withColumnRenamed("id", "a"), "a").select("h", F.col("a").alias("id"), "n", "smaller", F.col("p_a").alias("component"))
    across = _block_products(labelled.join(rows.select("id", "sketch"), "id"))
    more = open_pairs.unionByName(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct().join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(stored(_numeric(_beside(more, rows, "whole")), "ngram-links"))
    parts = components(links)
    named = members.join(parts.select(F.col("id").alias("first"), "component"), "first", "left")
    out = [F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "first").cast(df.schema[id_col].dataType).alias("component_id")]
    if not count_links:
        return named.select(*out)
    equals = stored(members.where("id <> first").groupBy("first").agg(F.countDistinct("id").alias("equals")), "ngram-equals")
    weighted = rows.join(parts, "id").join(equals.withColumnRenamed("first", "id"), "id", "left").withColumn("weight", F.coalesce("equals", F.lit(0)) + 1)
    counted = stored(_block_links(weighted.select("id", "whole", "component", "weight")), "ngram-link-counts")
    named = named.join(equals, "first", "left").join(counted.withColumnRenamed("id", "first"), "first", "left")
    n_links = F.coalesce("equals", F.lit(0)) + F.coalesce("links", F.lit(0)) + F.col("id").isNull().cast("long")
    return named.select(*out, F.when(F.col("first").isNotNull(), n_links).alias("n_links"))
