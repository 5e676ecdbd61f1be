"""Exact top-k inner products with a bit-sliced index.

Candidates are packed into blocks of rows. In a block, every attribute (vector
component) is kept as bitmaps, one per binary digit, over the block's rows. A query's
scores are added up as bitmaps: its components are written in signed binary digits,
each of which contributes an attribute's slices, shifted, or their complements; carry-save
adders turn the heap of weighted bitmaps into the slices of the sum. The best rows
are selected from the most significant slice downward, and rows that tie at the
boundary are resolved exactly, by id. Nothing is approximated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import stored, tidy

#: Bytes of a block's components as longs: of candidates (their slices take a fraction of it), and of queries.
BLOCK_BYTES, QUERY_BYTES = 8 << 20, 256 << 10
_PACKED = "block int, dim int, ids binary, low binary, data binary"


def pack_bits(rows: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    out = np.zeros((len(rows), -(-rows.shape[1] // 64) * 8), np.uint8)
    packed = np.packbits(rows, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def signed_digits(q: int) -> list[tuple[int, int]]:
    """(power of two, +1 or -1) pairs that add up to q, no two powers adjacent."""
    out, a = [], 0
    while q:
        if q & 1:
            d = 2 - (q & 3)
            out.append((a, d))
            q -= d
        q >>= 1
        a += 1
    return out


class BitSlices:
    """The bit-sliced index of one block; ids ascend.

    `planes[b, d]` is a bitmap over the rows: digit b of attribute d less its least value. A stored index holds nothing else of the vectors; scores
    are read back from the slices of the sum.
    """

    def __init__(self, ids: np.ndarray, low: np.ndarray, planes: np.ndarray) -> None:
        self.ids, self.low = ids, low
        self.bits, self.dims, self.words = planes.shape
        self.exists = pack_bits(np.ones((1, len(ids)), bool))[0]
        self.planes = np.empty((2, *planes.shape), np.uint64)
        self.planes[0] = planes
        np.invert(planes, out=self.planes[1])

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> BitSlices:
        n, dims = values.shape
        low = values.min(axis=0) if n else np.zeros(dims, np.int64)
        y = values.astype(np.uint64) - low.astype(np.uint64)  # wraps, so any range of longs is held
        bits = int(y.max()).bit_length() if y.size else 0
        planes = np.zeros((bits, dims, -(-n // 64)), np.uint64)
        for b in range(bits):
            planes[b] = pack_bits(((y >> np.uint64(b)) & np.uint64(1)).astype(bool).T)
        return cls(ids, low, planes)

    def offset(self, q: list[int]) -> int:
        """What a score is more than its sum of slices: of the least values, and of digits taken as complements."""
        top = (1 << self.bits) - 1
        minus = sum(1 << a for x in q for a, sign in signed_digits(x) if sign < 0)
        return sum(int(x) * int(y) for x, y in zip(q, self.low, strict=True)) - top * minus

    def sum_slices(self, q: list[int]) -> list[np.ndarray]:
        """Slices, least significant first, of a sum that differs from the scores by a constant."""
        chosen: dict[tuple[int, int], list[int]] = {}
        for d, x in enumerate(q):
            for a, sign in signed_digits(x):
                chosen.setdefault((a, sign), []).append(d)
        heap: dict[int, list[np.ndarray]] = {}
        for (a, sign), dims in chosen.items():
            part = self.planes[0 if sign > 0 else 1][:, dims]
            for b in range(self.bits):
                heap.setdefault(a + b, []).append(part[b])
        out: list[np.ndarray] = []
        weight = 0
        while heap:
            rows = heap.pop(weight, None)
            if rows is None:
                out.append(np.zeros(self.words, np.uint64))
                weight += 1
                continue
            m = np.concatenate(rows) if len(rows) > 1 else rows[0]
            while len(m) > 2:  # three bitmaps of a weight make one of it and a carry of the next
                k = len(m) // 3
                x, y, z = m[:k], m[k : 2 * k], m[2 * k : 3 * k]
                t = x ^ y
                heap.setdefault(weight + 1, []).append((x & y) | (t & z))
                m = np.concatenate([t ^ z, m[3 * k :]])
            if len(m) == 2:
                heap.setdefault(weight + 1, []).append((m[0] & m[1])[None])
                m = (m[0] ^ m[1])[None]
            out.append(m[0])
            weight += 1
        return out

    def top(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows other than the query's own, best first."""
        tied = self.exists.copy()
        own = np.searchsorted(self.ids, query_id)
        if own < len(self.ids) and self.ids[own] == query_id:
            tied[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        sure = np.zeros_like(tied)
        n_sure = 0
        digits = [int(x) for x in q]
        slices = self.sum_slices(digits)
        for s in reversed(slices):
            upper = tied & s
            n = n_sure + int(np.bitwise_count(upper).sum())
            if n > k:
                tied = upper
            else:
                sure, n_sure = sure | upper, n
                tied = tied & ~s
                if n == k:
                    break
        rows = np.array([*self._rows(sure), *self._rows(tied)[: k - n_sure]], np.int64)
        more = self.offset(digits)
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        sums = [0] * len(rows)
        for w, s in enumerate(slices):
            for at, one in enumerate(((s[word] >> bit) & np.uint64(1)).tolist()):
                sums[at] += one << w
        limit = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
        return sorted(((int(self.ids[r]), limit(x + more)) for r, x in zip(rows, sums, strict=True)), key=lambda x: (-x[1], x[0]))

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _planes(data: bytes, dim: int, rows: int) -> np.ndarray:
    words = -(-rows // 64)
    return np.frombuffer(data, np.uint64).reshape(len(data) // (8 * dim * words) if dim else 0, dim, words)


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows without an id, or with a null or non-finite component, are left out."""
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _in_blocks(rows: DataFrame, blocks: int, sliced: bool) -> DataFrame:
    """One row per block and vector length: ids ascending, and their bit slices (low, data) or, for queries, their vectors as a matrix of longs (data).

    Rows come sorted by block, so a task holds one block at a time.
    """

    def made(block: int, dim: int, ids: list, parts: list) -> pa.RecordBatch:
        own, first = np.unique(np.array(ids, np.int64), return_index=True)
        values = np.array(parts, np.int64).reshape(len(ids), dim)[first]
        low, data = b"", values
        if sliced:
            index = BitSlices.build(own, values)
            low, data = index.low.tobytes(), index.planes[0]
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "dim": pa.array([dim], pa.int32()), "ids": pa.array([own.tobytes()], pa.binary()), "low": pa.array([low], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts = None, [], []
        for batch in batches:
            vectors = batch.column("v")
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            for i, (block, vec_id) in enumerate(zip(batch.column("block").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                key = (block, int(ends[i + 1] - ends[i]))
                if key != at:
                    if ids:
                        yield made(*at, ids, parts)
                    at, ids, parts = key, [], []
                ids.append(vec_id)
                parts.append(flat[ends[i] : ends[i + 1]])
        if ids:
            yield made(*at, ids, parts)

    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    return placed.sortWithinPartitions("block", F.size("v")).select("block", "id", "v").mapInArrow(tidy(run), _PACKED)


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k rows with the greatest integer inner product for every query row, against all other rows.

    Returns (query_id, rank from 1, vec_id, score), ties to the smaller id. `is_query` is a
    condition on `id_col`. The index is built once, block by block, and written to the shared folder; work is then dealt out as (block of
    candidates, block of queries) pairs, so no task holds more than one of each. Blocks have as many rows as keeps a block's longs within
    `block_bytes` or `query_bytes`, whatever the vectors' length.

    Vectors that are null or hold a null or non-finite component take no part, nor do
    rows without an id. Vectors are compared with those of their own length only. Of
    rows that repeat an id one is kept; equal vectors of other ids are ties. A score
    beyond the range of a long is set to its limit. An empty table, or no query, gives
    an empty table. Other columns are ignored.
    """
    rows = quantised(df, id_col, vector_col, scale)
    wanted = quantised(df.where(is_query), id_col, vector_col, scale)
    (n, width), m = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first(), wanted.count()
    count = lambda total, room: max(1, -(-total // max(64, room // (8 * max(1, width)) // 64 * 64)))
    blocks, query_blocks = count(n, block_bytes), count(m, query_bytes)
    index = stored(_in_blocks(rows, blocks, True), "topk-index")
    queries = stored(_in_blocks(wanted, query_blocks, False), "topk-queries")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("q_block", every(query_blocks)).select("block", "q_block", "dim", F.lit(0).alias("side"), "ids", "low", "data")
    right = queries.withColumnRenamed("block", "q_block").withColumn("block", every(blocks)).select("block", "q_block", "dim", F.lit(1).alias("side"), "ids", "low", "data")
    cells = left.unionByName(right).repartition(max(1, min(blocks * query_blocks, 100_000)), "block", "q_block", "dim").sortWithinPartitions("block", "q_block", "dim", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held = None
        for batch in batches:
            for i in range(batch.num_rows):
                block, q_block, dim, side, ids, low, data = (c[i].as_py() for c in batch.columns)
                ids = np.frombuffer(ids, np.int64)
                if side == 0:
                    at, held = (block, q_block, dim), BitSlices(ids, np.frombuffer(low, np.int64), _planes(data, dim, len(ids)))
                    continue
                if at != (block, q_block, dim):
                    continue  # the block has no vector of this length
                matrix = np.frombuffer(data, np.int64).reshape(len(ids), dim)
                for start in range(0, len(ids), 1000):
                    best = [(int(q_id), *x) for q_id, q in zip(ids[start : start + 1000], matrix[start : start + 1000], strict=True) for x in held.top(int(q_id), q, k)]
                    if best:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*best, strict=True)], ["query_id", "vec_id", "score"])

    found = cells.mapInArrow(tidy(run), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
