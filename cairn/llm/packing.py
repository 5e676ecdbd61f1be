"""Packing of tokenised documents into fixed windows by the sum-of-squares rule.

Each task packs the documents of its partition online. A level array N holds, for
every fill h from 1 to capacity - 1, the number of windows filled to h. An item of
length s goes to the level h (a new window is level 0) for which the sum of N[h]^2
over all levels is least afterwards. Documents longer than a window are cut into
full windows and a rest; only the rest is placed. Tasks share nothing, so there is
no shuffle, and a lost task is repeated with the same result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cairn.llm.bpe import SPLIT, byte_alphabet
from cairn.llm.common import tidy, worker_cache

Piece = tuple  # (doc, start, ids as little-endian uint32 bytes, doc_tokens)


class LevelPacker:
    """Sum-of-squares packing of pieces; `emit(window, offset, piece)` gets those of finished windows.

    At most `most_open` windows are open: beyond it, and at the end, the emptiest
    windows are cut up to fill the fullest.
    """

    def __init__(self, capacity: int, emit: Callable[[int, int, Piece], None], most_open: int = 4096) -> None:
        self.capacity, self.emit, self.most_open = capacity, emit, most_open
        self.count = np.zeros(capacity + 1, np.int64)  # the level array; entry 0 and `capacity` stay 0
        self.at_level: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.open = self.windows = 0

    def add(self, doc, ids: bytes) -> None:
        n, c = len(ids) // 4, self.capacity
        full = n - n % c
        for start in range(0, full, c):
            self._close([(doc, start, ids[4 * start : 4 * (start + c)], n)])
        if full < n:
            self._place((doc, full, ids[4 * full :], n))

    def best_level(self, s: int) -> int:
        """The level h that makes the sum of squares least with an item of s; the fullest of equals."""
        c = self.capacity
        here = self.count[: c - s + 1]
        change = self.count[s : c + 1] - here
        change = 2 * change + 2
        change[0] = 2 * self.count[s] + 1 if s < c else 0
        if s < c:
            change[-1] = 1 - 2 * here[-1]  # a full window is at no level
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def _place(self, piece: Piece) -> None:
        s = len(piece[2]) // 4
        h = self.best_level(s)
        window = self._take(h) if h else []
        window.append(piece)
        if h + s == self.capacity:
            self._close(window)
        else:
            self._put(h + s, window)
            if self.open > self.most_open:
                self._merge()

    def _take(self, h: int) -> list[Piece]:
        self.count[h] -= 1
        self.open -= 1
        return self.at_level[h].pop()

    def _put(self, h: int, window: list[Piece]) -> None:
        self.count[h] += 1
        self.open += 1
        self.at_level[h].append(window)

    def _close(self, window: list[Piece]) -> None:
        offset = 0
        for piece in window:
            self.emit(self.windows, offset, piece)
            offset += len(piece[2]) // 4
        self.windows += 1

    def _merge(self) -> list[Piece]:
        """Fill the fullest open windows with cut pieces of the emptiest; at most one stays open."""
        levels = [(h, w) for h in range(1, self.capacity) for w in self.at_level[h]]
        self.count[:] = 0
        self.open = 0
        self.at_level = [[] for _ in range(self.capacity + 1)]
        i, fill = 0, levels[-1][0] if levels else 0
        while i < len(levels) - 1:
            window, (h, donor) = levels[-1][1], levels[i]
            doc, start, ids, n = donor.pop()
            s, space = len(ids) // 4, self.capacity - fill
            if s > space:
                donor.append((doc, start + space, ids[4 * space :], n))
                ids, s = ids[: 4 * space], space
            window.append((doc, start, ids, n))
            fill += s
            levels[i] = (h - s, donor)
            if not donor:
                i += 1
            if fill == self.capacity:
                self._close(levels.pop()[1])
                fill = levels[-1][0] if levels else 0
        if i < len(levels):
            self._put(fill, levels[i][1])

    def finish(self) -> None:
        """Close all windows; the last one is cut into sequences whose lengths are powers of two, which need no padding."""
        self._merge()
        rest = next((self._take(h) for h in range(1, self.capacity) if self.count[h]), [])
        rest.reverse()
        left = sum(len(p[2]) for p in rest) // 4
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            window = []
            while size:
                doc, start, ids, n = rest.pop()
                s = min(size, len(ids) // 4)
                if 4 * s < len(ids):
                    rest.append((doc, start + s, ids[4 * s :], n))
                window.append((doc, start, ids[: 4 * s], n))
                size -= s
            self._close(window)


_encoders: dict[str, tiktoken.Encoding] = worker_cache(__name__)


def encoder(path: str) -> tiktoken.Encoding:
    """A fast encoder of a byte-level BPE tokenizer file, once for each Python process that goes on packing."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in token): t for token, t in spec["model"]["vocab"].items() if token not in special}
        _encoders[path] = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", most_open: int = 4096) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    Returns a row per piece: (id_col, start, length, ids binary of little-endian uint32,
    doc_tokens, sequence_id, offset). A document is its BPE ids and then `end_id`.
    sequence_id is task number * 2^40 + the window's number in that task.

    Null or empty text: one token, `end_id`. Null ids stay null; repeated rows are packed
    as often as they occur; an empty table gives an empty one; other columns are ignored.
    Memory is bounded by `most_open` windows and the longest text.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        special = list(enc._special_tokens)
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0
        kind = None

        def emit(window: int, offset: int, piece: Piece) -> None:
            nonlocal held
            doc, start, ids, n = piece
            rows.append((doc, start, len(ids) // 4, ids, n, base + window, offset))
            held += len(ids)

        def flush() -> pa.RecordBatch:
            nonlocal held
            cols = list(zip(*rows, strict=True))
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            held = 0
            return out

        packer = LevelPacker(capacity, emit, most_open)
        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = enc.encode(text, allowed_special="all") if any(s in text for s in special) else enc.encode_ordinary(text)
                packer.add(doc.as_py(), np.array(ids, "<u4").tobytes() + tail)
                if held > 1 << 23:
                    yield flush()
        packer.finish()
        if rows:
            yield flush()

    return df.select(id_col, text_col).mapInArrow(tidy(run), schema)
