"""Byte-pair encoding and decoding by a tokenization automaton.

The merges are compiled, in rank order, into a deterministic automaton whose arcs
are labelled with tokens. It starts as one state with a loop for each byte. The
gadget of merge k, `u v -> w`,

* clones the state that arcs labelled `u` lead to and removes the clone's arc `v`
  (after `u`, `v` may no longer follow), and
* gives each state that still has an arc `u` a new arc `w`, leading to the state
  that `v` led to before the gadget.

A state is thus known by the label that leads to it and the time of the gadget
that cut it, and every arc question is answered by walking gadgets backwards
(`arc`). Each byte string labels exactly one path, which is its BPE encoding, so
encoding needs no merging: `encode` reads a word byte by byte and looks up, in
the tables, the one arc that ends at each byte. Decoding emits arc labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from cairn.llm.common import tidy

_SHIFT = 20
_SHORT = (3, 2, 1)
#: Fixed value: the pre-splitting pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts in which `re` and the tokenizers library agree about letters, digits and white space.
_FAST_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
_LIBRARY_SPLIT = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
NEEDS_LIBRARY = re.compile("[\x1c-\x1f\x80-\xa0\xb2\xb3\xb9\xbc-\xbeƀ-\U0010ffff]").search


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character -> byte, by the published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_words(text: str) -> list[str]:
    """Pre-split a text by the tokenizers library's own character tables; by `re` where it gives the same words faster."""
    if not NEEDS_LIBRARY(text):
        return _FAST_SPLIT(text)
    return [text[start:end] for _, (start, end) in _LIBRARY_SPLIT(text)]


@dataclass
class MergeAutomaton:
    """A compiled vocabulary: arc labels, gadgets and special strings.

    Size is bounded by the vocabulary (about 4 MB for 50,000 merges), never by the data.
    """

    labels: list[bytes]
    left: list[int]
    right: list[int]
    time: list[int]
    cut: dict[int, int]
    specials: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.ids = {b: t for t, b in enumerate(self.labels) if b and self.time[t] > -2}
        self.longest = max(map(len, self.ids), default=1)
        ends: dict[bytes, set[int]] = {}
        for b in self.ids:
            if len(b) > 3:
                ends.setdefault(b[-4:], set()).add(len(b))
        self._ends = {b: (*sorted(n, reverse=True), 3, 2, 1) for b, n in ends.items()}
        self._last: dict[bytes, int] = {}
        self._arcs: dict[int, bool] = {}
        self._special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    @classmethod
    def compile(cls, path: str) -> MergeAutomaton:
        """Read a tokenizer file and add one gadget for each merge, in order."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("only plain byte-level BPE files can be compiled")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("added tokens that take white space are not supported")
        vocab = model["vocab"]
        size = 1 + max([*vocab.values(), *(a["id"] for a in added)])
        labels, left, right, time = [b""] * size, [-1] * size, [-1] * size, [-2] * size
        for token, t in vocab.items():
            if all(c in alphabet for c in token):
                labels[t] = bytes(alphabet[c] for c in token)
                if len(labels[t]) == 1:
                    time[t] = -1
        for a in added:
            labels[a["id"]] = a["content"].encode()
        out = cls(labels, left, right, time, {}, {a["content"]: a["id"] for a in added})
        for k, pair in enumerate(model["merges"]):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            out._gadget(k, vocab[u], vocab[v], vocab[u + v])
        out.__post_init__()
        return out

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        if self.time[w] != -2:
            raise ValueError("two merges make one token")
        if self.time[u] == -2 or self.time[v] == -2 or not self._walk(u, v, k):
            return  # no path takes u v any more: the merge is dead and gets no arc
        self.left[w], self.right[w], self.time[w] = u, v, k
        self.cut[u << _SHIFT | v] = k

    def _walk(self, x: int, t: int, now: int) -> bool:
        """Has the state behind label x, as it stood before gadget `now`, an arc t?"""
        time, cut = self.time, self.cut
        while True:
            k = cut.get(x << _SHIFT | t)
            if k is not None and k < now:
                return False
            if time[x] < 0 and time[t] < 0:
                return True
            if time[x] > time[t]:  # this state was copied from the one behind its right part
                now, x = time[x], self.right[x]
            else:  # this arc was added beside the arc of its left part, after the cut
                now, t = time[t] + 1, self.left[t]

    def arc(self, x: int, t: int) -> bool:
        """Whether token t may follow token x; remembered in a bounded table."""
        key = x << _SHIFT | t
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) > 1_000_000:
                self._arcs.clear()
            known = self._arcs[key] = self._walk(x, t, 1 << 60)
        return known

    def encode(self, word: bytes) -> list[int]:
        """The one path of a word. Time grows in proportion to its length.

        What ends at a byte is looked for among the lengths that tokens with the same last four
        bytes have, then among the short ones.
        """
        if len(word) > 64:
            return self._encode_long(word)
        last, ids, arcs, ends, n = self._last, self.ids, self._arcs, self._ends, len(word)
        if len(last) > 500_000:
            last.clear()
        known = n
        while known and word[:known] not in last:
            known -= 1
        for i in range(known + 1, n + 1):
            for length in ends.get(word[i - 4 : i], _SHORT) if i > 3 else _SHORT:
                j = i - length
                if j < 0:
                    continue
                t = ids.get(word[j:i])
                if t is None:
                    continue
                if j:
                    x = last[word[:j]]
                    ok = arcs.get(x << _SHIFT | t)
                    if not (self.arc(x, t) if ok is None else ok):
                        continue
                last[word[:i]] = t
                break
            else:
                raise ValueError("a byte has no token")
        out = []
        while n:
            t = last[word[:n]]
            out.append(t)
            n -= len(self.labels[t])
        return out[::-1]

    def _encode_long(self, word: bytes) -> list[int]:
        n, ids = len(word), self.ids
        last = [-1] * (n + 1)
        for i in range(1, n + 1):
            for length in self._ends.get(word[i - 4 : i], _SHORT) if i > 3 else _SHORT:
                j = i - length
                t = ids.get(word[j:i]) if j >= 0 else None
                if t is not None and (not j or self.arc(last[j], t)):
                    last[i] = t
                    break
            else:
                raise ValueError("a byte has no token")
        out = []
        while n:
            out.append(last[n])
            n -= len(self.labels[last[n]])
        return out[::-1]

    def pieces(self, text: str) -> Iterator[str | int]:
        """Words of a text in order; special strings come as their ids."""
        if self._special is None or not self._special.search(text):
            yield from split_words(text)
            return
        at = 0
        for m in self._special.finditer(text):
            yield from split_words(text[at : m.start()])
            yield self.specials[m[0]]
            at = m.end()
        yield from split_words(text[at:])

    def encode_text(self, text: str) -> list[int]:
        out: list[int] = []
        for w in self.pieces(text):
            out.extend([w] if isinstance(w, int) else self.encode(w.encode("utf-8", "surrogatepass")))
        return out

    def decode(self, ids: list[int]) -> str:
        """Emit the labels of the arcs; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join([self.labels[t] for t in ids]).decode("utf-8", "replace")


class WordTable(dict):
    """Word (or special id) -> value made from its ids; filled on demand.

    Bounded: when it is full its words become the older generation, from which those still in use come back.
    """

    def __init__(self, automaton: MergeAutomaton, make, most: int = 400_000) -> None:
        super().__init__()
        self.automaton, self.make, self.most, self.older = automaton, make, most, {}

    def __missing__(self, word):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(word)
        if value is None:
            value = self.make([word] if isinstance(word, int) else self.automaton.encode(word.encode("utf-8", "surrogatepass")))
        self[word] = value
        return value

    def of(self, text: str) -> list:
        a = self.automaton
        words = split_words(text) if a._special is None or not a._special.search(text) else a.pieces(text)
        return list(map(self.__getitem__, words))


class _Decoded(dict):
    """Decimal ids of a word -> the labels of their arcs; bounded."""

    def __init__(self, labels: list[bytes]) -> None:
        super().__init__()
        self.labels = labels

    def __missing__(self, ids: str) -> bytes:
        if len(self) >= 400_000:
            self.clear()
        value = self[ids] = b"".join([self.labels[int(t)] for t in ids.split(",")])
        return value


_compiled: dict[str, MergeAutomaton] = {}
_tables: dict[tuple[str, str], WordTable] = {}


def automaton(path: str) -> MergeAutomaton:
    """The compiled automaton of a tokenizer file, once for each Python process."""
    if path not in _compiled:
        _compiled[path] = MergeAutomaton.compile(path)
    return _compiled[path]


def word_table(path: str, kind: str, make) -> WordTable:
    """A worker's table of words, kept from task to task."""
    if (path, kind) not in _tables:
        _tables[path, kind] = WordTable(automaton(path), make)
    return _tables[path, kind]


def _text_ids(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Encode a text column and decode it again.

    Returns (id_col, n_tokens long, ids_sha256, decoded_sha256) and, with `keep`, the
    ids (comma-joined decimals) and the decoded text. No shuffle; rows are independent.
    `tokenizer` is the path of a byte-level BPE file present on every machine.

    Null or empty text: no tokens, both digests of the empty string. A null id stays
    null; repeated rows give repeated results; an empty table gives an empty one; other
    columns are ignored. Very long texts and words are encoded whole, in linear time.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if keep else "")

    def run(batches):
        words = word_table(tokenizer, "decimal", _text_ids)
        spoken = _Decoded(words.automaton.labels)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                parts = words.of(text.as_py() or "")
                ids = ",".join(parts)
                back = b"".join(map(spoken.__getitem__, parts)).decode("utf-8", "replace")
                for c, v in zip(cols, (ids.count(",") + 1 if parts else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids if keep else None, back if keep else None), strict=True):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()][: 5 if keep else 3]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if keep else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)  # noqa: B905

    return df.select(id_col, text_col).mapInArrow(tidy(run), schema)
