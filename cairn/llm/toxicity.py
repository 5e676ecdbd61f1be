"""Toxicity by compression distance.

zstandard's trainer makes dictionaries from labelled text: one of ordinary documents, read whole, that both sides
share; one of toxic documents, of the words in them by which their windows differ from ordinary ones; and one of other ordinary words, of the
same size. A text is read in windows of one word (long words in several that overlap); a window's signal is the length it
compresses to with the ordinary pair of dictionaries less the length with the toxic pair. How often each length difference
occurs is turned into a probability by likelihood ratios and a logistic model, and the length threshold that goes with the decision is calibrated; all three are fitted to
measurements with dictionaries that have not seen the measured text.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import give_back, stored, tidy

#: Labelled rows that training may take to the driver: a bounded sample, chosen by hash.
SAMPLE_ROWS = 12_000
#: Bytes of text that training may take to the driver; labelled rows are taken, in the order of the hash, while they fit.
SAMPLE_BYTES = 192 << 20
THRESHOLD = 0.7
#: Sizes of what is shared, and at most of what is not.
SHARED_BYTES, OWN_BYTES = 100_000, 64_000
#: Bytes of one sample of ordinary text for the trainer, and of all of them; beyond it every k-th piece of all texts is taken.
SAMPLE_CHUNK, SHARED_SAMPLE = 2000, 12_000_000
FOLDS = 2
REACH = 8  # length differences are limited to -8 .. 8
WINDOW_CHARS = 32
STEP_CHARS = 16  # windows of a long word overlap, so that no word's beginning is cut in each of them
KEPT_CHARS = 256  # longer words are measured each time, so that the kept ones stay bounded
BINS = 2 * REACH + 1
#: Every window stands between these, so that a block is always worth compressing and its last bytes can be matched.
LEAD = b"a lead that each window has, so that a block is always worth compressing; 0123456789 abcdefghijklmnopqrstuvwxyz"
TAIL = bytes(range(1, 17))
_EDGES = ".,!?;:()\"'"


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTLAZY2, min_match=4, window_log=18, hash_log=17, chain_log=17, search_log=5, target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


class Windows(dict):
    """Word -> the length differences of its windows, moved to 0 .. 2 * REACH; bounded."""

    def __init__(self, toxic: bytes, ordinary: bytes, most: int = 200_000) -> None:
        super().__init__()
        self.toxic, self.ordinary, self.most = _compressor(toxic), _compressor(ordinary), most

    def __missing__(self, word: str) -> tuple[int, ...]:
        value = self.differences(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value

    def differences(self, word: str) -> tuple[int, ...]:
        """The difference of each of a word's windows; the last window ends with the word."""
        word = word.strip(_EDGES)
        last = max(0, len(word) - WINDOW_CHARS)
        out = []
        for at in [*range(0, last, STEP_CHARS), last]:
            window = LEAD + f" {word[at : at + WINDOW_CHARS]} ".encode("utf-8", "surrogatepass") + TAIL
            d = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
            out.append(max(-REACH, min(REACH, d)) + REACH)
        return tuple(out)

    def counts(self, text: str | None) -> np.ndarray:
        """Windows by length difference: all of them, then those of distinct words."""
        every, distinct = [0] * BINS, [0] * BINS
        for word, times in Counter(words(text)).items():
            for d in self[word]:
                every[d] += times
                distinct[d] += 1
        return np.array([*every, *distinct])


def _stripped(text: str | None) -> set[str]:
    return {w.strip(_EDGES) for w in words(text)}


def telling_words(texts: list[str], labels: list[int], least: float = 20.0) -> tuple[frozenset[str], frozenset[str]]:
    """Words of toxic texts that begin with (or are) something `least` times as frequent there, and those beginnings, of 4 to 12 characters.

    Beginnings are counted length by length, each only where the one before was frequent enough, so little is held at once.
    """
    toxic = [_stripped(t) for t, y in zip(texts, labels, strict=True) if y]
    n = [max(1, labels.count(0)), max(1, labels.count(1))]
    floor = max(3, round(0.005 * n[1]))
    starts: dict[str, int] = {}
    for k in range(4, 13):
        found = Counter(b for ws in toxic for b in {w[:k] for w in ws if len(w) >= k and (k == 4 or w[: k - 1] in starts)})
        starts |= {b: c for b, c in found.items() if c >= floor}
    usual: Counter = Counter()  # of ordinary texts, only what toxic ones have often enough
    for t, y in zip(texts, labels, strict=True):
        if not y:
            usual.update({b for w in _stripped(t) for k in range(4, min(len(w), 12) + 1) if (b := w[:k]) in starts})
    telling = frozenset(b for b, c in starts.items() if c / n[1] >= least * (usual[b] + 1) / n[0])
    return frozenset(w for ws in toxic for w in ws if _tells(w, telling)), telling


def _tells(word: str, telling: frozenset[str]) -> bool:
    return any(word[:k] in telling for k in range(4, min(len(word), 12) + 1))


def _other_words(texts: Iterable[str], telling: frozenset[str], size: int) -> bytes:
    """`size` bytes of words that don't tell, of all texts, those of the greatest hashes; only a sixteenth of the words is held, if that is enough."""
    at = lambda w: hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()
    raw = b""
    for least in (b"\xf0", b""):
        chosen = {w for t in texts for w in _stripped(t) if at(w) >= least and not _tells(w, telling)}
        raw = _bytes(sorted(chosen, key=at))
        if len(raw) >= size:
            break
    return raw[-size:]


def _features(counts: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Rows of what the logistic model reads, for rows of counts: the same of all windows and of those of distinct words."""
    out = []
    for part in (counts[:, :BINS], counts[:, BINS:]):
        n = np.maximum(1, part.sum(1))
        above = [part[:, REACH + k :].sum(1) for k in (2, 3, 4, 5)]
        sums = part @ ratios
        out += [sums / 10, sums / n * 10, *[np.log1p(a) for a in above], *[a / n * 20 for a in above], np.log1p(n)]
    return np.column_stack(out)


#: Which weights (the constant's first) are of evidence for toxicity: all but those of the constant and of the sizes.
EVIDENCE = np.r_[False, np.tile(np.r_[np.ones(10, bool), False], 2)]


@dataclass
class Model:
    """Dictionaries, likelihood ratios and logistic weights; a few hundred kB."""

    toxic: bytes
    ordinary: bytes
    ratios: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def scores(self, counts: np.ndarray) -> np.ndarray:
        x = (_features(counts, self.ratios) - self.mean) / self.spread
        z = np.column_stack([np.ones(len(x)), np.clip(x, -8, 8)]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _trained(samples: list[bytes], size: int, segment: int, window: int) -> bytes:
    """A zstandard dictionary of at most `size` bytes; samples that are too few, or no larger, are their own dictionary."""
    whole = b"".join(samples)
    if len(whole) <= size or len(samples) < 10:
        return whole[-size:]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=window).as_bytes()[-size:]
    except zstandard.ZstdError:  # the trainer finds nothing that repeats
        return whole[-size:]


def _bytes(ws: Iterable[str]) -> bytes:
    return f" {' '.join(ws)} ".encode("utf-8", "surrogatepass")


def dictionaries(texts: list[str], labels: list[int]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary of labelled texts."""
    toxic, telling = telling_words(texts, labels)
    clean = [t for t, y in zip(texts, labels, strict=True) if not y]
    step = max(1, -(-sum(len(t or "") for t in clean) // SHARED_SAMPLE))
    pieces: list[bytes] = []
    count = 0
    for t in clean:
        raw = _bytes(words(t))
        pieces += [raw[i : i + SAMPLE_CHUNK] for k, i in enumerate(range(0, len(raw), SAMPLE_CHUNK), count) if k % step == 0]
        count += -(-len(raw) // SAMPLE_CHUNK)
    told = [[w for w in dict.fromkeys(x.strip(_EDGES) for x in words(t)) if w in toxic] for t, y in zip(texts, labels, strict=True) if y]
    size = max(256, min(OWN_BYTES, 3 * len(_bytes(toxic))))
    own = _trained([_bytes(ws) for ws in told if ws], size, 48, 6)
    shared = _trained(pieces, SHARED_BYTES, 64, 8)
    return shared + own + LEAD, shared + _other_words(clean, telling, max(8, len(own))) + LEAD


def _shift(scores: np.ndarray, y: np.ndarray, threshold: float) -> float:
    """What to add to log odds so that the threshold of the best F1 of measured scores becomes `threshold`.

    That threshold counts as 1/2 if it is lower: few labels can't show that less than even odds should reject a text.
    """
    order = np.argsort(-scores, kind="stable")
    hits, told = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    best = int(np.argmax(2 * hits / (y.sum() + told)))
    low = scores[order[best + 1]] if best + 1 < len(y) else 0.0
    odds = lambda p: float(np.log(p / (1 - p)))
    return odds(threshold) - odds(min(max((scores[order[best]] + low) / 2, 0.5), 1 - 1e-4))


def train(texts: list[str], labels: list[int], threshold: float = THRESHOLD) -> Model:
    """Fit a model to labelled texts (1 is toxic).

    Each of FOLDS parts of the rows is measured with dictionaries of the others, and these measurements calibrate the
    ratios, the logistic model and the threshold; the model's own dictionaries are of all rows. Rows are put in an order that depends on the texts only, so equal input gives an
    equal model. Without rows of both labels every text gets the share of label 1 as its score.
    """
    rows = sorted(zip(texts, labels, strict=True), key=lambda r: (hashlib.md5((r[0] or "").encode("utf-8", "surrogatepass")).digest(), r[1]))
    split = lambda part: ([t for t, _ in part], [v for _, v in part])
    parts = [rows[k::FOLDS] for k in range(FOLDS)]
    measured = []
    for k, part in enumerate(parts):
        windows = Windows(*dictionaries(*split([r for j, other in enumerate(parts) if j != k for r in other])))
        measured += [windows.counts(t) for t, _ in part]
        windows.clear()
    counts = np.array(measured, float).reshape(-1, 2 * BINS)
    y = np.array([v for part in parts for _, v in part], float)
    seen = [counts[y == v, BINS:].sum(0) + 0.5 for v in (0, 1)]
    ratios = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    x = _features(counts, ratios)
    mean, spread = (x.mean(0), np.maximum(x.std(0), 1e-9)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    x = np.column_stack([np.ones(len(x)), np.clip((x - mean) / spread, -8, 8)])
    w = np.zeros(x.shape[1])
    ridge = np.r_[1e-6, np.full(len(w) - 1, 1.0)]
    if 0 < y.sum() < len(y):
        free = np.ones(len(w), bool)
        while True:
            for _ in range(60):  # Newton steps, shortened so that they can't diverge
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                some, grade = x[:, free], x.T @ (y - p) - ridge * w
                step = np.linalg.solve((some * (p * (1 - p) + 1e-9)[:, None]).T @ some + np.diag(ridge[free]), grade[free])
                w[free] += step / max(1.0, np.abs(step).max() / 2)
                if np.abs(step).max() < 1e-8:
                    break
            against = free & (w < 0) & EVIDENCE  # more evidence must not lower a score
            if not against.any():
                break
            free &= ~against
            w[against] = 0.0
        w[0] += _shift(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), y, threshold)
    else:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        w[0] = np.log(share / (1 - share))
    return Model(*dictionaries(*split(rows)), ratios, mean, spread, w)


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """At most `sample_rows` labelled texts outside the held-out third, of `sample_bytes` in all, chosen by a hash of the id."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    found = df.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.max("_y").alias("y"), F.min(text_col).alias("t"))
    found = stored(found.select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"), "y", "t"), "toxicity-sample")
    sizes = found.select("h", "i", F.coalesce(F.octet_length("t"), F.lit(0)).alias("n")).orderBy("h", "i").collect()  # at most sample_rows
    fits, total = 0, 0
    for r in sizes:
        total += r["n"]
        if total > sample_bytes:
            break
        fits += 1
    if fits < len(sizes):
        last = sizes[fits]
        found = found.where((F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("i") < last["i"])))
    rows = found.select("y", "t").collect()
    return [r["t"] or "" for r in rows], [r["y"] for r in rows]


_loaded: dict[str, tuple[Model, Windows]] = {}


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add held_out, score (0 to 1) and predicted (1 if score >= threshold, else 0) to rows.

    The model is trained here, on the driver, from a bounded sample of `labels` (id_col,
    label_col 0 or 1) joined to `df`; scoring reads whole texts and is a narrow transformation.
    Only the text enters a score. Other columns are kept, but for ones of the added names,
    which are replaced.

    Null and empty texts are scored like any text without words. Null ids are not held out.
    Labels that are null, or neither 0 nor 1, are ignored; of repeated ids the greater label
    counts. Without labels of both kinds every score is the share of label 1 (0 without any).
    Empty tables work. Very long texts and words are read whole.
    """
    spark = df.sparkSession
    model = train(*training_rows(df, labels, id_col, text_col, label_col, sample_rows), threshold)
    give_back()
    raw = pickle.dumps(model)
    mark = hashlib.sha256(raw).hexdigest()
    sent = spark.sparkContext.broadcast(raw)
    kept = [c for c in df.columns if c.lower() not in ("held_out", "score", "predicted")]
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _loaded:
            _loaded.clear()
            own = pickle.loads(sent.value)
            _loaded[mark] = own, Windows(own.toxic, own.ordinary)
        own, windows = _loaded[mark]
        for batch in batches:
            counts = np.array([windows.counts(t.as_py()) for t in batch.column(at)], float).reshape(-1, 2 * BINS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.scores(counts), pa.float64())], [*kept, "score"])

    out = df.select(*kept).mapInArrow(tidy(run), f"{fields}score double")
    return out.select(*kept, held_out(id_col).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
