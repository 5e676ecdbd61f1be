"""Personal data by weak supervision.

Patterns propose candidate spans. Labelers - the pattern's own check, a gazetteer, the
words before the span, its edges and its shape - vote on each: personal data, not, or no
opinion. Votes are counted over the whole corpus by pattern of votes; expectation-
maximisation estimates from the counts how reliable each labeler is for each family of spans,
and so how likely each voted-on candidate is personal data. Those likelihoods train a
logistic span classifier, which decides the candidates beyond the base kinds. Base spans
(valid e-mail and IP addresses, card and phone numbers) are always kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import tidy

BASE = ("email", "ip", "card", "phone")
EXTRA = ("account", "handle", "national", "secret")
KINDS = (*BASE, *EXTRA)
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: Kinds whose labelers share their reliabilities, so that failed checks are weighed against passed ones.
_FAMILY = [{"handle": 0, "account": 2, "national": 3}.get(k, i) for i, k in enumerate(KINDS)]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z.+])[0-9](?:[ -]?[0-9]){8,33}(?![0-9A-Za-z]|[ -][0-9])")
_KEY = re.compile(r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}+|sk-[0-9A-Za-z-]{20,}+|xox[abp]-[0-9A-Za-z-]{10,}+)(?![0-9A-Za-z])")
_KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox")
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?([^\s\"',;]{6,}+)")
_ASSIGN_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key")
_AT = re.compile(r"[(\[]at[)\]]", re.I)
_HANDLE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,5}", re.I)

#: Common top-level domains, country calling codes and first digits of card numbers.
TOP_DOMAINS = frozenset("com org net edu gov io co info biz de fr es uk us it nl ch at be eu ca au jp cn br mx ar".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "2", "6")
#: Words that speak for, and against, personal data when they stand shortly before a span.
CUES = re.compile(r"(?i)\b(?:e-?mail|mail|contact|phone|tel|mobile|cell|fax|call|card|visa|mastercard|iban|account|konto|compte|cuenta|ssn|passport|ip|host|server|password|passwd|pwd|secret|token|key|login|telefon|téléphone|teléfono|correo|courriel)\b")
COUNTER_CUES = re.compile(r"(?i)\b(?:version|release|isbn|issn|doi|page|section|chapter|figure|order|invoice|serial|lot|build|commit|checksum)\b")
CONTEXT_CHARS = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outward, in linear time."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by start and then kind."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", *m.span()))
        out.sort(key=lambda s: (s[1], _ORDER[s[0]]))
    return out


def extra_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of other kinds that touch no base span and no candidate before them."""
    found: list[tuple[str, int, int]] = []
    if any(k in text for k in _KEY_STARTS):
        found += [("secret", *m.span()) for m in _KEY.finditer(text)]
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in _ASSIGN_WORDS):
            found += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)]
    if _AT.search(text):
        found += [("handle", *m.span()) for m in _HANDLE.finditer(text)]
    if _DIGIT.search(text):
        found += [("national", *m.span()) for m in _NATIONAL.finditer(text)]
        found += [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
    if not found:
        return found
    taken = sorted((s, e) for _, s, e in base)
    out, end, i = [], 0, 0
    reach = 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][1])
            i += 1
        if s >= end and s >= reach:
            out.append((kind, s, e))
            end = e
    return out


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Of each labeler 1 (personal data), 0 (not) or -1 (no opinion): check, gazetteer, context, edges, shape."""
    span = text[start:end]
    digits = "".join(c for c in span if c.isascii() and c.isdigit())
    check = gazetteer = -1
    if kind in ("email", "handle"):
        top = re.split(r"\W+", span.rstrip(".)]").lower())[-1]
        check, gazetteer = int(top.isalpha() and len(top) >= 2), 1 if top in TOP_DOMAINS else -1
    elif kind == "ip":
        parts = span.split(".")
        check, gazetteer = int(not any(len(p) > 1 and p[0] == "0" for p in parts)), int(parts[0] not in ("0", "127", "255"))
    elif kind in ("card", "account"):
        check = int(len(digits) >= 12 and luhn(digits))
        gazetteer = int(digits.startswith(ISSUERS)) if len(digits) in (15, 16) else -1
    elif kind == "phone":
        check, gazetteer = int(digits[0] != "0"), 1 if digits.startswith(CALLING_CODES) else -1
    elif kind == "national":
        check, gazetteer = int(digits[0] not in "01" and digits[3] not in "01"), -1
    elif kind == "secret":
        check = int(any(c.isdigit() for c in span) and any(c.isalpha() for c in span))
        gazetteer = 1 if span.startswith(_KEY_STARTS) else -1
    before = text[max(0, start - CONTEXT_CHARS) : start]
    context = 0 if COUNTER_CUES.search(before) else 1 if CUES.search(before) else -1
    edges = 0 if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()) else -1
    counts = Counter(span)
    entropy = -sum(c / len(span) * math.log2(c / len(span)) for c in counts.values())
    shape = 0 if entropy < 1.5 else 1 if entropy >= 3.6 else -1
    return check, gazetteer, context, edges, shape


def features(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """What the final classifier reads, in a few steps each: kind, length, shares of digits and capitals, edges, mixture, cue."""
    span = text[start:end]
    n = len(span)
    digit, upper = sum(map(str.isdigit, span)) / n, sum(map(str.isupper, span)) / n
    clean = int(not ((start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())))
    spread = min(3, int(len(set(span)) / n * 4))
    return _ORDER[kind], min(4, n.bit_length() - 1), int(digit * 3.99), int(upper * 2.99), clean, spread, int(bool(CUES.search(text, max(0, start - CONTEXT_CHARS), start)))


def label_model(rows: list[tuple[int, tuple[int, ...], float]], rounds: int = 200) -> tuple[list[float], dict]:
    """Expectation-maximisation over (family, votes, count) rows: each row's probability of personal data, and what was learnt.

    A labeler has, for each family of kinds, a probability of either vote given either truth; votes are
    taken as independent given the truth, and having no opinion says nothing. Starts from the share of votes for, so that the
    labels keep their sense; counts are smoothed by one vote that tells right from wrong 4 : 1.
    """
    post = [(sum(v == 1 for v in votes) + 0.5) / (sum(v >= 0 for v in votes) + 1) for _, votes, _ in rows]
    learnt: dict = {}
    for _ in range(rounds):
        learnt = {}
        for (kind, votes, count), p in zip(rows, post, strict=True):
            prior, table = learnt.setdefault(kind, ([1.0, 1.0], [[[0.8, 0.2], [0.2, 0.8]] for _ in votes]))
            for truth, share in ((0, 1 - p), (1, p)):
                prior[truth] += share * count
                for j, v in enumerate(votes):
                    if v >= 0:
                        table[j][truth][v] += share * count
        change = 0.0
        for i, (kind, votes, _) in enumerate(rows):
            prior, table = learnt[kind]
            odds = math.log(prior[1] / prior[0])
            for j, v in enumerate(votes):
                if v >= 0:
                    odds += math.log(table[j][1][v] / sum(table[j][1])) - math.log(table[j][0][v] / sum(table[j][0]))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            change, post[i] = max(change, abs(p - post[i])), p
        if change < 1e-6:
            break
    return post, learnt


_WIDTHS = (len(KINDS), 5, 4, 3, 2, 4, 2)


def design(rows: list[tuple[int, ...]]) -> np.ndarray:
    """One-hot columns of feature rows, and a constant."""
    x = np.zeros((len(rows), 1 + sum(_WIDTHS)))
    x[:, 0] = 1
    for r, row in enumerate(rows):
        at = 1
        for v, width in zip(row, _WIDTHS, strict=True):
            x[r, at + min(v, width - 1)] = 1
            at += width
    return x


def span_classifier(rows: list[tuple[tuple[int, ...], float, float]]) -> np.ndarray:
    """Logistic weights from (features, probability, count) rows, by Newton steps with a small ridge."""
    x = design([f for f, _, _ in rows])
    p, c = (np.array([r[i] for r in rows], float) for i in (1, 2))
    c = c / max(1.0, c.sum()) * min(c.sum(), 10_000.0)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (c * (p - q)) - 0.1 * w)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """The final classifier's weights, learnt from the candidates of every text; only counts of votes and steps reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                t = text.as_py() or ""
                base = base_spans(t)
                for span in base + extra_spans(t, base):
                    counts[votes(t, *span), features(t, *span)] += 1
        if counts:
            join = lambda v: ",".join(map(str, v))
            yield pa.RecordBatch.from_arrays([pa.array([join(v) for v, _ in counts]), pa.array([join(f) for _, f in counts]), pa.array(list(counts.values()), pa.int64())], ["votes", "features", "n"])

    total = df.select(text_col).mapInArrow(tidy(run), "votes string, features string, n long").groupBy("votes", "features").agg(F.sum("n").alias("n")).orderBy("votes", "features").collect()
    split = lambda s: tuple(map(int, s.split(",")))
    rows = [(split(r["votes"]), split(r["features"]), float(r["n"])) for r in total]
    if not rows:
        return np.zeros(1 + sum(_WIDTHS))
    likely, _ = label_model([(_FAMILY[f[0]], v, n) for v, f, n in rows])
    return span_classifier([(f, p, n) for (_, f, n), p in zip(rows, likely, strict=True)])


def spans_of(text: str, weights: np.ndarray, threshold: float = 0.5) -> tuple[list, list]:
    """(base spans, all spans) of a text, by start and then kind."""
    base = base_spans(text)
    extra = extra_spans(text, base)
    if extra:
        odds = design([features(text, *s) for s in extra]) @ weights
        bound = math.log(threshold / (1 - threshold))
        extra = [s for s, z in zip(extra, odds, strict=True) if z >= bound]
    return base, sorted(base + extra, key=lambda s: (s[1], _ORDER[s[0]]))


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list) -> str:
    """The text with each stretch of overlapping spans replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"<{kind.upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def find_pii(df: DataFrame, text_col: str = "text", threshold: float = 0.5, redact: bool = True) -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone, base_sha256, base_spans and spans to rows and, with `redact`, `redacted`.

    Spans are written kind:start:end (code points, end exclusive), ordered by start and
    kind, joined by commas. Trained on all of `df` first (one pass of counting), then applied
    in a narrow pass. Columns of added names are replaced, others kept.

    Null text counts as empty, and its redacted text is null; a text without candidates has
    empty spans and the digest of the empty string. Repeated rows are counted and marked as
    often as they occur. An empty table gives an empty one. Texts are read whole, in linear time.
    """
    weights = train(df, text_col)
    added = [*(f"n_{k}" for k in BASE), "base_sha256", "base_spans", "spans", *(["redacted"] if redact else [])]
    kept = [c for c in df.columns if c.lower() not in added]
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    types = [pa.int64()] * 4 + [pa.string()] * (3 + redact)
    schema = fields + ", ".join(f"{a} {'long' if i < 4 else 'string'}" for i, a in enumerate(added))
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(at):
                t = value.as_py()
                base, spans = spans_of(t or "", weights, threshold)
                named = Counter(k for k, _, _ in base)
                said = _joined(base)
                rows.append((*(named[k] for k in BASE), hashlib.sha256(said.encode()).hexdigest(), said, _joined(spans), *([redacted(t, spans) if t is not None else None] if redact else [])))
            cols = list(zip(*rows, strict=True)) or [[]] * len(added)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], [*kept, *added])

    return df.select(*kept).mapInArrow(tidy(run), schema)
