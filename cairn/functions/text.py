"""Tokenizer and BM25 expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: English words that an index leaves out. Words with an apostrophe can only match while punctuation is kept.
STOPWORDS = tuple(
    """a about above after again against all am an and any are aren't as at be because been before being below between both
    but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had
    hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd
    i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only
    or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that
    that's the their theirs them themselves then there there's these they they'd they'll they're they've this those through
    to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which
    while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself
    yourselves""".split()
)
MIN_BYTES, MAX_BYTES = 2, 64
SPACE, SPACE_OR_PUNCTUATION = r"[\s]+", r"[\s\p{Punct}]+"


def fold(word: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(word, UPPER, LOWER)


@dataclass(frozen=True)
class Rules:
    """How texts are cut into terms: words left out, whether punctuation separates, and the lengths in bytes that are kept.

    `with_word` and `without_word` give changed rules; a word that is added is folded, one that is removed must be written as it stands.
    """

    stopwords: tuple[str, ...] = STOPWORDS
    remove_punctuation: bool = True
    least: int = MIN_BYTES
    most: int = MAX_BYTES

    def with_word(self, word: str) -> Rules:
        return replace(self, stopwords=tuple(dict.fromkeys((*self.stopwords, word.translate(str.maketrans(UPPER, LOWER))))))

    def without_word(self, word: str) -> Rules:
        return replace(self, stopwords=tuple(w for w in self.stopwords if w != word))


DEFAULT = Rules()


def kept(word: Column, rules: Rules = DEFAULT) -> Column:
    long_enough = F.octet_length(word).between(rules.least, rules.most)
    return long_enough & ~word.isin(*rules.stopwords) if rules.stopwords else long_enough


def tokens(text: Column | str, rules: Rules = DEFAULT) -> Column:
    """The kept, folded terms of a text in order; null text has none."""
    words = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE_OR_PUNCTUATION if rules.remove_punctuation else SPACE)
    return F.filter(F.transform(words, fold), lambda w: kept(w, rules))


def query_terms(query: str, rules: Rules = DEFAULT) -> list[str]:
    """Distinct terms of a query in order, by the same rules (on the driver; a query is short)."""
    words = re.split(r"[\t-\r !-/:-@\[-`{-~]+" if rules.remove_punctuation else r"[\t-\r ]+", query)
    low = [w.translate(str.maketrans(UPPER, LOWER)) for w in words]
    return list(dict.fromkeys(w for w in low if rules.least <= len(w.encode()) <= rules.most and w not in rules.stopwords))


def idf(total: Column, df: Column) -> Column:
    gain = F.log(F.lit(1.0) + F.greatest(F.lit(0.0), (total - df + 0.5) / (df + 0.5)))
    return F.when((total == 0) | (df == 0), 0.0).otherwise(gain)


def bm25(tf: Column, weight: Column, length: Column, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    mean = F.when(average <= 0, 1.0).otherwise(average)
    under = tf + k1 * (1.0 - b + b * length / mean)
    return F.when((tf == 0) | (weight <= 0) | (under <= 0), 0.0).otherwise(weight * tf * (k1 + 1.0) / under)


def token_table(df: DataFrame, id_col: str, text_col: str, rules: Rules = DEFAULT) -> DataFrame:
    """(id, term, position): one row per kept token; position counts kept tokens from 0."""
    return df.select(F.col(id_col), F.posexplode(tokens(text_col, rules)).alias("position", "term"))
