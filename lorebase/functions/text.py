"""Column functions on text: terms, relevance, identifiers, hash embeddings."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns.
LATIN = "[a-zA-Z0-9_+#.-]{2,}"
WORD = "[\\p{L}\\p{N}_]+"


def lexical_terms(text: Column) -> Column:
    """Distinct lower-case Latin tokens of two characters or more, and CJK pairs."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit(LATIN), F.lit(0))
    blocks = F.regexp_extract_all(low, F.lit("[\\x{3400}-\\x{9fff}]+"), F.lit(0))
    pairs = F.flatten(F.transform(blocks, lambda b: F.when(F.length(b) == 1, F.array(b)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(b) - 1, F.lit(1))), lambda i: F.substring(b, i, F.lit(2))))))
    return F.array_distinct(F.concat(latin, pairs))


def lexical_relevance(query_terms: Column, content_terms: Column) -> Column:
    """0.75 coverage of the query plus 0.25 precision, whose base is bounded by four times the query."""
    q, c = F.size(query_terms), F.size(content_terms)
    both = F.size(F.array_intersect(query_terms, content_terms)).cast("double")
    score = both / q * 0.75 + both / F.least(c, q * 4) * 0.25
    return F.when((q == 0) | (c == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def estimate_tokens(text: Column, chars_per_token: int = 4) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(float(chars_per_token)))).cast("long")


def short_id(*parts: Column) -> Column:
    """First 12 hex digits of the MD5 of the parts joined by colons."""
    return F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12)


def point_id(key: Column) -> Column:
    """The low 63 bits of an MD5 digest."""
    low = F.substring(F.md5(key), 17, 16)
    head = F.conv(F.substring(low, 1, 1), 16, 10).cast("long") % 8
    return head * F.lit(1 << 60) + F.conv(F.substring(low, 2, 15), 16, 10).cast("long")


class _Ends(dict):
    """The last four bytes of each word's MD5 as a number; -1 for no word."""

    def __missing__(self, word: str) -> int:
        end = self[word] = int.from_bytes(hashlib.md5(word.encode()).digest()[-4:]) if word else -1
        return end


#: Kept by a worker from batch to batch, and emptied when it holds many words.
_ENDS = _Ends()


def word_counts(texts: list[str], size: int) -> np.ndarray:
    """For each text how many of its white-space words fall in each of ``size`` slots."""
    if len(_ENDS) > 200_000:
        _ENDS.clear()
    at, many = [], []
    for t in texts:
        for blank in "\t\n\x0b\f\r":
            t = t.replace(blank, " ")
        words = t.split(" ")
        many.append(len(words))
        at.extend(map(_ENDS.__getitem__, words))
    at = np.array(at, np.int64)
    places = np.where(at < 0, size, at % size) + np.repeat(np.arange(len(many)) * (size + 1), many)
    return np.bincount(places, minlength=len(many) * (size + 1)).reshape(-1, size + 1)[:, :size].astype(np.float64)


def hash_embedding(text: Column, bits: int = 6) -> Column:
    """Counts of white-space words by the low ``bits`` of their MD5, scaled to unit norm; a null text has none.

    One pass over a batch's words; a word that comes again isn't hashed again.
    """
    size = 1 << bits

    @F.pandas_udf("array<double>")
    def counted(low: pd.Series) -> pd.Series:
        c = word_counts(["" if t is None else t for t in low], size)
        norm = np.sqrt((c * c).sum(axis=1, keepdims=True))
        rows = list(c / np.where(norm > 0, norm, 1))
        return pd.Series([None if t is None else r for t, r in zip(low, rows, strict=True)], dtype=object)

    return counted(F.lower(text))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision with a guard of 1e-8 on the norms' product."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b) + F.lit(1e-8))


def fit_dimension(vector: Column, size: int) -> Column:
    """Pad with zeros, or cut and scale to unit norm."""
    cut = F.transform(F.slice(vector, 1, size), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda s, x: s + x * x))
    padded = F.concat(cut, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(vector), F.lit(0))))
    return F.when(F.size(vector) <= size, padded).otherwise(F.transform(cut, lambda x: F.when(norm > 0, x / norm).otherwise(x)))


# Words that carry no evidence in citations, and none in questions.
CITATION_STOP_WORDS = ["about", "also", "and", "are", "been", "being", "for", "from", "has", "have", "into", "its", "made", "that", "the", "their", "this", "was", "were", "with"]
QUERY_STOP_WORDS = ["and", "or", "the", "is", "are", "what", "how", "why", "vs", "versus", "和", "与", "及", "或", "的", "了", "是", "什么", "哪些", "怎么", "如何", "为什么", "有什么", "区别", "差异", "比较", "对比", "请", "一下"]
HAN = "[\\x{4e00}-\\x{9fff}]+"


def _han(token: Column) -> Column:
    """Whether a token is a run of Han characters, as those of Latin letters and digits come before."""
    return token >= "\u4e00"


def _han_pairs(tokens: Column) -> Column:
    """Each run of Han characters as its pairs; a single one stays."""
    pairs = lambda t: F.when(F.length(t) == 1, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2))))
    return F.flatten(F.transform(F.filter(tokens, _han), pairs))


def citation_terms(text: Column) -> Column:
    """Distinct lower-case words of three characters or more without stop words, and Han pairs."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+|" + HAN), F.lit(0))
    stop = F.array(*[F.lit(w) for w in CITATION_STOP_WORDS])

    def terms(x: Column) -> Column:
        latin = F.filter(F.array_distinct(x), lambda t: (F.length(t) >= 3) & ~_han(t) & ~F.array_contains(stop, t))
        return F.array_distinct(F.concat(latin, _han_pairs(x)))

    return F.transform(F.array(tokens), terms)[0]  # the tokens are found once


def fact_terms(text: Column) -> Column:
    """Distinct lower-case runs of letters, digits and underscores, and Han pairs."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+|" + HAN), F.lit(0))
    return F.array_distinct(F.concat(F.filter(tokens, lambda t: ~t.rlike("^" + HAN)), _han_pairs(tokens)))


def identifiers(text: Column) -> Column:
    """Distinct lower-case identifiers of 2 to 64 characters that begin with a letter."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9_+#.\\-]{1,63}"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in QUERY_STOP_WORDS])
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda t: ~F.array_contains(stop, t)))


def query_terms(text: Column) -> Column:
    """Identifiers of a question, and its Han runs of two characters or more."""
    stop = F.array(*[F.lit(w) for w in QUERY_STOP_WORDS])
    runs = F.filter(F.regexp_extract_all(text, F.lit("[\\x{4e00}-\\x{9fff}]{2,}"), F.lit(0)), lambda t: ~F.array_contains(stop, t))
    return F.array_distinct(F.concat(identifiers(text), runs))


def coverage(terms: Column, text: Column) -> Column:
    """Share of terms that the lower-case text contains; 1 without terms."""
    low = F.lower(text)
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms))


def one_of(text: Column, markers: list[str]) -> Column:
    """Whether the text contains one of some fixed strings."""
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))
