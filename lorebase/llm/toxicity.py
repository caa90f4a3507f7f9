"""Toxicity by a learned, weighted lexicon matched with Aho-Corasick."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import forget_kept, short_batches, written

# Cyrillic and Greek letters that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}


#: Scripts that are written without spaces: each letter is a word here.
UNSPACED = (("\u0e00", "\u0eff"), ("\u1000", "\u109f"), ("\u1780", "\u17ff"), ("\u3040", "\u30ff"), ("\u3400", "\u4dbf"), ("\u4e00", "\u9fff"), ("\uf900", "\ufaff"), ("\U00020000", "\U0003ffff"))
#: Words of an entry at most in such scripts.
RUN = 4


class _Fold(dict):
    """A translation table: letters fold to lower case, marks on them stay, what is neither becomes a space."""

    def __missing__(self, c: int):
        ch = chr(c)
        low = ch.lower()
        if 0xFF00 < c < 0xFF5F:  # full-width forms
            low = chr(c - 0xFEE0).lower()
        if low in HOMOGLYPHS:
            out = HOMOGLYPHS[low]
        elif low in SUBSTITUTES:
            out = SUBSTITUTES[low]
        elif c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
            out = ""
        elif 0x300 <= c < 0x370:  # accents that no letter takes up
            out = ""
        elif any(a <= ch <= b for a, b in UNSPACED):
            out = low if unicodedata.category(ch)[0] == "M" else f" {low} " if ch.isalpha() else " "
        else:
            out = low if low.isalpha() or unicodedata.category(ch)[0] == "M" else " "
        self[c] = out
        return out


_FOLD = _Fold()
#: A space before a mark, as NFKC makes of a mark that stands alone.
_DOTS = re.compile(" (?=[\u0300-\u036f])")


def folded(text: str | None) -> str:
    """Words of letters between single spaces, with one at each end; "  " at least.

    Texts are composed first (NFKC), so an accent is part of its letter however it is written.
    Look-alike letters, digits and signs that stand for letters, full-width forms and
    invisible characters are folded.  A letter of a script without spaces is a word.  A word of digits alone folds to letters too, which
    no entry of the lexicon equals unless it was learned as such.
    """
    text = text or ""
    if not text.isascii():
        text = _DOTS.sub("", unicodedata.normalize("NFKC", text))
    return " " + " ".join(text.translate(_FOLD).split()) + " "


@dataclass
class Lexicon:
    """Weights of entries (" word ", " few words " or " prefix"), phrases that excuse a hit, and the scale.

    score = 1 / (1 + exp(-(bias + slope * x))), x = sum of weights of hits, three at most of
    one entry, over 1 + log2(1 + words / 256).
    """

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    bias: float = -4.0
    slope: float = 1.0

    def automaton(self):
        a = ahocorasick.Automaton()
        for k, w in self.weights.items():
            a.add_word(k, (k, w, len(k)))
        for p in self.exceptions:
            a.add_word(p, (p, None, len(p)))
        if len(a):
            a.make_automaton()
        return a


def evidence(text: str | None, automaton) -> float:
    """x of :class:`Lexicon` for one whole text."""
    words = folded(text)
    if not len(automaton):
        return 0.0
    hits = [(end - n + 1, end, k, w) for end, (k, w, n) in automaton.iter(words)]
    if not hits:
        return 0.0
    seen: dict[str, int] = {}
    best: dict[int, tuple[float, str]] = {}
    reach = -1  # how far the phrases that began so far excuse hits
    for a, b, k, w in sorted(hits, key=lambda h: (h[0], h[3] is not None)):
        if w is None:
            reach = max(reach, b)
        elif b > reach and (a not in best or w > best[a][0]):
            best[a] = (w, k)  # one hit a word: the entry of most weight
    total = 0.0
    for w, k in best.values():
        seen[k] = seen.get(k, 0) + 1
        total += w if seen[k] <= 3 else 0.0
    return total / (1 + math.log2(1 + (words.count(" ") - 1) / 256))


def held_out(id_col: str) -> Column:
    """Rows whose CRC-32 of the id as text leaves 1 when divided by 3 are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _entries(text: str | None) -> set[tuple[str, int]]:
    """Words, word beginnings and runs of letters without spaces, each with a 16-bit hash of the word before."""
    found, before, run = set(), [""], []
    for w in folded(text).split():
        at = zlib.crc32(before[-1].encode()) & 0xFFFF
        found.add((f" {w} ", at))
        found.update((f" {w[:k]}", at) for k in range(4, min(9, len(w)) + 1))
        run = [*run[1 - RUN :], w] if any(a <= w[0] <= b for a, b in UNSPACED) else []
        for k in range(2, len(run) + 1):
            first = before[-k] if k <= len(before) else ""
            found.add((f" {' '.join(run[-k:])} ", zlib.crc32(first.encode()) & 0xFFFF))
        before = [*before[-RUN:], w]
    return found


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: a text has thousands of entries, all of which are held while a batch is counted."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 30_000, candidates: int = 100_000, entries: int = 4_000, least_g2: float = 16.0, least_odds: float = 2.5) -> Lexicon:
    """Fit a lexicon on at most ``sample`` labelled rows that are not held out.

    The rows of the sample are those whose id has the smallest hash, so it doesn't depend
    on the order of files; labels other than 0 and 1 and rows without one are left out.
    Of the entries of toxic rows, the ``candidates`` most frequent are counted in clean rows.
    Entries are whole words, word beginnings of 4 to 9 letters, and 2 to 4 letters on end in scripts without spaces.  One is taken if it is
    more frequent among toxic rows by ``least_odds`` (log odds) and by a likelihood ratio of
    ``least_g2``, where toxic rows count once for each word before the entry, so that near
    copies of one toxic text don't make all of its words toxic; and dropped if a shorter beginning does as well; ``entries`` at most stay.
    Exceptions are two-word phrases around an entry that are found among clean rows only,
    so often that the entry's own share of toxic rows makes that a chance of one in a million.  What reaches the driver: an entry or bin each, bounded by the
    parameters.  Without rows of both classes the lexicon is empty and scores are low.
    """
    spark = docs.sparkSession
    short_batches(spark)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    known = known.where(~held_out(id_col)).orderBy(F.xxhash64(F.lit(3), F.col(id_col)), id_col).limit(sample)
    rows = written(docs.select(F.col(id_col), F.col(text_col).alias("__text")).join(known, id_col).select("__text", "__y"), "toxic-sample")
    n = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Lexicon({})

    def among_toxic(batches):
        forget_kept()
        for b in _slices(batches):
            seen: Counter[tuple[str, int]] = Counter()
            for t in b.column(0).to_pylist():
                found = _entries(t)
                seen.update(dict(found).items())  # a document counts once for an entry
                seen.update(dict.fromkeys(found, 0))
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["e", "at", "n"])

    # near copies repeat a word after the same word: what they share counts once
    toxic = rows.where("__y = 1").select("__text").mapInArrow(among_toxic, "e string, at int, n long").groupBy("e", "at").agg(F.sum("n").alias("n"))
    toxic = toxic.groupBy("e").agg(F.least(F.count(F.lit(1)), F.sum("n")).alias("c1")).where("c1 >= 3")
    toxic = written(toxic.orderBy(F.desc("c1"), "e").limit(candidates), "toxic-candidates")
    known = frozenset(r["e"] for r in toxic.select("e").toLocalIterator())
    shared = spark.sparkContext.broadcast(known)

    def among_clean(batches):
        for b in _slices(batches):
            seen = Counter(e for t in b.column(0).to_pylist() for e in {e for e, _ in _entries(t)} & shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["e", "c0"])

    clean = rows.where("__y = 0").select("__text").mapInArrow(among_clean, "e string, c0 long").groupBy("e").agg(F.sum("c0").alias("c0"))
    counts = toxic.join(clean, "e", "left").select("e", "c1", F.coalesce("c0", F.lit(0)).alias("c0"))
    odds = F.ln((F.col("c1") + 0.5) / (n1 - F.col("c1") + 0.5)) - F.ln((F.col("c0") + 0.5) / (n0 - F.col("c0") + 0.5))
    seen = F.col("c0") + F.col("c1")
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / (seen * n / (n0 + n1)))).otherwise(0.0)
    rest = lambda c, n: F.when(n - F.col(c) > 0, (n - F.col(c)) * F.ln((n - F.col(c)) / ((n0 + n1 - seen) * n / (n0 + n1)))).otherwise(0.0)
    g2 = 2 * (part("c0", n0) + part("c1", n1) + rest("c0", n0) + rest("c1", n1))
    picked = counts.select("e", odds.alias("odds"), g2.alias("g2"), "c0", "c1").where((F.col("odds") >= least_odds) & (F.col("g2") >= least_g2))
    picked = picked.orderBy(F.desc("g2"), "e").limit(entries).collect()
    weights: dict[str, float] = {}
    for r in sorted(picked, key=lambda r: (len(r["e"].rstrip()), r["e"])):
        shorter = [weights[r["e"][:k]] for k in range(5, len(r["e"])) if r["e"][:k] in weights]
        if not shorter or r["odds"] > max(shorter) + 1.0:
            weights[r["e"]] = r["odds"]
    lexicon = Lexicon(weights)
    automaton = lexicon.automaton()

    def phrases(batches):
        for b in _slices(batches):
            seen: dict[str, list[int]] = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, mine = folded(t), set()
                for end, (k, _, n) in automaton.iter(words):
                    begin = end - n + 1
                    stop = end if k.endswith(" ") else words.index(" ", end)
                    before, after = words.rfind(" ", 0, begin), words.find(" ", stop + 1)
                    if before >= 0:
                        mine.add((words[before : stop + 1], k))
                    if after >= 0:
                        mine.add((words[begin : after + 1], k))
                for p in mine:
                    seen.setdefault(p, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([k for _, k in seen], pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["p", "e", "c0", "c1"])

    if weights:
        excuses = rows.select("__text", "__y").mapInArrow(phrases, "p string, e string, c0 long, c1 long").groupBy("p", "e").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        share = {r["e"]: min(r["c1"] / (r["c0"] + r["c1"]), 0.999) for r in picked}
        rare = {e: math.log(1e-6) / math.log(1 - s) for e, s in share.items()}
        found = excuses.where("c1 = 0 AND c0 >= 5").orderBy(F.desc("c0"), "p").limit(entries).collect()
        lexicon.exceptions = sorted({r["p"] for r in found if r["c0"] >= rare[r["e"]]})
        automaton = lexicon.automaton()

    def bins(batches):
        for b in batches:
            x = [min(400, int(evidence(t, automaton) * 10)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), b.column(1)], names=["x", "y"])

    held = rows.select("__text", "__y").mapInArrow(bins, "x long, y int").groupBy("x").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).collect()
    lexicon.bias, lexicon.slope = _logistic([(r["x"] / 10, r["y"], r["n"]) for r in held])
    return lexicon


def _logistic(rows: list[tuple[float, int, int]], ridge: float = 0.05) -> tuple[float, float]:
    """Bias and slope by Newton's method, with a weak penalty on both."""
    x = np.array([r[0] for r in rows], float)
    y, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    a = np.stack([np.ones_like(x), x])
    b = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(b @ a, -30, 30)))
        g = a @ (y - n * p) - ridge * b
        h = (a * (n * p * (1 - p))) @ a.T + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(max(b[1], 0.0))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; null and empty texts are scored as texts without a hit."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.bias, lexicon.slope))

    def scored(batches):
        forget_kept()
        lex = Lexicon(*shared.value)
        automaton = lex.automaton()
        for b in batches:
            s = [1 / (1 + math.exp(-max(-30.0, min(30.0, lex.bias + lex.slope * evidence(t, automaton))))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(scored, f"`{id_col}` {kind}, score double")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, **how) -> DataFrame:
    """(id, held_out, score, predicted) of every row, repeated ids and null ids included.

    Only texts are inputs of a score: equal texts score alike.  A null id counts as not held
    out but is never learned from.  An empty table gives an empty result.
    """
    out = score(docs, learn(docs, labels, id_col, text_col, label_col, **how), id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **how) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, all columns kept.

    Null and empty texts have no hit and stay, null ids are never learned from, repeated rows
    and equal texts go or stay together, a score at the threshold goes, and an empty table stays empty.
    """
    lexicon = learn(docs, labels, id_col, text_col, **how)
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.bias, lexicon.slope))
    at = docs.columns.index(text_col)

    def clean(batches):
        forget_kept()
        lex = Lexicon(*shared.value)
        automaton = lex.automaton()
        for b in batches:
            s = [1 / (1 + math.exp(-max(-30.0, min(30.0, lex.bias + lex.slope * evidence(t, automaton))))) < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(s, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
