"""Suffix-array style dedup: bytes covered by a long string that also starts elsewhere go.

Strings of ``length`` bytes are told apart by prefix doubling.  Ranking every byte position
at every offset would shuffle each byte of the corpus many times over, so positions are
first thinned in a way that loses none:

* From each window of ``length`` bytes, the position of the gram of ``gram`` bytes with the
  smallest hash is taken (the leftmost among equals).  Equal windows take the same place.
  About two positions in ``length - gram`` remain.
* Round 1 ranks these positions by their gram.  A window whose gram is unique is unique.
* Round 2 ranks them at a longer offset: by all bytes of all windows that took the position.
  Positions of one rank share all their windows, so each such rank is settled as repeated,
  and one position stands for it.
* Round 3 does the same for spans of 16 window starts, only around positions whose gram is
  shared and whose longer string is not: a span whose common bytes are unique is unique,
  one whose windows' bytes are all shared is settled.
* Round 4 ranks what is still open, single starts by the ``length`` bytes from each.

Ranks are 128-bit fingerprints of the bytes in place of pairs of integers; Spark sorts and
groups (rank, position) rows in each round, and positions drop out as soon as they are
unique or settled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import drop_written, short_batches, written

_STEP = 16  # starts in a span of round 3
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_TABLE = _mix(_mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _POWERS:
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = _BASE, np.uint64(_inverse(int(_BASE)))
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position where they fit."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return _mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the position of its smallest (leftmost of equals)."""
    n = len(h) - width + 1
    bits = max(1, int(len(h)).bit_length())
    keep = np.uint64(64 - bits)
    key = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    # blocks of ``width``: a window is a block's suffix and the next block's prefix
    full = -(-len(h) // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = key
    blocks = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])
    return (low & np.uint64((1 << bits) - 1)).astype(np.int64) if keep else low.astype(np.int64)


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, its gram's hash, first and last window start that take it) of one text."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    at = _lowest(h, length - gram + 1)
    edge = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [len(at)]]) - 1
    return at[first], h[at[first]], first, last


def _name(data: bytes) -> tuple[int, int]:
    """A 128-bit fingerprint as two signed longs."""
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _keys(text: str) -> list:
    """Two longs that tell whole texts apart, computed in the JVM."""
    raw = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.lit(1), raw).alias("k1"), F.xxhash64(F.lit(2), raw).alias("k2")]


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32) -> DataFrame:
    """(k1, k2, lo, hi): runs of window starts, by text, whose string starts elsewhere too.

    A text is named by two hashes; equal texts share their rows.  ``length`` must exceed
    ``gram`` by a span of round 3 at least.
    """
    if not 1 <= gram <= length - _STEP:
        raise ValueError("gram is too long for length")
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(F.col(id_col).alias("__id"), *_keys(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).where(F.octet_length("__text") >= length)

    def sample(batches):
        for b in batches:
            k1, k2, pos, lo, hi, g, r = [], [], [], [], [], [], []
            for a, c, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                at, h, first, last = anchors(data, length, gram)
                for x, y in zip(first.tolist(), last.tolist(), strict=True):
                    r.append(xxhash.xxh3_64_intdigest(data[x : y + length]))
                k1 += [a] * len(at)
                k2 += [c] * len(at)
                pos.append(at), lo.append(first), hi.append(last), g.append(h)
            cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
            big = lambda x: np.array(x, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(cat(pos, np.int32)), pa.array(cat(lo, np.int32)), pa.array(cat(hi, np.int32)), pa.array(cat(g, np.uint64).view(np.int64)), pa.array(big(r))], names=["k1", "k2", "pos", "lo", "hi", "g", "r"])

    # rounds 1 and 2: grams, and all bytes around them (with the gram's hash, 128 bits tell them)
    sampled = written(texts.select("k1", "k2", "__text").mapInArrow(sample, "k1 long, k2 long, pos int, lo int, hi int, g long, r long"), "substring-anchors")
    alive = _alive(sampled.withColumn("twice", F.lit(False)), ["g"], "r", ["k1", "k2", "pos", "lo", "hi"])
    runs = _settled(sampled, alive, ["g", "r"])
    drop_written(sampled)
    unsettled = alive.where("ranks > 1").select("one.*", "twice")
    ask = unsettled.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "lo", "hi", "twice")).alias("ask"))
    # of equal texts one row is read: that of the smallest id (repeated ids change nothing,
    # as a place is told by its text)
    chosen = written(texts.groupBy("k1", "k2").agg(F.min("__id").alias("__id")), "substring-texts")

    def of_texts(ask: DataFrame) -> DataFrame:
        t = ask.join(chosen, ["k1", "k2"]).withColumnsRenamed({"k1": "a1", "k2": "a2", "__id": "a3"})
        return texts.join(t, (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")) & F.col("__id").eqNullSafe(F.col("a3"))).select("k1", "k2", "__text", "ask")

    def spans(batches):
        for b in batches:
            rows = []
            for k1, k2, text, ask in zip(*(x.to_pylist() for x in b.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for q in ask:
                    for n in range((q["pos"] - q["hi"]) // _STEP, (q["pos"] - q["lo"]) // _STEP + 1):
                        # starts _STEP * n to _STEP * n + _STEP - 1 before the position have these bytes in common
                        c = q["pos"] - _STEP * n
                        lo, hi = max(q["lo"], c - _STEP + 1), min(q["hi"], c)
                        every = _name(b"%d %d " % (c - lo, c - hi) + data[lo : hi + length])[0]
                        rows.append((*_name(b"%d " % n + data[c : c + length - _STEP + 1]), every, k1, k2, lo, hi, q["twice"]))
            yield _batch(rows, ["s1", "s2", "r", "k1", "k2", "lo", "hi"], "twice")

    kinds = "k1 long, k2 long, lo long, hi long, twice boolean"
    core = written(of_texts(ask).mapInArrow(spans, f"s1 long, s2 long, r long, {kinds}"), "substring-spans")
    open_ = _alive(core, ["s1", "s2"], "r", ["k1", "k2", "lo", "hi"])
    more = _settled(core, open_, ["s1", "s2", "r"])
    drop_written(core, alive)
    ask = open_.where("ranks > 1").select("one.*", "twice").groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi", "twice")).alias("ask"))

    def starts(batches):
        for b in batches:
            rows = []
            for k1, k2, text, ask in zip(*(x.to_pylist() for x in b.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for q in ask:
                    rows += [(*_name(data[p : p + length]), k1, k2, p, p, q["twice"]) for p in range(q["lo"], q["hi"] + 1)]
            yield _batch(rows, ["s1", "s2", "k1", "k2", "lo", "hi"], "twice")

    single = written(of_texts(ask).mapInArrow(starts, f"s1 long, s2 long, {kinds}"), "substring-starts")
    place = F.struct("k1", "k2", "lo")
    again = single.groupBy("s1", "s2").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max("twice").alias("z")).where("z OR x <> y").select("s1", "s2")
    found = single.join(again, ["s1", "s2"]).select("k1", "k2", "lo", "hi")
    return runs.unionByName(more).unionByName(found)


def _alive(rows: DataFrame, core: list[str], outer: str, place: list[str]) -> DataFrame:
    """The ranks (core, outer) whose core is shared: one place of each, and whether it is settled.

    twice: the outer string is at two places at least, or known to be; ranks: outer strings
    of the core.  Equal places (of copies of a text that were read twice) count once, but a
    text sampled from several rows counts for each row.
    """
    at = F.struct(*place)
    ranked = rows.groupBy(*core, outer).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("one"), F.max(at).alias("other"), F.max("twice").alias("known"))
    counts_rows = "pos" in place
    ranked = written(ranked.select(*core, outer, "one", (F.col("known") | (F.col("n") > 1 if counts_rows else F.col("one") != F.col("other"))).alias("twice")), "substring-ranks")
    shared = ranked.groupBy(*core).agg(F.count(F.lit(1)).alias("ranks"), F.max("twice").alias("any")).where("ranks > 1 OR any")
    alive = written(ranked.join(shared, core).drop("any"), "substring-alive")
    drop_written(ranked)
    return alive


def _settled(rows: DataFrame, alive: DataFrame, name: list[str]) -> DataFrame:
    """Window starts of every place whose outer string is settled."""
    runs = rows.join(alive.where("twice").select(*name), name)
    return written(runs.select("k1", "k2", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).distinct(), "substring-settled")


def _batch(rows: list[tuple], longs: list[str], flag: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * (len(longs) + 1)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.bool_())], names=[*longs, flag])


def covered(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges [a, b) covered by strings of ``length`` that start in the runs."""
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32, keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    Every byte that a string of ``length`` bytes covers goes if that string starts at any
    other place too, in the same text or another; all strings are judged on the input.
    n_spans counts maximal removed runs; ``kept`` holds the remaining bytes.  Null counts as
    empty; texts under ``length`` bytes stay whole; equal texts and repeated rows are each
    other's copies and go whole from ``length`` bytes on.  Null ids are ids like any other.
    An empty table gives an empty result; other columns are not read.
    """
    starts = repeated_starts(docs, id_col, text_col, length, gram).distinct()
    runs = written(starts.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "substring-runs")
    rows = docs.select(F.col(id_col), *_keys(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.join(runs, ["k1", "k2"], "left").select(id_col, "__text", "runs")
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for b in batches:
            out = []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                gone = covered([(r["lo"], r["hi"]) for r in runs or []], length)
                at, kept = 0, []
                for x, y in gone:
                    kept.append(data[at:x])
                    at = y
                left = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left if keep_text else None))
            cols = list(zip(*out, strict=True)) or [()] * 5
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                arrays.append(pa.array(cols[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
