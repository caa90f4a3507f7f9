"""Encoding and decoding with a merge-type piece model, with seeded merge-dropout."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import free_name, kept_by_worker, short_batches

#: What a space becomes inside pieces.
SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _mixed(x):
    """32 well-mixed bits of 64-bit keys (an array of uint64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x >> np.uint64(32)


def gaps(keys: np.ndarray, n: int, drop: float) -> np.ndarray:
    """Candidates that an occurrence (a key) merges between its skip n - 1 and its skip n.

    Gaps of odds (1 - drop)^k * drop are what a draw for each single candidate gives.
    """
    if drop >= 1:
        return np.zeros(len(keys), np.int64)
    x = _mixed(keys + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).astype(np.float64)
    return np.floor(np.log((x + 1) / 2**32) / np.log1p(-drop)).astype(np.int64)


def skipper(key: int, drop: float) -> Callable[[], bool]:
    """Tells for each candidate that comes up at one occurrence whether it is skipped."""
    if drop <= 0:
        return lambda: False
    keys = np.array([key & 0xFFFFFFFFFFFFFFFF], np.uint64)
    n, left = 0, int(gaps(keys, 0, drop)[0])

    def skip() -> bool:
        nonlocal n, left
        if left:
            left -= 1
            return False
        n += 1
        left = int(gaps(keys, n, drop)[0])
        return True

    return skip


def _ragged(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[at[i] : at[i] + size[i]] after each other, and where each ends."""
    ends = np.cumsum(size)
    return flat[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


class Pieces:
    """The pieces of a merge-type model, with their scores, and one byte piece for each byte."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.scores.append(sp.get_score(i))
            self.bytes_of.append(b"")
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()

        self.spelling = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.spelled = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.spelled_at = np.cumsum(self.spelled) - self.spelled
        self._pairs()

    def _pairs(self) -> None:
        """Tables for :meth:`segment_many`: characters' ids, ranks, and merges by hashed pair."""
        self.char = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        order = sorted(range(len(self.scores)), key=lambda i: -self.scores[i])
        self.rank = np.zeros(len(order), np.int32)
        level, last = -1, None
        for i in order:  # equal scores share a rank, so that the leftmost goes first
            if self.scores[i] != last:
                level, last = level + 1, self.scores[i]
            self.rank[i] = level
        self.bits = 20
        self.slots = np.full((1 << self.bits) + 64, -1, np.int64)
        self.merge = np.full((1 << self.bits) + 64, -1, np.int32)
        self.probes = 1
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    key = a << 20 | b
                    at = int(self._slot(np.array([key], np.int64))[0])
                    n = 1
                    while self.slots[at] >= 0 and self.slots[at] != key:
                        at, n = at + 1, n + 1
                    self.slots[at], self.merge[at] = key, i
                    self.probes = max(self.probes, n)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that pieces a and b merge to, or -1."""
        out = np.full(a.shape, -1, np.int32)
        known = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[known].astype(np.int64) << 20 | b[known]
        at = self._slot(key)
        for _ in range(self.probes):
            held = self.slots[at]
            hit = held == key
            out[known[hit]] = self.merge[at[hit]]
            on = ~hit & (held >= 0)
            if not on.any():
                break
            known, key, at = known[on], key[on], at[on] + 1
        return out

    def segment_many(self, words: list[str], drop: float, seeds: list[int]) -> list[list[int]]:
        """:meth:`segment` of many units of like length at once, with the same results."""
        skips = []
        for word, seed in zip(words, seeds, strict=True):
            skip = skipper(seed, drop)
            skips.append([k for k in range(3 * len(word)) if skip()])
        return [np.frombuffer(x, np.int32)[:-1].tolist() for x in self.segment_skipping(words, skips)]

    def segment_skipping(self, words: list[str], skips: list) -> list[bytes]:
        """Packed ids, and last the count of candidates that came up, of many units of like
        length, each with the (ascending) numbers of the candidates it skips.

        All units go through the agenda in step: each round takes every unit's best
        candidate, skips or merges it, and offers the new pairs.
        """
        n, width = len(words), max(1, max(map(len, words)))
        size = np.fromiter(map(len, words), np.int64, n)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.arange(width)[None, :] < size[:, None]
        sym = np.full((n, width + 1), -1, np.int32)
        sym[:, :width][inside] = self.char[codes]
        none = np.iinfo(np.int32).max
        many = np.fromiter(map(len, skips), np.int64, n)
        leave = np.full((n, int(many.max(initial=0)) + 1), -1, np.int64)
        leave[np.arange(leave.shape[1])[None, :] < many[:, None]] = [k for x in skips for k in x]
        drawn, left_out = np.zeros(n, np.int64), np.zeros(n, np.int64)
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        into = np.full((n, width), -1, np.int32)
        rank = np.full((n, width), none, np.int32)

        def offer(row: np.ndarray, i: np.ndarray) -> None:
            j = np.minimum(after[row, i], width)
            k = self._merged(sym[row, i], np.where(j < size[row], sym[row, j], -1))
            into[row, i] = k
            rank[row, i] = np.where(k >= 0, self.rank[k], none)

        row, at = np.nonzero(inside)
        offer(row, at)
        live = np.arange(n)
        while len(live):
            i = rank[live].argmin(axis=1)
            on = rank[live, i] < none
            live, i = live[on], i[on]
            skip = leave[live, left_out[live]] == drawn[live]
            drawn[live] += 1
            left_out[live[skip]] += 1
            rank[live[skip], i[skip]] = none
            row, i = live[~skip], i[~skip]
            j = after[row, i]
            sym[row, i] = into[row, i]
            sym[row, j], rank[row, j] = -2, none
            k = after[row, j]
            after[row, i] = k
            before[row, np.minimum(k, width)] = i
            offer(row, i)
            left = before[row, i]
            some = left >= 0
            offer(row[some], left[some])
        sym[:, width] = drawn
        keep = sym != -2
        keep[:, :width] &= inside
        flat = sym[keep]
        ends = np.cumsum(keep.sum(axis=1)).tolist()
        packed = flat.tobytes()
        out = [packed[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]
        for r in np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), "right")).tolist():  # characters without a piece
            spelled, where = [], np.flatnonzero(keep[r]).tolist()
            for c, x in zip(where, np.frombuffer(out[r], np.int32).tolist(), strict=True):
                spelled.extend([x] if x >= 0 else (self.byte_ids[b] for b in words[r][c].encode("utf-8", "surrogatepass")))
            out[r] = array("i", spelled).tobytes()
        return out

    def segment(self, word: str, drop: float, seed: int) -> list[int]:
        """:meth:`segment_drawn` with the draws of one seed."""
        return self.segment_drawn(word, skipper(seed, drop))

    def segment_drawn(self, word: str, skip: Callable[[], bool]) -> list[int]:
        """Ids of one unit in which spaces are already ``SPACE`` and literal ones are absent.

        Candidate merges wait in an agenda, best score first, leftmost first among equals.
        A candidate that comes up is skipped if ``skip`` says so; it comes back only if a
        neighbour changes, as a different span.
        """
        ids, scores = self.ids, self.scores
        n = len(word)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        text: list[str] = list(word)
        agenda: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (k := ids.get(text[i] + text[j])) is not None:
                heapq.heappush(agenda, (-scores[k], i, len(text[i]), len(text[j])))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = after[i] if text[i] else n
            if j >= n or len(text[i]) != a or len(text[j]) != b:
                continue
            if skip():
                continue
            text[i] += text[j]
            text[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out: list[int] = []
        for t in text:
            if t:
                k = ids.get(t)
                if k is None:
                    out.extend(self.byte_ids[b] for b in t.encode("utf-8", "surrogatepass"))
                else:
                    out.append(k)
        return out

    def decode(self, ids) -> str:
        """The text of ids; one leading space, which encoding puts first, goes."""
        ids = np.asarray(ids, np.int64)
        raw = _ragged(self.spelling, self.spelled_at[ids], self.spelled[ids])[0].tobytes()
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


#: Spaces and letters up to a sign, space or line end; a line end; or whatever goes up to a space.
_WORD = re.compile(r" *[^ ]+| +")
_PART = re.compile(r" *[^\W\d_]+(?=[.,;:!?\n ]|$)|\n| *[^ \n]+| +")


class Encoder:
    """Encodes whole texts unit by unit: words with the spaces before them, signs, line ends.

    No piece holds a space after another character, a sign after a letter, or a line end, so
    no merge crosses a unit's border (checked for the model at hand; where it doesn't hold,
    units are only cut before spaces).  Every candidate merge of every occurrence is drawn
    by itself: an occurrence's skips are a keyed hash of its document and its place.

    A state is a unit with the numbers of the candidates it skips.  Its ids are kept in one
    array, the count of candidates that came up beside them, and a further skip leads to
    another state, so that a batch's occurrences are looked up as arrays of state numbers.
    A state follows from its unit and skips alone, so forgetting the less used half when
    there are more than ``memory`` changes no result.  Units over ``LONG`` are segmented at
    every occurrence.
    """

    LONG = 512
    _SKIP = 20  # bits of a candidate's number

    def __init__(self, pieces: Pieces, drop: float, seed: int, memory: int = 300_000):
        self.pieces, self.drop, self.seed, self.memory = pieces, drop, seed, memory
        if any(SPACE in p.lstrip(SPACE) for p in pieces.ids):
            raise ValueError("a piece of this model spans a space")
        self.cut = not any(p[i].isalpha() and p[i + 1] in ".,;:!?" or "\n" in p for p in pieces.ids for i in range(len(p) - 1))
        self._forget()

    def _forget(self) -> None:
        self.unit_state: dict[str, int] = {}
        self.next_state: dict[int, int] = {}
        self.units: list[str] = []
        self.skips: list[tuple[int, ...]] = []
        self.ids, self.n_ids = np.zeros(1 << 16, np.int32), 0
        # by state: where its ids are, how many, candidates that came up, uses, and the state
        # and skip that lead to it (-1: a unit's first state, -2: one occurrence's own)
        self.at, self.size, self.drawn, self.used, self.link = (np.zeros(1 << 12, np.int64) for _ in range(5))

    def _forget_half(self) -> None:
        """Keep the states used most, with those that lead to them."""
        n, mask = len(self.units), (1 << self._SKIP) - 1
        used, link = self.used[:n], self.link[:n]
        half = max(1, self.memory // 2)
        least = max(2, np.partition(used, n - half)[n - half]) if n > half else 0
        keep = (used >= least) & (link != -2) & (self.size[:n] > 0)
        before = -1
        while before != (before := int(keep.sum())):
            keep &= (link < 0) | keep[np.maximum(link, 0) >> self._SKIP]
        at = np.flatnonzero(keep)
        new = np.cumsum(keep) - 1
        units, skips = [self.units[k] for k in at.tolist()], [self.skips[k] for k in at.tolist()]
        ids, size, link, used = _ragged(self.ids, self.at[at], self.size[at] + 1)[0], self.size[at] + 1, link[at], used[at]
        link = np.where(link < 0, link, new[np.maximum(link, 0) >> self._SKIP] << self._SKIP | link & mask)
        self._forget()
        self._add(units, skips, ids, size, link)
        self.used[: len(units)] = used // 2
        for k, (unit, x) in enumerate(zip(units, link.tolist(), strict=True)):
            if x < 0:
                self.unit_state[unit.replace(SPACE, " ")] = k
            else:
                self.next_state[x] = k

    def _places(self, n: int, doc_key: int) -> np.ndarray:
        """A key for each of the n places of a document."""
        start = xxhash.xxh64_intdigest((doc_key & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), self.seed)
        return np.arange(n, dtype=np.uint64) + np.uint64(start)

    def _spelled(self, unit: str, key: int) -> list[int]:
        """A very long unit, or one with literal U+2581, spelled in bytes as pieces use it for the space."""
        ids: list[int] = []
        skip = skipper(key, self.drop)
        for n, x in enumerate(unit.split(SPACE)):
            if n:
                ids += [self.pieces.byte_ids[b] for b in SPACE.encode()]
            ids += self.pieces.segment_drawn(x.replace(" ", SPACE), skip)
        return ids

    def _add(self, units: list[str], skips: list[tuple[int, ...]], flat: np.ndarray, size: np.ndarray, link: np.ndarray) -> range:
        """New states: each has size[i] numbers of ``flat``, its ids and the count of candidates last."""
        first = len(self.units)
        new = range(first, first + len(units))
        self.units += units
        self.skips += skips
        while len(self.at) < len(self.units):
            self.at, self.size, self.drawn, self.used, self.link = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.drawn, self.used, self.link))
        while len(self.ids) < self.n_ids + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        ends = np.cumsum(size)
        self.at[first : new.stop], self.size[first : new.stop] = self.n_ids + ends - size, size - 1
        self.drawn[first : new.stop], self.link[first : new.stop] = flat[ends - 1], link
        self.n_ids += len(flat)
        return new

    def _learn(self, units: list[str], skips: list[tuple[int, ...]], link: np.ndarray) -> list[int]:
        """States of units (in the model's spelling) with skips, all units of like length at once."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        kind = np.maximum(3, np.frexp(np.maximum(size - 1, 1).astype(np.float64))[1])
        states = np.zeros(len(units), np.int64)
        for bits in np.unique(kind).tolist():
            keys = np.flatnonzero(kind == bits)
            step = max(1, (1 << 17) >> bits)
            for at in range(0, len(keys), step):
                block = keys[at : at + step].tolist()
                words, left_out = [units[k] for k in block], [skips[k] for k in block]
                packed = self.pieces.segment_skipping(words, left_out)
                numbers = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
                states[block] = self._add(words, left_out, np.frombuffer(b"".join(packed), np.int32), numbers, link[block])
        return states.tolist()

    def _unit_states(self, units: list[str]) -> np.ndarray:
        got = list(map(self.unit_state.get, units))
        if None in got:
            new = list(dict.fromkeys(u for u, g in zip(units, got, strict=True) if g is None))
            odd = [u for u in new if len(u) > self.LONG or SPACE in u]
            if odd:  # no ids and no candidates: told at each occurrence
                one = np.ones(len(odd), np.int64)
                self.unit_state.update(zip(odd, self._add(odd, [()] * len(odd), np.zeros(len(odd), np.int32), one, -one), strict=True))
                new = [u for u in new if u not in self.unit_state]
            spelled = [u.replace(" ", SPACE) for u in new]
            self.unit_state.update(zip(new, self._learn(spelled, [()] * len(new), np.full(len(new), -1)), strict=True))
            got = list(map(self.unit_state.__getitem__, units))
        return np.array(got, np.int64)

    def _skipped_states(self, states: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Where one more skip leads from each state."""
        keys, back = np.unique(states << self._SKIP | skip, return_inverse=True)
        every = keys.tolist()
        got = list(map(self.next_state.get, every))
        if None in got:
            at = np.array([k for k, g in enumerate(got) if g is None])
            of, more = (keys[at] >> self._SKIP).tolist(), (keys[at] & (1 << self._SKIP) - 1).tolist()
            found = self._learn([self.units[x] for x in of], [(*self.skips[x], k) for x, k in zip(of, more, strict=True)], keys[at])
            self.next_state.update(zip(keys[at].tolist(), found, strict=True))
            got = list(map(self.next_state.__getitem__, every))
        return np.array(got, np.int64)[back]

    def _segmented(self, units: list[str], places: np.ndarray) -> np.ndarray:
        """States of units at their places."""
        states = self._unit_states(units)
        odd = np.flatnonzero(self.size[states] == 0).tolist()
        if self.drop > 0:
            skip = gaps(places, 0, self.drop)
            on = np.flatnonzero(skip < self.drawn[states])
            skip, n = skip[on], 0
            while len(on):  # occurrences whose next skip is among the candidates that come up
                n += 1
                states[on] = self._skipped_states(states[on], skip)
                skip = skip + 1 + gaps(places[on], n, self.drop)
                more = np.flatnonzero(skip < self.drawn[states[on]])
                on, skip = on[more], skip[more]
        self.used[: len(self.units)] += np.bincount(states, minlength=len(self.units))
        for k in odd:
            spelled = np.array([*self._spelled(units[k], int(places[k])), 0], np.int32)
            states[k] = self._add([""], [()], spelled, np.array([len(spelled)]), np.array([-2]))[0]
        return states

    def encode_many(self, texts: list[str | None], doc_keys: list[int]) -> list[np.ndarray]:
        """Piece ids of each whole text with a space put before it; null and empty texts have none."""
        if len(self.units) >= self.memory or self.n_ids >= 16 * self.memory:
            self._forget_half()
        units, ends, places = [], [0], []
        for text, key in zip(texts, doc_keys, strict=True):
            if text:
                units += _PART.findall(" " + text) if self.cut else _WORD.findall(" " + text)
            places.append(self._places(len(units) - ends[-1], key))
            ends.append(len(units))
        if not units:
            return [np.zeros(0, np.int32) for _ in texts]
        states = self._segmented(units, np.concatenate(places))
        ids, last = _ragged(self.ids, self.at[states], self.size[states])
        at = np.concatenate([[0], last])[ends].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode(self, text: str | None, doc_key: int = 0) -> list[int]:
        return self.encode_many([text], [doc_key])[0].tolist()


@kept_by_worker(2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


@kept_by_worker()
def _encoder(path: str, drop: float, seed: int) -> Encoder:
    """One encoder for all tasks of a worker: what it remembers changes no result."""
    return Encoder(_pieces(path), drop, seed)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, drop: float = 0.1, seed: int = 5) -> DataFrame:
    """(id, pieces, n_bytes, n_pieces, pieces_crc32, decoded_crc32, lossless) of every row.

    pieces are the ids of the whole text; each candidate merge of each occurrence is skipped
    with odds ``drop``, independently.  decoded_crc32 is the CRC-32 of the text that they
    decode to, and lossless tells whether that equals the text.  Null texts have null
    pieces and CRCs, no pieces and bytes, and count as lossless; empty texts have none.
    Rows of one id and text get the same pieces, so reruns and repeated rows agree; a null
    id is a key like any other.  An empty table gives an empty result; other columns are
    not read.  ``model`` must be readable on every executor.
    """
    short_batches(docs.sparkSession, 1024, "3m")
    kind = docs.schema[id_col].dataType.simpleString()
    held = free_name(docs.columns, "__key")
    rows = docs.select(id_col, text_col, F.xxhash64(F.lit(seed), F.col(id_col)).alias(held))

    def encode(batches):
        pieces = _pieces(model)
        encoder = _encoder(model, drop, seed)
        for b in batches:
            ids, size, crc, back, same = [], [], [], [], []
            texts = b.column(1).to_pylist()
            for text, got in zip(texts, encoder.encode_many(texts, b.column(2).to_pylist()), strict=True):
                if text is None:
                    ids.append(None), size.append(0), crc.append(None), back.append(None), same.append(True)
                    continue
                decoded = pieces.decode(got)
                ids.append(got)
                size.append(len(text.encode("utf-8", "surrogatepass")))
                crc.append(zlib.crc32(got.tobytes()))
                back.append(zlib.crc32(decoded.encode("utf-8", "surrogatepass")))
                same.append(decoded == text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(size, pa.int64()), pa.array([0 if i is None else len(i) for i in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.int64()), pa.array(same, pa.bool_())],
                names=[id_col, "pieces", "n_bytes", "n_pieces", "pieces_crc32", "decoded_crc32", "lossless"],
            )

    return rows.mapInArrow(encode, f"`{id_col}` {kind}, pieces array<int>, n_bytes long, n_pieces long, pieces_crc32 long, decoded_crc32 long, lossless boolean")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", model: str = MODEL) -> DataFrame:
    """(id, text) of piece ids; null pieces give a null text."""
    short_batches(encoded.sparkSession, 128)
    kind = encoded.schema[id_col].dataType.simpleString()

    def decode(batches):
        pieces = _pieces(model)
        for b in batches:
            texts = [None if p is None else pieces.decode(p) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, pieces_col).mapInArrow(decode, f"`{id_col}` {kind}, text string")
