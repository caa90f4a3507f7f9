"""Repair of conversation structure: the cheapest edits that make the roles of a conversation legal.

Edits are found by Dijkstra's algorithm on an implicit lattice whose nodes are (turn index,
state of the role grammar).  Texts take no part in it: it sees one letter a row.  Texts come
in once, afterwards, as a stream in order, so a conversation of any length is held neither
in the search nor in the pass over its texts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, as characters.
BLANKS = " \t\n\x0b\x0c\r"
#: Costs of edits; keeping or giving a new role to a truncated row costs TRUNCATED more.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar ``(s?(ua)+)?`` are the last role, "" before any; what a new row of user or assistant makes of each.
NEXT = {"": "u", "s": "u", "a": "u", "u": "a"}
LEGAL = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}
NAMES = {"u": "user", "a": "assistant"}


class Audit:
    """A string of edits as a node of a tree: parent, last letter, and a jump to a far ancestor.

    Two strings are compared by the letters that follow their last common node, found in a
    logarithmic number of jumps, so long strings are never copied or read through.
    """

    __slots__ = ("parent", "letter", "depth", "jump")

    def __init__(self, parent: Audit | None = None, letter: str = "") -> None:
        self.parent, self.letter = parent, letter
        if parent is None:
            self.depth, self.jump = 0, self
        else:
            self.depth = parent.depth + 1
            far = parent.jump
            self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent

    def up(self, depth: int) -> Audit:
        at = self
        while at.depth > depth:
            at = at.jump if at.jump.depth >= depth else at.parent
        return at

    def __lt__(self, other: Audit) -> bool:
        x, y = self.up(min(self.depth, other.depth)), other.up(min(self.depth, other.depth))
        if x is y:
            return self.depth < other.depth
        while x.parent is not y.parent:
            x, y = (x.jump, y.jump) if x.jump is not y.jump else (x.parent, y.parent)
        return x.letter < y.letter

    def __str__(self) -> str:
        letters, at = [], self
        while at.parent is not None:
            letters.append(at.letter)
            at = at.parent
        return "".join(reversed(letters))


def cheapest(rows: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation; of equal costs the ASCII-least audit.

    A row is its role's initial (``s``, ``u``, ``a``, else ``o``), in upper case if its text is
    truncated, or ``x`` if it has to go.  The queue is ordered by (cost, audit); the search
    ends at the first accepting end node that leaves it.  Letters fix the states they lead
    through, so two ways to a node never differ by a tail, and the order of strings holds
    however they go on.
    """
    queue, done = [(0, Audit(), 0, "")], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            return cost, str(audit)
        if (i, state) in done:
            continue
        done.add((i, state))
        ways = [(INSERT, "I", i, NEXT[state])]
        if i < len(rows):
            ways.append((DELETE, "D", i + 1, state))
            row = rows[i]
            if row != "x":
                more, role = (TRUNCATED if row.isupper() else 0), row.lower()
                ways.append((RENAME + more, "R", i + 1, NEXT[state]))
                if (state, role) in LEGAL:
                    ways.append((more, "K", i + 1, role))
        for more, letter, at, to in ways:
            if (at, to) not in done:
                heapq.heappush(queue, (cost + more, Audit(audit, letter), at, to))
    raise AssertionError("deleting every row is always possible")


@lru_cache(maxsize=20_000)
def _short(rows: str) -> tuple[int, str]:
    return cheapest(rows)


def _rows(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    return turns.select(F.col(id_col).cast("long").alias("__conv"), F.col(turn_col).cast("long").alias("__turn"), role.alias("__role"), text.alias("__text"), F.unhex(F.sha2(text, 256)).alias("__digest"))


def _in_order(rows: DataFrame, *first: Column) -> DataFrame:
    """Rows dealt by conversation, and in a conversation by turn (nulls first), role, and digest of the text."""
    return rows.repartition("__conv").sortWithinPartitions("__conv", *first, F.col("__turn").asc_nulls_first(), "__role", "__digest")


class _Faults:
    """What a conversation's rows say, taken in order: counts of faults, and a letter a row for the search."""

    def __init__(self) -> None:
        self.letters: list[str] = []
        self.seen: set[tuple[str, bytes]] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.before = None

    def take(self, turn: int | None, role: str, digest: bytes, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1
        initial = role[0] if role[:1] in ("s", "u", "a") else "o"
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if fault == "b":
            self.blank += 1
            self.letters.append("x")
        elif (role, digest) in self.seen:
            self.duplicate += 1
            self.letters.append("x")
        else:
            self.truncated += fault == "t"
            self.letters.append(initial.upper() if fault == "t" else initial)
        self.seen.add((role, digest))

    def told(self) -> tuple:
        rows = "".join(self.letters)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *(_short(rows) if len(rows) <= 40 else cheapest(rows)))


TOLD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
_PLAN = "__conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"audit": pa.string(), "repaired_sha256": pa.string(), "role": pa.string(), "text": pa.string(), "edit": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows), strict=True)], list(names))


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans of conversations whose rows (id, turn, role, digest, fault) come in order."""
    at, now, done = None, None, []
    for batch in batches:
        for conv, turn, role, digest, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != at:
                if now is not None:
                    done.append((at, *now.told()))
                at, now = conv, _Faults()
            now.take(turn, role, digest, fault)
        if done:
            yield _batch(done, ("__conv", *TOLD))
            done = []
    if now is not None:
        yield _batch([(at, *now.told())], ("__conv", *TOLD))


def repair_plans(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``turns``.

    Rows go by turn, null turns first; rows of one turn by role, then by the digest of the
    text.  A row's first fault counts: blank (nothing but white space), duplicate (role and
    text of an earlier row), truncated (its last character besides white space isn't one of
    ``.!?``).  Blank and duplicate rows must be deleted; a truncated row that stays costs 5.
    Keeping a row costs 0, renaming its role to user or assistant 1, deleting it 2, a new
    empty row 5.  gaps counts the turns between the first and the last that no row has, null
    turns aside; illegal counts the neighbours whose role initials aren't su, ua or au.

    Null roles and texts are one space, so such a text is blank and such a role illegal, as
    is an empty one.  Rows of a null id are one conversation; repeated rows are duplicates;
    other columns are not read; an empty table gives an empty result.

    What is shuffled of a row is its role and a digest; a task holds one letter and one
    digest for each row of the conversation at hand.
    """
    text = F.rtrim(F.col("__text"), F.lit(BLANKS))
    fault = F.when(text == "", "b").when(F.right(text, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t")
    rows = _rows(turns, id_col, turn_col, role_col, text_col).select("__conv", "__turn", "__role", "__digest", fault.alias("__fault"))
    return _in_order(rows).mapInArrow(_plans, _PLAN).withColumnRenamed("__conv", id_col)


class _Walk:
    """A conversation's repaired rows, given its audit at first and its rows one by one."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, ""

    def _made(self, role: str) -> str:
        self.state = role[:1]
        return role

    def new_rows(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the new rows that stand here."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._made(NAMES[NEXT[self.state]]), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.new_rows()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._made(NAMES[NEXT[self.state]]), text
        elif edit == "K":
            yield edit, self._made(role), text


def _merged(turns: DataFrame, plans: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Each conversation's plan and then its rows in order, as (id, what the plan tells..., role, text)."""
    rows = _rows(turns, id_col, turn_col, role_col, text_col)
    both = rows.unionByName(plans.withColumnRenamed(id_col, "__conv"), allowMissingColumns=True)
    return _in_order(both, F.col("audit").isNull()).select("__conv", *TOLD, "__role", "__text")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, list[tuple[str, str, str]]]]:
    """(plan, its first rows) where a conversation begins, then (None, more rows) until the next one."""
    walk = None
    for batch in batches:
        for conv, *told, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if told[-1] is not None:
                if walk is not None:
                    yield None, list(walk.new_rows())
                walk = _Walk(told[-1])
                yield (conv, *told), []
            else:
                yield None, list(walk.row(role, text))
    if walk is not None:
        yield None, list(walk.new_rows())


def repaired_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, position, edit, role, text) of every conversation after its cheapest repair.

    edit is K (kept), R (a new role) or I (a new, empty row).  Conversations of which nothing
    stays have no row.  See :func:`repair_plans` for order, nulls and ties.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv, at, size = [], None, 0, 0
        for plan, some in _walked(batches):
            if plan is not None:
                conv, at = plan[0], 0
            for edit, role, text in some:
                done.append((conv, at, edit, role, text))
                at, size = at + 1, size + len(text)
            if len(done) >= 1000 or size > 1_000_000:
                yield _batch(done, ("__conv", "position", "edit", "role", "text"))
                done, size = [], 0
        if done:
            yield _batch(done, ("__conv", "position", "edit", "role", "text"))

    both = _merged(turns, repair_plans(turns, id_col, turn_col, role_col, text_col), id_col, turn_col, role_col, text_col)
    return both.mapInArrow(rows, "__conv long, position long, edit string, role string, text string").withColumnRenamed("__conv", id_col)


def repair_digests(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Plans of :func:`repair_plans` and repaired_sha256, the digest of the repaired rows as ``role:text``, one a line."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, sha, empty = [], None, None, True
        for plan, some in _walked(batches):
            if plan is not None:
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha, empty = plan, hashlib.sha256(), True
                if len(done) >= 1000:
                    yield _batch(done, ("__conv", *TOLD, "repaired_sha256"))
                    done = []
            for _, role, text in some:
                sha.update((role + ":" + text if empty else "\n" + role + ":" + text).encode())
                empty = False
        if now is not None:
            done.append((*now, sha.hexdigest()))
            yield _batch(done, ("__conv", *TOLD, "repaired_sha256"))

    both = _merged(turns, repair_plans(turns, id_col, turn_col, role_col, text_col), id_col, turn_col, role_col, text_col)
    return both.mapInArrow(digests, _PLAN + ", repaired_sha256 string").withColumnRenamed("__conv", id_col)


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` after damage drawn by id and turn: rows lost, emptied, without ends of sentences, doubled, or of role user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("__copy")).drop("__copy")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired rows of every conversation, after :func:`damaged`."""
    ids = turns.select(F.col("conv_id").alias("__id")).distinct()
    told = repair_digests(damaged(turns))
    out = ids.join(told, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in TOLD[:-1]]
    return out.select(F.col("__id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
