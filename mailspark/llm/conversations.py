"""Repair of conversation structure by a suffix-shared automaton.

A conversation is a signature, one letter per row: ``d`` must be deleted (blank
or duplicate), else the role's initial class (``s u a x``), in capitals where
the text is truncated. Signatures are cut into pieces of at most PIECE letters,
and each distinct piece is treated once, whatever number of conversations holds
it: sorted by their reverse, pieces that end alike meet in one task and share
the nodes of their common suffixes. A node has, for each grammar state before
it and each state after it, the least cost to go, the first edit of the best
audit and the order of the audits. Edits from one state start with different
letters, so the ASCII-least of the cheapest audits is found letter by letter.

Costs of pieces compose like matrices over (min, +), so a conversation of any
length is a scan over its pieces: backwards for the costs to go, forwards for
the states. Rows are range partitioned to be cut into pieces, and the scan
holds one piece at a time. The one step that reads a conversation's texts in a
single task is the digest of its repaired text, since SHA-256 goes byte after
byte; it streams them in order and holds one row.

Defined results: null ``role`` and ``text`` (and ``conv_id`` and ``turn`` in the
damage's key) count as one space; a null ``conv_id`` is a conversation of its
own; null turns come first; rows of one turn follow by the SHA-256 of
``role:text``; repeated rows are duplicates of the first; a role of no letters,
or of another initial, can only be changed or deleted; conversations without
rows left have zeros and the empty digest; an empty table gives an empty table;
other columns do not enter.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage

PIECE = 128
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# Grammar (s?(ua)+)?: what a state is after, and where each initial leads.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}     # the initial an insert or a rerole gives
ROLES = {"u": "user", "a": "assistant"}
NEXT = [AFTER[s, WANTED[s]] for s in range(4)]
TAIL = ["", "II", "I", ""]                                        # inserts that end a conversation
FAR = 1 << 40


def _node(letter: str, rest: tuple) -> tuple:
    """``cost, edit, order`` of one letter before the suffix ``rest``.

    ``cost[e][f]``: least cost from state e to leave in state f. ``edit[e][f]``:
    first letter of the least of the cheapest audits. ``order[e]``: the reachable
    f by that audit, ascending.
    """
    cost0, _, order0 = rest
    truncated = letter.isupper()
    steps: list[list[tuple]] = []       # per state: (edit, cost, state after the row)
    for e in range(4):
        options = [("D", DELETE, e)]
        if letter != "d":
            kept = AFTER.get((e, letter.lower()))
            if kept is not None:
                options.append(("K", KEEP + TRUNCATED * truncated, kept))
            options.append(("R", REROLE + TRUNCATED * truncated, NEXT[e]))
        steps.append(options)
    # an insert leads to the next state before the same row; three lead round to where they began
    cost = [[min(c + cost0[g][f] for _, c, g in steps[e]) for f in range(4)] for e in range(4)]
    for _ in range(3):
        cost = [[min(cost[e][f], INSERT + cost[NEXT[e]][f]) for f in range(4)] for e in range(4)]
    edit = [[""] * 4 for _ in range(4)]
    for e in range(4):
        for f in range(4):
            if cost[e][f] < FAR:
                found = [a for a, c, g in steps[e] if c + cost0[g][f] == cost[e][f]]
                if INSERT + cost[NEXT[e]][f] == cost[e][f]:
                    found.append("I")
                edit[e][f] = min(found)
    return cost, edit, _order(cost, edit, steps, order0)


def _order(cost, edit, steps, order0):
    after = [{a: g for a, _, g in options} for options in steps]

    def rank(e, f):
        """Sorts the audits from e: its edits before the row's own, that one, then the rest's place."""
        letters, g = [], e
        while edit[g][f] == "I":
            letters.append("I")
            g = NEXT[g]
        letters.append(edit[g][f])
        g = after[g][edit[g][f]]
        return "".join(letters), order0[g].index(f)
    return [sorted((f for f in range(4) if cost[e][f] < FAR), key=lambda f: rank(e, f)) for e in range(4)]


END = ([[0 if e == f else FAR for f in range(4)] for e in range(4)], None, [[e] for e in range(4)])


class Automaton:
    """Suffixes seen so far. Signatures given in the order of their reverse
    share the nodes of common suffixes; only the current path is held."""

    def __init__(self):
        self.signature, self.path, self.made = "", [END], 0

    def read(self, signature: str) -> list[tuple]:
        """The nodes of the signature's suffixes, shortest first."""
        old, new = self.signature[::-1], signature[::-1]
        same = 0
        while same < len(old) and same < len(new) and old[same] == new[same]:
            same += 1
        del self.path[same + 1:]
        for letter in new[same:]:
            self.path.append(_node(letter, self.path[-1]))
            self.made += 1
        self.signature = signature
        return self.path

    def audit(self, signature: str, e: int, f: int) -> str | None:
        """The best audit from state e to state f; None if there is none."""
        path = self.read(signature)
        if path[-1][0][e][f] >= FAR:
            return None
        letters = []
        for at, letter in enumerate(signature):
            edit = path[len(signature) - at][1]
            while edit[e][f] == "I":
                letters.append("I")
                e = NEXT[e]
            a = edit[e][f]
            letters.append(a)
            e = AFTER[e, letter.lower()] if a == "K" else NEXT[e] if a == "R" else e
        return "".join(letters)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``summary`` (costs, then ranks, as 16-bit numbers) and the 16 ``audits`` of each distinct piece."""
    automaton = Automaton()
    for batch in batches:
        pieces = batch.column("piece").to_pylist()
        packed, audits = [], []
        for piece in pieces:
            cost, _, order = automaton.read(piece)[-1]
            ranks = [[order[e].index(f) if f in order[e] else 9 for f in range(4)] for e in range(4)]
            packed.append(np.minimum(np.array([cost, ranks]), 0x7FFF).astype(np.int16).tobytes())
            audits.append([automaton.audit(piece, e, f) for e in range(4) for f in range(4)])
        yield pa.RecordBatch.from_pydict({"piece": pa.array(pieces, pa.string()), "summary": pa.array(packed, pa.binary()),
                                          "audits": pa.array(audits, pa.list_(pa.string()))})


def _unpacked(summary: bytes) -> tuple[list, list]:
    cost, ranks = np.frombuffer(summary, np.int16).reshape(2, 4, 4).tolist()
    return [[c if c < 0x7FFF else FAR for c in row] for row in cost], ranks


def damage_sql() -> str:
    """0 to 19 by the row's key."""
    return "crc32(concat(coalesce(cast(conv_id AS string), ' '), ':', coalesce(cast(turn AS string), ' '))) % 20"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` of ``conversations`` as the contract
    damages them; dropped rows stay as markers of no copies."""
    return (rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), F.expr(damage_sql()).alias("_hit"))
            .select("conv_id", "turn",
                    F.expr("CASE _hit WHEN 4 THEN 'user' ELSE role END").alias("role"),
                    F.expr("CASE _hit WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END")
                    .alias("text"),
                    F.expr("CASE _hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END").alias("copies")))


def _featured(rows: DataFrame) -> DataFrame:
    """Adds ``digest`` (of role and text) and ``letter``, ``d`` for blank texts."""
    letter = ("CASE WHEN NOT text RLIKE '[^ \\\\t-\\\\r]' THEN 'd' "
              "WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END")
    truncated = "NOT text RLIKE '[.!?][ \\\\t-\\\\r]*\\\\z'"
    return (rows.withColumn("digest", F.unhex(F.sha2(F.concat("role", F.lit(":"), "text"), 256)))
            .withColumn("_letter", F.expr(letter))
            .withColumn("letter", F.expr(f"CASE WHEN _letter <> 'd' AND {truncated} THEN upper(_letter) ELSE _letter END"))
            .drop("_letter"))


def _pieces(size: int):
    """Cuts sorted rows ``conv_id, turn, digest, letter, copies, later`` into pieces.

    ``number`` orders a conversation's pieces within the partition. Of copies
    the first keeps its letter unless an earlier turn has the row too.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"conv": None, "number": 0, "letters": [], "n": 0, "turn": None, "digest": None, "any": False}
        out: list[tuple] = []

        def flush():
            if state["n"]:
                out.append((state["conv"], state["number"], state["turn"], state["digest"], "".join(state["letters"])))
                state["number"] += 1
                state["letters"], state["n"] = [], 0

        def batch_of():
            columns = list(zip(*out)) if out else [[]] * 5
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              names=["conv_id", "number", "turn", "digest", "piece"])

        for batch in batches:
            c = batch.to_pydict()
            for conv, turn, digest, letter, copies, later in zip(c["conv_id"], c["turn"], c["digest"], c["letter"],
                                                                 c["copies"], c["later"]):
                if not state["any"] or conv != state["conv"]:
                    flush()
                    state.update(conv=conv, number=0, any=True)
                first = "d" if later else letter
                while copies:
                    if not state["n"]:
                        state.update(turn=turn, digest=digest)
                    take = min(copies, size - state["n"])
                    state["letters"].append(first + "d" * (take - 1))
                    state["n"] += take
                    copies -= take
                    first = "d"
                    if state["n"] == size:
                        flush()
                    if len(out) >= 10_000:
                        yield batch_of()
            if out:
                yield batch_of()
        flush()
        yield batch_of()
    return run


_PIECES = "conv_id bigint, number bigint, turn bigint, digest binary, piece string"


def _to_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backward scan, pieces of a conversation last first: adds ``after``, the cost
    to go from each state behind the piece."""
    conv, begun, vector = None, False, None
    for batch in batches:
        after = []
        for c, summary in zip(batch.column("conv_id").to_pylist(), batch.column("summary").to_pylist()):
            if not begun or c != conv:
                conv, begun, vector = c, True, [INSERT * len(t) for t in TAIL]
            after.append(vector)
            cost, _ = _unpacked(summary)
            vector = [min(cost[e][f] + vector[f] for f in range(4)) for e in range(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(after, pa.list_(pa.int64()))],
                                         names=[*batch.schema.names, "after"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forward scan: adds ``way``, which of the piece's 16 audits is taken."""
    conv, begun, e = None, False, EMPTY
    for batch in batches:
        ways = []
        for c, summary, after in zip(batch.column("conv_id").to_pylist(), batch.column("summary").to_pylist(),
                                     batch.column("after").to_pylist()):
            if not begun or c != conv:
                conv, begun, e = c, True, EMPTY
            cost, ranks = _unpacked(summary)
            f = min(range(4), key=lambda f: (cost[e][f] + after[f], ranks[e][f]))
            ways.append(4 * e + f)
            e = f
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, pa.int32())],
                                         names=[*batch.schema.names, "way"])


_AT = "conv_id bigint, part int, number bigint, turn bigint, digest binary, piece string, summary binary"


def audited_pieces(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """``conv_id, turn, digest, number, piece, audit`` of the pieces of ``rows``
    (of :func:`_featured`); turn and digest are those of the first row."""
    held = stage(rows.filter("copies > 0").groupBy("conv_id", "turn", "digest", "letter")
                 .agg(F.sum("copies").alias("copies")), "letters")
    turn = F.struct("turn")     # in a struct nulls come first
    seen = (held.groupBy("conv_id", "digest").agg(F.min(turn).alias("a"), F.max(turn).alias("b")).filter("a < b")
            .select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), F.col("a.turn").alias("_turn")))
    marked = held.join(seen, held["conv_id"].eqNullSafe(seen["_conv"]) & (held["digest"] == seen["_digest"]), "left")
    marked = marked.select("conv_id", "turn", "digest", "letter", "copies", (
        F.col("_digest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))).alias("later"))
    order = ["conv_id", "turn", "digest"]
    pieces = stage(stage(marked, "marked").repartitionByRange(*order).sortWithinPartitions(*order)
                   .mapInArrow(_pieces(size), _PIECES).withColumn("part", F.spark_partition_id()), "pieces")
    known = stage(pieces.select("piece").distinct().withColumn("_back", F.reverse("piece"))
                  .repartitionByRange("_back").sortWithinPartitions("_back").select("piece")
                  .mapInArrow(_summaries, "piece string, summary binary, audits array<string>"), "automaton")
    at = pieces.join(known.select("piece", "summary"), "piece").select(*[c.split()[0] for c in _AT.split(", ")])
    back = (at.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("number"))
            .mapInArrow(_to_go, _AT + ", after array<bigint>"))
    ways = (back.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
            .mapInArrow(_states, _AT + ", after array<bigint>, way int"))
    audits = known.select("piece", F.posexplode("audits").alias("way", "audit"))
    return ways.join(audits, ["piece", "way"]).select("conv_id", "turn", "digest", "part", "number", "piece", "audit")


_REPAIRED = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
             "cost bigint, audit string, repaired_sha256 string")
_KINDS = [pa.int64()] * 7 + [pa.string()] * 2


class _Conversation:
    """Running counts of one conversation, and its repaired lines."""

    def __init__(self, conv, emit):
        self.conv, self.emit = conv, emit
        self.turns, self.low, self.high, self.last_turn = 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.before, self.state, self.lines = None, EMPTY, 0
        self.audit: list[str] = []
        self.sha = hashlib.sha256()
        self.waiting: list[tuple[str, str]] = []
        self.piece = self.edits = iter(())
        self.left = 0

    def line(self, role: str, text: str, edit: str) -> None:
        if self.lines:
            self.sha.update(b"\n")
        self.sha.update(f"{role}:{text}".encode("utf-8", "replace"))
        if self.emit is not None:
            self.emit.append((self.conv, self.lines, role, text, edit))
        self.lines += 1

    def insert(self) -> None:
        wanted = WANTED[self.state]
        self.line(ROLES[wanted], "", "insert")
        self.state, self.cost = AFTER[self.state, wanted], self.cost + INSERT

    def row(self, turn, role: str, text: str) -> None:
        if not self.left:
            piece, audit = self.waiting.pop(0)
            self.left, self.piece, self.edits = len(piece), iter(piece), iter(audit)
            self.audit.append(audit)
        self.left -= 1
        letter = next(self.piece)
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn, self.high = self.turns + 1, turn, turn
            self.low = turn if self.low is None else self.low
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if letter == "d":
            blank = not text.encode("utf-8", "replace").strip()
            self.blank, self.duplicate = self.blank + blank, self.duplicate + (not blank)
        self.truncated += letter.isupper()
        edit = next(self.edits)
        while edit == "I":
            self.insert()
            edit = next(self.edits)
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += letter.isupper() * TRUNCATED
        if edit == "R":
            role, self.cost = ROLES[WANTED[self.state]], self.cost + REROLE
        self.state = AFTER[self.state, role[:1]]
        self.line(role, text, "rerole" if edit == "R" else "keep")

    def result(self) -> tuple:
        self.audit.append(TAIL[self.state])
        for _ in TAIL[self.state]:
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit), self.sha.hexdigest())


def _applied(as_rows: bool):
    """Streams rows and audits in order; gives one row per conversation, or the
    repaired rows."""
    names = "conv_id position role text edit".split() if as_rows else [c.split()[0] for c in _REPAIRED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] if as_rows else _KINDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[tuple] | None = [] if as_rows else None
        current: _Conversation | None = None
        done: list[tuple] = []

        def batch_of(rows):
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            c = batch.to_pydict()
            for conv, turn, role, text, copies, piece, audit in zip(*(c[k] for k in (
                    "conv_id", "turn", "role", "text", "copies", "piece", "audit"))):
                if current is None or current.conv != conv:
                    if current is not None:
                        done.append(current.result())
                    current = _Conversation(conv, lines)
                if piece is not None:
                    current.waiting.append((piece, audit))
                    continue
                for _ in range(copies):
                    current.row(turn, role, text)
            rows = lines if as_rows else done
            if rows:
                yield batch_of(rows)
                rows.clear()
            done.clear()
        if current is not None:
            done.append(current.result())
            yield batch_of(lines if as_rows else done)
    return run


def _streamed(damaged_rows: DataFrame, size: int) -> DataFrame:
    rows = _featured(damaged_rows)
    pieces = audited_pieces(rows, size)
    both = (rows.select("conv_id", "turn", "digest", F.lit(1).alias("kind"), F.lit(0).alias("part"),
                        F.lit(0).cast("bigint").alias("number"), "role", "text", F.col("copies").cast("int").alias("copies"),
                        F.lit(None).cast("string").alias("piece"), F.lit(None).cast("string").alias("audit"))
            .unionByName(pieces.select("conv_id", "turn", "digest", F.lit(0).alias("kind"), "part", "number",
                                       F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                                       F.lit(0).alias("copies"), "piece", "audit")))
    return (both.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest", "kind", "part", "number")
            .select("conv_id", "turn", "role", "text", "copies", "piece", "audit"))


def repair(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """One row per conversation: faults, cost, audit and digest. ``rows``:
    ``conv_id, turn, role, text, copies`` as from :func:`damaged` (0 copies mark
    a conversation only)."""
    return _streamed(rows, size).mapInArrow(_applied(False), _REPAIRED)


def repaired_rows(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """``conv_id, position, role, text, edit`` (keep, rerole or insert) of the
    repaired conversations."""
    return _streamed(rows, size).mapInArrow(
        _applied(True), "conv_id bigint, position bigint, role string, text string, edit string")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns for ``conversations``, damaged first."""
    return repair(damaged(conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")))
