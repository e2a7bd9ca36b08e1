"""Repair of conversations by generalised LR parsing of their roles, with weighted edits.

A conversation should be `(s?(ua)+)?` in initials of roles: perhaps a system row, then pairs of a user and
an assistant row, or nothing at all. As an LR grammar:

    dialogue -> (empty) | pairs | s pairs        pairs -> pair | pairs pair        pair -> u a

A row may be kept (0), given the role user or assistant (3) or deleted (4); an empty user or assistant row may
be inserted anywhere (3). Blank rows and repeats of role and text must be deleted; a truncated row that stays
costs 3 more. The parser reads a row at a time and holds a graph-structured stack. Its tops are the LR
states: START, S (behind `s`), U (behind `u`) and PAIRS (after an `a` the reductions to pair and pairs are due
whatever lies below). What may follow depends on the top alone, so equal tops merge and the least
(cost, audit) stays. The audit spells the edits: D, I, K, R, in the order of the rows.

Audits of two tops that have read the same rows are never each other's beginnings (each ends with the letter
of the last row, and has one such letter a row), so comparing them ends where they first differ, whatever is
appended. Hence tops hold only their audit's rank and a trail back, and a row costs the same however many
came before it.

Rows are aggregated where all their fields are equal, and range-partitioned by conversation, turn,
role and text, so a conversation of any size is spread over many tasks. A conversation that lies in one task is
parsed there in a single pass. One that crosses a border of partitions (two a partition at most) is parsed in
segments, each from all four tops as the row before might have left them; the segments' costs and audits are
combined afterwards. A digest is taken from such a conversation's rows in order, as a stream.

Fields that are null count as one space in texts, roles and names; null turns come first and count in no gap.
Equal turns are ordered by role, then text. A null conv_id is a conversation of its own. Rows that
repeat count each, and are duplicates from the second on. Conversations without rows after damage have zeros, an
empty audit and the empty text's digest. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.memory import give_back
from rankweave.llm.shared import materialised

START, S, U, PAIRS = range(4)
#: What a terminal of the grammar leads to, by stack top.
SHIFT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (PAIRS, "u"): U, (U, "a"): PAIRS}
ACCEPTED = (START, PAIRS)
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAULTS = ("blank", "duplicate", "truncated")
_SPACE = "\\x20\\x09-\\x0D"
_STEP = re.compile("I*[DKR]")


def _insertions() -> dict[int, list[tuple[int, str]]]:
    """For each top, the tops that insertions lead to, and the letters inserted."""
    found: dict[int, list[tuple[int, str]]] = {}
    for top in range(4):
        reached, frontier = {top: ""}, [top]
        while frontier:
            at = frontier.pop(0)
            for letter in ROLES:
                to = SHIFT.get((at, letter))
                if to is not None and to not in reached:
                    reached[to] = reached[at] + letter
                    frontier.append(to)
        found[top] = sorted(reached.items(), key=lambda x: (len(x[1]), x[0]))
    return found


INSERTIONS = _insertions()


def _moves() -> dict[tuple[str, bool], list[list[tuple[int, int, str, str]]]]:
    """For a row's initial ('s', 'u', 'a' or '') and whether it must go: per top, (next top, cost without
    truncation, letters inserted before, edit)."""
    table = {}
    for initial in ("s", "u", "a", ""):
        for must in (False, True):
            rows = []
            for top in range(4):
                moves = []
                for at, inserted in INSERTIONS[top]:
                    cost = INSERT * len(inserted)
                    moves.append((at, cost + DELETE, inserted, "D"))
                    if not must:
                        if (at, initial) in SHIFT:
                            moves.append((SHIFT[at, initial], cost, inserted, "K"))
                        moves.extend((SHIFT[at, to], cost + REROLE, inserted, "R") for to in ROLES if (at, to) in SHIFT)
                rows.append(moves)
            table[initial, must] = rows
    return table


_MOVES = _moves()


class Stack:
    """Merged stack tops of one conversation or segment: by top (cost, rank of the audit, trail, digest or None)."""

    def __init__(self, top: int, digest: bool) -> None:
        self.tops: dict[int, tuple] = {top: (0, 0, None, hashlib.sha256() if digest else None)}

    def read(self, role: str, text: str, fault: str) -> None:
        """One row more."""
        initial, stays = role[:1], TRUNCATED if fault == "truncated" else 0
        moves = _MOVES[initial if initial in "sua" else "", fault in ("blank", "duplicate")]
        best: dict[int, tuple] = {}
        for top, (cost, rank, _, _) in self.tops.items():
            for to, more, inserted, edit in moves[top]:
                found = (cost + more + (stays if edit != "D" else 0), rank, "I" * len(inserted) + edit, top, inserted)
                if to not in best or found[:3] < best[to][:3]:
                    best[to] = found
        order = {key: k for k, key in enumerate(sorted({(b[1], b[2]) for b in best.values()}))}
        after = {}
        for to, (cost, rank, step, top, inserted) in best.items():
            _, _, trail, digest = self.tops[top]
            if digest is not None:
                digest = _extended(digest, top, inserted, step[-1], role, text)
            after[to] = (cost, order[rank, step], (trail, step), digest)
        self.tops = after

    def ends(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the best accepted stack."""
        best = None
        for top, (cost, rank, trail, digest) in self.tops.items():
            for to, inserted in INSERTIONS[top]:
                if to in ACCEPTED and (best is None or (cost + INSERT * len(inserted), rank, "I" * len(inserted)) < best[:3]):
                    best = (cost + INSERT * len(inserted), rank, "I" * len(inserted), trail, _extended(digest, top, inserted, "D", "", ""))
        return best[0], _audit(best[3]) + best[2], best[4].hexdigest()

    def exits(self) -> dict[int, tuple[int, str]]:
        """Cost and audit by top."""
        return {top: (cost, _audit(trail)) for top, (cost, _, trail, _) in self.tops.items()}


def _audit(trail: tuple | None) -> str:
    steps = []
    while trail is not None:
        trail, step = trail
        steps.append(step)
    return "".join(reversed(steps))


def _lines(top: int, inserted: str, edit: str, role: str, text: str) -> tuple[int, list[tuple[str, str]]]:
    """The top after a step, and the (role, text) that it puts out."""
    out = []
    for letter in inserted:
        out.append((ROLES[letter], ""))
        top = SHIFT[top, letter]
    if edit != "D":
        letter = role[:1] if edit == "K" else "a" if top == U else "u"
        out.append((role if edit == "K" else ROLES[letter], text))
        top = SHIFT[top, letter]
    return top, out


def _extended(digest, top: int, inserted: str, edit: str, role: str, text: str):
    """A copy of a digest with what a step puts out; only a stack at START has put out nothing yet."""
    if not inserted and edit == "D":
        return digest  # digests are copied before they change
    lines = _lines(top, inserted, edit, role, text)[1]
    digest = digest.copy()
    digest.update(("\n" * (top != START) + "\n".join(f"{r}:{t}" for r, t in lines)).encode("utf-8", "surrogatepass"))
    return digest


class Replay:
    """Puts out the rows that an audit makes of a conversation's rows, a row at a time."""

    def __init__(self, audit: str) -> None:
        self.audit, self.steps, self.top, self.at = audit, _STEP.finditer(audit), START, 0

    def read(self, role: str, text: str) -> list[tuple[str, str]]:
        step = next(self.steps)
        self.at = step.end()
        self.top, lines = _lines(self.top, _inserted(self.top, step.end() - step.start() - 1), step[0][-1], role, text)
        return lines

    def ends(self) -> list[tuple[str, str]]:
        return _lines(self.top, _inserted(self.top, len(self.audit) - self.at), "D", "", "")[1]


def _inserted(top: int, count: int) -> str:
    """The letters of so many insertions: only one row fits behind each top, a user's where there is a choice."""
    letters = ""
    for _ in range(count):
        letter = "a" if top == U else "u"
        letters += letter
        top = SHIFT[top, letter]
    return letters


class _Counts:
    """What a conversation's or a segment's rows count."""

    def __init__(self) -> None:
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def read(self, turn: int | None, role: str, fault: str, copies: int) -> None:
        if fault:
            self.faults[fault] += 1
            self.faults["duplicate" if fault != "blank" else "blank"] += copies - 1
        else:
            self.faults["duplicate"] += copies - 1
        own = role[:1]
        self.illegal += (self.last is not None and self.last + own not in ("su", "ua", "au")) + (copies - 1) * (own + own not in ("su", "ua", "au"))
        self.first, self.last = own if self.first is None else self.first, own
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def add(self, other: dict) -> None:
        """A later segment's counts, as stored."""
        for f in FAULTS:
            self.faults[f] += other[f]
        if other["first"] is not None:
            self.illegal += other["illegal"] + (self.last is not None and self.last + other["first"] not in ("su", "ua", "au"))
            self.first, self.last = other["first"] if self.first is None else self.first, other["last"]
        if other["low"] is not None:
            self.turns += other["turns"] - (other["low"] == self.high)
            self.low, self.high = other["low"] if self.low is None else self.low, other["high"]

    def values(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.faults, "illegal": self.illegal}

    def stored(self) -> dict:
        return {**self.faults, "illegal": self.illegal, "first": self.first, "last": self.last, "low": self.low, "high": self.high, "turns": self.turns}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies: rows with faults put in by crc32 of `conv_id:turn`, modulo 20. 0 drops
    a row (copies 0), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes its role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _blank(text: Column) -> Column:
    return ~text.rlike(f"[^{_SPACE}]")


def with_faults(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text, copies) with the fault of the first copy, '' for none. A row is a
    duplicate where an earlier turn has its role and text; further copies are too, unless they are blank."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    key = F.struct("conv_id", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("2"), "text", "role").alias("h2")).alias("key")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = same.where("copies > 0").select(key, place.alias("place")).groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    joined = same.select("*", key).join(seen.select("key", "first"), "key", "left")
    fault = F.when(_blank(F.col("text")), "blank").when(place > F.col("first"), "duplicate").when(~F.col("text").rlike(f"[.!?][{_SPACE}]*\\z"), "truncated").otherwise("")
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _order(*more: str) -> list:
    return [F.col("conv_id").asc_nulls_first(), *more, F.col("turn").asc_nulls_first(), "role", "text"]


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in ranges of conversations, turns, roles and beginnings of texts, sorted."""
    ranged = rows.repartitionByRange(*_order()[:-1], F.substring("text", 1, 64))
    return ranged.sortWithinPartitions(*_order())


_COUNTED = ("gaps", *FAULTS, "illegal")


def _verdict_kinds(conv: pa.DataType) -> list[tuple[str, pa.DataType]]:
    return [("conv_id", conv), *((c, pa.int64()) for c in (*_COUNTED, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _parsed_kinds(conv: pa.DataType) -> list[tuple[str, pa.DataType]]:
    """A task puts out verdicts of whole conversations, and segments of others."""
    counts = pa.struct([*((c, pa.int64()) for c in (*FAULTS, "illegal")), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())])
    exits = pa.list_(pa.struct([("entry", pa.int32()), ("top", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    return [*_verdict_kinds(conv), ("seg", pa.int32()), ("counts", counts), ("exits", exits)]


def _through(rows: DataFrame, work, kinds) -> DataFrame:
    """mapInArrow of a generator of dicts over dicts; `kinds` gives the fields for the type of conv_id."""
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

    schema = pa.schema(kinds(to_arrow_type(rows.schema["conv_id"].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for row in work(row for batch in batches for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist()):
            out.append({n: row.get(n) for n in schema.names})
            chars += len(row.get("audit") or "") + len(row.get("text") or "")
            if len(out) >= 4096 or chars >= 1 << 22:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
        give_back()

    return rows.mapInArrow(run, from_arrow_schema(schema))


def _parse(rows: Iterator[dict]) -> Iterator[dict]:
    """Parses a partition of sorted rows. Only its first conversation may have begun before it, and only
    its last one may go on behind it; these two become segments."""
    from pyspark import TaskContext

    seg, began = TaskContext.get().partitionId(), False
    conv, stacks, counts = None, [], _Counts()

    def segment() -> dict:
        exits = [{"entry": e, "top": t, "cost": c, "audit": a} for e, s in enumerate(stacks) for t, (c, a) in s.exits().items()]
        return {"conv_id": conv, "seg": seg, "counts": counts.stored(), "exits": exits}

    for row in rows:
        if not began or row["conv_id"] != conv:
            if len(stacks) > 1:
                yield segment()
            elif stacks:
                cost, audit, sha = stacks[0].ends()
                yield {"conv_id": conv, **counts.values(), "cost": cost, "audit": audit, "repaired_sha256": sha}
            stacks = [Stack(START, True)] if began else [Stack(top, False) for top in range(4)]
            began, conv, counts = True, row["conv_id"], _Counts()
        if row["copies"]:
            counts.read(row["turn"], row["role"], row["fault"], row["copies"])
        for k in range(row["copies"]):
            for stack in stacks:
                stack.read(row["role"], row["text"], "duplicate" if k else row["fault"])
    if began:
        yield segment()


def _by_conversation(rows: Iterator[dict]) -> Iterator[tuple[object, Iterator[dict]]]:
    for _, own in groupby(rows, key=lambda r: (r["conv_id"] is None, r["conv_id"])):
        first = next(own)
        yield first, own


def _combine(rows: Iterator[dict]) -> Iterator[dict]:
    """Verdicts, without digests, of conversations from their segments in order."""
    for first, more in _by_conversation(rows):
        tops, counts = {START: (0, ())}, _Counts()
        for segment in chain([first], more):
            counts.add(segment["counts"])
            after: dict[int, tuple] = {}
            for x in segment["exits"]:
                if x["entry"] in tops:
                    cost, pieces = tops[x["entry"]]
                    # Pieces that have read the same rows are never each other's beginnings, so tuples compare as texts do.
                    found = (cost + x["cost"], (*pieces, x["audit"]))
                    after[x["top"]] = min(after.get(x["top"], found), found)
            tops = after
        ends = [(cost + INSERT * len(ins), (*pieces, "I" * len(ins))) for top, (cost, pieces) in tops.items() for to, ins in INSERTIONS[top] if to in ACCEPTED]
        cost, pieces = min(ends)
        yield {"conv_id": first["conv_id"], **counts.values(), "cost": cost, "audit": "".join(pieces)}


def _replayed(rows: Iterator[dict]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """For each conversation its verdict, which comes before its rows, and the repaired rows, as a stream."""

    def lines(audit: str, own: Iterator[dict]) -> Iterator[tuple[str, str]]:
        replay = Replay(audit)
        for row in own:
            for _ in range(row["copies"]):
                yield from replay.read(row["role"], row["text"])
        yield from replay.ends()

    for verdict, own in _by_conversation(rows):
        yield verdict, lines(verdict["audit"], own)


def _digest(rows: Iterator[dict]) -> Iterator[dict]:
    for verdict, lines in _replayed(rows):
        sha = hashlib.sha256()
        for k, (role, text) in enumerate(lines):
            sha.update(("\n" * (k > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        yield verdict | {"repaired_sha256": sha.hexdigest()}


def _number(rows: Iterator[dict]) -> Iterator[dict]:
    for verdict, lines in _replayed(rows):
        for k, (role, text) in enumerate(lines):
            yield {"conv_id": verdict["conv_id"], "place": k, "role": role, "text": text}


def _with_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each conversation's verdict, and behind it its rows in order."""
    both = rows.withColumn("behind", F.lit(1)).unionByName(verdicts.withColumn("behind", F.lit(0)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*_order("behind"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of all
    conversations of (conv_id, turn, role, text, copies), and the rows they were made from, in the form that
    repaired_rows takes."""
    faulty = materialised(with_faults(rows))
    parsed = materialised(_through(_ordered(faulty), _parse, _parsed_kinds))
    segments = parsed.where("seg IS NOT NULL").select("conv_id", "seg", "counts", "exits")
    in_order = segments.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seg")
    cut = materialised(_through(in_order, _combine, lambda conv: _verdict_kinds(conv)[:-1]))
    # At most two conversations a partition are cut.
    ids = F.broadcast(cut.select(F.col("conv_id").alias("own")))
    theirs = faulty.join(ids, F.col("conv_id").eqNullSafe(F.col("own")), "left_semi")
    digested = _through(_with_verdicts(theirs, cut), _digest, _verdict_kinds)
    return parsed.where("seg IS NULL").drop("seg", "counts", "exits").unionByName(digested), faulty


def repaired_rows(faulty: DataFrame, verdicts: DataFrame) -> DataFrame:
    """conv_id, place, role and text of the repaired rows of all conversations."""
    kinds = lambda conv: [("conv_id", conv), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    return _through(_with_verdicts(faulty, verdicts.select("conv_id", "audit")), _number, kinds)
