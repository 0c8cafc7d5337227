"""Repair of the structure of conversations by Wagner-Fischer alignment.

A conversation is well formed if its roles' initials are ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn.
Its turns are aligned with the string of every feasible length; the cheapest edits win, and of equal costs the audit (the edits'
initials in order) that is least in ASCII.

1. Built-in columns give each turn a code (initial, fault) and a digest of role and text.  Only these are shuffled by conversation.
2. One matrix serves all lengths: row i, column r is the cost of aligning the turns from i on with the *last* r characters of the
   grammar string, which are the same for every length; a second one holds targets whose system turn is still to come.  Column r of row 0
   is the cost of the target of length r.
3. Rows are cut to Ukkonen's band: a cell stays only while its cost and the faults that turns before it must pay for are within the incumbent's cost,
   which a left-to-right repair gives.  A cell also goes if a target two turns shorter or longer is cheaper from there on, for
   what stands before it may be aligned with either.  So rows hold ties of the best lengths only, and long conversations stay narrow.
4. All lengths of the least cost are traced back together, letter by letter; those whose letter is not the least leave.
5. A second pass reads each conversation's audit, then its turns in order, and gives the repaired turns (or their digest) as a stream.

Memory of a task: 25 bytes a turn and the band of the longest conversation, never its texts.  A conversation's audit is one cell
and its SHA-256 one sequence, so one conversation is one task in both passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .streams import changes, whole_groups
from .tables import stored

# Fixed values of the rules
SPACES = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

_SYSTEM, _USER, _ASSISTANT, _OTHER = range(4)
_FINE, _CUT, _BAD = range(3)
_NEVER = 1 << 40


def damage(rows: DataFrame) -> DataFrame:
    """Turns damaged by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes its role user.  A null counts as one space."""
    def known(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    text, role = known("text"), known("role")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    times = F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("int")))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def _greedy(codes: np.ndarray) -> int:
    """Cost of the repair that goes from left to right and inserts what is missing: an upper bound."""
    cost, after = 0, None
    for code in codes.tolist():
        kind, fault = divmod(code, 3)
        if fault == _BAD:
            cost += DELETE
            continue
        cost += TRUNCATED if fault == _CUT else 0
        due = _ASSISTANT if after == _USER else _USER
        if kind == due or kind == _SYSTEM and after is None:
            after = kind
        elif kind in (_USER, _ASSISTANT):
            cost += INSERT
            after = kind
        else:
            cost += REROLE
            after = due
    return cost + (INSERT if after == _USER else 2 * INSERT if after == _SYSTEM else 0)


class _Row:
    """Costs of columns ``low`` on; every other column costs too much."""

    __slots__ = ("low", "cost")

    def __init__(self, low: int, cost: np.ndarray, most: int):
        live = np.flatnonzero(cost <= most)
        if len(live):
            self.low, self.cost = low + int(live[0]), cost[live[0] : live[-1] + 1].copy()
        else:
            self.low, self.cost = low, np.zeros(0, np.int64)

    def at(self, columns: np.ndarray) -> np.ndarray:
        out = np.full(len(columns), _NEVER)
        inside = (columns >= self.low) & (columns < self.low + len(self.cost))
        out[inside] = self.cost[columns[inside] - self.low]
        return out


def _only_least(low: int, cost: np.ndarray) -> np.ndarray:
    """Costs without those that another length of the same parity beats; column 0, where nothing is left of the target, stands alone."""
    start = 1 if low == 0 and len(cost) else 0
    for first in (start, start + 1):
        part = cost[first::2]
        if len(part):
            part[part > part.min()] = _NEVER
    return cost


@lru_cache(1 << 15)
def align(codes: bytes) -> tuple[int, str]:
    """Least cost and audit of a conversation whose turns have these codes (3 * initial + fault)."""
    turns = np.frombuffer(codes, dtype=np.uint8).astype(np.int64)
    n, (kind, fault) = len(turns), np.divmod(turns, 3)
    incumbent = _greedy(turns)
    forced = np.concatenate([[0], np.cumsum(np.where(fault == _BAD, DELETE, np.where(fault == _CUT, TRUNCATED, 0)))])
    rest: list[_Row] = [None] * (n + 1)  # the system turn has come, or never comes
    whole: list[_Row] = [None] * (n + 1)  # it is still to come
    most = incumbent - int(forced[n])
    rest[n], whole[n] = _Row(0, INSERT * np.arange(most // INSERT + 1), most), _Row(0, np.zeros(0, np.int64), most)
    for i in range(n - 1, -1, -1):
        most = incumbent - int(forced[i])
        below, late = rest[i + 1], whole[i + 1]
        cost = np.full(len(below.cost) + 1, _NEVER)
        cost[:-1] = below.cost + DELETE
        if fault[i] != _BAD:
            columns = np.arange(below.low + 1, below.low + len(cost))
            due = np.where(columns % 2 == 1, _ASSISTANT, _USER)
            cost[1:] = np.minimum(cost[1:], below.cost + np.where(due == kind[i], 0, REROLE) + (TRUNCATED if fault[i] == _CUT else 0))
        if len(below.cost):
            slope = INSERT * np.arange(len(cost))
            cost = np.minimum.accumulate(cost - slope) + slope
            more = max(0, (most - int(cost[-1])) // INSERT)
            cost = np.concatenate([cost, cost[-1] + INSERT * np.arange(1, more + 1)])
        rest[i] = _Row(below.low, _only_least(below.low, cost), most)
        low, high = below.low, below.low + len(below.cost)
        if len(late.cost):
            low, high = min(low, late.low), max(high, late.low + len(late.cost))
        columns = np.arange(low, high)
        cost = late.at(columns) + DELETE
        if kind[i] == _SYSTEM and fault[i] != _BAD:
            with_turn = below.at(columns) + (TRUNCATED if fault[i] == _CUT else 0)
            cost = np.minimum(cost, np.where((columns % 2 == 0) & (columns >= 2), with_turn, _NEVER))
        if len(cost):
            cost[cost > cost.min()] = _NEVER
        whole[i] = _Row(low, cost, most)

    open_r = np.arange(rest[0].low, rest[0].low + len(rest[0].cost))
    open_r = open_r[open_r % 2 == 0]
    open_w = np.arange(whole[0].low, whole[0].low + len(whole[0].cost))
    cost = int(min(rest[0].at(open_r).min(initial=_NEVER), whole[0].at(open_w).min(initial=_NEVER)))
    open_r, open_w = open_r[rest[0].at(open_r) == cost], open_w[whole[0].at(open_w) == cost]
    return cost, _trace(kind, fault, rest, whole, open_r, open_w, cost)


def _trace(kind, fault, rest: list[_Row], whole: list[_Row], open_r: np.ndarray, open_w: np.ndarray, left: int) -> str:
    """The least audit of all alignments of this cost that begin in the open columns; all of them share the letters so far."""
    audit, i, n, none = [], 0, len(kind), np.zeros(0, np.int64)
    while i < n or open_r.max(initial=0) > 0:
        if i < n:
            by_r, by_w = open_r[rest[i + 1].at(open_r) + DELETE == left], open_w[whole[i + 1].at(open_w) + DELETE == left]
            if len(by_r) or len(by_w):
                audit.append("D")
                open_r, open_w, i, left = by_r, by_w, i + 1, left - DELETE
                continue
        shorter = open_r[open_r > 0] - 1
        shorter = shorter[rest[i].at(shorter) + INSERT == left]
        if len(shorter):
            audit.append("I")
            open_r, open_w, left = shorter, none, left - INSERT
            continue
        extra = TRUNCATED if fault[i] == _CUT else 0
        keep = open_r[(open_r > 0) & (np.where(open_r % 2 == 1, _ASSISTANT, _USER) == kind[i])] - 1
        keep = keep[rest[i + 1].at(keep) + extra == left]
        if kind[i] == _SYSTEM:
            keep = np.union1d(keep, open_w[rest[i + 1].at(open_w) + extra == left])
        if len(keep):
            audit.append("K")
            open_r, left = keep, left - extra
        else:
            audit.append("R")
            open_r = open_r[open_r > 0] - 1
            open_r, left = open_r[rest[i + 1].at(open_r) + extra + REROLE == left], left - extra - REROLE
        open_w, i = none, i + 1
    return "".join(audit)


_AUDIT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches):
        table = table.combine_chunks()
        conv = table.column("conv").to_numpy(zero_copy_only=False)
        first = changes(conv)
        n, count = len(conv), np.diff(np.append(first, len(conv)))
        which = np.repeat(np.arange(len(first)), count)
        kind, state = (table.column(c).to_numpy() for c in ("kind", "state"))
        same = np.frombuffer(b"".join(table.column("same").to_pylist()), dtype=">u8").reshape(n, 2)
        order = np.lexsort((np.arange(n), same[:, 1], same[:, 0], which))
        new = np.zeros(n, dtype=bool)
        new[order[changes(which[order], same[order, 0], same[order, 1])]] = True
        blank = state == _BAD
        again = ~new & ~blank
        cut = (state == _CUT) & ~again
        inside = np.ones(n, dtype=bool)
        inside[first] = False
        before = np.concatenate([[_OTHER], kind[:-1]])
        legal = (before == _SYSTEM) & (kind == _USER) | (before == _USER) & (kind == _ASSISTANT) | (before == _ASSISTANT) & (kind == _USER)
        turn, known = table.column("turn").fill_null(0).to_numpy(), ~table.column("turn").is_null().to_numpy()
        codes = (3 * kind + np.where(blank | again, _BAD, np.where(cut, _CUT, _FINE))).astype(np.uint8)
        rows = []
        for a, m in zip(first.tolist(), count.tolist()):
            there = turn[a : a + m][known[a : a + m]]
            gaps = int(there[-1]) - int(there[0]) + 1 - len(changes(there)) if len(there) else 0
            rows.append((conv[a], gaps, *align(codes[a : a + m].tobytes())))
        sums = [np.add.reduceat(x.astype(np.int64), first) for x in (blank, again, cut, inside & ~legal)]
        names, gaps, cost, audit = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(gaps, pa.int64()), *map(pa.array, sums), pa.array(cost, pa.int64()), pa.array(audit)], ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _coded(turns: DataFrame) -> DataFrame:
    """Turns with what the passes sort and decide by; a null role or text counts as one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    initial = F.substring(role, 1, 1)
    ends = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    return turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("~")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"))).alias("same"),
        F.when(initial == "s", _SYSTEM).when(initial == "u", _USER).when(initial == "a", _ASSISTANT).otherwise(_OTHER).cast("int").alias("kind"),
        F.when(ends == "", _BAD).when(ends.isin(".", "!", "?"), _FINE).otherwise(_CUT).cast("int").alias("state"),
    ).withColumn("grp", F.xxhash64("conv"))


def _order(*more: str) -> list[Column | str]:
    return ["grp", "conv", *more, F.asc_nulls_first("turn"), "role", "same"]


def audits(turns: DataFrame) -> DataFrame:
    """Per conversation that has turns: conv (its key), the counts, cost and audit."""
    codes = _coded(turns).select("grp", "conv", "turn", "role", "same", "kind", "state")
    return codes.repartition("grp").sortWithinPartitions(*_order()).mapInArrow(_audits, _AUDIT)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str, str]]:
    """(conv, edit, role, text) of every repaired turn in order; each conversation begins with one whose edit is null."""
    names = ["conv", "audit", "role", "text"]
    conv, audit, at, after, last = None, "", 0, "", 0

    def inserted():
        nonlocal at, after
        while at < len(audit) and audit[at] == "I":
            role = "assistant" if after == "u" else "user"
            at, after = at + 1, role[0]
            yield conv, "I", role, ""

    for batch in batches:
        for name, plan, role, text in zip(*(batch.column(c).to_pylist() for c in names)):
            if plan is not None:
                conv, audit, at, after, last = name, plan, 0, "", len(plan.rstrip("I"))
                yield conv, None, "", ""
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                role = role if edit == "K" else "assistant" if after == "u" else "user"
                after = role[0]
                yield conv, edit, role, text
            if at == last:
                yield from inserted()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple[str, str]] = []
    now, hashed, first = None, None, True

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], ["conv", "repaired_sha256"])
        done.clear()
        return out

    for conv, edit, role, text in _turns(batches):
        if edit is None:
            if hashed is not None:
                done.append((now, hashed.hexdigest()))
            if len(done) >= 4096:
                yield batch()
            now, hashed, first = conv, hashlib.sha256(), True
            continue
        hashed.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    if hashed is not None:
        done.append((now, hashed.hexdigest()))
    yield batch()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    place, size = 0, 0
    for conv, edit, role, text in _turns(batches):
        if edit is None:
            place = 0
            continue
        rows.append((conv, place, edit, role, text))
        place, size = place + 1, size + len(text)
        if len(rows) >= 4096 or size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["conv", "place", "edit", "role", "text"])
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["conv", "place", "edit", "role", "text"])


def _with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns in order."""
    own = _coded(turns).select("grp", "conv", F.lit(1).alias("part"), "turn", "role", "same", "text", F.lit(None).cast("string").alias("audit"))
    heads = found.select(F.xxhash64("conv").alias("grp"), "conv", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("same"), F.lit("").alias("text"), "audit")
    return own.union(heads).repartition("grp").sortWithinPartitions(*_order("part")).select("conv", "audit", "role", "text")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, place (from 0), edit (K, R or I), role, text."""
    rebuilt = _with_audits(turns, stored(audits(turns), "audits")).mapInArrow(_repaired, "conv string, place long, edit string, role string, text string")
    names = turns.select("conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("~")).alias("conv")).distinct()
    return rebuilt.join(names, "conv").select("conv_id", "place", "edit", "role", "text")


def repair_conversations(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``turns`` (columns conv_id, turn, role, text; others are not read) and of ``ids`` (column conv_id), its faults, cheapest repair and the digest of what it gives.

    Columns: conv_id; gaps (turn numbers missing between its least and its largest), blank, duplicate, truncated (turns by their first
    fault), illegal (neighbours that the grammar forbids), cost (longs); audit (D, I, K and R in order); repaired_sha256.

    Turns stand in the order of their turn, nulls first; of equal turns by role, then by a digest.  A null role or text counts as one space, so it is
    blank or no role of the grammar; so is an empty role.  Turns with a null conv_id are one conversation.  Equal rows are duplicates.  A conversation without turns
    has zeros, an empty audit and the digest of an empty text.  An empty table gives an empty result.
    """
    found = stored(audits(turns), "audits")
    digests = _with_audits(turns, found).mapInArrow(_digests, "conv string, repaired_sha256 string")
    every = turns.select("conv_id") if ids is None else ids.select("conv_id").union(turns.select("conv_id"))
    every = every.distinct().withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("~")))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found.join(digests, "conv"), "conv", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    )
