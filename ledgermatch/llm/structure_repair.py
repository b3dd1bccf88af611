"""Conversation structure repair by a DAG of big-integer weights.

A conversation should read ``(system)? (user assistant)+`` by the initials of its roles, or be
empty, and hold no blank, repeated or cut-off turn. Edits: Keep a row (cost 0), Rerole it to
user or assistant (2), Delete it (3; blank and repeated rows must go), Insert an empty user or
assistant turn (2); a cut-off row that stays costs 1 more. Of the cheapest edits the ones
whose initials, in order, are the least text are taken.

The choice is one shortest path. A node is a row and what came before it (nothing, system,
user or assistant), a path's weight one integer: its high digits are the cost, its low digits a
number of fixed width that spells the audit from its first digit on (D 1, I 2, K 3, R 4) and
ends in zeros, so that a shorter audit comes before those it begins. The dynamic program runs
from the last row to the first: an edit adds its cost to the high digits and its letter before the
low ones, which move down by one. Minima of ordinary integers then decide costs and ties alike,
and the least weight spells the edits: no back pointers are kept. Two inserts never follow
each other in a cheapest path (without them the turns still alternate, or, after a system turn alone,
deleting that costs less), so a gap takes one insert at most and ``2 n + 1`` digits are enough.

Rows are shuffled by conversation and sorted, and one conversation at a time is held: its codes,
turns and four integers. Time grows with the square of one conversation's turns (in digits of a machine
word), so a conversation is the unit of work and must fit a task; how many there are does not matter.

Defined cases: NULL roles and texts are one space; turns sort by turn (NULL first), then role, then
text; all rows with a NULL conversation are one conversation; a conversation whose rows are all
marked absent is returned with zeros, an empty audit and no turns; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgermatch.llm.common import pick, ship

# --- fixed values: costs, audit digits, role initials ----------------------------
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LEGAL = {"su", "ua", "au"}
START, SYSTEM, USER, ASSISTANT = range(4)
# --- end of fixed values ----------------------------------------------------------

LETTERS = {v: k for k, v in DIGITS.items()}
BITS = 3
#: What a user or assistant turn leads to; nothing else follows the state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
NO_SPACE = re.compile(r"[^\x20\x09-\x0D]")
SPACES = " \t\n\x0b\x0c\r"


def kept_state(state: int, initial: str) -> int | None:
    """Where a row with this initial leads as it is, if it may stand there."""
    if initial == "s" and state == START:
        return SYSTEM
    return NEXT[state] if initial == ROLE[NEXT[state]][0] else None


def faults(turns: list[tuple[str, str]]) -> list[str]:
    """Each row's first fault: blank, duplicate, truncated, or none (empty)."""
    seen, out = set(), []
    for role, text in turns:
        known = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "replace"), digest_size=16).digest()
        if not NO_SPACE.search(text):
            out.append("blank")
        elif known in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(SPACES)[-1] in ".!?" else "truncated")
        seen.add(known)
    return out


def cheapest_edits(initials: list[str], found: list[str]) -> tuple[int, str]:
    """(cost, audit) of the least path."""
    n = len(initials)
    width = BITS * (2 * n + 1)
    low, top = (1 << width) - 1, width - BITS
    never = (8 * n + 8) << width  # dearer than deleting every row

    def after(cost: int, letter: str, rest: int) -> int:
        return (((rest >> width) + cost) << width) | (DIGITS[letter] << top) | ((rest & low) >> BITS)

    def with_insert(rows: list[int]) -> list[int]:
        return [min(rows[s], after(INSERT, "I", rows[NEXT[s]])) for s in range(4)]

    best = with_insert([0, never, never, 0])
    for initial, fault in zip(reversed(initials), reversed(found), strict=True):
        extra = CUT_OFF if fault == "truncated" else 0
        here = []
        for s in range(4):
            least = after(DELETE, "D", best[s])
            if fault not in ("blank", "duplicate"):
                least = min(least, after(REROLE + extra, "R", best[NEXT[s]]))
                to = kept_state(s, initial)
                if to is not None:
                    least = min(least, after(KEEP + extra, "K", best[to]))
            here.append(least)
        best = with_insert(here)
    weight = best[START]
    audit = "".join(LETTERS[d] for d in (((weight & low) >> at) & 7 for at in range(top, -1, -BITS)) if d)
    return weight >> width, audit


def apply_edits(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns that the edits leave: their letters say all, as the roles must alternate."""
    rows, state, out = iter(turns), START, []
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append((ROLE[state], ""))
            continue
        role, text = next(rows)
        if letter == "R":
            state = NEXT[state]
            out.append((ROLE[state], text))
        elif letter == "K":
            state = kept_state(state, role[:1])
            out.append((role, text))
    return out


def _report(turns: list[tuple[str, str]], numbers: list[int | None]) -> list:
    found = faults(turns)
    initials = [role[:1] for role, _ in turns]
    known = {t for t in numbers if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = cheapest_edits(initials, found)
    repaired = [{"role": r, "text": t} for r, t in apply_edits(turns, audit)]
    return [gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, repaired]


def repair(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           present: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (role, text).

    ``present`` names a boolean column; rows without it only name their conversation.
    """
    ship(df.sparkSession)
    names = {"conv_id": conv_id, "turn": turn, "role": role, "text": text} | ({"present": present} if present else {})
    rows = pick(df, **names)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"),
                       F.coalesce(F.col("present") if present else F.lit(True), F.lit(False)).alias("present"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartition("conv_id").sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    pair = pa.struct([("role", pa.string()), ("text", pa.string())])
    types = [to_arrow_type(kind), *[pa.int64()] * len(counts), pa.string(), pa.list_(pair)]
    out_names = ["conv_id", *counts, "audit", "repaired"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, numbers = None, [], []

        def batch(done: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*done, strict=True), types, strict=True)], out_names)

        for b in batches:
            done = []
            columns = [b.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "present")]
            for c, number, r, t, there in zip(*columns, strict=True):
                if conv != (c,):
                    if conv is not None:
                        done.append([conv[0], *_report(turns, numbers)])
                    conv, turns, numbers = (c,), [], []
                if there:
                    turns.append((r, t))
                    numbers.append(number)
            if done:
                yield batch(done)
        if conv is not None:
            yield batch([[conv[0], *_report(turns, numbers)]])

    return rows.mapInArrow(work, f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} bigint" for c in counts)
                           + ", audit string, repaired array<struct<role:string,text:string>>")


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): rows broken by their key's remainder of 20.

    0: the row is absent; 1: its text is empty; 2: its sentence ends go; 3: it comes twice;
    4: its role is user.
    """
    rows = pick(df, conv_id=conv_id, turn=turn, role=role, text=text)
    kind = F.crc32(F.concat_ws(":", _spaced("conv_id"), _spaced("turn"))) % 20
    rows = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), kind.alias("kind"))
    broken = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"), (F.col("kind") != 0).alias("present"), "kind")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return broken.withColumn("copy", F.explode(copies)).drop("copy", "kind")
