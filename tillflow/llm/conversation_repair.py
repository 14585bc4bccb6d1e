"""Repair of conversations' structure by iterative-deepening A*.

A repaired conversation has the roles of an optional system message and of pairs of
user and assistant. Rows are kept, deleted or given another role, and empty ones may
be inserted; the cheapest edits are searched depth first, in the ASCII order of their
initials, under a bound that grows to the least cost that exceeded it. What a failed
state would have needed stays in a table, so no state is searched twice with as much
to spend, in later rounds neither. The first path that is accepted is therefore the
cheapest one, and of several the ASCII-least.

Rows without their texts are streamed in order, and a conversation leaves its edits,
a character a row. Then the rows are streamed once more behind these edits. A task
thus holds some bytes a row of one conversation, never its texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillflow.llm.common import bounded_batches, saved, table

#: Fixed by the contract: white space, ends of sentences and costs.
BLANK = r"\A[\x20\x09-\x0D]*\z"
OPEN_END = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
LEGAL = ("su", "ua", "au")
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

#: Faults of a row, of which the first one counts.
FINE, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)
#: What has been accepted so far: nothing, a system row, or a pair up to its user or assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = (NOTHING, SYSTEM, USER, ASSISTANT)
#: Longer conversations are searched piece by piece.
PIECE = 32
#: Reports or rows a task hands on at once.
CHUNK = 1000


@dataclass(frozen=True)
class Row:
    """What the search knows of a row: the initial of its role, and its fault."""

    initial: str
    fault: int


def _kept(state: int, initial: str) -> int | None:
    """The state after a row of that initial, None if it cannot stand there."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _next(state: int) -> int:
    """The state after a user or assistant that fits."""
    return ASSISTANT if state == USER else USER


def _least_cost(row: Row) -> int:
    """What a row costs wherever it stands."""
    if row.fault in (IS_BLANK, IS_DUPLICATE):
        return DELETE
    cut = TRUNCATED if row.fault == IS_TRUNCATED else 0
    return cut if row.initial in ("s", "u", "a") else min(DELETE, REROLE + cut)


class Search:
    """Edits that take ``rows`` to one of ``goals``; only with ``closing`` may insertions end them."""

    def __init__(self, rows: list[Row], goals: set[int], closing: bool):
        self.rows, self.goals, self.closing = rows, goals, closing
        self.rest = [0]
        for row in reversed(rows):
            self.rest.append(self.rest[-1] + _least_cost(row))
        self.rest.reverse()
        #: Lower bounds of what is still to be paid, learned from failures.
        self.failed: dict[tuple[int, int], float] = {}

    def bound(self, at: int, state: int) -> float:
        known = self.failed.get((at, state))
        if known is not None:
            return known
        if at < len(self.rows):
            return self.rest[at]
        if state in self.goals:
            return 0
        return INSERT if self.closing else math.inf

    def moves(self, at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Edit, cost, and where it leads, in the order of the edits' initials."""
        row = self.rows[at] if at < len(self.rows) else None
        if row is not None:
            yield "D", DELETE, at + 1, state
        if row is not None or self.closing:
            yield "I", INSERT, at, _next(state)
        if row is None or row.fault in (IS_BLANK, IS_DUPLICATE):
            return
        cut = TRUNCATED if row.fault == IS_TRUNCATED else 0
        kept = _kept(state, row.initial)
        if kept is not None:
            yield "K", cut, at + 1, kept
        yield "R", REROLE + cut, at + 1, _next(state)

    def possible(self, state: int) -> bool:
        """Whether a goal can be reached at all, as insertions have no end."""
        if self.goals & {USER, ASSISTANT}:
            return bool(self.rows) or self.closing or state in self.goals
        if NOTHING in self.goals:
            return state == NOTHING
        keeps = any(r.initial == "s" and r.fault in (FINE, IS_TRUNCATED) for r in self.rows)
        return state == SYSTEM or (state == NOTHING and keeps)

    def cheapest(self, state: int) -> tuple[float, str]:
        """Cost and edits from ``state``, infinite if there are none."""
        if not self.possible(state):
            return math.inf, ""
        while True:
            bound = self.bound(0, state)
            edits = self._within(bound, state)
            if edits is not None:
                return bound, edits

    def _within(self, bound: float, state: int) -> str | None:
        """The first accepted edits in ASCII order that cost ``bound`` at most."""
        nodes, edits = [(0, state, 0)], []
        open_, needed = [self.moves(0, state)], [math.inf]
        while nodes:
            at, here, paid = nodes[-1]
            if at == len(self.rows) and here in self.goals:
                return "".join(edits)
            for edit, cost, to, then in open_[-1]:
                further = self.bound(to, then)
                if paid + cost + further > bound:
                    needed[-1] = min(needed[-1], cost + further)
                    continue
                nodes.append((to, then, paid + cost))
                edits.append(edit)
                open_.append(self.moves(to, then))
                needed.append(math.inf)
                break
            else:
                lowest = max(self.bound(at, here), needed.pop())
                self.failed[at, here] = lowest
                nodes.pop()
                open_.pop()
                if nodes:
                    edits.pop()
                    needed[-1] = min(needed[-1], paid - nodes[-1][2] + lowest)
        return None


def cheapest_edits(rows: list[Row], piece: int = PIECE) -> tuple[int, str]:
    """Least cost and the ASCII-least edits of that cost for a whole conversation.

    A long one is cut into pieces. Each is searched from every state to every state,
    and the pieces' costs are added from the last to the first. Edits of one piece
    that start alike and end in different states differ within the piece, as no
    insertion ends them there, so the comparison never has to look beyond it.
    """
    if not rows:
        return 0, ""
    pieces = [rows[i : i + piece] for i in range(0, len(rows), piece)]
    last = Search(pieces[-1], {NOTHING, ASSISTANT}, closing=True)
    if len(pieces) == 1:
        return last.cheapest(NOTHING)
    onward = {s: (*last.cheapest(s), None) for s in STATES}
    chain = [onward]
    for part in reversed(pieces[:-1]):
        searches = {goal: Search(part, {goal}, closing=False) for goal in STATES}
        choices = {}
        for state in STATES:
            found = [(goal, *searches[goal].cheapest(state)) for goal in STATES]
            choices[state] = min((cost + chain[-1][goal][0], edits, goal) for goal, cost, edits in found)
        chain.append(choices)
    cost, state, written = chain[-1][NOTHING][0], NOTHING, []
    for choices in reversed(chain):
        _, edits, then = choices[state]
        written.append(edits)
        state = then
    return cost, "".join(written)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Roles and texts after the edits of ``audit``."""
    state = NOTHING
    names = {USER: "user", ASSISTANT: "assistant"}
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "K":
            state = _kept(state, role[:1])
            yield role, text
        elif edit != "D":
            state = _next(state)
            yield names[state], text


# The two streams over the rows


def _whole(columns: DataFrame) -> DataFrame:
    """Conversations as texts, nulls as one blank, with what orders their rows.

    Rows are in the order of turn, nulls first; of one turn in that of role and a
    checksum of the text, so that equal rows stand side by side.
    """
    blank = F.lit(" ")
    text = F.coalesce(F.col("text"), blank)
    return columns.select(
        F.col("conv_id").cast("string").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), blank).alias("role"),
        text.alias("text"),
        F.md5(text.cast("binary")).alias("key"),
    )


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Rows that are dealt by conversation, each conversation in order."""
    names = [F.asc_nulls_first(c) for c in ("conv", *first, "turn", "role", "key")]
    return rows.sortWithinPartitions(*names)


def _faults(rows: DataFrame) -> DataFrame:
    """Rows without their texts, with their first fault."""
    slim = rows.select(
        "conv", "turn", "role", "key", F.col("text").rlike(BLANK).alias("blank"),
        F.col("text").rlike(OPEN_END).alias("cut"),
    ).repartition("conv")
    # Dealt by the conversation, rows need no second shuffle for this window.
    earlier = Window.partitionBy("conv", "role", "key").orderBy(F.asc_nulls_first("turn"))
    seen = F.row_number().over(earlier) > 1
    fault = F.when(F.col("blank"), IS_BLANK).when(seen, IS_DUPLICATE).when(F.col("cut"), IS_TRUNCATED)
    return slim.select("*", F.coalesce(fault, F.lit(FINE)).alias("fault")).drop("blank", "cut")


class _Report:
    """What is gathered of one conversation while its rows pass."""

    def __init__(self, conv: str | None):
        self.conv, self.initials, self.faults = conv, [], bytearray()
        self.first = self.last = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, role: str, fault: int) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        initial = role[:1]
        self.illegal += bool(self.initials) and self.initials[-1] + initial not in LEGAL
        self.initials.append(initial)
        self.faults.append(fault)

    def row(self) -> tuple:
        rows = [Row(i, f) for i, f in zip(self.initials, self.faults)]
        cost, audit = cheapest_edits(rows)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        counts = [self.faults.count(f) for f in (IS_BLANK, IS_DUPLICATE, IS_TRUNCATED)]
        return self.conv, len(rows), gaps, *counts, self.illegal, int(cost), audit


def _chunks(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    chunk, size = [], 0
    for row in rows:
        chunk.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(chunk) == CHUNK or size > 1 << 22:
            yield pd.DataFrame(chunk, columns=names)
            chunk, size = [], 0
    yield pd.DataFrame(chunk, columns=names)


REPORT = (
    "conv string, rows long, gaps long, blank long, duplicate long, truncated long, illegal long,"
    " cost long, audit string"
)


def _reports(rows: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in REPORT.split(", ")]

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        current = None
        for batch in batches:
            known = batch["known"].tolist()
            for conv, turn, has, role, fault in zip(
                batch["conv"].tolist(), batch["turn"].tolist(), known, batch["role"].tolist(), batch["fault"].tolist()
            ):
                if current is None or current.conv != conv:
                    if current is not None:
                        yield current.row()
                    current = _Report(conv)
                current.add(turn if has else None, role, fault)
        if current is not None:
            yield current.row()

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _chunks(told(batches), names)

    ordered = _in_order(_faults(rows))
    # pandas has no null longs
    slim = ordered.select(
        "conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("known"), "role", "fault"
    )
    return slim.mapInPandas(report, REPORT)


def _behind_edits(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The rows in order, each conversation's edits in a row before them."""
    none = F.lit(None)
    edits = reports.select(
        "conv", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"),
        F.col("audit").alias("text"), none.cast("string").alias("key"),
    )
    whole = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "key")
    return _in_order(edits.union(whole).repartition("conv"), "kind").select("conv", "kind", "role", "text")


def _by_conversation(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, Iterator]]:
    """Conversation and iterator of its repaired rows, which has to be used up before the next."""

    def rows():
        for batch in batches:
            columns = (batch[c].tolist() for c in ("conv", "kind", "role", "text"))
            yield from zip(*columns)

    stream = rows()
    for conv, _, _, audit in stream:

        def own():
            for _ in range(sum(edit != "I" for edit in audit)):
                yield next(stream)[2:]

        yield conv, edited(audit, own())


def repaired_rows(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """``conv``, ``place``, ``role`` and ``text`` of all conversations after their edits."""
    bounded_batches(rows.sparkSession)

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = (
            (conv, i, role, text) for conv, own in _by_conversation(batches) for i, (role, text) in enumerate(own)
        )
        yield from _chunks(out, ["conv", "place", "role", "text"])

    return _behind_edits(_whole(rows), reports).mapInPandas(repair, "conv string, place long, role string, text string")


def repaired_digests(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """``conv`` and ``repaired_sha256`` of the repaired ``role:text`` lines, hashed as they pass."""
    bounded_batches(rows.sparkSession)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for conv, own in _by_conversation(batches):
            digest, between = sha256(), b""
            for role, text in own:
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            yield conv, digest.hexdigest()

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _chunks(told(batches), ["conv", "repaired_sha256"])

    return _behind_edits(_whole(rows), reports).mapInPandas(digests, "conv string, repaired_sha256 string")


def conversation_reports(rows: DataFrame) -> DataFrame:
    """A row for each conversation with its faults, the cost of its repair and the edits.

    ``conv`` (the id as text), ``rows``, ``gaps``, ``blank``, ``duplicate``,
    ``truncated``, ``illegal``, ``cost`` and ``audit``. A null role or text is one
    blank; a null id is a conversation of its own; rows without a turn come first.
    Rows of one turn stand in the order of role and text checksum, so repeated rows
    are neighbours and all but one are duplicates. An empty text is blank, a very long
    one does not leave its row. An empty table gives an empty result; other columns
    are ignored.
    """
    bounded_batches(rows.sparkSession)
    return _reports(_whole(rows))


# The query


def _damage_key() -> Column:
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    return F.crc32(F.concat_ws(":", *told).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given another role, by a checksum of id and turn."""
    rows = conversations.select("conv_id", "turn", "role", "text", _damage_key().alias("fate")).filter("fate <> 0")
    text = F.coalesce(F.col("text"), F.lit(" "))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    reports = saved(conversation_reports(rows), "conversation-reports")
    named = conversations.groupBy("conv_id").agg(F.count("*").alias("_n"))
    named = named.select("conv_id", F.col("conv_id").cast("string").alias("_conv"))
    same = F.col("_conv").eqNullSafe(F.col("conv"))
    digests = repaired_digests(rows, reports).withColumnRenamed("conv", "_of")
    found = named.join(reports, same, "left").join(digests, F.col("_conv").eqNullSafe(F.col("_of")), "left")
    counts = [
        F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ]
    return found.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"),
    )
