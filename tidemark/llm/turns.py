"""Conversation structure repair: the cheapest edits that make a conversation's role initials match (s?(ua)+)?.

The edits are a path through the lattice of (turn index, grammar state), which is never built: Dijkstra's algorithm makes a
node's edges when it is popped, by the priority (cost, audit), and stops at the first popped end node that accepts. Of two
paths to one node with the same cost neither audit begins the other (they consume the same turns, and an insertion costs),
so the first difference decides and the least audit of a whole is made of least audits of its parts. That lets a long
conversation be solved in windows of WINDOW turns: the nodes of a window's end that can still matter go on to the next, and
edits all of them share are final and leave with their texts.

Rows are sent to their conversation's task once, sorted there by Spark (which spills) and read as a stream, so memory is one
window's turns, not a conversation's. A digest of a conversation's whole text is sequential, so one conversation is one task's
stream, however long; faults are found by Spark's own functions before.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 512
NOT_BLANK = r"[^\x20\x09-\x0D]"
WHOLE_END = r"[.!?][\x20\x09-\x0D]*\z"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn whose role has this initial, by the state before it.
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ACCEPTS = {START, ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, turns long"


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with damage by crc32('conv_id:turn') % 20; a null counts as one space.

    0 drops the row (it stays, marked absent), 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 sets its role to user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (kind == 0).alias("absent"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def fault(text: Column, seen: Column) -> Column:
    """A turn's first fault: blank, seen before, or cut short."""
    return F.when(~text.rlike(NOT_BLANK), BLANK).when(seen, DUPLICATE).when(~text.rlike(WHOLE_END), TRUNCATED).otherwise(FINE)


def cheapest(front: dict[int, tuple[int, str]], turns: list[tuple[str, int]], last: bool) -> dict[int, tuple[int, str]]:
    """From the nodes of front, state to (cost, audit), over turns (role initial, fault) to the states after them.

    If last, only the first popped accepting node at the end.
    """
    heap = [(cost, audit, 0, state) for state, (cost, audit) in front.items()]
    heapq.heapify(heap)
    done, found, n = set(), {}, len(turns)
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == n:
            if not last:
                found[state] = (cost, audit)
                continue
            if state in ACCEPTS:
                return {state: (cost, audit)}
        for role in "ua":
            after = STEP[role].get(state)
            if after is not None:
                heapq.heappush(heap, (cost + INSERT, audit + "I", at, after))
        if at < n:
            initial, wrong = turns[at]
            heapq.heappush(heap, (cost + DELETE, audit + "D", at + 1, state))
            if wrong not in (BLANK, DUPLICATE):
                extra = CUT_SHORT if wrong == TRUNCATED else 0
                after = STEP.get(initial, {}).get(state)
                if after is not None:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, after))
                for role in "ua":
                    after = STEP[role].get(state)
                    if after is not None:
                        heapq.heappush(heap, (cost + REROLE + extra, audit + "R", at + 1, after))
    return found


def without_losers(front: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """front without the states that can't be on the cheapest path.

    Whatever follows START can follow ASSISTANT for DELETE more at most (a system turn is deleted in place of kept), and
    whatever follows SYSTEM can follow ASSISTANT.
    """
    if ASSISTANT not in front:
        return front
    least = front[ASSISTANT][0]
    room = {START: least + DELETE, SYSTEM: least}
    return {s: v for s, v in front.items() if v[0] <= room.get(s, v[0])}


class Repair:
    """One conversation's turns in order, a stream; give(turn, role, text, edit) gets every turn of the repaired one."""

    def __init__(self, give: Callable[[int | None, str, str, str], None]) -> None:
        self.give = give
        self.held: list[tuple] = []  # turns whose edit is open, from the first undecided letter of the audits on
        self.fresh = 0  # how many of them, at the end, no window has taken
        self.front = {START: (0, "")}
        self.letters: list[str] = []
        self.before = ""  # the initial of the last turn given
        self.counts = [0, 0, 0, 0]
        self.illegal = self.turns = self.distinct = 0
        self.last: tuple | None = None
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, wrong: int) -> None:
        self.counts[wrong] += 1
        self.turns += 1
        if self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and (self.last is None or self.last[0] != turn):
            self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last = (turn, role)
        self.held.append((turn, role, text, wrong))
        self.fresh += 1
        if self.fresh == WINDOW:
            self._window(False)

    def _window(self, last: bool) -> None:
        turns = [(role[:1], wrong) for _, role, _, wrong in self.held[len(self.held) - self.fresh :]]
        self.front = without_losers(cheapest(self.front, turns, last))
        self.fresh = 0
        shared = len(os.path.commonprefix([audit for _, audit in self.front.values()]))
        self._settle(next(iter(self.front.values()))[1][:shared])
        self.front = {s: (cost, audit[shared:]) for s, (cost, audit) in self.front.items()}

    def _settle(self, audit: str) -> None:
        self.letters.append(audit)
        at = 0
        for letter in audit:
            turn, role, text = (None, "", "") if letter == "I" else self.held[at][:3]
            at += letter != "I"
            if letter == "D":
                continue
            if letter in "IR":
                role = ROLE[ASSISTANT if self.before == "u" else USER]
            self.before = role[:1]
            self.give(turn, role, text, letter)
        del self.held[:at]

    def end(self) -> dict:
        self._window(True)
        ((cost, _),) = self.front.values()
        gaps = self.high - self.low + 1 - self.distinct if self.low is not None else 0
        return {"gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[TRUNCATED], "illegal": self.illegal, "cost": cost, "audit": "".join(self.letters), "turns": self.turns}


def in_order(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, absent) with each turn's fault, a conversation in one partition, in order.

    One exchange. The order is turn (nulls first), then role and text.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "absent", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    rows = rows.select("conv_id", "turn", "role", "text", "absent", fault(F.col("text"), seen).alias("fault"))
    return rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def _streams(batches: Iterator[pa.RecordBatch], start: Callable[[int | None], Repair]) -> Iterator[tuple[int | None, Repair, bool]]:
    """(conversation, its Repair, whether it has ended), after every batch and at every end."""
    held: tuple[int | None, Repair] | None = None
    for batch in batches:
        for conv, turn, role, text, absent, wrong in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or held[0] != conv:
                if held is not None:
                    yield *held, True
                held = (conv, start(conv))
            if not absent:
                held[1].add(turn, role, text, wrong)
        if held is not None:
            yield *held, False
    if held is not None:
        yield *held, True


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation of rows (conv_id, turn, role, text, absent), with its faults, the cheapest edits and a digest.

    Keep costs 0, Rerole (to user or assistant) 1, Delete 2 (the only one for blank and repeated turns), Insert (an empty turn)
    5; a turn cut short that is not deleted costs 5 more. audit has the edits' initials, the least in ASCII of the cheapest.
    Rows marked absent count for nothing but their conversation, which, if it has no others, has zeros, '' and the digest
    of ''. A null conv_id is a conversation, null turns come first and have no gaps; role and text may be null (one space).
    Turns of the same number are taken in the order of role and text; repeated rows are repeated turns, duplicates of one
    another. Texts and conversations are of any length; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, parts = hashlib.sha256(), [0]

        def give(turn: int | None, role: str, text: str, edit: str) -> None:
            digest.update(f"{chr(10) if parts[0] else ''}{role}:{text}".encode())
            parts[0] += 1

        def start(conv: int | None) -> Repair:
            nonlocal digest
            digest, parts[0] = hashlib.sha256(), 0
            return Repair(give)

        done: list[dict] = []
        names = [c.split()[0] for c in SUMMARY.split(", ")]
        kinds = [pa.string() if c in ("audit", "repaired_sha256") else pa.int64() for c in names]
        for conv, repair, over in _streams(batches, start):
            if over:
                done.append({"conv_id": conv, **repair.end(), "repaired_sha256": digest.hexdigest()})
            elif done:
                yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], k) for c, k in zip(names, kinds, strict=True)], names=names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], k) for c, k in zip(names, kinds, strict=True)], names=names)

    return in_order(_plain(rows)).mapInArrow(run, SUMMARY)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), turn (null for inserted ones), role, text, edit.

    As `repaired_conversations`, whose audits' letters but D they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def start(conv: int | None) -> Repair:
            place = [0]

            def give(turn: int | None, role: str, text: str, edit: str) -> None:
                out.append((conv, place[0], turn, role, text, edit))
                place[0] += 1

            return Repair(give)

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "place", "turn", "role", "text", "edit"])
            out.clear()
            return made

        for _, repair, over in _streams(batches, start):
            if over:
                repair.end()
            elif out:
                yield batch()
        if out:
            yield batch()

    return in_order(_plain(rows)).mapInArrow(run, "conv_id long, place long, turn long, role string, text string, edit string")


def _plain(rows: DataFrame) -> DataFrame:
    absent = F.coalesce(F.col("absent"), F.lit(False)) if "absent" in rows.columns else F.lit(False)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], absent.alias("absent"))


def repair_sql() -> str:
    """Faults, cheapest edits and digests of the damaged table conversations, for DuckDB.

    The lattice is gone through turn by turn, its four states as strings of nine digits of cost and the audit, whose least is
    the least of (cost, audit).
    """
    said = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    add = lambda state, cost, letter: f"(lpad(CAST(CAST(substr({state}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}')"
    only = lambda condition, value: f"CASE WHEN {condition} THEN {value} END"

    def turned(after: int) -> str:
        """The least way to a state by one turn from s0, s1, s2, s3."""
        ways = [add(f"s{after}", DELETE, "D")]
        for letter, cost in (("K", 0), ("R", REROLE)):
            for role, steps in STEP.items():
                if letter == "R" and role == "s":
                    continue
                asked = "fault IN (0, 3)" + (f" AND initial = '{role}'" if letter == "K" else "")
                ways += [only(asked, add(f"s{before}", f"({cost} + CASE fault WHEN 3 THEN {CUT_SHORT} ELSE 0 END)", letter)) for before, to in steps.items() if to == after]
        return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]

    user = f"least(s2, {add('s0', INSERT, 'I')}, {add('s1', INSERT, 'I')}, {add('s3', INSERT, 'I')})"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), c AS (
  SELECT conv_id, turn, {said("role")} AS role, {said("text")} AS text,
         list_transform(string_split({said("conv_id")} || ':' || {said("turn")}, ''), lambda x: CAST(ascii(x) AS BIGINT)) AS name FROM conversations
), k AS (
  SELECT c.*, xor(list_reduce(list_prepend(4294967295, name), lambda h, b: xor(h // 256, t[xor(h % 256, b) + 1])), 4294967295) % 20 AS kind FROM c, crc
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k
), o AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen FROM d
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{NOT_BLANK}') THEN 1 WHEN seen THEN 2 WHEN NOT regexp_matches(text, '{WHOLE_END}') THEN 3 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o
), n AS (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id
), walk AS (
  SELECT conv_id, n, 0 AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000000005I' AS s2, '000000010II' AS s3 FROM n
  UNION ALL
  SELECT conv_id, n, i, s0, s1, s2, least(s3, {add("s2", INSERT, "I")}) AS s3 FROM (
    SELECT conv_id, n, i, s0, s1, {user} AS s2, s3 FROM (
      SELECT w.conv_id, w.n, w.i + 1 AS i, {turned(START)} AS s0, {turned(SYSTEM)} AS s1, {turned(USER)} AS s2, {turned(ASSISTANT)} AS s3
      FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 WHERE w.i < w.n))
), best AS (SELECT conv_id, least(s0, s3) AS way FROM walk WHERE i = n
), letters AS (
  SELECT conv_id, p, substr(way, 9 + p, 1) AS letter, p - length(replace(substr(way, 10, p), 'I', '')) AS inserted FROM (SELECT conv_id, way, unnest(range(1, length(way) - 8)) AS p FROM best)
), edits AS (
  SELECT l.conv_id, p, letter, role, text, initial FROM letters l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = p - inserted AND letter <> 'I' WHERE letter <> 'D'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 - max(CASE WHEN initial = 's' AND letter = 'K' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS place FROM edits
), whole AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS repaired FROM placed GROUP BY conv_id
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS turns FROM f GROUP BY conv_id
)
SELECT g.conv_id, {", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
       CAST(coalesce(CAST(substr(way, 1, 9) AS INTEGER), 0) AS BIGINT) AS cost, coalesce(substr(way, 10), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256,
       CAST(coalesce(turns, 0) AS BIGINT) AS turns
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN whole h ON h.conv_id IS NOT DISTINCT FROM g.conv_id"""
