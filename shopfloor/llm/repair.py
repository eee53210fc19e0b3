r"""Conversation structure repair by lightest derivations.

Role initials of a sound conversation read ``(s?(ua)+)?``. Edits make a damaged one sound: Keep, Rerole to user or assistant,
Delete, Insert an empty turn. The derivations of a run of rows are a weighted hypergraph: item (i, q) says that the first i
rows are dealt with and the roles so far leave the automaton in state q; each edit derives one item from another and extends
its value (cost, audit), audit being the initials of the edits. Values are ordered by cost, then by ASCII. Every deduction is
a monotone superior function: it adds to the cost and appends a letter, and of two audits of equal cost over the same rows
none begins with the other, since the rows give each letter but ``I`` its place and an ``I`` costs. So Knuth's agenda, which
pops the least value first, finalises an item when it pops it, and ends with the goal items.

A conversation may be of any length. Rows are dealt out by range of (conversation, turn), so a long one spreads over many
tasks; each task runs the agenda over pieces of ``PIECE`` rows, once for every state a piece can be entered in, and joins the
results, lightest first, to one summary for each conversation it holds a part of. Only summaries meet by conversation: their
audits are as long as the audit the table returns anyway. At last the rows stream past their audit in order, one at a time.

Null role and text count as one space, a null turn comes first, a null ``conv_id`` is a conversation of its own. Rows with one
turn stand in the order of role and md5 of the text; rows repeated in full are kept as often as they occur. A role is judged
by its first letter only. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, written

#: Rows one agenda runs over.
PIECE = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: State of the roles so far: none, after s, after u, after a; a sound conversation ends in 0 or 3.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, GOALS = 4, (0, 3)
FINE, BLANK, DUPLICATE, CUT = range(4)
SPACES, ENDS = r"\x20\x09-\x0D", ".!?"
Value = tuple[int, str]
Matrix = tuple[tuple[Value | None, ...], ...]


@lru_cache(maxsize=50_000)
def lightest(rows: tuple[tuple[str, int], ...], entry: int) -> tuple[Value | None, ...]:
    """The least (cost, audit) from state ``entry`` to each state over ``rows`` (role initial, fault)."""
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    done: dict[tuple[int, int], Value] = {}
    end, goals = len(rows), 0
    while agenda and goals < STATES:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in done:
            continue
        done[at, state] = (cost, audit)
        goals += at == end
        for role in ROLES:
            after = STEP.get((state, role))
            if after is not None:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", at, after))
        if at == end:
            continue
        initial, fault = rows[at]
        heapq.heappush(agenda, (cost + DELETE, audit + "D", at + 1, state))
        if fault in (BLANK, DUPLICATE):
            continue
        worse = TRUNCATED if fault == CUT else 0
        if (state, initial) in STEP:
            heapq.heappush(agenda, (cost + KEEP + worse, audit + "K", at + 1, STEP[state, initial]))
        for role in ROLES:
            after = STEP.get((state, role))
            if after is not None:
                heapq.heappush(agenda, (cost + REROLE + worse, audit + "R", at + 1, after))
    return tuple(done.get((end, q)) for q in range(STATES))


def joined(left: Matrix, right: Matrix) -> Matrix:
    """Lightest values over two runs of rows that follow each other."""
    return tuple(
        tuple(
            min(((x[0] + y[0], x[1] + y[1]) for x, m in zip(row, right, strict=True) if x is not None and (y := m[q]) is not None), default=None)
            for q in range(STATES)
        )
        for row in left
    )


class Summary:
    """What is known of a run of rows of one conversation: fault counts, illegal neighbours, lightest values.

    Parts are joined in pairs of like size, so a letter of an audit is copied once for every doubling.
    """

    def __init__(self):
        self.faults, self.illegal = [0, 0, 0, 0], 0
        self.first: str | None = None
        self.last = ""
        self.parts: list[tuple[int, Matrix]] = []

    def add(self, size: int, matrix: Matrix, faults: list[int], illegal: int, first: str, last: str) -> None:
        self.faults = [a + b for a, b in zip(self.faults, faults, strict=True)]
        self.illegal += illegal + (self.first is not None and self.last + first not in ("su", "ua", "au"))
        self.first, self.last = first if self.first is None else self.first, last
        self.parts.append((size, matrix))
        while len(self.parts) > 1 and self.parts[-2][0] <= self.parts[-1][0]:
            self._join()

    def add_rows(self, rows: tuple[tuple[str, int], ...]) -> None:
        initials = [r[0] for r in rows]
        faults = [sum(r[1] == k for r in rows) for k in range(4)]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        self.add(len(rows), tuple(lightest(rows, q) for q in range(STATES)), faults, illegal, initials[0], initials[-1])

    def _join(self) -> None:
        (m, right), (n, left) = self.parts.pop(), self.parts.pop()
        self.parts.append((n + m, joined(left, right)))

    def whole(self) -> tuple[int, Matrix]:
        while len(self.parts) > 1:
            self._join()
        return self.parts[0]


_CONV = "conv_id long, part long, size long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, audits array<string>"
_NAMES = [c.split()[0] for c in _CONV.split(", ")]
_ARROW = [pa.int64()] * 7 + [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]


def _rows_out(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(_ARROW)], names=_NAMES)


def _told(conv, part: int, s: Summary) -> tuple:
    size, matrix = s.whole()
    flat = [v for row in matrix for v in row]
    return (conv, part, size, *s.faults[1:], s.illegal, s.first, s.last, [None if v is None else v[0] for v in flat], [None if v is None else v[1] for v in flat])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of the conversations in rows (conv_id, at, initial, fault) sorted by ``at``."""
    conv, first, held, rows = None, None, None, []
    for batch in batches:
        done = []
        for c, at, initial, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held is None or c != conv:
                if held is not None:
                    held.add_rows(tuple(rows))
                    done.append(_told(conv, first, held))
                conv, first, held, rows = c, at, Summary(), []
            elif len(rows) == PIECE:
                held.add_rows(tuple(rows))
                rows = []
            rows.append((initial, fault))
        yield _rows_out(done)
    if held is not None:
        held.add_rows(tuple(rows))
        yield _rows_out([_told(conv, first, held)])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary for each conversation from summaries sorted by (conv_id, part)."""
    conv, held = None, None
    for batch in batches:
        done = []
        for c, _part, size, blank, duplicate, cut, illegal, first, last, costs, audits in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held is None or c != conv:
                if held is not None:
                    done.append(_told(conv, 0, held))
                conv, held = c, Summary()
            values = [None if k is None else (k, a) for k, a in zip(costs, audits, strict=True)]
            matrix = tuple(tuple(values[q * STATES : (q + 1) * STATES]) for q in range(STATES))
            held.add(size, matrix, [0, blank, duplicate, cut], illegal, first, last)
        yield _rows_out(done)
    if held is not None:
        yield _rows_out([_told(conv, 0, held)])


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, turn, role, text): rows by conversation and turn; ``at`` goes up with them and is unique."""
    require(conversations, "conv_id", "turn", "role", "text")
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    # Rows alike in everything may stand in any order: their place in the input lets them spread over tasks, too.
    key = ["conv_id", "turn", "role", "tie", "here"]
    keyed = rows.withColumns({"tie": F.md5("text"), "here": F.monotonically_increasing_id()})
    return written(keyed.repartitionByRange(*key).sortWithinPartitions(*key).select("conv_id", F.monotonically_increasing_id().alias("at"), "turn", "role", "text"), "repair-rows")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, at, initial, fault) of ``ordered`` rows: the first fault of each."""
    bare = F.regexp_replace("text", f"[{SPACES}]+$", "")
    blank = ~F.col("text").rlike(f"[^{SPACES}]")
    cut = ~F.substring(bare, -1, 1).isin(*ENDS)
    known = rows.select("conv_id", "at", F.substring("role", 1, 1).alias("initial"), F.sha2(F.concat("role", F.lit("\0"), "text"), 256).alias("said"), blank.alias("blank"), cut.alias("cut"))
    known = written(known, "repair-said")
    first = known.where("NOT blank").groupBy(F.col("conv_id").alias("of"), "said").agg(F.min("at").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (known["said"] == first["said"])
    fault = F.when(F.col("blank"), BLANK).when(F.col("at") > F.col("earliest"), DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    return known.join(first, same, "left").select("conv_id", "at", "initial", fault.alias("fault"))


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of every conversation in ``ordered`` rows."""
    dealt = faults(rows).repartitionByRange("at").sortWithinPartitions("at")
    parts = written(dealt.mapInArrow(_summed, _CONV), "repair-parts")
    whole = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_merged, _CONV)
    value = lambda q: F.struct(F.col("costs")[q].alias("cost"), F.col("audits")[q].alias("audit"))
    best = F.array_min(F.filter(F.array(*(value(q) for q in GOALS)), lambda v: v["cost"].isNotNull()))
    return written(whole.withColumn("best", best).select("conv_id", "blank", "duplicate", "truncated", "illegal", "best.*"), "repair-audits")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of the repaired conversations from rows (conv_id, at, turn, role, text, audit), a conversation's audit first."""
    audit, place, state, position = "", 0, 0, 0
    names, kinds = ["conv_id", "position", "turn", "edit", "role", "text"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def inserted(conv, out: list) -> None:
        nonlocal place, state, position
        while place < len(audit) and audit[place] == "I":
            role = "a" if state == 2 else "u"
            out.append((conv, position, None, "I", ROLES[role], ""))
            place, state, position = place + 1, STEP[state, role], position + 1

    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            out: list[tuple] = []
            for conv, at, turn, role, text, told in zip(*(x.to_pylist() for x in batch.slice(start, 500).columns), strict=True):
                if at < 0:
                    audit, place, state, position = told, 0, 0, 0
                else:
                    edit, place = audit[place], place + 1
                    if edit != "D":
                        if edit == "R":
                            role = ROLES["a" if state == 2 else "u"]
                        state = STEP[state, role[0]]
                        out.append((conv, position, turn, edit, role, text))
                        position += 1
                inserted(conv, out)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, turn, edit, role, text): the turns left, in order within a partition that holds the conversation.

    ``edit`` is K, R or I; ``turn`` is null for an inserted turn.
    """
    none = F.lit(None).cast("string")
    heads = found.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), "audit")
    both = heads.unionByName(rows.select("conv_id", "at", "turn", "role", "text", none.alias("audit")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_edited, "conv_id long, position long, turn long, edit string, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, held = None, None
    for batch in batches:
        done = []
        for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held is None or c != conv:
                if held is not None:
                    done.append((conv, held.hexdigest()))
                conv, held = c, sha256()
            else:
                held.update(b"\n")
            held.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([held.hexdigest()])], names=["conv_id", "repaired_sha256"])


def case_of(conv: Column, turn: Column) -> Column:
    """What happens to a row in the damage test: a number from 0 to 19."""
    word = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(word(conv), F.lit(":"), word(turn)).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage test: rows dropped, emptied, without sentence ends, repeated, given to the user."""
    case, space = F.col("case"), F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), case_of(F.col("conv_id"), F.col("turn")).alias("case")).where(case != 0)
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace("text", f"[{ENDS}]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row for every original conversation: what the damage test broke, and the lightest repair of what is left."""
    require(conversations, "conv_id", "turn", "role", "text")
    rows = ordered(damaged(conversations.select("conv_id", "turn", "role", "text")))
    found = audits(rows)
    digests = repaired(rows, found).select("conv_id", "role", "text").mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    turns = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for more in (turns, found, digests):
        named = more.withColumnRenamed("conv_id", "of")
        every = every.join(named, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = sha256(b"").hexdigest()
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


_CRC = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({}, ''), lambda h: CAST(ord(h) AS BIGINT))), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda x, z: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT)) % 20"
)
SQL = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} AS kind FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE kind <> 0),
rows AS MATERIALIZED (
  SELECT conv_id, turn, role, text, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM hurt),
f AS MATERIALIZED (SELECT *, CASE WHEN blank THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN cut THEN 3 ELSE 0 END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM rows),
step(q, i, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(q, r, cost, audit, said) AS (VALUES
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'),
  (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
edit AS MATERIALIZED (
  SELECT conv_id, pos, q, r, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS cost, 'K' AS audit, chr(10) || role || ':' || text AS said FROM f JOIN step USING (i) WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, pos, q, r, CASE WHEN fault = 3 THEN 6 ELSE 1 END, 'R', chr(10) || CASE step.i WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text FROM f JOIN step ON step.i IN ('u', 'a') WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, pos, q, q, 2, 'D', '' FROM f CROSS JOIN (VALUES (0), (1), (2), (3)) AS s(q)),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk(conv_id, pos, q, cost, audit, said) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, 0, '', '' FROM ids
  UNION ALL
  SELECT conv_id, pos, q, best.cost, best.audit, best.said FROM (
    SELECT w.conv_id, e.pos, e.r AS q, min({{'cost': w.cost + n.cost + e.cost, 'audit': w.audit || n.audit || e.audit, 'said': w.said || n.said || e.said}}) AS best
    FROM walk w JOIN ins n ON n.q = w.q JOIN edit e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.pos = w.pos + 1 AND e.q = n.r GROUP BY ALL)),
ends AS (
  SELECT w.conv_id, min({{'cost': w.cost + n.cost, 'audit': w.audit || n.audit, 'said': w.said || n.said}}) AS best
  FROM walk w JOIN ins n ON n.q = w.q AND n.r IN (0, 3) LEFT JOIN (SELECT conv_id, max(pos) AS n_rows FROM f GROUP BY 1) c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.pos = coalesce(c.n_rows, 0) GROUP BY 1),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY 1)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(substr(best.said, 2)) AS repaired_sha256
FROM ends e LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""
