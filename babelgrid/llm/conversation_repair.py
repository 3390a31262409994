"""Conversation structure repair by Hirschberg's divide and conquer.

The roles of a conversation should read ``system? (user assistant)+``.  Four
states say what has been put out (nothing, system, user, assistant); each row
is kept, re-roled or deleted, and empty turns may be inserted before it.  Of
the cheapest edits the one whose audit (the edits' initials) is least in ASCII
order is wanted.  The edits of a row, its inserts first, form a prefix-free
code (only the last letter isn't ``I``), and the automaton is deterministic,
so the order of two audits is settled row by row.  That lets a forward vector
of four (cost, rank) pairs stand for the best audits into each state: it meets
the backward cost vector in the middle, the least-ranked of the cheapest
crossings is chosen, and both halves are solved alike, in linear space.

A conversation may hold a third of all rows.  Rows are ordered by a range
partition; what a partition holds of a conversation is a segment.  Each
segment gives a 4 x 4 table of (cost, rank), the crossings between a
conversation's segments are found from those (at most one per partition), and
the segments are solved apart.  Only one thing is done in one task per
conversation: its repaired turns stream in order through one SHA-256, which
can't be split, without being held.
"""

from __future__ import annotations

import functools
import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import column, same

# --- fixed values of the contract -------------------------------------------------
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
# -----------------------------------------------------------------------------------
#: Characters by which rows of one turn are ordered before their digest decides.
TIE_CHARS = 64

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_INF = 1 << 60
#: Initial of a role, as the class in a row's code.
_CLASSES = {"s": 0, "u": 1, "a": 2}
_OK, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
_LEGAL = {(0, 1), (1, 2), (2, 1)}
Vector = tuple[tuple[int, int], ...]


def _wanted(state: int) -> int:
    """The state after a user or assistant turn, whichever fits."""
    return ASSISTANT if state == USER else USER


@functools.cache
def _choices(code: int) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """For each state the (next state, cost, letters) that a row with this code allows, the best per next state."""
    kind, fault = divmod(code, 4)
    out = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        at = state
        for inserts in range(3):
            base, letters = INSERT * inserts, "I" * inserts
            ways = [(at, DELETE, "D")]
            if fault in (_OK, _TRUNCATED):
                extra = TRUNCATED if fault == _TRUNCATED else 0
                if (kind, at) == (0, NOTHING):
                    ways.append((SYSTEM, KEEP + extra, "K"))
                elif kind in (1, 2) and _wanted(at) == (USER if kind == 1 else ASSISTANT):
                    ways.append((_wanted(at), KEEP + extra, "K"))
                ways.append((_wanted(at), REROLE + extra, "R"))
            for then, cost, letter in ways:
                way = (base + cost, letters + letter)
                best[then] = min(best.get(then, way), way)
            at = _wanted(at)
        out.append(tuple((then, cost, letters) for then, (cost, letters) in sorted(best.items())))
    return tuple(out)


#: Cost of the inserts that end a conversation, by state.
_END = (0, 2 * INSERT, INSERT, 0)
_TAIL = ("", "II", "I", "")


def _ranked(best: list[tuple | None]) -> Vector:
    order = {key: n for n, key in enumerate(sorted({b[1:] for b in best if b}))}
    return tuple((b[0], order[b[1:]]) if b else (_INF, 0) for b in best)


def _shifted(v: Vector) -> tuple[Vector, int]:
    low = min(c for c, _ in v)
    return tuple((c - low, r) if c < _INF else (c, r) for c, r in v), low


@functools.cache
def _row_forward(v: Vector, code: int) -> tuple[Vector, int]:
    best: list[tuple | None] = [None] * 4
    for state, (cost, rank) in enumerate(v):
        if cost < _INF:
            for then, more, letters in _choices(code)[state]:
                way = (cost + more, rank, letters)
                best[then] = min(best[then] or way, way)
    return _shifted(_ranked(best))


@functools.cache
def _row_backward(v: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    out = [min((more + v[then] for then, more, _ in _choices(code)[s]), default=_INF) for s in range(4)]
    low = min(out)
    return tuple(min(c - low, _INF) if c < _INF else _INF for c in out), low


def _start(state: int) -> Vector:
    return tuple((0, 0) if s == state else (_INF, 0) for s in range(4))


def _forward_rows(v: Vector, codes: bytes) -> Vector:
    v, total = _shifted(v)
    for code in codes:
        v, low = _row_forward(v, code)
        total += low
    return tuple((c + total, r) if c < _INF else (c, r) for c, r in v)


def _backward_rows(codes: bytes, v: tuple[int, ...]) -> tuple[int, ...]:
    total = 0
    for code in reversed(codes):
        v, low = _row_backward(v, code)
        total += low
    return tuple(c + total if c < _INF else c for c in v)


def _crossing(forward: Vector, backward: tuple[int, ...]) -> int:
    """The state of the least audit among the cheapest ways through."""
    return min((c + b, r, s) for s, ((c, r), b) in enumerate(zip(forward, backward, strict=True)))[2]


def audit_of(codes: bytes, start: int, end: int) -> str:
    """The least cheapest audit that leads from one state to another over the rows' codes."""
    parts, todo = [], [(0, len(codes), start, end)]
    while todo:
        lo, hi, s, t = todo.pop()
        if hi - lo == 1:
            parts.append(next(letters for then, _, letters in _choices(codes[lo])[s] if then == t))
        elif hi > lo:
            mid = (lo + hi) // 2
            goal = tuple(0 if x == t else _INF for x in range(4))
            x = _crossing(_forward_rows(_start(s), codes[lo:mid]), _backward_rows(codes[mid:hi], goal))
            todo += [(mid, hi, x, t), (lo, mid, s, x)]
    return "".join(parts)


Table = tuple[Vector, ...]  # [start state][end state]


def segment_table(codes: bytes) -> Table:
    return tuple(_forward_rows(_start(s), codes) for s in range(4))


def _forward_table(v: Vector, table: Table) -> Vector:
    best: list[tuple | None] = [None] * 4
    for s, (cost, rank) in enumerate(v):
        for t, (more, then) in enumerate(table[s] if cost < _INF else ()):
            if more < _INF:
                way = (cost + more, rank, then)
                best[t] = min(best[t] or way, way)
    return _ranked(best)


def _backward_table(table: Table, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(min(c + b, _INF) for (c, _), b in zip(row, v, strict=True)) for row in table)


def crossings(tables: list[Table]) -> tuple[int, list[int]]:
    """(cost, states before, between and after the segments) of a whole conversation."""
    whole = functools.reduce(_forward_table, tables, _start(NOTHING))
    last = _crossing(whole, _END)
    states = [NOTHING] + [last] * len(tables)
    todo = [(0, len(tables))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1:
            mid = (lo + hi) // 2
            goal = tuple(0 if x == states[hi] else _INF for x in range(4))
            back = functools.reduce(lambda v, t: _backward_table(t, v), reversed(tables[mid:hi]), goal)
            states[mid] = _crossing(functools.reduce(_forward_table, tables[lo:mid], _start(states[lo])), back)
            todo += [(lo, mid), (mid, hi)]
    return whole[last][0] + _END[last], states


# --- Spark ---------------------------------------------------------------------------

_SEGMENT = "g string, part int, codes binary"


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for g, part, codes in pdf.itertuples(index=False):
            table = segment_table(codes)
            kinds = [c // 4 for c in codes]
            faults = [0] * 4
            for c in codes:
                faults[c % 4] += 1
            illegal = sum(p not in _LEGAL for p in zip(kinds, kinds[1:]))
            rows.append((g, part, kinds[0], kinds[-1], illegal, *faults[1:],
                         [c for row in table for c, _ in row], [r for row in table for _, r in row]))
        yield pd.DataFrame(rows, columns=["g", "part", "first", "last", "illegal", "blank", "duplicate", "truncated", "costs", "ranks"])


def _plans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for g, segments in pdf.itertuples(index=False):
            tables, illegal, before = [], 0, None
            for s in segments:
                pairs = list(zip(map(int, s["costs"]), map(int, s["ranks"]), strict=True))
                tables.append(tuple(tuple(pairs[k:k + 4]) for k in range(0, 16, 4)))
                illegal += s["illegal"] + (before is not None and (before, s["first"]) not in _LEGAL)
                before = s["last"]
            cost, states = crossings(tables)
            ends = [(s["part"], states[n], states[n + 1], _TAIL[states[-1]] if n == len(tables) - 1 else "")
                    for n, s in enumerate(segments)]
            rows.append((g, cost, illegal, ends))
        yield pd.DataFrame(rows, columns=["g", "cost", "illegal", "ends"])


def _audits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["audit"] = [audit_of(c, s, t) + tail for c, s, t, tail in zip(pdf["codes"], pdf["s"], pdf["t"], pdf["tail"], strict=True)]
        yield pdf[["g", "part", "audit"]]


_TURNS = pa.schema([("g", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_TURNS_SQL = "g string, place long, edit string, role string, text string"
_FLUSH_ROWS, _FLUSH_CHARS = 2000, 4_000_000


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits (rows with one) and rows in order to repaired turns, a few at a time."""
    out: list[tuple] = []
    chars, now, place, state = 0, None, 0, NOTHING
    letters: deque[str] = deque()

    def names(s: int) -> str:
        return "assistant" if s == USER else "user"

    for batch in batches:
        for n in range(batch.num_rows):
            g, audit, role, text = (batch.column(k)[n].as_py() for k in range(4))
            if g != now:
                now, place, state = g, 0, NOTHING
                letters.clear()
            turns: list[tuple[str, str, str]] = []
            if audit is not None:
                letters.extend(audit)
            else:
                while letters[0] == "I":
                    letters.popleft()
                    turns.append(("I", names(state), ""))
                    state = _wanted(state)
                edit = letters.popleft()
                if edit == "K":
                    turns.append(("K", role, text))
                    state = SYSTEM if role[:1] == "s" else _wanted(state)
                elif edit == "R":
                    turns.append(("R", names(state), text))
                    state = _wanted(state)
            # inserts that end the conversation follow its last row's letter
            while letters and all(x == "I" for x in letters):
                letters.popleft()
                turns.append(("I", names(state), ""))
                state = _wanted(state)
            for edit, role, text in turns:
                out.append((g, place, edit, role, text))
                place += 1
                chars += len(text) + len(role)
            if len(out) >= _FLUSH_ROWS or chars >= _FLUSH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TURNS)], schema=_TURNS)
                out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TURNS)], schema=_TURNS)


_HASH = pa.schema([("g", pa.string()), ("repaired_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha, done = None, hashlib.sha256(), []
    for batch in batches:
        for n in range(batch.num_rows):
            g, role, text = (batch.column(k)[n].as_py() for k in range(3))
            if g != now:
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = g, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], schema=_HASH)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], schema=_HASH)


class Repair:
    """What ``repair`` found: ``summary`` (conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit) and ``turns`` (g, place, edit, role, text), the repaired
    conversations; ``hashes`` gives (g, repaired_sha256) of those.  ``g`` is the
    conversation's id as text after ``1``, or ``0`` where it is null."""

    def __init__(self, summary: DataFrame, turns: DataFrame) -> None:
        self.summary, self.turns = summary, turns

    def hashes(self) -> DataFrame:
        """Turns of a conversation lie in one partition, in order; they are hashed as they pass."""
        return self.turns.select("g", "role", "text").mapInArrow(_digests, "g string, repaired_sha256 string")


def group_key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("1"), conv.cast("string")), F.lit("0"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Faults, cheapest edits and repaired turns of every conversation.

    Rows are taken by turn, null turns first.  Rows of one turn are ordered by
    the first ``TIE_CHARS`` characters of role and text, then by the digest of
    both; rows equal in all of that are equal.  A null role or text counts as one
    space, a null conversation id is a conversation of its own, a repeated
    row is a duplicate.  Columns that aren't named stay out; no rows give no rows.
    """
    one = F.lit(" ")
    r, x = F.coalesce(column(rows, role).cast("string"), one), F.coalesce(column(rows, text).cast("string"), one)
    keys = ["turn", "k_role", "k_text", "k_digest"]
    whole = rows.select(group_key(column(rows, conv)).alias("g"), column(rows, turn).alias("turn"),
                        F.left(r, F.lit(TIE_CHARS)).alias("k_role"), F.left(x, F.lit(TIE_CHARS)).alias("k_text"),
                        F.sha2(F.concat_ws("\x00", F.length(r).cast("string"), r, x), 256).alias("k_digest"), r.alias("role"), x.alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("k_role").asc(), F.col("k_text").asc(), F.col("k_digest").asc()]

    kind = F.lit(3)
    for initial, n in _CLASSES.items():
        kind = F.when(F.left("role", F.lit(1)) == initial, n).otherwise(kind)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(F.length(bare) == 0, _BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), _OK).otherwise(_TRUNCATED)
    narrow = whole.select("g", *keys, kind.alias("kind"), fault.alias("fault"), F.rand(7).alias("salt"))
    narrow = (narrow.repartitionByRange(F.col("g"), *order, F.col("salt"))
              .sortWithinPartitions(F.col("g"), *order, F.col("salt"))
              .select("g", *keys, "kind", "fault", F.monotonically_increasing_id().alias("mid")))
    narrow = materialize(narrow, "turns-in-order")
    # the first of equal rows, found by an aggregate and joined by the rows' own numbers: no key of it is hot
    first = narrow.where(F.col("fault") != _BLANK).groupBy("g", "k_digest").agg(F.min("mid").alias("mid")).select("mid", F.lit(True).alias("first"))
    judged = narrow.join(first, "mid", "left")
    fault = F.when((F.col("fault") != _BLANK) & F.col("first").isNull(), _DUPLICATE).otherwise(F.col("fault"))
    code = F.struct("mid", (F.col("kind") * 4 + fault).cast("int").alias("code"))
    segments = (judged.withColumn("part", F.shiftright("mid", 33).cast("int")).groupBy("g", "part").agg(
        F.sort_array(F.collect_list(code)).alias("codes"), F.min(F.struct("mid", *keys)).alias("at")))
    packed = F.unhex(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c["code"]), 2, "0")), ""))
    segments = materialize(segments.select("g", "part", packed.alias("codes"), *[F.col(f"at.{k}").alias(k) for k in keys]), "segments")

    tables = segments.select("g", "part", "codes").mapInPandas(
        _tables, "g string, part int, first int, last int, illegal long, blank long, duplicate long, truncated long, "
                 "costs array<long>, ranks array<int>")
    tables = materialize(tables, "segment-tables")
    plans = (tables.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("part", "first", "last", "illegal", "costs", "ranks"))).alias("segments"))
             .mapInPandas(_plans, "g string, cost long, illegal long, ends array<struct<part:int,s:int,t:int,tail:string>>"))
    plans = materialize(plans, "segment-plans")
    ends = plans.select("g", F.explode("ends").alias("e")).select("g", "e.*")
    audits = segments.select("g", "part", "codes").join(ends, ["g", "part"]).mapInPandas(_audits, "g string, part int, audit string")
    audits = materialize(audits, "segment-audits")

    faults = tables.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    spans = narrow.select("g", "turn").distinct().groupBy("g").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    joined = audits.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("part", "audit"))).alias("a"))
    summary = (plans.select("g", "cost", "illegal").join(faults, "g").join(spans, "g")
               .join(joined.select("g", F.array_join("a.audit", "").alias("audit")), "g"))

    # the rows again, each segment's audit just before its first row
    marks = segments.select("g", "part", *keys).join(audits, ["g", "part"]).select(
        "g", *keys, F.col("part").alias("tag"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    stream = whole.select("g", *keys, F.lit(2 ** 31 - 1).alias("tag"), F.lit(None).cast("string").alias("audit"), "role", "text").unionByName(marks)
    stream = stream.repartition("g").sortWithinPartitions(F.col("g"), *order, F.col("tag"))
    turns = stream.select("g", "audit", "role", "text").mapInArrow(_apply, _TURNS_SQL)
    return Repair(summary.select("g", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), turns)


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage of (conv_id, turn, role, text), chosen by CRC-32 of
    ``conv_id:turn``: a row is dropped, emptied, robbed of its full stops, repeated, or made the user's."""
    one = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(column(rows, c).cast("string"), one) for c in ("conv_id", "turn")])
    d = rows.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"),
                    (F.crc32(key.cast("binary")) % 20).alias("kind")).where("kind <> 0")
    d = d.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per conversation of ``before`` with what ``repair`` finds in
    ``after``: zeros, an empty audit and the digest of nothing where no rows are left."""
    done = repair(after)
    convs = before.select("conv_id").distinct().withColumn("g", group_key(F.col("conv_id")))
    d = convs.join(done.summary, "g", "left").join(done.hashes(), "g", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


# the twin: backward over the rows, each state's cheapest way on as text that sorts by cost, then audit
def _add(x: str, cost: str, letter: str, line: str) -> str:
    return (f"lpad((left({x}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || '{letter}' || substr({x}, 11, instr({x}, chr(1)) - 10)"
            f" || {line} || substr({x}, instr({x}, chr(1)) + 1)")


def _line(role: str, text: str) -> str:
    return f"{role} || ':' || {text} || chr(10)"


_USER, _ASSISTANT = _line("'user'", "''"), _line("'assistant'", "''")


def _ways(state: int) -> str:
    names = ("b0", "bs", "bu", "ba")
    to, role = (3, "'assistant'") if state == USER else (2, "'user'")
    keeps = [(to, "a" if state == USER else "u")] + ([(1, "s")] if state == NOTHING else [])
    ways = [_add(names[state], str(DELETE), "D", "''")]
    ways += [f"CASE WHEN fault IN (0, 3) AND kind = '{k}' THEN {_add(names[t], 'pen', 'K', _line('role', 'text'))} END" for t, k in keeps]
    ways.append(f"CASE WHEN fault IN (0, 3) THEN {_add(names[to], f'{REROLE} + pen', 'R', _line(role, 'text'))} END")
    return f"least({', '.join(ways)})"


_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
_CRC = (f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({_KEY}, ''), lambda ch: "
        "[ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, "
        "CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT)")
_BARE = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
SQL = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, {TIE_CHARS}), left(text, {TIE_CHARS}),
         sha256(length(role) || chr(0) || role || chr(0) || text), copy) AS pos FROM d),
f AS (
  SELECT *, left(role, 1) AS kind, CASE WHEN {_BARE} = '' THEN 1
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
         WHEN right({_BARE}, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault FROM o),
r AS MATERIALIZED (SELECT *, CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END AS pen, lag(kind) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM f),
b(conv_id, p, b0, bs, bu, ba) AS (
  SELECT conv_id, max(pos) + 1, '0000000000' || chr(1), '0000000004II' || chr(1) || {_USER} || {_ASSISTANT},
         '0000000002I' || chr(1) || {_ASSISTANT}, '0000000000' || chr(1) FROM r GROUP BY conv_id
  UNION ALL
  SELECT conv_id, p, least(b0, {_add('bu', str(INSERT), 'I', _USER)}), least(bs, {_add('bu', str(INSERT), 'I', _USER)}),
         least(bu, {_add('ba', str(INSERT), 'I', _ASSISTANT)}), least(ba, {_add('bu', str(INSERT), 'I', _USER)})
  FROM (SELECT b.conv_id, p - 1 AS p, {_ways(NOTHING)} AS b0, {_ways(SYSTEM)} AS bs, {_ways(USER)} AS bu, {_ways(ASSISTANT)} AS ba
        FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = p - 1) w),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (prev IS NOT NULL AND (prev || kind) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(b0, 10)::BIGINT, 0) AS cost,
       coalesce(substr(b0, 11, instr(b0, chr(1)) - 11), '') AS audit,
       sha256(coalesce(substr(b0, instr(b0, chr(1)) + 1, length(b0) - instr(b0, chr(1)) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND p = 1
"""
