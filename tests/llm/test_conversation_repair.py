"""Conversation repair against a plain search over all edits."""

import functools
import hashlib
import random
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from babelgrid.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, g string, mid long, tag int"
SPACE = " \t\n\x0b\x0c\r"
sys.setrecursionlimit(20000)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        n = zlib.crc32(key.encode()) % 20
        if n == 0:
            continue
        if n == 1:
            text = ""
        if n == 2:
            text = "".join(c for c in text if c not in ".!?")
        if n == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if n == 3 else 1)
    return out


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's rows in order."""
    seen, faults, counts = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        f = 1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3
        seen.add((role, text))
        faults.append(f)
        if f:
            counts[f - 1] += 1
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    @functools.cache
    def best(n, last, inserted):
        """(cost, audit, turns) from row n on; ``last`` is the last initial put out."""
        ways = []
        want = "assistant" if last == "u" else "user"
        if n == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            c, a, t = best(n, want[0], inserted + 1)
            ways.append((c + 2, "I" + a, ((want, ""), *t)))
        if n < len(rows):
            c, a, t = best(n + 1, last, 0)
            ways.append((c + 3, "D" + a, t))
            if faults[n] in (0, 3):
                role, text = rows[n][2], rows[n][3]
                more = faults[n] == 3
                if role[:1] == want[0] or (role[:1] == "s" and last == ""):
                    c, a, t = best(n + 1, role[:1], 0)
                    ways.append((c + more, "K" + a, ((role, text), *t)))
                c, a, t = best(n + 1, want[0], 0)
                ways.append((c + 2 + more, "R" + a, ((want, text), *t)))
        return min(ways) if ways else (10 ** 9, "", ())

    cost, audit, out = best(0, "", 0)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *counts, illegal, cost, audit, sha


def plain_report(before, after):
    out = []
    for conv in {r[0] for r in before}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2][:64], r[3][:64],
            hashlib.sha256(f"{len(r[2])}\0{r[2]}\0{r[3]}".encode()).hexdigest()))
        out.append((conv, *plain_repair(mine)))
    return sorted(out, key=str)


def rows_of(seed, convs=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", "  \n", "Why? ", "x" * 3000 + ".", "a" * 80 + " 1.", "a" * 80 + " 2", None]
    roles = ["user", "assistant", "system", "tool", "", "User", None, "u", "a"]
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(1, 9)):
            want = roles[turn % 2]
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]),
                         want if rng.random() < 0.6 else rng.choice(roles),
                         f"Text {turn}." if rng.random() < 0.6 else rng.choice(texts)))
    return [*rows, rows[0], rows[0], rows[5]]


@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed):
    rows = rows_of(seed)
    d = spark.createDataFrame([(*r, "g", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = cr.report(d, cr.damage(d))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_report(rows, plain_damage(rows))


def test_empty(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert cr.report(d, cr.damage(d)).collect() == []
    one = spark.createDataFrame([(1, 0, "user", "Hi.", "g", 1, 2)], SCHEMA)
    r = cr.report(one, cr.damage(one).where("false")).first()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_one_conversation_over_many_segments(spark):
    """A conversation with all rows is cut by the range partition and still solved as a whole."""
    rng = random.Random(5)
    rows = [(1, k, rng.choice(["user", "user", "assistant", "system", "x"]), rng.choice(["A.", "b", "", f"Line {k}."]))
            for k in range(400)]
    rows += [(1, None, "user", "same.")] * 200
    d = spark.createDataFrame([(*r, "g", 1, 2) for r in rows], SCHEMA).repartition(4)
    joined = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(joined, "false")
    try:
        done = cr.repair(d)
        turns = done.turns.orderBy("place").collect()
        got = done.summary.join(done.hashes(), "g").first()
    finally:
        spark.conf.unset(joined)
    want = plain_report(rows, rows)[0]
    assert (got.gaps, got.blank, got.duplicate, got.truncated, got.illegal, got.cost, got.audit, got.repaired_sha256) == want[1:]
    assert [t.place for t in turns] == list(range(len(turns)))
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == want[-1]


@pytest.mark.parametrize("size", [1, 3, 7, 50])
def test_segments_meet_like_one(size):
    """Hirschberg over tables of any cut gives what it gives over all rows."""
    rng = random.Random(size)
    codes = bytes(rng.randrange(16) for _ in range(200))
    cost, states = cr.crossings([cr.segment_table(codes)])
    whole = cr.audit_of(codes, states[0], states[1])
    cuts = [codes[k:k + size] for k in range(0, len(codes), size)]
    cost2, states2 = cr.crossings([cr.segment_table(c) for c in cuts])
    assert cost2 == cost and states2[-1] == states[-1]
    assert "".join(cr.audit_of(c, states2[n], states2[n + 1]) for n, c in enumerate(cuts)) == whole


def test_damage_kinds(spark):
    rows = [(k, 0, "assistant", "One. Two!") for k in range(200)]
    got = cr.damage(spark.createDataFrame([(*r, "g", 1, 2) for r in rows], SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_damage(rows))
    assert got.where(F.col("text") == "One Two").count() > 0
