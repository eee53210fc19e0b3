"""Conversation repair against all derivations tried out."""

from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256
from itertools import product

import pytest

from shopfloor.llm import repair

ROWS = "conv_id long, turn long, role string, text string"


def plain(rows: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's rows (turn, role, text), every edit tried."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    best = None
    for edits in product("KuaD", repeat=len(rows)):
        for extra in product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            cost, audit, out, roles = 0, "", [], ""
            for k in range(len(rows) + 1):
                for r in extra[k]:
                    cost, audit, roles = cost + 5, audit + "I", roles + r
                    out.append(repair.ROLES[r] + ":")
                if k == len(rows):
                    break
                e = edits[k]
                if e == "D":
                    cost, audit = cost + 2, audit + "D"
                    continue
                if faults[k] in (1, 2):
                    cost = 10**6
                    break
                role = rows[k][1] if e == "K" else repair.ROLES[e]
                cost += (e != "K") + 5 * (faults[k] == 3)
                audit, roles = audit + ("K" if e == "K" else "R"), roles + (role[:1] or "-")
                out.append(f"{role}:{rows[k][2]}")
            if cost < 10**6 and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(out))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, best[0], best[1], sha256(best[2].encode()).hexdigest()


def hurt(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def made(n: int, rng: random.Random, most: int = 4) -> list[tuple]:
    rows = []
    for conv in range(n):
        for turn in rng.sample(range(9), rng.randint(1, most)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No", "Why? ", "\t \n", "", None, "é \x85"])))
    return rows


def test_report_equals_all_derivations(spark):
    rows = made(45, random.Random(5), 3) + [(None, None, "user", "Null."), (None, 1, "assistant", "One."), (77, None, None, None)]
    dropped = next(c for c in range(10**6, 10**7) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    table = spark.createDataFrame(rows, ROWS).selectExpr("*", "'x' AS at", "'y' AS audit", "1 AS cost", "2 AS part")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_report(table).collect()}
    left = hurt(rows)
    want = {c: plain([r[1:] for r in left if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())


def test_lightest_of_any_entry():
    """Values over all rows equal those joined from pieces, wherever they are cut."""
    rng = random.Random(2)
    for _ in range(60):
        rows = tuple((rng.choice("suat"), rng.randint(0, 3)) for _ in range(rng.randint(2, 9)))
        whole = tuple(repair.lightest(rows, q) for q in range(4))
        for cut in range(1, len(rows)):
            parts = [tuple(repair.lightest(p, q) for q in range(4)) for p in (rows[:cut], rows[cut:])]
            assert repair.joined(*parts) == whole


def test_a_long_conversation_in_pieces(spark, monkeypatch):
    """A conversation over many tasks and pieces; repeated rows and ties of turn have one result."""
    monkeypatch.setattr(repair, "PIECE", 7)
    rng = random.Random(8)
    rows = [(1, k // 2, rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 700)}" + rng.choice([".", "", "?"])) for k in range(1500)]
    rows += [(2, 0, "user", "Same.")] * 400
    turns = repair.ordered(spark.createDataFrame(rows, ROWS).repartition(3))
    found = {r["conv_id"]: r for r in repair.audits(turns).collect()}
    assert found[2]["duplicate"] == 399 and found[2]["audit"] == "D" * 400 and found[2]["cost"] == 800
    order = [r for r in sorted(turns.where("conv_id = 1").collect(), key=lambda r: r["at"])]
    seen, told = set(), []
    for r in order:
        fault = 2 if (r["role"], r["text"]) in seen else 0 if r["text"][-1] in ".!?" else 3
        seen.add((r["role"], r["text"]))
        told.append((r["role"][0], fault))
    values = repair.lightest(tuple(told), 0)
    assert (found[1]["cost"], found[1]["audit"]) == min(values[q] for q in repair.GOALS if values[q])
    out = repair.repaired(turns, repair.audits(turns)).where("conv_id = 1").orderBy("position").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in out)) and [r["position"] for r in out] == list(range(len(out)))
    assert "".join(r["edit"] for r in out) == found[1]["audit"].replace("D", "")


@pytest.mark.parametrize("rows", [[], [(1, 0, None, None)], [(None, None, None, None)]])
def test_small_tables(spark, rows):
    got = repair.repair_report(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == len(rows)


def test_a_very_long_text(spark):
    rows = [(3, 0, "user", "a" * 2_000_000 + "."), (3, 1, "assistant", "b c " * 500_000 + "!")]
    turns = repair.ordered(spark.createDataFrame(rows, ROWS))
    assert [r["audit"] for r in repair.audits(turns).collect()] == ["KK"]
