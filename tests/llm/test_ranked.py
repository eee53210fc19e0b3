"""Ranked search against scores of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shopfloor.llm import ranked

from .helpers import empty, frame, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text: str | None) -> list[str]:
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    held = [(d, Counter(w), len(w)) for d, t in docs if (w := terms(t))]
    n, length = len(held), sum(size for _, _, size in held)
    df = Counter(w for _, tf, _ in held for w in tf)
    out = []
    for item, text in items:
        scores = []
        for d, tf, size in held:
            m = 75 + (25 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in terms(text) if w in tf)
            scores.append((-s, d is not None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(x for x in scores if x[0])[:k], 1)]
    return out


def by_item(rows) -> list[tuple]:
    return sorted(((r[0], *r[1:]) for r in rows), key=str)


@pytest.mark.parametrize("shelf,portion", [(ranked.SHELF, ranked.PORTION), (300, 900)])
def test_ranks_equal_all_scores(spark, monkeypatch, shelf, portion):
    monkeypatch.setattr(ranked, "SHELF", shelf)
    monkeypatch.setattr(ranked, "PORTION", portion)
    rng = random.Random(3)
    docs = [*texts(), *[(1000 + k, "tied words here") for k in range(30)], (5, "A second text under one ID, tied words")]
    items = [(k, " ".join(rng.choices((docs[k][1] or "").split(), k=12))) for k in range(12)]
    items += [(50, "Tied WORDS here words"), (50, "another one: words"), (None, "the very same line"), (60, None), (61, " .,"), (62, "unheard of"), (63, "漢字 É x\x85")]
    table = frame(spark, docs, clashes=True).selectExpr("*", "1 AS m", "2 AS salt", "'t' AS terms", "'c' AS counts")
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "'x' AS rank", "'y' AS item")
    got = ranked.ranked(table.repartition(3), asked, 20).collect()
    assert by_item(map(tuple, got)) == by_item(plain(docs, items, 20))


def test_strata_skipped_by_bounds_hold_no_better_document():
    rng = np.random.default_rng(6)
    rows = sorted(((int(rng.integers(75, 400)), d, sorted(rng.choice(40, 8, replace=False).tolist()), rng.integers(1, 9, 8).tolist()) for d in range(3000)), key=lambda r: r[0])
    shelf = ranked.Shelf(rows, 40)
    items = [{int(t): int(w) for t, w in zip(rng.choice(40, 3, replace=False), rng.integers(1, 5000, 3), strict=True)} for _ in range(20)]
    best: list[list] = [[] for _ in items]
    visited = shelf.search(items, 40, best, 5)
    assert visited < 0.9 * len(items) * len(shelf.strata)
    for item, found in zip(items, best, strict=True):
        scores = [(-sum(item.get(t, 0) * ((10**9 * c) // (1000 * c + 12 * m)) for t, c in zip(ts, cs, strict=True)), d) for m, d, ts, cs in rows]
        assert [(-s, d) for s, d in sorted(scores)[:5]] == found


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "some words")], ITEMS)
    assert ranked.ranked(frame(spark), none).collect() == []
    assert ranked.ranked(empty(spark), some).collect() == []
    assert ranked.ranked(frame(spark, [(1, None), (2, "")]), some).collect() == []


def test_a_very_long_text(spark):
    docs = [(1, "alpha beta " * 400_000), (2, "gamma alpha")]
    got = ranked.ranked(frame(spark, docs), spark.createDataFrame([(1, "alpha")], ITEMS)).collect()
    assert sorted(tuple(r) for r in got) == plain(docs, [(1, "alpha")], 20)
