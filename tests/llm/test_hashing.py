"""Nearest neighbours by binary codes against all distances."""

from __future__ import annotations

import numpy as np
import pytest

from shopfloor.llm import hashing
from shopfloor.llm.queries import op12_hashing

ROWS = "vec_id long, embedding array<double>"


def exact(ids: np.ndarray, rows: np.ndarray, queries: list[int], k: int) -> dict[int, list[tuple[float, int]]]:
    out = {}
    for q in queries:
        apart = np.sqrt(((rows - rows[np.flatnonzero(ids == q)[0]]) ** 2).sum(axis=1))
        out[q] = sorted((d, i) for d, i in zip(apart.tolist(), ids.tolist(), strict=True) if i != q)[:k]
    return out


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall(spark, folder):
    path = f"/root/testdata/{folder}"
    table = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    want = exact(table.vec_id.to_numpy(), np.array([np.asarray(v, float) for v in table.embedding]), [i for i in table.vec_id if i % 100 == 0], 10)
    rows = op12_hashing(spark, path).collect()
    hits, ranks = 0, {}
    for r in rows:
        ranks.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    for q, best in want.items():
        got = sorted(ranks[q])
        assert [x[0] for x in got] == list(range(1, 11)) and [x[1:] for x in got] == sorted(x[1:] for x in got)
        exactly = {i: d for d, i in best}
        hits += sum(i in exactly and abs(exactly[i] - s) < 1e-12 for _, s, i in got)
    assert hits / (10 * len(want)) >= 0.97


def test_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(700, 20))
    codes = hashing.Codes(rows[:300], bits=72)
    shard = hashing.Shard(codes, np.arange(700), np.zeros(700, bool), rows)
    all_codes = np.unpackbits(codes.of(rows), axis=1)
    for radius in (0, 1, 5, 8, 9, 17, 30, 44, 72):
        for q in range(0, 700, 90):
            want = np.flatnonzero((all_codes != all_codes[q]).sum(axis=1) <= radius)
            assert shard.within(codes, codes.of(rows[q : q + 1])[0], radius).tolist() == want.tolist()


def test_odd_rows_ties_and_copies(spark, monkeypatch):
    """Unusable vectors take no part, equal vectors are ranked by id, extra columns do no harm, shards and blocks of any size agree."""
    rng = np.random.default_rng(4)
    good = [(k, rng.normal(size=6).tolist()) for k in range(330)] + [(500 + k, [1.0] * 6) for k in range(150)] + [(None, [1.0] * 6)]
    odd = [(1000, None), (1100, []), (1200, [0.0] * 6), (1300, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1400, [float("nan")] * 6), (1500, [float("inf")] + [1.0] * 5), (1600, [1.0, 2.0]), (901, [1e300] * 6)]
    table = spark.createDataFrame(good + odd, ROWS).selectExpr("*", "'a' AS rank", "'b' AS score", "'c' AS block", "'d' AS query_id")
    whole = [(i, v) for i, v in good if i is not None]
    want = exact(np.array([i for i, _ in whole]), np.array([v for _, v in whole]), [0, 100, 200, 300, 500, 600], 10)

    def got() -> dict:
        out: dict[int, list] = {}
        for r in sorted(hashing.every_hundredth(table.repartition(3)).collect(), key=lambda r: (r["query_id"], r["rank"])):
            out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        return out

    first = got()
    assert set(first) == set(want)
    for q in (0, 100, 200, 300):
        assert len(set(first[q]) & set(want[q])) >= 8 and first[q] == sorted(first[q])
    assert first[500] == [(0.0, None)] + [(0.0, i) for i in range(501, 510)]
    assert first[600] == [(0.0, None)] + [(0.0, i) for i in range(500, 509)]
    monkeypatch.setattr(hashing, "BLOCK", 2)
    second = got()
    assert second[500] == first[500] and set(second) == set(first)


@pytest.mark.parametrize("rows", [[], [(100, None)], [(100, [1.0, 2.0])], [(100, [1.0]), (101, [2.0]), (101, [2.0])]])
def test_small_tables(spark, rows):
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hashing.every_hundredth(spark.createDataFrame(rows, ROWS)).collect()]
    assert sorted(got) == ([(100, 1, 101, 1.0), (100, 2, 101, 1.0)] if len(rows) == 3 else [])
