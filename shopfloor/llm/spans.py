r"""Substring dedup over sliding sentence spans.

A sentence ends with ``.``, ``!`` or ``?`` before white space, or with a line. From every sentence on, the shortest run of two or
more sentences with at least ``WORDS`` words is hashed; a longer repeated run holds repeated ones of these from each of its
sentences on. A sentence of ``LONG`` words or more is a run of its own, too: of clauses instead of sentences. Runs are joined over
all documents; every run but the first (by doc_id, then place) is repeated, and sentences that a repeated run covers are
removed with the white space behind them. Runs of fewer words stay, so that "Yes. No." is no passage.

Runs are told apart by 128 bits. They are counted by one aggregation and the repeated ones are joined back, where Spark splits a
hash that is too frequent. Null or empty text has no sentences. Rows of one id and one text are one document and get one result;
rows of one id with other texts are documents of their own, ordered by the hash of their text. A null id comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..session import materialize
from .common import fresh, require

#: Words of a run of sentences at least, and of a sentence that is a run of its own.
WORDS, LONG = 12, 40
_END = re.compile(r"[.!?][\x20\t-\r]+|\n[\x20\t-\r]*")
_SPACE = re.compile(r"[\x20\t-\r]+")
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def pieces(text: str) -> list[str]:
    """The text cut behind every sentence; blank pieces are no sentences."""
    ends = [m.end() for m in _END.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if a < b]


def words_of(piece: str) -> list[str]:
    return [w for w in _SPACE.split(piece) if w]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(text: str, words: int = WORDS, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, place and number of sentences of every run."""
    split = [w for p in pieces(text) if (w := words_of(p))]
    n = len(split)
    digests = [xxhash.xxh3_128_digest(" ".join(w).encode()) for w in split]
    own = np.frombuffer(b"".join(digests), np.uint64).reshape(n, 2)
    size = np.array([len(w) for w in split], np.int64)
    before = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(n)
    end = np.maximum(np.searchsorted(before, before[:-1] + words), place + 2)
    place, end = place[end <= n], end[end <= n]
    alone = np.flatnonzero(size >= long)
    place, end = np.concatenate([place, alone]), np.concatenate([end, alone + 1])
    # A run's hash is a polynomial of its sentences', taken from sums up to its ends.
    up, back = _powers(_STEP, n), _powers(_BACK, n)
    sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(own * up[:n, None], axis=0, dtype=np.uint64)])
    runs = (sums[end] - sums[place]) * back[place][:, None] + (end - place).astype(np.uint64)[:, None]
    return runs[:, 0], runs[:, 1], place, end - place


def span_runs(docs: DataFrame, words: int, long: int) -> DataFrame:
    """(run, other, doc_id, row, place, length) of every run; ``row`` tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [run_hashes(t or "", words, long) for t in part.column(2).to_pylist()]
                owner = pa.array(np.repeat(np.arange(part.num_rows), [len(f[0]) for f in found]))
                joined = lambda k, kind: pa.array(np.concatenate([f[k] for f in found]).view(np.int64).astype(kind))
                yield pa.RecordBatch.from_arrays(
                    [joined(0, np.int64), joined(1, np.int64), part.column(0).take(owner), part.column(1).take(owner), joined(2, np.int32), joined(3, np.int32)],
                    names=["run", "other", "doc_id", "row", "place", "length"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").mapInArrow(run, "run long, other long, doc_id long, row long, place int, length int")


def repeated_sentences(docs: DataFrame, words: int = WORDS, long: int = LONG) -> DataFrame:
    """(doc_id, row, starts): places and lengths of the repeated runs of documents that have any."""
    runs = materialize(span_runs(docs, words, long), "span-runs")
    at = F.struct("doc_id", "row", "place")
    counted = runs.groupBy("run", "other").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("run", "other", "first")
    again = runs.join(materialize(counted, "span-repeats"), ["run", "other"]).where(at != F.col("first"))
    return again.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("place", "length"))).alias("starts"))


def without_repeats(docs: DataFrame, words: int = WORDS, long: int = LONG) -> DataFrame:
    """``docs`` with ``text`` cut down, and ``n_sentences``, ``n_removed`` and ``removed`` (start and end in code points)."""
    require(docs, "doc_id", "text")
    plain = docs.drop("n_sentences", "n_removed", "removed")
    of, row, starts = fresh(plain, "of", "row", "starts")
    found = materialize(repeated_sentences(plain, words, long), "span-removals").toDF(of, row, starts)
    held = plain.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(row)), "left").drop(of, row)
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [cut(t, s) for t, s in zip(part.column("text").to_pylist(), part.column(starts).to_pylist(), strict=True)]
                columns = [pa.array([m[0] for m in made], pa.string()) if c == "text" else part.column(c) for c in names]
                spans = pa.array([m[3] for m in made], pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), spans], names=[*names, "n_sentences", "n_removed", "removed"])

    schema = StructType([*plain.schema.fields, StructField("n_sentences", LongType()), StructField("n_removed", LongType()), StructField("removed", ArrayType(ArrayType(LongType())))])
    return held.mapInArrow(run, schema)


def cut(text: str | None, starts: list[dict] | None) -> tuple[str | None, int, int, list[list[int]]]:
    """The text without the sentences of its repeated runs, the numbers of sentences and of removed ones, and their spans."""
    gone = {s["place"] + k for s in starts or () for k in range(s["length"])}
    kept, spans, place, at = [], [], 0, 0
    for piece in pieces(text or ""):
        if _SPACE.fullmatch(piece):
            kept.append(piece)
        else:
            if place not in gone:
                kept.append(piece)
            elif spans and spans[-1][1] == at:
                spans[-1][1] = at + len(piece)
            else:
                spans.append([at, at + len(piece)])
            place += 1
        at += len(piece)
    return text if text is None else "".join(kept), place, len(gone), spans


def deduplicated(docs: DataFrame) -> DataFrame:
    return without_repeats(docs.select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", F.col("removed").cast("string").alias("removed"), "text")


_W = r"[ \t-\r]"
SQL = rf"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?]{_W}+|\n{_W}*)', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents),
x AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM p),
y AS (SELECT *, list_filter(string_split_regex(piece, '{_W}+'), lambda v: v <> '') AS w, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS off FROM x),
z AS (SELECT *, array_to_string(w, ' ') AS s, len(w) AS n, len(w) > 0 AS real FROM y),
q AS MATERIALIZED (SELECT *, row_number() OVER d AS place, sum(n) OVER d AS upto FROM z WHERE real WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, list(s ORDER BY place) AS said FROM q GROUP BY doc_id),
t AS (
  SELECT a.doc_id, a.place, min(b.place) - a.place + 1 AS length FROM q a JOIN q b ON a.doc_id = b.doc_id AND b.place > a.place AND b.upto - a.upto + a.n >= {WORDS} GROUP BY a.doc_id, a.place
  UNION ALL SELECT doc_id, place, 1 FROM q WHERE n >= {LONG}),
r AS (SELECT doc_id, place, length, array_to_string(said[place:place + length - 1], '|') || length AS run FROM t JOIN h USING (doc_id)),
f AS (SELECT run, min((doc_id, place)) AS first FROM r WHERE run IS NOT NULL GROUP BY run),
gone AS (SELECT DISTINCT doc_id, unnest(range(place, place + length)) AS place FROM r JOIN f USING (run) WHERE (doc_id, place) <> first),
m AS (SELECT z.*, q.place, g.place IS NOT NULL AS away FROM z LEFT JOIN q USING (doc_id, i) LEFT JOIN gone g ON g.doc_id = z.doc_id AND g.place = q.place),
e AS (SELECT *, away AND NOT coalesce(lag(away) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m),
k AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
spans AS (SELECT doc_id, span, min(off) AS a, max(off + length(piece)) AS b FROM k WHERE away GROUP BY ALL),
listed AS (SELECT doc_id, string_agg('[' || CAST(a AS BIGINT) || ', ' || CAST(b AS BIGINT) || ']', ', ' ORDER BY a) AS removed FROM spans GROUP BY 1)
SELECT doc_id, count(*) FILTER (WHERE real) AS n_sentences, count(*) FILTER (WHERE away) AS n_removed, '[' || coalesce(any_value(removed), '') || ']' AS removed,
  coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE NOT away), '') AS text
FROM m LEFT JOIN listed USING (doc_id) GROUP BY doc_id
"""
