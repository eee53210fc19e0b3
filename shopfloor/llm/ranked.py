r"""Ranked lexical search over a length-stratified index.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. Of N documents with
terms, with L terms in all, one of n terms has the normaliser m = 75 + (25 n N) div L. A term in df documents weighs
w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document scores the sum of w * ((10^9 tf) div (1000 tf + 12 m)) over an item's terms.

1. One pass over the whole texts gives each document's length and its counts of the terms that some item has.
2. Documents are dealt out by range of (m, hash of the id), so those of one normaliser stand together, in several tasks where
   they are many. A task takes up to ``SHELF`` postings at a time and groups them by stratum, that is by m; within a stratum
   the postings of a term stand by tf, and the impact of a tf is computed once for the stratum, not for each document.
3. The largest impact of each term bounds what an item can score in a stratum. An item visits strata by falling bounds and
   stops at the first bound below its k-th score; what a task has found goes on to its next shelf.
4. A task puts out its k best documents for each item, with all of equal rank settled; the best of them are ranked.

Scores are summed in 64-bit whole numbers; only bounds are doubles, rounded up. Items come in portions of at most ``PORTION`` bytes of text, an item longer than that alone; the terms and weights of one portion are
what all tasks are sent. Counts and weights are taken over all documents.

Null or empty text has no terms: such a document is not counted and not found, such an item finds nothing. Rows of documents
repeated in full are documents of their own, ranked by ``doc_id``, null first. Items are rows, too: two rows with one ``item_id``
each get their list, under that id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import require, written

K = 20
#: Postings a task indexes at once.
SHELF = 1_000_000
#: Bytes of text of the items searched at once.
PORTION = 4_000_000
#: Cells of (item, stratum) bounds computed at once.
CELLS = 4_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """All terms in order, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _features(docs: DataFrame, places: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents with terms: of the known terms by place, with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids, sizes, terms, counts = [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    words = terms_of(text.as_py())
                    if words:
                        tf = Counter(words)
                        held = sorted((known[w], tf[w]) for w in tf.keys() & known.keys())
                        ids.append(doc)
                        sizes.append(len(words))
                        terms.append([t for t, _ in held])
                        counts.append([c for _, c in held])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


class Stratum:
    """Documents of one normaliser: postings of each term by tf, with one impact for each (term, tf)."""

    def __init__(self, m: int, docs: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int):
        """``docs``, ``term``, ``tf``: one entry a posting, ``docs`` being places within the stratum."""
        order = np.lexsort((tf, term))
        self.docs, term, tf = docs[order], term[order], tf[order]
        opens = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(tf) != 0)))
        runs = np.diff(np.append(opens, len(term)))
        impact = (1_000_000_000 * tf[opens]) // (1000 * tf[opens] + 12 * m)
        self.impact = np.repeat(impact, runs)
        self.terms, first = np.unique(term, return_index=True)
        self.first = np.append(first, len(term))
        #: The largest impact of a term is that of its largest tf, the last of its postings.
        self.most = self.impact[self.first[1:] - 1]

    def bounds(self, weights: np.ndarray) -> np.ndarray:
        """For items (rows of term weights), the most a document of the stratum can score."""
        return weights[:, self.terms] @ self.most.astype(np.float64)

    def scores(self, weight: dict[int, int], size: int) -> np.ndarray:
        """Scores of all ``size`` documents."""
        mine = np.fromiter(weight, np.int64, len(weight))
        at = np.searchsorted(self.terms, mine)
        have = np.flatnonzero((at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == mine))
        out = np.zeros(size, np.int64)
        for k in have:
            a, b = self.first[at[k]], self.first[at[k] + 1]
            out[self.docs[a:b]] += self.impact[a:b] * weight[int(mine[k])]  # a document has a term once
        return out


class Shelf:
    """An index of some documents: their strata."""

    def __init__(self, rows: list[tuple[int, int | None, list[int], list[int]]], n_terms: int):
        """``rows``: (m, doc_id, terms, counts), by rising m."""
        self.strata: list[tuple[Stratum, np.ndarray, np.ndarray]] = []
        m = np.array([r[0] for r in rows], np.int64)
        edges = np.append(np.flatnonzero(np.append(True, np.diff(m) != 0)), len(m))
        for a, b in zip(edges, edges[1:], strict=False):
            part = rows[a:b]
            term = np.concatenate([np.asarray(r[2], np.int64) for r in part])
            if not len(term):
                continue
            place = np.repeat(np.arange(b - a), [len(r[2]) for r in part])
            tf = np.concatenate([np.asarray(r[3], np.int64) for r in part])
            ids = np.array([0 if r[1] is None else r[1] for r in part], np.int64)
            null = np.array([r[1] is None for r in part])
            self.strata.append((Stratum(int(m[a]), place, term, tf, n_terms), ids, null))

    def search(self, items: list[dict[int, int]], n_terms: int, best: list[list], k: int) -> int:
        """Bring ``best`` of every item (score, doc_id or null), its k best so far, up to date; returns the strata visited."""
        visited = 0
        step = max(1, CELLS // max(1, n_terms + len(self.strata)))
        for start in range(0, len(items), step):
            some = items[start : start + step]
            weights = np.zeros((len(some), n_terms))
            for row, item in enumerate(some):
                weights[row, list(item)] = list(item.values())
            if not self.strata:
                return visited
            bounds = np.stack([s.bounds(weights) for s, _, _ in self.strata], axis=1)
            for row, item in enumerate(some):
                mine = best[start + row]
                for at in np.argsort(-bounds[row], kind="stable"):
                    bound = bounds[row, at] * (1 + 1e-12)  # rounding of very large sums
                    if bound <= 0 or (len(mine) == k and bound < mine[-1][0]):
                        break
                    visited += 1
                    stratum, ids, null = self.strata[at]
                    scores = stratum.scores(item, len(ids))
                    good = np.flatnonzero(scores >= (mine[-1][0] if len(mine) == k else 1))
                    if len(good) > k:
                        least = np.partition(scores[good], len(good) - k)[len(good) - k]
                        good = good[scores[good] >= least]
                        good = good[np.lexsort((ids[good], ~null[good], -scores[good]))[:k]]
                    mine += [(int(scores[d]), None if null[d] else int(ids[d])) for d in good]
                    mine.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
                    del mine[k:]
        return visited


def _portions(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items with terms, in portions; only one portion at a time is held."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    held, size = [], 0
    for r in rows.toLocalIterator():
        more = len(r["text"])
        if held and size + more > PORTION:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += more
    if held:
        yield held


_FOUND = "item long, doc_id long, score long"


def _searched(docs: DataFrame, portion: list[tuple[int | None, str]], first: int, k: int) -> DataFrame:
    """(item, item_id, rank, doc_id, score) for one portion, whose items are numbered from ``first``."""
    counted = [Counter(terms_of(t)) for _, t in portion]
    names = sorted(set().union(*counted))
    places = {w: p for p, w in enumerate(names)}
    spark = docs.sparkSession
    features = written(_features(docs, places), "ranked-features")
    n_docs, length = features.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["term"]: r["df"] for r in features.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator()}
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(p, 0) + 1))) for p in range(len(names))]
    items = [{places[w]: weight[places[w]] * c for w, c in tf.items() if weight[places[w]] > 0 and places[w] in df} for tf in counted]
    sent = spark.sparkContext.broadcast(items)
    n_terms = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        best: list[list] = [[] for _ in items]
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[2])
                if size >= SHELF:
                    Shelf(rows, n_terms).search(items, n_terms, best, k)
                    rows, size = [], 0
        if rows:
            Shelf(rows, n_terms).search(items, n_terms, best, k)
        out = [(first + i, d, s) for i, found in enumerate(best) for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["item", "doc_id", "score"])

    m = F.expr(f"75 + (25 * n * {n_docs}L) DIV {max(1, length)}L")
    strata = features.where(F.size("terms") > 0).select(m.alias("m"), "doc_id", "terms", "counts", F.xxhash64("doc_id", "terms").alias("salt"))
    dealt = strata.repartitionByRange("m", "salt").sortWithinPartitions("m").drop("salt")
    found = written(dealt.mapInArrow(run, _FOUND), "ranked-found")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(first + i, item) for i, (item, _) in enumerate(portion)], "item long, item_id long")
    return ranked.join(ids, "item").select("item", "item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text)."""
    require(docs, "doc_id", "text")
    require(items, "item_id", "text")
    found, first = None, 0
    for portion in _portions(items):
        part = _searched(docs, portion, first, k)
        first += len(portion)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found.select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents),
a AS MATERIALIZED (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
q AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark),
t AS (SELECT item, item_id, term, count(*) AS c FROM (SELECT item, item_id, unnest(w) AS term FROM q) GROUP BY ALL),
p AS MATERIALIZED (SELECT r, doc_id, size, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS size, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n FROM a) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p GROUP BY term),
s AS (
  SELECT item, item_id, r, doc_id, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * a.n) // a.l)))) AS BIGINT) AS score
  FROM t JOIN p USING (term) JOIN v USING (term), a GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {K}
"""
