r"""Approximate nearest neighbours by multi-index hashing.

1. Codes are learned on a sample of at most ``SAMPLE`` vectors (the least hashes of their ids): principal axes, then rotations
   that bring the projections nearest to the corners of a cube (iterative quantisation); several rotations with other starts
   follow one another until there are ``BITS`` bits. On pairs of the sample the least Hamming radius is learned that holds a
   share ``HELD`` of the pairs of every distance.
2. Every row is indexed: a task cuts its part of the table into shards of ``SHARD`` rows, each with the vectors, the codes, and
   for every substring of eight bits the rows by its value.
3. Queries come in blocks of ``BLOCK`` rows, a stated set against all rows. A query's radius is that of the k-th distance known
   so far, first from the sample, then from the shards already searched in the task. By the pigeonhole principle a code
   within radius r = a s + t of s substrings is within a of one of the first t + 1 substrings or within a - 1 of another one:
   these values are looked up, so every code within the radius is retrieved. Codes found are held against the radius and
   reranked by their floats; a shard returns at most k rows for each query.

Distances are Euclidean in double precision, computed from the vectors as they are. Vectors that are null, empty, zero, or hold
a null or a number that is not finite take no part, nor do vectors of another length than the commonest (ties: the least).
Rows repeated in full are rows of their own; a query is not its own neighbour, by id. Rows with a null id are no queries and come
first among equals. Nothing is capped: a shard of equal vectors is reranked whole, k rows of it leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require, written

#: Vectors that codes and radii are learned from.
SAMPLE = 10_000
#: Bits of a code, and the share of the pairs of a distance that its radius holds.
BITS, HELD = 256, 0.99
#: Rows of a shard and queries of a block, both held in memory whole.
SHARD, BLOCK = 20_000, 10_000
ROUNDS, BINS, LEAST_PAIRS = 25, 200, 200
#: Bits that differ between two bytes.
_APART = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def usable(vector: Column) -> Column:
    """Whether a vector can take part, its length apart."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def cleaned(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    require(vectors, "vec_id", "embedding")
    whole = vectors.select(F.col("vec_id").cast("long"), "embedding").where(usable(F.col("embedding")))
    width = whole.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).first()
    return whole.where(F.size("embedding") == (width["width"] if width else 0))


def _distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(((rows - query) ** 2).sum(axis=1))


class Codes:
    """Learned rotations and radii."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, held: float = HELD):
        """``sample``: at least one row; rows beyond the sample's own are coded by the same rotations."""
        self.scale = float(np.abs(sample).max())  # else squares of very large numbers are lost
        self.mean = (sample / self.scale).mean(axis=0)
        centred = sample / self.scale - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :bits]
        projected, self.turns, made = centred @ axes, [], 0
        while made < bits:
            self.turns.append(axes @ self._rotation(projected, len(self.turns)))
            made += axes.shape[1]
        self.turn = np.concatenate(self.turns, axis=1)[:, :bits]
        self.substrings = -(-bits // 8)
        self._learn_radii(sample, held)

    @staticmethod
    def _rotation(projected: np.ndarray, seed: int) -> np.ndarray:
        """The rotation that brings rows nearest to corners, found from a random start."""
        size = projected.shape[1]
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]
        for _ in range(ROUNDS):
            corners = np.where(projected @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(projected.T @ corners)
            turn = u @ v
        return turn

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Codes as bytes, one substring each."""
        return np.packbits((rows / self.scale - self.mean) @ self.turn >= 0, axis=1)

    def _learn_radii(self, sample: np.ndarray, held: float) -> None:
        """For bins of distance, the radius that holds the share of its pairs; never less than that of a smaller distance."""
        few = sample[:: max(1, len(sample) // 500)]
        codes, some = self.of(sample), self.of(few)
        apart = np.concatenate([_distances(sample, x) for x in few])
        bits = np.concatenate([_APART[c, codes].sum(axis=1) for c in some])[np.isfinite(apart)]
        apart = apart[np.isfinite(apart)]
        self.step = max(float(apart.max()), 1e-12) / BINS
        bins = np.minimum((apart / self.step).astype(int), BINS - 1)
        self.radius = np.full(BINS + 1, 8 * self.substrings)
        most = 8 * self.substrings
        for b in range(BINS - 1, -1, -1):
            mine = bits[bins == b]
            if len(mine) >= LEAST_PAIRS:
                most = min(most, int(np.ceil(np.quantile(mine, held))))
            self.radius[b] = most  # too few pairs: the radius of the next larger distance

    def radius_of(self, distance: float) -> int:
        """Radius for a distance; all codes if it is beyond what the sample shows."""
        at = distance / self.step + 1  # the bin above, so that rounding loses nothing
        return int(self.radius[int(at)]) if at < BINS else 8 * self.substrings

    def words(self, codes: np.ndarray) -> np.ndarray:
        """Codes as words of 64 bits."""
        return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)


class Shard:
    """Vectors with their codes, indexed by the values of every substring."""

    def __init__(self, codes: Codes, ids: np.ndarray, null: np.ndarray, rows: np.ndarray):
        self.ids, self.null, self.rows = ids, null, rows
        own = codes.of(rows)
        self.words = codes.words(own)
        #: Of each substring: rows by value, the values there are, and how many rows have each.
        self.index = [(np.argsort(c, kind="stable"), *np.unique(c, return_counts=True)) for c in own.T]

    def within(self, codes: Codes, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all rows whose code is within the radius."""
        each, over = divmod(radius, len(code))
        hit = np.zeros(len(self.rows), bool)
        for i, (order, values, counts) in enumerate(self.index):
            near = _APART[code[i]][values] <= (each if i <= over else each - 1)
            hit[order[np.repeat(near, counts)]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.words[found] ^ codes.words(code[None, :])).sum(axis=1) <= radius]

    def nearest(self, codes: Codes, query: np.ndarray, code: np.ndarray, own: int, k: int, known: float) -> tuple[np.ndarray, np.ndarray]:
        """(place, distance) of the k nearest rows with codes within the radius of the distance ``known``, the query's own id apart."""
        near = self.within(codes, code, codes.radius_of(known))
        near = near[(self.ids[near] != own) | self.null[near]]
        apart = _distances(self.rows[near], query)
        near, apart = near[apart <= known], apart[apart <= known]
        if len(near) > k:
            # Ties at the k-th distance are settled by id, null first.
            kth = np.partition(apart, k - 1)[k - 1]
            close = np.flatnonzero(apart <= kth)
            near, apart = near[close], apart[close]
        best = np.lexsort((self.ids[near], ~self.null[near], apart))[:k]
        return near[best], apart[best]


def _sample(clean: DataFrame, size: int) -> np.ndarray:
    """At most ``size`` vectors, those with the least hashes of their ids."""
    rows = clean.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(size).select("embedding").collect()
    return np.array([r["embedding"] for r in rows], np.float64)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, vectors = batch.column(0), batch.column(1)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), flat.reshape(batch.num_rows, -1)


_FOUND = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE, bits: int = BITS, held: float = HELD) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` (vec_id, embedding) found for every row of ``queries``.

    The codes, the radii and one block of queries at a time, all of bounded size, are sent to all tasks. ``score`` is the
    distance; equal ones are ranked by ``vec_id``. Queries that repeat an id are searched once, with the least vector.
    """
    spark = vectors.sparkSession
    clean = written(cleaned(vectors), "ann-vectors")
    learned = _sample(clean, sample)
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(learned):
        return spark.createDataFrame([], schema)
    codes = Codes(learned, bits, held)
    width = learned.shape[1]
    asked = queries.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") == width))
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-asked.count() // BLOCK))
    # By range, each block has about BLOCK queries; the bound is on the average, a hash keeps blocks alike.
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "ann-queries")

    found: DataFrame | None = None
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).select("vec_id", "embedding").toArrow()
        if not rows.num_rows:
            continue
        ids, _, held_rows = _arrays(rows.combine_chunks().to_batches()[0])
        sent = spark.sparkContext.broadcast((codes, ids, held_rows, codes.of(held_rows), _first_bounds(learned, held_rows, k)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            codes, ids, asked_rows, asked_codes, bounds = sent.value
            best = [np.array([b]) for b in bounds]  # the k least distances known, of which the last is the bound

            def searched(parts: list) -> pa.RecordBatch:
                shard = Shard(codes, *(np.concatenate([p[c] for p in parts]) for c in range(3)))
                out: list[list[np.ndarray]] = [[], [], [], []]
                for q in range(len(ids)):
                    places, apart = shard.nearest(codes, asked_rows[q], asked_codes[q], ids[q], k, float(best[q][-1]))
                    if len(places):
                        both = np.sort(np.concatenate([best[q], apart]))
                        best[q] = both[:k] if len(both) > k else both
                        out[0].append(np.full(len(places), ids[q]))
                        out[1].append(shard.ids[places])
                        out[2].append(apart)
                        out[3].append(shard.null[places])
                joined = [np.concatenate(c) if c else np.zeros(0) for c in out]
                return pa.RecordBatch.from_arrays(
                    [pa.array(joined[0].astype(np.int64)), pa.array(joined[1].astype(np.int64), mask=joined[3].astype(bool)), pa.array(joined[2].astype(np.float64))], names=["query_id", "vec_id", "score"]
                )

            held, size = [], 0
            for batch in batches:
                held.append(_arrays(batch))
                size += batch.num_rows
                if size >= SHARD:
                    yield searched(held)
                    held, size = [], 0
            if size:
                yield searched(held)

        part = written(clean.mapInArrow(run, _FOUND), "ann-found")
        sent.unpersist()
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy("score", F.col("vec_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _first_bounds(sample: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """An upper bound of each query's k-th distance: the sample is part of the table; one more for the query itself."""
    if len(sample) <= k:
        return np.full(len(rows), np.inf)
    return np.array([np.partition(_distances(sample, x), k)[k] for x in rows])


def every_hundredth(vectors: DataFrame, k: int = 10) -> DataFrame:
    """``nearest`` for the rows whose id is divisible by 100."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k)
