"""N-gram Jaccard join with a MinHash LSH forest.

1. A text becomes the set of hashes of its runs of five words. Texts with equal sets form a copy class; from here on one
   row stands for a class.
2. Every tree gives a set a signature of ``depth`` min-hashes; the classes that share a prefix of it are a node of the tree's
   prefix trie. All classes of a node are linked to its least one: these links make candidate components. The search starts
   with whole signatures and shortens the prefix, level by level, until the recall estimated from the links found reaches
   ``recall``: a link of similarity s shares a prefix of m in some of k trees with probability p = 1 - (1 - s^m)^k, so it
   stands for 1 / p links. Links that were found by way of a third class make the estimate too low, never too high. Where no
   link was found, p at the similarity wanted is used. A level verifies only the components that it has changed.
3. Candidate components are cut into blocks by their total size, and every pair of blocks of a component is verified
   exactly in one task: sizes of intersections are products of incidence matrices whose equal columns are merged. A task
   puts out the number of links of each class, what they stand for, and a spanning forest, never pairs.
4. Components of the spanning forests are the result's classes.

A text of fewer than five words has one run; one without words has none, links with nothing and is a class of its own with
the other empty ones kept apart. Null text counts as empty. Repeated rows are copies; rows of
one id with other texts are documents of their own. Words are compared as they stand. A text is held whole in Python, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, require
from .graph import components

N, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 20, 7, 0.99
#: Classes, and runs, in a block of a candidate component.
BLOCK_CLASSES, BLOCK_RUNS = 400, 1_000_000
#: Words a worker remembers, and runs hashed at once.
REMEMBERED, AT_ONCE = 400_000, 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def meets(similarity, trees: int, matched: int):
    """The probability that sets of this similarity share a prefix of ``matched`` min-hashes in some tree."""
    return 1 - (1 - similarity**matched) ** trees


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


_WORDS = _WordHashes()


def run_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > REMEMBERED:
        _WORDS.clear()
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = max(1, len(ids) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(min(n, len(ids))):
        out = (out * _MIX) ^ ids[k : k + size]
        out ^= out >> np.uint64(31)
    out *= _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def set_key(runs: np.ndarray) -> bytes:
    return blake2b(runs.tobytes(), digest_size=16).digest()


class Forest:
    """Signatures of sets: for every tree ``depth`` min-hashes of 16 bits, all trees in one string of bytes."""

    def __init__(self, trees: int, depth: int):
        rng = np.random.default_rng(20)
        self.hashes = trees * depth
        self.flip = rng.integers(0, 2**32, self.hashes, dtype=np.uint32)
        self.odd = rng.integers(0, 2**31, self.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def signatures(self, sets: list[np.ndarray]) -> list[bytes]:
        """Sets are not empty."""
        flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        sizes = np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes
        out = np.zeros((len(sets), self.hashes), ">u2")
        for k in range(self.hashes):
            # A minimum is small; the product spreads it over all bits.
            out[:, k] = (np.minimum.reduceat((flat ^ self.flip[k]) * self.odd[k], starts) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        return [row.tobytes() for row in out]


def features(docs: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, row, key, runs, signature) of every row; ``row``, a hash of the text, tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees, depth)

        def made(ids: list, rows_: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            signed = iter(forest.signatures(full) if full else [])
            columns = [
                pa.array(ids, pa.int64()), pa.array(rows_, pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([next(signed) if len(s) else None for s in sets], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "key", "runs", "signature"])

        for batch in batches:
            ids, texts, sets, size = [], [], [], 0
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids.append(doc)
                texts.append(row)
                sets.append(run_hashes(text.as_py(), n))
                size += len(sets[-1])
                if size > AT_ONCE:
                    yield made(ids, texts, sets)
                    ids, texts, sets, size = [], [], [], 0
            if ids:
                yield made(ids, texts, sets)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").mapInArrow(run, "doc_id long, row long, key binary, runs long, signature binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Runs that lie in the same sets are counted as one column with their number as weight."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    starts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    counts = np.diff(np.append(starts, len(value)))
    tags = np.random.default_rng(7).integers(0, 2**64, len(sets), dtype=np.uint64)
    pattern = np.add.reduceat(tags[owner], starts)
    shared = counts > 1
    _, first, weight = np.unique(pattern[shared], return_index=True, return_counts=True)
    begin, size = starts[shared][first], counts[shared][first]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, len(begin), 2048):
        b = slice(a, a + 2048)
        column = np.repeat(np.arange(len(begin[b])), size[b])
        at = np.repeat(begin[b] - (np.cumsum(size[b]) - size[b]), size[b]) + np.arange(size[b].sum())
        held = np.zeros((len(sets), len(begin[b])), np.float32)
        held[owner[at], column] = 1
        out += (held * weight[b].astype(np.float32)) @ held.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _verified(rows: list[tuple], same: bool, similarity: float, trees: int, matched: int) -> list[tuple]:
    """(key, links, expected, root) of the classes in a pair of blocks; pairs inside one block count in that block's own pair only.

    ``expected`` is the number of links that those found stand for.
    """
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    side = np.array([r[1] for r in rows])
    copies = np.array([r[3] for r in rows], np.float64)
    sizes = np.array([len(s) for s in sets], np.float64)
    both = overlaps(sets).astype(np.float64)
    either = sizes[:, None] + sizes[None, :] - both
    linked = both >= similarity * either - 1e-6
    np.fill_diagonal(linked, False)
    if not same:
        linked &= side[:, None] != side[None, :]
    links = linked @ copies
    expected = np.where(linked, 1 / meets(np.maximum(both / either, similarity), trees, matched), 0) @ copies
    root = np.arange(len(rows))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(rows)).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    return [(r[0], int(k), float(e), rows[int(j)][0]) for r, k, e, j in zip(rows, links, expected, root, strict=True) if k]


def verify(members: DataFrame, n: int, similarity: float, trees: int, matched: int) -> DataFrame:
    """(key, links, expected, root) for ``members`` (component, first, second, block, key, copies, text), sorted by pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, keys = None, [], set()

        def done() -> pa.RecordBatch:
            out = _verified(rows, group[1] == group[2], similarity, trees, matched) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.float64(), pa.binary()))],
                names=["key", "links", "expected", "root"],
            )

        for batch in batches:
            for component, first, second, block, key, copies, text in zip(*(c for c in batch.columns), strict=True):
                here = (component.as_py(), first.as_py(), second.as_py())
                if here != group:
                    if rows:
                        yield done()
                    group, rows, keys = here, [], set()
                name = key.as_py()
                if name in keys:
                    continue
                runs = run_hashes(text.as_py(), n)
                if set_key(runs) == name:  # not so for another text under the same id
                    keys.add(name)
                    rows.append((name, block.as_py(), runs.tobytes(), copies.as_py()))
        if rows:
            yield done()

    columns = ["component", "first", "second", "block", "key", "copies", "text"]
    return members.select(*columns).mapInArrow(run, "key binary, links long, expected double, root binary")


def _candidates(classes: DataFrame, trees: int, depth: int, matched: int) -> DataFrame:
    """(key, component, of, copies, runs) of the classes that share a prefix of ``matched`` min-hashes with another, directly or through others."""
    spread = classes.select("key", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    entries = spread.select("key", F.expr(f"xxhash64(tree, substring(signature, tree * {2 * depth} + 1, {2 * matched}))").alias("node"))
    heads = entries.groupBy("node").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    heads = materialize(heads, "join-heads")
    near = components(entries.join(heads, "node").where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct())
    grouped = near.select(F.col("node").alias("key"), F.col("label").alias("component")).join(classes.select("key", "of", "copies", "runs"), "key")
    return materialize(grouped, "join-candidates")


def _dealt(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """The classes of ``placed`` (key, component, of, copies, blocks) with their texts, once for every pair of blocks they belong to, dealt and sorted by it."""
    blocks = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    held = blocks.join(texts, blocks["of.doc_id"].eqNullSafe(texts["doc_id"]) & (blocks["of.row"] == texts["row"]))
    pairs = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "key", "copies", "text"
    )
    return pairs.repartition("component", "first", "second").sortWithinPartitions("component", "first", "second")


def near_copies(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, copy_of, n_copies, n_links) for every row of ``docs`` (doc_id, text)."""
    return members(docs, n, similarity, trees, depth, recall).drop("row", "label")


def members(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """(doc_id, row, label, class_id, copy_of, n_copies, n_links) for every row of ``docs`` (doc_id, text).

    ``row`` is a hash of the text; rows of one ``label`` form a class, a null label is a class of its own. ``class_id`` is the least doc_id linked to the row directly or through others, ``copy_of`` the least with the same runs,
    ``n_copies`` the number of rows with the same runs, ``n_links`` the number of other rows of at least ``similarity``.
    """
    require(docs, "doc_id", "text")
    found = materialize(features(docs, n, trees, depth), "join-features")
    first = F.min(F.struct("doc_id", "row")).alias("of")
    classes = found.where("runs > 0").groupBy("key").agg(F.min("doc_id").alias("copy_of"), first, F.count(F.lit(1)).alias("copies"), F.first("runs").alias("runs"), F.first("signature").alias("signature"))
    classes = materialize(classes, "join-classes")

    links = done = None
    for matched in range(depth, 0, -1):
        grouped = _candidates(classes, trees, depth, matched)
        parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("runs") / BLOCK_RUNS)).cast("long").alias("blocks")
        sizes = materialize(grouped.groupBy("component").agg(parts, F.bit_xor(F.xxhash64("key")).alias("mark")), "join-sizes")
        # A component of the same classes as before has been verified.
        changed = sizes if done is None else sizes.join(done.select("component", "mark"), ["component", "mark"], "left_anti")
        placed = grouped.join(changed.drop("mark"), "component")
        more = materialize(verify(_dealt(placed, docs), n, similarity, trees, matched), "join-links")
        links = more if done is None else materialize(links.join(placed.select("key"), "key", "left_anti").union(more), "join-links")
        done = sizes
        seen, stands_for = links.agg(F.sum("links"), F.sum("expected")).first()
        if (seen / stands_for if seen else meets(similarity, trees, matched)) >= recall:
            break

    labels = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.select("key", "copy_of", "copies").join(labels.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left")
    known = materialize(known.withColumn("label", F.coalesce("label", "key")), "join-known")
    least = known.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    named = materialize(known.join(least, "label").select("key", "label", "class_id", "copy_of", "copies", F.coalesce("links", F.lit(0)).alias("links")), "join-classes")
    full = found.where("runs > 0").select("doc_id", "row", "key").join(named, "key").select(
        "doc_id", "row", "label", "class_id", "copy_of", F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.col("links")).alias("n_links")
    )
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    empty = found.where("runs = 0").select("doc_id", "row", F.lit(None).cast("binary").alias("label"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), one.alias("n_copies"), none.alias("n_links"))
    return full.unionByName(empty)


def first_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that are near copies of another: of each class the least doc_id stays, once.

    A row is known by its id and its text: another text under the same id is judged by itself. A null id comes first; of rows
    under one id the least hash of the text stays. Texts without words stay, rows with one id and text once.
    """
    of, row = fresh(docs, "of", "row")
    rows = materialize(members(docs.select("doc_id", "text"), **settings).where("label IS NOT NULL").select("doc_id", "row", "label").distinct(), "join-members")
    first = rows.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    away = rows.join(first, "label").where(F.struct("doc_id", "row") != F.col("first")).select(F.col("doc_id").alias(of), F.col("row").alias(row))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & F.xxhash64("text").eqNullSafe(F.col(row))
    return docs.join(materialize(away, "join-away"), same, "left_anti").dropDuplicates(["doc_id", "text"])


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\S+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= {round(10 * SIMILARITY)} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node),
class AS (SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY 1),
l AS (SELECT a AS doc_id, min(b) FILTER (WHERE same) AS first, count(*) FILTER (WHERE same) AS copies, count(*) AS links FROM e GROUP BY 1)
SELECT doc_id, class_id, least(doc_id, coalesce(first, doc_id)) AS copy_of, 1 + coalesce(copies, 0) AS n_copies, coalesce(links, 0) AS n_links
FROM class LEFT JOIN l USING (doc_id)
"""
