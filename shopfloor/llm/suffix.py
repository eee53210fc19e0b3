r"""Substring dedup on bytes: remove what any 200-byte string covers that starts twice.

Sorting all suffixes moves every byte of the corpus many times over (see the README for figures). Here strings meet at anchors
that their own bytes choose, so only places with a repeated neighbourhood are ever moved.

* Byte p is a boundary if the hash of the eight bytes up to p is the least, the last one of equals, of some 64 places in a row
  that hold p. That is decided by the 70 bytes before p and the 63 behind it, and no 64 places in a row have none. The anchor of
  a 200-byte window at i is its first boundary from i + 70 on; it lies at i + 133 at the latest, so what decides it lies in the
  window, and equal windows have their anchors at equal offsets.
* Every window of an anchor p holds the bytes p - 70 to p + 66. Anchors are grouped by a hash of these; groups of one place are
  dropped. Whole copies of a text count as one text, since all their bytes go anyway.
* For the anchors left, 263 bytes around each are brought together by group and the windows are compared. Groups of more than
  ``MANY`` places are compared by one row per window instead, which Spark can split and count before the shuffle.

Windows and neighbourhoods are compared by 64-bit hashes with fixed random weights. Null text counts as empty; text shorter
than 200 bytes keeps all. A row that is there twice is a copy of itself, so its bytes go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import require

LENGTH = 200
#: Distances of a window's start from its anchor, and bytes that all of an anchor's windows hold around it.
NEAR, FAR, AFTER = 70, 133, 66
PLACES = 64
#: Places of a neighbourhood above which windows are compared as rows, and anchors compared at once. A group of MANY places takes
#: about 200 MB in its task.
MANY, AT_ONCE = 50_000, 4_000
#: Words of 64 bits in the map of texts to read again, a table of fixed size.
MAP_WORDS = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_WEIGHTS = np.random.default_rng(200).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, 2 * len(_POWERS[k])), np.uint64(base))
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def boundaries(data: np.ndarray) -> np.ndarray:
    """Boundaries of a text of bytes, in order: the least hash of every 64 places, by running minima of blocks from both sides."""
    n = len(data) - 7
    eights = np.ndarray((n,), "<u8", data.tobytes(), strides=(1,))
    hashed = eights * np.uint64(_BASE)
    place = np.arange(n, dtype=np.uint64)
    rank = ((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - place)
    blocks = np.full(-(-n // PLACES) * PLACES, np.uint64(2**64 - 1))
    blocks[:n] = rank
    blocks = blocks.reshape(-1, PLACES)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(onward[: n - PLACES + 1], upto[PLACES - 1 : n])
    chosen = least[np.append(True, least[1:] != least[:-1])]
    return np.unique((np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)) + 7


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors that own windows, the first and last window of each, and hashes of what surrounds them."""
    data, n = np.frombuffer(text, np.uint8), len(text)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    p = boundaries(data)
    first = np.maximum(np.maximum(np.append(-n, p[:-1]) - NEAR + 1, p - FAR), 0)
    last = np.minimum(p - NEAR, n - LENGTH)
    own = first <= last
    p, first, last = p[own], first[own], last[own]
    up, down = powers(n)
    sums = np.append(np.uint64(0), np.add.accumulate(_WEIGHTS[data] * up))
    keys = (sums[p + AFTER + 1] - sums[p - NEAR]) * down[p - NEAR]
    return p, first, last, keys


def digest(text: Column) -> Column:
    """Equal texts have equal digests; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(key, text_id, place) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [(p, k) for t in part.column(1) for p, _, _, k in [anchors((t.as_py() or "").encode())]]
                sizes = [len(p) for p, _ in found]
                owner = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([k for _, k in found]).view(np.int64)), part.column(0).take(owner), pa.array(np.concatenate([p for p, _ in found]).astype(np.int32))],
                    names=["key", "text_id", "place"],
                )

    return docs.select(digest(F.col("text")).alias("text_id"), "text").mapInArrow(run, "key long, text_id long, place int")


def repeated_keys(rows: DataFrame, key: str, place: str) -> DataFrame:
    """(key, places) of keys at two places or more, places being (text_id, ``place``); a place may come several times."""
    at = F.struct("text_id", place)
    return rows.groupBy(key).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count(F.lit(1)).alias("places")).where("a <> b").drop("a", "b")


def marked(texts: DataFrame, ids: DataFrame, label: str) -> Column:
    """Whether a row of ``texts`` may have a text_id of ``ids``: a map of hash bits of fixed size, right for all that have one."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_WORDS * 64))
    bit = lambda c: F.pmod(spot(c), F.lit(64)).cast("int")
    word = lambda c: F.floor(spot(c) / 64).cast("int")
    held = ids.groupBy(word("text_id").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit("text_id"))).alias("bits"))
    every = ids.sparkSession.range(MAP_WORDS).select(F.col("id").cast("int").alias("word")).join(held, "word", "left").na.fill(0)
    row = every.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("rows")).select(F.transform("rows", lambda r: r["bits"]).alias("bits"))
    bits = materialize(row, label)
    return F.call_function("shiftright", F.get(bits.scalar(), word("text_id")), bit("text_id")).bitwiseAND(1) == 1


_CONTEXT = "key long, text_id long, place int, first int, last int, around binary"


def contexts(texts: DataFrame) -> DataFrame:
    """Anchors of ``texts`` (text_id, text, places: those wanted) with the bytes around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "text_id", "place", "first", "last", "around"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part, out = batch.slice(at, 50), [[] for _ in names]
                for text_id, text, places in zip(*(part.column(c) for c in ("text_id", "text", "places")), strict=True):
                    data = (text.as_py() or "").encode()
                    p, first, last, keys = anchors(data)
                    k = np.flatnonzero(np.isin(p, places.values.to_numpy()))
                    out[0] += keys[k].view(np.int64).tolist()
                    out[1] += [text_id.as_py()] * len(k)
                    for column, values in zip(out[2:5], (p, first, last), strict=True):
                        column += values[k].tolist()
                    out[5] += [b"\0" * (FAR - x) + data[max(0, x - FAR) : x - NEAR + LENGTH] for x in p[k].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=names)

    return texts.mapInArrow(run, _CONTEXT)


def window_hashes(place: np.ndarray, first: np.ndarray, last: np.ndarray, around: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of every anchor, a column for each start from FAR before it on, and whether the window is its own."""
    width = FAR - NEAR + LENGTH
    data = np.frombuffer(b"".join(a.ljust(width, b"\0") for a in around), np.uint8).reshape(len(around), width)
    up, down = powers(width + 1)
    sums = np.zeros((len(around), width + 1), np.uint64)
    np.add.accumulate(_WEIGHTS[data] * up[:width], axis=1, out=sums[:, 1:])
    n = FAR - NEAR + 1
    hashes = (sums[:, LENGTH : LENGTH + n] - sums[:, :n]) * down[:n]
    start = place[:, None] - FAR + np.arange(n)[None, :]
    return hashes, (start >= first[:, None]) & (start <= last[:, None])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)) + (batch.column(5).to_pylist(),)


def compared(dealt: DataFrame) -> DataFrame:
    """(text_id, start, end) covered by repeated windows; ``dealt`` has all anchors of a key in one partition, sorted by key, text_id, place."""

    def covered(parts: list[tuple]) -> pa.RecordBatch:
        key, text_id, place, first, last = (np.concatenate([p[k] for p in parts]) for k in range(5))
        around = [a for p in parts for a in p[5]]
        same = np.append(False, (key[1:] == key[:-1]) & (text_id[1:] == text_id[:-1]) & (place[1:] == place[:-1]))
        hashes, own = window_hashes(place, first, last, around)
        own &= ~same[:, None]
        row, column = np.nonzero(own)
        mixed = (hashes[row, column] ^ (column.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(_BASE)
        order = np.argsort(mixed, kind="stable")
        s = mixed[order]
        equal = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[order] = np.append(False, equal) | np.append(equal, False)
        row, start = row[twice], (place[row] - FAR + column)[twice]
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        ends = np.append(heads[1:], len(row)) - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(text_id[row[heads]], pa.int64()), pa.array(start[heads].astype(np.int32)), pa.array((start[ends] + LENGTH if len(heads) else start).astype(np.int32))],
            names=["text_id", "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = _columns(batch.slice(at, AT_ONCE))
                if size >= AT_ONCE:  # up to where the key changes
                    key = part[0]
                    other = np.flatnonzero(key != held[-1][0][-1])
                    cut = int(other[0]) if len(other) else len(key)
                    held.append(tuple(c[:cut] for c in part))
                    part = tuple(c[cut:] for c in part)
                    if not len(part[0]):
                        continue
                    yield covered(held)
                    held, size = [], 0
                held.append(part)
                size += len(part[0])
        if held:
            yield covered(held)

    return dealt.mapInArrow(run, "text_id long, start int, end int")


def window_rows(around: DataFrame) -> DataFrame:
    """(window, text_id, start) of every window of the anchors given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                _, text_id, place, first, last, bytes_ = _columns(batch.slice(at, AT_ONCE))
                hashes, own = window_hashes(place, first, last, bytes_)
                row, column = np.nonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[row, column].view(np.int64)), pa.array(text_id[row], pa.int64()), pa.array((place[row] - FAR + column).astype(np.int32))],
                    names=["window", "text_id", "start"],
                )

    return around.mapInArrow(run, "window long, text_id long, start int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(text_id, spans): merged spans of bytes to remove from texts that share some with another place; copies as a whole aside."""
    rows = materialize(anchor_rows(docs), "suffix-anchors")
    keys = materialize(repeated_keys(rows, "key", "place"), "suffix-keys")
    found = rows.join(keys, "key").groupBy("text_id").agg(F.collect_set("place").alias("places"))
    found = materialize(found, "suffix-places")
    texts = docs.select(F.col("doc_id"), digest(F.col("text")).alias("text_id"), "text")
    one = texts.groupBy("text_id").agg(F.min("doc_id").alias("doc_id"))
    wanted = materialize(found.join(one, "text_id"), "suffix-wanted")
    right = wanted.withColumnsRenamed({"doc_id": "_doc", "text_id": "_text"})
    read = texts.where(marked(texts, found, "suffix-map")).join(right, (F.col("text_id") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    around = materialize(contexts(read.select("text_id", "text", "places")), "suffix-around")
    many = materialize(keys.where(F.col("places") > MANY).select("key"), "suffix-many")
    dealt = around.join(many, "key", "left_anti").repartition("key").sortWithinPartitions("key", "text_id", "place")
    spans = compared(dealt)
    windows = materialize(window_rows(around.join(many, "key", "left_semi")), "suffix-windows")
    again = windows.join(materialize(repeated_keys(windows, "window", "start").select("window"), "suffix-repeats"), "window")
    spans = spans.unionByName(again.select("text_id", "start", (F.col("start") + LENGTH).alias("end")))
    return spans.groupBy("text_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def remaining(text: str | None, spans: list[dict] | None, whole: bool) -> tuple[int, int, int, bytes]:
    """Bytes of a text, bytes removed, runs removed, and what is left."""
    data = (text or "").encode()
    if whole and len(data) >= LENGTH:
        return len(data), len(data), 1, b""
    kept, at, runs = [], 0, 0
    for s in spans or ():
        if s["start"] > at or not runs:
            kept.append(data[at : s["start"]])
            runs += 1
        at = max(at, s["end"])
    left = b"".join([*kept, data[at:]])
    return len(data), len(data) - len(left), runs, left


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what is left of every text of ``docs`` (doc_id, text), as bytes."""
    require(docs, "doc_id", "text")
    docs = docs.select("doc_id", "text")
    spans = materialize(repeated_spans(docs), "suffix-spans")
    texts = docs.withColumn("text_id", digest(F.col("text")))
    copies = texts.where(F.octet_length("text") >= LENGTH).groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_id", F.lit(True).alias("whole"))
    known = materialize(spans.join(copies, "text_id", "full"), "suffix-known")
    hit = materialize(known.select("text_id"), "suffix-hit")
    near = marked(texts, hit, "suffix-map")
    right = known.withColumnRenamed("text_id", "_text")
    left = texts.where(near).join(right, F.col("text_id") == F.col("_text"), "left").select("doc_id", "text", "spans", F.coalesce("whole", F.lit(False)).alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [remaining(*row) for row in zip(*(part.column(c).to_pylist() for c in ("text", "spans", "whole")), strict=True)]
                columns = [pa.array([m[k] for m in made], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array([m[3] for m in made], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = left.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    body = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    rest = texts.where(~near).select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), body.cast("binary").alias("kept"))
    return cut.unionByName(rest)


def removal_digests(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
