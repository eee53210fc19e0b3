"""Benchmark decontamination: a BM25 index of the test items, queried by every training passage with block-max WAND.

Documents are cut into windows of two strides, a stride being as long as the longest test item, so every copy of an item
lies whole in some window. A window is a query of its distinct terms. Weights are divided by the item's threshold, a share
of the score the item gives itself, so an item is retrieved when its weights add up to one. Items stand in blocks; the
largest weight of a term within a block bounds what the block can gain from it, and the pivot search skips blocks by these
bounds. Windows whose rare terms, even with all frequent terms added, lift no item to one are dropped before, by sums over
arrays. Every item retrieved is verified: runs of five words of its question and of its answer must occur in the window.

The index is the only thing sent to all tasks. Its size is checked: test sets of more than ``INDEX_BYTES`` of text are
split into several indexes by item id, with counts and lengths taken over all items, and the documents are read once for
each. Null or empty texts have no terms: such items are never found, such documents find nothing. Repeated document rows
give repeated matches. Rows of items under one id, null included, are items of their own; a document has one row for an id,
that of the best of them within an index. A text is held whole in Python, however long, its windows one by one. No match is dropped.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

#: Text of the items in one index, in bytes.
INDEX_BYTES = 16_000_000
#: Items in a block of the pivot search.
BLOCK = 8
K1, B = 1.2, 0.75
#: What all items may gain from the terms too frequent to look for first.
COMMON = 0.5
#: Words a task remembers, and words handled at once.
REMEMBERED, AT_ONCE = 300_000, 400_000
_EDGE = re.compile(r"^\W+|\W+$")


def normal(word: str) -> str:
    """A word in lower case without what stands around its letters and digits."""
    word = word.lower()
    return word if word.isalnum() else _EDGE.sub("", word)


def tokens(text: str | None) -> list[str]:
    return [n for w in (text or "").split() if (n := normal(w))]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's last sentence is its answer, what stands before is its question; a single sentence is cut in half."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if tokens(p)]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in tokens(p)], tokens(parts[-1])
    words = tokens(text)
    return words[: len(words) // 2], words[len(words) // 2 :]


def runs(words: list[str], n: int) -> set[tuple[str, ...]]:
    """Runs of n words; all words as one run if there are fewer."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def overlap(part: list[str], window: list[str], n: int) -> float:
    """Share of the part's runs that the window holds; an empty part is held."""
    wanted = runs(part, n)
    if not wanted:
        return 1.0
    held = runs(window, min(n, len(part)))
    return len(wanted & held) / len(wanted)


class Index:
    """Postings of a set of items with normalised weights and block maxima."""

    def __init__(self, items: list[tuple[int | None, str]], counts: dict[str, int], n_items: int, mean: float, share: float, n: int):
        self.n = n
        words = [tokens(t) for _, t in items]
        #: Items by their place in the list, since ids may be null or repeat.
        self.ids = sorted((i for i, w in enumerate(words) if w), key=lambda i: (len(words[i]), i))
        self.names = [name for name, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        self.stride = max(map(len, words), default=0)
        self.terms: dict[str, int] = {}
        self.postings: list[tuple[list[int], list[float]]] = []
        for at, item in enumerate(self.ids):
            tf: dict[str, int] = defaultdict(int)
            for w in words[item]:
                tf[w] += 1
            room = K1 * (1 - B + B * len(words[item]) / mean)
            weights = {w: math.log(1 + (n_items - counts[w] + 0.5) / (counts[w] + 0.5)) * k * (K1 + 1) / (k + room) for w, k in tf.items()}
            threshold = share * sum(weights.values())
            for w, x in weights.items():
                t = self.terms.setdefault(w, len(self.terms))
                if t == len(self.postings):
                    self.postings.append(([], []))
                self.postings[t][0].append(at)
                self.postings[t][1].append(x / threshold)
        self.most = [max(p[1]) for p in self.postings]
        self.block_most: list[dict[int, float]] = []
        for at, x in self.postings:
            best: dict[int, float] = {}
            for i, v in zip(at, x, strict=True):
                best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), v)
            self.block_most.append(best)
        # The most frequent terms, as long as no item gains more than COMMON from them, are not looked for at first.
        self.common = np.zeros(len(self.ids))
        rare = np.ones(len(self.postings), bool)
        for t in sorted(range(len(self.postings)), key=lambda t: -len(self.postings[t][0])):
            at, x = (np.array(v) for v in self.postings[t])
            if (self.common[at] + x).max() > COMMON:
                break
            self.common[at] += x
            rare[t] = False
        self.rare = np.append(rare, False)  # also for -1, no term
        self.first = np.cumsum([0, *(len(p[0]) for p in self.postings)])
        self.item = np.array([i for p in self.postings for i in p[0]], np.int64)
        self.weight = np.array([x for p in self.postings for x in p[1]])
        self.known = _Places(self.terms)

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.known = _Places(self.terms)

    def windows(self, texts: list[str | None]) -> Iterator[tuple[int, list[str], list[int]]]:
        """Windows in which some item may reach one: place of the text, words and distinct terms."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        rows = [(t or "").split() for t in texts]
        place, stride = self.known.__getitem__, self.stride
        ids = np.fromiter(chain.from_iterable(map(place, r) for r in rows), np.int64, sum(map(len, rows)))
        sizes = np.array([len(r) for r in rows])
        begins = np.cumsum(sizes) - sizes
        chunks = -(-sizes // stride) + 1  # one empty chunk keeps a text from the next
        first_chunk = np.cumsum(chunks) - chunks
        at = np.flatnonzero(self.rare[ids])
        if not len(at):
            return
        row = np.searchsorted(begins, at, "right") - 1
        chunk = first_chunk[row] + (at - begins[row]) // stride
        keys = np.unique(chunk * len(self.terms) + ids[at])
        chunk, term = keys // len(self.terms), keys % len(self.terms)
        counts = self.first[term + 1] - self.first[term]
        posting = np.repeat(self.first[term] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        item, total = self.item[posting], int(chunks.sum()) + 1
        order = np.argsort(key := item * total + np.repeat(chunk, counts), kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        sums, key = np.add.reduceat(self.weight[posting[order]], starts), key[starts]
        both = sums + np.where(np.append(np.diff(key) == 1, False), np.append(sums[1:], 0.0), 0.0)
        good = np.flatnonzero(both + self.common[key // total] >= 0.999)
        for c in np.unique(key[good] % total):
            r = int(np.searchsorted(first_chunk, c, "right") - 1)
            start = (int(c) - int(first_chunk[r])) * stride
            for begin in (start, start - stride) if start else (start,):
                here = ids[begins[r] + begin : begins[r] + min(begin + 2 * stride, sizes[r])]
                yield r, rows[r][begin : begin + 2 * stride], np.unique(here[here >= 0]).tolist()

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Every item that the terms give a weight of one, by block-max WAND: (place in the index, weight)."""
        end, found = len(self.ids), []
        lists = [[self.postings[t][0][0], 0, t] for t in terms]

        def to(x: list, item: int) -> None:
            at = self.postings[x[2]][0]
            k = x[1]
            while k < len(at) and at[k] < item:
                k += 1
            x[0], x[1] = (at[k] if k < len(at) else end), k

        while True:
            lists.sort(key=lambda x: x[0])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                if x[0] == end:
                    break
                total += self.most[x[2]]
                if total >= 0.999999:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_most[x[2]].get(block, 0.0) for x in lists[: pivot + 1]) < 0.999999:
                after = min((block + 1) * BLOCK, lists[pivot + 1][0] if pivot + 1 < len(lists) else end)
                for x in lists[: pivot + 1]:
                    to(x, after)
            elif lists[0][0] == item:
                score = sum(self.postings[x[2]][1][x[1]] for x in lists[: pivot + 1])
                if score >= 0.999999:
                    found.append((item, score))
                for x in lists[: pivot + 1]:
                    to(x, item + 1)
            else:
                for x in lists[:pivot]:
                    if x[0] < item:
                        to(x, item)

    def matches(self, texts: list[str | None], least: float) -> list[dict[int | None, tuple[float, float, float]]]:
        """Ids of the items verified in each text, with the best window's weight, question overlap and answer overlap."""
        out: list[dict[int | None, tuple[float, float, float]]] = [{} for _ in texts]
        for row, words, terms in self.windows(texts):
            found = self.search(terms)
            window = tokens(" ".join(words)) if found else []
            for at, score in found:
                item = self.ids[at]
                q, a = (overlap(part, window, self.n) for part in self.parts[item])
                if q >= least and a >= least:
                    name = self.names[item]
                    out[row][name] = max(out[row].get(name, (0.0, 0.0, 0.0)), (score, q, a))
        return out


class _Places(dict):
    """Term of a word as it stands in a text, -1 if it is none; remembers what it has worked out."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        place = self[word] = self.terms.get(normal(word), -1)
        return place


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about AT_ONCE words, one text at least."""
    start = size = 0
    for k, t in enumerate(texts):
        more = len(t or "") // 6
        if size and size + more > AT_ONCE:
            yield start, k
            start, size = k, 0
        size += more
    yield start, len(texts)


def _indexes(items: DataFrame, share: float, n: int) -> Iterator[Index]:
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(w, len(all_)) for t in batch.column("text").to_pylist() for all_ in [tokens(t)] for w in sorted(set(all_))]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string())], names=["term"])

    counts = rows.mapInArrow(terms, "term string").groupBy("term").agg(F.count(F.lit(1)).alias("items"))
    size, n_items = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    length = rows.mapInArrow(_lengths, "n long").agg(F.coalesce(F.avg("n"), F.lit(1.0))).first()[0]
    shards = max(1, -(-size // INDEX_BYTES))
    for k in range(shards):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        own = part.mapInArrow(terms, "term string").distinct()
        known = {r["term"]: r["items"] for r in counts.join(own, "term", "left_semi").toLocalIterator()}
        held = sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        if held:
            yield Index(held, known, n_items, max(length, 1.0), share, n)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(tokens(t)) for t in batch.column("text").to_pylist()], pa.int64())], names=["n"])


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.6, least: float = 0.5, n: int = 5) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for every item found in a document.

    ``share``: part of an item's own BM25 score that a window must reach; ``least``: part of the runs of ``n`` words that
    must occur, of the question and of the answer. ``score`` is the window's BM25 score over the threshold.
    """
    require(docs, "doc_id", "text")
    require(items, "item_id", "text")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    spark, found = docs.sparkSession, []
    for index in _indexes(items, share, n):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                texts, docs_ = batch.column(1).to_pylist(), batch.column(0).to_pylist()
                for a, b in _portions(texts):
                    for doc, found_ in zip(docs_[a:b], sent.value.matches(texts[a:b], least), strict=True):
                        rows += [(doc, item, *scores) for item, scores in sorted(found_.items(), key=lambda x: (x[0] is not None, x[0] or 0))]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def without_items(docs: DataFrame, items: DataFrame, share: float = 0.6, least: float = 0.5, n: int = 5) -> DataFrame:
    """``docs`` without the rows whose text holds an item, as ``contaminated`` finds them; each row is judged by its own text."""
    require(docs, "doc_id", "text")
    require(items, "item_id", "text")
    at, left = docs.columns.index("text"), docs
    for index in _indexes(items, share, n):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).to_pylist()
                for a, b in _portions(texts):
                    yield batch.slice(a, b - a).filter(pa.array([not m for m in sent.value.matches(texts[a:b], least)], pa.bool_()))

        left = left.mapInArrow(run, docs.schema)
    return left
