r"""Line dedup by an exact set-similarity join.

A line is the set of its words. Lines with equal sets form a class that stands in one row from then on; its first line, by
document and place, is the class's own place. Two sets of n and m words of Jaccard similarity t differ in d <= n (1 - t) / t
words. Single words are shared by more and more lines as the table grows, so classes meet on groups of words:

1. The words are dealt by hash to a number of parts that depends on the level of the set's size, a doubling of it each, and
   what a set has in a part is one mark. A word in which two sets differ changes one mark, so all but d marks of either are the
   other's, too, and by the prefix principle the first d + 1 marks of both, in any order common to all, share one. Marks that few
   lines can be expected to have come first: the rarities of their words are added up. A word's length stands for its rarity, or the
   levels of ``rarity``, counts of the words of all documents in hash buckets, if the caller gives them; any order gives the same result. A set also stands in the levels of smaller
   sets it may match, and one with no more than d marks in a level (there, it may share none) with the words of its prefix, the
   first n - ceil(t n) + 1.
2. Classes that share a mark are held against each other if their lengths allow the similarity and parity maps of their words,
   of 128 bits, differ in no more bits than the sets may differ in words.
3. The lines of the pairs left are read again and compared word by word, as 64-bit hashes.

A class whose first line comes after the first line of a class it matches is gone. Since one earlier match is enough, classes
meet in two rounds. The first one is for marks of more than ``FEW`` classes. Those under a mark are dealt to ``MANY`` shares by their hash;
each class is held against the earliest of the first classes of its marks and the earliest of the first ones of its shares: two pairs
a class, after which few of a large group of near copies are left. In the second one those left meet each other and every earlier
class that is gone, each pair once; two that are gone do not meet. Two classes alone under a mark are a pair as they stand, the others
are joined by mark and come out under the least mark of both. Marks of one class alone, most of them, are left out first. Counts and joins go
over the marks in ``PASSES`` parts, one after the other, so that the disk holds the shuffle of one part at a time. A line is removed if it is not the first
of its class or its class is gone: it has an equal or similar line before it in the table.

Only DataFrame functions are used. Lines without words, and all lines of a null text, are kept. Rows of one id and one text are
one document; rows of one id with other texts are documents of their own, ordered by the hash of their text. A null id comes first. A document that has lost all its words is left out of ``without_lines``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, let, require, written

SIMILARITY = 0.8
#: Buckets of word counts: an array of so many bytes is sent to all tasks.
BUCKETS = 1 << 18
#: Marks of more classes than these take part in the first round.
FEW = 16
#: Shares of the classes with a mark; those of a share are first held against the first of them.
MANY = 100
#: Parts of the marks, one after the other.
PASSES = 4
#: Parts that words are dealt to, as a multiple of the words in which the largest sets of a level may differ.
SPREAD = 1.3
#: Bits of a word's code for its rarity and the sums of them.
RARITY = (1 << 14) - 1
BLANKS = " \t\n\x0b\f\r"
#: Words of 64 bits in the map of lines to read again, a table of fixed size.
MAP_WORDS = 1 << 18


def spaced_words(text: Column) -> Column:
    """Words of a text whose line ends are spaces; splitting at single spaces is the fast path."""
    odd = text.contains("  ") | text.startswith(" ") | text.endswith(" ") | (text == "")
    for c in "\t\x0b\f\r":
        odd = odd | text.contains(c)
    return F.when(odd, F.array_remove(F.split(text, SPACE, -1), "")).otherwise(F.split(text, " ", -1))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, place, line) of every line of a text; ``row`` tells texts of one id apart."""
    # The hash apart, or every line would carry the whole text and hash it again.
    split = docs.select("doc_id", F.xxhash64("text").alias("row"), F.split("text", "\n", -1).alias("lines"))
    return split.select("doc_id", "row", F.posexplode("lines").alias("place", "line"))


def bucket(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - int(math.log2(BUCKETS))).cast("int")


def rarity(docs: DataFrame) -> DataFrame:
    """One row: a level of every bucket, four to each doubling of its words in all documents, as an array of bytes."""
    spread = docs.select(F.explode(spaced_words(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("word"))
    counts = spread.groupBy(bucket(F.xxhash64("word")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.floor(4 * F.log2(F.lit(1.0) + F.coalesce("n", F.lit(0)))), F.lit(127)).cast("tinyint")
    full = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", level.alias("level"))
    return full.agg(F.array_sort(F.collect_list(F.struct("bucket", "level"))).alias("rows")).select(F.transform("rows", lambda r: r["level"]).alias("levels"))


def needed(n: Column, similarity: float) -> Column:
    """Least overlap of a set of n words with any set this similar."""
    return F.ceil(n * F.lit(similarity) - 1e-9).cast("int")


def _level(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) + 1e-9).cast("int")


def _marks(codes: Column, size: Column, level: Column, similarity: float) -> Column:
    """The first marks of a set in a level, in their order, of which 32 bits of the hash are kept."""
    share = (1 - similarity) / similarity
    above = F.pow(F.lit(2.0), level + 1) - 1
    # In a level below its own a set meets smaller ones only.
    differ = F.when(size > above, (size + above) * F.lit((1 - similarity) / (1 + similarity))).otherwise(size * F.lit(share))
    most = F.floor(differ + 1e-6).cast("int") + 1
    parts = F.least(F.greatest(F.ceil((above * F.lit(share) + 1) * F.lit(SPREAD)), F.lit(2)), F.lit(1 << 19)).cast("long")
    # Parts are ranges of the hash, so that the words of a part stand side by side.
    dealt = lambda k: F.transform(codes, lambda c: F.shiftright(F.shiftright(c, 33) * k, 31))
    starts = lambda s: F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    # 36 bits of each hash above the sum of the rarities; a part too large for a long counts as 0.
    total = lambda x, y: F.aggregate(F.sequence(x, y - 1), F.lit(0).cast("long"), lambda a, i: F.try_add(a, F.get(codes, i).bitwiseAND(F.lit(2**50 - 1))))
    # Rarest first, then 49 bits of the group's hash.
    mark = lambda t: F.shiftleft(F.lit(RARITY).cast("long") - t.bitwiseAND(F.lit(RARITY).cast("long")), 49).bitwiseOR(F.shiftrightunsigned(F.xxhash64(level, t), 15))
    groups = lambda b: F.zip_with(b, F.slice(b, F.lit(2), F.size(b)), lambda x, y: let(F.coalesce(total(x, F.coalesce(y, size)), F.lit(0).cast("long")), mark))
    marks = let(let(let(parts, dealt), starts), groups)
    rarest = F.sort_array(F.transform(codes, lambda c: F.shiftleft(F.lit(RARITY).cast("long") - c.bitwiseAND(F.lit(RARITY).cast("long")), 49).bitwiseOR(F.shiftrightunsigned(c, 15))))
    words = F.transform(F.slice(rarest, F.lit(1), size - needed(size, similarity) + 1), lambda c: F.xxhash64(F.lit(-1), level, c))
    first = let(marks, lambda m: F.when(F.size(m) < most, F.concat(m, words)).otherwise(F.slice(F.sort_array(m), F.lit(1), most)))
    return F.transform(first, lambda m: (m.bitwiseAND(F.lit(2**32 - 1)) - F.lit(2**31)).cast("int"))


def line_sets(docs: DataFrame, levels: DataFrame | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row, place, k1, k2, n, fine, coarse, marks) of every line with words.

    ``levels`` are counts of words by ``rarity``; without them a word's length stands for its rarity. ``marks`` is empty for sets that
    match equal sets only: those that need all their words in a match and find no larger set that would do. ``k1`` and ``k2`` are equal
    for equal sets. ``coarse`` and ``fine`` are the parities of the words in each of 128 classes, 64 of hashes below 0 and 64 of the others.
    """
    # 50 bits of the hash, then room for the sum of rarities from 0 to 14.
    high = lambda h: h.bitwiseAND(F.lit(-1 - RARITY).cast("long"))
    counted = lambda w: let(F.xxhash64(w), lambda h: high(h).bitwiseOR(F.greatest(F.lit(14) - F.shiftright(F.get(F.col("levels"), bucket(h)).cast("long"), 3), F.lit(0)).cast("long")))
    measured = lambda w: high(F.xxhash64(w)).bitwiseOR(F.least(F.octet_length(w), F.lit(15)).cast("long") - 1)
    # A test of the line itself: one of its words would be pushed down and split the line twice.
    full = lines_of(docs).where(F.ltrim("line", F.lit(BLANKS)) != "")
    if levels is not None:
        full = full.withColumn("levels", levels.scalar())
    hashed = full.select("doc_id", "row", "place", F.transform(spaced_words(F.col("line")), measured if levels is None else counted).alias("hashes"))
    coded = hashed.select("doc_id", "row", "place", F.sort_array(F.array_distinct("hashes")).alias("codes"))
    size = F.size("codes")
    alone = (needed(size, similarity) >= size) & (needed(size + 1, similarity) > size)
    stands = F.sequence(_level(needed(size, similarity)), _level(size))
    marks = F.flatten(F.transform(stands, lambda level: _marks(F.col("codes"), F.size("codes"), level, similarity)))
    # Sorted codes below 0 stand first: half of the words for either map.
    below = F.array_position(F.sort_array(F.concat("codes", F.array(F.lit(0).cast("long")))), F.lit(0).cast("long")).cast("int") - 1
    low = lambda c: F.shiftright(c, 14).bitwiseAND(F.lit(63).cast("long")).cast("int")
    parity = lambda codes: F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), low(c))))
    return coded.select(
        "doc_id", "row", "place", F.xxhash64("codes").alias("k1"), F.xxhash64(F.lit(2), "codes").alias("k2"), size.alias("n"),
        parity(F.slice("codes", F.lit(1), below)).alias("coarse"), parity(F.slice("codes", below + 1, size - below)).alias("fine"),
        F.when(alone, F.array().cast("array<int>")).otherwise(marks).alias("marks"),
    )


def _both(n: Column, m: Column, similarity: float) -> Column:
    """Words that sets of n and m words have in common at least, if they are similar."""
    return F.ceil((n + m) * F.lit(similarity / (1 + similarity)) - 1e-9)


def may_match(similarity: float) -> Column:
    """Length and map filters for rows a and b (n, coarse, fine) that share a mark."""
    n, m = F.col("a.n"), F.col("b.n")
    both = _both(n, m, similarity)
    coarse, fine = (F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in ("coarse", "fine"))
    return (F.least(n, m) >= needed(F.greatest(n, m), similarity)) & (F.bit_count(coarse) + F.bit_count(fine) <= n + m - 2 * both)


def _shared(classes: DataFrame) -> DataFrame:
    """(id, mark, classes, other) of the marks that more than one class has, with their number and the largest id of them; of two one row."""
    under = Window.partitionBy("mark")
    found = []
    for part in range(PASSES):
        spread = classes.select("id", F.explode("marks").alias("mark")).where(F.pmod("mark", F.lit(PASSES)) == part)
        counted = spread.select("id", "mark", F.count(F.lit(1)).over(under).alias("classes"), F.max("id").over(under).alias("other"))
        found.append(written(counted.where("classes > 2 OR classes = 2 AND id <> other"), "line-marks"))
    return reduce(DataFrame.union, found)


def _near(pairs: DataFrame) -> DataFrame:
    """(id, first, before, first_before) of the pairs (a, b) of structs of first line and id, the later class first."""
    turned = pairs.select(F.greatest("a", "b").alias("late"), F.least("a", "b").alias("early"))
    return turned.select("late.id", "late.first", F.col("early.id").alias("before"), F.col("early.first").alias("first_before"))


def _bits(spots: DataFrame) -> DataFrame:
    """One row: a map of the column ``spot``, bits in an array of 64-bit words."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("spot", F.lit(64)).cast("int"))
    words = spots.groupBy(F.floor(F.col("spot") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = spots.sparkSession.range(MAP_WORDS).select(F.col("id").cast("int").alias("word")).join(words, "word", "left").na.fill(0)
    return written(every.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("rows")).select(F.transform("rows", lambda r: r["bits"]).alias("bits")), "line-map")


def _verified(near: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(id) of the later classes of the pairs ``near`` that match."""
    ends = F.array(F.struct("id", "first"), F.struct(F.col("before").alias("id"), F.col("first_before").alias("first")))
    wanted = written(near.select(F.explode(ends).alias("x")).select("x.id", "x.first.*").distinct(), "line-wanted")
    spot = lambda *of: F.pmod(F.xxhash64(*of), F.lit(MAP_WORDS * 64))
    marked = lambda bits, at: F.call_function("shiftright", F.get(bits.scalar(), F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(1) == 1
    texts, places = (_bits(wanted.select(spot(*of).alias("spot"))) for of in (("doc_id", "row"), ("doc_id", "row", "place")))
    same = F.expr("l.doc_id <=> w.doc_id AND l.row = w.row AND l.place = w.place")
    lines = lines_of(docs.where(marked(texts, spot(F.col("doc_id"), F.xxhash64("text"))))).where(marked(places, spot("doc_id", "row", "place")))
    held = lines.withColumn("words", F.array_distinct(F.transform(spaced_words(F.col("line")), lambda w: F.xxhash64(w)))).drop("line")
    read = written(held.alias("l").join(wanted.alias("w"), same).select("id", "words"), "line-texts")
    once = read.dropDuplicates(["id"])
    both = near.select("id", "before").join(once, "id").join(once.select(F.col("id").alias("before"), F.col("words").alias("others")), "before")
    common = F.size(F.array_intersect("words", "others"))
    return both.where(common >= (F.size("words") + F.size("others") - common) * F.lit(similarity) - 1e-9).select("id").distinct()


def _first_round(shared: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the classes under a mark of many with the first of it and the first of their share."""
    head = F.min(F.struct("first", "id", "n", "coarse", "fine"))
    heads = [head.over(Window.partitionBy("mark")).alias("h0"), head.over(Window.partitionBy("mark", F.pmod("id", F.lit(MANY)))).alias("h1")]
    headed = shared.where(F.col("classes") > FEW).select("id", "mark").join(known, "id").select(F.struct("first", "id", "n", "coarse", "fine").alias("a"), *heads)
    starred = headed.select("a", F.posexplode(F.array("h0", "h1")).alias("of", "b")).where("a.id <> b.id").where(may_match(similarity))
    best = starred.groupBy(F.struct("a.first", "a.id").alias("a"), "of").agg(F.min(F.struct("b.first", "b.id")).alias("b"))
    return best.select("a", "b").distinct()


def _second_round(shared: DataFrame, known: DataFrame, gone: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes that share a mark, each pair once, but for those of which the later one is known to be gone."""
    known = known.join(gone.withColumn("gone", F.lit(True)), "id", "left").na.fill(False, ["gone"])
    end = lambda x: F.struct(F.col(f"{x}.first"), F.col(f"{x}.id")).alias(x)
    twos = shared.where("classes = 2").select(F.col("id").alias("one"), "other").distinct()
    twos = twos.join(known.alias("a"), F.col("a.id") == F.col("one")).join(known.alias("b"), F.col("b.id") == F.col("other"))
    twos = twos.where("NOT IF(a.first > b.first, a.gone, b.gone)").where(may_match(similarity)).select(end("a"), end("b"))
    pairs = [written(twos, "line-pairs")]

    # A pair under marks of more classes comes out under the least of those it shares.
    held = shared.where("classes > 2").groupBy("id").agg(F.collect_set("mark").alias("marks")).join(known, "id")
    held = written(held, "line-held")
    meet = F.expr("a.mark = b.mark AND (b.gone AND b.first < a.first OR NOT b.gone AND a.id < b.id)")
    least = F.array_min(F.array_intersect("a.marks", "b.marks")) == F.col("a.mark")
    for part in range(PASSES):
        marked = held.withColumn("mark", F.explode("marks")).where(F.pmod("mark", F.lit(PASSES)) == part)
        met = marked.where("NOT gone").alias("a").join(marked.alias("b"), meet & may_match(similarity) & least)
        pairs.append(written(met.select(end("a"), end("b")), "line-pairs"))
    return reduce(DataFrame.union, pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verdicts(docs: DataFrame, similarity: float, levels: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, places, removed): places of the lines with words, and of those among them that go, of every document that has any."""
    require(docs, "doc_id", "text")
    docs = docs.select("doc_id", "text")
    order = F.struct("doc_id", "row", "place")
    first = F.min(F.struct(order.alias("first"), "n", "fine", "coarse", "marks")).alias("of")
    classes = written(line_sets(docs, levels, similarity).groupBy(F.col("k1").alias("id"), "k2").agg(first).select("id", "of.*"), "line-classes")
    shared = _shared(classes)
    known = classes.select("id", "first", "n", "coarse", "fine")

    met = written(_first_round(shared, known, similarity), "line-heads")
    gone = written(_verified(_near(met), docs, similarity), "line-gone")
    met = written(_second_round(shared, known, gone, similarity), "line-met")
    # A class known to be gone needs no other match.
    rest = _verified(_near(met).join(gone, "id", "left_anti"), docs, similarity)
    gone = written(gone.union(rest).distinct(), "line-gone")

    filled = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(F.ltrim(x, F.lit(BLANKS)) != "", i))
    told = docs.select("doc_id", F.xxhash64("text").alias("row"), F.array_compact(filled).alias("places"), F.lit(None).cast("int").alias("place")).where(F.size("places") > 0)
    kept = classes.select("id", "first.*").join(gone, "id", "left_anti").select("doc_id", "row", F.lit(None).cast("array<int>").alias("places"), "place")
    found = told.union(kept).groupBy("doc_id", "row").agg(F.first("places", ignorenulls=True).alias("places"), F.collect_set("place").alias("kept"))
    return found.select("doc_id", "row", "places", F.array_except("places", "kept").alias("removed"))


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, levels: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, place, removed) of every line with words. ``levels`` (see ``line_sets``) changes the work, not the result."""
    found = _verdicts(docs, similarity, levels).select("doc_id", "row", "removed", F.explode("places").alias("place"))
    return found.select("doc_id", "row", "place", F.array_contains("removed", F.col("place")).alias("removed"))


def line_report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): lines with words, and the places of those removed, for every document that has lines."""
    places = F.array_join(F.col("removed").cast("array<string>"), ",")
    return _verdicts(docs, similarity).select("doc_id", F.size("places").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), places.alias("removed"))


def without_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; documents of which no word is left go, others keep their columns."""
    of, row, gone = fresh(docs, "of", "row", "gone")
    places = _verdicts(docs, similarity).where(F.size("removed") > 0).select("doc_id", "row", "removed")
    places = written(places, "line-removals").toDF(of, row, gone)
    held = docs.join(places, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(row)), "left")
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i))
    cut = held.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    return cut.where(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


_W = r"[ \t-\r]+"
SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents),
w AS (SELECT doc_id, place, list_distinct(list_filter(string_split_regex(line, '{_W}'), lambda x: x <> '')) AS w FROM l),
s AS (SELECT doc_id, place, list_sort(w) AS w, len(w) AS n FROM w WHERE len(w) > 0),
c AS (SELECT w, n, min((doc_id, place)) AS first, row_number() OVER () AS id FROM s GROUP BY w, n),
t AS (SELECT id, first, n, unnest(w) AS word FROM c WHERE n > 3),
r AS (SELECT *, count(*) OVER (PARTITION BY word) AS f FROM t),
p AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY f, word) <= n - ceil({SIMILARITY} * n - 1e-9) + 1),
m AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.word = b.word AND b.first < a.first AND least(a.n, b.n) >= {SIMILARITY} * greatest(a.n, b.n) - 1e-9),
g AS (
  SELECT DISTINCT a AS id FROM m JOIN c x ON x.id = m.a JOIN c y ON y.id = m.b
  WHERE len(list_intersect(x.w, y.w)) >= {SIMILARITY} * (x.n + y.n - len(list_intersect(x.w, y.w))) - 1e-9),
o AS (SELECT s.doc_id, s.place, g.id IS NOT NULL OR (s.doc_id, s.place) <> c.first AS removed FROM s JOIN c USING (w, n) LEFT JOIN g ON g.id = c.id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed,
  coalesce(string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) FILTER (WHERE removed), '') AS removed
FROM o GROUP BY doc_id
"""
