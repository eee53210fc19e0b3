r"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and word pairs fall into hash buckets. Counts over every document make the raw multinomial, counts over trusted ones
the target. A document's score is the mean, over its own words and pairs, of the log ratio of the two: its
log-likelihood ratio divided by its length. It is kept if its score is at least a threshold and it breaks no base rule. The
trusted documents are split by id: four of five parts make the target, and the scores of all others, which are like those of any
clean document, set the threshold: their quantile ``LOST``, less ``MARGIN`` times their quartile range.

Only DataFrame functions are used. A map of hash bits of fixed size picks the texts that may be the target's; only these move, to
meet the ids they must equal. The counts are the only thing gathered: one row per bucket and task, so they grow with
the input up to a bound by ``BUCKETS``, and the table of ratios, ``BUCKETS`` doubles, is sent to all tasks as a scalar subquery.
Scoring reads a row at a time and moves nothing.

Null text counts as empty. A text with fewer than ten words breaks the base rules. Without any trusted document the ratio is
zero everywhere and the base rules decide alone. Equal texts get equal verdicts; added columns replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, let, require, words
from .suffix import marked

BUCKETS = 1 << 16
#: Added to every bucket's count.
SMOOTHING = 0.5
#: Share of clean documents below the quantile, and quartile ranges that the threshold lies below it.
LOST, MARGIN = 0.005, 3.0
#: Of so many parts of the trusted documents, one sets the threshold.
PARTS = 5
#: Base rules: least words, and words in repeated windows of five per hundred words.
LEAST_WORDS, REPEATED = 10, 20
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def tail(values: Column, skip: int) -> Column:
    """All but the first ``skip`` elements."""
    return F.slice(values, skip + 1, F.greatest(F.size(values) - skip, F.lit(0)))


def joined(left: Column, right: Column) -> Column:
    """Hashes of two columns of hashes, as long as the second, which is not longer."""
    return F.zip_with(F.slice(left, 1, F.size(right)), right, lambda a, b: F.xxhash64(a, b))


def pairs(hashes: Column) -> Column:
    """Hashes of neighbouring words."""
    return joined(hashes, tail(hashes, 1))


def buckets(hashes: Column, double: Column, n: int) -> Column:
    """Buckets of all words and pairs of a text."""
    return F.transform(F.concat(hashes, double), lambda h: F.pmod(h, F.lit(n)).cast("int"))


def windows(hashes: Column, double: Column) -> Column:
    """Hashes of all windows of five words: two pairs, then the fifth word."""
    return let(joined(double, tail(double, 2)), lambda four: joined(four, tail(hashes, 4)))


def repeat_words(keys: Column) -> Column:
    """Words covered by windows of five that occur twice or more in the text."""

    def covered(keys: Column) -> Column:
        ordered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            key = lambda j: F.get(rows, j)["k"]
            twice = F.filter(rows, lambda x, j: (x["k"] == F.coalesce(key(j + 1), F.bitwise_not(x["k"]))) | (x["k"] == F.coalesce(key(j - 1), F.bitwise_not(x["k"]))))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i + 5 - acc["end"])).alias("n"), (i + 5).alias("end"))
        first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(let(ordered, starts), first, step, lambda acc: acc["n"])

    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(covered(keys))


def base_columns(text: Column, tokens: Column, hashes: Column, double: Column) -> dict[str, Column]:
    """The base counts of a text, given its words and their hashes as columns."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.char_length(F.array_join(tokens, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(windows(hashes, double), repeat_words).cast("long"),
    }


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > REPEATED * n_words)


def bucket_ratios(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS) -> DataFrame:
    """(ratios): one row, an array with the log ratio of every bucket; ``trusted`` has the ids (doc_id) of the target's documents."""
    ids = materialize(trusted.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("text_id")).distinct(), "quality-target")
    texts = docs.select(F.col("doc_id").alias("text_id"), "text")
    target = texts.where(marked(texts, ids, "quality-map")).join(ids.hint("shuffle_hash"), "text_id")

    def counts(texts: DataFrame, name: str) -> DataFrame:
        held = texts.select(let(hashed(words(F.col("text"))), lambda h: buckets(h, pairs(h), n)).alias("b")).select(F.explode("b").alias("bucket"))
        return held.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))

    every = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    every = every.join(counts(docs, "raw"), "bucket", "left").join(counts(target, "target"), "bucket", "left").na.fill(0)
    row = F.struct("bucket", "raw", "target")
    summed = every.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"), F.array_sort(F.collect_list(row)).alias("rows"))
    alpha, total = F.lit(SMOOTHING), F.lit(SMOOTHING * n)
    ratio = lambda r: F.log((r["target"] + alpha) / (F.col("targets") + total)) - F.log((r["raw"] + alpha) / (F.col("raws") + total))
    return summed.select(F.when(F.col("targets") > 0, F.transform("rows", ratio)).otherwise(F.transform("rows", lambda r: F.lit(0.0))).alias("ratios"))


def mean_ratio(places: Column, ratios: Column) -> Column:
    """Mean log ratio over a text's buckets; null without words."""
    total = F.aggregate(places, F.lit(0.0), lambda a, k: a + F.get(ratios, k))
    return F.when(F.size(places) > 0, total / F.size(places))


def scored(docs: DataFrame, ratios: DataFrame, n: int = BUCKETS) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``score``."""

    docs = docs.drop(*ADDED)
    held, result = fresh(docs, "ratios", "result")

    def made(x: Column) -> Column:
        base = base_columns(F.col("text"), x["w"], x["h"], x["d"])
        score = let(buckets(x["h"], x["d"], n), lambda b: mean_ratio(b, F.col(held)))
        return F.struct(*[c.alias(name) for name, c in base.items()], score.alias("score"))

    coded = let(words(F.col("text")), lambda w: let(hashed(w), lambda h: F.struct(w.alias("w"), h.alias("h"), pairs(h).alias("d"))))
    out = docs.withColumn(held, ratios.scalar()).withColumn(result, let(coded, made)).drop(held)
    out = out.select("*", *[F.col(f"{result}.{c}").alias(c) for c in ADDED if c not in ("base_failed", "kept")]).drop(result)
    return out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))


def threshold(scores: DataFrame, trusted: DataFrame, lost: float = LOST, margin: float = MARGIN) -> float | None:
    """The score below which documents go, from ``scores`` (doc_id, base_failed, score) of the trusted ones; null without any."""
    good = scores.where("NOT base_failed AND score IS NOT NULL").select("doc_id", "score").join(trusted, "doc_id", "left_semi")
    low, q1, q3 = (good.agg(F.percentile_approx("score", [lost, 0.25, 0.75], 100_000)).first()[0]) or (None, None, None)
    return None if low is None else low - margin * (q3 - q1)


def judged(scores: DataFrame, least: float | None) -> DataFrame:
    """``kept`` for rows with ``base_failed`` and ``score``: every document is held against the one threshold."""
    passes = F.lit(True) if least is None else F.coalesce(F.col("score") >= least, F.lit(False))
    return scores.withColumn("kept", ~F.col("base_failed") & passes)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled as good and not toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()


def verdicts(docs: DataFrame, labels: DataFrame, columns: list[str], n: int = BUCKETS) -> DataFrame:
    """``columns`` of ``docs`` with the base counts, ``base_failed``, ``score`` and ``kept``, for every row."""
    require(docs, "doc_id", "text")
    require(labels, "doc_id", "quality", "toxic")
    trusted = trusted_ids(labels)
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == 0
    ratios = materialize(bucket_ratios(docs, trusted.where(~held_out), n), "quality-ratios")
    scores = scored(docs, ratios, n).select(*columns, *[c for c in ADDED if c != "kept" and c not in columns])
    scores = materialize(scores, "quality-scores")
    return judged(scores, threshold(scores, trusted.where(held_out)))


def quality_columns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return verdicts(docs.select("doc_id", "text"), labels, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    own = dict(zip(docs.columns, fresh(docs, *[f"own_{k}" for k in range(len(docs.columns))]), strict=True))
    plain = docs.withColumnsRenamed({c: name for c, name in own.items() if c in ADDED})
    kept = verdicts(plain, labels, plain.columns).where("kept").select(*plain.columns)
    return kept.toDF(*docs.columns)
