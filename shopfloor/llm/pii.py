r"""Personal data: base patterns, and generated candidates that boosted trees accept or refuse.

Base spans follow fixed patterns, leftmost and non-overlapping per kind, with a check of every match; they always stay. High
recall generators propose further spans, which may overlap; those that touch no base span can be added. A gradient-boosted
classifier scores each of them by the format of its text and by the text around it. Its positive examples are base spans and
known keys rewritten in the formats that only the generators find (``REWRITTEN``), known keys, and passwords after their name;
the negative ones are candidates, found or made from base spans (``BROKEN``), that fail the check of their generator
(``failed``). A candidate that is neither is scored, but teaches nothing. All examples count: a hash puts four fifths of them
into the fit, and the other fifth sets, for each generator, the lowest threshold with the ``PRECISION`` wanted. Where a generator
has many examples of a label, they weigh as much as ``BALANCE`` of them together, so that no kind drowns the others. Of accepted candidates that overlap the one with the highest
score is added, then the first, then the longest.

Only DataFrame functions and Spark's own classifier are used. Offsets are code points, ends exclusive; null text counts as
empty. Positions come from the text between matches, summed in blocks. Patterns cannot run away: repeated parts are
possessive, and a pattern that could start anywhere in a run starts at its beginning. Rows of one id and one text get one
result. Without examples of both kinds nothing is added, and by a generator without positive examples neither.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, let, require

#: Most weight of all examples of one generator and label together; each weighs one where they are no more.
BALANCE = 2_000
TREES, LEAVES_DEPTH, PRECISION = 10, 3, 0.99

KINDS = ["email", "ip", "card", "phone", "secret"]
_NAME = "A-Za-z0-9._%+-"
#: Base patterns in the order of their kinds. The starts change no match: a run that fails fails from its middle, too.
EMAIL = rf"(?:\G|(?<![{_NAME}]))[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
#: (kind, pattern, what a text must have for it).
GENERATORS = [
    ("email", rf"(?<![{_NAME}])[{_NAME}]{{1,64}}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{{1,63}}+ ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{{2,24}}+", r"@|\(at\)|\[at\]"),
    ("phone", r"(?<![0-9+])\(?[0-9]{2,4}+\)?[ .-][0-9]{3,4}+[ .-][0-9]{3,4}+", r"[0-9]"),
    ("card", r"(?<![0-9])[0-9](?:[ .-]?[0-9]){12,18}+", r"[0-9]"),
    ("secret", r"(?<![A-Za-z0-9/+=_-])(?=[A-Za-z/+=_-]*+[0-9])(?=[0-9/+=_-]*+[A-Za-z])[A-Za-z0-9/+=_-]{16,}+", r"[0-9]"),
    ("secret", r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s?[=:]\s?[\"']?[^\s\"',;]{6,}+", r"[=:]"),
]
#: Formats of keys that count as confirmed when the classifier learns.
CONFIRMED = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp|gho|sk|pk)[_-][A-Za-z0-9_-]{16,}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
NAMED = r"(?i)^(?:password|passwd|pwd|secret|token|api[_-]?key)"
#: (generator, pattern, replacement): base spans of the generator's kind, or known keys, as only the generator finds them.
REWRITTEN = [
    (0, r"^([^@]+)@(.+)\.([^.]+)$", "$1 (at) $2 (dot) $3"), (0, r"^([^@]+)@(.+)\.([^.]+)$", "$1[at]$2[dot]$3"), (0, r"^([^@]+)@", "$1 @ "), (0, "@", "(at)"),
    (1, r"^\+", ""), (1, r"^\+[0-9]{1,3}[\x20.-]+", ""), (1, r"^\+[0-9]*?[\x20.()-]*([0-9]{3})[\x20.()-]*([0-9]{3})[\x20.()-]*([0-9]{4})$", "$1-$2-$3"),
    (1, r"^\+[0-9]*?[\x20.()-]*([0-9]{3})[\x20.()-]*([0-9]{3})[\x20.()-]*([0-9]{4})$", "$1.$2.$3"), (1, r"^\+[0-9]*?[\x20.()-]*([0-9]{3})[\x20.()-]*([0-9]{3})[\x20.()-]*([0-9]{4})$", "($1) $2 $3"),
    (2, r"[\x20-]?([0-9]{4})(?=[\x20-]?[0-9])[\x20-]?", "$1."), (2, r"[\x20-]?([0-9])[\x20-]?(?=[0-9]{2})", "$1."),
    (3, r"^(?:AKIA|ASIA|(?:ghp|gho|sk|pk)[_-])", ""),
]
#: The same for formats that fail the generator's check.
BROKEN = [(0, r"^([^@]+)@(.+)\.([^.]+)$", "$1 @ $2. $3"), (1, r"^\+.*?([0-9]{2})[^0-9]*([0-9]{3})[^0-9]*([0-9]{3})$", "$1-$2-$3"), (2, r"[\x20-]?([0-9]{4})(?=[\x20-]?[0-9])[\x20-]?", "$1.")]
AROUND = r"(?i)(?:tel|phone|call|fax|mail|contact|card|visa|key|pass|token|secret|id)\W{0,4}$"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    doubled = lambda d: F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
    term = lambda d, i: F.when(F.pmod(F.length(number) - i, F.lit(2)) == 0, doubled(d.cast("int"))).otherwise(d.cast("int"))
    each = F.transform(F.split(number, "(?<=.)(?=.)", -1), lambda d, i: term(d, i))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, d: a + d), F.lit(10)) == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def whole(value: Column, before: Column, after: Column) -> Column:
    """Digits of a number with those that stand around it."""
    return digits(F.concat(F.regexp_extract(before, r"[0-9\x20.()-]*$", 0), value, F.regexp_extract(after, r"^[0-9\x20.()-]*", 0)))


def failed(generator: Column, value: Column, before: Column, after: Column) -> Column:
    """Whether a candidate fails its generator's check: a sentence ends in it, wrong number of digits or Luhn sum, plain words and numbers."""
    return (
        F.when(generator == 0, value.rlike(r"\x20\.|\.\x20")).when(generator == 1, ~F.length(whole(value, before, after)).between(10, 15))
        .when(generator == 2, ~valid("card", value)).when(generator == 3, ~value.rlike("[A-Za-z][0-9]|[0-9][A-Za-z]")).otherwise(False)
    )


def running(lengths: Column) -> Column:
    """Running sums; blocks keep the work for n numbers at n^1.5."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    size = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))

    def summed(size: Column) -> Column:
        heads = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / size).cast("int")), lambda b: total(F.slice(lengths, 1, b * size)))

        def each(heads: Column) -> Column:
            at = lambda i: F.floor(i / size).cast("int")
            return F.transform(lengths, lambda x, i: F.get(heads, at(i)) + total(F.slice(lengths, at(i) * size + 1, i - at(i) * size + 1)))

        return let(heads, each)

    return let(size, summed)


def matches(text: Column, pattern: str, needs: str) -> Column:
    """All matches in order: array of (start, end, value, before, after), with some of the text around."""

    def placed(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        steps = F.transform(hits, lambda h, i: F.char_length(F.get(gaps, i)) + F.when(i > 0, F.char_length(F.get(hits, i - 1))).otherwise(0))
        row = lambda starts: F.transform(hits, lambda h, i: F.struct(
            F.get(starts, i).alias("start"), (F.get(starts, i) + F.char_length(h)).alias("end"), h.alias("value"),
            F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(12)).alias("after"),
        ))
        return let(running(steps), row)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    none = F.array().cast("array<struct<start: int, end: int, value: string, before: string, after: string>>")
    return F.when(text.rlike(needs) & text.rlike(pattern), let(found, placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, value, before, after) of all base kinds, kinds by their place in ``KINDS``."""

    def of(k: int, kind: str, pattern: str, needs: str) -> Column:
        good = F.filter(matches(text, pattern, needs), lambda m: valid(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), *[m[f].alias(f) for f in ("value", "before", "after")]))

    patterns = (("email", EMAIL, "@"), ("ip", IP, r"[0-9]\.[0-9]"), ("card", CARD, r"[0-9]"), ("phone", PHONE, r"\+[0-9]"))
    return F.array_sort(F.concat(*[of(k, *x) for k, x in enumerate(patterns)]))


def candidates(text: Column) -> Column:
    """Array of (start, end, value, before, after, generator) of all generators."""

    def of(k: int, pattern: str, needs: str) -> Column:
        return F.transform(matches(text, pattern, needs), lambda m: F.struct(*[m[f].alias(f) for f in ("start", "end", "value", "before", "after")], F.lit(k).alias("generator")))

    return F.concat(*[of(k, pattern, needs) for k, (_, pattern, needs) in enumerate(GENERATORS)])


def _features() -> dict[str, Column]:
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    left = lambda keep: F.length(F.regexp_replace(value, f"[^{keep}]", "")).cast("double")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": F.length(value).cast("double"), "digits": left("0-9"), "upper": left("A-Z"), "lower": left("a-z"), "hex": left("0-9a-f"),
        "marks": left("=/+_ .()-"), "groups": F.size(F.split(value, r"[^0-9]+", -1)).cast("double"),
        "variety": F.size(F.array_distinct(F.split(value, ""))).cast("double"), "luhn": yes(F.when(F.length(digits(value)) >= 12, luhn(digits(value)))),
        "plus": yes(value.startswith("+")), "at": yes(value.contains("@")), "written": yes(value.rlike(r"\(at\)|\[at\]|dot")), "named": yes(value.rlike(NAMED)),
        "whole": F.length(whole(value, before, after)).cast("double"), "parted": yes(value.rlike(r"\x20\.|\.\x20")), "mixed": yes(value.rlike("[A-Za-z][0-9]|[0-9][A-Za-z]")),
        "told": yes(before.rlike(AROUND)), "glued": yes(before.rlike(r"[0-9A-Za-z.+-]$")), "runs_on": yes(after.rlike(r"^[0-9A-Za-z-]")),
        **{f"generator_{k}": yes(F.col("generator") == k) for k in range(len(GENERATORS))},
    }


def rewritten(spans: DataFrame) -> DataFrame:
    """Examples (generator, value, before, after, confirmed, _order) made of ``spans`` (kind, value, before, after): each is put in another format and found again."""
    made = F.filter(F.array(*[
        F.struct(F.lit(k).alias("generator"), F.lit(good).alias("good"), F.when((F.col("kind") == KINDS.index(GENERATORS[k][0])) & F.col("value").rlike(pattern), last(F.regexp_replace("value", pattern, to))).alias("value"))
        for good, last, formats in ((True, lambda v: v, REWRITTEN), (False, _wrong_digit, BROKEN)) for k, pattern, to in formats
    ]), lambda x: x["value"].isNotNull())
    rows = spans.select("before", "after", F.xxhash64("value", "before", "after").alias("_order"), F.explode(made).alias("x")).select("before", "after", "_order", "x.*")
    found = F.explode(candidates(F.concat("before", "value", "after")))
    rows = rows.select("_order", "good", F.col("generator").alias("_of"), F.char_length("before").alias("_from"), (F.char_length("before") + F.char_length("value")).alias("_to"), found.alias("c"))
    rows = rows.where("c.generator = _of AND c.start < _to AND _from < c.end").select("_order", "good", "c.generator", "c.value", "c.before", "c.after")
    rows = rows.withColumn("failed", failed(*[F.col(c) for c in ("generator", "value", "before", "after")])).where("good <> failed")
    return rows.select("generator", "value", "before", "after", F.col("good").alias("confirmed"), "_order")


def _wrong_digit(value: Column) -> Column:
    """``value`` with another last digit; one without a digit at its end stays."""
    return F.when(value.rlike("[0-9]$"), F.concat(F.regexp_replace(value, "[0-9]$", ""), F.pmod(F.right(value, F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))).otherwise(value)


def examples(proposed: DataFrame, bases: DataFrame) -> DataFrame:
    """All labelled candidates (generator, value, before, after, confirmed, _order, weight)."""
    columns = ["generator", "value", "before", "after"]
    key = F.col("value").rlike(CONFIRMED)
    label = F.when(key | F.col("value").rlike(NAMED), True).when(failed(*[F.col(c) for c in columns]), False)
    known = proposed.select(*columns, label.alias("confirmed")).where("confirmed IS NOT NULL").distinct()
    known = materialize(known.withColumn("_order", F.xxhash64("value", "before", "after")), "pii-known")
    bases = materialize(bases.select("kind", "value", "before", "after").distinct().withColumn("_order", F.xxhash64("value", "before", "after")), "pii-bases")
    spans = bases.where(F.col("kind").isin([KINDS.index(k) for k in ("email", "card", "phone")]))
    keys = known.where((F.col("generator") == 3) & key).select(F.lit(KINDS.index("secret")).alias("kind"), "value", "before", "after", "_order")
    made = rewritten(spans.union(keys).drop("_order")).select(*known.columns)
    labelled = materialize(known.union(made), "pii-labelled")
    weights = labelled.groupBy("generator", "confirmed").agg(F.least(F.lit(1.0), F.lit(float(BALANCE)) / F.count(F.lit(1))).alias("weight"))
    return labelled.join(F.broadcast(weights), ["generator", "confirmed"]).select(*labelled.columns, "weight")


def accepted(proposed: DataFrame, bases: DataFrame) -> DataFrame:
    """Rows of ``proposed`` (value, before, after, generator, ...) whose score reaches their generator's threshold, with ``score``; ``bases`` has the base spans."""
    none = proposed.withColumn("score", F.lit(0.0)).where("false")
    features = _features()
    code = lambda df: df.withColumns({f"f_{name}": c for name, c in features.items()})
    coded = code(proposed)
    vectors = VectorAssembler(inputCols=[f"f_{name}" for name in features], outputCol="features")
    taught = code(examples(proposed, bases))
    taught = vectors.transform(taught.select("generator", "_order", "weight", F.col("confirmed").cast("double").alias("label"), *[f"f_{n}" for n in features])).select("generator", "_order", "weight", "label", "features")
    taught = materialize(taught, "pii-examples")
    held_out = F.pmod(F.col("_order"), F.lit(5)) == 0
    classes = {r["label"] for r in taught.where(~held_out).select("label").distinct().collect()}
    if len(classes) < 2:
        return none
    model = GBTClassifier(maxIter=TREES, maxDepth=LEAVES_DEPTH, stepSize=0.3, seed=6, maxBins=32, weightCol="weight").fit(taught.where(~held_out).select("features", "label", "weight"))

    def score(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("score", F.round(vector_to_array("probability")[1], 3)).drop("rawPrediction", "probability", "prediction")

    curve = score(taught.where(held_out)).groupBy("generator", "score").agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("good")).collect()
    least: dict[int, float] = {}
    for k in range(len(GENERATORS)):
        n = good = 0
        for r in sorted((r for r in curve if r["generator"] == k), key=lambda r: -r["score"]):
            n, good = n + r["n"], good + r["good"]
            if good >= PRECISION * n and r["score"] >= 0.5:
                least[k] = r["score"]
    if not least:
        return none
    chosen = reduce(or_, [(F.col("generator") == k) & (F.col("score") >= x) for k, x in least.items()])
    return score(vectors.transform(coded)).where(chosen).select(*proposed.columns, "score")


def _apart(spans: Column, start: Column, end: Column) -> Column:
    return ~F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, added): spans (start, kind, end) of every row, base ones and those the classifier adds."""
    require(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.xxhash64("text").alias("row"), base_spans(text).alias("base"), candidates(text).alias("found"))
    found = materialize(found, "pii-found")
    free = F.filter("found", lambda c: _apart(F.col("base"), c["start"], c["end"]))
    proposed = found.where(F.size("found") > 0).select("doc_id", "row", F.explode(free).alias("c")).select("doc_id", "row", "c.*").distinct()
    good = accepted(proposed, found.select(F.explode("base").alias("b")).select("b.*"))
    kind = F.element_at(F.array(*[F.lit(KINDS.index(k)) for k, _, _ in GENERATORS]), F.col("generator") + 1)
    ranked = F.struct((-F.col("score")).alias("worse"), "start", (-F.col("end")).alias("shorter"), kind.alias("kind"), "end")
    rows = good.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(ranked)).alias("ranked"))
    start = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    taken = F.aggregate("ranked", start, lambda acc, c: F.when(_apart(acc, c["start"], c["end"]), F.concat(acc, F.array(F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))).otherwise(acc))
    rows = rows.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), taken.alias("added"))
    out = found.select("doc_id", "row", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"))
    joined = out.join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    return joined.select("doc_id", "row", "base", F.coalesce("added", start).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return personal_spans(docs).select(
        "doc_id", *[count(k) for k in KINDS[:4]], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans")
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; of overlapping spans the first and longest stands for all."""
    of, row, spans = fresh(docs, "of", "row", "spans")
    found = materialize(personal_spans(docs), "pii-spans").select("doc_id", "row", F.array_sort(F.concat("base", "added"))).toDF(of, row, spans).dropDuplicates([of, row])
    held = docs.join(found, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(row)), "left")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    first = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        F.when(s["start"] < acc["at"], acc["text"]).otherwise(F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))).alias("text"),
        s["end"].alias("at"),
    ))
    cut = F.aggregate(spans, first, step, lambda acc: F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    return held.withColumn("text", F.when(F.size(spans) > 0, cut).otherwise(F.col("text"))).select(*docs.columns)
