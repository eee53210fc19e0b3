"""URL filters: host and path rules, then a weighted vocabulary matched by one Aho-Corasick pass per URL.

A vocabulary term counts where no ASCII letter or digit touches it. Strict terms reject a URL alone, soft terms when
enough distinct ones occur: every term has a weight, a term counts once, and a URL is rejected once the weights reach
``LIMIT``. Rules go first: the longest rule whose host (or parent domain) and path prefix fit decides.

A null URL, or one without ``://``, has an empty host and path, so no rule fits; a null URL has no terms and is allowed.
Result columns replace columns of the same names; all other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LIMIT = 2
#: Terms that reject alone, and terms of which two must meet.
STRICT = ["adult", "casino", "escort", "malware", "nsfw", "phishing", "porn", "spam", "viagra", "warez", "xxx"]
SOFT = ["ads", "bets", "bonus", "cheap", "click", "crack", "deals", "farm", "free", "keygen", "loan", "pills", "poker", "slots", "track", "win"]
VOCABULARY = dict.fromkeys(STRICT, LIMIT) | dict.fromkeys(SOFT, 1)
#: (host/path prefix, verdict); rules without a path prefix end in a slash.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)
_SPLIT = r"://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, ASCII letters in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that fits and its verdict, null if none does. Of rules as long as one another the first in order wins."""
    rule = verdict = None
    for text, said in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{prefix}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


class Vocabulary:
    """The automaton of a vocabulary, built once per task."""

    def __init__(self, weights: dict[str, int], limit: int):
        self.limit, self.automaton = limit, ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (term, weight))
        self.automaton.make_automaton()

    def terms(self, url: str | None) -> dict[str, int]:
        """Distinct terms that stand alone in the URL, with their weights."""
        text = (url or "").translate(_LOWERED)
        found = {}
        for end, (term, weight) in self.automaton.iter(text) if len(self.automaton) else ():
            start = end + 1 - len(term)
            if not (text[start - 1 : start].isascii() and text[start - 1 : start].isalnum() or text[end + 1 : end + 2].isascii() and text[end + 1 : end + 2].isalnum()):
                found[term] = weight
        return found


def term_hits(df: DataFrame, vocabulary: dict[str, int], limit: int = LIMIT, url: str = "url") -> DataFrame:
    """Adds ``n_strict`` and ``n_soft``, the distinct terms at or below the limit, and ``terms``, all of them in order."""
    kept = df.drop("n_strict", "n_soft", "terms")
    schema = "n_strict long, n_soft long, terms array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Vocabulary(vocabulary, limit)
        for batch in batches:
            found = [scan.terms(u) for u in batch.column(url).to_pylist()]
            strict = pa.array([sum(w >= limit for w in f.values()) for f in found], pa.int64())
            soft = pa.array([sum(w < limit for w in f.values()) for f in found], pa.int64())
            terms = pa.array([sorted(f) for f in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, strict, soft, terms], names=[*batch.schema.names, "n_strict", "n_soft", "terms"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *StructType.fromDDL(schema).fields]))


def judge(df: DataFrame, rules: list[tuple[str, str]] = RULES, vocabulary: dict[str, int] = VOCABULARY, limit: int = LIMIT, url: str = "url") -> DataFrame:
    """Adds host, path, rule, n_strict, n_soft, terms and verdict."""
    hits = term_hits(df.drop("host", "path", "rule", "verdict"), vocabulary, limit, url)
    weight = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair]) if vocabulary else None
    score = F.aggregate(F.transform("terms", lambda t: weight[t]), F.lit(0), lambda a, b: a + b) if vocabulary else F.lit(0)
    out = hits.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": rule, "verdict": F.coalesce(said, F.when(score >= limit, "block").otherwise("allow"))})


def judged_pages(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def _count(terms: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS BIGINT)" for t in terms)


def _case(value: int) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    return "CASE " + " ".join(
        f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '/{p}') THEN '{(text, said)[value]}'"
        for text, said in ordered for d, _, p in [text.partition("/")]
    ) + " END"


SQL = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
    translate(coalesce(regexp_extract(url, '{_SPLIT}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{_SPLIT}', 2), '') AS path
  FROM pages),
hits AS (SELECT *, {_count(STRICT)} AS n_strict, {_count(SOFT)} AS n_soft FROM parts)
SELECT page_id, host, path, {_case(0)} AS rule, coalesce({_case(1)}, CASE WHEN {LIMIT} * n_strict + n_soft >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict, n_soft
FROM hits
"""
