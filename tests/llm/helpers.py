"""Fixture texts and plain versions of what the operators compute."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators add; a table may have them already.
CLASHES = ["score", "kept", "key", "place", "id", "ids", "row", "_id", "n", "spans", "gone"]


def sentence(rng: random.Random, words: list[str], least: int = 6, most: int = 14) -> str:
    return " ".join(rng.choice(words) for _ in range(rng.randint(least, most))).capitalize() + "."


def texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Documents with copies, near copies, shared passages, shared lines, odd white space, empty, null, tied and very long ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = " ".join(sentence(rng, words) for _ in range(6))
    out: list[tuple[int | None, str | None]] = []
    for k in range(40):
        lines = ["  ".join(sentence(rng, words) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5))]
        if k % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        out.append((k, "\n".join(lines)))
    base = " ".join(sentence(rng, words) for _ in range(12))
    tokens = base.split(" ")
    for k in range(6):  # near copies of one text, some beyond the threshold
        changed = list(tokens)
        for at in rng.sample(range(len(tokens)), k):
            changed[at] = "zz" + str(at)
        out.append((100 + k, " ".join(changed)))
    out += [(200, out[3][1]), (201, out[3][1]), (202, ""), (203, None), (204, " \t\n \x0b"), (205, "one two"), (206, "one two"), (207, "ÉÀ ß 漢字 \U0001f600 é \x85 x y")]
    out += [(208, "same words again and again " * 3000), (209, "a" * 5000), (210, "\n".join(["the very same line here"] * 50)), (None, "no id has this text at all"), (None, None)]
    return out


def frame(spark, rows=None, clashes: bool = False):
    """The documents as a table, with extra columns of clashing names if wanted."""
    rows = texts() if rows is None else rows
    df = spark.createDataFrame([(d, t, None, "s", None if t is None else len(t)) for d, t in rows], DOCS)
    if clashes:
        for name in CLASHES:
            if name not in df.columns:
                df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
