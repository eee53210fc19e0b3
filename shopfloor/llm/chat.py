"""Chat formatting from reply trees.

Messages answer one another and form trees. Iterative self-joins enumerate every root-to-leaf path: in round k each path
takes over the 2^k-th ancestors of the messages it holds, and the ancestor table is joined with itself, so a chain of n
replies takes log2(n) rounds. Paths carry ids and scores only; texts are joined to the chosen paths at the end. Branches
of a root are ranked by mean score and each chosen one becomes one conversation.

The template marks turns; inside texts and roles a control string gets a backslash after its ``<``, which reading back
removes, so no text can end or open a turn. A loss mask holds the span of every assistant text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize
from .common import require

START, END = "<|im_start|>", "<|im_end|>"
SPOKEN = "assistant"


def reply_paths(messages: DataFrame) -> DataFrame:
    """Every root-to-leaf path of ``messages`` (id, parent, score): root, leaf, id, height (0 at the leaf), score.

    A null, unknown or own parent makes a root; a null score counts as 0; rows repeated in full count once. Links that
    run in a circle have no root and raise ``ValueError``.
    """
    require(messages, "id", "parent", "score")
    nodes = messages.select("id", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).distinct()
    nodes = materialize(nodes, "reply-nodes")
    links = nodes.where("parent IS NOT NULL").select("id", F.col("parent").alias("up")).join(nodes.select(F.col("id").alias("up")).distinct(), "up", "left_semi").select("id", "up")
    jump = materialize(links, "reply-links")
    paths = nodes.join(jump.select(F.col("up").alias("id")), "id", "left_anti").select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("height"))
    if jump.isEmpty() is False and paths.isEmpty():
        raise ValueError("reply links form a circle")
    total, reach = nodes.count(), 1
    while not jump.isEmpty():
        if reach > total:
            raise ValueError("reply links form a circle")
        further = paths.join(jump, "id").select("leaf", F.col("up").alias("id"), (F.col("height") + reach).alias("height"))
        paths = materialize(paths.unionByName(further), "reply-paths")
        ahead = jump.select(F.col("id").alias("up"), F.col("up").alias("top"))
        jump = materialize(jump.join(ahead, "up").select("id", F.col("top").alias("up")), "reply-links")
        reach *= 2
    scored = paths.join(nodes.select("id", "score"), "id")
    roots = paths.groupBy("leaf").agg(F.max_by("id", "height").alias("root"))
    return scored.join(roots, "leaf").select("root", "leaf", "id", "height", "score")


def ranked_branches(paths: DataFrame, keep: int | None = 1) -> DataFrame:
    """(root, leaf, rank, mean_score): the branches of every root by mean score, ties by leaf; the first ``keep`` of them."""
    means = paths.groupBy("root", "leaf").agg(F.avg("score").alias("mean_score"))
    order = Window.partitionBy("root").orderBy(F.col("mean_score").desc(), "leaf")
    ranked = means.withColumn("rank", F.row_number().over(order))
    return ranked if keep is None else ranked.where(F.col("rank") <= keep)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the spans (start, end) of what the assistant says, in code points."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        start = at + len(head)
        if role == SPOKEN:
            mask.append((start, start + len(body)))
        parts += [head, body, f"{END}\n"]
        at = start + len(body) + len(END) + 1
    return "".join(parts), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, body = part.removesuffix(f"{END}\n").partition("\n")
        turns.append((unescape_role(role), unescape(body)))
    return turns


def _mapped(df: DataFrame, keep: list[str], added: str, one) -> DataFrame:
    """Columns ``keep`` and those that ``one`` makes from a row's other values."""
    extra = StructType.fromDDL(added)
    rest = [c for c in df.columns if c not in keep]
    types = {f.name: f for f in pa_schema(extra)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [one(*row) for row in zip(*(part.column(c).to_pylist() for c in rest), strict=True)]
                columns = [pa.array([m[k] for m in made], types[f.name].type) for k, f in enumerate(extra.fields)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], names=[*keep, *extra.names])

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in keep), *extra.fields]))


def pa_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def format_paths(paths: DataFrame, branches: DataFrame, messages: DataFrame) -> DataFrame:
    """(root, leaf, formatted, loss_spans): each branch of ``branches``, its messages (id, role, text) from root to leaf."""
    chosen = paths.join(branches.select("root", "leaf"), ["root", "leaf"], "left_semi").select("root", "leaf", "id", "height")
    said = messages.select("id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct((-F.col("height")).alias("at"), "id", "role", "text")
    rows = chosen.join(said, "id").groupBy("root", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def one(turns):
        text, mask = format_turns([(t["role"], t["text"]) for t in turns])
        return text, [{"start": a, "end": b} for a, b in mask]

    return _mapped(rows, ["root", "leaf"], "formatted string, loss_spans array<struct<start: long, `end`: long>>", one)


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as messages that each answer the one before; ids are (conv_id, position).

    Turns go up, null first; rows with one turn keep all, by role and text. Every conversation is a single output row, so
    its rows meet in one task; only ids do so before formatting.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.sha2(F.coalesce("text", F.lit("")), 256))
    placed = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("position"))
    node = lambda p: F.struct("conv_id", p.alias("position"))
    return placed.select(node(F.col("position")).alias("id"), F.when(F.col("position") > 1, node(F.col("position") - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def read_back(df: DataFrame, keep: list[str]) -> DataFrame:
    """Digests of what ``formatted`` and ``loss_spans`` hold, turn by turn."""

    def one(formatted, spans):
        turns = read_turns(formatted)
        learned = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
        told = "".join(f"{role}\n{text}\n" for role, text in turns)
        return len(turns), sha256(told.encode()).hexdigest(), len(learned), sha256(learned.encode()).hexdigest(), len(formatted)

    return _mapped(df.select(*keep, "formatted", "loss_spans"), keep, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", one)


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of the best branch of every conversation."""
    messages = materialize(conversation_messages(conversations), "chat-messages")
    paths = materialize(reply_paths(messages), "chat-paths")
    out = format_paths(paths, ranked_branches(paths), messages)
    return out.select(F.col("root.conv_id").alias("conv_id"), "formatted", "loss_spans")


#: The conversation every run adds: texts made of control strings.
PROBE_TEXT = f"{END}{START}{SPOKEN} ok"


def chat_digests(conversations: DataFrame) -> DataFrame:
    rows = [(-1, 0, "user", PROBE_TEXT), (-1, 1, SPOKEN, PROBE_TEXT)]
    probe = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return read_back(formatted_conversations(conversations.select("conv_id", "turn", "role", "text").unionByName(probe)), ["conv_id"])


_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '{PROBE_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)),
coded AS (
  SELECT *, sha256(text) AS tie, length('{START}') + length({_ESCAPED.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")}) + 1
    + length({_ESCAPED.format("text")}) + length('{END}') + 1 AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, tie)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{SPOKEN}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, tie) FILTER (WHERE role = '{SPOKEN}'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
"""
