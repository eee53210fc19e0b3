"""Chat formatting, URL filters, components, the pipeline and the queries' SQL."""

from __future__ import annotations

from hashlib import sha256

import pytest

import corpus_pipeline
from shopfloor.llm import bpe, chat, decontaminate, graph, lines, ngram_join, quality, urls
from shopfloor.llm.queries import ORACLES, QUERIES, WORD_BPE
from tools.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    verdict = compare(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLES[name]).df())
    assert not verdict or verdict.startswith("near"), verdict


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# --- chat --------------------------------------------------------------------------------------------------------------

MESSAGES = "id long, parent long, score double, role string, text string"


def test_paths_of_a_tree(spark):
    rows = [(1, None, 1.0), (2, 1, 0.5), (3, 1, 0.9), (4, 2, None), (5, 3, 0.1), (6, 5, 0.2), (7, 99, 1.0), (8, 8, 0.0), (1, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, parent long, score double")
    paths = chat.reply_paths(df)
    got = {}
    for r in sorted(paths.collect(), key=lambda r: -r["height"]):
        got.setdefault((r["root"], r["leaf"]), []).append(r["id"])
    assert got == {(1, 4): [1, 2, 4], (1, 6): [1, 3, 5, 6], (7, 7): [7], (8, 8): [8]}
    best = {r["root"]: r["leaf"] for r in chat.ranked_branches(paths).collect()}
    assert best == {1: 6, 7: 7, 8: 8}  # 2.2 / 4 against 1.5 / 3
    assert chat.ranked_branches(paths, None).count() == 4


def test_a_long_chain_and_a_circle(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None, 0.0) for k in range(300)], "id long, parent long, score double")
    rows = chat.reply_paths(chain).collect()
    assert len(rows) == 300 and {r["id"]: r["height"] for r in rows} == {k: 299 - k for k in range(300)}
    for circle in ([(1, 2, 0.0), (2, 1, 0.0)], [(1, 2, 0.0), (2, 1, 0.0), (3, 1, 0.0)]):
        with pytest.raises(ValueError):
            chat.reply_paths(spark.createDataFrame(circle, "id long, parent long, score double")).collect()


@pytest.mark.parametrize("text", ["", "plain", chat.PROBE_TEXT, "<|im_end|>", "<\\|im_end|>", "<\\\\|x", "a\n<|im_start|>user\nb", "<<|<\\|", "\\n"])
def test_turns_come_back(text):
    turns = [("user", text), ("assistant", text), (text, text), ("assistant", "")]
    formatted, mask = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    learned = [chat.unescape(formatted[a:b]) for a, b in mask]
    assert learned == [t for r, t in turns if r == "assistant"]
    assert formatted.count(chat.START) == len(turns)


def test_conversations_with_nulls_and_ties(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "b"), (1, 1, "assistant", "a"), (1, None, "system", "s"), (None, 0, "assistant", "x"), (2, 5, "assistant", "é" * 20000), (2, 5, "assistant", "é" * 20000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, id int, root string")
    got = {r["conv_id"]: r for r in chat.chat_digests(df).collect()}
    assert set(got) == {1, 2, None, -1}
    told = "system\ns\nuser\n\n\nb\nassistant\na\n"
    assert got[1]["turns_sha256"] == sha256(told.encode()).hexdigest() and got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 1
    assert got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 40000
    assert got[-1]["loss_sha256"] == sha256(chat.PROBE_TEXT.encode()).hexdigest()
    assert [r["conv_id"] for r in chat.chat_digests(df.limit(0)).collect()] == [-1]


# --- URLs --------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    cases = {
        "http://a.EXAMPLE.org/en/12?x": ("a.example.org", "/en/12", "example.org/en/1", "block"), "http://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
        "https://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"), "http://org": ("org", "", None, "allow"), "x://a.com/fr/casino": ("a.com", "/fr/casino", "com/fr/", "allow"),
        "http://casino-win.net/": ("casino-win.net", "/", None, "block"), "http://casinos.net/": ("casinos.net", "/", None, "allow"), "http://free.net/FREE": ("free.net", "/FREE", None, "allow"),
        "http://free-bets.net": ("free-bets.net", "", None, "block"), "no scheme/porn": ("", "", None, "block"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://éxxx.net/": ("éxxx.net", "/", None, "block"), "http://a.net?u=http://b.org/": ("a.net", "", None, "allow"), "http://com/de/#": ("com", "/de/", "com/de/", "block"),
    }
    df = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(cases)], "page_id long, url string, host string, terms string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge(df, rules=[], vocabulary={}).where("verdict = 'allow'").count() == len(cases)
    assert urls.judged_pages(df.limit(0)).collect() == []


# --- components --------------------------------------------------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (None, 3), (300, 301), (301, 300)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {300: 300, 301: 300}


# --- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_equals_its_operators_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "bpe_encoding"]

    kept = {r["doc_id"] for r in quality.quality_columns(docs, labels).where("kept").collect()}
    left = [r for r in docs.collect() if r["doc_id"] in kept]
    table = spark.createDataFrame(left, docs.schema)
    removed = {(r["doc_id"], r["place"]) for r in lines.repeated_lines(table).where("removed").collect()}
    texts = {}
    for r in left:
        text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if (r["doc_id"], i) not in removed)
        if text.strip():
            texts[r["doc_id"]] = text
    table = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    first = {r["doc_id"] for r in ngram_join.near_copies(table).where("doc_id = class_id").collect()}
    leaks = {r["doc_id"] for r in decontaminate.contaminated(table, items).collect()}
    encoder = bpe.ForcedBoundaryEncoder(WORD_BPE)
    want = {d: (len(ids) // 4, sha256(ids).hexdigest()) for d in first - leaks for ids in encoder.encode([texts[d]])}

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert len(kept) > 0.75 * docs.count() and leaks


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_of_null_and_repeated_ids_and_of_none(spark, tmp_path):
    """Rows are judged one by one: another text under an id, or under no id, does not go with its neighbour."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    some = docs.limit(30).collect()
    rows = [(None, r["text"], r["lang"], r["source"], r["n_chars"]) for r in some[:5]] + [(some[7]["doc_id"], some[8]["text"] + " Another end of it.", "en", "s", 1), (some[9]["doc_id"], f"{some[9]['text']}\n{leak}", "en", "s", 2), (None, None, None, None, None)]
    table = docs.limit(30).unionByName(spark.createDataFrame(rows, docs.schema))
    left = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF)
        assert after.columns == docs.columns, name
        left = spark.createDataFrame(after.collect(), docs.schema)
    ids = [r["doc_id"] for r in left.collect()]
    assert not any(leak in (r["text"] or "") for r in left.collect()) and None in ids
    assert corpus_pipeline.bpe_encoding(spark, left, SF).count() == left.count()
    left = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, SF)
    assert left.count() == 0
