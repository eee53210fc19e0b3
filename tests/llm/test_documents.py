"""Text operators on small fixtures against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shopfloor.llm import bpe, decontaminate, lines, ngram_join, pii, quality, spans, suffix
from shopfloor.llm.queries import WORD_BPE

from .helpers import empty, frame, sentence, texts


def by_id(rows, *names):
    return sorted(((r["doc_id"], *[r[n] for n in names]) for r in rows), key=repr)


# --- BPE ---------------------------------------------------------------------------------------------------------------


def test_encoding_equals_the_library_and_decodes(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    odd = ["a<|endoftext|>b <|startoftext|>", "ΑΣ Σ ΣΑΣ", "\x1c a\x1db", "a᠎b ​ ﻿x", "İ I'LL they'RE 123,456!!??", "ﬁ ① ½ กำ 힣", "\x85x\xa0y\x00z", "<|endoftext|>", "''s 's's", "áͅ b"]
    rows = texts() + [(300 + k, t) for k, t in enumerate(odd)]
    got = bpe.decode_column(bpe.encode_column(frame(spark, rows, clashes=True), WORD_BPE), WORD_BPE).select("doc_id", "text", "ids", "decoded", "score").collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(memoryview(bytes(r["ids"])).cast("I")) == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
        assert r["score"] == "x"


def test_cuts_lie_between_bytes_no_token_joins():
    encoder = bpe.ForcedBoundaryEncoder(WORD_BPE)
    word = next(a + b for a in "qzx" for b in "qzxj0" if a + b not in encoder.inside)
    assert encoder.cuts(f"th{word}in") == [f"th{word[0]}", f"{word[1]}in"] or len(encoder.cuts(f"th{word}in")) >= 2
    assert "".join(encoder.cuts(f"th{word}in")) == f"th{word}in"


def test_digests_of_an_empty_table(spark):
    assert bpe.token_digests(empty(spark), WORD_BPE).collect() == []


# --- quality -----------------------------------------------------------------------------------------------------------


def quality_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    filled = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(filled) - len(set(filled)), len(covered), failed


def labels(spark, good):
    return spark.createDataFrame([(d, 1, 0) for d in good] + [(999, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")


def test_base_rules_and_scores(spark):
    import math

    import xxhash

    rows = [r for r in texts() if r[0] is not None] + [(300, "### $$$ a|b " * 9), (301, "ring zing ring zing ring zing ring zing ring zing ring zing")]
    good = [d for d, _ in rows if d < 40]
    got = {r["doc_id"]: r for r in quality.quality_columns(frame(spark, rows, clashes=True), labels(spark, good)).collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for d, t in rows:
        assert tuple(got[d][n] for n in names) == quality_base(t), d

    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    def places(text):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        pair = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(hashes, hashes[1:])]
        return [signed(h) % quality.BUCKETS for h in hashes + pair]

    held_out = {r["doc_id"] for r in spark.createDataFrame([(d,) for d in good], "doc_id long").where(f"pmod(xxhash64(doc_id), {quality.PARTS}) = 0").collect()}
    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(places(t))
        if d in good and d not in held_out:
            target.update(places(t))
    alpha, n = quality.SMOOTHING, quality.BUCKETS
    raws, targets = sum(raw.values()), sum(target.values())
    for d, t in rows:
        b = places(t)
        if b:
            want = sum(math.log((target[k] + alpha) / (targets + alpha * n)) - math.log((raw[k] + alpha) / (raws + alpha * n)) for k in b) / len(b)
            assert got[d]["score"] == pytest.approx(want, abs=1e-9), d
        else:
            assert got[d]["score"] is None and not got[d]["kept"]
    assert all(got[d]["kept"] for d in good if not got[d]["base_failed"])
    assert not got[301]["kept"]


def test_all_trusted_documents_count(spark, monkeypatch):
    """Target and threshold cover every trusted document, also of many."""
    import numpy as np

    held = f"pmod(xxhash64(doc_id), {quality.PARTS}) = 0"
    ids = spark.range(40_000).selectExpr("id AS doc_id")
    docs = ids.selectExpr("doc_id", "concat_ws(' ', transform(sequence(0, 11), k -> concat('w', k * (doc_id % 50)))) AS text")
    labelled = ids.selectExpr("doc_id", "1 AS quality", "0 AS toxic").where("doc_id % 4 < 3")
    n_held, n_target = labelled.where(held).count(), labelled.where(f"NOT {held}").count()
    given, threshold = [], quality.threshold
    monkeypatch.setattr(quality, "threshold", lambda scores, trusted: given.append((scores, trusted)) or threshold(scores, trusted))
    got = quality.quality_columns(docs, labelled)
    (scores, trusted), = given
    assert trusted.count() == n_held > 5_000 and n_target > 20_000
    ratio = np.array(quality.bucket_ratios(docs, labelled.where(f"NOT {held}").select("doc_id")).first()["ratios"])
    places = lambda t: quality.let(quality.hashed(quality.words(t)), lambda h: quality.buckets(h, quality.pairs(h), quality.BUCKETS))
    coded = docs.where("doc_id < 50").select("doc_id", places(quality.F.col("text")).alias("b")).collect()
    sizes = {r["k"]: (r["raw"], r["target"]) for r in docs.join(labelled, "doc_id", "left").selectExpr("doc_id % 50 AS k", f"quality = 1 AND NOT {held} AS t").groupBy("k").agg(quality.F.count("k").alias("raw"), quality.F.count_if("t").alias("target")).collect()}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for r in coded:
        for b in r["b"]:
            raw[b] += sizes[r["doc_id"]][0]
            target[b] += sizes[r["doc_id"]][1]
    share = lambda c: np.log((c + quality.SMOOTHING) / (c.sum() + quality.SMOOTHING * quality.BUCKETS))
    assert np.allclose(ratio, share(target) - share(raw), atol=1e-9)
    rows = {r["doc_id"]: r["score"] for r in got.where("doc_id < 50").collect()}
    assert all(rows[r["doc_id"]] == pytest.approx(np.mean(ratio[r["b"]]), abs=1e-9) for r in coded)


def test_quality_without_labels_and_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_columns(frame(spark), none).collect()}
    assert kept[0] and not kept[202] and not kept[203]
    assert quality.quality_columns(empty(spark), none).collect() == []
    docs = frame(spark, clashes=True)
    assert quality.good_documents(docs, none).columns == docs.columns


# --- n-gram join -------------------------------------------------------------------------------------------------------


def runs(text, n=5):
    words = (text or "").split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_near_copies_equal_all_pairs(spark):
    rows = texts()
    sets = [runs(t) for _, t in rows]
    link = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and 5 * len(a & b) >= 4 * len(a | b):
                link[i].add(j)
    got = ngram_join.near_copies(frame(spark, rows, clashes=True)).collect()
    assert len(got) == len(rows)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return [rows[j][0] for j in seen if rows[j][0] is not None]

    want = sorted(((rows[i][0], min(reach(i), default=None), len(link[i])) for i in range(len(rows))), key=repr)
    assert by_id(got, "class_id", "n_links") == want
    assert sum(r["n_links"] for r in got if r["doc_id"] in range(100, 106)) > 0


def test_blocks_do_not_change_links(spark, monkeypatch):
    want = by_id(ngram_join.near_copies(frame(spark)).collect(), "class_id", "n_links")
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 2)
    assert by_id(ngram_join.near_copies(frame(spark)).collect(), "class_id", "n_links") == want


def test_prefixes_shorten_until_the_recall_wanted(spark):
    """Near copies at 0.8 to 0.85 rarely share 30 min-hashes: whole signatures find few of them, shortened ones all."""
    assert ngram_join.meets(0.8, 20, 7) > 0.99 > ngram_join.meets(0.8, 20, 8)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(f"z{k}" if at == 13 * k or at in range(20 * k, 20 * k + 15, 5) else w for at, w in enumerate(base))) for k in range(8)]
    sets = [runs(t) for _, t in rows]
    links = sum(5 * len(a & b) >= 4 * len(a | b) for a in sets for b in sets) - len(sets)
    found = lambda **how: sum(r["n_links"] for r in ngram_join.near_copies(frame(spark, rows), depth=30, **how).collect())
    assert links > 20
    assert found(recall=0.0) < links
    assert found() == links


def test_recall_on_the_test_table(spark):
    """Links of every row of the small table against exact counts of shared runs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: runs(r["text"]) for r in docs.collect()}
    holders, shared = defaultdict(list), Counter()
    for doc, held in sets.items():
        for run in held:
            shared.update((other, doc) for other in holders[run])
            holders[run].append(doc)
    want = Counter()
    for (a, b), c in shared.items():
        if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
            want.update((a, b))
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_copies(docs).collect()}
    assert sum(want.values()) > 50
    assert all(got[d] <= want[d] for d in got)
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_first_of_each_knows_rows_by_their_text(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(3, base), (7, base), (7, "a text that stands nowhere else at all here"), (None, base + " more"), (9, None), (9, "")]
    left = Counter((r["doc_id"], r["text"]) for r in ngram_join.first_of_each(frame(spark, rows)).collect())
    assert left == Counter([(None, base + " more"), (7, rows[2][1]), (9, None), (9, "")])
    rows = [(5, base), (None, base), (None, "another text under no id for all of it"), (None, base)]
    left = Counter((r["doc_id"], r["text"]) for r in ngram_join.first_of_each(frame(spark, rows)).collect())
    assert left == Counter([(None, base), (None, rows[2][1])])


def test_first_of_each_keeps_columns_and_one_of_a_group(spark):
    docs = frame(spark, clashes=True)
    left = ngram_join.first_of_each(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 3 in ids and 200 not in ids and 201 not in ids and 203 in ids and ids.count(None) == 2
    assert ngram_join.near_copies(empty(spark)).collect() == []


# --- sentence spans ----------------------------------------------------------------------------------------------------


def spans_plain(rows):
    def sentences(text):
        return [p for p in spans.pieces(text or "") if spans.words_of(p)]

    found, order = {}, []
    for d, t in rows:
        s = [" ".join(spans.words_of(p)) for p in sentences(t)]
        for i in range(len(s)):
            if len(s[i].split(" ")) >= spans.LONG:
                order.append(((-1 if d is None else d, i), (s[i],)))
            for k in range(2, len(s) - i + 1):
                if sum(len(x.split(" ")) for x in s[i : i + k]) >= spans.WORDS:
                    order.append(((-1 if d is None else d, i), tuple(s[i : i + k])))
                    break
    for place, run in sorted(order):
        found.setdefault(run, place)
    gone = defaultdict(set)
    for (d, i), run in order:
        if found[run] != (d, i):
            gone[d].update(range(i, i + len(run)))
    return gone


def test_sentence_spans_equal_plain(spark):
    rows = texts()
    gone = spans_plain(rows)
    got = spans.without_repeats(frame(spark, rows, clashes=True)).collect()
    assert len(got) == len(rows) and any(r["n_removed"] for r in got)
    source = defaultdict(list)
    for d, t in rows:
        source[d].append(t)
    for r in got:
        if r["doc_id"] is None:
            continue
        text, away = source[r["doc_id"]][0], gone[r["doc_id"]]
        assert r["n_removed"] == len(away), r["doc_id"]
        kept, place = [], 0
        for p in spans.pieces(text or ""):
            real = bool(spans.words_of(p))
            if not real or place not in away:
                kept.append(p)
            place += real
        assert r["text"] == (None if text is None else "".join(kept))
        assert sum(b - a for a, b in r["removed"]) == len(text or "") - len("".join(kept))
    assert spans.deduplicated(empty(spark)).collect() == []


def test_passages_of_long_and_of_short_sentences(spark):
    long = " ".join(f"long{k}" for k in range(61)) + "."
    pair = "Nine words stand here in this sentence one two. Nine other words stand in that sentence as well."
    rows = [(1, f"First start. {long} First end."), (2, f"Second start here. {long} Second end."), (3, f"Third one. {pair} Third end of it."), (4, f"Fourth one. {pair} Fourth end of it."), (5, "Hi. Yes. No."), (6, "Hi. Yes. No.")]
    got = {r["doc_id"]: r["text"] for r in spans.without_repeats(frame(spark, rows)).collect()}
    assert got == {**dict(rows), 2: "Second start here. Second end.", 4: "Fourth one. Fourth end of it."}


def test_planted_passages_go_and_clean_documents_stay(spark):
    """Repeated passages of 50 words in documents of their own, on the test table: 95 % go, 97 % of the other documents stay as they are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(1)
    made = lambda n: " ".join(sentence(rng, [f"v{k}" for k in range(5000)], 5, 20) for _ in range(n))
    passages = [made(5) for _ in range(20)]
    planted = [(10**6 + k, f"{made(2)} {passages[k % 20]} {made(2)}") for k in range(60)]
    both = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in spans.without_repeats(both).collect()}
    caught = [passages[k % 20] not in got[10**6 + k] and len(got[10**6 + k]) < len(planted[k][1]) - 0.9 * len(passages[k % 20]) for k in range(20, 60)]
    assert sum(caught) >= 0.95 * len(caught) and all(got[10**6 + k] == planted[k][1] for k in range(20))
    alone = [(2 * 10**6 + k, made(8)) for k in range(100)]
    left = {r["doc_id"]: r["text"] for r in spans.without_repeats(both.unionByName(spark.createDataFrame(alone, "doc_id long, text string"))).collect()}
    assert sum(left[d] == t for d, t in alone) >= 97


# --- lines -------------------------------------------------------------------------------------------------------------


def lines_plain(rows, t=0.8):
    seen, out = [], {}
    for d, text in sorted(((d, t) for d, t in rows if d is not None and t is not None), key=lambda x: x[0]):
        for i, line in enumerate(text.split("\n")):
            w = frozenset(x for x in re.split(r"[ \t-\r]+", line) if x)
            if not w:
                continue
            out[d, i] = any(len(w & o) >= t * len(w | o) - 1e-9 for o in seen)
            seen.append(w)
    return out


def test_lines_equal_all_pairs(spark, monkeypatch):
    rows = [r for r in texts() if r[0] is not None]
    rows += [(400 + k, f"w1 w2 w3 w4 w5 w6 w7 w8 w9 x{k}\nshort line\n\ta\tb  c\r\nq{k} r{k} s{k}") for k in range(30)]
    want = lines_plain(rows)
    for many in (16, 2, 1000):
        monkeypatch.setattr(lines, "MANY", many)
        got = {(r["doc_id"], r["place"]): r["removed"] for r in lines.repeated_lines(frame(spark, rows)).collect()}
        assert got == want
    assert any(want.values())


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.9])
def test_lines_of_other_similarities(spark, monkeypatch, similarity):
    monkeypatch.setattr(lines, "MANY", 5)
    rows = [(k, "\n".join(" ".join(random.Random(f"{k} {i}").sample("aa bb cc dd ee ff".split(), 1 + (k + i) % 6)) for i in range(3))) for k in range(25)]
    rows += [(900, "aa bb cc xx"), (901, "aa bb cc xx yy"), (902, "new1 new2 new3"), (903, "new1 new2 new3 new4")]
    got = {(r["doc_id"], r["place"]): r["removed"] for r in lines.repeated_lines(frame(spark, rows), similarity).collect()}
    assert got == lines_plain(rows, similarity)


def test_lines_of_null_ids_and_of_two_texts_under_one_id(spark):
    rows = [(d, f"a b c d e f g h i j k l{k}\nown{k} words{k} stand{k} here{k}\nm{k} n o p q r s t u v w x y z") for k, d in enumerate([None, None, 7, 7, 8, None])]
    rows.append(rows[-1])
    docs = frame(spark, rows)
    keyed = [(r["doc_id"], r["row"], r["text"]) for r in docs.selectExpr("doc_id", "xxhash64(text) AS row", "text").distinct().collect()]
    order = sorted(keyed, key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    removed = lines_plain([(k, t) for k, (_, _, t) in enumerate(order)])
    want = {(d, row, i): removed[k, i] for k, (d, row, t) in enumerate(order) for i in range(3)}
    got = {(r["doc_id"], r["row"], r["place"]): r["removed"] for r in lines.repeated_lines(docs).collect()}
    assert got == want and sum(got.values()) == 10
    kept = Counter((r["doc_id"], r["text"]) for r in lines.without_lines(docs).collect())
    times = Counter(rows)
    assert kept == Counter({(d, "\n".join(x for i, x in enumerate(t.split("\n")) if not removed[k, i])): times[d, t] for k, (d, _, t) in enumerate(order)})
    report = Counter((r["doc_id"], r["n_lines"], r["n_removed"]) for r in lines.line_report(docs).collect())
    assert report == Counter((d, 3, sum(removed[k, i] for i in range(3))) for k, (d, _, _) in enumerate(order))


def test_without_lines_rebuilds_texts(spark):
    rows = [r for r in texts() if r[0] is not None]
    removed = lines_plain(rows)
    docs = frame(spark, rows, clashes=True)
    left = lines.without_lines(docs)
    assert left.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    for d, t in rows:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not removed.get((d, i)))
        if t is not None and kept != t and not kept.strip(" \t\n\x0b\f\r"):
            assert d not in got
        else:
            assert got[d] == kept, d
    assert 201 not in got and 203 in got
    assert lines.line_report(empty(spark)).collect() == []


def test_rarity_counts_the_words_of_all_documents(spark):
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("same\nsame").alias("text"))
    at = docs.limit(1).select(lines.bucket(F.xxhash64(F.lit("same"))).alias("b")).first()["b"]
    levels = lines.rarity(docs).first()["levels"]
    assert levels[at] == math.floor(4 * math.log2(1 + 24_000)) and sum(1 for x in levels if x) == 1


def test_a_group_of_near_copies_meets_its_first_lines_only(spark, monkeypatch):
    """Pairs of lines to compare stay in proportion to a group of near copies; every copy but the first goes."""
    monkeypatch.setattr(lines, "MANY", 4)
    met = []
    kept = lines._verified
    monkeypatch.setattr(lines, "_verified", lambda near, docs, t: (met.append(near.count()), kept(near, docs, t))[1])
    rows = [(k, f"w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 x{k}") for k in range(90)]
    got = {r["doc_id"]: r["removed"] for r in lines.repeated_lines(frame(spark, rows)).collect()}
    assert got == {k: k > 0 for k in range(90)} and sum(met) <= 3 * len(rows)


def test_a_pair_of_lines_comes_out_under_one_of_its_marks(spark, monkeypatch):
    """Lines just too far from a group of near copies meet its lines once, however many marks they share."""
    met = []
    kept = lines.written
    monkeypatch.setattr(lines, "written", lambda df, label: (out := kept(df, label), met.extend((r["a"], r["b"]) for r in out.collect()) if label == "line-met" and out.columns == ["a", "b"] else None)[0])
    other = lambda new: " ".join(new.get(i, f"w{i}") for i in range(20))
    rows = [(k, other({k % 10: f"x{k}"})) for k in range(60)]
    rows += [(100 + 10 * i + j, other({10 + i: f"y{i}{j}", 10 + j: f"z{i}{j}"})) for j in range(10) for i in range(j)]
    got = {(r["doc_id"], r["place"]): r["removed"] for r in lines.repeated_lines(frame(spark, rows)).collect()}
    assert got == lines_plain(rows) and sum(got.values()) == 59
    assert len(met) > 100 and len(set(met)) == len(met)


def test_lines_of_frequent_words_share_few_marks(spark):
    """Lines without a rare word share words of their prefixes with many others, but marks of several words with few; near copies share one."""
    rng = random.Random(5)
    sets = [rng.sample([f"w{i}" for i in range(400)], 24) for _ in range(300)]
    rows = [(k, " ".join(w)) for k, w in enumerate(sets)] + [(1000 + k, " ".join([*w[1:], f"other{k}"])) for k, w in enumerate(sets)]
    docs = frame(spark, rows)
    marks = {r["doc_id"]: set(r["marks"]) for r in lines.line_sets(docs, lines.rarity(docs), 0.8).collect()}
    assert all(marks[k] & marks[1000 + k] for k in range(300))
    assert sum(bool(marks[a] & marks[b]) for b in range(300) for a in range(b)) <= 0.03 * 300 * 299 / 2


def test_words_are_not_counted_and_small_groups_meet_in_one_round(spark, monkeypatch):
    """Near copies in small groups need no first round and no counts of words; counts given by the caller change no result."""
    rows = [(k, f"{' '.join(f'g{k // 3}w{i}' for i in range(12))} own{k}\n" + " ".join(f"u{k}v{i}" for i in range(8))) for k in range(60)]
    docs, want = frame(spark, rows), lines_plain(rows)
    levels = lines.rarity(docs)
    assert {(r["doc_id"], r["place"]): r["removed"] for r in lines.repeated_lines(docs, levels=levels).collect()} == want
    rounds, kept = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda near, docs, t: (rounds.append(near.count()), kept(near, docs, t))[1])
    monkeypatch.setattr(lines, "rarity", None)
    got = {(r["doc_id"], r["place"]): r["removed"] for r in lines.repeated_lines(docs).collect()}
    assert got == want and sum(got.values()) == 40 and rounds == [0, 60]


# --- personal data -----------------------------------------------------------------------------------------------------


def pii_plain(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            figures = [int(x) for x in re.sub(r"[^0-9]", "", m[0])]
            doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(figures))]
            if k == 1 and max(map(int, m[0].split("."))) > 255 or k == 2 and not (14 <= len(figures) <= 19 and sum(doubled) % 10 == 0) or k == 3 and not 10 <= len(figures) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_equal_plain_and_stay(spark):
    odd = [
        "a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 +1 (988) 555-2485. x@y.z+q@w.e.r", "\U0001f600 +49 30 12345678 1234567890123456789012 a",
        "7" * 30000 + " " + "a" * 30000 + "@" + "b." * 9000 + "c", "1@2.3@4.5.6.7 +1+2 +123456789012-", "00255.001.0.1 256.1.1.1 1.1.1.1111", "none here, version 3.0 of 2024",
    ]
    rows = texts() + [(500 + k, t) for k, t in enumerate(odd)]
    got = pii.pii_report(frame(spark, rows, clashes=True)).collect()
    assert len(got) == len(rows)
    source = {d: t for d, t in rows if d is not None}
    for r in got:
        if r["doc_id"] is not None:
            want = pii_plain(source[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), r["doc_id"]
            assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
            assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [want.count(f"{k}:") for k in pii.KINDS[:4]]
    assert pii.pii_report(empty(spark)).collect() == []


def test_classifier_adds_keys_it_has_not_seen(spark):
    rows = []
    for k in range(120):
        key = hashlib.sha256(str(k).encode()).hexdigest()
        rows.append((k, f"plain words {k} then token = \"{key[:40]}\" and mail user{k}@mail.example.com or 4{k:03d}123 items-{k}-of-many-plain-things"))
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(frame(spark, rows)).collect()}
    assert sum("secret:" in s for s in got.values()) >= 110
    clean = frame(spark, rows).where("doc_id < 3")
    left = {r["doc_id"]: r["text"] for r in pii.redacted(frame(spark, rows + [(900, None)])).collect()}
    assert "[email]" in left[0] and "@" not in left[0] and left[900] is None
    assert pii.pii_report(clean).count() == 3


def card_number(k):
    head = f"4{k * 7919 % 10**14:014d}"
    total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(int(x) for x in reversed(head)))
    return head + str(-total % 10)


def test_every_generator_adds_spans(spark):
    """Formats without any base span, as frequent as those with one, are added; such that fail a check are not."""
    rows, want, wrong = [], {}, {}
    for k in range(240):
        card, key = card_number(k), hashlib.sha256(str(k).encode()).hexdigest()
        four = [card[i : i + 4] for i in range(0, 16, 4)]
        area, last = f"{200 + k * 37 % 700}", f"{1000 + k * 53 % 9000}"
        rows.append((3 * k, f"write to user{k}@mail.example.com or call +1 {area}-555-{last} and pay by {' '.join(four)} with AKIA{key[:16].upper()} or {key[:40]} now"))
        secret = "".join(c.upper() if i % 3 else c for i, c in enumerate(key[20:52]))
        parts = [f"name{k} (at) host{k} (dot) org", f"{area}-555-{last}", ".".join(four), secret + "Zx9" * 80, f"password: hunter{k}xyz{'q' * 250}"]
        rows.append((3 * k + 1, f"write to {parts[0]} or call {parts[1]} and pay by {parts[2]} with {parts[3]} or {parts[4]} now"))
        bad = [f"look{k} @ noon. Then", f"{area}-555-{last[:3]}", ".".join([*four[:3], four[3][:3] + str((int(four[3][3]) + 1) % 10)]), f"plain-{k}-words-of-many-things"]
        rows.append((3 * k + 2, f"write to {bad[0]} or number {bad[1]} and part {bad[2]} with {bad[3]} now"))
        want[3 * k + 1], wrong[3 * k + 2] = parts, bad
    source = dict(rows)
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(frame(spark, rows)).collect()}
    added = Counter()
    for d, parts in want.items():
        for k, part in enumerate(parts):
            at = source[d].index(part)
            added[k] += f"{pii.GENERATORS[k][0]}:{at}:{at + len(part)}" in got[d].split(",")
    assert all(added[k] >= 0.95 * len(want) for k in range(5)), added
    assert sum(got[d] != "" for d in wrong) <= 0.02 * len(wrong)


def test_the_classifier_learns_from_all_examples(spark):
    """More candidates than the old sample held: all of them are examples, and a label of many weighs as ``BALANCE`` of them."""
    words = spark.range(5_000).select(F.lit(3).alias("generator"), F.concat(F.lit("plain-"), F.lpad(F.col("id").cast("string"), 12, "0"), F.lit("-words")).alias("value"), F.lit("").alias("before"), F.lit("").alias("after"))
    mails = spark.range(3_000).select(F.lit(0).alias("kind"), F.concat(F.lit("name"), F.col("id").cast("string"), F.lit("@example.org")).alias("value"), F.lit("mail ").alias("before"), F.lit(" end").alias("after"))
    got = {(r["generator"], r["confirmed"]): (r["n"], r["w"]) for r in pii.examples(words, mails).groupBy("generator", "confirmed").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    assert got[3, False][0] == 5_000 and got[0, True][0] >= 3 * 3_000
    assert got[3, False][1] == pytest.approx(pii.BALANCE) and got[0, True][1] == pytest.approx(pii.BALANCE)


# --- bytes -------------------------------------------------------------------------------------------------------------


def test_byte_spans_equal_plain(spark, monkeypatch):
    import random

    rng = random.Random(5)
    z = "".join(rng.choice("abcdefgh") for _ in range(400))
    odd = ["a" * 500, "ab" * 150, z, "x" * 40 + z[100:301] + "y", z[:199] + "Q", "é" * 150, "b" * 199, "the " * 60, z[150:350], "é" * 99 + "z"]
    rows = [r for r in texts() if r[0] not in (None, 208)] + [(600 + k, t) for k, t in enumerate(odd)]
    data = {d: (t or "").encode() for d, t in rows}
    count = Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    for many in (2000, 3):
        monkeypatch.setattr(suffix, "MANY", many)
        got = {r["doc_id"]: r for r in suffix.removal_digests(frame(spark, rows, clashes=True)).collect()}
        for d, b in data.items():
            gone = bytearray(len(b))
            for i in range(len(b) - 199):
                if count[b[i : i + 200]] > 1:
                    gone[i : i + 200] = b"\1" * 200
            kept = bytes(x for x, g in zip(b, gone) if not g)
            n_runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
            r = got[d]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), n_runs, hashlib.sha256(kept).hexdigest()), d
    assert suffix.removal_digests(empty(spark)).collect() == []


# --- decontamination ---------------------------------------------------------------------------------------------------

ITEMS = "item_id long, text string"


def test_leaks_are_found_and_clean_texts_are_not(spark, monkeypatch):
    import random

    rng = random.Random(9)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, f"{say(rng.randint(8, 25))}. {say(rng.randint(5, 12))}.") for k in range(60)] + [(60, None), (61, ""), (62, say(9))]
    rows, want = [], set()
    for d in range(80):
        text = say(rng.randint(5, 400))
        if d % 4 == 0:
            item, leaked = items[rng.randrange(60)]
            at = rng.randint(0, len(text.split()))
            parts = text.split()
            text = " ".join([*parts[:at], leaked.upper() if d % 8 else leaked, *parts[at:]])
            want.add((d, item))
        rows.append((d, text))
    rows += [(90, None), (91, ""), (None, items[5][1])]
    table = spark.createDataFrame(items, ITEMS)
    for size in (16_000_000, 2_000):  # one index, and several
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
        got = decontaminate.contaminated(frame(spark, rows, clashes=True), table).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want | {(None, 5)}
    assert decontaminate.contaminated(empty(spark), table).collect() == []
    assert decontaminate.contaminated(frame(spark), spark.createDataFrame([], ITEMS)).collect() == []


def test_items_under_one_id_and_without_one(spark):
    words = [[f"{a}{k}" for k in range(30)] for a in ("p", "q", "r")]
    items = spark.createDataFrame([(5, " ".join(words[0]) + "."), (5, " ".join(words[1]) + "."), (None, " ".join(words[2]) + "."), (None, None)], "item_id long, text string")
    docs = frame(spark, [(k, f"before it {' '.join(w)} and after it") for k, w in enumerate(words)] + [(None, "x " + " ".join(words[1])), (3, "clean of all of them"), (1, "a clean text under an id that leaks"), (4, None)])
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(0, 5), (1, 5), (None, 5), (2, None)}
    left = decontaminate.without_items(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["text"] or "" for r in left.collect()) == ["", "a clean text under an id that leaks", "clean of all of them"]
    assert decontaminate.without_items(docs, items.limit(0)).count() == docs.count()


def test_pivot_search_equals_full_scores():
    import random

    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for k in range(50)]
    counts = Counter(w for _, t in items for w in set(t.split()))
    index = decontaminate.Index(items, counts, len(items), sum(len(t.split()) for _, t in items) / len(items), 0.6, 5)
    for _ in range(200):
        terms = sorted({index.terms[w] for w in rng.sample(words, rng.randint(1, 40)) if w in index.terms})
        score = defaultdict(float)
        for t in terms:
            for i, x in zip(*index.postings[t]):
                score[i] += x
        assert [i for i, _ in index.search(terms)] == sorted(i for i, x in score.items() if x >= 1) if terms else True
