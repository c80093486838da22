"""Line dedup, n-gram join, decontamination, top-k search, URL filter and chat formatting against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import llm.brute as brute
from estatelake.llm import chat, decontamination, line_dedup, mtree, ngram_jaccard, urls
from estatelake.llm.components import components

random.seed(11)
VOCABULARY = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 9))) for _ in range(300)]


def sentence(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def changed(text, n=1):
    words = text.split(" ")
    for _ in range(n):
        words[random.randrange(len(words))] = random.choice(VOCABULARY)
    return " ".join(words)


def test_components_of_paths_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 200), (200, 300), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(60)} | {200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup_equals_brute_force(spark):
    hot = sentence(40)
    near = [changed(hot) for _ in range(180)]  # more than a chunk of near lines
    docs = [(i, "\n".join([sentence(12), hot if i % 3 else near[i], "Short.", sentence(30)])) for i in range(180)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, docs[0][1]), (504, " ".join(VOCABULARY * 300)), (505, hot.upper() + "\n" + hot + " ")]
    frame = spark.createDataFrame([(k, t, "a", 1) for k, t in docs], "doc_id long, text string, content string, n_lines int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame).collect()}
    assert {k: r.text for k, r in got.items()} == dict(brute.dedup(docs))
    assert got[505].emptied and not got[501].emptied and got[500].n_lines == 0 and got[0].content == "a"
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_simhash_counts_long_lines_in_stretches(spark):
    texts = ["a b a", sentence(127), sentence(128), sentence(1000), "x " * 70_000 + "y", " ".join(f"w{i}" for i in range(40_000))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, norm string")
    assert {r.k: r.hash % 2**64 for r in line_dedup.simhash(rows, ["k"]).collect()} == {i: brute.sim_hash(t) for i, t in enumerate(texts)}


def test_ngram_join_equals_brute_force(spark):
    base = [sentence(120) for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(base)] + [(100 + i, changed(base[0], i % 4)) for i in range(90)]
    docs += [(300 + i, base[1].upper() + "!") for i in range(5)] + [(400, None), (401, ""), (402, "..."), (403, "two words"), (404, "Two words."), (None, base[2])]
    docs += [(405, base[3]), (405, base[3]), (406, sentence(20_000)), (407, "...")]
    got = ngram_jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.class_id, r.links) for r in got) == order(brute.links(docs))
    kept = [r.class_id for r in got if r.keep and r.class_id is not None]
    assert len(kept) == len(set(kept)) and {r.class_id for r in got} - {None} == set(kept)
    assert ngram_jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bayesian_pruning_keeps_what_reaches_the_threshold():
    least = ngram_jaccard.least_matches(0.8, 1e-6)
    assert len(least) == 8 and all(a < b for a, b in zip(least, least[1:])) and least[0] < 10 and 60 < least[-1] < 0.8 * 128


ITEMS = [(1, sentence(30)), (2, "one two three"), (3, sentence(10)), (4, None), (5, "..."), (6, "the " * 12), (7, sentence(25)), (7, sentence(11))]


def test_decontamination_equals_brute_force(spark):
    words = [t.split() for _, t in ITEMS if t]
    docs = [(i, sentence(60)) for i in range(30)]
    docs += [(50 + i, f"{sentence(5)} {' '.join(words[0][i : i + 8 + i])}, {sentence(7)}".upper()) for i in range(12)]
    docs += [(80, "one, two; THREE one two three"), (81, "the " * 40), (82, None), (83, ""), (84, ITEMS[2][1]), (84, ITEMS[2][1]), (85, "É " + ITEMS[6][1] + " " + ITEMS[7][1])]
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.contamination(frame, items).collect()
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == order(brute.hits(docs, ITEMS))
    for empty in ((frame.limit(0), items), (frame, items.limit(0))):
        assert decontamination.contamination(*empty).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = decontamination.tokenised(spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha " + "x " * 50 + "beta"), (3, "beta alpha")], "doc_id long, text string"), "text", "doc_id")
    items = decontamination.tokenised(spark.createDataFrame([(9, "alpha beta")], "item_id long, text string"), "text", "item_id")
    near = decontamination.proximity_hits(docs, items, within=5).join(docs, "row")
    assert sorted(r.doc_id for r in near.collect()) == [1, 3]


def test_top_k_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=8).tolist() for _ in range(900)] + [[0.5] * 8] * 700 + [[1.0] * 3, [2.0] * 3]
    rows = [(i, v) for i, v in enumerate(vectors)]
    bad = [(5000, None), (5050, [float("nan")] * 8), (5100, [float("inf")] * 8), (5150, [None] * 8), (5200, []), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("id"), mtree.quantised(F.col("embedding")).alias("vector")
    )
    frame.write.mode("overwrite").parquet(path := spark.conf.get("spark.checkpoint.dir") + "/vectors")
    frame = spark.read.parquet(path)
    got = mtree.top_k(frame, frame.where("id % 50 = 0"), objects=16, block=7)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    ints = [np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for v in vectors]
    for q in range(0, len(vectors), 50):
        scores = sorted((-int(ints[q] @ v), i) for i, v in enumerate(ints) if i != q and len(v) == len(ints[q]))[:5]
        assert sorted(found[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert set(found) == set(range(0, len(vectors), 50))
    assert mtree.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_url_verdicts(spark):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("a.org/x.html", "block"), (None, "block"), ("com/", "allow")]
    cases = {
        "http://a.example.com/en/1": ("example.com/en/", "block"), "http://www.EXAMPLE.com/en/1?x": ("www.example.com/en/", "allow"),
        "http://example.com/de/": ("com/", "allow"), "http://example.com": (None, "allow"), "https://x.net/es/y#z": ("net/es/", "block"),
        "https://x.net/est": (None, "allow"), "http://a.org/x.html?q=1": ("a.org/x.html", "block"), "http://b.a.org/x.html2": (None, "allow"),
        "no scheme": (None, "allow"), "http://notexample.com/en/": ("com/", "allow"), None: (None, "allow"), "": (None, "allow"),
    }
    pages = spark.createDataFrame([(u, "old") for u in [*cases, "http://example.com/de/"]], "url string, verdict string")
    got = urls.url_verdicts(pages, spark.createDataFrame(rules, "entry string, verdict string"))
    assert got.count() == len(cases) + 1 and {r.url: (r.rule, r.verdict) for r in got.collect()} == cases
    nothing = spark.createDataFrame([], "entry string, verdict string")
    assert {r.verdict for r in urls.url_verdicts(pages, nothing, broadcast_entries=-1).collect()} == {"allow"}


def test_url_verdicts_with_clashing_columns(spark):
    pages = spark.createDataFrame([("http://a.com/x", 1, "b", "e", 2, "r")], "url string, best int, entry string, shape string, block int, rule string")
    listed = spark.createDataFrame([("com/", "block")], "entry string, verdict string")
    got = urls.url_verdicts(pages, listed).collect()
    assert [(r.best, r.entry, r.shape, r.block, r.rule, r.verdict) for r in got] == [(1, "b", "e", 2, "com/", "block")]


def test_bloom_filter_loses_no_entry_and_passes_few_others(spark):
    listed = spark.range(2000).select(F.concat(F.lit("e"), "id").alias("entry"))
    probes = spark.range(20_000).select(F.concat(F.lit("e"), "id").alias("entry"))
    passed = urls.possible(probes, urls.bloom_filter(listed, 125), 125)
    assert passed.join(listed, "entry").count() == 2000 and passed.count() < 2400


TURNS = [("system", "Be brief."), ("user", "hi </s>"), ("assistant", "[INST] \\ <\\s> [/INST]\n"), ("tool", "x [/TEXT] <s>"), ("user", ""), ("assistant", "")]


def record(value):
    return json.dumps(value)


def test_layouts_become_turns(spark):
    cases = [
        ({"messages": [{"role": r, "content": t} for r, t in TURNS], "id": 4}, "messages", TURNS),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "conversations", [("user", "q"), ("assistant", "")]),
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"system": "s", "prompt": "p", "response": "r"}, "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction_input_output", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o", "meta": {"a": 1}}, "instruction_input_output", [("user", "i\n\nn"), ("assistant", "o")]),
        ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
        ({"something": 1}, None, []),
    ]
    rows = [(i, record(c[0]), "old") for i, c in enumerate(cases)] + [(90, None, "old"), (91, "", "old"), (92, "{broken", "old")]
    got = {r.n: r for r in chat.canonical_turns(spark.createDataFrame(rows, "n int, record string, layout string")).collect()}
    for i, (_, layout, turns) in enumerate(cases):
        assert (got[i].layout, [(t.role, t.text) for t in got[i].turns]) == (layout, turns)
    assert all(got[n].layout is None and got[n].turns == [] for n in (90, 91, 92))


@pytest.mark.parametrize("turns", [TURNS, [], TURNS * 50, [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")], [("a[TEXT]b", "<"), ("", "\\" * 9 + "</s>")]])
def test_formatting_can_be_read_back(spark, turns):
    rows = spark.createDataFrame([(turns,)], "turns array<struct<role:string,text:string>>")
    out = chat.format_turns(rows).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("lost", chat.loss_text(F.col("formatted"), F.col("loss"))).first()
    assert [(t.role, t.text) for t in out.back] == turns
    assert out.lost == "".join(t for r, t in turns if r == "assistant")
    assert [chat_text(out.formatted[s.start : s.end]) for s in out.loss] == [t for r, t in turns if r == "assistant"]


def chat_text(text):
    import re

    return re.sub(chat._INNER.replace(r"(\\*)", r"\\(\\*)"), r"\1\2\3", text)


def test_rows_become_records_in_order(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "a"), (2, None, None, "x"), (None, 1, "user", "n")]
    got = chat.canonical_turns(chat.records_of_rows(spark.createDataFrame(rows, "c int, turn int, role string, text string"), "c", "turn")).collect()
    turns = {r.c: [(t.role, t.text) for t in r.turns] for r in got}
    assert turns == {1: [("user", ""), ("assistant", "a"), ("assistant", "b")], 2: [("", "x")], None: [("user", "n")]}
