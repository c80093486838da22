"""Hard negatives, source mixing and the Merkle manifest against brute force, with odd rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from estatelake.llm import hard_negatives, merkle, mixing


def brute_negatives(rows, asked, positives=5, negatives=3, low=50, high=95):
    good = [r for r in rows if None not in r and None not in r[3]]
    found = []
    for row, id_, label, vector in good:
        if not asked(id_):
            continue
        others = sorted((-sum(a * b for a, b in zip(vector, v)), i, lab, r) for r, i, lab, v in good if r != row)
        for score, positive, _, _ in [o for o in others if o[2] == label][:positives]:
            near = [o for o in others if o[2] != label and low * -score <= 100 * -o[0] <= high * -score]
            found += [(row, id_, positive, k + 1, o[1], -score, -o[0]) for k, o in enumerate(near[:negatives])]
    return sorted(found)


VECTORS = "row long, id long, label long, vector array<long>, key string, deal int, n int"


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rng = random.Random(4)
    rows = [(i, i, rng.randint(0, 3), [rng.randint(-3, 9) for _ in range(4)]) for i in range(300)]
    rows += [(300 + i, i, 1, [2, 2, 2, 2]) for i in range(40)]  # ties and repeated ids
    rows += [(400, 410, None, [1] * 4), (401, 411, 1, None), (402, 412, 1, [1, None, 1, 1]), (403, None, 1, [1] * 4)]
    rows += [(404, 420, 1, []), (405, 421, 2, [5]), (406, 422, 2, [4] * 9), (407, 423, 9, [8] * 4)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    asked = lambda id_: id_ % 10 == 0 or id_ > 400
    found = hard_negatives.mine(frame, (F.col("id") % 10 == 0) | (F.col("id") > 400))
    got = sorted(map(tuple, found.collect()))
    assert got and got == brute_negatives(rows, asked)
    assert found.schema == hard_negatives.mine(frame.limit(0), F.lit(True)).schema
    assert hard_negatives.mine(frame, F.lit(False)).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, i, i % 2, [rng.randint(-(2**29), 2**29) for _ in range(3)]) for i in range(60)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    got = sorted(map(tuple, hard_negatives.mine(frame, F.col("id") < 9).collect()))
    assert got and got == brute_negatives(rows, lambda i: i < 9)
    huge = spark.createDataFrame([(i, i, i % 2, [2**62] * 3, "x", 1, 2) for i in range(4)], VECTORS)
    assert hard_negatives.mine(huge, F.lit(True)).count() == 0


def test_keys_sort_by_anchor_score_kind_and_id():
    rng = random.Random(6)
    pairs = [(rng.randint(-5, 5), rng.choice([-(2**63) + 1, -1, 0, 7, 2**63 - 1]), rng.random() < 0.5, rng.choice([-(2**63), -2, 3])) for _ in range(300)]
    keys = sorted(hard_negatives.packed(*p) for p in pairs)
    assert [hard_negatives.unpacked(k) for k in keys] == sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_positives_are_found_with_hot_labels_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    rows = [(i, i, 0 if i % 3 else 1 + i % 5, [i % 17, i % 5, 3]) for i in range(500)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(5)
    got = sorted(map(tuple, hard_negatives.mine(frame, F.col("id") % 50 == 0).collect()))
    assert got == brute_negatives(rows, lambda i: i % 50 == 0)


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total = {s: weights[i % len(weights)] for i, s in enumerate(names)}, share * sum(sizes.values())
    full = set()
    while True:
        left = sum(w for s, w in weight.items() if s not in full)
        level = (total - sum(most * sizes[s] for s in full)) / left if left else 0
        more = {s for s in names if s not in full and level * weight[s] > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def balanced(sizes, target, most=2):
    """Rates nearest to 1 by bisection."""
    low, high = -50.0, 50.0
    for _ in range(300):
        mid = (low + high) / 2
        if sum(s * min(most, math.exp(min(mid * s, 50))) for s in sizes) > target:
            high = mid
        else:
            low = mid
    return [min(most, math.exp(min(low * s, 50))) for s in sizes]


def mixed(spark, docs):
    frame = spark.createDataFrame([(k, s, n, "old", 1) for k, s, n in docs], "doc_id long, source string, size long, mix string, rank int")
    rows = mixing.mix(frame, "source", "size", "doc_id").collect()
    assert all(r.rank == 1 for r in rows)
    return rows


def test_mix_equals_brute_force(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice(["a", "b", "c", "dé", "e", None]), int(rng.paretovariate(1.1) * 3)) for i in range(1500)]
    docs += [(5000 + i, "hot", 7) for i in range(5000)] + [(9000 + i, "zero", 0) for i in range(3)]
    docs += [(9100, "a", None), (9101, "a", -4), (None, "b", 12), (None, "b", 12), (7, "b", 30), (7, "b", 30)]
    rows = mixed(spark, docs)
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == Counter(docs)
    sizes, of, taken = defaultdict(int), defaultdict(list), defaultdict(int)
    for r in rows:
        n = max(r["size"] or 0, 0)
        sizes[r.source] += n
        of[r.source].append(r)
        taken[r.source] += n * r.mix.copies
        assert r.mix.copies in (math.floor(r.mix.rate), math.ceil(r.mix.rate)) and 0 <= r.mix.copies <= 2
    want = brute_targets(sizes)
    for s, members in of.items():
        assert {r.mix.source_size for r in members} == {sizes[s]} and all(r.mix.target == pytest.approx(want[s]) for r in members)
        assert abs(taken[s] - want[s]) <= max(1, 0.002 * want[s])
        full = [r for r in members if (r["size"] or 0) > 0]
        if full and want[s] < 2 * sizes[s]:
            rates = balanced([r["size"] for r in full], want[s])
            assert [r.mix.rate for r in full] == pytest.approx(rates, abs=1e-4)
    again = mixed(spark, docs)
    assert Counter(map(repr, rows)) == Counter(map(repr, again))


def test_mix_of_odd_tables(spark):
    assert mixed(spark, []) == []
    assert [(r.mix.copies, r.mix.target) for r in mixed(spark, [(1, None, 0)])] == [(1, 0.0)]
    assert {r.doc_id: r.mix.copies for r in mixed(spark, [(1, "a", 10), (2, "b", 1), (3, "c", 9)])}[1] in (1, 2)
    copies = mixing.in_copies(mixing.mix(spark.createDataFrame([(1, "a", 4), (2, "b", 4)], "doc_id long, source string, size long"), "source", "size", "doc_id"))
    assert copies.where("doc_id = 1").count() == 2


def test_words(spark):
    texts = [None, "", " \t\n", "a b", "a b　c d\x1ce", "x" * 100_000 + " y"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", mixing.words(F.col("text")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {0: 0, 1: 0, 2: 0, 3: 2, 4: 2, 5: 2}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(docs, columns):
    """{(key, leaf): (subroot, root, siblings)} of rows given as dicts"""
    def leaf(d):
        return sha("".join("-" if d[c] is None else f"{len(str(d[c]).encode())}:{d[c]}" for c in columns))

    def up(nodes):
        ways = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for w, i in zip(ways, at):
                w += nodes[i // 8 * 8 : i] + nodes[i + 1 : i // 8 * 8 + 8]
            nodes, at = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
        return (nodes[0] if nodes else None), ways

    trees = defaultdict(list)
    for d in docs:
        trees[d["lang"]].append((d["doc_id"] is not None, d["doc_id"] or 0, leaf(d)))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    done = {t: (sorted(trees[t]), *up([x[2] for x in sorted(trees[t])])) for t in names}
    root, tops = up([done[t][1] for t in names])
    return Counter(
        (key if some else None, h, done[t][1], root, "".join(way + tops[i])) for i, t in enumerate(names) for (some, key, h), way in zip(done[t][0], done[t][2])
    ), root


@pytest.mark.parametrize("counts", [{"en": 700, None: 1, "fr": 64, "": 9, "z": 513}, {"en": 1}, {"en": 8}, {None: 73}, {f"l{i:03}": 1 for i in range(70)}])
def test_manifest_equals_brute_force(spark, counts):
    docs, rng = [], random.Random(3)
    for lang, n in counts.items():
        for i in range(n):
            docs.append({"doc_id": rng.choice([None, i, i, i - 900, 5]), "lang": lang, "text": rng.choice([None, "", "é" * i, f"Text {i}", "A"]), "leaf": "x", "tree": i})
    columns = ["doc_id", "lang", "text"]
    frame = spark.createDataFrame([tuple(d.values()) for d in docs], "doc_id long, lang string, text string, leaf string, tree int")
    wrong = F.when(F.col("text") == "A", merkle.leaf([F.col("doc_id"), F.col("lang"), merkle.lowered(F.col("text"))]))
    found = merkle.proofs(merkle.manifest(frame, columns, "lang", "doc_id", wrong=wrong))
    rows = found.select(
        "carried", "leaf", "subroot", "root", merkle.siblings(F.col("proof")).alias("siblings"), merkle.fold(F.col("leaf"), F.col("proof")).alias("folded"),
        merkle.fold(F.col("carried.wrong"), F.col("proof")).alias("other"),
    ).collect()
    want, root = brute_manifest(docs, columns)
    assert Counter((r.carried.key, r.leaf, r.subroot, r.root, r.siblings) for r in rows) == want
    assert all(r.folded == root and r.other != root for r in rows) and any(r.other for r in rows) == any(d["text"] == "A" for d in docs)


def test_manifest_stores_every_third_level_and_takes_empty_tables(spark):
    frame = spark.range(600).selectExpr("id AS doc_id", "'en' AS lang", "'t' AS text")
    found = merkle.manifest(frame, ["doc_id", "text"], "lang", "doc_id")
    assert [level.count() for level in found["leaves"]] == [600, 2, 1] and [level.count() for level in found["subroots"]] == [1]
    assert merkle.proofs(merkle.manifest(frame.limit(0), ["doc_id"], "lang", "doc_id")).count() == 0
