"""SentencePiece, surrogates, secrets and toxicity on small fixtures, against libraries and brute force."""

import random
import re

import numpy as np
import pytest
import sentencepiece as library
import zstandard
from pyspark.sql import functions as F

from estatelake.llm import pii, secrets, sentencepiece, toxicity
from estatelake.llm.queries import tokenizer_path

EDGE = [None, "", " ", "a", "  a  b ", "▁x", "\x00", "a\nb\tc", "<s> </s> <unk>", "é漢字𠮷", "ab" * 20_000, " " * 500 + "x", "a", "a"]


def test_encoding_and_decoding_equal_the_library(spark):
    model = sentencepiece.load_model(spark, tokenizer_path())
    own = library.SentencePieceProcessor(model_file=tokenizer_path())
    random.seed(1)
    texts = EDGE + ["".join(random.choice(a) for _ in range(random.randint(0, 60))) for a in ("ab e", "the in er", " \n\t▁", "é漢𠮷\x00 a", "();{}\r \n") * 60]
    rows = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "n int, text string, ids int")
    got = {r.n: r for r in sentencepiece.decode(sentencepiece.encode(rows, model), model).collect()}
    for i, t in enumerate(texts):
        ids = own.encode(t or "")
        assert got[i].ids == ids and got[i].decoded == own.decode(ids), repr(t)


def test_decoding_of_any_ids_equals_the_library():
    with open(tokenizer_path(), "rb") as file:
        decoder = sentencepiece.Decoder(sentencepiece.Pieces(file.read()))
    own = library.SentencePieceProcessor(model_file=tokenizer_path())
    random.seed(2)
    for _ in range(2000):
        ids = [random.randint(0, 31_999 if random.random() < 0.5 else 262) for _ in range(random.randint(0, 8))]
        assert decoder.decode(np.array(ids, np.int32)) == own.decode(ids)


def test_empty_tables(spark):
    model = sentencepiece.load_model(spark, tokenizer_path())
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sentencepiece.encode(none, model).count() == 0
    assert pii.with_surrogates(none, b"k").count() == 0
    assert secrets.find_secrets(none).count() == 0
    scored = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.select(toxicity.score(scored)).count() == 0


ADA = "Mail bob.42@mail8.example.com, +1 (724) 555-7058 or +1 724 555 7058, 44.161.181.40, 4944 3394 9042 9605."


def test_surrogates_keep_format_type_and_coreference(spark):
    texts = [
        (1, ADA, "x"), (2, "BOB.42@MAIL8.EXAMPLE.COM and amy@mail8.example.com", "x"), (3, "Dr. Anna Smith met Mr. Smith and John SMITH.", "x"),
        (4, "Version 2.0. of 12, licensed 4.0", "x"), (5, None, "x"), (6, "", "x"), (7, "Иван Петров", "x"), (7, "Иван Петров", "x"),
        (8, "DE89 3704 0044 0532 0130 00 and 123-45-6789", "x"),
    ]
    rows = pii.with_surrogates(spark.createDataFrame(texts, "doc_id int, text string, kinds string"), b"k").collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and got[4].text == texts[3][1] and got[5].text is None and got[6].text == "" and got[5].kinds == []
    parts = re.fullmatch(r"Mail (\w+)\.(\d\d)@(\w+\.\w+\.com), \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4}), ([\d.]+), (\d{4} \d{4} \d{4} \d{4})\.", got[1].text)
    assert parts and parts[4] + parts[5] + parts[6] == parts[7] + parts[8] + parts[9]
    assert pii.luhn(parts[11].replace(" ", "")) == 0 and parts[11][0] == "4"
    assert got[2].text.split(" ")[0] == f"{parts[1]}.{parts[2]}@{parts[3]}".upper() and got[2].text.endswith("@" + parts[3])
    surname = re.fullmatch(r"Dr\. (\w+) (\w+) met Mr\. (\w+) and (\w+) (\w+)\.", got[3].text)
    assert surname[2] == surname[3] and surname[5] == surname[2].upper() and surname[2] != "Smith"
    assert surname[1].endswith(tuple(pii.ENDINGS["latin"]["f"])) and surname[4].endswith(tuple(pii.ENDINGS["latin"]["m"]))
    assert all(pii.script_of(w) == "cyrillic" for w in got[7].text.split(" "))
    assert "3704" not in got[8].text and pii._mod97(got[8].text.split(" and ")[0].replace(" ", "")) == 1
    for r in rows:
        for start, end, kind, norm in pii.detect(dict((a, b) for a, b, _ in texts)[r.doc_id] or ""):
            assert norm not in (r.text or "").lower()


def test_surrogates_never_collide(spark):
    names = [(f"surname-greek", f"ν{i}") for i in range(3000)] + [("phone", f"{i:07d}") for i in range(2000)]
    got = pii.settled_attempts(spark.createDataFrame(names, "kind string, norm string"), b"k").collect()
    assert len(got) == 5000 == len({(r.kind, r.surrogate) for r in got}) and any(r.attempt for r in got)
    assert not {(r.kind, r.surrogate) for r in got} & set(names)


def brute_spans(text):
    found = []
    for i, (kind, pattern, good) in enumerate((
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )):
        found += [(m.start(), i, kind, m.end()) for m in pattern.finditer(text) if good(m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_secret_patterns_equal_brute_force_and_the_battery_adds(spark):
    random.seed(4)
    key = "".join(random.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(44))
    texts = [
        None, "", "é𠮷 Token='abcdef1' x", "secret=token: abcdefgh", "password = short", "AKIA" + "B" * 16 + " AKIAQ", "0123456789abcdef" * 2 + "g" + "f" * 24,
        "token=password=abcdef and api_key : \"x/y-z.w=1\"", f"the value {key} here", "antidisestablishmentarianism pneumonoultramicroscopicsilicovolcanoconiosis",
        "a" * 100_000, "01234567890123456789012345", f"the value {key} here", "https-//example-com/some/quite/long/path/with/words/in/it",
    ]
    rows = [(8 if i == 12 else i, t) for i, t in enumerate(texts)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert len(got) == len(rows)
    pending = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in got]
    for i, t in rows:
        base = brute_spans(t or "")
        match = next(p for p in pending if p[0] == i and [s for s in p[1] if s[0] != "random"] == base)
        assert [t[a:b] for k, a, b in match[1] if k == "random"] == ([key] if t and key in t else [])
        pending.remove(match)


def test_toxicity_separates_planted_words_and_scores_edge_cases(spark):
    random.seed(5)
    common, bad = [f"word{i}" for i in range(60)], ["dreadfulness", "scoundrel", "blockhead"]
    make = lambda toxic: " ".join(random.choice(bad) if toxic and random.random() < 0.06 else random.choice(common) for _ in range(120))
    docs = [(i, make(i % 4 == 0)) for i in range(400)] + [(900, None), (901, ""), (902, "x" * 200_000), (None, "y"), (903, make(False)), (904, make(True))]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 300 or doc_id is null"))
    got = {r.doc_id: r.score for r in frame.select("doc_id", toxicity.score(model).alias("score")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(docs)
    unseen = range(300, 400)
    assert sum((got[i] >= 0.3) == (i % 4 == 0) for i in unseen) >= 98
    assert got[900] == got[901] and got[900] < 0.3 and got[903] < 0.3 <= got[904]
    assert max(len(zstandard.compress(w)) for w in toxicity.windows("a b " * 500)) < 200


def test_toxicity_of_one_class_is_constant(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert frame.select(F.countDistinct(toxicity.score(model))).first()[0] == 1


def test_wrong_models_are_refused():
    with pytest.raises(Exception):
        sentencepiece.Pieces(b"\x0a\x03abc\x12\x02\x18\x01")
