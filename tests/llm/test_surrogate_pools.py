"""Titles, domains and formats that run out, against brute force over small corpora."""

import re
import string
import time

import pytest

from estatelake.llm import pii


def rewritten(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.text for r in sorted(pii.with_surrogates(frame, b"k").collect())]


def test_titles_are_no_names(spark):
    text, other, lone = "Prof. Dr. Schmidt sprach. Dr. Weber kam. Schmidt ging.", "Herr Dr. Otto Kurz und Frau Prof. Dr. Ida Kurz.", "Prof. Dr. said Dr. no, Dr. Dr."
    got = rewritten(spark, [text, other, lone])
    a, b = re.fullmatch(r"Prof\. Dr\. (\w+) sprach\. Dr\. (\w+) kam\. \1 ging\.", got[0]).groups()
    assert {a, b}.isdisjoint({"Schmidt", "Weber"}) and a != b
    otto, kurz, ida = re.fullmatch(r"Herr Dr\. (\w+) (\w+) und Frau Prof\. Dr\. (\w+) \2\.", got[1]).groups()
    assert kurz != "Kurz" and otto.endswith(tuple(pii.ENDINGS["latin"]["m"])) and ida.endswith(tuple(pii.ENDINGS["latin"]["f"]))
    assert got[2] == lone


def test_domains_stay_apart_and_short_formats_grow(spark):
    letters = string.ascii_lowercase
    real = [f"{x}@{y}.c" for x in letters for y in letters]
    got = rewritten(spark, [" ".join(real[i : i + 26]) for i in range(0, len(real), 26)])
    mapped = dict(zip(real, " ".join(got).split(" ")))
    assert len(set(mapped.values())) == len(real) == 676 and not set(mapped.values()) & set(real)
    domains = {(a.split("@")[1], b.split("@")[1]) for a, b in mapped.items()}
    assert len(domains) == len({a for a, _ in domains}) == len({b for _, b in domains}) == 26


def test_a_used_up_format_ends_with_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_ATTEMPTS", 3)
    full = spark.createDataFrame([("phone", f"{i}") for i in range(10)], "kind string, norm string")
    with pytest.raises(ValueError, match="phone"):
        pii.settled_attempts(full, b"k")


def test_a_text_full_of_addresses():
    start = time.time()
    assert len(pii.detect(" ".join(f"a{i}@b{i}.org" for i in range(100_000)))) == 100_000
    assert time.time() - start < 20
