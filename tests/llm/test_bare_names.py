"""Mentions of a person without a title or a given name in front."""

from estatelake.llm import pii


def test_bare_mentions_get_the_same_surrogate(spark):
    texts = [(1, "Mary Jones came. Jones said so, and JONES's friend Mary left; no jones."), (2, "Jones and Mary are unknown here."), (3, "mary.jones@a.org wrote to Mr. Jones, not to Jones-Bell or Joneson. Jones")]
    got = {r.doc_id: r for r in pii.with_surrogates(spark.createDataFrame(texts, "doc_id int, text string"), b"k").collect()}
    given, last = got[1].text.split(" ")[:2]
    assert got[1].text == f"{given} {last} came. {last} said so, and {last.upper()}'s friend {given} left; no jones."
    assert {given, last}.isdisjoint({"Mary", "Jones"}) and got[1].kinds == ["given", "surname", "surname", "surname", "given"]
    assert got[2].text == texts[1][1]
    assert got[3].text.endswith(f" wrote to Mr. {last}, not to Jones-Bell or Joneson. {last}")
