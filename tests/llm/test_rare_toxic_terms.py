"""Toxic terms of a language that holds few of the toxic documents."""

from estatelake.llm import toxicity


def test_terms_of_a_rare_language_are_learnt(spark):
    rows = [(1, f"the house scoundrel {i}") for i in range(400)] + [(0, f"the house {i}") for i in range(400, 2000)]
    rows += [(1, f"la casa bomenteta {i}") for i in range(6)] + [(0, f"la casa {i}") for i in range(60)] + [(1, "la casa once")]
    ordinary, toxic = toxicity._dictionaries(spark.createDataFrame(rows, "toxic int, text string"), 407, 1660, 2000, 8000)
    assert {"scoundrel", "bomenteta"} <= set(toxic.decode().split()) - set(ordinary.decode().split())
    assert "once" not in toxic.decode().replace(ordinary.decode(), "").split()
