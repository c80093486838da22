"""The registered queries against their SQL, and the pipeline stage by stage against brute force."""

import pytest
from compare import connect, differences

import corpus_pipeline
import llm.brute as brute
from estatelake.llm.common import stored, table
from estatelake.llm.queries import QUERIES, SQL

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark):
    assert differences(QUERIES[name](spark, PATH), connect(PATH), SQL[name]) == []


def test_all_thirteen_are_registered():
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 14)] == [1] * 13
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline_stages_equal_brute_force(spark):
    docs = table(spark, PATH, "documents")
    steps = [(docs.columns, {r.doc_id: r.text for r in docs.collect()})]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, PATH))
        steps.append((docs.columns, {r.doc_id: r.text for r in docs.collect()}))
    raw, clean, lines, single, decontaminated, last = (texts for _, texts in steps)
    assert all(columns == steps[0][0] for columns, _ in steps[:-1])
    assert clean.items() <= raw.items()
    deduped = dict(brute.dedup(list(clean.items()), whole=True))
    emptied = {k for k in clean if deduped[k] != clean[k] and not deduped[k].strip()}
    assert lines == {k: t for k, t in deduped.items() if k not in emptied}
    assert single == {k: lines[k] for k, c, _ in brute.links(list(lines.items())) if k == c}
    items = [(r.item_id, r.text) for r in table(spark, PATH, "benchmark").collect()]
    assert decontaminated == {k: single[k] for k, _, n, _ in brute.hits(list(single.items()), items) if n == 0}
    assert last == decontaminated
