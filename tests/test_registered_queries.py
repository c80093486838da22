"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

from estatelake.registry import load
from estatelake.registry.tables import with_views

PATH = "/root/testdata/sf0.001"
ENTRIES = load()


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.sql))
def test_query_equals_sql(name, spark, con):
    assert differences(ENTRIES[name].run(spark, PATH), con, ENTRIES[name].sql) == []


def test_entry_is_the_first_search_page(spark, con):
    import __spark_entry__

    page = with_views("listing", """SELECT id, price, region, province, building_area, walking_minutes FROM listing
        WHERE section_type = '1-URGENT' AND region = '1' AND price < 30000000 ORDER BY price, id LIMIT 12""")
    rows = __spark_entry__.entry(spark)
    assert differences(rows.drop("cut", "unit_price"), con, page) == []
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
