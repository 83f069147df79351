import os

import pytest
from helpers import duck, plain

from scriptorium.plans import catalogue

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
#: Queries whose answer may be empty on small tables.
MAYBE_EMPTY = {"cron_due"}


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    want = duck(FOLDER).sql(catalogue.SQL[name]).df()
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want) and (len(want) or name in MAYBE_EMPTY)


def test_every_query_has_sql_but_sequential_ones():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"louvain_communities"}
