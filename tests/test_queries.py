import pytest

from lodestrata.queries import QUERIES, SQL

from .oracle import connect, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        assert rows(got) == rows(connect(sf).execute(SQL[name]).df())
