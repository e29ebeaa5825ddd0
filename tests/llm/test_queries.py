import pytest

from lodestrata.llm import queries

from ..oracle import connect, rows

COLUMNS = {
    "p1_found": {"chunk_key_a", "chunk_key_b"},
    "p2_found": {"tbl", "key_a", "key_b"},
    "p3_found": {"tbl", "record_key", "kind"},
    "p4_found": {"artifact_id", "line_no"},
    "p5_found": {"tbl", "record_key", "start_char", "kind"},
    "p6_ids": {"doc_id", "ids"},
    "p8_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_and_gives_its_columns(spark, sf, name):
    got = queries.queries()[name](spark, sf).toPandas()
    assert len(got) or name in ("p1_found", "p1_nearest", "p8_limits")
    if name in COLUMNS:
        assert set(got.columns) == COLUMNS[name]
    if name in queries.oracle_sql():
        assert rows(got) == rows(connect(sf).execute(queries.oracle_sql()[name]).df())


def test_found_pairs_are_ordered(spark, sf):
    assert queries.p1_found(spark, sf).where("chunk_key_a >= chunk_key_b").count() == 0
    assert queries.p2_found(spark, sf).where("key_a >= key_b").count() == 0
