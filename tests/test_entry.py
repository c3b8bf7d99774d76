import pytest

import __spark_entry__ as entry

from conftest import SF_DIR


def test_every_query_has_sql():
    own = set(entry.queries()) - set(entry.LLM_REGISTRY)
    assert own - set(entry.oracle_sql()) == set()
    assert set(entry.oracle_sql()) <= set(entry.queries())


# One per area; ``tools/check_oracle.py`` compares all of them.
SAMPLE = [
    "prepare_articles", "csv_scan", "latest_page_deep", "keyword_page_envelope",
    "keyword_words", "display_items", "knn_exact", "knn_lsh", "index_audit",
    "incremental_build", "semantic_search_lexical", "search_list_envelopes",
]


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_sql(spark, key):
    import duckdb

    from tools.check_oracle import TABLES, compare

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    assert not compare(spark, con, key, SF_DIR).startswith("FAIL")
