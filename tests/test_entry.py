"""Driver contract of ``__spark_entry__``."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["chat_id", "seg_id", "n_messages", "prompt"]
    assert df.count() > 0


def test_every_query_has_sql_or_is_known_rows_only():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert set(E.QUERIES) == set(E.ORACLE_SQL)
