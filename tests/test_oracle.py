"""Every registered engine query that SQL can express gives DuckDB's rows; the others run."""

import math

import pytest

from tests.compare import duck, same

from tickloom import queries as engine
from tickloom import oracles, queries_live, queries_models, queries_more  # noqa: F401


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    same(engine.QUERIES[name](spark, sf).toPandas(), duck(sf, engine.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLE_SQL)))
def test_values_are_finite(spark, sf, name):
    """What SQL can't say: machines, adaptive filters, compositions of queries that have SQL. Missing is NULL, never NaN."""
    df = engine.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    for row in df.collect():
        assert all(math.isfinite(v) for v in row if isinstance(v, float)), row


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_trade_exits_of_tied_and_missing_trades(spark, tmp_path):
    """Every trade of the time of an entry is a fill, as in SQL; an exit without a price takes the tape's last one; rows without a symbol or time are none."""
    import duckdb

    rows = [  # seconds, user, value, k; more than 94 is an entry
        (0, 3, 10.0, 97), (0, 13, 20.0, 3), (0, 3, 30.0, 99), (7200, 3, None, 1), (8000, 3, None, 98), (15300, 3, 40.0, 1),
        (20000, 3, 50.0, 96), (30000, 3, 60.0, 1), (30000, 3, 61.0, 1), (40000, 3, None, 1),
        (0, None, 10.0, 97), (None, 3, 10.0, 97), (0, 4, None, 97), (0, 5, 10.0, 94),
    ]
    values = ", ".join(f"({i}, {'NULL' if at is None else f'make_timestamp({(1704067200 + at) * 10**6})'}, {user or 'NULL'}, {'NULL' if v is None else v}, {k})" for i, (at, user, v, k) in enumerate(rows))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE TABLE events AS SELECT i::BIGINT AS event_id, ts::TIMESTAMP AS ts, u::BIGINT AS user_id, 'click' AS event_type, v::DOUBLE AS value, '{{\"k\": ' || k || '}}' AS props FROM (VALUES {values}) t(i, ts, u, v, k)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = engine.QUERIES["sim_trade_exits"](spark, str(tmp_path)).toPandas()
    assert sorted(got["event_id"]) == [0] * 3 + [2] * 3 + [4, 6, 12]
    same(got, con.execute(engine.ORACLE_SQL["sim_trade_exits"]).fetchdf())
