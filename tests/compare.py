"""Compare a Spark result with DuckDB on the same tables, whatever the order of rows and columns."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.execute(sql).fetchdf()


def plain(x):
    if x is None or str(x) in ("nan", "<NA>", "NaT", "None"):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if type(x).__name__.startswith(("float", "Decimal")):
        return round(float(x), 6)
    return int(x) if hasattr(x, "__index__") else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(spark_frame, duck_frame):
    assert sorted(spark_frame.columns) == sorted(duck_frame.columns)
    assert rows(spark_frame) == rows(duck_frame)
