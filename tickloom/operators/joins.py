"""Join shapes that Spark has no operator for: as-of and interval joins.

As-of joins are a union and windows within chunks of the key, with a carry from chunk to
chunk, so they take one shuffle and a long key is many tasks.
Interval joins are equi-joins on exploded time buckets with the range as a residual
predicate; no nested loop is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import chunks


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], columns: list[str], forward: bool = False, fallback_last: bool = False, tolerance: float | None = None, span: float = chunks.SECONDS, order: tuple[str, ...] = ()) -> DataFrame:
    """left with the columns of right's latest row at or before ``on`` (forward: the first at or after).

    All columns come from one row of right, nulls included. fallback_last: a forward
    search that finds nothing takes the last row of right. tolerance: the largest
    distance in the units of a numeric ``on``, or in seconds. span: the length of a chunk, in
    the same units. order: columns of right that order its rows of one ``on``; without them
    any of those may be found.
    """
    timed = dict(left.dtypes)[on].startswith("timestamp")
    num = lambda x: F.unix_micros(x) / 1e6 if timed else x
    names = left.columns
    row = F.struct(F.col(on).alias("_on"), *[F.col(o).alias(f"_by_{o}") for o in order], *columns)
    both = left.select(*names, F.lit(None).cast(right.select(row.alias("_r")).schema["_r"].dataType).alias("_r"), F.lit(1 if not forward else 0).alias("_side")).unionByName(
        right.select(*by, on, row.alias("_r"), F.lit(0 if not forward else 1).alias("_side")), allowMissingColumns=True
    )
    ties = [F.col(f"_r._by_{o}") for o in order]
    out = chunks.last_known(both, "_r", "_f", by, on, [F.col(on), F.col("_side"), *ties], F.floor(num(F.col(on)) / span).cast("long"), forward, ties)
    out = out.filter(F.col("_side") == (0 if forward else 1))
    if forward and fallback_last:
        ends = right.groupBy(*by).agg(F.max_by(row, F.when(F.col(on).isNotNull(), F.struct(on, *order))).alias("_end"))
        out = out.alias("l").join(ends.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by], "left")
        out = out.select("l.*", F.col("r._end")).withColumn("_f", F.coalesce("_f", "_end"))
    if tolerance is not None:
        out = out.withColumn("_f", F.when(F.abs(num(F.col(on)) - num(F.col("_f._on"))) <= tolerance, F.col("_f")))
    return out.select(*names, *[F.col(f"_f.{c}").alias(c) for c in columns])


def interval(events: DataFrame, rows: DataFrame, by: list[str], at: str, start: Column, end: Column, bucket: float, closed: str = "left") -> DataFrame:
    """Pairs of an event and the rows of its key with ``at`` between start and end.

    at is a numeric column of rows (say epoch seconds); start and end are columns of
    events. closed: which ends belong to the interval (left, right, both). The bucket
    should be about as long as an interval, so an event meets a few buckets.
    """
    e = events.withColumn("_s", start).withColumn("_e", end)
    e = e.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bucket), F.floor(F.col("_e") / bucket))))
    r = rows.withColumn("_b", F.floor(F.col(at) / bucket)).withColumn("_at", F.col(at))
    low = F.col("_at") >= F.col("_s") if closed in ("left", "both") else F.col("_at") > F.col("_s")
    high = F.col("_at") <= F.col("_e") if closed in ("right", "both") else F.col("_at") < F.col("_e")
    clash = [c for c in r.columns if c in e.columns and c not in (*by, "_b")]
    for c in clash:
        r = r.withColumnRenamed(c, f"{c}_row")
    return e.join(r, [*by, "_b"]).filter(low & high).drop("_b", "_s", "_e", "_at")


def align(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Index join of two tables of bars; columns of right that left has too get the suffix _right."""
    for c in right.columns:
        if c in left.columns and c not in on:
            right = right.withColumnRenamed(c, f"{c}_right")
    return left.join(right, on, how)


def lookup(rows: DataFrame, values: DataFrame, on: list[str], column: str, default) -> DataFrame:
    """rows with a column of values by exact key, or the default."""
    return rows.join(values.select(*on, column), on, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def keep_days(rows: DataFrame, days: DataFrame, on: list[str], drop: bool = False) -> DataFrame:
    """Rows whose key is in a list of days, or is not."""
    return rows.join(days, on, "left_anti" if drop else "left_semi")


def expand(rows: DataFrame, grid: list[dict]) -> DataFrame:
    """Every row with every parameter set of a short list, by exploding a literal array: no join."""
    sets = F.array(*[F.struct(F.lit(i).alias("config_id"), *[F.lit(v).alias(k) for k, v in g.items()]) for i, g in enumerate(grid)])
    return rows.withColumn("_g", F.explode(sets)).select("*", "_g.*").drop("_g")
