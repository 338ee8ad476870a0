"""Long series in two levels: work within chunks of a key, and a carry from chunk to chunk.

A chunk is a range of the order (a day of time, a million ids), so a symbol with a third of
all rows is as many tasks as it has chunks. Each function summarises the chunks, combines
the summaries of a key in order (one row for each chunk), and joins what a chunk is
handed back to its rows. The summaries are small, and Spark chooses how to join them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from tickloom.windows import Series

#: Seconds of a chunk by time, and ids of a chunk by id.
SECONDS, IDS = 86_400, 1_000_000
KEY = "symbol"
Field = Callable[[str], Column]


def by_time(ts: str = "ts", sec: int = SECONDS) -> Column:
    return F.floor(F.unix_micros(F.col(ts)) / (sec * 1_000_000)).cast("long")


def by_id(seq: str = "seq", ids: int = IDS) -> Column:
    return F.floor(F.col(seq) / ids).cast("long")


def _handed(key: list[str], order: str = "_chunk"):
    """The chunks of a key before this one."""
    return Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _with(rows: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the further columns of told, whose keys may be NULL."""
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return rows.alias("l").join(told.alias("r"), on, "left").select("l.*", *[F.col(f"r.{c}") for c in told.columns if c not in keys])


def numbered(df: DataFrame, name: str, chunk: Column, order: tuple[str, ...] = ("ts", "seq"), key: str = KEY) -> DataFrame:
    """Add each row's number in its series, from 0."""
    rows = df.withColumn("_chunk", chunk)
    sizes = rows.groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
    before = sizes.select(key, "_chunk", F.coalesce(F.sum("_n").over(_handed([key])), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(*order)) - 1
    rows = _with(rows.withColumn(name, local), before, [key, "_chunk"])
    return rows.withColumn(name, (F.col("_before") + F.col(name)).cast("long")).select(*[c for c in df.columns if c != name], name)


def run_ids(df: DataFrame, name: str, goes_on: Callable[[Field, Field], Column], fields: list[str], chunk: Column, order: tuple[str, ...] = ("ts", "seq"), key: str = KEY) -> DataFrame:
    """Add the number, from 1, of the run that a row belongs to.

    goes_on(before, now) tells from the named fields of two rows in succession whether the
    second continues the run; NULL means no.
    """
    s = Series(key=(key, "_chunk"), order=order)
    holds = lambda c: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)
    inner = holds(goes_on(lambda n: s.lag(F.col(n)), F.col))
    rows = df.withColumn("_chunk", chunk).withColumn("_new", F.when(F.row_number().over(s.p) > 1, inner))
    at, row = F.struct(*order), F.struct(*fields)
    told = rows.groupBy(key, "_chunk").agg(F.coalesce(F.sum("_new"), F.lit(0)).alias("_n"), F.min_by(row, at).alias("_first"), F.max_by(row, at).alias("_last"))
    told = told.withColumn("_prior", F.lag("_last").over(Window.partitionBy(key).orderBy("_chunk")))
    told = told.withColumn("_opens", holds(goes_on(lambda n: F.col("_prior")[n], lambda n: F.col("_first")[n])))
    told = told.select(key, "_chunk", "_opens", F.coalesce(F.sum(F.col("_n") + F.col("_opens")).over(_handed([key])), F.lit(0)).alias("_before"))
    rows = _with(rows, told, [key, "_chunk"])
    return rows.withColumn(name, F.col("_before") + F.sum(F.coalesce("_new", "_opens")).over(s.u)).select(*df.columns, name)


def last_known(rows: DataFrame, value: str, found: str, by: list[str], on: str, sort: list[Column], chunk: Column, forward: bool = False, ties: list[Column] | None = None) -> DataFrame:
    """Add found: the value (NULL where a row has none) of the nearest row at or before, or after, in the sorted series.

    sort orders rows of a chunk; ``on``, ties and value give the carry, so of rows that share
    ``on`` and ties any may be carried.
    """
    rows = rows.withColumn("_chunk", chunk)
    # Forward is backward over the reversed order: a frame that ends at its row is kept as it
    # runs, one that starts there is gone through anew for every row.
    turned = (lambda x: x.desc()) if forward else (lambda x: x.asc())
    edge = F.min_by if forward else F.max_by
    told = rows.groupBy(*by, "_chunk").agg(edge(value, F.when(F.col(value).isNotNull() & F.col(on).isNotNull(), F.struct(on, *(ties or [])))).alias("_held"))
    way = Window.partitionBy(*by).orderBy(turned(F.col("_chunk"))).rowsBetween(Window.unboundedPreceding, -1)
    told = told.select(*by, "_chunk", F.last("_held", ignorenulls=True).over(way).alias("_carried"))
    w = Window.partitionBy(*by, "_chunk").orderBy(*map(turned, sort)).rowsBetween(Window.unboundedPreceding, 0)
    out = _with(rows.withColumn(found, F.last(value, ignorenulls=True).over(w)), told, [*by, "_chunk"])
    return out.withColumn(found, F.coalesce(found, "_carried")).drop("_chunk", "_carried")


# --- bars that restart at a volume ----------------------------------------------------------------


def _sorted(t: pa.Table, order: tuple[str, ...]) -> pa.Table:
    """Missing values first, as Spark orders them."""
    return t.take(pc.sort_indices(t, [(o, "ascending") for o in order], null_placement="at_start"))


def _sums(t: pa.Table, size: str) -> tuple[pa.Table, np.ndarray]:
    t = _sorted(t, ("ts", "seq"))
    return t, np.concatenate([[0.0], np.cumsum(t.column(size).to_numpy())])


def _ends(total: np.ndarray, volume: float) -> np.ndarray:
    """For a bar that starts at each row, the row behind its last; beyond the rows if it stays open."""
    starts = np.arange(len(total))
    return np.maximum(np.searchsorted(total, total + volume, side="left"), starts + 1)


def volume_ids(tape: DataFrame, volume: float, size: str = "qty", chunk: Column | None = None) -> DataFrame:
    """Add bar_id: a bar closes with the trade that reaches volume, and the next one starts at 0.

    What a chunk hands on depends on what it is handed, the volume of the open bar, only
    through the trade that closes that bar. So a chunk is summarised by what follows from
    each trade of its first bar: the sum that reaches it, what is open at the chunk's end,
    and how many bars closed. Following these summaries gives every chunk its start.
    """
    chunk = by_time() if chunk is None else chunk
    rows = tape.withColumn("_chunk", chunk)

    def profile(t: pa.Table) -> pa.Table:
        key, at = t.column(KEY)[0], t.column("_chunk")[0]
        _, total = _sums(t, size)
        n = len(total) - 1
        jump = _ends(total, volume)
        jump = np.where(jump <= n, jump, np.arange(n + 1))
        closed = (jump != np.arange(n + 1)).astype(np.int64)
        while True:  # doubled until every start is at its last open bar
            further = jump[jump]
            if (further == jump).all():
                break
            closed, jump = closed + closed[jump], further
        first = int(np.searchsorted(total, volume, side="left"))  # trades of a bar that starts with the chunk
        after = np.arange(1, min(first, n) + 1)
        row = {"_total": total[-1], "_reach": total[after].tolist(), "_open": (total[-1] - total[jump[after]]).tolist(), "_closed": (1 + closed[after]).tolist()}
        out = pa.Table.from_pylist([row], pa.schema([("_total", pa.float64()), *[(n, pa.list_(k)) for n, k in (("_reach", pa.float64()), ("_open", pa.float64()), ("_closed", pa.int64()))]]))
        return out.add_column(0, "_chunk", pa.array([at.as_py()], pa.int64())).add_column(0, pa.field(KEY, key.type), pa.array([key.as_py()], key.type))

    kind = tape.schema[KEY].dataType.simpleString()
    told = rows.select(KEY, "_chunk", "ts", "seq", size).groupBy(KEY, "_chunk").applyInArrow(profile, f"{KEY} {kind}, _chunk long, _total double, _reach array<double>, _open array<double>, _closed array<long>")

    def follow(t: pa.Table) -> pa.Table:
        t = _sorted(t, ("_chunk",))
        held, bar, start, first = 0.0, 0, [], []
        for total, reach, left, closed in zip(*(t.column(c) for c in ("_total", "_reach", "_open", "_closed")), strict=True):
            start.append(held)
            first.append(bar)
            reach = np.array(reach.as_py(), float)
            j = int(np.searchsorted(reach, volume - held, side="left"))
            if j < len(reach):
                held, bar = left[j].as_py(), bar + closed[j].as_py()
            else:
                held += total.as_py()
        return t.select([KEY, "_chunk"]).append_column("_held", pa.array(start, pa.float64())).append_column("_first", pa.array(first, pa.int64()))

    starts = told.groupBy(KEY).applyInArrow(follow, f"{KEY} {kind}, _chunk long, _held double, _first long")

    def ids(t: pa.Table) -> pa.Table:
        t, total = _sums(t, size)
        held, bar, n = t.column("_held")[0].as_py(), t.column("_first")[0].as_py(), t.num_rows
        out, at = np.empty(n, np.int64), 0
        end = max(int(np.searchsorted(total, volume - held, side="left")), 1)
        while at < n:
            end = min(end, n)
            out[at:end] = bar
            at, bar = end, bar + 1
            end = max(int(np.searchsorted(total, total[at] + volume, side="left")), at + 1)
        return t.select(names).append_column("bar_id", pa.array(out))

    names = [c for c in tape.columns if c != "bar_id"]
    schema = StructType([tape.schema[c] for c in names]).add("bar_id", LongType())
    return _with(rows, starts, [KEY, "_chunk"]).groupBy(KEY, "_chunk").applyInArrow(ids, schema)


# --- linear recurrences ---------------------------------------------------------------------------


def linear(df: DataFrame, steps: dict[str, tuple[Column, Column]], chunk: Column, order: tuple[str, ...] = ("bar",), key: str = KEY, before: bool = False) -> DataFrame:
    """Add for each name y = a * (y of the row before) + b by its (a, b), y before the first row being 0.

    Steps compose: (a, b) after (a', b') is (a a', a b' + b). A chunk is composed row by row
    as if it began at 0, the last pairs of the chunks are composed in order, and each row
    is its own b plus its own a times what its chunk is handed. A step with a = 0 forgets
    what was before, be it NaN. With ``before``, name_before is the y of the row before.
    """
    fields = [f for f in df.schema.fields if f.name not in steps]
    pairs = {n: (f"_a_{n}", f"_b_{n}") for n in steps}
    last = {n: (f"_p_{n}", f"_q_{n}") for n in steps} if before else {}
    schema = StructType([*fields]).add("_chunk", LongType())
    for x in (*pairs.values(), *last.values()):
        schema = schema.add(x[0], DoubleType()).add(x[1], DoubleType())
    told = {x: v.cast("double") for n in steps for x, v in zip(pairs[n], steps[n], strict=True)}
    rows = df.withColumns({"_chunk": chunk, **told}).select(*[f.name for f in fields], "_chunk", *told)

    inputs = list(told)

    def compose(t: pa.Table) -> pa.Table:
        t = _sorted(t, order)
        made = t.drop_columns(inputs)
        sides = {}
        for n, names in pairs.items():
            a, b = (t.column(c).to_numpy(zero_copy_only=False).tolist() for c in names)
            out, prior, x, y = [], [], 1.0, 0.0
            for p, q in zip(a, b, strict=True):
                prior.append((x, y))
                x, y = (x * p, y * p + q) if p != 0 else (0.0, q)
                out.append((x, y))
            sides[n] = (np.array(out).T, np.array(prior).T)
        for k, names in enumerate((pairs, last)):
            for n, (x, y) in names.items():
                made = made.append_column(x, pa.array(sides[n][k][0])).append_column(y, pa.array(sides[n][k][1]))
        return made

    rows = rows.groupBy(key, "_chunk").applyInArrow(compose, schema)
    at, ends = F.struct(*order), [x for n in steps for x in pairs[n]]
    summary = rows.groupBy(key, "_chunk").agg(F.max_by(F.struct(*ends), at).alias("_end"))
    handed = F.collect_list("_end").over(_handed([key]))
    step = lambda y, a, b: F.when(a == 0, b).otherwise(a * y + b)
    along = lambda x: lambda y, e: step(y, e[x[0]], e[x[1]])
    carries = [F.aggregate(handed, F.lit(0.0), along(x)).alias(f"_y_{n}") for n, x in pairs.items()]
    out = _with(rows, summary.select(key, "_chunk", *carries), [key, "_chunk"])
    found = {n: step(F.col(f"_y_{n}"), *map(F.col, x)) for n, x in pairs.items()} | {f"{n}_before": step(F.col(f"_y_{n}"), *map(F.col, x)) for n, x in last.items()}
    return out.withColumns(found).select(*[f.name for f in fields], *found)
