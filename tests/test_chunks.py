"""Two-level operators against loops: many chunks, a hot symbol, missing keys, empty tables."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import bars as br
from tickloom.operators import chunks
from tickloom.operators import indicators as ind
from tickloom.operators import joins as jn
from tickloom.operators import smoothers as sm
from tickloom.windows import Series, trailing

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    """A third of the rows is symbol 0; ids and sides make runs, some over several chunks; a symbol and a few times are missing."""
    rng, out = random.Random(8), []
    at = 0
    for k in range(2400):
        at += rng.choice([0, 1, 1, 40, 3600 * rng.randint(0, 9)])
        symbol = rng.choice([0, 0, 0, 1, 2, 3, 4, 5, None])
        out.append((symbol, None if rng.random() < 0.01 else T0 + timedelta(seconds=at), k, float(rng.randint(1, 40)), rng.choice(["buy", "sell"]), rng.choice([k, k, k + 5])))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol long, ts timestamp, seq long, qty double, side string, first_id long").repartition(4).cache()


def series(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[1] is not None, r[1] or T0, r[2])) for k, v in out.items()}


def test_numbers(frame, rows):
    got = {r["seq"]: r["n"] for r in chunks.numbered(frame, "n", chunks.by_time()).collect()}
    assert got == {r[2]: k for own in series(rows).values() for k, r in enumerate(own)}
    assert chunks.numbered(frame.limit(0), "n", chunks.by_time()).count() == 0


@pytest.mark.parametrize("sec", [86_400, 60, 10**9])
def test_runs(frame, rows, sec):
    goes_on = lambda before, now: (now("side") == before("side")) & (now("qty") + before("qty") < 70)
    got = {r["seq"]: r["run"] for r in chunks.run_ids(frame, "run", goes_on, ["side", "qty"], chunks.by_time(sec=sec)).collect()}
    want = {}
    for own in series(rows).values():
        run = 0
        for k, r in enumerate(own):
            run += not (k and r[4] == own[k - 1][4] and r[3] + own[k - 1][3] < 70)
            want[r[2]] = run
    assert got == want


@pytest.mark.parametrize(("sec", "volume"), [(86_400, 100.0), (60, 100.0), (86_400, 1.0), (600, 3000.0), (10**9, 250.0), (86_400, 10.0**9)])
def test_volume_bars(frame, rows, sec, volume):
    got = {r["seq"]: r["bar_id"] for r in chunks.volume_ids(frame, volume, chunk=chunks.by_time(sec=sec)).collect()}
    want = {}
    for own in series(rows).values():
        bar, held = 0, 0.0
        for r in own:
            want[r[2]], held = bar, held + r[3]
            if held >= volume:
                bar, held = bar + 1, 0.0
    assert got == want


@pytest.mark.parametrize("forward", [False, True])
def test_asof(spark, frame, rows, forward):
    left = frame.filter("seq % 3 = 0 and ts is not null").select("symbol", F.unix_seconds("ts").alias("at"), "seq")
    right = frame.filter("seq % 7 = 1 and ts is not null").select("symbol", F.unix_seconds("ts").alias("at"), "qty")
    known = [(r[0], int((r[1] - T0).total_seconds()), r[3]) for r in rows if r[2] % 7 == 1 and r[1]]
    for span in (100, 86_400, 10**9):
        for fallback in (False, forward):
            got = {r["seq"]: r["qty"] for r in jn.asof(left, right, "at", ["symbol"], ["qty"], forward, fallback, span=span).collect()}
            assert len(got) == left.count()
            for r in rows:
                if r[2] % 3 or not r[1]:
                    continue
                at, own = int((r[1] - T0).total_seconds()), [k for k in known if k[0] == r[0]]
                near = [k for k in own if (k[1] >= at if forward else k[1] <= at)]
                best = (min if forward else max)((k[1] for k in near), default=None)
                if best is None and fallback and own:
                    best = max(k[1] for k in own)
                assert got[r[2]] in ([k[2] for k in own if k[1] == best] if best is not None else [None])


def bars_with_gaps(seed, n):
    rng = np.random.default_rng(seed)
    x = 100 + rng.normal(size=n).cumsum()
    x[rng.random(n) < 0.15] = np.nan
    return x, np.where(rng.random(n) < 0.1, np.nan, rng.random(n) * 0.5)


@pytest.mark.parametrize("rows_of_a_chunk", [12, 1000])
def test_scans_equal_loops(spark, rows_of_a_chunk):
    """Each symbol is cut in 8 tasks or more, and gives the rows of the loop over the whole series."""
    data = {k: bars_with_gaps(k, n) for k, n in ((1, 240), (2, 100), (3, 1))}
    whole = 100 + np.random.default_rng(9).normal(size=200).cumsum()
    data[4] = (whole, np.full(200, 0.1))
    data[5] = (np.array([np.nan] * 30), np.full(30, 0.1))
    value = lambda v: None if v != v else float(v)
    df = spark.createDataFrame([(k, 60 * i, value(v), value(a)) for k, (x, pace) in data.items() for i, (v, a) in enumerate(zip(x, pace, strict=True))], "symbol long, bar long, x double, pace double")
    kw = {"rows": rows_of_a_chunk}
    cases = {
        "ewm": (sm.ewm_scan(df, "x", "y", 0.2, **kw), lambda x, a: sm.ewm(x, 0.2)),
        "least": (sm.ewm_scan(df, "x", "y", 0.2, least=9, **kw), lambda x, a: sm.ewm(x, 0.2, least=9)),
        "adjusted": (sm.ewm_scan(df, "x", "y", 0.2, adjust=True, least=3, **kw), lambda x, a: sm.ewm(x, 0.2, True, 3)),
        "adaptive": (sm.adaptive_scan(df, "x", "pace", "y", **kw), sm.adaptive_ema),
        "kaufman": (sm.kaufman_scan(df, "x", "y", n=5, **kw), lambda x, a: sm.kaufman(x, 5)),
    }
    for name, (got, loop) in cases.items():
        found = {(r["symbol"], r["bar"] // 60): r["y"] for r in got.collect()}
        assert len(found) == df.count(), name
        for k, (x, pace) in data.items():
            y = loop(x, pace)["y"]
            for i, v in enumerate(y):
                mine = found[k, i]
                assert (mine is None) == (not np.isfinite(v)) and (mine is None or mine == pytest.approx(v, rel=1e-9)), (name, k, i, mine, v)
    with pytest.raises(ValueError):
        sm.kaufman_scan(df, "x", "y", n=20, rows=20)


def test_a_hot_symbol_is_many_tasks(frame):
    """No window or grouped function of these operators has the symbol alone as its key over rows."""
    tape = frame.filter("ts is not null").withColumns({"price": F.col("qty"), "notional": F.col("qty"), "last_id": F.col("first_id"), "n_fills": F.lit(1).cast("long")})
    for df in (br.with_count_id(tape, 10), br.merge_trades(tape), br.volume_bar_ids(tape, 100.0), sm.ewm_scan(tape, "qty", "y", 0.2, order=("seq",), by=chunks.by_id())):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window" in line and "windowspec" in line.lower() and "_chunk" not in line and "chunk" not in line:
                raise AssertionError(line)


def test_no_frame_starts_at_its_row(spark, frame):
    """Such frames are gone through anew for each row: quadratic in a chunk. A forward search and a fill from behind have none."""
    left = frame.select("symbol", "ts", "seq")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower().replace(" ", "")
    for df in (jn.asof(left, frame.select("symbol", "ts", "qty"), "ts", ["symbol"], ["qty"], forward=True), frame.select(Series(order=("seq",)).bfill(F.col("qty")))):
        assert "currentrow$(),unboundedfollowing" not in plan(df) and "currentrow$(),specifiedwindowframe" not in plan(df) and "1,unboundedfollowing" not in plan(df)
    gaps = frame.select("symbol", "seq", F.when(F.col("seq") % 7 == 0, F.col("qty")).alias("x")).filter("symbol = 1")
    own = sorted((r["seq"], r["x"]) for r in gaps.collect())
    want = {k: next((x for _, x in own[i:] if x is not None), None) for i, (k, _) in enumerate(own)}
    assert {r["seq"]: r["y"] for r in gaps.select("seq", Series(order=("seq",)).bfill(F.col("x")).alias("y")).collect()} == want


def test_time_frames_by_bins(spark, frame):
    """Sums and extremes of (t - ms, t] equal those of Spark's own frame, which goes through all its rows for each row; none is planned."""
    rows = frame.withColumn("micros", F.unix_micros("ts")).withColumn("qty", F.when(F.col("seq") % 11 != 0, F.col("qty")))
    for ms in (1000, 7_000, 3_600_000):
        w = Window.partitionBy("symbol").orderBy("micros").rangeBetween(-ms * 1000 + 1, 0)
        want = rows.select("seq", F.sum("qty").over(w).alias("s"), F.min("qty").over(w).alias("l"), F.max("qty").over(w).alias("h"))
        got = trailing(rows, ms, {"s": ("sum", F.col("qty")), "l": ("min", F.col("qty")), "h": ("max", F.col("qty"))})
        assert got.columns == [*rows.columns, "s", "l", "h"]
        assert sorted(map(str, got.select("seq", "s", "l", "h").collect())) == sorted(map(str, want.collect()))
    tape = frame.withColumn("price", F.col("qty"))
    plan = ind.aggressive_flow(tape, 3_600_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "3599999999" not in plan and "window_volume" in plan


@pytest.mark.parametrize("span", [1, 100, 10**9])
def test_asof_in_the_order_of_ties(spark, span):
    """Of rows of one time the search backward finds the last by order, forward the first, from chunk to chunk too."""
    left = spark.createDataFrame([(0, at) for at in (50, 100, 150, 400)], "symbol long, at long")
    right = spark.createDataFrame([(0, at, seq) for seq in random.Random(3).sample(range(60), 60) for at in (100, 300)], "symbol long, at long, seq long").repartition(5)
    right = right.withColumn("x", F.col("at") + F.col("seq"))
    find = lambda *how: {r["at"]: r["x"] for r in jn.asof(left, right, "at", ["symbol"], ["x"], *how, span=span, order=("seq",)).collect()}
    assert find() == {50: None, 100: 159, 150: 159, 400: 359}
    assert find(True) == {50: 100, 100: 100, 150: 300, 400: None}
    assert find(True, True) == {50: 100, 100: 100, 150: 300, 400: 359}
