"""Small hand-made cases, recursions against pandas, streams against batches."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom import windows
from tickloom.operators import bars as br
from tickloom.operators import features as ft
from tickloom.operators import joins as jn
from tickloom.operators import labels as lb
from tickloom.operators import metrics as mt
from tickloom.operators import simulate as sim
from tickloom.operators import smoothers as sm
from tickloom.operators import spectrum as sp
from tickloom.plans import expressions as ex
from tickloom.plans import scans
from tickloom.schema import TAPE, normalise, tape_of_events
from tickloom.windows import Series

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
S = Series(order=("bar",))


def tape(spark, rows):
    """rows: (ms, price, qty, side, first_id, last_id)"""
    out = [(1, T0 + timedelta(milliseconds=m), i, float(p), float(q), float(p * q), s, a, b, b - a + 1) for i, (m, p, q, s, a, b) in enumerate(rows)]
    return spark.createDataFrame(out, TAPE)


def bars(spark, closes, spread=0.0):
    return spark.createDataFrame([(1, i, float(x), float(x) + spread, float(x) - spread, float(x), 10.0) for i, x in enumerate(closes)], "symbol long, bar long, open double, high double, low double, close double, volume double")


def test_merge_boundaries(spark):
    rows = [(0, 10, 1, "buy", 0, 0), (50, 11, 1, "buy", 1, 1), (149, 11, 1, "buy", 2, 2), (249, 12, 1, "buy", 3, 3), (260, 11, 1, "buy", 4, 4), (265, 11, 1, "sell", 5, 5), (266, 10, 1, "sell", 7, 7)]
    got = br.merge_trades(tape(spark, rows)).orderBy("seq").collect()
    # 100 ms is too late, a better price, another side and a gap in ids each break the chain
    assert [(r["seq"], r["n_raw_trades"]) for r in got] == [(0, 3), (3, 1), (4, 1), (5, 1), (6, 1)]
    assert sum(r["qty"] for r in got) == 7


def test_volume_bars_drop_the_excess_and_keep_the_tail(spark):
    t = tape(spark, [(i, 10, q, "buy", i, i) for i, q in enumerate([4, 4, 4, 9, 1, 12, 3])])
    assert [r["volume"] for r in br.volume_bars(t, 10).orderBy("bar_id").collect()] == [12, 10, 12, 3]
    carried = br.volume_bars(t, 10, carry=True).orderBy("bar_id").collect()
    assert sum(r["volume"] for r in carried) == 37


def test_bars_of_an_empty_tape(spark):
    t = tape(spark, [(0, 1, 1, "buy", 0, 0)]).limit(0)
    assert br.time_bars(t, 60).count() == br.count_bars(t, 3).count() == br.volume_bars(t, 5).count() == br.merge_trades(t).count() == 0


def test_bars_reject_unknown_kinds(spark):
    with pytest.raises(ValueError):
        br.build_bars(tape(spark, []), "raw", "ticks", 5)


def test_last_row_of_a_timestamp_wins(spark):
    t = tape(spark, [(0, 1, 1, "buy", 0, 0), (0, 2, 1, "buy", 1, 1), (5, 3, 1, "buy", 2, 2)])
    assert [r["price"] for r in windows.dedup_last(t).orderBy("seq").collect()] == [2.0, 3.0]


def test_normalise_names_and_missing_values(spark):
    df = spark.createDataFrame([(T0, 10.0, 2.0, "BUY", 7), (T0, float("nan"), 1.0, "sell", 8)], "timestamp timestamp, price double, amount double, side string, agg_trade_id long")
    got = normalise(df, "X").orderBy("seq").collect()
    assert got[0]["notional"] == 20.0 and got[0]["side"] == "buy" and got[1]["price"] is None and got[0]["symbol"] == "X"


def test_halo_chunks_give_the_whole_series(spark, sf):
    t = br.time_bars(tape_of_events(spark.read.parquet(f"{sf}/events.parquet")), 21600)
    whole = t.select("symbol", "bar", S.mean(F.col("close"), 3, 1).alias("m"))
    cut = windows.with_halo(t, F.floor(F.col("bar") / (86400 * 5)), 2, order=("bar",))
    own = Series(key=("symbol", "chunk"), order=("bar",))
    part = cut.withColumn("m", own.mean(F.col("close"), 3, 1)).filter(~F.col("halo")).select("symbol", "bar", "m")
    a, b = (x.orderBy("symbol", "bar").toPandas() for x in (whole, part))
    assert np.allclose(a["m"], b["m"]) and len(a) == len(b)


def test_asof_ties_nulls_and_direction(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 10, "b"), (2, 1, "c")], "k int, t int, id string")
    right = spark.createDataFrame([(1, 5, 50, None), (1, 7, 70, 7), (1, 20, 200, 2)], "k int, t int, v int, u int")
    got = {r["id"]: (r["v"], r["u"]) for r in jn.asof(left, right, "t", ["k"], ["v", "u"]).collect()}
    assert got == {"a": (50, None), "b": (70, 7), "c": (None, None)}
    ahead = {r["id"]: r["v"] for r in jn.asof(left, right, "t", ["k"], ["v"], forward=True).collect()}
    assert ahead == {"a": 50, "b": 200, "c": None}
    near = {r["id"]: r["v"] for r in jn.asof(left, right, "t", ["k"], ["v"], tolerance=2).collect()}
    assert near == {"a": 50, "b": None, "c": None}


def test_interval_ends(spark):
    e = spark.createDataFrame([(1, 0.0, 10.0)], "k int, a double, b double")
    rows = spark.createDataFrame([(1, 0.0), (1, 10.0), (1, 5.0), (2, 5.0)], "k int, t double")
    n = lambda closed: jn.interval(e, rows, ["k"], "t", F.col("a"), F.col("b"), 3.0, closed).count()
    assert (n("left"), n("right"), n("both")) == (2, 2, 3)


def test_expressions_parse_and_refuse(spark):
    n = ex.parse("ts_zscore( ts_mean(delta(x,2),3), 10)")
    assert ex.order(n) == 3 and ex.lookback(n) == 9 + 2 + 2 and ex.fields(n) == {"x"} and ex.show(n) == "ts_zscore(ts_mean(delta(x, 2), 3), 10)"
    for bad in ("nope(x, 3)", "ts_mean(x", "ts_mean(x, 3) y", "ts_corr(x, 3)", "ts_mean(x)", ""):
        with pytest.raises(ValueError):
            ex.parse(bad)
    with pytest.raises(ValueError):
        ex.evaluate(bars(spark, [1, 2]), {"e": "delta(zzz, 1)"}, S)


def test_windows_with_missing_values_and_constant_runs(spark):
    x = [None, 1.0, 1.0, 1.0, None, 2.0, 5.0, 5.0, 5.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "symbol long, bar long, x double")
    got = ex.evaluate(df, {"m": "ts_mean(x, 4)", "s": "ts_stddev(x, 4)", "c": "ts_autocorr(x, 6)", "r": "ts_rank(x, 3)"}, S).orderBy("bar").toPandas()
    p = pd.Series(x, dtype=float)
    assert np.allclose(got["m"].astype(float), p.rolling(4, min_periods=2).mean(), equal_nan=True)
    assert np.allclose(got["s"].astype(float), p.rolling(4, min_periods=2).std(), equal_nan=True, atol=1e-9)
    assert got["r"].isna()[4] and got["r"][8] == pytest.approx(2 / 3)


def test_exponential_means_match_pandas(spark):
    x = np.array([1.0, 2.0, np.nan, 4.0, 3.0, np.nan, np.nan, 8.0])
    assert np.allclose(sm.ewm(x, 0.3)["y"], pd.Series(x).ewm(alpha=0.3, adjust=False).mean(), equal_nan=True)
    assert np.allclose(sm.ewm(x, 0.3, adjust=True)["y"], pd.Series(x).ewm(alpha=0.3, adjust=True).mean(), equal_nan=True)


def test_triple_barrier_cases(spark):
    rows = [(1, i, 100.0, h, low, c, 1.0) for i, (h, low, c) in enumerate([(100, 100, 100), (103, 97, 101), (100, 100, 100), (100, 98, 98.5), (99, 98, 99)])]
    b = spark.createDataFrame([tuple(map(float, r[2:])) and (r[0], r[1], *map(float, r[2:])) for r in rows], "symbol long, bar long, open double, high double, low double, close double, volume double")
    got = {r["bar"]: (r["label"], r["hit_bar"], round(r["ret"], 4)) for r in lb.triple_barrier(b, 0.02, 0.02, 3).collect()}
    assert got[0] == ("lower", 1, 0.01)  # both sides in one bar that closes above the entry
    assert got[2] == ("lower", 1, -0.02)
    assert got[3] == ("time", 1, round(99 / 98.5 - 1, 4))
    assert 4 not in got


def test_machine_flip_keeps_the_entry(spark):
    close, want = np.array([100.0, 101, 102, 103]), np.array([1.0, 1, -1, -1])
    loose = sim.machine(close, want, close * np.nan, "none", "none", {}, 0.0)
    assert loose["position"] == [1, 1, -1, -1] and loose["reason"] == ["entry", "", "flip", ""]
    timed = sim.machine(close, want, close * np.nan, "none", "time_decay", {"bars": 3}, 0.0)
    strict = sim.machine(close, want, close * np.nan, "none", "time_decay", {"bars": 3}, 0.0, strict=True)
    assert timed["reason"][3] == "exit" and strict["reason"][3] == ""


def test_gap_statuses(spark):
    rows = [(10, 9, 9.5), (11, 10, 11), (13, 12, 12.5), (13, 11, 12), (12, 9, 10)]
    b = spark.createDataFrame([(1, i, float(c), float(h), float(low), float(c), 1.0) for i, (h, low, c) in enumerate(rows)], "symbol long, bar long, open double, high double, low double, close double, volume double")
    got = lb.gap_fills(b, 5).filter("kind = 'bullish'").orderBy("bar").collect()
    assert [(g["bar"], g["status"], g["fill_bars"]) for g in got] == [(2, "filled", 2)] and got[0]["max_extension"] == pytest.approx(1.0)


def test_spectrum_finds_planted_periods(spark):
    df = sp.cosines(spark, 1200, 1.0, [60.0, 300.0], [1.0, 2.0], 0.1, 3)
    spec = sp.spectrum(sp.autocovariance(df, ["symbol"], "bar", "x", 600), ["symbol"], 1.0, 60)
    top = [r["period_sec"] for r in sp.top_periods(spec, ["symbol"], 2).orderBy("rank").collect()]
    assert top == pytest.approx([300.0, 60.0], rel=0.1)


def test_returns_and_streaks(spark):
    df = spark.createDataFrame([(1, i, r, 1.0) for i, r in enumerate([0.1, -0.1, 0.0, 0.2])], "symbol long, bar long, ret double, position double")
    assert mt.streaks(df, ["symbol"], "bar").first()["max_losses"] == 2
    m = mt.return_metrics(df, ["symbol"], "bar", 3600.0).first()
    assert m["total_return"] == pytest.approx(1.1 * 0.9 * 1.2 - 1)


def test_scan_drops_repeats_and_ranks(spark, sf):
    out = scans.factor_scan(tape_of_events(spark.read.parquet(f"{sf}/events.parquet")), 21600, ["ts_mean(volume, 5)", "ts_mean(volume,5)", "delta(trade_imbalance, 2)"], least_bars=10).toPandas()
    assert set(out["expr"]) == {"ts_mean(volume,5)", "delta(trade_imbalance,2)"}


def test_balance_and_features(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b", 1.0, None if i % 2 else 2.0) for i in range(10)], "id long, k string, x double, y double")
    assert {r["k"]: r["count"] for r in ft.balance(df, "k", ["id"]).groupBy("k").count().collect()} == {"a": 3, "b": 3}
    assert ft.select_features(df, ["id", "x", "y"]) == ["id"]


def test_sources_round_trip(spark, tmp_path):
    from tickloom.sources import io

    t = tape(spark, [(0, 1, 1, "buy", 0, 0), (86_400_000, 2, 1, "sell", 1, 1)])
    io.write_days(t, str(tmp_path / "t"))
    io.write_days(t.filter("seq = 1").withColumn("price", F.lit(9.0)), str(tmp_path / "t"), skip_existing=True)
    assert [r["price"] for r in io.read_trades(spark, str(tmp_path / "t")).orderBy("seq").collect()] == [1.0, 2.0]
    assert io.read_trades(spark, str(tmp_path / "t"), end="2024-01-02").count() == 1
    assert io.read_trades(spark, str(tmp_path / "t"), end="2024-01-02", inclusive=True).count() == 2
    msg = spark.createDataFrame([('{"a":5,"p":"2.5","q":"4","f":7,"l":9,"T":1704067200000,"m":true}',)], "value string")
    r = io.decode_agg_trades(msg).first()
    assert (r["seq"], r["notional"], r["side"], r["n_fills"]) == (5, 10.0, "sell", 3)
    ev = spark.createDataFrame([('{"id":"1","title":"Coin up?","outcomes":"[\\"Yes\\",\\"No\\"]","outcomePrices":"[\\"0.4\\",\\"0.6\\"]","clobTokenIds":"[\\"t1\\",\\"t2\\"]"}',)], "value string")
    m = io.token_for_signal(io.market_events(ev, ["coin"]).withColumn("signal", F.lit(-1))).first()
    assert m["token"] == "t2" and m["outcomePrices"] == [0.4, 0.6]


def _stream(spark, path, make):
    schema = TAPE
    name = f"q{abs(hash(path)) % 10**8}"
    q = make(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", path + "_ck").start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_equal_batches(spark, sf, tmp_path):
    from tickloom.streaming import bars as sb

    t = tape_of_events(spark.read.parquet(f"{sf}/events.parquet")).filter("symbol < 3")
    t.orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "in")
    got = _stream(spark, path, lambda s: sb.event_bar_stream(s, count=20))
    full = br.count_bars(t, 20).filter("n_trades = 20")
    cols = ["symbol", "bar_id", "open", "high", "low", "close", "volume", "buy_volume"]
    a, b = (x.select(*cols).orderBy("symbol", "bar_id").toPandas() for x in (got, full))
    pd.testing.assert_frame_equal(a, b)
    (tmp_path / "in_ck").rename(tmp_path / "ck1")
    merged = _stream(spark, path + "/", lambda s: sb.merge_stream(s, gap_ms=3_600_000))
    whole = br.merge_trades(t, 3_600_000)
    # the last order of each symbol may still be pending
    assert whole.count() - 3 <= merged.count() <= whole.count()
    left = merged.select("symbol", "seq", "n_raw_trades").exceptAll(whole.select("symbol", "seq", "n_raw_trades"))
    assert left.count() == 0


def test_microstructure_stream(spark, sf, tmp_path):
    from tickloom.streaming import state

    t = tape_of_events(spark.read.parquet(f"{sf}/events.parquet")).filter("symbol = 1")
    t.orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "m"))
    got = _stream(spark, str(tmp_path / "m"), lambda s: state.microstructure_stream(s, window_ms=86_400_000, imbalance=0.2, impact=0.001, timeout_ms=10**9))
    assert got.count() == t.count() and got.filter("signal <> 0").count() > 0


def test_models(spark):
    from tickloom.operators import ml

    df = spark.range(200).select(F.col("id"), (F.col("id") / 200).alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df = df.withColumn("y", 2 * F.col("a") + 0.1 * F.col("b")).withColumn("k", (F.col("a") > 0.5).cast("double"))
    assert ml.fit(df, ["a", "b"], "y", "ridge", reg=0.0).transform(df).select(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1e-6
    assert ml.clusters(df, ["a", "b"], 3).select("cluster").distinct().count() == 3
    assert ml.class_weights(df, "k").agg(F.sum("weight")).first()[0] == pytest.approx(200)
    sizes = [r["count"] for r in ml.folds(spark.range(400), "id", 3).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [100, 100, 100, 100]
    from pyspark.ml.evaluation import RegressionEvaluator

    metric = RegressionEvaluator(labelCol="y", metricName="r2")
    ranked = ml.permutation_importance(ml.fit(df, ["a", "b"], "y", "ridge", reg=0.0), df, ["a", "b"], "y", metric)
    assert [n for n, _ in ranked] == ["a", "b"] and ranked[0][1] > 0.5 > ranked[1][1] > 0


def test_paged_source_reads_every_page(spark):
    from tickloom.sources.paged import paged_source, read_paged

    def fetch(symbol, start, limit):
        t = datetime(2024, 1, 1)
        return [(symbol, i, t, 1.0, 2.0, "buy", i, i) for i in range(start, min(start + limit, 25))]

    spark.dataSource.register(paged_source("pages_of_trades", fetch, page=10))
    got = read_paged(spark, "pages_of_trades", ["A", "B"], from_id=3, to_id=20)
    assert got.count() == 36 and got.select("seq").distinct().count() == 18


def test_restarted_range_equals_a_loop(spark):
    from tickloom.operators import compose as cm

    rng = np.random.default_rng(0)
    close = 100 + rng.normal(size=60).cumsum()
    b = bars(spark, close, 0.5)
    got = cm.atr_exits(b, n=5, low=0.0, high=1.0).orderBy("bar").toPandas()
    prior = np.concatenate([close[:1], close[:-1]])
    tr = np.maximum(1.0, np.maximum(abs(close + 0.5 - prior), abs(close - 0.5 - prior)))
    atr = sm.ewm(tr[45:60], 2 / 6)["y"][-1]
    assert got["stop"].iloc[-1] == pytest.approx(round(2 * atr / close[-1], 4), abs=1e-4)


def test_one_indicator_grid(spark, sf):
    from tickloom.operators import compose as cm

    t = tape_of_events(spark.read.parquet(f"{sf}/events.parquet"))
    got = cm.all_indicators(t, 86400, ["trade_diff_spread", "efficiency_ratio", "turnover_ratio"])
    assert got.columns == ["symbol", "bar", "trade_diff_spread", "efficiency_ratio", "turnover_ratio"] and got.count() > 0


def test_signal_that_never_changes(spark):
    """Its correlation with itself a bar before is NaN, as in the SQL of eval_signal_metrics; zeros under 30 pairs stay."""
    import math

    from tickloom.operators import evaluate

    rows = spark.createDataFrame([(k, i, 0.1 * ((i * 7) % 13), 0.1 * ((i * 5) % 11) - 0.5, -1) for k, n in ((1, 40), (2, 20)) for i in range(n)], "symbol long, bar long, x double, y double, signal int")
    got = {r["symbol"]: r for r in evaluate.signal_metrics(rows, ["symbol"], "bar").collect()}
    assert math.isnan(got[1]["signal_autocorr"]) and math.isfinite(got[1]["ic"]) and got[1]["short_share"] == 1.0
    assert got[2]["signal_autocorr"] == 0.0


def test_trade_exits_between_trades_and_after_the_end(spark):
    from tickloom.operators import compose as cm

    t = tape(spark, [(0, 100, 1, "buy", 0, 0), (1000, 110, 1, "buy", 1, 1), (1000, 111, 1, "buy", 2, 2), (3000, 120, 1, "buy", 3, 3), (3000, 121, 1, "buy", 4, 4)]).repartition(3)
    entries = spark.createDataFrame([(1, T0.timestamp() + at, at, side) for at, side in ((0.0, 1), (0.5, -1), (2.0, 1), (9.0, 1))] + [(2, T0.timestamp(), 7.0, 1)], "symbol long, at double, id double, side int")
    got = cm.trade_exits(entries, t, 1.0).orderBy("id", "entry_price").collect()
    # an exit takes the first of the tied trades; after the end the fills are those of the last time
    assert [(r["id"], r["entry_price"], r["price"]) for r in got] == [(0.0, 100, 110), (0.5, 110, 120), (0.5, 111, 120), (2.0, 120, 120), (2.0, 121, 120), (9.0, 120, 120), (9.0, 121, 120)]
    assert got[1]["ret"] == pytest.approx(-(120 / 110 - 1)) and got[1]["at"] == T0.timestamp() + 0.5
