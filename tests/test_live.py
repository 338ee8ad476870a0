"""The live path against batches: splice, bounded history, silence, tails and a source with offsets, over restarts."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as br
from tickloom.operators import signals as sg
from tickloom.schema import TAPE, tape_of_events
from tickloom.streaming import live
from tickloom.streaming.replay import replay, slices, state_store
from tickloom.windows import Series, div

GAP = 3_600_000


@pytest.fixture(scope="module")
def tape(spark, sf):
    t = tape_of_events(spark.read.parquet(f"{sf}/events.parquet")).filter("symbol < 4")
    return spark.createDataFrame(t.toPandas(), TAPE).cache()


def batch_bars(tape, count, merge=True):
    """Full bars of all orders but each symbol's last, which a stream holds back, and their signal."""
    orders = br.merge_trades(tape, GAP) if merge else tape
    if merge:
        from pyspark.sql import Window

        orders = orders.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("seq")))).filter("k > 1")
    b = br.count_bars(orders, count).filter(F.col("n_trades") == count)
    b = b.withColumn("factor", div(F.col("buy_volume") - F.col("sell_volume"), F.col("volume")))
    return b


def with_signal(bars, **params):
    from tickloom.operators import signals

    old, signals.S = signals.S, Series(order=("bar_id",))
    try:
        return sg.signal(bars, "zscore", **params)
    finally:
        signals.S = old


COLUMNS = ["symbol", "bar_id", "ts", *live.VALUES]


def same(a, b, columns=COLUMNS):
    a, b = (x.select(*columns).toPandas().sort_values(columns[:2]).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    assert len(a)


@pytest.mark.parametrize("merge", [True, False])
def test_history_then_stream_equals_one_batch(spark, tape, merge):
    """The stream begins before the history ends and is restarted half-way; bars of both are those of one batch."""
    first, second, third = slices(tape, 3)
    warm = live.warm_state(first, 8, 500, GAP, merge)
    overlap = first.filter(F.col("seq") > first.agg(F.percentile_approx("seq", 0.8)).first()[0])
    got = replay([overlap.unionByName(second), third], lambda s: live.live_bars(s, 8, live.zscore_signal(n=20), warm, gap_ms=GAP, merge=merge, history=50, warmup=10))
    whole = with_signal(batch_bars(tape, 8, merge), n=20)
    before = json_bars(spark, warm)
    same(got.select(*COLUMNS).unionByName(before), whole)
    later = whole.join(got.select("symbol", "bar_id"), ["symbol", "bar_id"])
    signals = later.withColumn("signal", F.when(F.col("bar_id") + 1 >= 10, F.col("signal")).otherwise(0))
    same(got, signals, ["symbol", "bar_id", "signal"])
    assert got.filter("signal <> 0").count() and got.filter("ready <> (n_bars >= 10)").count() == 0
    assert got.filter("n_bars <> bar_id + 1").count() == 0


def json_bars(spark, warm):
    """The closed bars within a warm state."""
    rows = [(r["symbol"], b["bar_id"], pd.Timestamp(b["us"], unit="us").to_pydatetime(), *[b[v] for v in live.VALUES]) for r in warm.collect() for b in json.loads(r["bars"] or "[]")]
    kinds = ", ".join(f"{v} {'long' if v == 'n_trades' else 'double'}" for v in live.VALUES)
    return spark.createDataFrame(rows, f"symbol long, bar_id long, ts timestamp, {kinds}")


def test_history_is_a_ring(spark, tape):
    """The signal sees no more bars than the ring holds, over restarts too."""
    length = lambda h: len(h["close"]) * 1000 + int(h["bar_id"][-1] - h["bar_id"][0])
    got = replay(slices(tape, 3), lambda s: live.live_bars(s, 3, length, gap_ms=GAP, history=7, merge=False))
    want = got.withColumn("want", (F.least(F.lit(7), F.col("bar_id") + 1) * 1000 + F.least(F.lit(6), F.col("bar_id"))).cast("int"))
    assert want.count() > 100 and want.filter("signal <> want").count() == 0
    with pytest.raises(ValueError):
        live.LiveBars(0, length)


def test_empty_history_and_new_symbols(spark, tape):
    warm = live.warm_state(tape.filter("symbol = 1").limit(0), 8, merge=False)
    assert warm.count() == 0
    known = live.warm_state(tape.filter("symbol = 1"), 8, merge=False)
    got = replay([tape], lambda s: live.live_bars(s, 8, live.ma_cross_signal(lambda h: h["close"]), known, merge=False))
    assert got.filter("symbol = 1").count() == 0  # all of it is history
    b = batch_bars(tape.filter("symbol <> 1"), 8, merge=False).withColumn("factor", F.col("close"))
    from tickloom.operators import signals

    old, signals.S = signals.S, Series(order=("bar_id",))
    want = sg.signal(b, "ma_cross")
    signals.S = old
    same(got, want, ["symbol", "bar_id", "signal"])


def test_silence_by_event_time(spark, tape):
    got = replay(slices(tape, 3), lambda s: live.staleness(s, 20 * GAP, clock=False))
    t = tape.select("symbol", "ts").toPandas().sort_values(["symbol", "ts"])
    limit, want = pd.Timedelta(hours=20), []
    for s, g in t.groupby("symbol"):
        ts = list(g["ts"])
        for k, (a, b) in enumerate(zip(ts, [*ts[1:], None], strict=True)):
            if b is None:
                want += [(s, "stale", a, k + 1)] if t["ts"].max() - a > limit + pd.Timedelta(milliseconds=1) else []
            elif b - a > limit:
                want += [(s, "stale", a, k + 1), (s, "back", b, k + 1)]
    assert len(want) > 10 and sorted(map(tuple, got.toPandas().itertuples(index=False))) == sorted(want)


def test_silence_by_the_clock(spark, tape, tmp_path):
    """A symbol that falls silent is told once, although the other goes on, and told again when it is back."""
    one, two = (tape.filter(f"symbol = {k}").orderBy("seq").limit(6) for k in (1, 2))
    feed = lambda df: df.write.mode("append").parquet(str(tmp_path / "in"))
    feed(one.unionByName(two).filter("false"))
    with state_store(spark):
        out = live.staleness(spark.readStream.schema(TAPE).parquet(str(tmp_path / "in")), stale_ms=4_000)
        q = out.writeStream.format("memory").queryName("silence").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
        try:
            feed(one.limit(2).unionByName(two.limit(2)))
            seen = lambda: [(r["symbol"], r["status"]) for r in spark.table("silence").collect()]
            deadline = time.time() + 90
            while (1, "stale") not in seen() and time.time() < deadline:
                feed(two)
                time.sleep(1)
            for _ in range(4):  # told once, however long it lasts
                feed(two)
                time.sleep(1)
            assert seen() == [(1, "stale")]
            feed(one)
            while (1, "back") not in seen() and time.time() < deadline:
                feed(two)
                time.sleep(1)
            assert seen()[:2] == [(1, "stale"), (1, "back")]
        finally:
            q.stop()


def features(tail):
    b = br.time_bars(tail, 86_400)
    s = Series(order=("bar",))
    return b.withColumn("mean", s.mean(F.col("close"), 3, 1)).select("symbol", "bar", "close", "volume", "mean")


def test_tail_computed_anew(spark, tape, tmp_path):
    """Results over three runs are the batch's; a batch that runs again, alone or after a lost commit, changes nothing."""
    root = str(tmp_path / "root")
    parts = slices(tape, 3)
    replay(parts, lambda s: s, lambda s: live.bar_features(s, features, 86_400, root, keep=120))
    got = live.read_features(spark, root)
    last = tape.groupBy("symbol").agg(F.max(br.time_bin(F.col("ts"), 86_400)).alias("last"))
    want = features(tape).join(last, "symbol").filter("bar < last").drop("last")
    columns = ["symbol", "bar", "close", "volume", "mean"]
    same(got, want, columns)
    # Batch 2 once more over the tail of batch 1: the same folders, the same rows.
    folders = sorted(p.name for p in (tmp_path / "root/tail").iterdir())
    assert folders == ["1", "2"]
    rows = {p: spark.read.parquet(f"{root}/{p}").collect() for p in ("tail/2", "out/2")}
    captured(features, root, tape.schema)(parts[2], 2)
    for p, before in rows.items():
        assert sorted(map(str, spark.read.parquet(f"{root}/{p}").collect())) == sorted(map(str, before))
    same(live.read_features(spark, root), want, columns)


def test_batches_larger_than_the_tail(spark, tape, tmp_path):
    """Batches with more trades than the tail keeps lose no bar, and the bars that features look back over are whole."""
    root = str(tmp_path / "root")
    replay(slices(tape, 3), lambda s: s, lambda s: live.bar_features(s, features, 86_400, root, keep=3, bars=3))
    last = tape.groupBy("symbol").agg(F.max(br.time_bin(F.col("ts"), 86_400)).alias("last"))
    same(live.read_features(spark, root), features(tape).join(last, "symbol").filter("bar < last").drop("last"), ["symbol", "bar", "close", "volume", "mean"])
    kept = spark.read.parquet(f"{root}/tail/2")
    assert kept.columns == tape.columns and kept.groupBy("symbol").agg(F.countDistinct(br.time_bin(F.col("ts"), 86_400)).alias("n")).filter("n > 3").count() == 0


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    def getValueState(self, name, schema):
        return Value()

    def listTimers(self):
        return []

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


def test_a_large_batch_is_no_list_of_python_rows():
    """Memory of merging 300,000 fills of one symbol, in frames as Spark hands them over, and the orders of a loop over them."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from tickloom.streaming.bars import Merger

    rng, n = np.random.default_rng(3), 300_000
    whole = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 150, n)), "ms"), "seq": np.arange(n), "price": rng.integers(1, 9, n) / 4.0, "qty": rng.integers(1, 9, n) * 1.0})
    whole["notional"], whole["side"] = whole["price"] * whole["qty"], np.where(rng.random(n) < 0.5, "buy", "sell")
    whole["first_id"] = whole["last_id"] = np.arange(n)
    whole["n_fills"] = 1
    want, p = 0, None
    for r in whole.itertuples(index=False):
        on = p and r.side == p.side and (r.ts - p.ts) < pd.Timedelta(milliseconds=100) and (r.price >= p.price if r.side == "buy" else r.price <= p.price)
        want, p = want + (not on), r
    whole = whole.sample(frac=1, random_state=1)
    merger = Merger(100)
    merger.init(Handle())
    parts = [whole[whole["seq"] < n // 2], whole[whole["seq"] >= n // 2]]
    tracemalloc.start()
    base = tracemalloc.get_traced_memory()[0]
    got = sum(len(f) for part in parts for f in merger.handleInputRows((1,), (part[a : a + 10_000] for a in range(0, len(part), 10_000)), None))
    peak = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    assert got == want - 1  # the last order is under way
    assert peak < 250 * n / 2


def test_bars_of_a_history_are_not_cut(spark, tape):
    """history_bars has every bar; warm_state keeps the last of the same bars."""
    whole = live.history_bars(tape, 4, 3_600_000).filter("n_trades = 4")
    warm = live.warm_state(tape, 4, keep=2, gap_ms=3_600_000).collect()
    count = {r["symbol"]: r["n"] for r in whole.groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    assert {r["symbol"]: r["n_bars"] for r in warm if r["n_bars"]} == count and max(count.values()) > 2
    rows = {(r["symbol"], r["bar_id"]): r.asDict() for r in whole.collect()}
    assert all(b == {k: rows[r["symbol"], b["bar_id"]][k] for k in b} for r in warm for b in json.loads(r["bars"] or "[]"))


def captured(features, root, schema):
    """The function that bar_features gives to foreachBatch."""
    held = []

    class Sink:
        def foreachBatch(self, f):
            held.append(f)

    class Tape:
        pass

    t = Tape()
    t.schema, t.writeStream = schema, Sink()
    live.bar_features(t, features, 86_400, root, keep=120)
    return held[0]


def test_live_source_over_restarts(spark, tmp_path):
    """The service grows between runs; every trade arrives once, in partitions of ids, and offsets are told."""
    from datetime import datetime

    from tickloom.sources.live import live_source, stream_live

    size, told = str(tmp_path / "size"), str(tmp_path / "told")

    def latest(symbol):
        with open(size) as f:
            return int(f.read()) - (symbol == "B")

    def fetch(symbol, start, limit):
        return [(symbol, i, datetime(2024, 1, 1), 1.0 + i, 2.0, "buy", i, i) for i in range(start, start + limit) if i % 7]  # ids may be missing

    def committed(end):
        with open(told, "a") as f:
            f.write(json.dumps(end) + "\n")

    spark.dataSource.register(live_source("trades_service", fetch, latest, page=10, committed=committed))
    for last in (25, 25, 60, 131):
        with open(size, "w") as f:
            f.write(str(last))
        out = stream_live(spark, "trades_service", ["A", "B"], from_id=3, partition_ids=20)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = [(r["symbol"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(rows) == sorted((s, i) for s, end in (("A", 131), ("B", 130)) for i in range(3, end + 1) if i % 7)
    assert json.loads(open(told).read().splitlines()[-1])["A"] >= 61
