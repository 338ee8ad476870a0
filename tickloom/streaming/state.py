"""Live indicators and the shock and recovery machine over a bounded history of event time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.streaming.ordered import PIECE, ordered, pieces

OUT = "symbol long, ts timestamp, seq long, imbalance double, impact double, spread_pct double, phase string, signal int"
_ROW = "ms long, seq long, price double, qty double, buy boolean"


class Window:
    """Trades of the last ms with running sums, and the highest and lowest price kept in order; each trade enters and leaves once."""

    def __init__(self, ms: int, trades: list[tuple]) -> None:
        self.ms, self.trades, self.high, self.low = ms, deque(), deque(), deque()
        self.volume = self.net = 0.0
        for t in trades:
            self.add(t)

    def add(self, trade: tuple) -> None:
        at, _, price, qty, buy = trade
        while self.trades and self.trades[0][0] <= at - self.ms:
            _, _, _, q, b = self.trades.popleft()
            self.volume, self.net = self.volume - q, self.net - (q if b else -q)
        if not self.trades:  # no rounding is carried into an empty window
            self.volume = self.net = 0.0
        self.trades.append(trade)
        self.volume, self.net = self.volume + qty, self.net + (qty if buy else -qty)
        for kept, worse in ((self.high, lambda p: p <= price), (self.low, lambda p: p >= price)):
            while kept and kept[0][0] <= at - self.ms:
                kept.popleft()
            while kept and worse(kept[-1][1]):
                kept.pop()
            kept.append((at, price))

    @property
    def width(self) -> float:
        return self.high[0][1] - self.low[0][1]


class Microstructure(StatefulProcessor):
    """Rolling sums over window_ms, a percentile of the price range, and a machine that goes from
    calm to shock when imbalance and impact are large, and signals against the move when they ease
    before timeout_ms. State is the trades of the window and the phase."""

    def __init__(self, window_ms: int = 5000, imbalance: float = 0.6, impact: float = 0.002, timeout_ms: int = 30_000, history: int = 200) -> None:
        self.window_ms, self.imbalance, self.impact, self.timeout_ms, self.history = window_ms, imbalance, impact, timeout_ms, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trades = handle.getListState("trades", _ROW)
        self.ranges = handle.getListState("ranges", "v double")
        self.phase = handle.getValueState("phase", "phase string, since long, side int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        window = Window(self.window_ms, [tuple(t) for t in self.trades.get()] if self.trades.exists() else [])
        ranges = [t[0] for t in self.ranges.get()] if self.ranges.exists() else []
        phase, since, side = self.phase.get() if self.phase.exists() else ("calm", 0, 0)
        out = []
        t = ordered(rows, ["ts", "seq", "price", "qty", "side"], ("ts", "seq"))
        t["ms"] = t["ts"].astype("datetime64[ms]").astype(np.int64)
        for i, (ms, seq, price, qty, trade_side) in enumerate(pieces(t, ["ms", "seq", "price", "qty", "side"])):
            window.add((ms, int(seq), float(price), float(qty), trade_side == "buy"))
            imbalance, impact = window.net / (window.volume + 1e-10), window.trades[-1][2] / window.trades[0][2] - 1
            width = window.width
            pct = 100.0 * sum(v < width for v in ranges) / len(ranges) if ranges else 0.0
            ranges = (ranges + [width])[-self.history :]
            signal = 0
            if phase == "calm" and abs(imbalance) >= self.imbalance and abs(impact) >= self.impact:
                phase, since, side = "shock", ms, 1 if impact > 0 else -1
            elif phase == "shock":
                if ms - since > self.timeout_ms:
                    phase = "calm"
                elif abs(imbalance) < self.imbalance / 2:
                    phase, signal = "calm", -side
            out.append((key[0], t["ts"][i], seq, imbalance, impact, pct, phase, signal))
            if len(out) == PIECE:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])
                out = []
        self.trades.put(list(window.trades))
        self.ranges.put([(v,) for v in ranges])
        self.phase.update((phase, since, side))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    def close(self) -> None:
        pass


def microstructure_stream(tape: DataFrame, **options) -> DataFrame:
    return tape.groupBy("symbol").transformWithStateInPandas(Microstructure(**options), OUT, "Append", "None")
