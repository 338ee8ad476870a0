"""A streaming source for services that number trades by id and serve any range of ids again.

Offsets are ids: the next one of each symbol. A batch is a range of ids of each symbol, cut
into partitions, so a restarted or repeated batch asks for the same ids and gets the same
trades: with Spark's checkpoint and an idempotent or transactional sink, each arrives once.
The functions are the caller's: latest(symbol) -> last id there is, fetch(symbol, from_id,
limit) -> rows of ``SCHEMA`` by id. They run on the driver (latest) and on executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tickloom.sources.paged import SCHEMA


class IdRange(InputPartition):
    """Ids [low, high) of a symbol."""

    def __init__(self, symbol: str, low: int, high: int) -> None:
        self.symbol, self.low, self.high = symbol, low, high


def live_source(name: str, fetch: Callable[[str, int, int], list[tuple]], latest: Callable[[str], int], page: int = 1000, committed: Callable[[dict], None] | None = None) -> type[DataSource]:
    """A data source class with this name; register it with spark.dataSource.register.

    Options: symbols (comma-joined), from_id, partition_ids (ids of a partition). ``committed``
    is told each offset that Spark has stored as done.
    """

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict) -> None:
            self.symbols = [s for s in options.get("symbols", "").split(",") if s]
            self.first, self.size = int(options.get("from_id", 0)), int(options.get("partition_ids", 100_000))

        def initialOffset(self) -> dict:
            return dict.fromkeys(self.symbols, self.first)

        def latestOffset(self) -> dict:
            return {s: max(latest(s) + 1, self.first) for s in self.symbols}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            parts = []
            for s in end:  # a symbol that was added begins at from_id
                for low in range(start.get(s, self.first), end[s], self.size):
                    parts.append(IdRange(s, low, min(low + self.size, end[s])))
            return parts

        def read(self, partition: IdRange) -> Iterator[tuple]:
            at = partition.low
            while at < partition.high:
                rows = fetch(partition.symbol, at, min(page, partition.high - at))
                for r in rows:
                    if r[1] < partition.high:
                        yield tuple(r)
                if not rows or rows[-1][1] + 1 >= partition.high:
                    return
                at = rows[-1][1] + 1

        def commit(self, end: dict) -> None:
            if committed is not None:
                committed(end)

    class Live(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader(self.options)

    return Live


def stream_live(spark: SparkSession, name: str, symbols: list[str], from_id: int = 0, partition_ids: int = 100_000) -> DataFrame:
    """The stream of a registered live source."""
    return spark.readStream.format(name).options(symbols=",".join(symbols), from_id=str(from_id), partition_ids=str(partition_ids)).load()
