"""A batch source for services that page trades by id, by Spark's Python data source interface.

The fetch function is the caller's: fetch(symbol, from_id, limit) -> rows. Symbols are
partitions, so they are read in parallel; a lost task reads its symbol again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "symbol string, seq long, ts timestamp, price double, qty double, side string, first_id long, last_id long"


def paged_source(name: str, fetch: Callable[[str, int, int], list[tuple]], page: int = 1000) -> type[DataSource]:
    """A data source class with this name; register it with spark.dataSource.register.

    Options: symbols (comma-joined), from_id, to_id. A page shorter than asked ends a symbol.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.symbols = [s for s in options.get("symbols", "").split(",") if s]
            self.low, self.high = int(options.get("from_id", 0)), int(options.get("to_id", 2**62))

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(s) for s in self.symbols]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            at = self.low
            while at <= self.high:
                rows = fetch(partition.value, at, page)
                for r in rows:
                    if r[1] <= self.high:
                        yield r
                if len(rows) < page:
                    return
                at = rows[-1][1] + 1

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Paged


def read_paged(spark: SparkSession, name: str, symbols: list[str], from_id: int = 0, to_id: int = 2**62):
    return spark.read.format(name).options(symbols=",".join(symbols), from_id=str(from_id), to_id=str(to_id)).load()
