"""A paged, keyed time-series API as a Spark data source.

One partition for each (symbol, month), read page by page with a cursor. The
fetching itself is a callable that the user registers, since no network is
assumed here: fetch(symbol, start_ms, end_ms, limit) -> list of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, int, int, int], list[tuple]]
MONTH_MS = 30 * 86_400_000


class Slice(InputPartition):
    def __init__(self, symbol: str, start: int, end: int):
        self.symbol, self.start, self.end = symbol, start, end


def pages(fetch: Fetch, symbol: str, start: int, end: int, limit: int) -> Iterator[tuple]:
    """Rows with start <= time < end in order, each time once; the next page begins after the last time seen."""
    cursor = start
    while cursor < end:
        got = sorted(r for r in fetch(symbol, cursor, end, limit) if cursor <= r[0] < end)
        yield from ((symbol, *r) for r in got)
        if len(got) < limit:
            return
        cursor = got[-1][0] + 1


def register(spark: SparkSession, name: str, fetch: Fetch, schema: str, limit: int = 1000) -> None:
    """Make ``spark.read.format(name)`` read by ``fetch``; options: symbols (comma-separated), start_ms, end_ms."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.symbols = [s.strip().upper() for s in options["symbols"].split(",") if s.strip()]
            self.start, self.end = int(options["start_ms"]), int(options["end_ms"])

        def partitions(self):
            return [Slice(s, at, min(at + MONTH_MS, self.end)) for s in self.symbols for at in range(self.start, self.end, MONTH_MS)]

        def read(self, partition):
            yield from pages(fetch, partition.symbol, partition.start, partition.end, limit)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"symbol string, {schema}"

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Source)
