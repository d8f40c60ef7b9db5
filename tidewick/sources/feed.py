"""A Python data source of bars: files by ticker, planned as (ticker, span of days) partitions, with both pushed down.

    register(spark)
    spark.read.format("bars_feed").option("days", 365).load(folder).where("ticker = 'N' and date >= '2024-01-01'")

The folder holds Parquet files under ticker=... , as write_table() and per_ticker() leave them. A filter on ticker drops
folders before they are looked into, one on date drops spans, and a task reads its span's rows only. As a stream, the offset
is a day, and a batch has the days after the last one.
"""

from __future__ import annotations

import datetime as dt
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double"
FIELDS = pa.schema([("date", pa.date32()), ("ticker", pa.string()), *((c, pa.float64()) for c in ("open", "high", "low", "close", "adj_close", "volume"))])
_FIRST, _LAST = dt.date(1, 1, 1), dt.date(9999, 12, 31)


@dataclass
class Span(InputPartition):
    """The bars of a ticker on days low..high."""

    folder: str
    ticker: str
    low: dt.date
    high: dt.date


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _folders(path: str) -> dict[str, str]:
    """Folders by ticker."""
    fs, root = open_folder(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return {urllib.parse.unquote(f.base_name.split("=", 1)[1]): f.path for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith("ticker=")}


def _days(path: str, folder: str) -> tuple[dt.date, dt.date] | None:
    """The first and last day in a folder, from the files' statistics; only their ends are read."""
    fs, _ = open_folder(path)
    low, high = [], []
    for piece in ds.dataset(folder, filesystem=fs, format="parquet").get_fragments():
        piece.ensure_complete_metadata()
        for group in piece.row_groups:
            if found := (group.statistics or {}).get("date"):
                low.append(found["min"])
                high.append(found["max"])
            elif group.num_rows:
                return _FIRST, _LAST
    return (min(low), max(high)) if low else None


def read_span(path: str, span: Span) -> Iterator[pa.RecordBatch]:
    fs, _ = open_folder(path)
    data = ds.dataset(span.folder, filesystem=fs, format="parquet")
    names = [c for c in FIELDS.names if c in data.schema.names]
    kept = (ds.field("date") >= pa.scalar(span.low, pa.date32())) & (ds.field("date") <= pa.scalar(span.high, pa.date32()))
    for batch in data.to_batches(columns=names, filter=kept):
        if batch.num_rows:
            columns = [pa.array([span.ticker] * batch.num_rows) if f.name == "ticker" else batch.column(names.index(f.name)).cast(f.type) if f.name in names else pa.nulls(batch.num_rows, f.type) for f in FIELDS]
            yield pa.record_batch(columns, schema=FIELDS)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.days = options["path"], int(options.get("days", 365))
        self.tickers: set[str] | None = set(options["tickers"].split(",")) if options.get("tickers") else None
        self.low, self.high = _FIRST, _LAST

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality and lists on ticker, and bounds on date; returns the rest."""
        for f in filters:
            column = f.attribute
            if column == ("ticker",) and isinstance(f, EqualTo | In):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.tickers = wanted if self.tickers is None else self.tickers & wanted
            elif column == ("date",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                day = dt.timedelta(days=1)
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + day if isinstance(f, GreaterThan) else f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value - day if isinstance(f, LessThan) else f.value)
            else:
                yield f

    def partitions(self) -> list[Span]:
        out = []
        for ticker, folder in sorted(_folders(self.path).items()):
            if self.tickers is not None and ticker not in self.tickers:
                continue
            known = _days(self.path, folder)
            if known is None:
                continue
            low, high = max(known[0], self.low), min(known[1], self.high)
            while low <= high:
                end = high if (high - low).days < self.days else low + dt.timedelta(days=self.days - 1)
                out.append(Span(folder, ticker, low, end))
                if end == high:
                    break
                low = end + dt.timedelta(days=1)
        return out

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # a plan without partitions is read as well
            yield from read_span(self.path, partition)


class FeedStream(DataSourceStreamReader):
    """Offsets are days; a batch has a partition a ticker for the days after the last offset."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.start = options.get("start", "0001-01-01")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"day": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        known = [d for f in _folders(self.path).values() if (d := _days(self.path, f))]
        return {"day": max([self.start, *(d[1].isoformat() for d in known)])}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        low, high = dt.date.fromisoformat(start["day"]) + dt.timedelta(days=1), dt.date.fromisoformat(end["day"])
        return [Span(folder, ticker, low, high) for ticker, folder in sorted(_folders(self.path).items())] if low <= high else []

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # a plan without partitions is read as well
            yield from read_span(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class BarsFeed(DataSource):
    """Options: path; tickers, comma-separated; days of a partition; start, the day after which a stream begins."""

    @classmethod
    def name(cls) -> str:
        return "bars_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStream:  # noqa: N802
        return FeedStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarsFeed)
