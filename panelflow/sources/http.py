"""Levels over HTTP, as a Python data source: spark.read.format("http_levels").

Options: url (with {key}, and if the server can cut by time {from} and {to}), keys (comma-joined) or
key, date and value (columns of the CSV answer), timeout. Rows are (source_key, ts, level). Each key
is a partition, asked by a task of its own. Filters on source_key leave keys out, those on ts go into
the address; Spark applies what the server may not have. A key without an observation is an error,
or, with the option missing=skip, no row.
"""

from __future__ import annotations

import csv
import io
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "source_key string, ts timestamp_ntz, level double"


class HttpLevels(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_levels"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.keys = [k for k in options.get("keys", options.get("key", "")).split(",")]
        self.since = self.until = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keys are filtered here for good; the bounds of time are asked of the server and left to Spark as well."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column == "source_key" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = [k for k in self.keys if k in wanted]
                continue
            if column == "ts" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.since = max(f.value, self.since or f.value)
            if column == "ts" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.until = min(f.value, self.until or f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in self.keys]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        o, key = self.options, partition.value
        bounds = {"from": self.since.isoformat() if self.since else "", "to": self.until.isoformat() if self.until else ""}
        url = o["url"].format_map({"key": urllib.parse.quote(key, safe="")} | bounds)
        with urllib.request.urlopen(url, timeout=float(o.get("timeout", "30"))) as answer:
            text = answer.read().decode()
        try:
            rows = parse(text, o.get("date", "Date"), o.get("value", "Close"))
        except ValueError:
            if o.get("missing") != "skip":
                raise
            rows = []
        times, levels = [t for t, _ in rows], [x for _, x in rows]
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.string()), pa.array(times, pa.timestamp("us")), pa.array(levels, pa.float64())], names=["source_key", "ts", "level"])


def parse(text: str, date: str, value: str) -> list[tuple[datetime, float]]:
    """Rows of a CSV answer with a number; none at all is an error."""
    rows = []
    for row in csv.DictReader(io.StringIO(text)):
        try:
            rows.append((datetime.fromisoformat(row[date]), float(row[value])))
        except (ValueError, TypeError):
            continue
    if not rows:
        raise ValueError("the answer holds no observation")
    return rows


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HttpLevels)
