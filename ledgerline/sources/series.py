"""A data source for dated series that a server gives by id.

    spark.dataSource.register(SeriesSource)
    spark.read.format("series").option("url", "https://host/csv?id={id}").option("ids", "GS10,TB3MS").load()

Each series is a partition, so series load side by side and a lost task repeats its own. Certificates are
always verified.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import ssl
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What a server answers if trying again may help (fixed values of the protocol).
PASSING = (408, 429, 500, 502, 503, 504)


def fetch(url: str, attempts: int, wait: float, timeout: float) -> str:
    """The text at ``url``; errors that may pass are tried again after 1, 2, 4, ... times ``wait`` seconds."""
    if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"not a web address: {url}")
    for k in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=timeout, context=ssl.create_default_context()) as answer:
                return answer.read().decode("utf-8-sig")
        except urllib.error.HTTPError as e:
            if e.code not in PASSING or k == attempts - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if isinstance(getattr(e, "reason", None), ssl.SSLError) or k == attempts - 1:
                raise
        time.sleep(wait * 2**k)
    raise ValueError("attempts must be 1 or more")


def observations(text: str) -> Iterator[tuple[dt.date, float | None]]:
    """(date, value) of the lines of a CSV text with a header; a value that is no number is null."""
    lines = csv.reader(io.StringIO(text))
    next(lines, None)
    for row in lines:
        if len(row) < 2:
            continue
        try:
            value = float(row[1])
        except ValueError:
            value = None
        yield dt.date.fromisoformat(row[0].strip()), value if value is not None and abs(value) != float("inf") and value == value else None


class SeriesSource(DataSource):
    """Options: url (with ``{id}``), ids (comma-separated), attempts, wait and timeout (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> str:
        return "series_id string, date date, value double"

    def reader(self, schema) -> DataSourceReader:
        return SeriesReader(self.options)


class SeriesReader(DataSourceReader):
    def __init__(self, options):
        self.url = options["url"]
        self.ids = list(dict.fromkeys(x.strip() for x in options["ids"].split(",") if x.strip()))
        self.attempts, self.wait, self.timeout = int(options.get("attempts", 3)), float(options.get("wait", 1)), float(options.get("timeout", 30))
        if "{id}" not in self.url or not self.ids:
            raise ValueError("url needs {id}, and ids a series at least")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in self.ids]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url = self.url.replace("{id}", urllib.parse.quote(partition.value, safe=""))
        for date, value in observations(fetch(url, self.attempts, self.wait, self.timeout)):
            yield partition.value, date, value
