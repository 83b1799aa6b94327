"""A Python data source that fetches pages: ``spark.read.format("web_pages")`` after
``register(spark)``, with ``option("urls", ...)`` (one per line) or ``option("path",
...)`` (a text file of urls). Each partition fetches a batch of urls; a page that
fails has a null body and its error. Any scheme urllib knows works, ``file:`` too."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, endpoint_id string, content_type string, content_length bigint, body binary, total_bytes bigint, error string"


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class WebPagesReader(DataSourceReader):
    def __init__(self, options):
        text = options.get("urls")
        if text is None:
            with open(options["path"], encoding="utf-8") as f:
                text = f.read()
        self.urls = [u.strip() for u in text.splitlines() if u.strip()]
        self.batch = max(1, int(options.get("urlsPerPartition", "64")))
        self.timeout = float(options.get("timeout", "30"))
        self.endpoint = options.get("endpointId")

    def partitions(self) -> list[InputPartition]:
        return [_Urls(self.urls[i : i + self.batch]) for i in range(0, len(self.urls), self.batch)] or [_Urls([])]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        from urllib.parse import urlsplit
        from urllib.request import urlopen

        for url in partition.urls:
            endpoint = self.endpoint or urlsplit(url).hostname or "unknown"
            try:
                with urlopen(url, timeout=self.timeout) as r:
                    body = r.read()
                    length = r.headers.get("Content-Length")
                    yield url, endpoint, r.headers.get("Content-Type"), int(length) if length and length.isdigit() else None, body, len(body), None
            except Exception as e:  # noqa: BLE001  a page that can't be had is a row, not a failed job
                yield url, endpoint, None, None, None, None, f"{type(e).__name__}: {e}"


class WebPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WebPagesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)
