"""Web pages as a Spark data source: ``spark.read.format("web_pages")`` fetches the addresses of a file, some to each task.

Options: ``urls`` (JSON list of addresses, or of objects with ``url, etag, last_modified``), ``agent``, ``timeout`` (20 seconds), ``most_bytes`` (4 MiB),
``partitions`` (8) and ``pause`` (seconds between two requests of a task to one host, 1). Redirects are not followed. A request that fails,
or whose body is too large, is a row with a null status and the reason.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, content_type string, location string, etag string, last_modified string, body string, fetched_at double, error string"


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_: object) -> None:
        return None


def fetch(url: str, etag: str | None = None, last_modified: str | None = None, agent: str = "larkspur", timeout: float = 20.0, most_bytes: int = 4 << 20) -> tuple:
    """One request as a row of ``SCHEMA``; what is known of an earlier answer is sent along, so that a page that has not changed answers 304."""
    headers = {"User-Agent": agent, "Accept": "text/html,application/xhtml+xml;q=0.9,*/*;q=0.1"}
    headers |= {k: v for k, v in (("If-None-Match", etag), ("If-Modified-Since", last_modified)) if v}
    now = time.time()
    try:
        opener = urllib.request.build_opener(_Stay)
        try:
            answer = opener.open(urllib.request.Request(url, headers=headers), timeout=timeout)
        except urllib.error.HTTPError as e:
            answer = e
        with answer:
            raw = answer.read(most_bytes + 1)
            if len(raw) > most_bytes:
                raise ValueError("the body is too large")
            h = answer.headers
            text = raw.decode(h.get_content_charset() or "utf-8", "replace")
            return (url, answer.status, h.get("Content-Type"), h.get("Location"), h.get("ETag"), h.get("Last-Modified"), text, now, None)
    except Exception as e:  # noqa: BLE001 - whatever goes wrong with one address is told in its row
        return (url, None, None, None, None, None, None, now, f"{type(e).__name__}: {e}")


class _Part(InputPartition):
    def __init__(self, rows: list[dict]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows = [{"url": x} if isinstance(x, str) else x for x in json.loads(options.get("urls", "[]"))]
        self.count = max(1, int(options.get("partitions", 8)))
        self.pause = float(options.get("pause", 1.0))
        self.settings = {"agent": options.get("agent", "larkspur"), "timeout": float(options.get("timeout", 20)), "most_bytes": int(options.get("most_bytes", 4 << 20))}

    def partitions(self) -> list[InputPartition]:
        """All addresses of a host go to one task, which waits between them."""
        parts: list[list[dict]] = [[] for _ in range(self.count)]
        hosts: dict[str, int] = {}
        for row in self.rows:
            parts[hosts.setdefault(urlsplit(row["url"]).netloc, len(hosts)) % self.count].append(row)
        return [_Part(p) for p in parts if p] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        last: dict[str, float] = {}
        for row in partition.rows:
            host = urlsplit(row["url"]).netloc
            time.sleep(max(0.0, last.get(host, 0.0) + self.pause - time.monotonic()))
            yield fetch(row["url"], row.get("etag"), row.get("last_modified"), **self.settings)
            last[host] = time.monotonic()


class WebPages(DataSource):
    """The data source ``web_pages``."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``web_pages`` known to the session."""
    spark.dataSource.register(WebPages)
