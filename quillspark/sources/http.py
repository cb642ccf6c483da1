"""Lines over HTTP as a data source: files are cut into ranges of bytes, requests are repeated when they fail.

``spark.dataSource.register(HttpLines)``, then ``spark.read.format("http_lines").options(urls=..., part_bytes=..., retries=..., timeout=...).load()``
gives a row (url, at, line) for each line, ``at`` being the byte where it begins in the file as it is served.
A line belongs to the range in which it begins, so ranges need not know of each other. Servers that take no ranges, and compressed files, are read by one task each.
"""

from __future__ import annotations

import gzip
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, attempts of a request after the first, seconds of a time-out and between attempts (doubled each time), lines of a batch.
PART_BYTES, RETRIES, TIMEOUT, PAUSE, LINES = 64 << 20, 3, 30.0, 0.5, 4096
#: Answers after which a request is not repeated.
FINAL = frozenset((400, 401, 403, 404, 405, 410, 416))


@dataclass
class Part(InputPartition):
    """Bytes ``begin`` to ``end`` of a file; without an end, all of it in one stream."""

    url: str
    begin: int = 0
    end: int | None = None

    def __post_init__(self) -> None:
        super().__init__(self.url)


class HttpLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_lines"

    def schema(self) -> str:
        return "url string, at bigint, line string"

    def reader(self, schema: Any) -> DataSourceReader:
        return HttpReader({k.lower(): v for k, v in self.options.items()})


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = options.get("urls", "").split()
        if not self.urls:
            raise ValueError("option urls: addresses with white space between")
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.retries, self.timeout = int(options.get("retries", RETRIES)), float(options.get("timeout", TIMEOUT))

    def open(self, url: str, headers: dict[str, str] | None = None, method: str = "GET") -> Any:
        pause = PAUSE
        for attempt in range(self.retries + 1):
            try:
                return urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}, method=method), timeout=self.timeout)
            except OSError as e:
                if attempt == self.retries or isinstance(e, urllib.error.HTTPError) and e.code in FINAL:
                    raise OSError(f"cannot read {url}: {e}") from e
                time.sleep(pause)
                pause *= 2

    def partitions(self) -> list[InputPartition]:
        """Ranges of every file whose server says how long it is and that it takes ranges."""
        out: list[InputPartition] = []
        for url in self.urls:
            if url.partition("?")[0].endswith(".gz"):
                out.append(Part(url))
                continue
            try:
                with self.open(url, method="HEAD") as head:
                    size, ranges = int(head.headers.get("Content-Length") or 0), head.headers.get("Accept-Ranges") == "bytes"
            except OSError:  # some servers answer no such question; reading tells whether the file is there
                size, ranges = 0, False
            cuts = range(0, size, self.part_bytes) if ranges and size else ()
            out += [Part(url, b, min(b + self.part_bytes, size)) for b in cuts] or [Part(url)]
        return out

    def _chunks(self, part: Part) -> Iterator[bytes]:
        """The bytes of a part from one before its begin on, going on where a broken connection left off."""
        if part.end is None:
            with self.open(part.url) as answer:
                stream = gzip.open(answer) if part.url.partition("?")[0].endswith(".gz") else answer
                while data := stream.read(1 << 20):
                    yield data
            return
        at, left = max(part.begin - 1, 0), self.retries
        while True:
            try:
                with self.open(part.url, {"Range": f"bytes={at}-"}) as answer:
                    if at and answer.status != 206:
                        raise OSError(f"cannot read {part.url}: the server does not keep to ranges")
                    while data := answer.read(1 << 16):
                        at += len(data)
                        yield data
                    length = answer.headers.get("Content-Range", "").rpartition("/")[2]
                    if not length.isdigit() or at >= int(length):
                        return
                    raise ConnectionError("the connection ended early")
            except (OSError, EOFError) as e:
                if not left or "cannot read" in str(e):
                    raise OSError(f"cannot read {part.url}: {e}") from e
                left -= 1
                time.sleep(PAUSE)

    def _lines(self, part: Part) -> Iterator[tuple[int, bytes]]:
        at, held = max(part.begin - 1, 0) if part.end is not None else 0, b""
        skip = part.begin > 0  # the rest of a line that begins before
        for data in self._chunks(part):
            held += data
            *whole, held = held.split(b"\n")
            for line in whole:
                if skip:
                    skip = False
                elif part.end is not None and at >= part.end:
                    return
                else:
                    yield at, line
                at += len(line) + 1
            if not skip and part.end is not None and at >= part.end:
                return
        if held and not skip and (part.end is None or at < part.end):
            yield at, held

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        places: list[int] = []
        lines: list[str] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.url] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], names=["url", "at", "line"])

        for at, line in self._lines(partition):
            places.append(at)
            lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
            if len(lines) == LINES:
                yield batch()
                places, lines = [], []
        if lines:
            yield batch()
