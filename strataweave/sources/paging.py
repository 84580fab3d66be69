"""A Python data source for paged APIs: one partition per page, the fetcher is given, so tests and offline builds need no network."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, offset: int, follow: bool = False):
        self.offset, self.follow = offset, follow


def paged_source(name: str, schema: str, fetch: Callable[[int, int], list[dict]], size: int = 100) -> type[DataSource]:
    """A data source class to register: ``fetch(offset, limit)`` gives the rows of a page.

    Option ``total`` says how many rows there are: then every page is a partition. Without it one task asks page after page until a short one.
    """
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.total = options.get("total")

        def partitions(self):
            if self.total is None:
                return [Page(0, True)]
            return [Page(k) for k in range(0, int(self.total), size)] or [Page(0)]

        def read(self, partition):
            at = partition.offset
            while True:
                rows = fetch(at, size)
                for row in rows:
                    yield tuple(json.dumps(row[c]) if isinstance(row.get(c), (dict, list)) else row.get(c) for c in columns)
                if not partition.follow or len(rows) < size:
                    return
                at += size

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options)

    return Paged


def count_by_paging(fetch: Callable[[int, int], list[dict]], size: int = 100, most: int = 100_000) -> int:
    """Rows of an API that tells no total: pages are asked until a short one; more than ``most`` is an error, not an end."""
    n = 0
    while True:
        got = len(fetch(n, size))
        n += got
        if got < size:
            return n
        if n >= most:
            raise ValueError(f"the source has {most} rows or more")


def with_retries(call: Callable[[], object], retryable=(408, 425, 429, 500, 502, 503, 504), attempts: int = 4, base_ms: int = 500, sleep=None):
    """Calls until it succeeds; errors with a ``status`` that is retryable wait 500, 1000, 2000 ms."""
    import time

    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if getattr(e, "status", None) not in retryable or k == attempts - 1:
                raise
            (sleep or time.sleep)(base_ms * 2**k / 1000)


def tile_plan(south: float, west: float, north: float, east: float, zoom: int, most: int) -> tuple[int, list[tuple[int, int]]]:
    """(zoom, tiles): the zoom falls until at most ``most`` tiles cover the box."""
    import math

    def ty(lat, z):
        r = math.radians(lat)
        return int((1 - math.asinh(math.tan(r)) / math.pi) / 2 * 2**z)

    for z in range(zoom, -1, -1):
        x0, x1 = (int((lon + 180) / 360 * 2**z) for lon in (west, east))
        y0, y1 = ty(north, z), ty(south, z)
        if (x1 - x0 + 1) * (y1 - y0 + 1) <= most or z == 0:
            return z, [(x, y) for y in range(y0, y1 + 1) for x in range(min(x0, 2**z - 1), min(x1, 2**z - 1) + 1)]
    raise AssertionError
