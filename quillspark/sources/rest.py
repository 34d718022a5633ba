"""A registry behind a REST interface as a Python data source: by ids in parallel, or page after page."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(url: str, tries: int = 4, wait: float = 1.0, open_=None) -> bytes:
    """Read a URL; transient errors are tried again after 1, 2, 4 ... times ``wait`` seconds."""
    for attempt in range(tries):
        try:
            with (open_ or urllib.request.urlopen)(url) as answer:
                return answer.read()
        except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
            if isinstance(error, urllib.error.HTTPError) and error.code < 500 and error.code != 429 or attempt == tries - 1:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError("unreachable")


class StudiesSource(DataSource):
    """Options: ``url``; ``ids`` (comma-separated) for one partition an id, or ``pageSize`` and ``maxStudies`` for a token chain."""

    @classmethod
    def name(cls) -> str:
        return "studies"

    def schema(self) -> str:
        return "id string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Part(InputPartition):
    def __init__(self, study: str | None):
        self.study = study


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[_Part]:
        ids = [i.strip() for i in self.options.get("ids", "").split(",") if i.strip()]
        return [_Part(i) for i in ids] or [_Part(None)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        base = self.options["url"].rstrip("/")
        if partition.study:
            yield partition.study, fetch(f"{base}/{urllib.parse.quote(partition.study)}").decode()
            return
        most, token, n = int(self.options.get("maxstudies", 1000)), None, 0
        while n < most:
            query = {"pageSize": self.options.get("pagesize", 100)} | ({"pageToken": token} if token else {})
            page = json.loads(fetch(f"{base}?{urllib.parse.urlencode(query)}"))
            for study in page.get("studies", [])[: most - n]:
                n += 1
                yield str(study.get("id", n)), json.dumps(study)
            token = page.get("nextPageToken")
            if not token:
                return
