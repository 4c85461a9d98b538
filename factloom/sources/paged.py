"""A paged web service as a data source: one partition for each page, retries for busy or failing servers."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(url: str, tries: int = 3, pause: float = 0.5) -> dict:
    """The JSON at ``url``; answers 429 and 5xx are tried again, with longer pauses, and the last one is raised."""
    for n in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=30) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if n + 1 == tries or not (e.code == 429 or e.code >= 500):
                raise
        time.sleep(pause * 2**n)
    raise AssertionError


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options, schema):
        self.url, self.pages, self.names = options["url"], int(options["pages"]), schema.fieldNames()
        self.pause = float(options.get("pause", 0.5))

    def partitions(self):
        return [Page(i) for i in range(1, self.pages + 1)]

    def read(self, partition):
        for item in fetch(self.url.replace("{page}", str(partition.number)), pause=self.pause)["items"]:
            yield tuple(item.get(n) for n in self.names)


class PagedSource(DataSource):
    """``spark.read.format("paged").schema(...).option("url", "http://.../{page}").option("pages", n).load()``; items lie under ``items``."""

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "id string, text string"

    def reader(self, schema):
        return PagedReader(self.options, schema)
