"""Live page source: fetches a frontier of URLs over HTTP, politely.

URLs are dealt by host, so one task speaks to a host; requests start at most
``rate`` times a second per task, robots rules are asked first, failures become
rows with an error.  Nothing else in the package uses the network.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import urllib.robotparser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.config import Crawler
from docquarry.functions.urls import host


class Fetcher:
    def __init__(self, agent: str, timeout: float, rate: float):
        self.agent, self.timeout, self.wait = agent, timeout, 1 / rate
        self.robots: dict[str, urllib.robotparser.RobotFileParser] = {}
        self.last = 0.0

    def _open(self, url: str) -> str:
        time.sleep(max(0.0, self.last + self.wait - time.monotonic()))
        self.last = time.monotonic()
        asked = urllib.request.Request(url, headers={"User-Agent": self.agent})
        with urllib.request.urlopen(asked, timeout=self.timeout) as got:
            return got.read().decode(got.headers.get_content_charset() or "utf-8", "replace")

    def _allowed(self, url: str) -> bool:
        site = "{0.scheme}://{0.netloc}".format(urlsplit(url))
        if site not in self.robots:
            rules = urllib.robotparser.RobotFileParser()
            try:
                rules.parse(self._open(f"{site}/robots.txt").splitlines())
            except (OSError, ValueError):
                rules.parse([])
            self.robots[site] = rules
        return self.robots[site].can_fetch(self.agent, url)

    def fetch(self, url: str) -> tuple[str | None, str | None]:
        """(html, error)"""
        if urlsplit(url).scheme not in ("http", "https"):
            return None, "not an HTTP URL"
        try:
            return (self._open(url), None) if self._allowed(url) else (None, "disallowed by robots.txt")
        except (OSError, ValueError) as e:
            return None, f"{type(e).__name__}: {e}"[:200]


def fetch_pages(frontier: DataFrame, options: Crawler | None = None, tasks: int = 16) -> DataFrame:
    """(url, html, error) for every distinct row of ``frontier(url)``."""
    options = options or Crawler()

    def run(batches):
        fetcher = Fetcher(options.user_agent, options.page_timeout / 1000, options.default_rate_limit)
        for pdf in batches:
            found = [fetcher.fetch(u) for u in pdf["url"]]
            yield pd.DataFrame({"url": pdf["url"], "html": [h for h, _ in found], "error": [e for _, e in found]})

    urls = frontier.select("url").filter("url IS NOT NULL").distinct().withColumn("host", host(F.col("url")))
    return urls.repartition(tasks, "host").select("url").mapInPandas(run, "url string, html string, error string")
