"""Pages by URL through a client that the caller gives: robots' rules first, one origin in one task, nothing fetched twice.

A client is a function that workers can import or unpickle: url -> (status, body). It follows no redirects; `replay`
makes one from recorded answers, so that jobs run offline and give the same result again. An origin's pages are fetched
one after another in one task, as its rate limit asks for; many origins run side by side.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unescaped
from ..functions.workers import ready

Client = Callable[[str], tuple[int, str]]
FETCHED = "url string, outcome string, status int, body string, error string, retryable boolean"
#: Answers by which a server refuses access; they are taken as they are.
REFUSED = (401, 403, 429)
# Agents whose denial counts for every agent, so that a name of one's own is no way round it.
IDENTITIES = (
    "ChatGPT-User",
    "GPTBot",
    "OAI-SearchBot",
)


def replay(answers: dict[str, tuple[int, str]]) -> Client:
    """A client of recorded answers; any other page is missing."""
    return lambda url: answers.get(url, (404, ""))


def origin(url: Column) -> Column:
    return F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))))


class _Origin:
    """What an origin's robots.txt allows."""

    def __init__(self, name: str, client: Client, agent: str, interval: float):
        self.agents, self.refusal, self.rules = (agent, *IDENTITIES), None, RobotFileParser()
        status, body = client(name + "/robots.txt")
        if status in REFUSED or 300 <= status < 400:
            self.refusal = f"HTTP {status} at robots.txt"
        elif status >= 400 and status != 404:
            self.refusal = f"robots.txt can't be read: HTTP {status}"
        self.unread = bool(self.refusal) and status >= 500
        self.rules.parse(body.splitlines() if status == 200 else [])
        self.interval = max(interval, *(float(self.rules.crawl_delay(a) or 0) for a in self.agents))

    def get(self, url: str, client: Client) -> tuple:
        if self.refusal:
            return "failed" if self.unread else "blocked", None, None, self.refusal, self.unread
        if not all(self.rules.can_fetch(a, url) for a in self.agents):
            return "blocked", None, None, "robots.txt disallows it", False
        if self.interval:
            time.sleep(self.interval)
        status, body = client(url)
        if status in REFUSED:
            return "blocked", status, None, f"HTTP {status}", False
        if 300 <= status < 400:
            return "blocked", status, None, f"HTTP {status}: redirect not followed", False
        if status != 200:
            return "failed", status, None, f"HTTP {status}", status >= 500
        return "fetched", status, body, None, False


def fetch(urls: DataFrame, url_col: str, client: Client, agent: str, cache: DataFrame | None = None, interval: float = 0.0) -> DataFrame:
    """(url, outcome, status, body, error, retryable) for each distinct URL: cached, fetched, blocked or failed.

    cache: (url, body) of what is there already, a row for each URL; it is never asked for again. A null URL has no row;
    one that is no URL fails."""
    ready(urls.sparkSession)
    wanted = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct()
    known = None
    if cache is not None:
        held = wanted.join(cache.select("url", "body"), "url")
        known = held.select("url", F.lit("cached").alias("outcome"), F.lit(None).cast("int").alias("status"), "body", F.lit(None).cast("string").alias("error"), F.lit(False).alias("retryable"))
        wanted = wanted.join(cache.select("url"), "url", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rules = None, None
        for part in parts:
            rows = []
            for url, name in zip(part["url"], part["origin"], strict=True):
                try:
                    if not isinstance(name, str):
                        raise ValueError("no URL")
                    if name != now:
                        rules, now = _Origin(name, client, agent, interval), name
                    rows.append((url, *rules.get(url, client)))
                except Exception as e:  # noqa: BLE001  a client's own errors are outcomes, not the job's end
                    rows.append((url, "failed", None, None, f"{type(e).__name__}: {e}", not isinstance(e, ValueError)))
            out = pd.DataFrame(rows, columns=[f.strip().split(" ")[0] for f in FETCHED.split(",")])
            yield out.astype({"status": "Int32"})

    dealt = wanted.withColumn("origin", origin(F.col("url"))).repartition("origin").sortWithinPartitions("origin", "url")
    got = dealt.mapInPandas(run, FETCHED)
    return got if known is None else known.unionByName(got)


def page_fields(pages: DataFrame, html_col: str, fields: dict[str, str]) -> DataFrame:
    """pages with a column for each field: what the first group of its pattern finds, character references read; null if nothing."""
    found = {name: unescaped(F.nullif(F.regexp_extract(html_col, pattern, 1), F.lit(""))) for name, pattern in fields.items()}
    return pages.withColumns(found)
