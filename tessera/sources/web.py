"""Web pages: URL checks in SQL functions, private addresses, robots rules, main text."""

from __future__ import annotations

import ipaddress
from html.parser import HTMLParser
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_TEXT, MAX_BYTES = 50, 5 * 1024 * 1024


def url_problem(url: Column) -> Column:
    """bad_scheme, no_host, credentials, or null if the URL may be fetched."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    scheme = F.lower(part("PROTOCOL"))
    return F.when(scheme.isNull() | ~scheme.isin("http", "https"), "bad_scheme").when(F.coalesce(part("HOST"), F.lit("")) == "", "no_host").when(part("USERINFO").isNotNull(), "credentials")


@F.pandas_udf(T.BooleanType())
def is_private(hosts: pd.Series) -> pd.Series:
    """Whether a literal host is a private, loopback, link-local or reserved address; names are only checked for localhost."""

    def one(host):
        if host is None:
            return None
        if host.lower() in ("localhost", "localhost.localdomain"):
            return True
        try:
            a = ipaddress.ip_address(host.strip("[]"))
        except ValueError:
            return False
        return a.is_private or a.is_loopback or a.is_link_local or a.is_reserved

    return hosts.map(one)


def robots_allowed(pages: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """pages(url, ...) with allowed, by robots(host, status, body); no rules or an error status allow."""

    @F.pandas_udf("boolean")
    def allowed(urls: pd.Series, bodies: pd.Series) -> pd.Series:
        known: dict = {}

        def one(url, body):
            if body is None:
                return True
            if body not in known:
                known[body] = RobotFileParser()
                known[body].parse(body.splitlines())
            return known[body].can_fetch(agent, url)

        return pd.Series([one(u, b) for u, b in zip(urls, bodies)], dtype=object)

    rules = robots.select(F.col("host").alias("_host"), F.when(F.col("status") < 400, F.col("body")).alias("_body"))
    hosted = pages.withColumn("_host", F.lower(F.try_parse_url("url", F.lit("HOST"))))
    return hosted.join(rules, "_host", "left").withColumn("allowed", allowed("url", "_body")).drop("_host", "_body")


class _Main(HTMLParser):
    """Title, and the text of block elements outside navigation, scripts and styles (inside main or article, if there)."""

    SKIP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "template"}
    BLOCK = {"p", "h1", "h2", "h3", "h4", "li", "td", "blockquote", "pre", "div", "section", "article", "main", "br", "tr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip = self.main = 0
        self.in_title = False
        self.title, self.all, self.inside = [], [], []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        self.main += tag in ("main", "article")
        self.in_title = self.in_title or tag == "title"
        if tag in self.BLOCK:
            self._put("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        if tag in self.BLOCK:
            self._put("\n")
        self.main -= tag in ("main", "article") and self.main > 0
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self._put(data)

    def _put(self, text):
        self.all.append(text)
        if self.main:
            self.inside.append(text)


def main_text(html: str | None) -> tuple[str, str]:
    """(title, text) of a page, one line for each block."""
    tool = _Main()
    tool.feed(html or "")
    tool.close()
    chosen = "".join(tool.inside) if "".join(tool.inside).strip() else "".join(tool.all)
    lines = (" ".join(x.split()) for x in chosen.split("\n"))
    return " ".join("".join(tool.title).split()), "\n".join(x for x in lines if x)


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, title, text, problem) of pages(key, url, html): the first check that fails, else too_short under MIN_TEXT characters."""

    @F.pandas_udf("title string, text string")
    def parse(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([main_text(h) for h in html], columns=["title", "text"])

    df = pages.select(key, "url", parse(F.col("html")).alias("m"), F.octet_length("html").alias("size"), is_private(F.try_parse_url("url", F.lit("HOST"))).alias("private"))
    problem = F.coalesce(url_problem(F.col("url")), F.when(F.col("private"), "private_address"), F.when(F.col("size") > MAX_BYTES, "too_large"), F.when(F.length("m.text") < MIN_TEXT, "too_short"))
    return df.select(key, "m.title", "m.text", problem.alias("problem"))


def binary_problem(content: Column, magic: bytes = b"%PDF", limit: int = 10 * 1024 * 1024) -> Column:
    """too_large or bad_magic of a binary file, before anything is parsed."""
    return F.when(F.octet_length(content) > limit, "too_large").when(F.substring(content, 1, len(magic)) != F.lit(magic), "bad_magic")
