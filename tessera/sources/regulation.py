"""Regulation HTML to paragraph chunks: the parser only lists paragraphs, all state is windows.

State runs along one document: section, article with its title, annex flag, a counter of unnumbered
paragraphs. Each is the last mark before a row, so no task needs more than one document's rows.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X

# Class names of each kind of paragraph; containment counts, in this order.
SECTION = ["oj-ti-section-1", "oj-ti-section-2", "oj-ti-section-3", "title-division-1", "title-division-2", "title-gr-seq-level-1"]
ANNEX = ["oj-doc-ti", "title-fam-member", "title-doc-last"]
ARTICLE = ["oj-ti-art", "title-article-norm"]
SUBTITLE = ["oj-sti-art", "stitle-article-norm"]
PARAGRAPH = ["oj-normal", "norm"]
#: Pages of an Arrow batch that are Python objects at once.
PAGE_ROWS = 500


class _Paragraphs(HTMLParser):
    """Texts of p elements with a class, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list = []
        self.open: list = []

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self.close_p()
            self.open.append((dict(attrs).get("class"), []))

    def handle_endtag(self, tag):
        if tag == "p":
            self.close_p()

    def handle_data(self, data):
        if self.open:
            self.open[-1][1].append(data)

    def close_p(self):
        if self.open:
            cls, parts = self.open.pop()
            if cls is not None:
                self.rows.append((len(self.rows), cls, "".join(parts)))


def paragraphs(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, seq, class, text) of pages(key, html)."""

    def parse(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PAGE_ROWS):
                part, page, rows = batch.slice(start, PAGE_ROWS), [], []
                for i, html in enumerate(part.column(1).to_pylist()):
                    tool = _Paragraphs()
                    tool.feed(html or "")
                    tool.close_p()
                    page += [i] * len(tool.rows)
                    rows += tool.rows
                seq, cls, text = zip(*rows) if rows else ((), (), ())
                columns = [part.column(0).take(pa.array(page, pa.int64())), pa.array(seq, pa.int32()), pa.array(cls, pa.string()), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "seq", "class", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "html").mapInArrow(parse, f"{key} {kind}, seq int, class string, text string")


def article_range(rows: DataFrame, by: list) -> DataFrame:
    """First and last article and the number of chunks of each group; 0 where no chunk has an article."""
    return rows.groupBy(*by).agg(F.coalesce(F.min("article"), F.lit(0)).alias("first_article"), F.coalesce(F.max("article"), F.lit(0)).alias("last_article"), F.count("*").alias("n"))


def chunks(pages: DataFrame, regulation_id: str, key: str = "page_id") -> DataFrame:
    """Chunks of each page's regulation, in document order."""
    rows = paragraphs(pages, key).withColumn("text", X.collapse(F.col("text"))).where("text <> ''").withColumn("class", F.lower("class"))
    has = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: F.contains("class", n))
    number = X.article_number(F.col("text"))
    kind = F.when(has(SECTION), "section").when(has(ANNEX) & F.contains(F.lower("text"), F.lit("anhang")), "annex").when(has(ARTICLE), F.when(number.isNotNull(), "article").otherwise("skip")).when(has(SUBTITLE), "subtitle").when(has(PARAGRAPH), "paragraph").otherwise("skip")
    upto = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    last = lambda value, on: F.last(F.when(F.col("kind").isin(*on), value), ignorenulls=True).over(upto)
    df = rows.withColumn("kind", kind).withColumn("number", number)
    df = df.withColumn("place", last(F.struct(F.when(F.col("kind") == "article", F.col("number")).alias("article"), (F.col("kind") == "annex").alias("annex")), ["article", "annex"]))
    df = df.withColumn("section", last(F.col("text"), ["section", "annex"]))
    df = df.withColumn("title", last(F.struct(F.when(F.col("kind") == "subtitle", F.col("text")).alias("t")), ["article", "annex", "subtitle"])["t"])
    df = df.withColumn("run", F.count_if(F.col("kind") == "article").over(upto))
    body = df.where("kind = 'paragraph' and place is not null and (place.article is not null or place.annex)")
    own = X.paragraph_number(F.col("text"))
    counter = F.count_if(own.isNull()).over(W.partitionBy(key, "run").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    body = body.withColumn("paragraph", F.coalesce(own, counter.cast("int"))).withColumn("article", F.col("place.article"))
    first = F.row_number().over(W.partitionBy(key, "article", "paragraph").orderBy("seq"))
    kept = body.withColumn("_k", first).where("article is null or _k = 1")
    nth = F.row_number().over(W.partitionBy(key).orderBy("seq"))
    chunk_id = F.when(F.col("article").isNotNull(), F.format_string(f"{regulation_id}-art%d-para%d", "article", "paragraph")).otherwise(F.format_string(f"{regulation_id}-anhang-%d", nth))
    return kept.select(key, "seq", chunk_id.alias("chunk_id"), "article", F.when(F.col("article").isNotNull(), F.col("title")).alias("article_title"), "paragraph", X.paragraph_body(F.col("text")).alias("text"), "section", F.col("article").isNull().alias("is_annex"))
