"""A deterministic embedding without a model: words hashed to signed dimensions, normalised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 64


def embed(text: Column, width: int = WIDTH, prefix: str = "passage: ") -> Column:
    """A unit vector of the text's words; that of a text without words is zero. Queries take the prefix "query: ".

    The prefix is what embedding models want; here it is a word like others, and left out of the count.
    """
    from tessera.operators.retrieval import unit

    words = F.regexp_extract_all(F.lower(F.substr(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))), F.lit(len(prefix) + 1))), F.lit(r"(?U)\w+"), F.lit(0))
    number = F.transform(words, lambda w: F.crc32(w.cast("binary")))
    sign = lambda h: F.when(F.shiftright(h, 16) % 2 == 0, 1.0).otherwise(-1.0)
    value = lambda i: F.aggregate(F.filter(number, lambda h: h % width == i), F.lit(0.0), lambda s, h: s + sign(h))
    return unit(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), value))
