"""Texts made for people and prompts: templates, numbered blocks, plain text, warnings, repaired encodings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entities that exported text may hold; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def decode_entities(text: Column) -> Column:
    for name, character in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def plain_text(html: Column) -> Column:
    """Tags out, entities decoded."""
    return decode_entities(F.regexp_replace(html, "<[^>]+>", ""))


def markdown_plain(text: Column) -> Column:
    """Markdown without its marks: headings, quotes, list bullets, emphasis, code and links (their label stays)."""
    for pattern, new in ((r"(?m)^#{1,6}\s+", ""), (r"(?m)^>\s?", ""), (r"(?m)^(\s*)[-*+]\s+", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"\*\*|__|`", ""), (r"(?<!\w)[*_](\S(?:[^*_\n]*\S)?)[*_](?!\w)", "$1")):
        text = F.regexp_replace(text, pattern, new)
    return text


def render(template: str, values: dict) -> Column:
    """A template with {{ name }} places, filled from columns; a name without a column raises KeyError."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def numbered(items: Column, line) -> Column:
    """One line for each item of an array, numbered from 1."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), line(x))), "\n")


def replacement_line(quote: Column, new: Column) -> Column:
    """What is to be done with a quoted passage: null asks for a rewording, empty for removal."""
    what = F.when(new.isNull(), "reword").when(F.trim(new) == "", "remove").otherwise(F.concat(F.lit("replace by "), new))
    return F.concat(F.lit('"'), quote, F.lit('": '), what)


def warnings(degraded: Column, timed_out: Column, failed: Column, total: Column) -> Column:
    """Codes of what went wrong in an analysis, in fixed order; an empty array if nothing did."""
    codes = F.array(
        F.when(degraded, "knowledge_base_degraded"),
        F.when(timed_out, "evaluation_timeout"),
        F.when(failed > 0, "evaluation_partial"),
        F.when(total == 0, "no_claims_found"),
    )
    return F.array_compact(codes)


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was decoded as Latin-1, decoded again as often as that succeeds and shortens the text."""
    # no character above U+00FF, and a lead byte with a continuation byte at least once
    suspect = lambda t: t.rlike(r"^[\x{00}-\x{FF}]*$") & t.rlike(r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]")

    def once(t: Column) -> Column:
        again = F.when(suspect(t), F.try_validate_utf8(F.encode(F.when(suspect(t), t), "ISO-8859-1").cast("string")))
        return F.coalesce(F.when(F.length(again) < F.length(t), again), t)

    # each wrong decoding doubles what isn't ASCII, so there are at most log2(length) of them
    most = F.greatest(F.ceil(F.log2(F.length(text) + F.lit(1))).cast("int"), F.lit(1))
    return F.when(suspect(text), F.aggregate(F.sequence(F.lit(1), most), text, lambda t, _: once(t))).otherwise(text)


def role_label(role: Column) -> Column:
    return F.when(role == "owner", "Owner").when(role == "editor", "Editor").otherwise("Viewer")


def bearer_token(header: Column) -> Column:
    """The token of an Authorization header, null if it has another form."""
    found = F.regexp_extract(header, r"^(?i:bearer) +(\S+)$", 1)
    return F.when(found != "", found)


def report_name(prefix: str, key: Column, day: Column) -> Column:
    """prefix-<first eight characters of the key>-<date>."""
    return F.concat_ws("-", F.lit(prefix), F.left(key.cast("string"), F.lit(8)), F.date_format(day, "yyyy-MM-dd"))
