"""Rewrites: splicing, findings, segments, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.intervals import with_holder


def splice(text: Column, edits: Column) -> Column:
    """Apply edits, array<struct<start,end,new>>, from the last start to the first; [DELETE] removes its span."""
    ordered = F.array_sort(edits, lambda a, b: F.when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1).otherwise(0))

    def one(t, e):
        new = F.when(X.is_delete_marker(e["new"]), "").otherwise(e["new"])
        return F.concat(F.substr(t, F.lit(1), e["start"]), new, F.substr(t, e["end"] + 1, F.length(t)))

    return X.tidy(F.aggregate(ordered, text, one))


def apply_findings(text: Column, findings: Column) -> Column:
    """Apply array<struct<quote,new>> in order, each at its first occurrence in the running text; absent quotes change nothing.

    Where a quote is removed, three line ends or more become two.
    """

    def one(t, f):
        at = F.when(f["quote"] != "", F.position(f["quote"], t)).otherwise(0)
        new = F.coalesce(f["new"], F.lit(""))
        done = F.concat(F.substr(t, F.lit(1), at - 1), new, F.substr(t, at + F.length(f["quote"]), F.length(t)))
        return F.when(at > 0, F.when(new == "", X.collapse_blank_lines(done)).otherwise(done)).otherwise(t)

    return F.aggregate(findings, text, one)


def without_overlaps(spans: Column) -> Column:
    """Of array<struct<start,end,...>> in order of start, those that begin at or after the end of the last one kept."""
    start = F.struct(F.lit(0).alias("cursor"), F.slice(spans, 1, 0).alias("kept"))
    step = lambda acc, s: F.when(s["start"] >= acc["cursor"], F.struct(s["end"].alias("cursor"), F.array_append(acc["kept"], s).alias("kept"))).otherwise(acc)
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["kept"])


def segments(text: Column, spans: Column) -> Column:
    """Alternating text and span pieces, array<struct<kind,text>>; empty text pieces are left out."""
    piece = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,text:string>>").alias("out"))
    cut = lambda a, b: F.substr(text, a + 1, F.greatest(b - a, F.lit(0)))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece("text", cut(acc["at"], s["start"])), piece("claim", cut(s["start"], s["end"])))).alias("out"))
    done = lambda acc: F.concat(acc["out"], F.array(piece("text", cut(acc["at"], F.length(text)))))
    return F.filter(F.aggregate(F.array_sort(spans), start, step, done), lambda p: p["text"] != "")


def highlighted(text: Column, spans: Column) -> Column:
    """HTML with the non-overlapping spans marked and all else escaped."""
    escape = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = segments(text, without_overlaps(spans))
    return F.array_join(F.transform(parts, lambda p: F.when(p["kind"] == "claim", F.concat(F.lit("<mark>"), escape(p["text"]), F.lit("</mark>"))).otherwise(escape(p["text"]))), "")


def sanitised(rewrite: Column, original: Column) -> Column:
    """A model's rewrite made fit to splice, or null if it is a placeholder or a memo; the delete marker passes."""
    clean = X.match_terminal_punctuation(X.aggressive_clean(X.strip_wrapping_quotes(rewrite)), original)
    bad = X.is_placeholder(rewrite) | X.is_compliance_memo(rewrite) | (F.trim(rewrite) == "")
    return F.when(X.is_delete_marker(rewrite), F.lit("[DELETE]")).when(~bad, clean)


def holding(parts: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Those of parts(key, paragraph, start, end, ...) that hold one of spans(key, start, end) wholly."""
    held = with_holder(spans.select(key, "start", "end"), parts, "paragraph", key).select(key, "paragraph").distinct()
    return parts.join(held, [key, "paragraph"], "left_semi")


def paragraph_claims(docs: DataFrame, claims: DataFrame, key: str = "doc_id", separator: str = r"\n{2,}") -> DataFrame:
    """(key, paragraph, start, end, n_claims): claims that lie wholly inside each paragraph; one that crosses a break is in none."""
    parts = docs.select(key, F.posexplode(X.paragraphs(F.col("text"), separator)).alias("paragraph", "p")).select(key, "paragraph", "p.*")
    n = with_holder(claims.select(key, "start", "end"), parts, "paragraph", key).groupBy(key, "paragraph").agg(F.count("*").alias("n_claims"))
    return parts.join(n, [key, "paragraph"], "left").select(key, "paragraph", "start", "end", F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


def guarded(original: Column, rewritten: Column, new_hits: Column) -> Column:
    """The rewritten text, or the original if the rewrite brings new terms."""
    return F.when(F.coalesce(new_hits, F.lit(0)) > 0, original).otherwise(rewritten)
