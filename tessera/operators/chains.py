"""Chains of model calls and guards: detect, evaluate, rewrite, smart apply, polish, audit, apply.

Each is a plan over whole tables. Answers come from models.Answers, a table that is written before a
plan branches on them: every request is asked once, a retry is a second attempt of the rows that need
one, and a chain that is run again with the same table asks only what that lacks. Guards are lexicon
scans in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import verdicts as V
from tessera.operators import claims as C
from tessera.operators import lexicon as L
from tessera.operators import rewriting as R
from tessera.sources.models import Answers

DEFAULT_ASSESSMENT = "The audit gave no assessment."
VERDICT = ("status", "risk", "confidence", "reasoning", "rewrite")


def detect(docs: DataFrame, caller, rules=L.RULES, key: str = "doc_id", answers: Answers | None = None) -> DataFrame:
    """Claims (key, term, start, end, claim_type, explicit, origin) of docs(key, text).

    A model's claims count only where they occur word for word; each text once. Lexicon hits, of those
    that begin at one place the longest, are added where no model claim covers them.
    """
    answers = answers or Answers(docs.sparkSession)
    said = answers.ask(docs.select(key, "text"), caller, "detect").select(key, "text", F.explode("output.claims").alias("c"))
    said = said.select(key, "text", F.trim("c.claim_text").alias("term"), F.col("c.claim_type").alias("claim_type"), (F.coalesce("c.implicitness", F.lit("explicit")) == "explicit").alias("explicit"))
    at = F.expr("instr(text, term)") - 1
    found = said.where("term <> ''").dropDuplicates([key, "term"]).withColumn("start", at).where("start >= 0").withColumn("end", F.col("start") + F.length("term")).drop("text")
    hits = L.longest_per_start(L.spans(docs, rules, key=key), key)
    hits = hits.select(key, "term", L.claim_type(F.col("label"), F.col("severity"), rules).alias("claim_type"), F.lit(True).alias("explicit"), "start", "end")
    return C.detected(found, hits, key)


def evaluate(claims: DataFrame, caller, fallback, version: str = "1", evidence: DataFrame | None = None, answers: Answers | None = None) -> DataFrame:
    """claims(claim_id, claim_type, claim_text) with status, risk, confidence, reasoning, rewrite, hints and version.

    Obvious disease claims are decided without a call and have two fixed hints. Where the first model
    gives no usable answer the fallback is asked; if that has none either the claim is unclear. A hint is
    verified, and keeps its chunk and gets its url, only if evidence(claim_id, chunk_id, url) has that
    chunk for the same claim; hints without a reference or a rationale go.
    """
    answers = answers or Answers(claims.sparkSession)
    cut = V.disease_shortcut(F.col("claim_type"), F.col("claim_text")).isNotNull()
    nothing = [F.lit(None).cast("string").alias(c) for c in VERDICT]
    asked = answers.ask(claims.where(~cut), caller, "evaluate", 1)
    bad = F.col("error").isNotNull() | F.col("output.status").isNull()
    fields = [F.col(f"output.{c}").alias(c) for c in VERDICT]
    first = asked.where(~bad).select(*claims.columns, *fields, "output.hints", F.lit(version).alias("version"))
    again = answers.ask(asked.where(bad).select(*claims.columns), fallback, "evaluate", 2).select(*claims.columns, *fields, "output.hints", F.lit(f"{version}+fallback").alias("version"))
    told = first.unionByName(again)
    rows = claims.where(cut).select("*", *nothing, F.lit(version).alias("version")).unionByName(told.drop("hints"))
    verdicts = C.evaluate(rows)
    hints = C.hint_lists(told.select("claim_id", "hints"), evidence).withColumnRenamed("hints", "_told")
    fixed = F.when(V.disease_shortcut(F.col("claim_type"), F.col("claim_text")).isNotNull(), V.shortcut_hints())
    return verdicts.join(hints, "claim_id", "left").withColumn("hints", F.coalesce(fixed, "_told", V.no_hints())).drop("_told")


def guarded_answers(rows: DataFrame, caller, kind: str, field: str, rules=L.RULES, clean=None, answers: Answers | None = None) -> DataFrame:
    """rows with answer and outcome: said, blocked (a lexicon term in it even after one retry) or missing (no answer).

    clean is applied to the model's text before the lexicon looks at it. A blocked or missing answer is null.
    """
    answers, columns = answers or Answers(rows.sparkSession), rows.columns
    text = F.col(f"output.{field}") if clean is None else clean(F.col(f"output.{field}"))
    hit = L.has_terms(F.coalesce("answer", F.lit("")), rules)
    outcome = F.when(F.col("answer").isNull(), "missing").when(hit, "blocked").otherwise("said")
    first = answers.ask(rows, caller, kind, 1).select(*columns, text.alias("answer")).withColumn("outcome", outcome)
    retry = first.where("outcome = 'blocked'").select(*columns)
    second = answers.ask(retry, caller, kind, 2).select(*columns, text.alias("answer")).withColumn("outcome", outcome)
    return first.where("outcome <> 'blocked'").unionByName(second).withColumn("answer", F.when(F.col("outcome") == "said", F.col("answer")))


def rewrite(claims: DataFrame, caller, rules=L.RULES, answers: Answers | None = None) -> DataFrame:
    """claims(claim_id, claim_text, suggestion) with rewrite: a suggestion that is there stays, else the model's, guarded and made fit."""
    has = F.coalesce(F.trim("suggestion"), F.lit("")) != ""
    asked = guarded_answers(claims.where(~has), caller, "rewrite", "rewrite", rules, answers=answers)
    fit = R.sanitised(F.col("answer"), F.col("claim_text"))
    return claims.where(has).withColumn("rewrite", F.col("suggestion")).unionByName(asked.withColumn("rewrite", fit).drop("answer", "outcome"))


def smart_apply(docs: DataFrame, problems: DataFrame, caller, rules=L.RULES, key: str = "doc_id", separator: str = r"\n{2,}", answers: Answers | None = None) -> DataFrame:
    """(key, text) of docs after paragraphs that hold problems(key, start, end) were rewritten; others stay as they are.

    A rewritten paragraph loses its drop markers and goes if nothing is left of it or a lexicon term
    is in it after a retry; without an answer it stays. What stays is joined by blank lines; order is
    that of the document.
    """
    parts = docs.select(key, F.posexplode(X.paragraphs(F.col("text"), separator)).alias("paragraph", "p")).select(key, "paragraph", "p.text", "p.start", "p.end")
    held = R.holding(parts, problems, key).select(key, "paragraph", "text")
    new = guarded_answers(held, caller, "paragraph", "text", rules, X.strip_drop_markers, answers).select(key, "paragraph", F.coalesce("answer", F.lit("")).alias("new"), (F.col("outcome") != "missing").alias("asked"))
    rows = parts.join(new, [key, "paragraph"], "left").select(key, F.struct("paragraph", F.when(F.col("asked"), F.col("new")).otherwise(F.col("text")).alias("text")).alias("r"))
    # paragraphs of one document, as many as it has
    joined = rows.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return joined.select(key, X.rejoin(F.transform("rows", lambda r: r["text"])).alias("text"))


def residual(before: DataFrame, after: DataFrame, caller, rules=L.RULES, key: str = "doc_id", answers: Answers | None = None) -> tuple[DataFrame, DataFrame]:
    """What a second detection finds in rewritten texts: claims as detect gives them, and (key, changed, checked, n_residual).

    Texts that are empty or, white space around them apart, as they were bring no claims and aren't
    asked about. checked is false where the detector failed: such a text must be looked at by hand.
    """
    answers = answers or Answers(after.sparkSession)
    was = before.select(key, F.col("text").alias("_was"))
    space = r"^\s+|\s+$"
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), space, "")
    rows = after.select(key, "text").join(was, key, "left").withColumn("changed", (strip("text") != "") & (strip("text") != strip("_was")))
    ask = rows.where("changed").select(key, "text")
    found = detect(ask, caller, rules, key, answers)
    failed = answers.ask(ask, caller, "detect").where("error is not null").select(key, F.lit(False).alias("_ok"))
    found = found.join(failed, key, "left_anti")
    n = found.groupBy(key).agg(F.count("*").alias("n_residual"))
    told = rows.select(key, "changed").join(failed, key, "left").join(n, key, "left")
    return found, told.select(key, "changed", F.coalesce("_ok", F.lit(True)).alias("checked"), F.coalesce("n_residual", F.lit(0)).alias("n_residual"))


def polish(docs: DataFrame, caller, rules=L.RULES, answers: Answers | None = None) -> DataFrame:
    """docs(doc_id, text) with polished and kept: the model's text, unless it is missing or brings a term that wasn't there."""
    answers = answers or Answers(docs.sparkSession)
    said = answers.ask(docs, caller, "polish").select("doc_id", "text", F.col("output.text").alias("answer"))
    terms = lambda c: F.transform(L.find_terms(rules)(c), lambda h: F.lower(h["term"]))
    # one pass over the answers: only of those with a term both texts go to the scan
    risky = F.when(L.has_terms(F.coalesce("answer", F.lit("")), rules), F.struct("answer", "text"))
    checked = said.withColumn("_risky", risky)
    checked = checked.withColumn("n_new", F.size(F.array_except(terms(F.col("_risky.answer")), terms(F.col("_risky.text")))))
    ok = (F.col("n_new") == 0) & (F.coalesce(F.trim("answer"), F.lit("")) != "")
    return checked.select("doc_id", R.guarded(F.col("text"), F.col("answer"), F.when(ok, 0).otherwise(1)).alias("polished"), ok.alias("kept"))


def audit(findings: DataFrame, key: list, assessment: str = "assessment") -> DataFrame:
    """For each key: shippable, assessment, the numbers of findings kept and dropped, and the gravest severity."""
    rank = V.severity_rank(F.col("severity"))
    ok = (rank < 99) & (F.coalesce(F.trim("issue"), F.lit("")) != "")
    told = F.max(F.when(F.trim(assessment) != "", F.col(assessment)))
    out = findings.withColumns({"_rank": rank, "_ok": ok}).groupBy(*key).agg(F.count_if("_ok").alias("n_findings"), F.count_if(~F.col("_ok")).alias("n_dropped"), F.min(F.when(F.col("_ok"), F.struct("_rank", "severity"))).alias("_top"), F.bool_and(F.coalesce("model_flag", F.lit(True))).alias("_flag"), told.alias("_told"))
    blocking = F.coalesce(F.col("_top._rank") <= 1, F.lit(False))
    return out.select(*key, (~blocking & F.col("_flag")).alias("shippable"), F.coalesce("_told", F.lit(DEFAULT_ASSESSMENT)).alias("assessment"), "n_findings", "n_dropped", F.col("_top.severity").alias("gravest"))


def apply_audit(text: Column, findings: Column, summary: Column | None = None, rules=L.RULES) -> Column:
    """struct<text,applied> after findings array<struct<quote,new>>: the text as it was, and 0, if the result has a lexicon term.

    summary: the text of a model that was given a summary alone; it counts as one change.
    """
    after = R.apply_findings(text, findings)
    n = F.aggregate(findings, F.lit(0), lambda s, f: s + F.when((f["quote"] != "") & F.contains(text, f["quote"]), 1).otherwise(0))
    if summary is not None:
        after, n = F.coalesce(summary, after), F.when(summary.isNotNull(), 1).otherwise(n)
    hit = L.has_terms(after, rules)
    return F.struct(F.when(hit, text).otherwise(after).alias("text"), F.when(hit, 0).otherwise(n).alias("applied"))
