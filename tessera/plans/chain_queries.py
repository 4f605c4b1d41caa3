"""Queries over chains of model calls. Models are stubs whose answers follow from the request, so SQL can tell them too."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from tessera.functions import embedding
from tessera.functions import text as X
from tessera.operators import chains as H
from tessera.operators import claims as C
from tessera.operators import lexicon as L
from tessera.plans.registry import query, table
from tessera.sources import models

_RULES = (L._rule("public", "hard", "", r"public", ""), L._rule("token", "soft", "", r"token", ""))


def _finds(requests):
    """A detector that names the first licence of a text, and something that isn't there."""
    found = (re.search("license", t or "", re.IGNORECASE) for t in requests["text"])
    return [json.dumps({"claims": ([{"claim_text": m[0], "claim_type": "health_based", "implicitness": "implicit"}] if m else []) + [{"claim_text": "not in any text \u0001"}]}) for m in found]


@query(r"""select doc_id, case when regexp_matches(text, '(?i)license') then 2 else 1 end as n_claims from documents""")
def model_stub_calls(spark, d):
    """The model boundary over all documents."""
    out = models.call(table(spark, d, "documents").select("doc_id", "text"), _finds)
    return out.where("error is null").select("doc_id", F.size("output.claims").alias("n_claims"))


@query(r"""
with m as (select doc_id, text, regexp_extract(text, '(?i)license') term from documents where regexp_matches(text, '(?i)license')),
c as (select doc_id, instr(text, term) - 1 s, instr(text, term) - 1 + length(term) e from m),
r(rule, claim_type) as (values ('public', 'disease_based'), ('token', 'wellbeing_based')),
g as (select doc_id, rule, claim_type, string_split_regex(text, '(?i)' || rule) g from documents, r),
u as (select doc_id, rule, claim_type, unnest(g) gap, generate_subscripts(g, 1) i, len(g) n from g),
h as (select doc_id, claim_type, rule, i, n, cast(sum(length(gap)) over (partition by doc_id, rule order by i) + (i - 1) * length(rule) as bigint) s from u)
select doc_id, cast(s as bigint) as start_at, 'health_based' as claim_type, false as explicit_, 'model' as origin from c
union all select doc_id, s, claim_type, true, 'lexicon' from h where i < n and not exists (select 1 from c where c.doc_id = h.doc_id and c.s <= h.s and h.s + length(rule) <= c.e)""")
def detect_chain(spark, d):
    """Claims of a model that occur word for word, and the lexicon's besides."""
    found = H.detect(table(spark, d, "documents"), _finds, _RULES)
    return found.select("doc_id", F.col("start").cast("long").alias("start_at"), "claim_type", F.col("explicit").alias("explicit_"), "origin")


@query("""
select doc_id, case when toxic = 1 then 'forbidden' when doc_id % 5 = 0 then 'unclear' else 'borderline' end as status, case when toxic = 1 then 'high' when doc_id % 5 = 0 then 'medium' else 'low' end as risk,
       case when toxic = 1 then 0.98 when doc_id % 5 = 0 then 0.5 else 0.9 end as confidence, case when toxic = 0 and doc_id % 5 = 0 then '1+fallback' else '1' end as version from labels""")
def evaluate_chain(spark, d):
    """Shortcut, model, fallback model, coercion and the rule for low confidence."""
    text = F.when(F.col("toxic") == 1, "heilt alles").otherwise("tut gut")
    claims = table(spark, d, "labels").select(F.col("doc_id").alias("claim_id"), F.lit("disease_based").alias("claim_type"), text.alias("claim_text"))
    first = lambda r: [None if i % 5 == 0 else '{"status": "Grenzwertig", "risk": "gering", "confidence": 0.9}' for i in r["claim_id"]]
    second = lambda r: ['{"status": "verboten", "confidence": "viel"}'] * len(r)
    return H.evaluate(claims, first, second).select(F.col("claim_id").alias("doc_id"), "status", "risk", "confidence", "version")


@query("""
select doc_id, case doc_id % 5 when 0 then 'kept' when 1 then 'Ruhe.' when 2 then null when 3 then '[DELETE]' else 'Ruhe.' end as rewrite from labels""")
def rewrite_chain(spark, d):
    """Suggestions kept, rewrites guarded with one retry, the delete marker passed on."""
    claims = table(spark, d, "labels").select(F.col("doc_id").alias("claim_id"), F.lit("Tut gut.").alias("claim_text"), F.when(F.col("doc_id") % 5 == 0, "kept").alias("suggestion"))

    def model(r):
        return [json.dumps({"rewrite": {1: "„Ruhe“" if n > 1 else "Heilkraft", 2: "Therapie", 3: " [delete]"}.get(i % 5, "Ruhe.")}) for i, n in zip(r["claim_id"], r["attempt"])]

    return H.rewrite(claims, model).select(F.col("claim_id").alias("doc_id"), "rewrite")


@query(r"""
with p as (select doc_id, string_split(text, chr(10)) g from documents where text is not null),
n as (select doc_id, list_filter(list_transform(g, lambda x: case when regexp_matches(x, '(?i)license') then (case doc_id % 3 when 0 then 'changed' else '' end) else regexp_replace(x, '\s+$', '') end), lambda x: trim(x) <> '') g from p)
select doc_id, array_to_string(g, chr(10) || chr(10)) as text from n""")
def smart_apply_chain(spark, d):
    """Paragraphs with a hit rewritten: some changed, some with a term even after the retry, some marked for removal."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    problems = L.literal_spans(docs, ["license"])
    model = lambda r: [json.dumps({"text": ("changed", "Heilkraft", "[DELETE]")[i % 3]}) for i in r["doc_id"]]
    return H.smart_apply(docs, problems, model, separator=r"\n")


@query("select doc_id, case doc_id % 3 when 0 then text || ' ok' else text end as polished, doc_id % 3 = 0 as kept from documents")
def polish_chain(spark, d):
    """A polished text is taken unless it brings a new term or is missing."""
    model = lambda r: [None if i % 3 == 2 else json.dumps({"text": t + (" ok", " Heilkraft")[i % 3]}) for i, t in zip(r["doc_id"], r["text"])]
    return H.polish(table(spark, d, "documents").select("doc_id", "text"), model)


@query(f"""
with f as (select user_id, cast(ts as date) day_, case event_type when 'error' then 'critical' when 'purchase' then 'high' when 'click' then 'medium' when 'view' then 'low' else 'other' end severity, event_id % 11 > 0 flag from events),
r as (select *, case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 end r from f)
select user_id, day_, coalesce(min(r), 9) > 1 and bool_and(flag) as shippable, '{H.DEFAULT_ASSESSMENT}' as assessment, count(r) as n_findings, count(*) - count(r) as n_dropped,
       case min(r) when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' end as gravest from r group by 1, 2""")
def final_audit(spark, d):
    """The audit of each text (here a user's day)."""
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "click", "medium").when(F.col("event_type") == "view", "low").otherwise("other")
    findings = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day_"), "event_id", severity.alias("severity"), (F.col("event_id") % 11 > 0).alias("model_flag"), F.lit("x").alias("issue"), F.lit(" ").alias("assessment"))
    return H.audit(findings, ["user_id", "day_"])


@query("""
select doc_id, case when doc_id % 2 = 0 and contains(text, 'the') then substring(text, 1, instr(text, 'the') - 1) || 'THE' || substring(text, instr(text, 'the') + 3) else text end as text,
       cast(case when doc_id % 2 = 0 and contains(text, 'the') then 1 else 0 end as integer) as applied from documents""")
def apply_audit_guard(spark, d):
    """Findings applied, and taken back where the result has a term of the lexicon."""
    finding = F.struct(F.lit("the").alias("quote"), F.when(F.col("doc_id") % 2 == 0, "THE").otherwise(" Heilkraft ").alias("new"))
    df = table(spark, d, "documents").select("doc_id", H.apply_audit(F.col("text"), F.array(finding)).alias("r"))
    return df.select("doc_id", "r.text", "r.applied")


@query("""
select doc_id, doc_id % 3 > 0 as summarised, case doc_id % 3 when 1 then 'Ruhe' else text end as text, cast(case when doc_id % 3 = 1 or doc_id % 3 = 0 and has then 1 else 0 end as integer) as applied from (
  select doc_id, contains(text, 'the') has, case when doc_id % 3 = 0 and contains(text, 'the') then substring(text, 1, instr(text, 'the') - 1) || 'THE' || substring(text, instr(text, 'the') + 3) else text end as text from documents)""")
def apply_audit_summary(spark, d):
    """Texts whose audit came as findings or as a summary alone; a summary counts as one change, and goes if it has a term of the lexicon."""
    findings = F.array(F.struct(F.lit("the").alias("quote"), F.lit("THE").alias("new")))
    summary = F.when(F.col("doc_id") % 3 == 1, "Ruhe").when(F.col("doc_id") % 3 == 2, "Heilkraft")
    df = table(spark, d, "documents").select("doc_id", summary.isNotNull().alias("summarised"), H.apply_audit(F.col("text"), findings, summary).alias("r"))
    return df.select("doc_id", "summarised", "r.text", "r.applied")


@query("""
select doc_id, cast(n_chars as integer) as tokens_in, case when doc_id % 4 > 0 then cast(doc_id % 9 as integer) end as tokens_out, doc_id % 4 > 0 as counted from documents""")
def model_usage(spark, d):
    """Token counts that a model reports with its answers; some answers come without."""
    def model(r):
        return [json.dumps({"text": "x"} | ({"usage": {"tokens_in": n, "tokens_out": i % 9, "cache_read": 1}} if i % 4 else {"usage": {"tokens_in": n}})) for i, n in zip(r["doc_id"].tolist(), r["n_chars"].tolist())]

    out = models.call(table(spark, d, "documents").select("doc_id", "n_chars"), model, models.SCHEMAS["polish"])
    return out.select("doc_id", "usage.tokens_in", "usage.tokens_out", F.col("usage.cache_read").isNotNull().alias("counted"))


@query("select doc_id as claim_id, quality from labels where quality <> 1")
def problem_claims(spark, d):
    claims = table(spark, d, "labels").select(F.col("doc_id").alias("claim_id"), "quality", F.when(F.col("quality") == 1, "allowed").otherwise("borderline").alias("status"))
    return C.problems(claims).select("claim_id", "quality")


@query("select doc_id as claim_id from labels where quality <> 1 and doc_id % 2 = 0")
def applicable_claims(spark, d):
    claims = table(spark, d, "labels").select(F.col("doc_id").alias("claim_id"), F.when(F.col("quality") == 1, "allowed").otherwise("forbidden").alias("status"), F.when(F.col("doc_id") % 2 == 0, "x").alias("rewrite"))
    return C.applicable(claims).select("claim_id")


@query("select l_orderkey as text_id, l_linenumber as claim_id, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber) as place from lineitem")
def claims_by_start(spark, d):
    """Evaluated claims in order of their place in the text."""
    claims = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("text_id"), F.col("l_linenumber").alias("claim_id"), F.col("l_shipdate").alias("start"))
    return C.in_order(claims, "text_id", "start", "claim_id").select("text_id", "claim_id", F.col("place").cast("long").alias("place"))


@query(r"""select conv_id, turn, regexp_matches(text, '[.!?;:]\s*$') as closed, timestamp '2024-01-01 10:00:00' + to_hours(cast(turn as integer)) as at from conversations""")
def closed_turns(spark, d):
    """Whether a turn ends with punctuation, and its time from ISO text with Z."""
    iso = F.date_format(F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 10:00:00").cast("timestamp")) + 3600 * F.col("turn")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "conversations").select("conv_id", "turn", X.ends_with_punctuation(F.col("text")).alias("closed"), X.iso_time(iso).alias("at"))


@query()
def hashed_embeddings(spark, d):
    """Embeddings of all benchmark items without a model."""
    return table(spark, d, "benchmark").select("item_id", embedding.embed(F.col("text"), prefix="query: ").alias("vector"))


@query("select user_id, bool_or(event_type = 'error') as partial, count(*) filter (where event_type = 'error') as failed from events group by 1")
def failed_evaluations(spark, d):
    """Whether any evaluation of a user failed."""
    return C.failures(table(spark, d, "events"), ["user_id"], F.col("event_type") == "error")


@query("""select doc_id, doc_id % 7 = 3 or doc_id % 5 = 2 or doc_id % 11 = 4 as dropped from labels""")
def valid_verdicts(spark, d):
    """Enum and range checks of evaluated claims: a verdict that is none, confidences beyond 0 to 1, and nulls go."""
    k = F.col("doc_id")
    status = F.when(k % 7 == 3, "maybe").when(F.col("quality") == 1, " allowed").otherwise("Forbidden")
    confidence = F.when(k % 11 == 4, None).when(k % 5 == 2, F.when(k % 2 == 0, 1.5).otherwise(-0.1)).otherwise(F.col("toxic").cast("double"))
    rows = table(spark, d, "labels").select("doc_id", status.alias("status"), confidence.alias("confidence"))
    return C.with_validity(rows).select("doc_id", (~F.col("is_valid")).alias("dropped"))


@query("""
select item_id, regexp_replace(text, '[*_`#>]', '', 'g') as plain from benchmark""")
def markdown_text(spark, d):
    """Markdown around benchmark items taken off again."""
    from tessera.functions.formatting import markdown_plain

    marked = F.concat(F.lit("## **"), F.regexp_replace("text", r"\n", "** \n> `"), F.lit("`**"))
    return table(spark, d, "benchmark").select("item_id", F.regexp_replace(markdown_plain(marked), " \n", "\n").alias("plain"))

