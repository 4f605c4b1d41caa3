"""Queries over texts made for people: plain text, numbered findings, warnings, report names, repaired encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import formatting as X
from tessera.plans.registry import query, table


@query("""
select page_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as plain from pages""")
def plain_text_export(spark, d):
    return table(spark, d, "pages").select("page_id", X.plain_text(F.col("html")).alias("plain"))


@query("""
with f as (select user_id, cast(ts as date) day_, event_id, event_type quote, case when event_id % 3 = 0 then null when event_id % 3 = 1 then '' else 'x' end new from events),
n as (select user_id, day_, event_id, cast(row_number() over (partition by user_id, day_ order by event_id) as varchar) || '. "' || quote || '": ' || case when new is null then 'reword' when trim(new) = '' then 'remove' else 'replace by ' || new end line from f)
select user_id, day_, string_agg(line, chr(10) order by event_id) as block from n group by 1, 2""")
def numbered_findings(spark, d):
    new = F.when(F.col("event_id") % 3 == 1, "").when(F.col("event_id") % 3 == 2, "x")
    found = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day_"), F.struct("event_id", F.col("event_type").alias("quote"), new.alias("new")).alias("f"))
    lists = found.groupBy("user_id", "day_").agg(F.array_sort(F.collect_list("f")).alias("f"))
    return lists.select("user_id", "day_", X.numbered(F.col("f"), lambda x: X.replacement_line(x["quote"], x["new"])).alias("block"))


@query("""
select o_orderkey as id, concat_ws(',', case when o_orderkey % 5 = 0 then 'knowledge_base_degraded' end, case when o_orderkey % 7 = 0 then 'evaluation_timeout' end, case when o_orderkey % 3 > 0 then 'evaluation_partial' end, case when o_orderkey % 4 = 0 then 'no_claims_found' end) as warnings,
       'report-' || left(cast(o_orderkey as varchar), 8) || '-' || strftime(o_orderdate, '%Y-%m-%d') as file_name from orders""")
def analysis_warnings(spark, d):
    k = F.col("o_orderkey")
    codes = X.warnings(k % 5 == 0, k % 7 == 0, k % 3, k % 4)
    return table(spark, d, "orders").select(k.alias("id"), F.array_join(codes, ",").alias("warnings"), X.report_name("report", k, F.col("o_orderdate")).alias("file_name"))


@query("""
select c_custkey as id, 'Dear ' || c_name || ', you joined ' || c_mktsegment || ' as ' || case c_custkey % 3 when 0 then 'Owner' when 1 then 'Editor' else 'Viewer' end || '.' as message,
       case when c_custkey % 2 = 0 then 'token-' || c_custkey end as token from customer""")
def invite_messages(spark, d):
    role = F.when(F.col("c_custkey") % 3 == 0, "owner").when(F.col("c_custkey") % 3 == 1, "editor").otherwise("viewer")
    header = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Bearer token-"), "c_custkey")).otherwise("Basic x")
    text = X.render("Dear {{ name }}, you joined {{project}} as {{ role }}.", {"name": F.col("c_name"), "project": F.col("c_mktsegment"), "role": X.role_label(role)})
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("message"), X.bearer_token(header).alias("token"))


@query("select doc_id, text as repaired from documents")
def mojibake_repair(spark, d):
    """Texts whose UTF-8 was decoded as Latin-1 once are what they were; those beyond Latin-1 are left as they are."""
    broken = F.encode(F.col("text"), "UTF-8")
    return table(spark, d, "documents").select("doc_id", X.repair_mojibake(F.decode(broken, "ISO-8859-1")).alias("repaired"))
