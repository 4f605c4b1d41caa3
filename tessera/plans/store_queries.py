"""Queries over verdicts, the analyses store, projects, invites, limits and streams.

orders stand for analyses (customer: project, its nation: user's region), events for calls and
invites, labels and lineitem for evaluated claims.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import verdicts as V
from tessera.operators import claims as C
from tessera.operators import knowledge_index
from tessera.operators import store as S
from tessera.plans import knowledge as K
from tessera.plans.registry import query, shared_dir, table
from tessera.sources import prompts, register, regulation, web
from tessera.streaming import fanout, limiter, quota, scan

AS_OF = "2024-01-20 00:00:00"


@query("""
select doc_id, case when toxic = 1 then 'forbidden' when quality = 0 then 'borderline' else 'allowed' end as status,
       case when toxic = 1 then 'high' when quality = 0 then 'medium' else 'low' end as risk, least(1.0, 0.5 + doc_id % 7 / 10.0) as confidence
from labels""")
def verdict_coercion(spark, d):
    """Labels written as the synonyms that models drift into, coerced back."""
    raw = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, " Verboten").when(F.col("quality") == 0, "grenzwertig").otherwise("OK ").alias("s"), F.when(F.col("toxic") == 1, "hoch").when(F.col("quality") == 0, "weird").otherwise("gering").alias("r"), (F.lit(0.5) + F.col("doc_id") % 7 / 10.0).alias("c"))
    return raw.select("doc_id", V.status(F.col("s")).alias("status"), V.risk(F.col("r")).alias("risk"), F.least(F.lit(1.0), V.confidence(F.col("c"))).alias("confidence"))


@query("""
with c as (select doc_id, case when toxic = 1 then 'forbidden' when quality = 0 then 'borderline' else 'allowed' end status, doc_id % 10 / 10.0 confidence from labels)
select doc_id, case when confidence < 0.6 then 'unclear' else status end as status, case when confidence >= 0.6 then 'x' end as rewrite from c""")
def low_confidence_override(spark, d):
    raw = table(spark, d, "labels").select("doc_id", F.lit("wellbeing_based").alias("claim_type"), F.lit("x").alias("claim_text"), F.when(F.col("toxic") == 1, "forbidden").when(F.col("quality") == 0, "borderline").otherwise("allowed").alias("status"), F.lit("low").alias("risk"), (F.col("doc_id") % 10 / 10.0).cast("string").alias("confidence"), F.lit("").alias("reasoning"), F.lit("x").alias("rewrite"))
    return C.evaluate(raw).select("doc_id", "status", "rewrite")


_STATUS_SQL = "select l_orderkey, case l_returnflag when 'A' then 'allowed' when 'N' then 'borderline' else 'forbidden' end status, case when l_quantity < 17 then 'low' when l_quantity < 34 then 'medium' else 'high' end risk from lineitem"


def _evaluated(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "allowed").when(F.col("l_returnflag") == "N", "borderline").otherwise("forbidden")
    risk = F.when(F.col("l_quantity") < 17, "low").when(F.col("l_quantity") < 34, "medium").otherwise("high")
    return table(spark, d, "lineitem").select("l_orderkey", status.alias("status"), risk.alias("risk"))


@query(f"""
with c as ({_STATUS_SQL}), g as (
select l_orderkey, count(*) filter (where status = 'allowed') n_allowed, count(*) filter (where status = 'borderline') n_borderline, count(*) filter (where status = 'forbidden') n_forbidden, count(*) total,
       avg(case risk when 'low' then 0.2 when 'medium' then 0.55 else 0.9 end) risk_score from c group by 1)
select l_orderkey, n_allowed, n_borderline, n_forbidden, total, round(risk_score, 6) as risk_score, greatest(0, 100 - 20 * n_forbidden - 10 * n_borderline) as compliance,
       case when greatest(0, 100 - 20 * n_forbidden - 10 * n_borderline) >= 85 then 'green' when greatest(0, 100 - 20 * n_forbidden - 10 * n_borderline) >= 60 then 'yellow' else 'red' end as band from g""")
def risk_status_report(spark, d):
    r = C.report(_evaluated(spark, d), "l_orderkey")
    return r.select("l_orderkey", F.col("allowed").alias("n_allowed"), F.col("borderline").alias("n_borderline"), F.col("forbidden").alias("n_forbidden"), "total", F.round("risk_score", 6).alias("risk_score"), "compliance", "band")


@query(f"with c as ({_STATUS_SQL}) select status, count(*) as n, round(count(*) * 1.0 / sum(count(*)) over (), 6) as share from c group by 1")
def status_mix(spark, d):
    from pyspark.sql import Window as W

    counts = _evaluated(spark, d).groupBy("status").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6))


@query("""
select user_id, count(*) as n_calls, sum(event_id % 5000) as tokens_in, round(sum(case event_type when 'click' then (event_id % 5000) * 8.0 + 700 * 20.0 when 'view' then (event_id % 5000) * 0.5 + 700 * 2.0 else (event_id % 5000) * 4.0 + 700 * 10.0 end / 1e6), 4) as cost_usd
from events group by 1""")
def cost_rollup(spark, d):
    model = F.when(F.col("event_type") == "click", "large").when(F.col("event_type") == "view", "small").otherwise("other")
    calls = table(spark, d, "events").select("user_id", model.alias("model"), (F.col("event_id") % 5000).alias("tokens_in"))
    return calls.groupBy("user_id").agg(F.count("*").alias("n_calls"), F.sum("tokens_in").alias("tokens_in"), F.round(F.sum(V.cost(F.col("model"), F.col("tokens_in"), F.lit(700), {"large": (8.0, 20.0), "small": (0.5, 2.0)}, (4.0, 10.0))), 4).alias("cost_usd"))


_FINDINGS_SQL = "select user_id, event_id, case event_type when 'error' then 'critical' when 'purchase' then 'high' when 'click' then 'medium' when 'view' then 'low' else 'other' end severity, event_id % 11 > 0 flag, cast(ts as date) as day_ from events"


def _findings(spark, d):
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "click", "medium").when(F.col("event_type") == "view", "low").otherwise("other")
    return table(spark, d, "events").select("user_id", F.to_date("ts").alias("day_"), "event_id", severity.alias("severity"), (F.col("event_id") % 11 > 0).alias("model_flag"), F.lit("x").alias("issue"))


@query(f"with f as ({_FINDINGS_SQL}) select user_id, bool_or(severity in ('critical', 'high')) as blocking, not bool_or(severity in ('critical', 'high')) and bool_and(flag) as shippable from f group by 1")
def shippable_flag(spark, d):
    return C.shippable(_findings(spark, d), "user_id").select("user_id", "blocking", "shippable")


@query(f"""
with f as ({_FINDINGS_SQL})
select user_id, day_, event_id, severity, row_number() over (partition by user_id, day_ order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, event_id) as place from f where severity <> 'other'""")
def findings_by_severity(spark, d):
    """The findings of each text (here a user's day), the gravest first; those with an unknown severity are dropped."""
    rows = C.by_severity(_findings(spark, d), ["user_id", "day_"], "event_id")
    return rows.select("user_id", "day_", "event_id", "severity", F.col("place").cast("long").alias("place"))


@query("""
with x as (select l.doc_id, d.lang, l.toxic = 1 gold, regexp_matches(lower(d.text), '\\b(?:idiot|clown|worthless|pathetic)\\b') predicted from labels l join documents d using (doc_id)),
g as (select lang, count(*) filter (where predicted and gold) tp, count(*) filter (where predicted and not gold) fp, count(*) filter (where not predicted and gold) fn from x group by 1)
select lang, tp, fp, fn, round(case when tp + fp > 0 then tp * 1.0 / (tp + fp) else 0 end, 6) as precision_, round(case when tp + fn > 0 then tp * 1.0 / (tp + fn) else 0 end, 6) as recall_, round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from g""")
def precision_recall_f1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("text").rlike(r"(?iuU)\b(?:idiot|clown|worthless|pathetic)\b").alias("predicted"))
    gold = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("gold"))
    r = C.precision_recall(gold.join(docs, "doc_id"), ["lang"])
    return r.select("lang", "tp", "fp", "fn", F.round("precision", 6).alias("precision_"), F.round("recall", 6).alias("recall_"), F.round("f1", 6).alias("f1"))


def _analyses(spark, d):
    deleted = F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate") + F.expr("interval 10 days"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), (F.col("o_custkey") % 25).alias("user_id"), F.col("o_orderdate").alias("created_at"), F.lit("de").alias("language"), F.col("o_orderpriority").alias("input_text"), F.col("o_totalprice").alias("risk_score"), deleted.alias("deleted_at"))


def _members(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_nationkey").cast("long").alias("user_id"), F.when(F.col("c_mktsegment") == "BUILDING", "owner").when(F.col("c_mktsegment") == "MACHINERY", "editor").otherwise("viewer").alias("role"))


@query("select o_orderkey as id, o_custkey as project_id, o_orderdate as created_at, o_orderpriority as preview, o_totalprice as risk_score from orders where o_orderstatus <> 'P' order by o_orderdate desc, o_orderkey limit 20 offset 40")
def history_page(spark, d):
    return S.history_page(_analyses(spark, d), 20, 40).select("id", "project_id", "created_at", "preview", "risk_score")


@query("""
select o_orderkey as id, o_custkey as project_id from orders where exists (select 1 from customer where c_custkey = o_custkey and c_nationkey = 7 and c_mktsegment in ('BUILDING', 'MACHINERY'))""")
def membership_scope(spark, d):
    return S.visible_to(_analyses(spark, d), _members(spark, d), 7, "analyses", "write").select("id", "project_id")


@query("""
with m as (select c_custkey project_id, c_nationkey user_id, case c_mktsegment when 'BUILDING' then 'owner' when 'MACHINERY' then 'editor' else 'viewer' end role from customer
           union all select c_custkey, (c_nationkey + 1) % 25, 'viewer' from customer where c_custkey % 3 = 0),
n as (select project_id, count(*) c from m group by 1)
select p.c_custkey as project_id, p.c_name as name, p.c_custkey % 50 = 0 as is_default, m.role, n.c as member_count
from customer p join m on m.project_id = p.c_custkey and m.user_id = 7 join n on n.project_id = p.c_custkey""")
def project_list(spark, d):
    customers = table(spark, d, "customer")
    more = customers.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("project_id"), ((F.col("c_nationkey") + 1) % 25).cast("long").alias("user_id"), F.lit("viewer").alias("role"))
    projects = customers.select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 50 == 0).alias("is_default"))
    return S.project_list(projects, _members(spark, d).unionByName(more), 7).select("project_id", "name", "is_default", "role", "member_count")


@query("""
select c.c_custkey as project_id, c.c_nationkey as user_id, s.s_name as email, nullif(n.n_name, 'NATION_3') as display_name
from customer c left join supplier s on s.s_suppkey = c.c_nationkey left join nation n on n.n_nationkey = c.c_nationkey""")
def member_list(spark, d):
    users = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("user_id"), F.col("s_name").alias("email"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), F.when(F.col("n_name") == "NATION_3", " ").otherwise(F.col("n_name")).alias("display_name"))
    return S.member_list(_members(spark, d), users, names).select("project_id", F.col("user_id").cast("int").alias("user_id"), "email", "display_name")


@query("""select o_orderkey as id from orders where o_orderstatus <> 'P' or o_orderdate + interval 10 days >= timestamp '1998-01-01' - interval 30 days""")
def purge_deleted(spark, d):
    return S.purge(_analyses(spark, d), "1998-01-01 00:00:00").select("id")


@query("""
select o_orderkey as id, case when o_orderkey % 7 <> 0 then 'none' when o_orderstatus <> 'P' then 'live' when o_orderdate + interval 10 days >= timestamp '1998-01-01' - interval 30 days then 'restored' else 'gone' end as outcome from orders""")
def restore_window(spark, d):
    a = _analyses(spark, d)
    return S.restore(a, a.where("id % 7 = 0"), "1998-01-01 00:00:00").select("id", F.coalesce("outcome", F.lit("none")).alias("outcome"))


@query("select o_orderkey as id, o_orderkey % 7 = 0 and o_orderstatus <> 'P' as changed from orders")
def soft_delete(spark, d):
    a = _analyses(spark, d)
    return S.soft_delete(a, a.where("id % 7 = 0"), "2024-01-01 00:00:00").select("id", "changed")


def _invites(spark, d):
    status = F.when(F.col("event_type").isin("click", "view"), "pending").when(F.col("event_type") == "purchase", "accepted").otherwise("revoked")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("invited_by"), F.col("ts").alias("invited_at"), status.alias("status"), (F.col("ts") + F.expr("interval 7 days")).alias("expires_at"))


@query("""
with i as (select event_id, ts, case when event_type in ('click', 'view') then (case when ts + interval 7 days < timestamp '2024-02-10' then 'expired' else 'pending' end) when event_type = 'purchase' then 'accepted' else 'revoked' end status from events)
select event_id, status from i where status = 'pending' or ts >= timestamp '2024-02-10' - interval 30 days""")
def purge_and_expire_invites(spark, d):
    return S.clean_invites(_invites(spark, d), "2024-02-10 00:00:00").select("event_id", "status")


@query("select user_id as invited_by, count(*) as n_invites, count(*) < 50 as allowed from events where ts between timestamp '2024-01-20' - interval 24 hours and timestamp '2024-01-20' group by 1")
def invites_24h(spark, d):
    return S.invites_last_day(_invites(spark, d), AS_OF)


@query("""
select event_id, case when event_type = 'purchase' then 'accepted' when event_type in ('error', 'signup') or ts + interval 7 days < timestamp '2024-01-20' then 'not_found' when user_id % 2 = 1 then 'mismatch' else 'ok' end as outcome from events""")
def invite_outcomes(spark, d):
    email = F.concat(F.lit("U"), F.col("invited_by") - F.col("invited_by") % 2)
    return _invites(spark, d).select("event_id", S.invite_outcome(F.col("status"), F.col("expires_at"), email, F.concat(F.lit("u"), "invited_by"), AS_OF).alias("outcome"))


@query("""
select event_id, 1 + count(*) over (partition by user_id order by epoch_ms(ts) range between 21599999 preceding and 1 preceding) as used,
       1 + count(*) over (partition by user_id order by epoch_ms(ts) range between 21599999 preceding and 1 preceding) <= 2 as allowed from events""")
def sliding_limiter(spark, d):
    hits = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "ts", "event_id")
    return limiter.limited(hits, 2, 21_600).select("event_id", F.col("used").cast("long").alias("used"), "allowed")


@query("""
select event_id, 1 + count(*) over (partition by user_id order by epoch_ms(ts) range between 21599999 preceding and 1 preceding) as used,
       1 + count(*) over (partition by user_id order by epoch_ms(ts) range between 21599999 preceding and 1 preceding) <= 2 as allowed from events""")
def streaming_limiter(spark, d):
    """The limiter over a stream of events with kept state per user; the whole table is one micro-batch, in which no row is late."""
    path, kind = f"{d}/events.parquet", table(spark, d, "events").schema
    events = scan.read_stream(spark, *_folder(path), kind)
    hits = events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    out = _streamed(spark, limiter.limited_stream(hits, 2, 21_600))
    return out.select("event_id", F.col("used").cast("long").alias("used"), "allowed")


_QUOTA_SQL = """
with a as (select event_id, user_id, ts, strftime(ts, '%Y-%m') as month, case when event_type = 'error' then -1 else 1 end amount from events),
s as (select *, sum(amount) over (partition by user_id, month order by ts, event_id) s from a),
r as (select *, greatest(0, max(s - 20) over (partition by user_id, month order by ts, event_id)) r from s)
select event_id, month, r = coalesce(lag(r) over (partition by user_id, month order by ts, event_id), 0) as allowed, cast(s - r as bigint) as used, cast(20 - s + r as bigint) as remaining from r"""


@query(_QUOTA_SQL)
def quota_calls(spark, d):
    """Each call against a monthly quota of 20, errors as refunds: whether it is allowed and what is left."""
    usage = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("amount"))
    return quota.charged(usage, 20).select("event_id", "month", "allowed", F.col("used").cast("long").alias("used"), F.col("remaining").cast("long").alias("remaining"))


@query(_QUOTA_SQL)
def streaming_quota(spark, d):
    """The same over a stream with kept state for each user and month; the whole table is one micro-batch."""
    events = scan.read_stream(spark, *_folder(f"{d}/events.parquet"), table(spark, d, "events").schema)
    usage = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("amount"))
    return _streamed(spark, quota.charged_stream(usage, 20)).select("event_id", "month", "allowed", "used", "remaining")


@query("""
select 'profiles' as table_, c_custkey as user_id, 'default-' || c_custkey as project_id from customer
union all select 'projects', c_custkey, 'default-' || c_custkey from customer union all select 'members', c_custkey, 'default-' || c_custkey from customer""")
def streaming_sign_up(spark, d):
    """New users as a stream into three tables, each micro-batch once."""
    users = scan.read_stream(spark, *_folder(f"{d}/customer.parquet"), table(spark, d, "customer").schema)
    users = users.select(F.col("c_custkey").cast("long").alias("user_id"), F.concat("c_name", F.lit("@x.org")).alias("email"), F.lit("").alias("display_name"))
    at = f"{shared_dir(spark)}/sign-up-{uuid.uuid4().hex}"
    fanout.sign_ups(users, f"{at}/tables", f"{at}/checkpoint", "2024-01-20").awaitTermination()
    rows = {name: fanout.read(spark, f"{at}/tables", name, kind) for name, kind in fanout.SIGN_UP.items()}
    own = F.substring_index("project_id", "-", -1).cast("long")
    shown = {"profiles": ("user_id", "active_project"), "projects": (own, "project_id"), "members": ("user_id", "project_id")}
    parts = [rows[name].select(F.lit(name).alias("table_"), (F.col(user) if isinstance(user, str) else user).alias("user_id"), F.col(project).alias("project_id")) for name, (user, project) in shown.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _folder(path: str) -> tuple:
    """Streams read folders: a table that is one file is named through a glob of its own name."""
    head, tail = path.rsplit("/", 1)
    return (f"{head}/{tail[:-1]}[{tail[-1]}]",)


def _streamed(spark, stream, mode: str = "append"):
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    scan.run_to_table(stream, f"{at}/out", f"{at}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("""select doc_id, len(regexp_extract_all(lower(text), '\\blicens[a-z]*\\b')) as n_hits from documents where regexp_matches(lower(text), '\\blicens[a-z]*\\b')""")
def streaming_scan(spark, d):
    """The lexicon scan over a stream of documents."""
    from tessera.operators.lexicon import _rule

    docs = scan.read_stream(spark, *_folder(f"{d}/documents.parquet"), table(spark, d, "documents").schema)
    out = _streamed(spark, scan.scan_stream(docs, (_rule("licence", "soft", "", r"\blicens[a-z]*\b", ""),)))
    return out.groupBy("doc_id").agg(F.count("*").alias("n_hits"))


@query("""
select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as n, round(sum(value), 2) as value from events
group by 1, 2 having time_bucket(interval 1 hour, ts) + interval 1 hour <= (select max(ts) from events) - interval 2 hours""")
def streaming_hourly(spark, d):
    """Hourly rollup of a stream in append mode: hours that the watermark has passed; the whole table is one micro-batch."""
    events = scan.read_stream(spark, *_folder(f"{d}/events.parquet"), table(spark, d, "events").schema)
    return _streamed(spark, scan.hourly(events)).select("hour", "event_type", "n", F.round("value", 2).alias("value"))


@query("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3")
def conversation_last_n(spark, d):
    return S.last_messages(table(spark, d, "conversations"), 3).select("conv_id", "turn", "role")


@query("""select user_id, cast(date_trunc('month', ts) as date) as month, sum(case when event_type = 'error' then -1 else 1 end) as used, greatest(0, 60 - sum(case when event_type = 'error' then -1 else 1 end)) as remaining from events group by 1, 2""")
def monthly_quota(spark, d):
    usage = table(spark, d, "events").select("user_id", "ts", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("amount"))
    return S.monthly_quota(usage, 60)


@query("select o_custkey as entry, o_orderkey as version, o_orderdate as valid_from, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as valid_to from orders")
def validity_history(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entry"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("at"))
    return S.validity(o, "entry", "at", "version").drop("at")


@query("""
with a as (select o_custkey % 25 u, count(*) filter (where o_orderdate >= timestamp '1997-06-01') n_month, avg(case when o_orderdate > timestamp '1997-06-20' - interval 30 days then o_totalprice end) mean_score, count(*) filter (where o_orderstatus = 'O') open_items
           from orders where o_orderdate <= timestamp '1997-06-20' group by 1),
c as (select o_custkey % 25 u, count(*) used from orders where o_orderdate between timestamp '1997-06-01' and timestamp '1997-06-20' group by 1)
select u as user_id, coalesce(n_month, 0) as n_month, round(mean_score, 2) as mean_score, coalesce(open_items, 0) as open_items, greatest(0, 30 - coalesce(used, 0)) as credits_left from a full join c using (u)""")
def dashboard_kpis(spark, d):
    o = table(spark, d, "orders").withColumn("user_id", F.col("o_custkey") % 25)
    analyses = o.select("user_id", F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("risk_score"), (F.col("o_orderstatus") == "O").alias("open"))
    usage = o.select("user_id", F.col("o_orderdate").alias("ts"), F.lit(1).alias("amount"))
    k = S.dashboard(analyses, usage, "1997-06-20 00:00:00", 30)
    return k.withColumn("mean_score", F.round("mean_score", 2))


@query("""
with x as (select l.doc_id % 3 v, l.toxic = 1 gold, regexp_matches(lower(d.text), '\\b(?:idiot|clown|worthless|pathetic)\\b') predicted from labels l join documents d using (doc_id)),
g as (select v, count(*) filter (where predicted and gold) tp, count(*) filter (where predicted and not gold) fp, count(*) filter (where not predicted and gold) fn from x group by 1),
f as (select v, case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end f1 from g)
select cast(v as bigint) as version, round(f1, 6) as f1, round(f1 - lag(f1) over (order by v), 6) as f1_change from f""")
def scores_by_version(spark, d):
    """F1 of each version of a detector (a third of the documents each), and the change since the one before."""
    docs = table(spark, d, "documents").select("doc_id", F.lit("toxic").alias("kind"), (F.col("doc_id") % 3).alias("version"), F.col("text").rlike(r"(?iuU)\b(?:idiot|clown|worthless|pathetic)\b").alias("predicted"))
    gold = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("gold"))
    r = C.against_previous(C.precision_recall(gold.join(docs, "doc_id"), ["kind", "version"]), ["kind"], "version")
    return r.select("version", F.round("f1", 6).alias("f1"), F.round("f1_change", 6).alias("f1_change"))


@query("""
select o.o_orderkey as id, coalesce(case when o.o_orderkey % 4 > 0 then cast(o.o_custkey as varchar) end, cast(m.p as varchar), 'default-' || (o.o_custkey % 25)) as project_id
from orders o left join (select c_nationkey u, min(c_custkey) p from customer where c_custkey % 50 = 0 group by 1) m on m.u = o.o_custkey % 25""")
def backfill_default_projects(spark, d):
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") % 50 == 0).alias("is_default"))
    defaults = S.default_project(projects, _members(spark, d))
    a = _analyses(spark, d).withColumn("project_id", F.when(F.col("id") % 4 > 0, F.col("project_id")))
    return S.backfill_projects(a, defaults).select("id", "project_id")


@query("""
with n as (select o_custkey, max(o_orderkey) k from orders group by 1)
select c_custkey as id, case when n.k is null then c_name else 'order-' || n.k end as body from customer left join n on n.o_custkey = c_custkey
union all select o_custkey, 'order-' || k from n where o_custkey not in (select c_custkey from customer)""")
def upsert_latest(spark, d):
    current = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body"))
    incoming = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("order-"), "o_orderkey").alias("body"), F.col("o_orderkey").alias("seq"))
    return S.upsert(current, incoming, "id")


@query("""
with u as (select doc_id id, 'documents' src, 0 p from documents where doc_id % 2 = 0 union all select page_id, 'pages', 1 from pages union all select doc_id, 'documents-2', 2 from documents)
select id, src from u qualify row_number() over (partition by id order by p) = 1""")
def source_union_first_wins(spark, d):
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages")
    parts = [docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("documents").alias("src")), pages.select(F.col("page_id").alias("id"), F.lit("pages").alias("src")), docs.select(F.col("doc_id").alias("id"), F.lit("documents-2").alias("src"))]
    return K.first_source_wins(parts, "id", "src")


@query("""
select page_id, case when not regexp_matches(lower(url), '^https?://') then 'bad_scheme' when regexp_matches(url, '^[a-zA-Z]+://[^/?#]*@') then 'credentials' else 'ok' end as problem from pages""")
def url_checks(spark, d):
    return table(spark, d, "pages").select("page_id", F.coalesce(web.url_problem(F.col("url")), F.lit("ok")).alias("problem"))


@query()
def html_main_text(spark, d):
    """Title, main text and the first problem of every page."""
    return web.extract(table(spark, d, "pages"))


@query("""
select page_id, case when octet_length(encode(case when page_id % 2 = 0 then '%PDF-1.7' else '' end || html)) > 4000 then 'too_large' when page_id % 2 = 1 and not starts_with(html, '%PDF') then 'bad_magic' else 'ok' end as problem from pages where html is not null""")
def binary_checks(spark, d):
    """Pages as bytes that claim to be PDF: size first, then the magic number."""
    content = F.encode(F.concat(F.when(F.col("page_id") % 2 == 0, "%PDF-1.7").otherwise(""), "html"), "UTF-8")
    return table(spark, d, "pages").where("html is not null").select("page_id", F.coalesce(web.binary_problem(content, limit=4000), F.lit("ok")).alias("problem"))


@query("select page_id, not contains(url, '/fr/') as allowed from pages")
def robots_rules(spark, d):
    pages = table(spark, d, "pages")
    hosts = pages.select(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host")).where("host is not null").distinct()
    rules = hosts.withColumns({"status": F.lit(200), "body": F.lit("User-agent: *\nDisallow: /fr/\n")})
    return web.robots_allowed(pages, rules).select("page_id", "allowed")


@query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
k as (select doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) t, row_number() over (partition by doc_id order by i) n from l where trim(regexp_replace(t, '\s+', ' ', 'g')) <> '')
select 'r-art' || doc_id || '-para' || n as chunk_id, cast(doc_id as integer) as article, 'Zweck' as article_title, cast(n as integer) as paragraph, t as text, 'KAPITEL I' as section, false as is_annex from k""")
def html_chunks(spark, d):
    """Each document as an article of a regulation, a paragraph for each line."""
    escape = lambda t: F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda t: F.concat(F.lit('<p class="oj-normal">'), escape(t), F.lit("</p>"))), "\n")
    html = F.concat(F.lit('<p class="oj-ti-section-1">KAPITEL I</p><p class="oj-ti-art">Artikel '), "doc_id", F.lit('</p><p class="oj-sti-art">Zweck</p>'), lines)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return regulation.chunks(docs, "r").select("chunk_id", "article", "article_title", "paragraph", "text", "section", "is_annex")


@query("""
select case when p_partkey % 7 > 0 then 'P-' || p_partkey else 'gen-' end as id, p_brand as nutrient, case when p_partkey % 14 > 0 then p_name end as claim_en, case when p_partkey % 28 = 0 then 'de ' || p_partkey end as claim_de,
       case p_size % 4 when 0 then 'authorised' when 2 then 'on_hold' else 'non_authorised' end as status,
       case p_size % 5 when 0 then 'art_13_1' when 1 then 'art_13_5' when 2 then 'art_14_1_a' when 3 then 'art_14_1_b' else 'unknown' end as claim_type,
       case p_partkey % 4 when 0 then date '2012-05-05' when 1 then date '2013-12-31' when 2 then date '2014-01-02' end as entry_date
from part where p_partkey % 7 > 0 or p_partkey % 14 > 0 or p_partkey % 28 = 0""")
def register_entries(spark, d):
    """Parts as a register sheet under one year's headers."""
    k, pick = F.col("p_partkey"), lambda n, *v: F.get(F.array(*map(F.lit, v)), n.cast("int"))
    sheet = table(spark, d, "part").select(
        F.when(k % 7 > 0, F.concat(F.lit("P-"), k)).alias("Claim ID"),
        F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("Nutrient, substance, food or food category"),
        F.when(k % 14 > 0, F.col("p_name")).otherwise(" ").alias("Claim."),
        F.when(k % 28 == 0, F.concat(F.lit("de "), k)).alias("Claim (DE)"),
        pick(F.col("p_size") % 4, "Authorized", "Non-authorised", "On hold", "whatever").alias("Status"),
        pick(F.col("p_size") % 5, "Art. 13(1)", "Art 13.5", "Article 14 (1)(a)", "Art 14(1)(b) children", None).alias("Claim type"),
        pick(k % 4, "5.5.2012", "2013-12-31", "20140102", "x").alias("Entry date"),
    )
    e = register.entries(sheet)
    return e.select(F.when(F.col("id").startswith("gen-"), "gen-").otherwise(F.col("id")).alias("id"), "nutrient", "claim_en", "claim_de", "status", "claim_type", "entry_date")


@query(rf"""
with l as (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 n from documents),
k as (select doc_id, t, n, row_number() over (partition by doc_id order by n) i from (select doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) t, n from l) where length(t) > 10)
select cast(doc_id as varchar) as doc, 'vo432-' || lpad(cast(i as varchar), cast(greatest(3, length(cast(i as varchar))) as integer), '0') as id,
       nullif(trim(regexp_extract(t, '{X.NUTRIENT_HINT}', 1)), '') as nutrient, t as claim_de,
       nullif(concat_ws(' — ', case when n % 2 = 0 then 'nur so' end, case when n % 3 = 0 then 'Beschränkungen: keine' end), '') as conditions from k""")
def annex_rows(spark, d):
    """Lines of documents as rows of an annex's table."""
    lines = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("n", "t"))
    cells = F.array("t", F.when(F.col("n") % 2 == 0, "nur\nso"), F.when(F.col("n") % 3 == 0, "kei\xad\nne"), F.lit(None).cast("string"))
    return register.annex_entries(lines.select("doc", "page", "n", cells.alias("cells"))).select("doc", "id", "nutrient", "claim_de", "conditions")


@query("""
with f as (select p_partkey - p_partkey % 2 k, p_partkey, p_name, p_brand, p_type from part qualify row_number() over (partition by p_partkey - p_partkey % 2 order by p_partkey) = 1)
select cast(k as varchar) as key, p_name as food, case when p_partkey % 3 < 2 then p_brand end as health_relationship, case when p_partkey % 4 > 0 then p_type else 'later' end as pending_claim,
       'efsa-' || left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 40) || '-' || k as id from f""")
def botanical_rows(spark, d):
    """Parts as rows of a sheet of pending claims: two rows a key, of which the first counts; revised wordings fill gaps."""
    k = F.col("p_partkey")
    food = F.when(k % 3 == 0, F.concat(F.lit("X - "), "p_name", F.lit(" - "), "p_brand")).when(k % 3 == 1, F.concat("p_name", F.lit(" - "), "p_brand")).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select(k.alias("seq"), (k - k % 2).cast("string").alias("key"), food.alias("food_text"), F.when(k % 4 > 0, F.col("p_type")).otherwise("").alias("original"), F.lit("later").alias("revised"))
    return register.botanical_entries(rows).select("key", "food", "health_relationship", "pending_claim", "id")


def knowledge_chunks(spark, d):
    """Rows of five tables as entries of the five sources, as chunks."""
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    reg = table(spark, d, "part").select(F.concat(F.lit("P-"), "p_partkey").alias("id"), F.col("p_brand").alias("nutrient"), F.col("p_name").alias("claim_en"), F.lit("authorised").alias("status"), F.lit("art_13_1").alias("claim_type"), *none("claim_de", "conditions", "regulation_reference"))
    law = table(spark, d, "nation").select(F.concat(F.lit("r-"), "n_nationkey").alias("chunk_id"), F.lit("1924").alias("regulation_id"), F.col("n_nationkey").alias("article"), F.col("n_name").alias("article_title"), F.col("n_regionkey").alias("paragraph"), F.lit("Text").alias("text"), F.lit("S").alias("section"), F.lit(False).alias("is_annex"), *none("eur_lex_url"))
    exc = table(spark, d, "supplier").select(F.concat(F.lit("x-"), "s_suppkey").alias("chunk_id"), F.lit("VO X").alias("regulation_id"), F.col("s_suppkey").cast("string").alias("article"), F.col("s_name").alias("title"), F.lit("S").alias("snippet"), F.array(F.lit("a"), F.lit("b")).alias("tags"), *none("paragraph", "source_url"))
    case = table(spark, d, "customer").select(F.concat(F.lit("c-"), "c_custkey").alias("id"), F.lit("BGH").alias("court"), F.concat(F.lit("I ZR "), "c_custkey", F.lit("/16")).alias("case_number"), F.lit("2018-01-01").alias("decision_date"), F.col("c_name").alias("title"), F.lit("S").alias("summary"), F.array().cast("array<string>").alias("legal_basis"), F.array().cast("array<string>").alias("tags"), *none("claim_type", "decision", "source_url", "verification_status", "ai_confidence"))
    bot = table(spark, d, "region").select(F.concat(F.lit("b-"), "r_regionkey").alias("id"), F.lit("Curcuma longa").alias("scientific_name"), F.col("r_name").alias("common_name_de"), F.array(F.lit("Gelbwurz")).alias("common_names"), F.lit("on_hold").alias("status"), *none("health_relationship", "summary", "source_url"))
    parts = [K.register_chunks(reg), K.regulation_chunks(law), K.excerpt_chunks(exc), K.case_chunks(case), K.botanical_chunks(bot)]
    return K.union(parts)



@query("""
select 'P-' || p_partkey as chunk_id, 'eu_claim' as source_type, 'EU-Register · ' || p_brand as reference, p_brand || ' — ' || p_name as embedding_text from part
union all select 'r-' || n_nationkey, 'regulation', 'VO 1924, Art. ' || n_nationkey || case when n_regionkey > 0 then ' Abs. ' || n_regionkey else '' end, n_name || ' — Text' from nation
union all select 'x-' || s_suppkey, 'regulation', 'VO X § ' || s_suppkey, s_name || ' — S — a b' from supplier
union all select 'c-' || c_custkey, 'case_law', 'BGH I ZR ' || c_custkey || '/16 (2018-01-01)', c_name || ' — S' from customer
union all select 'b-' || r_regionkey, 'botanical', 'EFSA-Botanical · ' || r_name || ' (Curcuma longa) · EFSA on-hold', 'Curcuma longa — ' || r_name || ' — Gelbwurz' from region""")
def knowledge_payloads(spark, d):
    return knowledge_chunks(spark, d).select("chunk_id", "source_type", "reference", "embedding_text")


@query()
def knowledge_search(spark, d):
    """Benchmark items searched in the kept table of all five sources; a second refresh has nothing to embed."""
    path = f"{shared_dir(spark)}/knowledge-{uuid.uuid4().hex}"
    chunks = knowledge_chunks(spark, d)
    knowledge_index.refresh(chunks, path)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = knowledge_index.search(knowledge_index.read_table(spark, path), items)
    return found.select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), F.col("rank").cast("long").alias("rank"))


@query("select source_type, n as embedded, cast(0 as bigint) as embedded_again from (select 'eu_claim' source_type, count(*) n from part union all select 'regulation', (select count(*) from nation) + (select count(*) from supplier) union all select 'case_law', count(*) from customer union all select 'botanical', count(*) from region)")
def knowledge_refresh(spark, d):
    """How many chunks of each source a first and a second refresh embed."""
    path, chunks = f"{shared_dir(spark)}/knowledge-{uuid.uuid4().hex}", knowledge_chunks(spark, d)
    first, again = (knowledge_index.refresh(chunks, path).select("source_type", "embedded") for _ in range(2))
    return first.join(again.withColumnRenamed("embedded", "embedded_again"), "source_type")


@query("""
with v as (select 't' || (o_custkey % 50) task, o_orderkey % 3 a, o_orderkey % 12 b, o_orderkey % 7 c from orders where o_orderkey % 5 > 0)
select task, a || '.' || b || '.' || c as version from v qualify row_number() over (partition by task order by a desc, b desc, c desc) = 1""")
def semver_latest(spark, d):
    """Orders as prompt files, some with a version that is none; of each task the latest."""
    k = F.col("o_orderkey")
    version = F.when(k % 5 == 0, "x").otherwise(F.concat_ws(".", k % 3, k % 12, k % 7))
    raw = F.concat(F.lit("---\ntask: t"), F.col("o_custkey") % 50, F.lit("\nversion: "), version, F.lit("\nmodel: m\nauthor: x\ncreated_at: 2026-01-01\ndescription: d\n---\nHello {{ name }}"))
    files = table(spark, d, "orders").select(F.concat(F.lit("p"), k).alias("path"), raw.alias("raw"))
    return prompts.latest(prompts.parse_prompts(files).where("valid")).select("task", "version")


@query("select doc_id, doc_id % 2 = 0 and doc_id % 3 <> 1 as shortcut from documents where text is not null")
def disease_shortcut(spark, d):
    """Documents as claims, some of which end with an obvious disease claim."""
    end = F.when(F.col("doc_id") % 3 == 0, " heilt alles").when(F.col("doc_id") % 3 == 1, " Leberfunktion").otherwise(" WIRKT gegen x")
    kind = F.when(F.col("doc_id") % 2 == 0, "disease_based").otherwise("wellbeing_based")
    df = table(spark, d, "documents").where("text is not null").select("doc_id", kind.alias("kind"), F.concat("text", end).alias("claim"))
    return df.select("doc_id", V.disease_shortcut(F.col("kind"), F.col("claim")).isNotNull().alias("shortcut"))


@query("""
select o_orderkey as id, case when o_orderkey % 13 >= 10 then 'project_limit' when o_orderkey % 11 >= 10 then 'member_limit' when o_orderkey % 60 >= 50 then 'invite_limit' when o_orderkey % 17 = 0 then 'default_protected' when o_orderkey % 5 = 0 and o_orderkey % 3 <= 1 then 'last_owner' else 'ok' end as code from orders""")
def project_limit_checks(spark, d):
    k = F.col("o_orderkey")
    facts = table(spark, d, "orders").select(k.alias("id"), (k % 13).alias("owned_projects"), (k % 11).alias("members"), (k % 60).alias("invites_today"), (k % 17 == 0).alias("is_default"), F.when(k % 5 == 0, "owner").otherwise("viewer").alias("role"), (k % 3).alias("owners"))
    return S.project_checks(facts).select("id", "code")


@query("select c_mktsegment as nutrient, count(*) as n from customer group by 1 order by n desc, 1 limit 10")
def top_nutrients(spark, d):
    return register.most_frequent(table(spark, d, "customer").select(F.col("c_mktsegment").alias("nutrient")), "nutrient")


@query("""
select status, claim_type, count(*) as n from (select case p_partkey % 4 when 0 then 'authorised' when 1 then 'on_hold' else 'non_authorised' end as status, case p_partkey % 3 when 0 then 'art_13_1' when 1 then 'art_14_1_b' else 'unknown' end as claim_type from part) group by 1, 2""")
def register_status_counts(spark, d):
    """Parts as register rows with outcomes and articles in several spellings, counted by what they mean."""
    k = F.col("p_partkey")
    outcome = F.when(k % 4 == 0, F.when(k % 8 == 0, "Authorized").otherwise(" authorised")).when(k % 4 == 1, "On hold").when(k % 4 == 2, "Rejected")
    article = F.when(k % 3 == 0, "Art. 13(1)").when(k % 3 == 1, "Article 14 (1)(b), children")
    sheet = table(spark, d, "part").select(k.cast("string").alias("Claim ID"), F.col("p_name").alias("Claim"), outcome.alias("Status"), article.alias("Claim type"))
    return register.status_counts(register.entries(sheet))
