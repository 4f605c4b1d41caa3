"""The analyses store: lists, scoping, soft deletion, purges, projects, invites and limits.

Plain Parquet has no MERGE or DELETE, so writers return the new state as a DataFrame
(copy-on-write); the caller commits it by overwriting partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import preview

RESTORE_DAYS = 30
MAX_PROJECTS, MAX_MEMBERS, MAX_INVITES_A_DAY = 10, 10, 50
WRITERS = ("owner", "editor")
#: Roles that may do what, on which table.
ALLOWED = {("analyses", "select"): ("owner", "editor", "viewer"), ("analyses", "write"): WRITERS, ("projects", "write"): ("owner",), ("members", "write"): ("owner",), ("invites", "write"): ("owner",)}


def live(df: DataFrame) -> DataFrame:
    return df.where("deleted_at is null")


def visible_to(df: DataFrame, members: DataFrame, user_id, table: str = "analyses", verb: str = "select") -> DataFrame:
    """Rows of the projects in which the user has a role that allows the verb."""
    roles = ALLOWED.get((table, verb), ("owner", "editor", "viewer"))
    mine = members.where((F.col("user_id") == F.lit(user_id)) & F.col("role").isin(*roles)).select("project_id")
    return df.join(mine, "project_id", "left_semi")


def removable_members(members: DataFrame, user_id) -> DataFrame:
    """Members whom the user may remove: themselves, or all of a project they own."""
    owned = members.where((F.col("user_id") == F.lit(user_id)) & (F.col("role") == "owner")).select("project_id", F.lit(True).alias("_own"))
    return members.join(owned, "project_id", "left").where((F.col("user_id") == F.lit(user_id)) | F.coalesce("_own", F.lit(False))).drop("_own")


def history_page(analyses: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of live analyses, newest first. The sort is limited, so Spark keeps only offset + limit rows."""
    limit = 100 if limit > 100 else 20 if limit < 1 else limit
    rows = live(analyses).select("id", "project_id", "user_id", "created_at", "language", preview(F.col("input_text")).alias("preview"), "risk_score")
    return rows.orderBy(F.desc("created_at"), "id").offset(max(0, offset)).limit(limit)


def soft_delete(analyses: DataFrame, ids: DataFrame, at) -> DataFrame:
    """Live rows among ids get deleted_at; others stay as they are; changed tells which."""
    mark = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    df = analyses.join(mark, "id", "left").withColumn("changed", F.coalesce("_hit", F.lit(False)) & F.col("deleted_at").isNull())
    return df.withColumn("deleted_at", F.when(F.col("changed"), F.lit(at).cast("timestamp")).otherwise(F.col("deleted_at"))).drop("_hit")


def restore(analyses: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """outcome: live (nothing to do), restored, gone (deleted over RESTORE_DAYS ago), or null for rows not among ids."""
    mark = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    oldest = F.lit(as_of).cast("timestamp") - F.expr(f"interval {RESTORE_DAYS} days")
    outcome = F.when(F.col("_hit").isNull(), None).when(F.col("deleted_at").isNull(), "live").when(F.col("deleted_at") >= oldest, "restored").otherwise("gone")
    df = analyses.join(mark, "id", "left").withColumn("outcome", outcome)
    return df.withColumn("deleted_at", F.when(F.coalesce(F.col("outcome") == "restored", F.lit(False)), None).otherwise(F.col("deleted_at"))).drop("_hit")


def purge(analyses: DataFrame, as_of) -> DataFrame:
    """Without rows deleted over RESTORE_DAYS ago."""
    oldest = F.lit(as_of).cast("timestamp") - F.expr(f"interval {RESTORE_DAYS} days")
    return analyses.where(F.col("deleted_at").isNull() | (F.col("deleted_at") >= oldest))


def clean_invites(invites: DataFrame, as_of) -> DataFrame:
    """Pending invites past expiry expire; then settled invites of over 30 days ago go."""
    now = F.lit(as_of).cast("timestamp")
    status = F.when((F.col("status") == "pending") & (F.col("expires_at") < now), "expired").otherwise(F.col("status"))
    return invites.withColumn("status", status).where((F.col("status") == "pending") | (F.col("invited_at") >= now - F.expr("interval 30 days")))


def invite_outcome(status: Column, expires_at: Column, email: Column, user_email: Column, as_of) -> Column:
    """accepted, not_found, mismatch or ok, checked in this order."""
    expired = expires_at < F.lit(as_of).cast("timestamp")
    return F.when(status == "accepted", "accepted").when(status.isin("revoked", "expired") | expired, "not_found").when(F.lower(email) != F.lower(user_email), "mismatch").otherwise("ok")


def invites_last_day(invites: DataFrame, as_of) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    recent = F.col("invited_at").between(now - F.expr("interval 24 hours"), now)
    return invites.where(recent).groupBy("invited_by").agg(F.count("*").alias("n_invites")).withColumn("allowed", F.col("n_invites") < MAX_INVITES_A_DAY)


def project_list(projects: DataFrame, members: DataFrame, user_id) -> DataFrame:
    """The user's projects with role and number of members; the default one first, then by name."""
    mine = members.where(F.col("user_id") == F.lit(user_id)).select("project_id", "role")
    counts = members.join(mine.select("project_id"), "project_id", "left_semi").groupBy("project_id").agg(F.count("*").alias("member_count"))
    rows = projects.join(mine, "project_id").join(counts, "project_id", "left").withColumn("member_count", F.coalesce("member_count", F.lit(1)))
    return rows.orderBy(~F.col("is_default"), F.lower("name"), "project_id")


def member_list(members: DataFrame, users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Members with e-mail and display name, null where unknown or empty."""
    names = profiles.select("user_id", F.when(F.trim("display_name") != "", F.col("display_name")).alias("display_name"))
    return members.join(users.select("user_id", "email"), "user_id", "left").join(names, "user_id", "left")


def default_project(projects: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, project_id): each user's default project, the least id of several."""
    return members.join(projects.where("is_default"), "project_id").groupBy("user_id").agg(F.min("project_id").alias("project_id"))


def backfill_projects(analyses: DataFrame, defaults: DataFrame) -> DataFrame:
    """Analyses without a project take their user's default, or a new one named after the user."""
    d = defaults.select(F.col("user_id"), F.col("project_id").alias("_default"))
    fresh = F.concat(F.lit("default-"), F.col("user_id").cast("string"))
    return analyses.join(d, "user_id", "left").withColumn("project_id", F.coalesce(F.col("project_id").cast("string"), F.col("_default").cast("string"), fresh)).drop("_default")


def target_project(payload: Column, header: Column, active: Column, default: Column) -> Column:
    return F.coalesce(payload, header, active, default)


def project_checks(facts: DataFrame) -> DataFrame:
    """code of the first limit that an action on counted facts breaks, or ok."""
    code = F.when(F.col("owned_projects") >= MAX_PROJECTS, "project_limit").when(F.col("members") >= MAX_MEMBERS, "member_limit").when(F.col("invites_today") >= MAX_INVITES_A_DAY, "invite_limit").when(F.col("is_default"), "default_protected").when((F.col("role") == "owner") & (F.col("owners") <= 1), "last_owner").otherwise("ok")
    return facts.withColumn("code", code)


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Insert or replace whole rows by key; of several incoming rows with one key the last by `seq` stays."""
    last = incoming.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("seq")))).where("_k = 1").drop("_k", "seq")
    return current.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def validity(entries: DataFrame, key: str, at: str, version: str) -> DataFrame:
    """valid_from and valid_to of each version of an entry; the open one has no end. Versions of one time follow in their order."""
    return entries.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(W.partitionBy(key).orderBy(at, version)))


def last_messages(messages: DataFrame, n: int = 20) -> DataFrame:
    order = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def monthly_quota(usage: DataFrame, quota: int) -> DataFrame:
    """Used and remaining units for each user and month; refunds are negative amounts."""
    month = F.date_trunc("month", "ts").cast("date").alias("month")
    return usage.groupBy("user_id", month).agg(F.sum("amount").alias("used")).withColumn("remaining", F.greatest(F.lit(0), quota - F.col("used")))


def project_counts(members: DataFrame) -> DataFrame:
    """Members of each project, by role."""
    n = lambda role: F.count_if(F.col("role") == role).alias(f"{role}s")
    return members.groupBy("project_id").agg(F.count("*").alias("members"), n("owner"), n("editor"), n("viewer"))


def dashboard(analyses: DataFrame, usage: DataFrame, as_of: str, credits: int) -> DataFrame:
    """For each user(user_id) at a time: analyses of the month, mean score of 30 days, open items, credits left this month.

    analyses(user_id, created_at, risk_score, open), usage(user_id, ts, amount); what lies after as_of doesn't count.
    """
    now = F.lit(as_of).cast("timestamp")
    month = F.date_trunc("month", now)
    at = F.col("created_at").cast("timestamp")
    a = analyses.where(at <= now).groupBy("user_id").agg(F.count_if(at >= month).alias("n_month"), F.avg(F.when(at > now - F.expr("interval 30 days"), F.col("risk_score"))).alias("mean_score"), F.count_if("open").alias("open_items"))
    ts = F.col("ts").cast("timestamp")
    used = usage.where((ts >= month) & (ts <= now)).groupBy("user_id").agg(F.sum("amount").alias("used"))
    return a.join(used, "user_id", "full").select("user_id", F.coalesce("n_month", F.lit(0)).alias("n_month"), "mean_score", F.coalesce("open_items", F.lit(0)).alias("open_items"), F.greatest(F.lit(0), credits - F.coalesce("used", F.lit(0))).alias("credits_left"))
