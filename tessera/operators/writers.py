"""Writers of the analyses store: each takes tables and returns the new state or the rows to append.

Plain Parquet has no MERGE, so the caller commits a new state by overwriting and appends rows as
they are. Times are arguments, so a retried job writes the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.tables import exists

NAME_LENGTH = 80
INVITE_DAYS = 7


def persist(analyses: DataFrame, at: str) -> DataFrame:
    """Analyses (user_id, project_id, input_text, ...) with id, created_at and warning.

    The id comes from the row, so a retry doesn't write it twice. A row that can't be stored, without
    a user, project or text, has a null id and the warning persist_failed; it is reported, not raised.
    """
    good = F.col("user_id").isNotNull() & F.col("project_id").isNotNull() & (F.coalesce(F.trim("input_text"), F.lit("")) != "")
    made = F.sha2(F.to_json(F.struct("user_id", "project_id", "input_text", F.lit(at).alias("at"))), 256)
    return analyses.withColumns({"id": F.when(good, F.substring(made, 1, 32)), "created_at": F.lit(at).cast("timestamp"), "warning": F.when(~good, "persist_failed")})


def name_problem(name: Column) -> Column:
    n = F.length(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(n == 0, "name_missing").when(n > NAME_LENGTH, "name_too_long")


def create_projects(wanted: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append to projects and members for wanted(project_id, user_id, name, color): each creator becomes owner."""
    good = wanted.where(name_problem(F.col("name")).isNull())
    stamp = F.lit(at).cast("timestamp")
    projects = good.select("project_id", F.trim("name").alias("name"), "color", F.lit(False).alias("is_default"), stamp.alias("created_at"), stamp.alias("updated_at"))
    return projects, good.select("project_id", "user_id", F.lit("owner").alias("role"), stamp.alias("joined_at"))


def patch_projects(projects: DataFrame, patches: DataFrame, at: str) -> DataFrame:
    """projects with patches(project_id, name, color) applied: null fields stay, an empty patch changes nothing, a bad name isn't taken."""
    p = patches.select("project_id", F.when(name_problem(F.col("name")).isNull(), F.trim("name")).alias("_name"), F.col("color").alias("_color"))
    df = projects.join(p, "project_id", "left")
    new = {"name": F.coalesce("_name", "name"), "color": F.coalesce("_color", "color")}
    changed = F.lit(False)
    for c, value in new.items():
        changed = changed | ~value.eqNullSafe(F.col(c))
    return df.withColumn("updated_at", F.when(changed, F.lit(at).cast("timestamp")).otherwise(F.col("updated_at"))).withColumns(new).drop("_name", "_color")


def change_members(members: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """The members after changes(project_id, user_id, action, role), one for each member, with outcome.

    add inserts unless there, set changes the role, remove takes the row out (role null). Owners of a
    project all of whose owners would go keep their role: last_owner. What can't be done is absent.
    """
    c = changes.select("project_id", "user_id", F.col("action"), F.col("role").alias("_role"))
    df = members.select("project_id", "user_id", "role", "joined_at").join(c, ["project_id", "user_id"], "full")
    there = F.col("role").isNotNull()
    wanted = F.when(F.col("action").isNull(), F.col("role")).when((F.col("action") == "add") & ~there, F.col("_role")).when((F.col("action") == "set") & there, F.col("_role")).when((F.col("action") == "remove") & there, None).otherwise(F.col("role"))
    df = df.withColumn("_new", wanted)
    owners = df.groupBy("project_id").agg(F.count_if(F.col("role") == "owner").alias("_before"), F.count_if(F.col("_new") == "owner").alias("_after"))
    df = df.join(owners, "project_id")
    kept = there & (F.col("role") == "owner") & ~F.col("_new").eqNullSafe(F.lit("owner")) & (F.col("_before") > 0) & (F.col("_after") == 0)
    outcome = F.when(F.col("action").isNull(), "unchanged").when(kept, "last_owner").when((F.col("action") == "add") & there, "exists").when((F.col("action") != "add") & ~there, "absent").otherwise("done")
    df = df.withColumns({"outcome": outcome, "role": F.when(kept, F.col("role")).otherwise(F.col("_new")), "joined_at": F.coalesce("joined_at", F.lit(at).cast("timestamp"))})
    return df.select("project_id", "user_id", "role", "joined_at", "outcome").where("role is not null or outcome <> 'unchanged'")


def create_invites(invites: DataFrame, wanted: DataFrame, at: str, together: bool = True) -> DataFrame:
    """wanted(invite_id, project_id, email, role, invited_by) as invites; one that is pending for the project and address already is given back (reused).

    together: wanted are stored as one batch, so of several for one project and address the least id is
    made and given back to the others. Otherwise each is answered from invites alone, as if no other were wanted.
    """
    open_ = invites.where((F.col("status") == "pending") & (F.col("expires_at") >= F.lit(at).cast("timestamp")))
    old = open_.groupBy("project_id", F.lower("email").alias("_email")).agg(F.min("invite_id").alias("_old"))
    df = wanted.withColumn("_email", F.lower(F.trim("email"))).join(old, ["project_id", "_email"], "left")
    if together:
        first = F.min("invite_id").over(W.partitionBy("project_id", "_email"))
        df = df.withColumn("_old", F.coalesce("_old", F.when(F.col("project_id").isNotNull() & F.col("_email").isNotNull() & (first != F.col("invite_id")), first)))
    stamp = F.lit(at).cast("timestamp")
    return df.select(F.coalesce("_old", "invite_id").alias("invite_id"), "project_id", F.col("_email").alias("email"), "role", "invited_by", F.lit("pending").alias("status"), stamp.alias("invited_at"), (stamp + F.expr(f"interval {INVITE_DAYS} days")).alias("expires_at"), F.col("_old").isNotNull().alias("reused"))


def settle_invites(invites: DataFrame, actions: DataFrame, at: str) -> DataFrame:
    """invites after actions(invite_id, action) with outcome: accept and revoke only change what is pending, accept only before expiry."""
    df = invites.join(actions.select("invite_id", "action"), "invite_id", "left")
    pending, late = F.col("status") == "pending", F.col("expires_at") < F.lit(at).cast("timestamp")
    outcome = F.when(F.col("action").isNull(), "unchanged").when(~pending, "settled").when((F.col("action") == "accept") & late, "expired").when(F.col("action") == "accept", "accepted").when(F.col("action") == "revoke", "revoked").otherwise("unchanged")
    status = F.when(outcome.isin("accepted", "revoked", "expired"), outcome).otherwise(F.col("status"))
    settled = F.when(outcome.isin("accepted", "revoked"), F.lit(at).cast("timestamp"))
    return df.withColumn("outcome", outcome).withColumns({"status": status, "settled_at": settled}).drop("action")


def pending_invites(invites: DataFrame, project_id) -> DataFrame:
    """A project's open invites, the newest first."""
    return invites.where((F.col("project_id") == F.lit(project_id)) & (F.col("status") == "pending")).orderBy(F.desc("invited_at"), "invite_id")


def public_invite(invites: DataFrame, projects: DataFrame) -> DataFrame:
    """What the holder of an invite's link may see: no ids of people or projects, the address with its name hidden."""
    hidden = F.concat(F.substring("email", 1, 1), F.lit("…@"), F.substring_index("email", "@", -1))
    return invites.join(projects.select("project_id", F.col("name").alias("project")), "project_id", "left").select("invite_id", "project", hidden.alias("email"), "role", "status", "expires_at")


def set_active(profiles: DataFrame, wanted: DataFrame, members: DataFrame) -> DataFrame:
    """profiles with active_project from wanted(user_id, project_id): null clears it, a project the user isn't in changes nothing."""
    mine = members.select("user_id", F.col("project_id").alias("_project"), F.lit(True).alias("_in")).distinct()
    w = wanted.select("user_id", F.col("project_id").alias("_project"), F.lit(True).alias("_asked")).join(mine, ["user_id", "_project"], "left")
    df = profiles.join(w, "user_id", "left")
    new = F.when(F.col("_asked") & F.col("_project").isNull(), None).when(F.col("_asked") & F.col("_in"), F.col("_project")).otherwise(F.col("active_project"))
    return df.withColumn("active_project", new).drop("_project", "_asked", "_in")


def sign_up(users: DataFrame, at: str) -> dict:
    """Rows of four tables for new users(user_id, email, display_name): profile with its active project, default project, owner row."""
    stamp, project = F.lit(at).cast("timestamp"), F.concat(F.lit("default-"), F.col("user_id").cast("string"))
    name = F.coalesce(F.when(F.trim("display_name") != "", F.trim("display_name")), F.substring_index("email", "@", 1))
    return {
        "profiles": users.select("user_id", name.alias("display_name"), project.alias("active_project"), stamp.alias("created_at")),
        "projects": users.select(project.alias("project_id"), F.lit("Default").alias("name"), F.lit(True).alias("is_default"), stamp.alias("created_at")),
        "members": users.select(project.alias("project_id"), "user_id", F.lit("owner").alias("role"), stamp.alias("joined_at")),
    }


def missing_defaults(analyses: DataFrame, defaults: DataFrame, at: str) -> dict:
    """Default projects and owner rows to append for users who have analyses without a project and no default (user_id, project_id) yet."""
    users = analyses.where("project_id is null and user_id is not null").select("user_id").distinct().join(defaults, "user_id", "left_anti")
    rows = sign_up(users.withColumns({"email": F.lit("@"), "display_name": F.lit("")}), at)
    return {t: rows[t] for t in ("projects", "members")}


def touch(after: DataFrame, before: DataFrame, key: str, at: str) -> DataFrame:
    """after, with updated_at set on new rows and on those that differ from before in another column."""
    columns = [c for c in after.columns if c not in (key, "updated_at")]
    old = before.select(F.col(key), F.struct(*columns).alias("_old"), F.col("updated_at").alias("_at"))
    df = after.drop("updated_at").join(old, key, "left")
    same = F.struct(*columns).eqNullSafe(F.col("_old"))
    return df.withColumn("updated_at", F.when(same, F.col("_at")).otherwise(F.lit(at).cast("timestamp"))).drop("_old", "_at")


def merge_rewrites(claims: DataFrame, rewrites: DataFrame) -> DataFrame:
    """claims with the rewrite of rewrites(claim_id, rewrite), where that is one."""
    new = rewrites.select("claim_id", F.col("rewrite").alias("_new"))
    return claims.join(new, "claim_id", "left").withColumn("rewrite", F.coalesce(F.when(F.trim("_new") != "", F.col("_new")), F.col("rewrite"))).drop("_new")


def unevaluated(detected: DataFrame, evaluated: DataFrame) -> DataFrame:
    return detected.join(evaluated.select("claim_id"), "claim_id", "left_anti")


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def ensure_table(spark: SparkSession, path: str, schema: str, partition: str) -> DataFrame:
    """The Parquet table at path, made empty with its schema if there is none yet."""
    if not exists(spark, path):
        spark.createDataFrame([], schema).write.partitionBy(partition).parquet(path)
    return spark.read.schema(schema).parquet(path)


def of_width(vectors: DataFrame, column: str, width: int) -> DataFrame:
    """vectors; one of another length than width is an error when it is written."""
    wrong = F.raise_error(F.format_string(f"a vector has %d numbers, not {width}", F.size(column))).cast(vectors.schema[column].dataType)
    return vectors.withColumn(column, F.when(F.col(column).isNull() | (F.size(column) == width), F.col(column)).otherwise(wrong))


def in_one(tables: dict) -> DataFrame:
    """Tables as rows (table, row as JSON), for a log or a comparison."""
    return reduce(DataFrame.unionByName, [t.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row")) for name, t in tables.items()])
