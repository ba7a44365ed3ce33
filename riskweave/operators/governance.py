"""Events, notifications, audit, erasure, invites and policy presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from riskweave import fixed_values as fv
from riskweave.operators.analytics import display_name
from riskweave.operators.spread_join import spread_join
from riskweave.schemas import missing


def _event(kind, old: Column, new: Column, comment: Column | None = None) -> Column:
    return F.struct(
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("event_type"),
        old.cast("string").alias("old_value"), new.cast("string").alias("new_value"),
        (F.lit(None) if comment is None else comment).cast("string").alias("comment"))


# E1 -----------------------------------------------------------------------
def finding_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events that lead from one snapshot of findings to the next, only for real changes.

    after may carry `actor_id` and `comment`.
    """
    b = before.select("id", F.col("status").alias("_s"), F.col("verification_status").alias("_v"),
                      F.col("assignee_id").alias("_a"))
    joined = after.join(b, "id")
    actor = F.col("actor_id") if "actor_id" in after.columns else F.lit(None).cast("string")
    note = F.trim(F.col("comment")) if "comment" in after.columns else F.lit(None).cast("string")
    nothing = F.lit(None).cast("string")
    s, v, a = F.col("status"), F.col("verification_status"), missing(F.col("assignee_id"))
    changed_assignee = ~a.eqNullSafe(F.col("_a"))
    events = F.array(
        F.when(missing(s).isNotNull() & ~s.eqNullSafe(F.col("_s")), _event("status_changed", F.col("_s"), s)),
        F.when(missing(v).isNotNull() & ~v.eqNullSafe(F.col("_v")),
               _event("verification_status_changed", F.col("_v"), v)),
        F.when(missing(note).isNotNull(), _event("comment", nothing, nothing, note)),
        F.when(changed_assignee, _event(F.when(a.isNull(), "unassigned").otherwise("assigned"), F.col("_a"), a)),
    )
    return joined.select(F.col("id").alias("finding_id"), actor.alias("user_id"),
                         F.explode(F.array_compact(events)).alias("e")).select("finding_id", "user_id", "e.*")


def reopened_events(carried: DataFrame) -> DataFrame:
    """Events for findings that came back after they were fixed."""
    return carried.filter((F.col("status") == "reopened") & (F.col("previous_status") == "fixed")).select(
        F.col("id").alias("finding_id"), F.lit("reopened").alias("event_type"),
        F.lit("fixed").alias("old_value"), F.lit("reopened").alias("new_value"))


# E3 -----------------------------------------------------------------------
def replay_findings(events: DataFrame) -> DataFrame:
    """Current status, verification and assignee of each finding from its event log.

    Last valid event per family, as one partial aggregation.
    """
    at = F.struct("created_at", "id")
    kind, new = F.col("event_type"), F.col("new_value")

    def last(guard: Column) -> Column:
        return F.max_by(new, F.when(guard, at))

    # an unassignment carries no new value, so the winner is read from a struct
    moved = kind.isin("assigned", "unassigned")
    assignee = F.max_by(F.struct(F.when(kind == "assigned", new).alias("v")), F.when(moved, at))["v"]
    return events.groupBy("finding_id").agg(
        last(kind.isin("status_changed", "reopened") & new.isin(*fv.FINDING_STATUSES)).alias("status"),
        last((kind == "verification_status_changed") & new.isin(*fv.VERIFICATION_STATUSES)).alias("verification_status"),
        assignee.alias("assignee_id"),
        F.count_if(kind == "comment").alias("comments"),
    )


# P20 ----------------------------------------------------------------------
def cancel_scans(scans: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """requests(scan_id, by_admin) -> scans with outcome; only queued and running can be cancelled.

    An owner's cancel marks the scan failed, an admin's marks it cancelled.
    """
    asked = requests.groupBy("scan_id").agg(F.max("by_admin").alias("by_admin"))
    can = F.col("status").isin(*fv.CANCELLABLE)
    new = F.when(F.col("by_admin"), "cancelled").otherwise("failed")
    why = F.when(F.col("by_admin"), "Cancelled by Admin intervention") \
        .otherwise("Scan was manually cancelled or timed out.")
    return scans.join(asked, "scan_id").select(
        "scan_id", F.col("status").alias("old_status"), F.when(can, new).otherwise(F.col("status")).alias("status"),
        F.when(can, why).alias("error_message"), F.when(can, as_of).alias("completed_at"),
        F.when(can, "ok").otherwise("not_cancellable").alias("outcome"))


# J8 -----------------------------------------------------------------------
def scan_notifications(scans: DataFrame, existing: DataFrame) -> DataFrame:
    """Completed and failed scans to tell their trigger about, once per user, type and scan."""
    done = F.col("status") == "completed"
    made = (
        scans.filter(F.col("status").isin("completed", "failed") & missing(F.col("triggered_by")).isNotNull())
        .select(
            F.col("triggered_by").alias("user_id"),
            F.when(done, "scan_completed").otherwise("scan_failed").alias("type"),
            F.when(done, "Scan completed").otherwise("Scan failed").alias("title"),
            F.when(done, F.concat(F.lit("Scan "), F.col("scan_id").cast("string"), F.lit(" completed with risk "),
                                  F.col("risk_level"), F.lit(".")))
            .otherwise(F.concat(F.lit("Scan "), F.col("scan_id").cast("string"), F.lit(" failed."))).alias("message"),
            F.to_json(F.struct(F.col("scan_id").cast("string").alias("scanId"),
                               F.col("project_id").cast("string").alias("projectId"), "status",
                               F.col("risk_level").alias("riskLevel"),
                               F.col("risk_percent").alias("riskPercent"))).alias("payload"),
            F.col("scan_id").cast("string").alias("ref"),
        )
        .dropDuplicates(["user_id", "type", "ref"])
    )
    told = existing.select("user_id", "type", F.get_json_object("payload", "$.scanId").alias("ref"))
    return made.join(told, ["user_id", "type", "ref"], "left_anti")


# E2 -----------------------------------------------------------------------
def finding_notifications(events: DataFrame, findings: DataFrame, users: DataFrame) -> DataFrame:
    """Assignment and comment notices from finding events, never to the actor."""
    f = findings.select(F.col("id").alias("finding_id"), F.col("title").alias("_title"), "project_id", "scan_id",
                        F.col("assignee_id").alias("_assignee"))
    who = users.select("user_id", F.col("name").alias("_n"), F.col("email").alias("_e"))
    kind = F.col("event_type")
    to = F.when(kind == "assigned", F.col("new_value")).when(kind == "comment", F.col("_assignee"))
    actor = display_name(F.col("_n"), F.col("_e"))
    rows = (events.filter(kind.isin("assigned", "comment")).join(f, "finding_id").withColumn("_to", to)
            .filter(missing(F.col("_to")).isNotNull() & ~F.col("_to").eqNullSafe(F.col("user_id")))
            .join(who, "user_id", "left"))
    text = lambda c: F.col(c).cast("string")
    return rows.select(
        F.col("_to").alias("user_id"),
        F.when(kind == "assigned", "finding_assigned").otherwise("finding_commented").alias("type"),
        F.when(kind == "assigned", "Finding assigned to you").otherwise("New finding comment").alias("title"),
        F.when(kind == "assigned", F.concat(actor, F.lit(" assigned "), F.col("_title"), F.lit(" to you.")))
        .otherwise(F.concat(actor, F.lit(" commented on "), F.col("_title"), F.lit("."))).alias("message"),
        F.to_json(F.struct(text("finding_id").alias("findingId"), text("project_id").alias("projectId"),
                           text("scan_id").alias("scanId"), F.col("user_id").alias("actorId"))).alias("payload"),
    )


def project_deleted_notifications(deleted: DataFrame, members: DataFrame) -> DataFrame:
    """deleted(project_id, name, organization_id, created_by, actor_id) -> notices to creator and team."""
    known = ["project_id", "name", "organization_id", "created_by", "actor_id"]
    rows = deleted.select(*known).distinct().withColumn("_rows", F.count(F.lit(1)).over(W.partitionBy("project_id")))
    team = members.select("organization_id", "user_id").distinct()
    # a project of one row meets each member once: what is left to tell apart is its creator, so its notices need no shuffle
    one, several = rows.filter("_rows = 1"), rows.filter("_rows > 1")
    others = spread_join(one, team, ["organization_id"], ["project_id"], ["user_id"]).filter(
        F.col("created_by").isNull() | ~F.col("user_id").eqNullSafe(F.col("created_by")))
    own = rows.filter("created_by is not null").withColumn("user_id", F.col("created_by"))
    shared = own.filter("_rows > 1").unionByName(several.join(team, "organization_id")).dropDuplicates(["project_id", "user_id"])
    return (own.filter("_rows = 1").unionByName(others).unionByName(shared).filter(~F.col("user_id").eqNullSafe(F.col("actor_id")))
            .select("user_id", F.lit("project_deleted").alias("type"), F.lit("Project deleted").alias("title"),
                    F.concat("name", F.lit(" was deleted.")).alias("message"),
                    F.to_json(F.struct(F.col("project_id").cast("string").alias("projectId"),
                                       F.col("name").alias("projectName"),
                                       F.col("actor_id").alias("deletedBy"))).alias("payload")))


# E2, teams ----------------------------------------------------------------
def team_deleted_notifications(deleted: DataFrame, members: DataFrame) -> DataFrame:
    """deleted(organization_id, name, actor_id) -> notices to every member but the one who deleted it."""
    told = deleted.join(members.select("organization_id", "user_id").distinct(), "organization_id").filter(~F.col("user_id").eqNullSafe(F.col("actor_id")))
    payload = F.struct(F.col("organization_id").cast("string").alias("organizationId"), F.col("name").alias("organizationName"), F.col("actor_id").alias("deletedBy"))
    return told.select("user_id", F.lit("team_deleted").alias("type"), F.lit("Team deleted").alias("title"),
                       F.concat("name", F.lit(" was deleted.")).alias("message"), F.to_json(payload).alias("payload"))


def membership_ends(asked: DataFrame, members: DataFrame) -> DataFrame:
    """asked(organization_id, user_id, actor_id) with the member's role and the outcome: left, removed, last_owner or not_found."""
    owners = members.groupBy("organization_id").agg(F.count_if(F.col("role") == "owner").alias("_owners"))
    known = members.select("organization_id", "user_id", "role")
    outcome = (F.when(F.col("role").isNull(), "not_found")
               .when((F.col("role") == "owner") & (F.col("_owners") <= 1), "last_owner")
               .when(F.col("user_id") == F.col("actor_id"), "left").otherwise("removed"))
    return (asked.join(known, ["organization_id", "user_id"], "left").join(owners, "organization_id", "left")
            .withColumn("outcome", outcome).drop("_owners"))


def membership_notifications(ends: DataFrame, organizations: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """Notices of membership ends: to the other members when somebody left, to the member when they were removed."""
    team = organizations.select("organization_id", F.col("name").alias("_team"))
    named = ends.filter(F.col("outcome").isin("left", "removed")).join(team, "organization_id")
    who = users.select("user_id", F.coalesce(missing(F.col("name")), missing(F.col("email")), F.lit("A member")).alias("_who"))
    left = named.filter("outcome = 'left'").join(who, "user_id", "left")
    others = members.select("organization_id", F.col("user_id").alias("_to"))
    to_others = left.join(others, "organization_id").filter(F.col("_to") != F.col("user_id"))
    place = [F.col("organization_id").cast("string").alias("organizationId"), F.col("_team").alias("organizationName")]
    return to_others.select(
        F.col("_to").alias("user_id"), F.lit("team_member_left").alias("type"), F.lit("A member left your team").alias("title"),
        F.concat(F.coalesce("_who", F.lit("A member")), F.lit(" left "), "_team", F.lit(".")).alias("message"),
        F.to_json(F.struct(*place, F.col("user_id").alias("userId"))).alias("payload"),
    ).unionByName(named.filter("outcome = 'removed'").select(
        "user_id", F.lit("team_member_removed").alias("type"), F.lit("You were removed from a team").alias("title"),
        F.concat(F.lit("You were removed from "), "_team", F.lit(".")).alias("message"),
        F.to_json(F.struct(*place, F.col("actor_id").alias("removedBy"))).alias("payload")))


# E1, reviews --------------------------------------------------------------
def review_events(reviews: DataFrame) -> DataFrame:
    """reviews(finding_id, user_id, review) -> one ai_review event each; review is the reviewer's JSON answer, kept whole."""
    nothing = F.lit(None).cast("string")
    return reviews.filter(F.col("review").isNotNull()).select(
        "finding_id", "user_id", F.lit("ai_review").alias("event_type"), nothing.alias("old_value"), nothing.alias("new_value"), F.col("review").alias("comment"))


# E4 -----------------------------------------------------------------------
def audit_events(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Audit rows for finding events, with old and new values as JSON."""
    kind = F.col("event_type")
    action = (
        F.when(kind.isin("status_changed", "verification_status_changed"), "finding.triage.update")
        .when(kind.isin("assigned", "unassigned"), "finding.assign")
        .when(kind == "comment", "finding.comment")
        .when(kind == "ai_review", "finding.ai_review")
    )
    change = F.when(~kind.isin("comment", "ai_review"), F.struct(F.col("old_value").alias("oldValue"), F.col("new_value").alias("newValue")))
    f = findings.select(F.col("id").alias("finding_id"), "project_id", "scan_id")
    return events.withColumn("action", action).filter("action is not null").join(f, "finding_id").select(
        "user_id", "action", F.lit("Finding").alias("entity_type"),
        F.col("finding_id").cast("string").alias("entity_id"),
        F.to_json(F.struct(
            F.col("project_id").cast("string").alias("projectId"), F.col("scan_id").cast("string").alias("scanId"),
            F.when(kind == "status_changed", change).alias("status"),
            F.when(kind == "verification_status_changed", change).alias("verificationStatus"),
            F.when(kind.isin("assigned", "unassigned"), F.col("old_value")).alias("oldValue"),
            F.when(kind == "assigned", F.col("new_value")).alias("newValue"),
        )).alias("metadata"))


# E5 -----------------------------------------------------------------------
def erase_users(erased: DataFrame, as_of: Column, *, users: DataFrame, members: DataFrame, findings: DataFrame,
                projects: DataFrame, scans: DataFrame, audit: DataFrame) -> dict[str, DataFrame]:
    """The six tables without any trace of the erased users, plus the audit trail of it.

    erased(user_id): joined by size; a short list is broadcast, a long one shuffled.
    """
    gone = erased.select("user_id").distinct()

    def blank(df: DataFrame, column: str) -> DataFrame:
        hit = gone.select(F.col("user_id").alias(column), F.lit(True).alias("_gone"))
        cleared = F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(column))
        return df.join(hit, column, "left").withColumn(column, cleared).drop("_gone").select(*df.columns)

    hit = gone.withColumn("_gone", F.lit(True))
    marked = users.join(hit, "user_id", "left")
    new = {
        "name": F.lit("Deleted user"),
        "email": F.concat(F.lit("deleted-"), F.col("user_id").cast("string"), F.lit("@deleted.local")),
        "role_global": F.lit("user"), "status": F.lit("deleted"),
    }
    anonymous = marked.withColumns({k: F.when(F.col("_gone"), v).otherwise(F.col(k)) for k, v in new.items()})
    trail = users.join(gone, "user_id", "left_semi").select(
        F.lit(None).cast("string").alias("user_id"), F.lit("account.deleted").alias("action"),
        F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"),
        F.to_json(F.struct(F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("deletedAt"), "email"))
        .alias("metadata"))
    kept = blank(audit, "user_id")
    return {
        "users": anonymous.drop("_gone").select(*users.columns),
        "organization_members": members.join(gone, "user_id", "left_anti").select(*members.columns),
        "findings": blank(findings, "assignee_id"),
        "projects": blank(projects, "created_by"),
        "scans": blank(scans, "triggered_by"),
        "audit_events": kept.unionByName(trail, allowMissingColumns=True),
    }


# E6 -----------------------------------------------------------------------
def invite_states(invites: DataFrame, as_of: Column) -> DataFrame:
    """Invites with what a reply would meet: valid, or invalid and why."""
    late = F.col("expires_at") < as_of
    pending = F.col("status") == "pending"
    return invites.withColumns({
        "effective_status": F.when(pending & late, "expired").otherwise(F.col("status")),
        "acceptable": pending & ~late,
    })


def resolve_invites(replies: DataFrame, invites: DataFrame, as_of: Column) -> DataFrame:
    """replies(invite_id, organization_id, email) -> outcome ok or invalid."""
    s = invite_states(invites, as_of).select(
        F.col("id").alias("invite_id"), "organization_id", "email", "acceptable")
    return replies.join(s, ["invite_id", "organization_id", "email"], "left").withColumn(
        "outcome", F.when(F.coalesce("acceptable", F.lit(False)), "ok").otherwise("invalid")).drop("acceptable")


# E7 -----------------------------------------------------------------------
def apply_presets(policies: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen(project_id, preset) over policies: an upsert by project.

    The four presets are constants, so they enter as a CASE instead of a join.
    """
    def pick(at, cast):
        out = None
        for row in fv.POLICY_PRESETS:
            value = F.array(*[F.lit(x) for x in row[at]]) if isinstance(row[at], list) else F.lit(row[at])
            out = F.when(F.col("preset") == row[0], value) if out is None else out.when(F.col("preset") == row[0], value)
        return out.cast(cast)

    patch = chosen.select("project_id", pick(1, "array<string>").alias("_e"), pick(2, "string").alias("_t"),
                          pick(3, "boolean").alias("_a"), pick(4, "boolean").alias("_v"))
    return policies.join(patch, "project_id", "full").select(
        "project_id",
        F.coalesce(F.to_json("_e"), "enabled_engines").alias("enabled_engines"),
        F.coalesce("_t", "severity_threshold").alias("severity_threshold"),
        F.coalesce("_a", "ai_triage_enabled").alias("ai_triage_enabled"),
        F.coalesce("_v", "secret_verification_enabled").alias("secret_verification_enabled"),
        F.coalesce("rule_overrides", F.lit("{}")).alias("rule_overrides"),
    )
