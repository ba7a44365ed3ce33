"""Who may see and do what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave import fixed_values as fv
from riskweave.functions import text as tx
from riskweave.schemas import missing


# J3 -----------------------------------------------------------------------
def accessible_projects(projects: DataFrame, members: DataFrame, user_id: str, action: str = "view",
                        org_scope: tuple | None = None) -> DataFrame:
    """Projects one user may act on.

    org_scope: None for every organization, ("personal",) for projects without one,
    ("org", id) for one organization.
    """
    orgs = (members.filter((F.col("user_id") == user_id) & F.col("role").isin(*fv.ACTION_ROLES[action]))
            .select("organization_id", F.lit(True).alias("_member")).distinct())
    allowed = (F.col("created_by") == user_id) | F.coalesce("_member", F.lit(False))
    if action == "view":
        allowed = allowed | (F.col("visibility") == "public")
    out = projects.join(orgs, "organization_id", "left").filter(F.coalesce(allowed, F.lit(False))).drop("_member")
    if org_scope is None:
        return out
    if org_scope[0] == "personal":
        return out.filter("organization_id is null")
    return out.filter(F.col("organization_id") == org_scope[1])


def decide_access(requests: DataFrame, projects: DataFrame, members: DataFrame) -> DataFrame:
    """requests(user_id, project_id, action) -> allowed, for any number of users at once.

    Two equi-joins on the requested pairs; user x project pairs nobody asked about are
    never formed.
    """
    roles = members.select("user_id", "organization_id", "role")
    p = projects.select("project_id", "organization_id", "created_by", "visibility")
    granted = F.lit(False)
    for action, names in fv.ACTION_ROLES.items():
        granted = granted | ((F.col("action") == action) & F.col("role").isin(*names))
    allowed = (
        (F.col("created_by") == F.col("user_id")) | granted
        | ((F.col("action") == "view") & (F.col("visibility") == "public"))
    )
    return (requests.join(p, "project_id", "left").join(roles, ["user_id", "organization_id"], "left")
            .withColumn("allowed", F.coalesce(allowed, F.lit(False)))
            .drop("created_by", "visibility", "role"))


def in_scope(rows: DataFrame, visible_projects: DataFrame) -> DataFrame:
    """Scans or findings whose project is visible."""
    return rows.join(visible_projects.select("project_id"), "project_id", "left_semi")


# J4 -----------------------------------------------------------------------
def _scopes(raw: Column) -> Column:
    """Scopes of a grant: a JSON list, where 'all' counts, or comma-separated names."""
    listed = tx.json_string_array(raw, None)
    split = F.transform(F.split(raw, ","), tx.strip)
    # valid JSON that is no list grants nothing
    broken = F.try_parse_json(raw).isNull()
    return F.when(listed.isNotNull(), listed).when(broken, F.filter(split, lambda s: s != "all")) \
        .otherwise(F.array().cast("array<string>"))


def support_grants(grants: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Live grants of active global admins as (actor_id, target, target_id, scope)."""
    admins = users.filter((F.col("status") == "active") & F.col("role_global").isin(*fv.ADMIN_ROLES))
    live = (grants.filter((F.col("expires_at") > as_of) & F.col("revoked_at").isNull())
            .join(admins.select(F.col("user_id").alias("actor_id")), "actor_id", "left_semi"))
    rows = live.select("actor_id", "project_id", "organization_id", F.explode(_scopes(F.col("scopes"))).alias("scope"))
    by_project = rows.filter("project_id is not null").select(
        "actor_id", F.lit("project").alias("target"), F.col("project_id").alias("target_id"), "scope")
    by_org = rows.filter("organization_id is not null").select(
        "actor_id", F.lit("organization").alias("target"), F.col("organization_id").alias("target_id"), "scope")
    return by_project.unionByName(by_org).distinct()


def support_access(requests: DataFrame, projects: DataFrame, grants: DataFrame, users: DataFrame,
                   as_of: Column) -> DataFrame:
    """requests(user_id, project_id, action) -> allowed through break-glass grants.

    The OR over project and organization is two equi-joins; grants are reduced to the
    allowed (actor, target, action) first.
    """
    action = None
    for name, scopes in fv.SUPPORT_SCOPES.items():
        hit = F.when(F.col("scope").isin("all", *scopes), F.lit(name))
        action = [hit] if action is None else [*action, hit]
    usable = (
        support_grants(grants, users, as_of)
        .select("actor_id", "target", "target_id", F.explode(F.array_compact(F.array(*action))).alias("action"))
        .distinct().withColumnRenamed("actor_id", "user_id")
    )
    asked = requests.join(projects.select("project_id", "organization_id"), "project_id", "inner")
    one = (usable.filter("target = 'project'")
           .select("user_id", F.col("target_id").alias("project_id"), "action", F.lit(True).alias("_p")))
    two = (usable.filter("target = 'organization'")
           .select("user_id", F.col("target_id").alias("organization_id"), "action", F.lit(True).alias("_o")))
    return (asked.join(one, ["user_id", "project_id", "action"], "left")
            .join(two, ["user_id", "organization_id", "action"], "left")
            .withColumn("allowed", F.coalesce("_p", F.lit(False)) | F.coalesce("_o", F.lit(False)))
            .drop("_p", "_o"))


# J5 -----------------------------------------------------------------------
def org_assignees(members: DataFrame, users: DataFrame) -> DataFrame:
    """Active members per organization: the assignee list its projects share."""
    active = users.filter("status = 'active'").select("user_id", "name", "email")
    return members.select("organization_id", "user_id", "role").join(active, "user_id")


def assignee_lists(projects: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """Every assignee list once: (scope, scope_id, user_id, name, email, role).

    Projects of one organization share that organization's list; a personal project has
    its creator.  Project x member pairs are not written out.
    """
    active = users.filter("status = 'active'").select("user_id", "name", "email")
    cols = ["scope", "scope_id", "user_id", "name", "email", "role"]
    team = org_assignees(members, users).select(
        F.lit("organization").alias("scope"), F.col("organization_id").cast("bigint").alias("scope_id"), *cols[2:])
    own = (projects.filter("organization_id is null")
           .select(F.lit("project").alias("scope"), F.col("project_id").alias("scope_id"), F.col("created_by").alias("user_id"))
           .join(active, "user_id").withColumn("role", F.lit("owner")).select(*cols))
    return team.unionByName(own)


def eligible_assignees(project_id, projects: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """Assignees of one project: its organization's active members, or its creator."""
    mine = projects.filter(F.col("project_id") == project_id).select("project_id", "organization_id", "created_by")
    active = users.filter("status = 'active'").select("user_id", "name", "email")
    team = mine.filter("organization_id is not null").join(org_assignees(members, users), "organization_id") \
        .select("project_id", "user_id", "name", "email", "role")
    own = (mine.filter("organization_id is null").select("project_id", F.col("created_by").alias("user_id"))
           .join(active, "user_id").withColumn("role", F.lit("owner")))
    return team.unionByName(own)


def check_assignees(requests: DataFrame, projects: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """requests(project_id, user_id) -> eligible, without listing any project's team."""
    active = users.filter("status = 'active'").select("user_id", F.lit(True).alias("_active"))
    team = members.select("organization_id", "user_id", F.lit(True).alias("_member"))
    ok = F.coalesce("_active", F.lit(False)) & F.when(
        F.col("organization_id").isNotNull(), F.coalesce("_member", F.lit(False))
    ).otherwise(F.coalesce(F.col("created_by") == F.col("user_id"), F.lit(False)))
    return (requests.join(projects.select("project_id", "organization_id", "created_by"), "project_id", "left")
            .join(team, ["organization_id", "user_id"], "left").join(active, "user_id", "left")
            .withColumn("eligible", ok).select("project_id", "user_id", "eligible"))


# J9 -----------------------------------------------------------------------
def resolve_tokens(requests: DataFrame, tokens: DataFrame, scans: DataFrame, scopes: list[str] | None) -> DataFrame:
    """requests(request_id, token, scan_id) -> outcome ok, unauthorized, forbidden or not_found.

    scopes: any of these must occur in the token's scopes; None asks for none.
    """
    known = tokens.select("token_hash", F.col("project_id").alias("token_project"), "scopes", "is_active")
    owner = scans.select("scan_id", F.col("project_id").alias("scan_project"))
    scoped = F.lit(True)
    if scopes is not None:
        scoped = F.lit(False)
        for s in scopes:
            scoped = scoped | F.col("scopes").contains(s)
    outcome = (
        F.when(missing(F.col("token")).isNull(), "unauthorized")
        .when(F.coalesce(F.col("is_active"), F.lit("")) != "true", "unauthorized")
        .when(~scoped, "forbidden")
        .when(F.coalesce(F.col("scan_project") != F.col("token_project"), F.lit(True)), "not_found")
        .otherwise("ok")
    )
    return (requests.withColumn("token_hash", F.sha2("token", 256)).join(known, "token_hash", "left")
            .join(owner, "scan_id", "left").withColumn("outcome", outcome)
            .select("request_id", "scan_id", "outcome"))


# A10 ----------------------------------------------------------------------
def dashboards(users: DataFrame, projects: DataFrame, members: DataFrame, per_project: DataFrame) -> DataFrame:
    """Overview sums of every user's visible projects.

    per_project: project_id plus counts.  A user's projects fall into three separate
    groups - public ones, private ones of the user's organizations, and private own
    ones elsewhere - so each is summed once per organization or creator and no
    user x project pair is ever formed.
    """
    counts = [c for c in per_project.columns if c != "project_id"]
    p = projects.select("project_id", "organization_id", "created_by", "visibility").join(per_project, "project_id", "left")
    p = p.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumn("projects", F.lit(1).cast("bigint"))
    figures = ["projects", *counts]
    sums = [F.sum(c).alias(c) for c in figures]
    private = p.filter(F.coalesce(F.col("visibility") != "public", F.lit(True)))
    public = p.filter("visibility = 'public'").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in figures])
    per_org = private.filter("organization_id is not null").groupBy("organization_id").agg(*sums)
    roles = members.filter(F.col("role").isin(*fv.ACTION_ROLES["view"])).select("user_id", "organization_id").distinct()
    teams = roles.join(per_org, "organization_id").select("user_id", *figures)
    own = (private.filter("created_by is not null").groupBy(F.col("created_by").alias("user_id"), "organization_id").agg(*sums)
           .join(roles, ["user_id", "organization_id"], "left_anti").select("user_id", *figures))
    seen = teams.unionByName(own).groupBy("user_id").agg(*sums)
    everyone = public.select(F.struct(*figures)).scalar()        # one subquery for all figures
    return users.select("user_id").join(seen, "user_id", "left").withColumn("_public", everyone).select(
        "user_id", *[(F.coalesce(c, F.lit(0)) + F.col(f"_public.{c}")).alias(c) for c in figures])
