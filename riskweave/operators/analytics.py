"""Counts, heat maps, trends, diffs, lists and pages over findings and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskweave import fixed_values as fv
from riskweave.functions import scoring as sc, text as tx
from riskweave.operators.order_statistics import ordered
from riskweave.schemas import missing

_LEVELS = ["critical", "high", "medium", "low", "info"]


def is_active(status: Column) -> Column:
    """P5: neither dismissed nor fixed."""
    return ~status.isin(*fv.CLOSED_STATUSES)


def is_unresolved_high(severity: Column, status: Column) -> Column:
    """P6: critical or high, and not settled."""
    return F.lower(severity).isin("critical", "high") & ~status.isin(*fv.SETTLED_STATUSES)


def severity_count_columns() -> list[Column]:
    sev = F.lower("severity")
    return [F.count_if(sev == level).alias(level) for level in _LEVELS] + [F.count(F.lit(1)).alias("total")]


# A2 / A3 ------------------------------------------------------------------
def severity_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(*severity_count_columns())


def status_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    names = ["open", "confirmed", "false_positive", "fixed", "accepted_risk"]
    return findings.groupBy(*by).agg(*[F.count_if(F.col("status") == n).alias(n) for n in names])


def unresolved_high(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(
        F.count_if(is_unresolved_high(F.col("severity"), F.col("status"))).alias("unresolved"))


# A4 .. A7 -----------------------------------------------------------------
def top_counts(findings: DataFrame, scope: str, key: Column, name: str, limit: int | None = None) -> DataFrame:
    """Rows per scope and key, most frequent first, ties by key.

    The counts are aggregated before they are ranked, and the rank limit is applied
    below the second shuffle, so neither a hot scope nor a hot key gathers rows.
    """
    counts = findings.select(scope, key.alias(name)).groupBy(scope, name).agg(F.count(F.lit(1)).alias("n"))
    if limit is None:
        return counts
    order = W.partitionBy(scope).orderBy(F.desc("n"), F.asc(name))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def file_heatmap(findings: DataFrame, limit: int = 50) -> DataFrame:
    return top_counts(findings.filter("file_path is not null"), "scan_id", F.col("file_path"), "file", limit)


def engine_counts(findings: DataFrame, limit: int | None = None) -> DataFrame:
    return top_counts(findings, "scan_id", F.col("engine"), "engine", limit)


def owasp_counts(findings: DataFrame, limit: int | None = None) -> DataFrame:
    key = F.coalesce(missing(F.col("owasp_category")), F.lit("Unmapped"))
    return top_counts(findings, "scan_id", key, "owasp", limit)


def category_counts(findings: DataFrame) -> DataFrame:
    return top_counts(findings, "scan_id", F.col("scan_category"), "category")


# A8 / A9 ------------------------------------------------------------------
def _metrics(df: DataFrame, **named: Column) -> DataFrame:
    """(metric, value) rows from one pass over a table."""
    one = df.agg(*[c.alias(n) for n, c in named.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"))
                                          for n in named])).alias("m")).select("m.*")


def platform_stats(users: DataFrame, projects: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One (metric, value) row per platform figure; every table is read once."""
    count, status = F.count(F.lit(1)), F.col("status")
    by_severity = findings.groupBy("severity").agg(count.alias("value")).select(
        F.concat(F.lit("findings_"), "severity").alias("metric"), "value")
    return (
        _metrics(users, total_users=count)
        .unionByName(_metrics(projects, total_projects=count))
        .unionByName(_metrics(
            scans, total_scans=count, failed_scans=F.count_if(status == "failed"),
            queued_scans=F.count_if(status == "queued"), running_scans=F.count_if(status == "running"),
            active_scans=F.count_if(status.isin("queued", "running"))))
        .unionByName(by_severity)
    )


def health_metrics(users: DataFrame, projects: DataFrame, scans: DataFrame, tokens: DataFrame) -> DataFrame:
    count = F.count(F.lit(1))
    return (
        _metrics(users, users=count).unionByName(_metrics(projects, projects=count))
        .unionByName(_metrics(scans, scans=count, queued=F.count_if(F.col("status") == "queued"),
                              failed=F.count_if(F.col("status") == "failed")))
        .unionByName(_metrics(tokens, active_tokens=F.count_if(F.col("is_active") == "true")))
    )


# A11 ----------------------------------------------------------------------
def relation_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with the number of rows in each child table, 0 where there are none."""
    out = parents
    for name, child in children.items():
        counts = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


# A12 ----------------------------------------------------------------------
def triage_statistics(findings: DataFrame) -> DataFrame:
    """Findings per scan by verification status and by severity."""
    sets = [["scan_id", "verification_status"], ["scan_id", "severity"]]
    return (
        findings.groupingSets([[F.col(c) for c in s] for s in sets],
                              "scan_id", "verification_status", "severity")
        .agg(F.grouping("severity").alias("g"), F.count(F.lit(1)).alias("n"))
        .select("scan_id", F.when(F.col("g") == 1, "verification").otherwise("severity").alias("kind"),
                F.coalesce("verification_status", "severity").alias("name"), "n")
    )


# A13 ----------------------------------------------------------------------
def badge_summary(findings: DataFrame, limit: int = 5) -> DataFrame:
    """Active counts by severity and the first few distinct types, in order of appearance."""
    live = findings.filter(is_active(F.col("status")))
    first = live.groupBy("scan_id", "vuln_type").agg(F.min("seq").alias("at"))
    order = W.partitionBy("scan_id").orderBy("at", "vuln_type")
    top = (first.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit)
           .groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("nth", "vuln_type"))).alias("t"))
           .select("scan_id", F.transform("t", lambda x: x["vuln_type"]).alias("top_vulnerabilities")))
    return severity_counts(live, ["scan_id"]).join(top, "scan_id")


# A16 / F33 ----------------------------------------------------------------
def severity_shares(counts: DataFrame) -> DataFrame:
    """Share of each of the four chart levels in percent, 0 for empty scopes."""
    total = sum((F.col(c) for c in _LEVELS[1:4]), F.col("critical"))
    return counts.withColumns({
        f"{c}_pct": F.coalesce(F.try_divide(F.col(c).cast("double"), total.cast("double")) * 100, F.lit(0.0))
        for c in _LEVELS[:4]
    })


def attack_surface(counts: DataFrame, by: list[str]) -> DataFrame:
    cells = sc.attack_surface(*[F.col(c) for c in _LEVELS[:4]])
    return counts.select(*by, F.inline(cells).alias("category", "count"))


# A18 ----------------------------------------------------------------------
def stage_counters(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Findings per scan and policy engine, with engines a policy switched off marked.

    scans: scan_id and policy_engines.  Each scan opens into the six fixed engines.
    """
    counts = (
        findings.select("scan_id", sc.lookup(F.col("engine"), fv.ENGINE_TO_POLICY, F.lit(None).cast("string"))
                        .alias("engine"))
        .groupBy("scan_id", "engine").agg(F.count(F.lit(1)).alias("n"))
    )
    grid = scans.select("scan_id", "policy_engines",
                        F.explode(F.array(*[F.lit(e) for e in fv.POLICY_ENGINES])).alias("engine"))
    on = (F.size("policy_engines") == 0) | F.array_contains("policy_engines", F.col("engine"))
    return grid.join(counts, ["scan_id", "engine"], "left").select(
        "scan_id", "engine", F.when(on, "completed").otherwise("skipped").alias("stage"),
        F.when(on, F.coalesce("n", F.lit(0))).otherwise(0).alias("n"))


# A19 ----------------------------------------------------------------------
def invariant_breaks(scans: DataFrame, organizations: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """Rows (rule, subject, n) where a guard is broken or at its limit."""
    busy = (scans.filter(F.col("status").isin(*fv.CANCELLABLE)).groupBy("project_id")
            .agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select(F.lit("concurrent_scans").alias("rule"), F.col("project_id").cast("string").alias("subject"), "n"))
    owners = members.groupBy("organization_id").agg(F.count_if(F.col("role") == "owner").alias("n"))
    lone = (organizations.join(owners, "organization_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .filter("n <= 1")
            .select(F.lit("last_owner").alias("rule"), F.col("organization_id").cast("string").alias("subject"), "n"))
    admins = (users.agg(F.count_if((F.col("status") == "active") & F.col("role_global").isin(*fv.ADMIN_ROLES)).alias("n"))
              .filter("n <= 1").select(F.lit("last_admin").alias("rule"), F.lit("global").alias("subject"), "n"))
    return busy.unionByName(lone).unionByName(admins)


# A20 ----------------------------------------------------------------------
def scan_durations(scans: DataFrame) -> DataFrame:
    ms = F.floor(tx.micros_between(F.col("completed_at"), F.col("started_at")) / 1000).cast("bigint")
    return scans.withColumn("duration_ms", ms)


# W1 / W2 / J7 -------------------------------------------------------------
def latest_scans(scans: DataFrame, n: int) -> DataFrame:
    """The n most recent scans of every project, rank 1 first."""
    order = W.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("scan_id"))
    return scans.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= n)


def risk_trend(scans: DataFrame, n: int = 5) -> DataFrame:
    """Rounded risk of the last n scans of a project, oldest first."""
    rounded = F.floor(F.coalesce("risk_percent", F.lit(0.0)) + 0.5).cast("bigint")
    points = F.array_sort(F.collect_list(F.struct((-F.col("recency")).alias("o"), rounded.alias("r"))))
    return latest_scans(scans, n).groupBy("project_id").agg(
        F.transform(points, lambda p: p["r"]).alias("trend"))


def projects_with_latest_scan(projects: DataFrame, scans: DataFrame, organizations: DataFrame) -> DataFrame:
    newest = scans.groupBy("project_id").agg(
        F.max(F.struct("created_at", "scan_id", "status", "risk_level", "risk_percent")).alias("s"))
    orgs = organizations.select("organization_id", F.col("name").alias("organization_name"))
    return projects.join(newest, "project_id", "left").join(orgs, "organization_id", "left").select(
        "project_id", "name", "organization_name", F.col("s.scan_id").alias("latest_scan_id"),
        F.col("s.status").alias("latest_status"), F.col("s.created_at").alias("latest_created_at"))


# J6 -----------------------------------------------------------------------
def scan_report_list(scans: DataFrame, projects: DataFrame, findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("scan_id").agg(
        F.count_if(F.col("severity") == "Critical").alias("critical"),
        F.count_if(F.col("severity") == "High").alias("high"), F.count(F.lit(1)).alias("total"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("critical", "high", "total")}
    named = projects.select("project_id", F.col("name").alias("project_name"))
    return (scans.join(named, "project_id", "left").join(counts, "scan_id", "left").withColumns(zero)
            .withColumn("project_name", F.coalesce("project_name", F.lit("Unknown Project"))))


# P14 ----------------------------------------------------------------------
def scan_list(scans: DataFrame, projects: DataFrame, status: str | None = None, project_id=None) -> DataFrame:
    out = scans
    if status:
        out = out.filter(F.col("status") == status)
    if project_id is not None:
        out = out.filter(F.col("project_id") == project_id)
    return out.join(projects.select("project_id", F.col("name").alias("project_name")), "project_id", "left")


# U1 / U2 ------------------------------------------------------------------
def _diff(findings: DataFrame, pairs: DataFrame, key: list[Column], names: list[str], pair: list[str]) -> DataFrame:
    """Presence of every key on the two sides of each (current_id, base_id) pair.

    Keys are reduced per side before they meet, so repeats of one key cost one row.
    """
    keys = findings.select("scan_id", *[k.alias(n) for k, n in zip(key, names)]).distinct()
    now = keys.join(pairs.withColumnRenamed("current_id", "scan_id").withColumn("current_id", F.col("scan_id")),
                    "scan_id").select(*pair, *names, F.lit(1).alias("now"), F.lit(0).alias("before"))
    then = keys.join(pairs.withColumnRenamed("base_id", "scan_id").withColumn("base_id", F.col("scan_id")),
                     "scan_id").select(*pair, *names, F.lit(0).alias("now"), F.lit(1).alias("before"))
    return now.unionByName(then).groupBy(*pair, *names).agg(F.max("now").alias("now"), F.max("before").alias("before"))


def _diff_counts(sides: DataFrame, pair: list[str]) -> DataFrame:
    now, before = F.col("now") == 1, F.col("before") == 1
    return sides.groupBy(*pair).agg(
        F.count_if(now & ~before).alias("introduced"), F.count_if(before & ~now).alias("fixed"),
        F.count_if(now & before).alias("unchanged"))


def scan_pairs(scans: DataFrame) -> DataFrame:
    """Latest scan of each project against the one before: (project_id, current_id, base_id)."""
    two = latest_scans(scans, 2)
    return two.groupBy("project_id").agg(
        F.max(F.when(F.col("recency") == 1, F.col("scan_id"))).alias("current_id"),
        F.max(F.when(F.col("recency") == 2, F.col("scan_id"))).alias("base_id"))


def compare_scans(findings: DataFrame, scans: DataFrame, pairs: DataFrame) -> DataFrame:
    """API diff: keys are type, path and line; plus the change in risk."""
    pair = ["current_id", "base_id"]
    line = F.coalesce(F.nullif(F.col("line_start"), F.lit(0)), F.col("line_number"))
    sides = _diff(findings, pairs, [F.col("vuln_type"), F.col("file_path"), line], ["k1", "k2", "k3"], pair)
    risk = scans.select("scan_id", "risk_percent")
    return (
        pairs.select(*pair).join(_diff_counts(sides, pair), pair, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("introduced", "fixed", "unchanged")})
        .join(risk.toDF("current_id", "now_risk"), "current_id").join(risk.toDF("base_id", "base_risk"), "base_id")
        .select(*pair, F.col("introduced").alias("introduced_count"), F.col("fixed").alias("fixed_count"),
                (F.col("now_risk") - F.col("base_risk")).alias("risk_delta"))
    )


def project_changes(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Project page diff: fingerprint (or rule:path:line) sets of the last two scans."""
    pairs = scan_pairs(scans)
    fallback = F.concat_ws(":", "rule_id", "file_path", F.col("line_number").cast("string"))
    key = F.coalesce(missing(F.col("dedupe_hash")), fallback)
    counts = _diff_counts(_diff(findings, pairs, [key], ["k"], ["project_id"]), ["project_id"])
    return pairs.select("project_id").join(counts, "project_id", "left").select(
        "project_id", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in
                        (("introduced", "new_findings"), ("fixed", "fixed_findings"), ("unchanged", "unchanged_findings"))])


# P2 / P3 / P4 -------------------------------------------------------------
def filter_findings(findings: DataFrame, severity: str | None = None, status: str | None = None,
                    engine: str | None = None) -> DataFrame:
    out = findings
    if severity:
        out = out.filter(F.lower("severity") == severity.lower())
    if status:
        out = out.filter(F.col("status") == status)
    if engine:
        out = out.filter(F.col("engine") == engine)
    return out


def triage_language(path: Column) -> Column:
    low, out = F.lower(path), None
    for tail, name in fv.TRIAGE_LANGUAGES:
        out = F.when(low.endswith(tail), name) if out is None else out.when(low.endswith(tail), name)
    return out.otherwise("other")


def triage_filter(findings: DataFrame, severity: str = "All", verification: str = "All", language: str = "All",
                  hide_previous_fp: bool = False) -> DataFrame:
    out = findings
    if severity != "All":
        out = out.filter(F.lower("severity") == severity.lower())
    if verification != "All":
        out = out.filter(F.col("verification_status") == verification)
    if language != "All":
        out = out.filter(triage_language(F.col("file_path")) == language.lower())
    if hide_previous_fp:
        out = out.filter(~F.coalesce("previously_false_positive", F.lit(False)))
    return out


_SEARCHED = ["title", "rule_id", "engine", "scan_category", "vuln_type", "file_path", "source", "sink", "cwe_id",
             "owasp_category", "attack_scenario", "impact", "remediation"]


def search_findings(findings: DataFrame, query: str = "", severity: str = "All", verification: str = "All",
                    language: str = "All") -> DataFrame:
    """Case-insensitive substring over thirteen fields joined by blanks, plus filters."""
    out = triage_filter(findings, "All", verification, language)
    if severity != "All":
        out = out.filter(F.col("severity") == severity)
    if query:
        haystack = F.lower(F.concat_ws(" ", *[missing(F.col(c)) for c in _SEARCHED]))
        out = out.filter(haystack.contains(query.lower()))
    return out


# P16 ----------------------------------------------------------------------
def api_projection(findings: DataFrame) -> DataFrame:
    """Findings under their public names."""
    c = F.col
    or_number = lambda n: F.coalesce(F.nullif(c(n), F.lit(0)), c("line_number"))
    blank = lambda n: F.coalesce(c(n), F.lit(""))
    return findings.select(
        "id", "engine", c("rule_id").alias("ruleId"), c("scan_category").alias("scanCategory"), "title",
        c("vuln_type").alias("vulnType"), "severity", c("cvss4_score").alias("cvss4"), "confidence",
        c("cwe_id").alias("cweId"), c("owasp_category").alias("owaspCategory"), c("file_path").alias("filePath"),
        c("line_number").alias("lineNumber"), or_number("line_start").alias("lineStart"),
        or_number("line_end").alias("lineEnd"), "source", "sink", c("function_name").alias("functionName"),
        blank("dataflow_trace").alias("dataflowTrace"), blank("evidence").alias("evidence"),
        c("code_snippet").alias("codeSnippet"), c("why_vulnerable").alias("whyVulnerable"),
        c("attack_scenario").alias("attackScenario"), blank("impact").alias("impact"), "poc", "remediation",
        c("secure_example").alias("secureExample"), blank("pentest_hint").alias("pentestHint"),
        blank("references").alias("references"),
        F.coalesce(missing(c("verification_status")), F.lit("unverified")).alias("verificationStatus"),
        blank("dedupe_hash").alias("dedupeHash"),
    )


# O1 .. O6 -----------------------------------------------------------------
SHALLOW = 10_000                   # rows in front of a page's end that one task may hold


def severity_order() -> list[Column]:
    """O2: severity, then CVSS, then age; the id makes it total."""
    return [sc.severity_rank(F.col("severity")).desc(), F.desc("cvss4_score"), F.asc("created_at"), F.asc("id")]


def sort_mode(mode: str) -> list[Column]:
    """O3."""
    return {
        "risk": [sc.severity_rank(F.col("severity")).desc(), F.desc("cvss4_score"), F.asc("id")],
        "confidence": [F.desc("confidence"), F.asc("id")],
        "file": [F.asc("file_path"), F.asc("id")],
    }[mode]


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20,
         at_least_one: bool = True) -> DataFrame:
    """One page with its envelope columns page, total and total_pages.

    A page near the start is a top-k with offset; the total is a scalar subquery over the same
    rows, so nothing is joined or collected.  A page that lies deeper is read from sorted slices.
    """
    number, size = max(1, number), max(1, size)
    if number * size > SHALLOW:
        return ordered(df, [], order).page(number, size).drop("position")
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    pages = F.ceil(F.col("total") / size)
    return (
        df.orderBy(*order).offset((number - 1) * size).limit(size)
        .withColumn("page", F.lit(number))
        .withColumn("total", counted.scalar())
        .withColumn("total_pages", F.greatest(pages, F.lit(1)) if at_least_one else pages)
    )


def page_per_scope(df: DataFrame, scope: str, order: list[Column], number: int, size: int) -> DataFrame:
    """The same page of every scope at once, with the scope's totals.

    Near the start, a scope's rank limit works below the shuffle, so at most SHALLOW rows of it meet;
    deeper pages are read from sorted slices, which no scope has to fit into.
    """
    number, size = max(1, number), max(1, size)
    if number * size > SHALLOW:
        return ordered(df, [scope], order).page(number, size)
    totals = df.groupBy(scope).agg(F.count(F.lit(1)).alias("total"))
    placed = df.withColumn("position", F.row_number().over(W.partitionBy(scope).orderBy(*order)))
    rows = placed.filter(F.col("position") <= number * size).filter(F.col("position") > (number - 1) * size)
    return rows.join(totals, scope).withColumns({
        "page": F.lit(number), "total_pages": F.greatest(F.ceil(F.col("total") / size), F.lit(1))})


def newest(df: DataFrame, limit: int | None, tie: str) -> DataFrame:
    """O4, O6: most recent rows first, as many as the caller asks for; None: all."""
    ordered = df.orderBy(F.desc("created_at"), F.desc(tie))
    return ordered if limit is None else ordered.limit(max(1, limit))


def pending_invites(invites: DataFrame, organization_id=None, limit: int | None = None) -> DataFrame:
    out = invites.filter("status = 'pending'")
    if organization_id is not None:
        out = out.filter(F.col("organization_id") == organization_id)
    return newest(out, limit, "id")


def active_grants(grants: DataFrame, as_of: Column, actor: str | None = None, limit: int | None = None) -> DataFrame:
    out = grants.filter((F.col("expires_at") > as_of) & F.col("revoked_at").isNull())
    if actor is not None:
        out = out.filter(F.col("actor_id") == actor)
    return newest(out, limit, "id")


def project_tokens(tokens: DataFrame, project_id=None, limit: int | None = None) -> DataFrame:
    out = tokens if project_id is None else tokens.filter(F.col("project_id") == project_id)
    return newest(out.drop("token_hash"), limit, "id")


# O5 / J14 -----------------------------------------------------------------
def display_name(name: Column, email: Column) -> Column:
    return F.coalesce(missing(name), missing(email), F.lit("A user"))


def finding_timeline(events: DataFrame, users: DataFrame, limit: int | None = None) -> DataFrame:
    """Oldest events of every finding, with who did it and a readable comment."""
    order = W.partitionBy("finding_id").orderBy("created_at", "id")
    kept = events.withColumn("nth", F.row_number().over(order))
    kept = kept if limit is None else kept.filter(F.col("nth") <= limit)
    who = users.select(F.col("user_id"), F.col("name").alias("user_name"), F.col("email").alias("user_email"))
    return kept.join(who, "user_id", "left").withColumns({
        "actor": display_name(F.col("user_name"), F.col("user_email")),
        "shown": tx.review_comment(F.col("event_type"), F.col("comment")),
    })


def scan_timeline(events: DataFrame) -> DataFrame:
    """Scan events with phase and label; order by created_at, id to display."""
    return events.withColumns({"phase": tx.event_phase(F.col("event_type")), "label": tx.event_label(F.col("event_type"))})


# P12 / P13 / P15 ----------------------------------------------------------
def admin_search(df: DataFrame, text: str = "", columns: tuple[str, str] = ("name", "repo_url"), **exact) -> DataFrame:
    """Either column contains the text (any case), and exact matches hold."""
    out = df
    for column, value in exact.items():
        if value:
            out = out.filter(F.col(column) == value)
    needle = text.strip().lower()
    if needle:
        out = out.filter(F.lower(columns[0]).contains(needle) | F.lower(columns[1]).contains(needle))
    return out


def audit_search(audit: DataFrame, user_id: str = "", action: str = "", entity_type: str = "") -> DataFrame:
    out = audit
    if user_id:
        out = out.filter(F.col("user_id") == user_id)
    if action:
        out = out.filter(F.col("action").contains(action))
    if entity_type:
        out = out.filter(F.col("entity_type") == entity_type)
    parsed = F.try_parse_json("metadata")
    return out.withColumns({
        "metadata_json": parsed, "metadata_raw": F.when(parsed.isNull(), F.col("metadata"))})


def inbox(notifications: DataFrame, user_id: str | None = None, unread_only: bool = False,
          category: str | None = None) -> DataFrame:
    out = notifications
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    if unread_only:
        out = out.filter("status = 'unread'")
    if category in fv.NOTIFICATION_CATEGORIES:
        out = out.filter(F.col("type").isin(*fv.NOTIFICATION_CATEGORIES[category]))
    return out


# O2 -----------------------------------------------------------------------
def list_positions(findings: DataFrame) -> DataFrame:
    """Place of every finding in its scan's list (severity, CVSS, age, id).

    Only the columns of the order are dealt and sorted, in slices, so a scan with very many findings is
    numbered by many tasks.
    """
    slim = findings.select("scan_id", "id", "severity", "cvss4_score", "created_at")
    return ordered(slim, ["scan_id"], severity_order()).positions().select("id", "scan_id", F.col("position").cast("int").alias("position"))
