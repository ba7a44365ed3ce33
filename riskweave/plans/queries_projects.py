"""Queries over projects, people, events and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions import text as tx
from riskweave.operators import access as ac, analytics as an, governance as go, history as hi, intake as it
from riskweave.plans.registry import query
from riskweave.views import AS_OF, Views

def _now() -> Column:
    return F.lit(AS_OF.split("'")[1]).cast("timestamp_ntz")


# --- platform figures ---------------------------------------------------------
@query("a8_platform_stats", """SELECT 'total_users' AS metric, count(*) AS value FROM users UNION ALL SELECT 'total_projects', count(*) FROM projects
 UNION ALL SELECT 'total_scans', count(*) FROM scans UNION ALL SELECT 'failed_scans', count(*) FILTER (status = 'failed') FROM scans
 UNION ALL SELECT 'queued_scans', count(*) FILTER (status = 'queued') FROM scans UNION ALL SELECT 'running_scans', count(*) FILTER (status = 'running') FROM scans
 UNION ALL SELECT 'active_scans', count(*) FILTER (status IN ('queued', 'running')) FROM scans
 UNION ALL SELECT 'findings_' || severity, count(*) FROM scan_findings GROUP BY severity""")
def a8(v: Views) -> DataFrame:
    return an.platform_stats(v.users, v.projects, v.scans, v.scan_findings)


@query("a9_health_metrics", """SELECT 'users' AS metric, count(*) AS value FROM users UNION ALL SELECT 'projects', count(*) FROM projects UNION ALL SELECT 'scans', count(*) FROM scans
 UNION ALL SELECT 'queued', count(*) FILTER (status = 'queued') FROM scans UNION ALL SELECT 'failed', count(*) FILTER (status = 'failed') FROM scans
 UNION ALL SELECT 'active_tokens', count(*) FILTER (is_active = 'true') FROM api_tokens""")
def a9(v: Views) -> DataFrame:
    return an.health_metrics(v.users, v.projects, v.scans, v.api_tokens)


_PER_PROJECT = """pp AS (SELECT project_id, count(*) AS scans FROM scans GROUP BY project_id),
pf AS (SELECT project_id, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high, count(*) AS active
  FROM findings WHERE status NOT IN ('false_positive', 'fixed') GROUP BY project_id),
pc AS (SELECT p.*, coalesce(scans, 0) AS scans, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(active, 0) AS active
  FROM projects p LEFT JOIN pp ON p.project_id = pp.project_id LEFT JOIN pf ON p.project_id = pf.project_id)"""


@query("a10_dashboard_overview", f"""WITH {_PER_PROJECT}, see AS (SELECT u.user_id, pc.* FROM users u JOIN pc ON pc.visibility = 'public' OR pc.created_by = u.user_id
  OR EXISTS (SELECT 1 FROM organization_members m WHERE m.user_id = u.user_id AND m.organization_id = pc.organization_id))
SELECT u.user_id, count(see.project_id) AS projects, CAST(coalesce(sum(scans), 0) AS BIGINT) AS scans, CAST(coalesce(sum(critical), 0) AS BIGINT) AS critical,
  CAST(coalesce(sum(high), 0) AS BIGINT) AS high, CAST(coalesce(sum(active), 0) AS BIGINT) AS active FROM users u LEFT JOIN see ON u.user_id = see.user_id GROUP BY u.user_id""")
def a10(v: Views) -> DataFrame:
    live = v.findings.filter(an.is_active(F.col("status")))
    found = live.groupBy("project_id").agg(F.count_if(F.col("severity") == "Critical").alias("critical"),
                                           F.count_if(F.col("severity") == "High").alias("high"), F.count(F.lit(1)).alias("active"))
    scans = v.scans.groupBy("project_id").agg(F.count(F.lit(1)).alias("scans"))
    per_project = scans.join(found, "project_id", "full").select(
        "project_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("scans", "critical", "high", "active")])
    return ac.dashboards(v.users, v.projects, v.organization_members, per_project)


@query("a11_relation_counts_project", """SELECT p.project_id, p.name, coalesce(s.n, 0) AS scans, coalesce(f.n, 0) AS findings FROM projects p
  LEFT JOIN (SELECT project_id, count(*) AS n FROM scans GROUP BY ALL) s ON p.project_id = s.project_id
  LEFT JOIN (SELECT project_id, count(*) AS n FROM findings GROUP BY ALL) f ON p.project_id = f.project_id""")
def a11(v: Views) -> DataFrame:
    return an.relation_counts(v.projects.select("project_id", "name"), "project_id", scans=v.scans, findings=v.findings)


@query("a11_relation_counts_organization", """SELECT o.organization_id, o.name, coalesce(m.n, 0) AS members, coalesce(p.n, 0) AS projects FROM organizations o
  LEFT JOIN (SELECT organization_id, count(*) AS n FROM organization_members GROUP BY ALL) m ON o.organization_id = m.organization_id
  LEFT JOIN (SELECT organization_id, count(*) AS n FROM projects GROUP BY ALL) p ON o.organization_id = p.organization_id""")
def a11_org(v: Views) -> DataFrame:
    return an.relation_counts(v.organizations, "organization_id", members=v.organization_members, projects=v.projects)


@query("a19_invariant_audits", """SELECT 'concurrent_scans' AS rule, CAST(project_id AS VARCHAR) AS subject, count(*) AS n FROM scans WHERE status IN ('queued', 'running') GROUP BY project_id HAVING count(*) > 1
 UNION ALL SELECT 'last_owner', CAST(o.organization_id AS VARCHAR), count(*) FILTER (role = 'owner') FROM organizations o LEFT JOIN organization_members m
   ON o.organization_id = m.organization_id GROUP BY o.organization_id HAVING count(*) FILTER (role = 'owner') <= 1
 UNION ALL SELECT 'last_admin', 'global', count(*) FROM users WHERE status = 'active' AND role_global IN ('admin', 'super_admin') HAVING count(*) <= 1""")
def a19(v: Views) -> DataFrame:
    return an.invariant_breaks(v.scans, v.organizations, v.organization_members, v.users)


# --- access ---------------------------------------------------------------
def _requests(v: Views) -> DataFrame:
    return v.sql("""SELECT DISTINCT triggered_by AS user_id, project_id,
      CASE status WHEN 'completed' THEN 'view' WHEN 'queued' THEN 'manage' ELSE 'trigger_scan' END AS action
      FROM {scans} WHERE triggered_by IS NOT NULL""")


_REQ = """r AS (SELECT DISTINCT triggered_by AS user_id, project_id, CASE status WHEN 'completed' THEN 'view' WHEN 'queued' THEN 'manage' ELSE 'trigger_scan' END AS action
  FROM scans WHERE triggered_by IS NOT NULL)"""


@query("j3_access_scope", f"""WITH {_REQ} SELECT r.user_id, r.project_id, r.action, (p.created_by = r.user_id OR (r.action = 'view' AND p.visibility = 'public')
  OR EXISTS (SELECT 1 FROM organization_members m WHERE m.user_id = r.user_id AND m.organization_id = p.organization_id AND (r.action = 'view'
    OR (r.action = 'manage' AND m.role IN ('owner', 'admin')) OR (r.action = 'trigger_scan' AND m.role IN ('owner', 'admin', 'member'))))) AS allowed
FROM r JOIN projects p ON r.project_id = p.project_id""")
def j3(v: Views) -> DataFrame:
    return ac.decide_access(_requests(v), v.projects, v.organization_members).select("user_id", "project_id", "action", "allowed")


@query("j3_visible_scans", """WITH p AS (SELECT project_id FROM projects p WHERE created_by = 'user-7' OR visibility = 'public' OR EXISTS (SELECT 1 FROM organization_members m
  WHERE m.user_id = 'user-7' AND m.organization_id = p.organization_id AND role IN ('owner', 'admin', 'member', 'viewer')))
SELECT scan_id, scans.project_id, status FROM scans JOIN p ON scans.project_id = p.project_id""")
def j3_scans(v: Views) -> DataFrame:
    visible = ac.accessible_projects(v.projects, v.organization_members, "user-7")
    return ac.in_scope(v.scans, visible).select("scan_id", "project_id", "status")


@query("j4_break_glass", f"""WITH {_REQ}, admins AS (SELECT user_id FROM users WHERE status = 'active' AND role_global IN ('admin', 'super_admin')),
g AS (SELECT * FROM support_grants WHERE actor_id IN (SELECT user_id FROM admins) AND expires_at > {AS_OF} AND revoked_at IS NULL),
a AS (SELECT *, CASE scopes WHEN '["view_findings"]' THEN ['view'] WHEN '["all"]' THEN ['view', 'manage', 'trigger_scan'] WHEN 'manage_scan, view_source' THEN ['view', 'trigger_scan']
  WHEN '["manage_policy","manage_scan"]' THEN ['manage', 'trigger_scan'] ELSE CAST([] AS VARCHAR[]) END AS acts FROM g)
SELECT r.user_id, r.project_id, r.action, EXISTS (SELECT 1 FROM a WHERE a.actor_id = r.user_id AND list_contains(a.acts, r.action)
  AND (a.project_id = r.project_id OR a.organization_id = p.organization_id)) AS allowed FROM r JOIN projects p ON r.project_id = p.project_id""")
def j4(v: Views) -> DataFrame:
    out = ac.support_access(_requests(v), v.projects, v.support_grants, v.users, _now())
    return out.select("user_id", "project_id", "action", "allowed")


@query("j5_assignee_check", """WITH r AS (SELECT DISTINCT project_id, assignee_id AS user_id FROM findings WHERE assignee_id IS NOT NULL)
SELECT r.project_id, r.user_id, (u.user_id IS NOT NULL AND CASE WHEN p.organization_id IS NOT NULL THEN m.user_id IS NOT NULL ELSE p.created_by = r.user_id END) AS eligible
FROM r JOIN projects p ON r.project_id = p.project_id LEFT JOIN users u ON u.user_id = r.user_id AND u.status = 'active'
  LEFT JOIN organization_members m ON m.user_id = r.user_id AND m.organization_id = p.organization_id""")
def j5(v: Views) -> DataFrame:
    asked = v.findings.filter("assignee_id is not null").select("project_id", F.col("assignee_id").alias("user_id")).distinct()
    return ac.check_assignees(asked, v.projects, v.organization_members, v.users)


@query("j5_assignee_lists", """SELECT 'organization' AS scope, CAST(m.organization_id AS BIGINT) AS scope_id, u.user_id, u.name, u.email, m.role FROM organization_members m
  JOIN users u ON m.user_id = u.user_id AND u.status = 'active'
UNION ALL SELECT 'project', p.project_id, u.user_id, u.name, u.email, 'owner' FROM projects p JOIN users u ON p.created_by = u.user_id AND u.status = 'active' WHERE p.organization_id IS NULL""")
def j5_list(v: Views) -> DataFrame:
    return ac.assignee_lists(v.projects, v.organization_members, v.users)


@query("j6_scan_report_list", """SELECT s.scan_id, coalesce(p.name, 'Unknown Project') AS project_name, coalesce(f.critical, 0) AS critical, coalesce(f.high, 0) AS high, coalesce(f.total, 0) AS total
FROM scans s LEFT JOIN projects p ON s.project_id = p.project_id LEFT JOIN (SELECT scan_id, count(*) FILTER (severity = 'Critical') AS critical,
  count(*) FILTER (severity = 'High') AS high, count(*) AS total FROM scan_findings GROUP BY scan_id) f ON s.scan_id = f.scan_id""")
def j6(v: Views) -> DataFrame:
    return an.scan_report_list(v.scans, v.projects, v.scan_findings).select("scan_id", "project_name", "critical", "high", "total")


@query("j7_latest_scan_per_project", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, scan_id DESC) AS r FROM scans)
SELECT p.project_id, p.name, o.name AS organization_name, coalesce(l.scan_id, -1) AS latest_scan_id, l.status AS latest_status, l.created_at AS latest_created_at
FROM projects p LEFT JOIN l ON p.project_id = l.project_id AND r = 1 LEFT JOIN organizations o ON p.organization_id = o.organization_id""")
def j7(v: Views) -> DataFrame:
    return an.projects_with_latest_scan(v.projects, v.scans, v.organizations).withColumn(
        "latest_scan_id", F.coalesce("latest_scan_id", F.lit(-1)))


@query("j9_ci_tokens", """SELECT r.request_id, r.scan_id, CASE WHEN r.token = '' THEN 'unauthorized' WHEN coalesce(t.is_active, '') <> 'true' THEN 'unauthorized'
  WHEN NOT (contains(t.scopes, 'report:write') OR contains(t.scopes, 'scan:read')) THEN 'forbidden' WHEN s.project_id IS NULL OR s.project_id <> t.project_id THEN 'not_found' ELSE 'ok' END AS outcome
FROM token_requests r LEFT JOIN api_tokens t ON sha256(r.token) = t.token_hash LEFT JOIN scans s ON r.scan_id = s.scan_id""")
def j9(v: Views) -> DataFrame:
    return ac.resolve_tokens(v.token_requests, v.api_tokens, v.scans, ["report:write", "scan:read"])


@query("j16_policy_lookup", """SELECT s.scan_id, CASE p.enabled_engines WHEN '["semgrep","trivy"]' THEN 'semgrep,trivy' WHEN '["owasp","secrets",7,"bandit"]' THEN 'owasp,secrets,bandit' ELSE '' END AS engines,
  coalesce(p.severity_threshold, 'Info') AS threshold, coalesce(p.ai_triage_enabled, true) AS ai_triage, coalesce(p.secret_verification_enabled, false) AS verify_secrets
FROM scans s LEFT JOIN scanner_policies p ON s.project_id = p.project_id""")
def j16(v: Views) -> DataFrame:
    from riskweave.operators.enrichment import with_policy
    return with_policy(v.scans.select("scan_id", "project_id"), v.scanner_policies).select(
        "scan_id", F.array_join("policy_engines", ",").alias("engines"), F.col("policy_threshold").alias("threshold"),
        F.col("policy_ai_triage").alias("ai_triage"), F.col("policy_verify_secrets").alias("verify_secrets"))


@query("f27_policy_json", """SELECT project_id, CASE enabled_engines WHEN '[]' THEN '' WHEN '["semgrep","trivy"]' THEN 'semgrep,trivy' WHEN '["owasp","secrets",7,"bandit"]' THEN 'owasp,secrets,bandit'
  ELSE 'semgrep,bandit,eslint,owasp,trivy,secrets' END AS engines, CASE WHEN contains(rule_overrides, 'rule-1') THEN 'rule-1' ELSE '' END AS override_keys FROM scanner_policies""")
def f27(v: Views) -> DataFrame:
    from riskweave.operators.enrichment import serialised_policy
    return serialised_policy(v.scanner_policies).select(
        "project_id", F.array_join("enabled_engines", ",").alias("engines"), F.array_join(F.map_keys("rule_overrides"), ",").alias("override_keys"))


# --- lists ----------------------------------------------------------------
@query("o4_recent_scans", "SELECT scan_id, project_id, status, created_at FROM scans ORDER BY created_at DESC, scan_id DESC LIMIT 500")
def o4(v: Views) -> DataFrame:
    return an.newest(v.scans, 500, "scan_id").select("scan_id", "project_id", "status", "created_at")


@query("o4_recent_scans_for_user", """SELECT scan_id, s.project_id FROM scans s JOIN projects p ON s.project_id = p.project_id WHERE created_by = 'user-7' OR visibility = 'public'
  OR EXISTS (SELECT 1 FROM organization_members m WHERE m.user_id = 'user-7' AND m.organization_id = p.organization_id) ORDER BY created_at DESC, scan_id DESC LIMIT 20""")
def o4_user(v: Views) -> DataFrame:
    visible = ac.accessible_projects(v.projects, v.organization_members, "user-7")
    return an.newest(ac.in_scope(v.scans, visible), 20, "scan_id").select("scan_id", "project_id")


@query("o5_scan_timeline", """SELECT id, scan_id, created_at, CASE WHEN contains(event_type, 'started') OR contains(event_type, 'running') THEN 'started'
  WHEN contains(event_type, 'failed') OR contains(event_type, 'error') THEN 'failed' WHEN contains(event_type, 'completed') THEN 'completed' ELSE 'other' END AS phase,
  replace(event_type, '_', ' ') AS label FROM scan_events""")
def o5(v: Views) -> DataFrame:
    """F32 on the scan's event log."""
    return an.scan_timeline(v.scan_events).select("id", "scan_id", "created_at", "phase", "label")


@query("o6_pending_invites", "SELECT id, organization_id, email FROM invites WHERE status = 'pending'")
def o6(v: Views) -> DataFrame:
    return an.pending_invites(v.invites).select("id", "organization_id", "email")


@query("o6_active_grants", f"SELECT id, actor_id, expires_at FROM support_grants WHERE expires_at > {AS_OF} AND revoked_at IS NULL")
def o6_grants(v: Views) -> DataFrame:
    return an.active_grants(v.support_grants, _now()).select("id", "actor_id", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


@query("j14_finding_timeline", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY created_at, id) AS nth FROM finding_events)
SELECT e.id, e.finding_id, CAST(nth AS INT) AS nth, coalesce(nullif(u.name, ''), nullif(u.email, ''), 'A user') AS actor,
  CASE WHEN event_type <> 'ai_review' THEN comment WHEN contains(comment, 'reachable') THEN 'AI verdict: likely true positive.' || chr(10) || 'Confidence: 75%.' || chr(10) || 'Explanation: reachable'
  WHEN contains(comment, 'escape') THEN 'AI verdict: likely false positive.' || chr(10) || 'Suggested fix: escape' ELSE comment END AS shown
FROM e LEFT JOIN users u ON e.user_id = u.user_id""")
def j14(v: Views) -> DataFrame:
    """F26 renders the comments."""
    return an.finding_timeline(v.finding_events, v.users).select("id", "finding_id", "nth", "actor", "shown")


@query("p12_admin_search_projects", "SELECT project_id, name FROM projects WHERE (contains(lower(name), '12') OR contains(lower(repo_url), '12')) AND status = 'MACHINERY'")
def p12(v: Views) -> DataFrame:
    return an.admin_search(v.projects, " 12 ", ("name", "repo_url"), status="MACHINERY").select("project_id", "name")


@query("p12_admin_search_users", "SELECT user_id, name, email FROM users WHERE (contains(lower(name), 'supplier#00000001') OR contains(lower(email), 'u2')) AND status = 'active'")
def p12_users(v: Views) -> DataFrame:
    # one OR over both columns: either text matches on its own
    by_name = an.admin_search(v.users, "Supplier#00000001", ("name", "email"), status="active")
    by_mail = an.admin_search(v.users, "U2", ("email", "email"), status="active")
    return by_name.unionByName(by_mail).distinct().select("user_id", "name", "email")


@query("p13_audit_search", """SELECT id, user_id, action, CASE WHEN starts_with(metadata, 'raw') THEN metadata END AS metadata_raw,
  CASE WHEN NOT starts_with(metadata, 'raw') THEN CAST(json_extract(metadata, '$.k') AS INT) ELSE -1 END AS k FROM audit_events WHERE contains(action, 'SCAN') OR contains(action, 'scan')""")
def p13(v: Views) -> DataFrame:
    upper = an.audit_search(v.audit_events, action="SCAN", entity_type="Scan")
    lower = an.audit_search(v.audit_events, action="scan", entity_type="Scan")
    return upper.unionByName(lower).select(
        "id", "user_id", "action", "metadata_raw",
        F.coalesce(F.try_variant_get("metadata_json", "$.k", "int"), F.lit(-1)).alias("k"))


@query("p14_admin_scans", "SELECT scan_id, p.name AS project_name FROM scans s LEFT JOIN projects p ON s.project_id = p.project_id WHERE s.status = 'queued'")
def p14(v: Views) -> DataFrame:
    return an.scan_list(v.scans, v.projects, status="queued").select("scan_id", "project_name")


@query("p15_notification_inbox", "SELECT id, user_id, type FROM notifications WHERE status = 'unread' AND type IN ('scan_completed', 'scan_failed')")
def p15(v: Views) -> DataFrame:
    return an.inbox(v.notifications, unread_only=True, category="scan").select("id", "user_id", "type")


@query("p15_team_inbox", "SELECT id, user_id, type FROM notifications WHERE type = 'team_invite_accepted'")
def p15_team(v: Views) -> DataFrame:
    return an.inbox(v.notifications, category="team").select("id", "user_id", "type")


# --- intake -----------------------------------------------------------------
@query("p9_request_validation", """WITH b AS (SELECT *, CASE WHEN guest THEN 524288 ELSE 10485760 END AS lim, octet_length(encode(source_value)) AS n FROM scan_requests),
r AS (SELECT *, CASE WHEN source_type NOT IN ('repo_url', 'archive', 'paste') THEN 'unsupported_type' WHEN trim(source_value, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty_value' WHEN guest AND n > lim THEN 'too_large'
  WHEN source_type = 'repo_url' THEN CASE source_value WHEN 'https://github.com/a/b' THEN NULL WHEN 'http://github.com/a/b' THEN 'not_https' WHEN 'https://10.1.2.3/x' THEN 'internal_host'
    WHEN 'https://' THEN 'no_host' WHEN 'https://example.org/x' THEN 'prefix_not_allowed' WHEN 'https://user@gitlab.com/x' THEN 'prefix_not_allowed' ELSE 'not_https' END
  WHEN n > lim THEN 'too_large' END AS reason FROM b)
SELECT request_id, reason, CASE WHEN reason IS NULL THEN 200 WHEN reason = 'too_large' THEN 413 ELSE 400 END AS code FROM r""")
def p9(v: Views) -> DataFrame:
    return it.validate_requests(v.scan_requests).select("request_id", "reason", "code")


@query("p10_upload_validation", """WITH r AS (SELECT *, CASE WHEN size > 524288000 THEN 'too_large' WHEN regexp_matches(lower(file_name), '(\\.zip|\\.tar\\.gz|\\.tgz)$') THEN NULL ELSE 'unsupported_archive' END AS reason FROM uploads)
SELECT upload_id, reason, CASE WHEN reason IS NULL THEN 'uploads/' || upload_id || '-' || regexp_extract(file_name, '([^/]*)$', 1) END AS object_key FROM r""")
def p10(v: Views) -> DataFrame:
    return it.validate_uploads(v.uploads).select("upload_id", "reason", "object_key")


@query("p17_badge_validity", f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY published_at DESC, token DESC) AS r FROM badge_publications)
SELECT s.scan_id AS request_id, CASE WHEN b.token IS NULL OR r > 1 THEN 'not_found' WHEN b.published_at + INTERVAL '30' DAY < {AS_OF} THEN 'gone' ELSE 'ok' END AS outcome
FROM scans s LEFT JOIN b ON b.token = 'badge-' || s.scan_id""")
def p17(v: Views) -> DataFrame:
    asked = v.scans.select(F.col("scan_id").alias("request_id"), F.concat(F.lit("badge-"), F.col("scan_id").cast("string")).alias("token"))
    return hi.badge_lookup(asked, hi.current_badges(v.badge_publications), _now()).select("request_id", "outcome")


@query("w7_badge_replacement", """SELECT token, scan_id, CASE WHEN row_number() OVER (PARTITION BY scan_id ORDER BY published_at DESC, token DESC) = 1 THEN 'true' ELSE 'false' END AS is_active,
  published_at + INTERVAL '90' DAY AS expires_at FROM badge_publications""")
def w7(v: Views) -> DataFrame:
    return hi.current_badges(v.badge_publications, "dashboard").select("token", "scan_id", "is_active", "expires_at")


_STALE = f"""WITH s AS (SELECT *, CASE WHEN status = 'queued' AND epoch_us({AS_OF}) - epoch_us(created_at) > 180000000 THEN 'q'
  WHEN status = 'running' AND epoch_us({AS_OF}) - epoch_us(started_at) > 1800000000 THEN 'r' END AS k FROM scans)"""


@query("p18_stale_sweep", f"""{_STALE} SELECT scan_id, 'failed' AS status, {AS_OF} AS completed_at, CASE k WHEN 'q' THEN 'Scan timeout: Stuck in queue for more than 3 minutes.'
  ELSE 'Scan timeout: Stuck in running for more than 30 minutes.' END AS error_message FROM s WHERE k IS NOT NULL""")
def p18(v: Views) -> DataFrame:
    failed, _, _ = it.stale_sweep(v.scans, _now(), v.notifications)
    return failed.select("scan_id", "status", "completed_at", "error_message")


@query("p18_stale_notifications", f"""{_STALE} SELECT triggered_by AS user_id, CAST(scan_id AS VARCHAR) AS ref, 'Scan ' || scan_id || ' failed.' AS message FROM s WHERE k IS NOT NULL AND triggered_by IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM notifications n WHERE n.user_id = s.triggered_by AND n.type = 'scan_failed' AND n.payload = '{{"scanId":"' || s.scan_id || '"}}')""")
def p18_notes(v: Views) -> DataFrame:
    _, _, notes = it.stale_sweep(v.scans, _now(), v.notifications)
    return notes.select("user_id", "ref", "message")


@query("p19_update_validation", """WITH r AS (SELECT update_id, CASE WHEN status = 'closed' THEN 'invalid_status' WHEN verification_status = 'maybe' THEN 'invalid_verification'
  WHEN coalesce(status, '') = '' AND coalesce(verification_status, '') = '' THEN 'nothing_to_update' END AS reason, trim(comment) AS stored_comment FROM finding_updates) SELECT * FROM r""")
def p19(v: Views) -> DataFrame:
    return it.validate_updates(v.finding_updates).select("update_id", "reason", "stored_comment")


@query("p20_cancel_scans", f"""SELECT scan_id, status AS old_status, CASE WHEN status = 'completed' THEN 'completed' WHEN source_type = 'archive' THEN 'cancelled' ELSE 'failed' END AS status,
  CASE WHEN status = 'completed' THEN 'not_cancellable' ELSE 'ok' END AS outcome FROM scans WHERE triggered_by IS NOT NULL""")
def p20(v: Views) -> DataFrame:
    asked = v.scans.filter("triggered_by is not null").select("scan_id", (F.col("source_type") == "archive").alias("by_admin"))
    return go.cancel_scans(v.scans, asked, _now()).select("scan_id", "old_status", "status", "outcome")


# --- events and governance ----------------------------------------------------
def _after(v: Views) -> DataFrame:
    c = F.col
    return v.scan_findings.select(
        "id", F.when(c("severity") == "Critical", "confirmed").otherwise(c("status")).alias("status"),
        F.when(c("severity") == "Info", "skipped").otherwise(c("verification_status")).alias("verification_status"),
        F.when(c("severity") == "High", F.lit(None)).when(c("severity") == "Medium", "user-3").otherwise(c("assignee_id")).alias("assignee_id"),
        F.when(c("status") == "open", "user-4").otherwise("user-3").alias("actor_id"), F.when(c("severity") == "Low", F.concat(F.lit(" seen "), c("rule_id"))).alias("comment"))


_ACTOR = "CASE WHEN status = 'open' THEN 'user-4' ELSE 'user-3' END"
_EVENTS = f"""e AS (SELECT id AS finding_id, {_ACTOR} AS user_id, 'status_changed' AS event_type, status AS old_value, 'confirmed' AS new_value, CAST(NULL AS VARCHAR) AS comment
  FROM scan_findings WHERE severity = 'Critical' AND status <> 'confirmed'
UNION ALL SELECT id, {_ACTOR}, 'verification_status_changed', verification_status, 'skipped', NULL FROM scan_findings WHERE severity = 'Info' AND verification_status <> 'skipped'
UNION ALL SELECT id, {_ACTOR}, 'comment', NULL, NULL, 'seen ' || rule_id FROM scan_findings WHERE severity = 'Low'
UNION ALL SELECT id, {_ACTOR}, 'unassigned', assignee_id, NULL, NULL FROM scan_findings WHERE severity = 'High' AND assignee_id IS NOT NULL
UNION ALL SELECT id, {_ACTOR}, 'assigned', assignee_id, 'user-3', NULL FROM scan_findings WHERE severity = 'Medium' AND assignee_id IS DISTINCT FROM 'user-3')"""


@query("e1_finding_events", f"WITH {_EVENTS} SELECT * FROM e")
def e1(v: Views) -> DataFrame:
    return go.finding_events(v.scan_findings, _after(v)).select("finding_id", "user_id", "event_type", "old_value", "new_value", "comment")


@query("e2_finding_notifications", f"""WITH n AS (SELECT f.*, {_ACTOR.replace("status", "f.status")} AS actor FROM findings f),
w AS (SELECT n.*, coalesce(nullif(u.name, ''), nullif(u.email, ''), 'A user') AS who FROM n LEFT JOIN users u ON u.user_id = n.actor)
SELECT assignee_id AS user_id, 'finding_commented' AS type, who || ' commented on ' || title || '.' AS message,
  '{{"findingId":"' || id || '","projectId":"' || project_id || '","scanId":"' || scan_id || '","actorId":"' || actor || '"}}' AS payload
FROM w WHERE severity = 'Low' AND assignee_id IS NOT NULL AND assignee_id <> actor
UNION ALL SELECT 'user-3', 'finding_assigned', who || ' assigned ' || title || ' to you.',
  '{{"findingId":"' || id || '","projectId":"' || project_id || '","scanId":"' || scan_id || '","actorId":"' || actor || '"}}'
FROM w WHERE severity = 'Medium' AND assignee_id IS DISTINCT FROM 'user-3' AND actor <> 'user-3'""")
def e2(v: Views) -> DataFrame:
    events = go.finding_events(v.scan_findings, _after(v))
    return go.finding_notifications(events, v.findings, v.users).select("user_id", "type", "message", "payload")


@query("e2_project_deleted", """WITH d AS (SELECT *, 'user-5' AS actor FROM projects WHERE visibility = 'public'),
u AS (SELECT project_id, name, created_by AS user_id FROM d UNION SELECT d.project_id, d.name, m.user_id FROM d JOIN organization_members m ON d.organization_id = m.organization_id)
SELECT user_id, name || ' was deleted.' AS message FROM u WHERE user_id IS NOT NULL AND user_id <> 'user-5'""")
def e2_projects(v: Views) -> DataFrame:
    gone = v.projects.filter("visibility = 'public'").withColumn("actor_id", F.lit("user-5"))
    return go.project_deleted_notifications(gone, v.organization_members).select("user_id", "message")


@query("e2_team_deleted", """SELECT m.user_id, o.name || ' was deleted.' AS message, '{"organizationId":"' || o.organization_id || '","organizationName":"' || o.name || '","deletedBy":"user-5"}' AS payload
FROM organizations o JOIN (SELECT DISTINCT organization_id, user_id FROM organization_members) m ON o.organization_id = m.organization_id WHERE o.organization_id % 2 = 1 AND m.user_id <> 'user-5'""")
def e2_teams(v: Views) -> DataFrame:
    gone = v.organizations.filter("organization_id % 2 = 1").withColumn("actor_id", F.lit("user-5"))
    return go.team_deleted_notifications(gone, v.organization_members).select("user_id", "message", "payload")


def _leaving(v: Views) -> DataFrame:
    """Every sixth supplier leaves its team, those after are removed from theirs, some ask for a team they are not in."""
    return v.sql("""SELECT CASE WHEN s_suppkey % 6 = 2 THEN s_nationkey + 1 ELSE s_nationkey END AS organization_id, 'user-' || CAST(s_suppkey AS STRING) AS user_id,
      CASE WHEN s_suppkey % 6 = 0 THEN 'user-' || CAST(s_suppkey AS STRING) ELSE 'user-1' END AS actor_id FROM {supplier} WHERE s_suppkey % 6 < 3""")


_ENDS = """ends AS (SELECT q.*, m.role, CASE WHEN m.role IS NULL THEN 'not_found' WHEN m.role = 'owner' AND w.n <= 1 THEN 'last_owner' WHEN q.user_id = q.actor_id THEN 'left' ELSE 'removed' END AS outcome
  FROM (SELECT CASE WHEN s_suppkey % 6 = 2 THEN s_nationkey + 1 ELSE s_nationkey END AS organization_id, 'user-' || s_suppkey AS user_id, CASE WHEN s_suppkey % 6 = 0 THEN 'user-' || s_suppkey ELSE 'user-1' END AS actor_id FROM supplier WHERE s_suppkey % 6 < 3) q
  LEFT JOIN organization_members m ON m.organization_id = q.organization_id AND m.user_id = q.user_id
  LEFT JOIN (SELECT organization_id, count(*) FILTER (role = 'owner') AS n FROM organization_members GROUP BY ALL) w ON w.organization_id = q.organization_id)"""


@query("e2_membership_ends", f"WITH {_ENDS} SELECT organization_id, user_id, outcome FROM ends")
def e2_ends(v: Views) -> DataFrame:
    return go.membership_ends(_leaving(v), v.organization_members).select("organization_id", "user_id", "outcome")


@query("e2_membership_notifications", f"""WITH {_ENDS} SELECT m.user_id, 'team_member_left' AS type, coalesce(nullif(u.name, ''), nullif(u.email, ''), 'A member') || ' left ' || o.name || '.' AS message,
  '{{"organizationId":"' || e.organization_id || '","organizationName":"' || o.name || '","userId":"' || e.user_id || '"}}' AS payload
FROM ends e JOIN organizations o ON e.organization_id = o.organization_id JOIN organization_members m ON m.organization_id = e.organization_id AND m.user_id <> e.user_id LEFT JOIN users u ON u.user_id = e.user_id WHERE outcome = 'left'
UNION ALL SELECT e.user_id, 'team_member_removed', 'You were removed from ' || o.name || '.', '{{"organizationId":"' || e.organization_id || '","organizationName":"' || o.name || '","removedBy":"user-1"}}'
FROM ends e JOIN organizations o ON e.organization_id = o.organization_id WHERE outcome = 'removed'""")
def e2_members(v: Views) -> DataFrame:
    ends = go.membership_ends(_leaving(v), v.organization_members)
    return go.membership_notifications(ends, v.organizations, v.organization_members, v.users).select("user_id", "type", "message", "payload")


_REVIEW = """'{"isLikelyTruePositive":' || CASE WHEN severity = 'Critical' THEN 'true' ELSE 'false' END || ',"confidence":0.75,"explanation":"' || title || '"}'"""


@query("e1_review_events", f"SELECT id AS finding_id, 'user-2' AS user_id, 'ai_review' AS event_type, {_REVIEW} AS comment FROM findings WHERE severity IN ('Critical', 'High')")
def e1_reviews(v: Views) -> DataFrame:
    return go.review_events(_reviews(v)).select("finding_id", "user_id", "event_type", "comment")


def _reviews(v: Views) -> DataFrame:
    answer = F.concat(F.lit('{"isLikelyTruePositive":'), F.when(F.col("severity") == "Critical", "true").otherwise("false"), F.lit(',"confidence":0.75,"explanation":"'), "title", F.lit('"}'))
    return v.findings.filter(F.col("severity").isin("Critical", "High")).select(F.col("id").alias("finding_id"), F.lit("user-2").alias("user_id"), answer.alias("review"))


@query("e4_review_audit", """SELECT 'user-2' AS user_id, 'finding.ai_review' AS action, CAST(id AS VARCHAR) AS entity_id, '{"projectId":"' || project_id || '","scanId":"' || scan_id || '"}' AS metadata
FROM findings WHERE severity IN ('Critical', 'High')""")
def e4_reviews(v: Views) -> DataFrame:
    return go.audit_events(go.review_events(_reviews(v)), v.findings).select("user_id", "action", "entity_id", "metadata")


@query("o6_project_tokens", "SELECT id, project_id, scopes, is_active FROM api_tokens WHERE project_id % 2 = 1")
def o6_tokens(v: Views) -> DataFrame:
    """The list of tokens never shows their hashes."""
    tokens = v.api_tokens.filter("project_id % 2 = 1").withColumn("created_at", _now())
    listed = an.project_tokens(tokens)
    assert "token_hash" not in listed.columns
    return listed.select("id", "project_id", "scopes", "is_active")


@query("e6_invite_replies", f"""SELECT i.id AS invite_id, CASE WHEN i.id % 3 = 0 THEN 'other@example.org' ELSE email END AS email, CASE WHEN i.id % 3 <> 0 AND status = 'pending' AND expires_at >= {AS_OF} THEN 'ok' ELSE 'invalid' END AS outcome FROM invites i""")
def e6_replies(v: Views) -> DataFrame:
    """Every third reply comes from another address than the invited one."""
    replies = v.invites.select(F.col("id").alias("invite_id"), "organization_id", F.when(F.col("id") % 3 == 0, "other@example.org").otherwise(F.col("email")).alias("email"))
    return go.resolve_invites(replies, v.invites, _now()).select("invite_id", "email", "outcome")


@query("j8_scan_notifications", """SELECT triggered_by AS user_id, 'scan_completed' AS type, 'Scan ' || scan_id || ' completed with risk ' || risk_level || '.' AS message, CAST(scan_id AS VARCHAR) AS ref
FROM scans s WHERE status = 'completed' AND triggered_by IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM notifications n WHERE n.user_id = s.triggered_by AND n.type = 'scan_completed' AND n.id = s.scan_id)""")
def j8(v: Views) -> DataFrame:
    return go.scan_notifications(v.scans, v.notifications).select("user_id", "type", "message", "ref")


_STATES = "('open', 'confirmed', 'in_progress', 'fixed', 'accepted_risk', 'false_positive', 'ignored', 'reopened')"


@query("e3_state_replay", f"""WITH s AS (SELECT finding_id, new_value FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, id DESC) AS r FROM finding_events
    WHERE event_type = 'status_changed' AND new_value IN {_STATES}) WHERE r = 1),
w AS (SELECT finding_id, new_value FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, id DESC) AS r FROM finding_events
    WHERE event_type = 'verification_status_changed' AND new_value <> 'bogus') WHERE r = 1),
a AS (SELECT finding_id, new_value FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, id DESC) AS r FROM finding_events
    WHERE event_type IN ('assigned', 'unassigned')) WHERE r = 1),
k AS (SELECT finding_id, count(*) FILTER (event_type = 'comment') AS comments FROM finding_events GROUP BY finding_id)
SELECT k.finding_id, s.new_value AS status, w.new_value AS verification_status, a.new_value AS assignee_id, comments FROM k
  LEFT JOIN s ON k.finding_id = s.finding_id LEFT JOIN w ON k.finding_id = w.finding_id LEFT JOIN a ON k.finding_id = a.finding_id""")
def e3(v: Views) -> DataFrame:
    return go.replay_findings(v.finding_events)


@query("e4_audit_events", f"""WITH {_EVENTS} SELECT e.user_id, CASE WHEN event_type LIKE '%status%' THEN 'finding.triage.update' WHEN event_type = 'comment' THEN 'finding.comment' ELSE 'finding.assign' END AS action,
  e.finding_id AS entity_id, '{{"projectId":"' || f.project_id || '","scanId":"' || f.scan_id || '"' ||
  CASE event_type WHEN 'status_changed' THEN ',"status":{{"oldValue":"' || old_value || '","newValue":"' || new_value || '"}}'
    WHEN 'verification_status_changed' THEN ',"verificationStatus":{{"oldValue":"' || old_value || '","newValue":"' || new_value || '"}}'
    WHEN 'unassigned' THEN ',"oldValue":"' || old_value || '"' WHEN 'assigned' THEN coalesce(',"oldValue":"' || old_value || '"', '') || ',"newValue":"' || new_value || '"' ELSE '' END || '}}' AS metadata
FROM e JOIN findings f ON e.finding_id = f.id""")
def e4(v: Views) -> DataFrame:
    events = go.finding_events(v.scan_findings, _after(v))
    return go.audit_events(events, v.findings).select("user_id", "action", "entity_id", "metadata")


@query("e5_user_erasure", """WITH x AS (SELECT user_id FROM users WHERE status = 'disabled')
SELECT 'findings' AS "table", count(*) AS n, count(*) FILTER (assignee_id IS NULL OR assignee_id IN (SELECT user_id FROM x)) AS blank FROM scan_findings
UNION ALL SELECT 'projects', count(*), count(*) FILTER (created_by IN (SELECT user_id FROM x)) FROM projects
UNION ALL SELECT 'scans', count(*), count(*) FILTER (triggered_by IS NULL OR triggered_by IN (SELECT user_id FROM x)) FROM scans
UNION ALL SELECT 'audit_events', count(*) + (SELECT count(*) FROM x), count(*) FILTER (user_id IN (SELECT user_id FROM x)) + (SELECT count(*) FROM x) FROM audit_events
UNION ALL SELECT 'organization_members', count(*), 0 FROM organization_members WHERE user_id NOT IN (SELECT user_id FROM x)
UNION ALL SELECT 'users', count(*), count(*) FILTER (status = 'disabled') FROM users""")
def e5(v: Views) -> DataFrame:
    out = go.erase_users(v.users.filter("status = 'disabled'"), _now(), users=v.users, members=v.organization_members,
                         findings=v.scan_findings.select("id", "assignee_id"), projects=v.projects, scans=v.scans, audit=v.audit_events)
    blank = {"findings": F.col("assignee_id").isNull(), "projects": F.col("created_by").isNull(), "scans": F.col("triggered_by").isNull(),
             "audit_events": F.col("user_id").isNull(), "organization_members": F.col("user_id").isNull(), "users": F.col("status") == "deleted"}
    parts = [out[n].agg(F.count(F.lit(1)).alias("n"), F.count_if(b).alias("blank")).select(F.lit(n).alias("table"), "n", "blank") for n, b in blank.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total


@query("e6_invite_states", f"""SELECT id, CASE WHEN status = 'pending' AND expires_at < {AS_OF} THEN 'expired' ELSE status END AS effective_status, status = 'pending' AND expires_at >= {AS_OF} AS acceptable FROM invites""")
def e6(v: Views) -> DataFrame:
    return go.invite_states(v.invites, _now()).select("id", "effective_status", "acceptable")


@query("e7_policy_presets", """WITH ch AS (SELECT c_custkey AS project_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Fast Scan' WHEN 'MACHINERY' THEN 'Strict Security' WHEN 'HOUSEHOLD' THEN 'AI Assisted' END AS preset
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))
SELECT coalesce(p.project_id, ch.project_id) AS project_id, CASE WHEN preset = 'Fast Scan' THEN '["semgrep","owasp","secrets"]' WHEN preset IS NOT NULL THEN '["semgrep","bandit","eslint","owasp","trivy","secrets"]'
  ELSE enabled_engines END AS enabled_engines, CASE preset WHEN 'Fast Scan' THEN 'Medium' WHEN 'Strict Security' THEN 'Info' WHEN 'AI Assisted' THEN 'Low' ELSE severity_threshold END AS severity_threshold,
  CASE WHEN preset IS NULL THEN ai_triage_enabled ELSE preset = 'AI Assisted' END AS ai_triage_enabled,
  CASE WHEN preset IS NULL THEN secret_verification_enabled ELSE preset = 'Strict Security' END AS secret_verification_enabled
FROM scanner_policies p FULL JOIN ch ON p.project_id = ch.project_id""")
def e7(v: Views) -> DataFrame:
    chosen = v.sql("""SELECT c_custkey AS project_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Fast Scan' WHEN 'MACHINERY' THEN 'Strict Security' ELSE 'AI Assisted' END AS preset
      FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""")
    return go.apply_presets(v.scanner_policies, chosen).drop("rule_overrides")


# --- scalar functions on events, names, times -----------------------------------
@query("f24_f25_times", f"""WITH t AS (SELECT id, created_at, date_diff('second', created_at, TIMESTAMP '2024-01-31 12:00:00') AS s0,
  CAST(floor((epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(created_at)) / 1000000) AS BIGINT) AS s FROM scan_events)
SELECT id, strftime(created_at + INTERVAL '7' HOUR, '%H:%M %-d thg %-m, %Y') AS local, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min' || CASE WHEN s // 60 > 1 THEN 's' ELSE '' END || ' ago'
  WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 > 1 THEN 's' ELSE '' END || ' ago' WHEN s < 2592000 THEN (s // 86400) || ' day' || CASE WHEN s // 86400 > 1 THEN 's' ELSE '' END || ' ago'
  ELSE strftime(created_at + INTERVAL '7' HOUR, '%-d thg %-m, %Y') END AS age FROM t""")
def f24(v: Views) -> DataFrame:
    as_of = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    return v.scan_events.select("id", tx.local_time(F.col("created_at")).alias("local"), tx.relative_age(F.col("created_at"), as_of).alias("age"))


@query("f29_slug_email", r"""SELECT project_id, regexp_replace(regexp_replace(lower(trim(name || ' / ' || status || '!')), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g') AS slug,
  lower(trim(' ' || created_by || '@X.org ')) AS email, true AS ok FROM projects""")
def f29(v: Views) -> DataFrame:
    mail = tx.normalise_email(F.concat(F.lit(" "), "created_by", F.lit("@X.org ")))
    return v.projects.select("project_id", tx.slugify(F.concat("name", F.lit(" / "), "status", F.lit("!"))).alias("slug"),
                             mail.alias("email"), tx.is_valid_email(mail).alias("ok"))

