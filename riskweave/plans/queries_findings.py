"""Queries over findings and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskweave.functions import scoring as sc, text as tx
from riskweave.operators import analytics as an, dedupe, enrichment as en, history as hi, risk, triage as tr
from riskweave.plans.registry import query
from riskweave.views import Views

_RANK = "CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"
_WEIGHT = "CASE severity WHEN 'Critical' THEN 30 WHEN 'High' THEN 14 WHEN 'Medium' THEN 6 WHEN 'Low' THEN 2 ELSE 1 END"
_COUNTS = ("count(*) FILTER (lower(severity) = 'critical') AS critical, count(*) FILTER (lower(severity) = 'high') AS high, "
           "count(*) FILTER (lower(severity) = 'medium') AS medium, count(*) FILTER (lower(severity) = 'low') AS low, "
           "count(*) FILTER (lower(severity) = 'info') AS info, count(*) AS total")


@query("a1_risk_score", f"""
WITH g AS (SELECT scan_id, sum({_WEIGHT} * confidence) AS w, max({_RANK}) AS r,
  bool_or(scan_category = 'Secret scan' AND verification_status = 'verified') AS live FROM scan_findings GROUP BY scan_id),
s AS (SELECT scan_id, greatest(least(round(w + CASE WHEN live THEN 20.0 ELSE 0.0 END, 6), 100.0),
  CASE r WHEN 4 THEN 85.0 WHEN 3 THEN 60.0 WHEN 2 THEN 35.0 ELSE 0.0 END) AS p FROM g)
SELECT scans.scan_id, CASE WHEN p IS NULL THEN 'Low' WHEN p >= 85 THEN 'Critical' WHEN p >= 70 THEN 'High'
  WHEN p >= 40 THEN 'Medium' ELSE 'Low' END AS risk_level, CAST(coalesce(p, 5.0) AS DOUBLE) AS risk_percent
FROM scans LEFT JOIN s ON scans.scan_id = s.scan_id""")
def a1(v: Views) -> DataFrame:
    return risk.scan_risk(v.scan_findings, v.scans)


@query("a2_severity_counts_scan", f"SELECT scan_id, {_COUNTS} FROM scan_findings GROUP BY scan_id")
def a2(v: Views) -> DataFrame:
    return an.severity_counts(v.scan_findings, ["scan_id"])


@query("a2_severity_counts_project", f"SELECT project_id, {_COUNTS} FROM findings GROUP BY project_id")
def a2_project(v: Views) -> DataFrame:
    return an.severity_counts(v.findings, ["project_id"])


@query("a2_severity_counts_organization", f"""SELECT p.organization_id, {_COUNTS} FROM findings f JOIN projects p
  ON f.project_id = p.project_id WHERE p.organization_id IS NOT NULL GROUP BY p.organization_id""")
def a2_org(v: Views) -> DataFrame:
    # counted per project first, so the join to projects carries one row a project
    per_project = an.severity_counts(v.findings, ["project_id"])
    orgs = v.projects.filter("organization_id is not null").select("project_id", "organization_id")
    names = ["critical", "high", "medium", "low", "info", "total"]
    return per_project.join(orgs, "project_id").groupBy("organization_id").agg(*[F.sum(n).alias(n) for n in names])


@query("a3_status_counts", """SELECT scan_id, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'confirmed') AS confirmed,
  count(*) FILTER (status = 'false_positive') AS false_positive, count(*) FILTER (status = 'fixed') AS fixed,
  count(*) FILTER (status = 'accepted_risk') AS accepted_risk FROM scan_findings GROUP BY scan_id""")
def a3(v: Views) -> DataFrame:
    return an.status_counts(v.scan_findings, ["scan_id"])


@query("a4_file_heatmap", """SELECT scan_id, file, n, rank FROM (SELECT scan_id, file_path AS file, count(*) AS n,
  CAST(row_number() OVER (PARTITION BY scan_id ORDER BY count(*) DESC, file_path) AS INT) AS rank
  FROM scan_findings GROUP BY scan_id, file_path) WHERE rank <= 50""")
def a4(v: Views) -> DataFrame:
    return an.file_heatmap(v.scan_findings)


@query("a5_engine_counts", """SELECT scan_id, engine, n, rank FROM (SELECT scan_id, engine, count(*) AS n,
  CAST(row_number() OVER (PARTITION BY scan_id ORDER BY count(*) DESC, engine) AS INT) AS rank
  FROM scan_findings GROUP BY scan_id, engine) WHERE rank <= 5""")
def a5(v: Views) -> DataFrame:
    return an.engine_counts(v.scan_findings, 5)


@query("a6_owasp_counts", """WITH g AS (SELECT scan_id, coalesce(nullif(owasp_category, ''), 'Unmapped') AS owasp, count(*) AS n FROM scan_findings GROUP BY ALL)
SELECT scan_id, owasp, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, owasp) AS INT) AS rank FROM g) WHERE rank <= 5""")
def a6(v: Views) -> DataFrame:
    return an.owasp_counts(v.scan_findings, 5)


@query("a7_category_counts", "SELECT scan_id, scan_category AS category, count(*) AS n FROM scan_findings GROUP BY ALL")
def a7(v: Views) -> DataFrame:
    return an.category_counts(v.scan_findings)


@query("a12_triage_statistics", """SELECT scan_id, 'verification' AS kind, verification_status AS name, count(*) AS n
  FROM scan_findings GROUP BY ALL UNION ALL SELECT scan_id, 'severity', severity, count(*) FROM scan_findings GROUP BY ALL""")
def a12(v: Views) -> DataFrame:
    return an.triage_statistics(v.scan_findings)


@query("a13_badge_summary", f"""WITH live AS (SELECT * FROM scan_findings WHERE status NOT IN ('false_positive', 'fixed')),
f AS (SELECT scan_id, vuln_type, min(seq) AS place FROM live GROUP BY ALL),
t AS (SELECT scan_id, string_agg(vuln_type, '|' ORDER BY place, vuln_type) AS top_vulnerabilities FROM (SELECT *, row_number()
  OVER (PARTITION BY scan_id ORDER BY place, vuln_type) AS nth FROM f) WHERE nth <= 5 GROUP BY scan_id),
c AS (SELECT scan_id, {_COUNTS} FROM live GROUP BY scan_id)
SELECT c.*, t.top_vulnerabilities FROM c JOIN t ON c.scan_id = t.scan_id""")
def a13(v: Views) -> DataFrame:
    return an.badge_summary(v.scan_findings).withColumn("top_vulnerabilities", F.array_join("top_vulnerabilities", "|"))


@query("a15_ci_gate", """WITH g AS (SELECT scan_id, count(*) FILTER (severity IN ('Critical', 'High')) AS e,
  count(*) FILTER (severity = 'Medium') AS w FROM scan_findings GROUP BY scan_id)
SELECT s.scan_id, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, CASE WHEN coalesce(e, 0) > 0 THEN 'fail' ELSE 'pass' END AS verdict
FROM scans s LEFT JOIN g ON s.scan_id = g.scan_id""")
def a15(v: Views) -> DataFrame:
    from riskweave.operators.evaluation import ci_gate
    return ci_gate(v.scan_findings, v.scans)


@query("a16_severity_share", f"""WITH c AS (SELECT scan_id, {_COUNTS} FROM scan_findings GROUP BY scan_id),
t AS (SELECT *, critical + high + medium + low AS n FROM c)
SELECT scan_id, CASE WHEN n = 0 THEN 0.0 ELSE round(critical / n * 100, 6) END AS critical_pct,
  CASE WHEN n = 0 THEN 0.0 ELSE round(high / n * 100, 6) END AS high_pct,
  CASE WHEN n = 0 THEN 0.0 ELSE round(medium / n * 100, 6) END AS medium_pct,
  CASE WHEN n = 0 THEN 0.0 ELSE round(low / n * 100, 6) END AS low_pct FROM t""")
def a16(v: Views) -> DataFrame:
    shares = an.severity_shares(an.severity_counts(v.scan_findings, ["scan_id"]))
    return shares.select("scan_id", *[F.round(f"{c}_pct", 6).alias(f"{c}_pct") for c in ("critical", "high", "medium", "low")])


_SURFACE = " UNION ALL ".join(
    f"SELECT project_id, '{label}' AS category, CAST(greatest({floor}, floor(round(({form}) * m * {factor}, 9) + 0.5)) AS BIGINT) AS count FROM m"
    for label, floor, factor, form in (
        ("Injection (SQLi/XSS)", 4, "CAST(0.6 AS DOUBLE)", "critical * 2 + high"),
        ("Broken Auth", 5, "CAST(0.5 AS DOUBLE)", "critical + medium * CAST(1.5 AS DOUBLE)"),
        ("Sensitive Data", 3, "CAST(0.45 AS DOUBLE)", "high * CAST(1.8 AS DOUBLE) + low"),
        ("XXE & SSRF", 2, "CAST(0.4 AS DOUBLE)", "critical * CAST(1.2 AS DOUBLE) + high * CAST(0.8 AS DOUBLE)"),
        ("Access Control", 6, "CAST(0.7 AS DOUBLE)", "critical * CAST(2.2 AS DOUBLE) + medium"),
        ("Misconfig", 4, "CAST(0.5 AS DOUBLE)", "high + low * 2")))


@query("f33_attack_surface", f"""WITH c AS (SELECT project_id, {_COUNTS} FROM findings GROUP BY project_id),
m AS (SELECT *, CASE WHEN critical + high + medium + low > 0 THEN 1 ELSE 15 END AS m FROM c) {_SURFACE}""")
def f33(v: Views) -> DataFrame:
    return an.attack_surface(an.severity_counts(v.findings, ["project_id"]), ["project_id"])


_FOLD = f"""WITH r AS (SELECT *, {_RANK} AS rk, max({_RANK}) OVER (PARTITION BY scan_id, dedupe_hash) AS top FROM scan_findings),
z AS (SELECT *, min(CASE WHEN rk = top THEN seq END) OVER (PARTITION BY scan_id, dedupe_hash) AS s0,
  min(seq) OVER (PARTITION BY scan_id, dedupe_hash) AS first_seq, count(*) OVER (PARTITION BY scan_id, dedupe_hash) AS copies FROM r),
y AS (SELECT *, max(confidence) OVER (PARTITION BY scan_id, dedupe_hash ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
  max(confidence) OVER (PARTITION BY scan_id, dedupe_hash) AS best FROM z WHERE seq >= s0),
x AS (SELECT *, row_number() OVER (PARTITION BY scan_id, dedupe_hash ORDER BY seq DESC) AS nth FROM y
  WHERE rk = top AND (seen IS NULL OR confidence > seen))"""


@query("a17_deduplicate", _FOLD + """ SELECT id, scan_id, dedupe_hash, severity, best AS confidence, first_seq, copies FROM x WHERE nth = 1""")
def a17(v: Views) -> DataFrame:
    return dedupe.deduplicate(v.scan_findings).select(
        "id", "scan_id", "dedupe_hash", "severity", "confidence", "first_seq", "copies")


@query("a18_stage_counters", """WITH pol AS (SELECT project_id, enabled_engines AS e FROM scanner_policies),
s AS (SELECT scan_id, e FROM scans LEFT JOIN pol ON scans.project_id = pol.project_id),
grid AS (SELECT scan_id, e, unnest(['semgrep', 'bandit', 'eslint', 'owasp', 'trivy', 'secrets']) AS engine FROM s),
c AS (SELECT scan_id, CASE engine WHEN 'eslint-security' THEN 'eslint' WHEN 'owasp-patterns' THEN 'owasp' WHEN 'secret-scan' THEN 'secrets'
  ELSE engine END AS engine, count(*) AS n FROM scan_findings GROUP BY ALL),
g AS (SELECT grid.*, c.n, (e IS NULL OR e IN ('[]', 'not json') OR contains(e, '"' || grid.engine || '"')) AS is_on FROM grid
  LEFT JOIN c ON grid.scan_id = c.scan_id AND grid.engine = c.engine)
SELECT scan_id, engine, CASE WHEN is_on THEN 'completed' ELSE 'skipped' END AS stage, CASE WHEN is_on THEN coalesce(n, 0) ELSE 0 END AS n FROM g""")
def a18(v: Views) -> DataFrame:
    ruled = en.with_policy(v.scans.select("scan_id", "project_id"), v.scanner_policies)
    return an.stage_counters(v.scan_findings, ruled)


@query("a20_scan_duration", """SELECT scan_id, coalesce(epoch_us(completed_at) // 1000 - epoch_us(started_at) // 1000, -1) AS duration_ms FROM scans""")
def a20(v: Views) -> DataFrame:
    return an.scan_durations(v.scans).select("scan_id", F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"))


# --- triage -------------------------------------------------------------------
_HEUR = """WITH b AS (SELECT *, lower(title || ' ' || vuln_type || ' ' || code_snippet || ' ' || source || ' ' || sink) AS t FROM scan_findings),
h AS (SELECT *, CASE WHEN verification_status <> 'unverified' THEN 0
  WHEN (contains(t, 'injection') OR contains(t, 'sqli') OR contains(t, 'command')) AND source <> '' AND sink <> '' THEN 1
  WHEN (contains(t, 'injection') OR contains(t, 'xss') OR contains(t, 'ssrf')) AND source = '' THEN 2
  WHEN scan_category = 'Secret scan' AND regexp_matches(lower(evidence), 'localhost|127\\.0\\.0\\.1|example\\.com|test') THEN 3 ELSE 4 END AS k FROM b)"""


@query("r1_heuristic_triage", _HEUR + """ SELECT id, CASE k WHEN 0 THEN verification_status WHEN 2 THEN 'false_positive_likely'
  WHEN 3 THEN 'false_positive_likely' ELSE 'needs_review' END AS verification_status,
  CASE k WHEN 2 THEN least(confidence, CAST(0.55 AS DOUBLE)) WHEN 3 THEN least(confidence, CAST(0.4 AS DOUBLE)) ELSE confidence END AS confidence FROM h""")
def r1(v: Views) -> DataFrame:
    return tr.heuristic_triage(v.scan_findings).select("id", "verification_status", "confidence")


@query("w3_review_candidates", f"""SELECT id, scan_id, CAST(k AS INT) AS review_rank FROM (SELECT *, row_number() OVER (PARTITION BY scan_id
  ORDER BY {_RANK} DESC, confidence DESC, seq) AS k FROM scan_findings WHERE verification_status = 'unverified') WHERE k <= 25""")
def w3(v: Views) -> DataFrame:
    return tr.review_candidates(v.scan_findings, 25).select("id", "scan_id", "review_rank")


def _verdicts(v: Views) -> DataFrame:
    return v.sql("""SELECT l_orderkey AS scan_id, seq, CASE l_suppkey % 4 WHEN 0 THEN -0.5D WHEN 1 THEN 0.05D WHEN 2 THEN 0.4D ELSE -0.1D END AS confidence_delta,
      CASE l_suppkey % 3 WHEN 0 THEN 'false_positive_likely' WHEN 1 THEN 'verified' ELSE 'needs_review' END AS verification_status,
      CASE WHEN l_suppkey % 2 = 0 THEN 'judged' ELSE '' END AS why_vulnerable, '' AS exploitability, '' AS false_positive_reason,
      '' AS remediation, '' AS secure_example, 'stage it' AS pentest_hint
      FROM {scan_findings} f JOIN (SELECT l_orderkey, l_suppkey, max(l_shipdate) AS d FROM {lineitem} WHERE l_returnflag <> 'R' GROUP BY l_orderkey, l_suppkey) l
      ON f.scan_id = l.l_orderkey AND CAST(substr(f.seq, 19, 8) AS BIGINT) = l.l_suppkey""")


@query("r2_reviewer_verdicts", _HEUR + f""", cand AS (SELECT scan_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY scan_id
  ORDER BY {_RANK} DESC, confidence DESC, seq) AS k FROM scan_findings WHERE verification_status = 'unverified')),
supp AS (SELECT DISTINCT l_orderkey AS scan_id, l_suppkey AS s FROM lineitem WHERE l_returnflag <> 'R'),
j AS (SELECT h.*, cand.seq IS NOT NULL AND supp.s IS NOT NULL AS c, supp.s AS s FROM h LEFT JOIN cand ON h.scan_id = cand.scan_id AND h.seq = cand.seq
  LEFT JOIN supp ON h.scan_id = supp.scan_id AND CAST(substr(h.seq, 19, 8) AS BIGINT) = supp.s)
SELECT id, CASE WHEN c THEN CASE WHEN s % 3 = 0 THEN 'false_positive_likely' ELSE 'needs_review' END
    WHEN k = 0 THEN verification_status WHEN k IN (2, 3) THEN 'false_positive_likely' ELSE 'needs_review' END AS verification_status,
  round(CASE WHEN c THEN greatest(0.0, least(1.0, confidence + CASE s % 4 WHEN 0 THEN -0.3 WHEN 1 THEN 0.05 WHEN 2 THEN 0.1 ELSE -0.1 END))
    WHEN k = 2 THEN least(confidence, 0.55) WHEN k = 3 THEN least(confidence, 0.4) ELSE confidence END, 6) AS confidence,
  CASE WHEN c AND s % 2 = 0 THEN 'judged' ELSE why_vulnerable END AS why_vulnerable,
  CASE WHEN c THEN 'stage it' ELSE pentest_hint END AS pentest_hint FROM j""")
def r2(v: Views) -> DataFrame:
    texts = {n: F.lit("") for n in ("exploitability", "false_positive_reason")}
    out = tr.apply_verdicts(v.scan_findings.withColumns(texts), _verdicts(v))
    return out.select("id", "verification_status", F.round("confidence", 6).alias("confidence"), "why_vulnerable", "pentest_hint")


@query("r3_confidence_floor", "SELECT id, greatest(round(confidence - 0.5, 2), CAST(0.05 AS DOUBLE)) AS confidence FROM scan_findings")
def r3(v: Views) -> DataFrame:
    low = v.scan_findings.withColumn("confidence", F.round(F.col("confidence") - 0.5, 2))
    return tr.floor_confidence(low).select("id", "confidence")


@query("r4_path_review", """SELECT id, CASE WHEN contains(file_path, 'f1') THEN 'false_positive_likely' WHEN verification_status = 'unverified'
  THEN 'needs_review' ELSE verification_status END AS verification_status, CASE WHEN contains(file_path, 'f1') THEN CAST(0.3 AS DOUBLE) ELSE confidence END AS confidence
  FROM scan_findings""")
def r4(v: Views) -> DataFrame:
    renamed = v.scan_findings.withColumn("file_path", F.replace("file_path", F.lit("f1"), F.lit("Test1")))
    return tr.path_review(renamed).select("id", "verification_status", "confidence")


# --- enrichment functions -----------------------------------------------------
@query("f1_scan_category", """WITH b AS (SELECT *, lower(engine || ' ' || title || ' ' || vuln_type || ' ' || file_path) AS t FROM scan_findings)
SELECT id, CASE WHEN engine = 'secret-scan' THEN 'Secret scan' WHEN engine = 'trivy' THEN 'Dependency scan'
  WHEN contains(t, 'dependency') THEN 'Dependency scan' WHEN regexp_matches(t, 'secret|password|token|api key|credential') THEN 'Secret scan'
  WHEN regexp_matches(lower(file_path), '(\\.properties|\\.xml|\\.yml|\\.yaml|dockerfile|\\.ini|\\.conf)$') THEN 'Config scan'
  WHEN regexp_matches(t, 'config|cors|debug|docker|ci/cd') THEN 'Config scan' ELSE 'SAST source code' END AS category FROM b""")
def f1(v: Views) -> DataFrame:
    c = F.col
    return v.scan_findings.select("id", sc.scan_category(c("engine"), c("title"), c("vuln_type"), c("file_path")).alias("category"))


@query("f2_f3_source_sink", """WITH b AS (SELECT *, lower(title || ' ' || vuln_type || ' ' || code_snippet) AS t FROM scan_findings)
SELECT id, CASE WHEN source <> '' THEN source WHEN contains(t, 'request.getparameter') OR contains(t, 'getparameter(') THEN 'HTTP request parameter'
  WHEN contains(t, 'getheader(') THEN 'HTTP request header' WHEN contains(t, 'request.args') THEN 'HTTP query parameter'
  WHEN contains(t, 'request.form') THEN 'HTTP form body' WHEN contains(t, 'req.query') THEN 'HTTP query parameter'
  WHEN contains(t, 'req.body') THEN 'HTTP request body' WHEN contains(t, 'input(') OR contains(t, 'scanner.next') THEN 'stdin/user input'
  WHEN contains(t, 'user_url') OR contains(t, 'target_url') THEN 'user-controlled URL' WHEN contains(t, 'url') THEN 'URL variable' ELSE '' END AS source,
  CASE WHEN sink <> '' THEN sink WHEN contains(t, 'executequery') THEN 'SQL executeQuery' WHEN contains(t, 'executeupdate') THEN 'SQL executeUpdate'
  WHEN contains(t, 'cursor.execute') THEN 'SQL execute' WHEN contains(t, 'select') THEN 'SQL string construction'
  WHEN regexp_matches(t, 'runtime\\.getruntime\\(\\)\\.exec|processbuilder|os\\.system|subprocess') THEN 'OS command execution'
  WHEN contains(t, 'eval(') THEN 'dynamic code execution' WHEN contains(t, 'innerhtml') THEN 'DOM HTML injection sink'
  WHEN contains(t, 'requests.get') THEN 'server-side HTTP request' WHEN contains(t, 'fetch(') THEN 'HTTP request sink' ELSE '' END AS sink FROM b""")
def f2_f3(v: Views) -> DataFrame:
    c = F.col
    text = sc.blob(c("title"), c("vuln_type"), c("code_snippet"))
    return v.scan_findings.select("id", sc.source_label(c("source"), text).alias("source"), sc.sink_label(c("sink"), text).alias("sink"))


@query("f6_rule_id", """SELECT id, CASE WHEN status <> 'open' THEN rule_id ELSE CASE scan_category WHEN 'Secret scan' THEN 'secret' WHEN 'SAST source code' THEN 'sast'
  WHEN 'Dependency scan' THEN 'dep' WHEN 'Config scan' THEN 'config' ELSE 'rule' END || '.' || replace(lower(engine), ' ', '-') || '.' ||
  CASE WHEN cwe_id <> '' THEN lower(cwe_id) ELSE replace(lower(vuln_type), ' ', '-') END END AS rule FROM scan_findings""")
def f6(v: Views) -> DataFrame:
    c = F.col
    given = F.when(c("status") != "open", c("rule_id")).otherwise("")
    return v.scan_findings.select("id", sc.rule_id_or_default(given, c("scan_category"), c("engine"), c("cwe_id"), c("vuln_type")).alias("rule"))


@query("f7_fingerprint", "SELECT id, substr(sha256(rule_id || ':' || file_path || ':' || line_start), 1, 16) AS fingerprint FROM scan_findings")
def f7(v: Views) -> DataFrame:
    from riskweave.schemas import fingerprint
    return v.scan_findings.select("id", fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line_start")).alias("fingerprint"))


@query("f8_f9_f10_normalisers", """WITH r AS (SELECT id, CASE severity WHEN 'Critical' THEN 'ERROR' WHEN 'High' THEN 'warning' WHEN 'Medium' THEN 'INFO' WHEN 'Low' THEN 'low' ELSE 'bogus' END AS raw,
  CASE line_number % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'Low' ELSE '' END AS conf FROM scan_findings),
n AS (SELECT *, CASE raw WHEN 'ERROR' THEN 'High' WHEN 'warning' THEN 'Medium' WHEN 'INFO' THEN 'Low' WHEN 'low' THEN 'Low' ELSE 'Medium' END AS semgrep,
  CASE raw WHEN 'low' THEN 'Low' ELSE 'Medium' END AS bandit FROM r)
SELECT id, semgrep, bandit, CAST(CASE WHEN semgrep = 'High' THEN 7.5 ELSE 5.0 END AS DOUBLE) AS semgrep_cvss,
  CAST(CASE WHEN bandit = 'Medium' THEN 5.4 ELSE 3.1 END AS DOUBLE) AS bandit_cvss,
  CAST(CASE conf WHEN 'high' THEN 0.9 WHEN 'MEDIUM' THEN 0.75 WHEN 'Low' THEN 0.55 ELSE 0.8 END AS DOUBLE) AS confidence FROM n""")
def f8(v: Views) -> DataFrame:
    raw = sc.lookup(F.col("severity"), {"Critical": "ERROR", "High": "warning", "Medium": "INFO", "Low": "low"}, "bogus")
    conf = F.element_at(F.array(*[F.lit(x) for x in ("high", "MEDIUM", "Low", "")]), F.col("line_number") % 4 + 1)
    named = v.scan_findings.select("id", sc.semgrep_severity(raw).alias("semgrep"), sc.bandit_severity(raw).alias("bandit"), conf.alias("c"))
    return named.select("id", "semgrep", "bandit", sc.cvss_for("semgrep", F.col("semgrep")).alias("semgrep_cvss"),
                        sc.cvss_for("bandit", F.col("bandit")).alias("bandit_cvss"), sc.semgrep_confidence(F.col("c")).alias("confidence"))


@query("f12_calibrate", """WITH b AS (SELECT *, regexp_matches(lower(title || ' ' || vuln_type || ' ' || code_snippet || ' ' || source || ' ' || sink),
    'injection|sql|command|xss|ssrf') AS inj, source <> '' AS so, sink <> '' AS si,
    regexp_matches(CASE WHEN evidence <> '' THEN evidence ELSE code_snippet END, '(?i)(akia|sk-|gsk_|ghp_|token|password|secret|private key)') AS known FROM scan_findings),
k AS (SELECT *, CASE WHEN inj AND so AND si AND confidence >= 0.82 THEN 1 WHEN inj AND so AND si THEN 2 WHEN inj AND si THEN 3 WHEN inj THEN 4
    WHEN scan_category = 'Secret scan' AND NOT known THEN 5
    WHEN scan_category = 'Dependency scan' AND NOT contains(title || ' ' || poc, 'CVE-') AND severity IN ('Critical', 'High') THEN 6 ELSE 0 END AS k FROM b)
SELECT id, CASE k WHEN 1 THEN 'Critical' WHEN 2 THEN 'High' WHEN 3 THEN 'Medium' WHEN 4 THEN 'Low' WHEN 5 THEN 'Medium' WHEN 6 THEN 'Medium' ELSE severity END AS severity,
  CAST(CASE k WHEN 1 THEN greatest(cvss4_score, 9.0) WHEN 2 THEN least(greatest(cvss4_score, 7.0), 8.9) WHEN 3 THEN least(greatest(cvss4_score, 5.0), 6.9)
    WHEN 4 THEN least(cvss4_score, 3.9) WHEN 5 THEN least(cvss4_score, 6.9) ELSE cvss4_score END AS DOUBLE) AS cvss,
  CAST(CASE k WHEN 3 THEN least(confidence, 0.72) WHEN 4 THEN least(confidence, 0.55) ELSE confidence END AS DOUBLE) AS confidence FROM k""")
def f12(v: Views) -> DataFrame:
    names = ["severity", "cvss4_score", "confidence", "scan_category", "title", "vuln_type", "code_snippet", "source", "sink", "evidence", "poc"]
    return v.scan_findings.select("id", sc.calibrate(*[F.col(n) for n in names]).alias("c")).select("id", "c.*")


@query("f13_f14_snippet_explanation", """WITH c AS (SELECT *, CASE WHEN line_number % 2 = 0 THEN '' ELSE '  ctx ' || file_path || chr(10) || ' end ' END AS ctx FROM scan_findings),
w AS (SELECT *, CASE WHEN ctx <> '' AND code_snippet <> '' THEN trim(ctx) ELSE code_snippet END AS snip FROM c)
SELECT id, snip AS snippet, CASE WHEN evidence <> '' THEN evidence ELSE snip END AS evidence,
  CASE WHEN why_vulnerable <> '' THEN why_vulnerable ELSE scan_category || ' finding from ' || engine || '. Source: ' || coalesce(nullif(source, ''), 'not proven')
  || '; sink: ' || coalesce(nullif(sink, ''), 'not proven') || '. ' || attack_scenario END AS why FROM w""")
def f13(v: Views) -> DataFrame:
    c = F.col
    ctx = F.when(c("line_number") % 2 == 0, "").otherwise(F.concat(F.lit("  ctx "), c("file_path"), F.lit("\n end ")))
    wide = v.scan_findings.withColumn("snip", tx.widened_snippet(c("code_snippet"), ctx))
    return wide.select("id", c("snip").alias("snippet"), tx.default_evidence(c("evidence"), c("snip")).alias("evidence"),
                       tx.default_explanation(c("why_vulnerable"), c("scan_category"), c("engine"), c("source"), c("sink"),
                                              c("attack_scenario")).alias("why"))


@query("f15_code_link", """SELECT f.id, CASE WHEN s.source_type = 'repo_url' THEN replace(s.source_value, '.git', '') || '/blob/main/' || file_path || '#L' || line_start ||
  CASE WHEN line_end > line_start THEN '-L' || line_end ELSE '' END ELSE '/dashboard/scans/snippet?file=' || file_path || '&line=' || line_start END AS link,
  CASE WHEN s.source_type = 'repo_url' THEN replace(s.source_value, '.git', '') || '/blob/main%20branch/' || file_path || '#L' || line_start ||
  CASE WHEN line_end > line_start THEN '-L' || line_end ELSE '' END END AS browse FROM scan_findings f JOIN scans s ON f.scan_id = s.scan_id""")
def f15(v: Views) -> DataFrame:
    c = F.col
    rows = v.scan_findings.join(v.scans.select("scan_id", "source_type", "source_value"), "scan_id")
    return rows.select("id", tx.code_link(c("source_type"), c("source_value"), c("file_path"), c("line_start"), c("line_end")).alias("link"),
                       tx.browse_link(F.lit(""), F.lit(""), c("source_type"), c("source_value"), F.lit("main branch"), c("file_path"),
                                      c("line_start"), c("line_end"), c("line_number")).alias("browse"))


@query("f19_sarif_level", """SELECT id, CASE severity WHEN 'Critical' THEN 'error' WHEN 'High' THEN 'error' WHEN 'Medium' THEN 'warning' ELSE 'note' END AS service,
  CASE severity WHEN 'Critical' THEN 'error' WHEN 'High' THEN 'error' WHEN 'Medium' THEN 'warning' ELSE 'note' END AS dashboard FROM scan_findings""")
def f19(v: Views) -> DataFrame:
    return v.scan_findings.select("id", sc.sarif_level(F.col("severity")).alias("service"),
                                  sc.sarif_level(F.upper("severity"), "dashboard").alias("dashboard"))


@query("f20_rule_help", r"""SELECT id, CASE WHEN "references" <> '' THEN trim(split_part("references", chr(10), 1)) WHEN cwe_id <> '' THEN
  'https://cwe.mitre.org/data/definitions/' || replace(cwe_id, 'CWE-', '') || '.html' ELSE '' END AS help_uri,
  CASE title WHEN 'Potential injection sink' THEN 'PotentialInjectionSink' WHEN 'DOM XSS sink' THEN 'DomXssSink' WHEN 'SSRF sink with user url'
  THEN 'SsrfSinkWithUserUrl' WHEN 'Hardcoded API key' THEN 'HardcodedApiKey' ELSE 'DebugModeEnabled' END AS name FROM scan_findings""")
def f20(v: Views) -> DataFrame:
    return v.scan_findings.select("id", tx.help_uri(F.col("references"), F.col("cwe_id")).alias("help_uri"),
                                  tx.rule_name(F.col("title"), F.col("rule_id")).alias("name"))


@query("f21_related_locations", """SELECT id, CASE WHEN contains(dataflow_trace, 'message') THEN '0:in:a.py:3;1:out:' || file_path || ':' || line_start ELSE '' END AS steps FROM scan_findings""")
def f21(v: Views) -> DataFrame:
    steps = tx.related_locations(F.col("dataflow_trace"), F.col("file_path"), F.col("line_start"))
    shown = F.array_join(F.transform(steps, lambda s: F.concat_ws(":", s["id"].cast("string"), s["message"], s["uri"], s["line"].cast("string"))), ";")
    return v.scan_findings.select("id", shown.alias("steps"))


@query("f22_f23_rank_bands", f"""SELECT id, {_RANK} AS rank, 4 - ({_RANK}) AS list_order,
  CASE WHEN cvss4_score * 10 >= 85 THEN 'Critical' WHEN cvss4_score * 10 >= 70 THEN 'High' WHEN cvss4_score * 10 >= 40 THEN 'Medium' ELSE 'Low' END AS band,
  CASE WHEN cvss4_score * 10 >= 80 THEN 'Critical Risk' WHEN cvss4_score * 10 >= 60 THEN 'High Risk' WHEN cvss4_score * 10 >= 30 THEN 'Medium Risk' ELSE 'Low Risk' END AS gauge
  FROM scan_findings""")
def f22(v: Views) -> DataFrame:
    score = F.col("cvss4_score") * 10
    return v.scan_findings.select("id", sc.severity_rank(F.col("severity")).alias("rank"), sc.severity_list_order(F.col("severity")).alias("list_order"),
                                  sc.risk_band(score).alias("band"), sc.gauge_band(score).alias("gauge"))


@query("f28_pentest_guidance", """WITH b AS (SELECT *, lower(vuln_type || ' ' || title || ' ' || cwe_id || ' ' || owasp_category) AS t FROM scan_findings)
SELECT id, CASE WHEN trim(pentest_hint) <> '' THEN 'own' WHEN contains(t, 'sql') THEN 'sql' WHEN contains(t, 'xss') OR contains(t, 'cross-site') THEN 'xss'
  WHEN contains(t, 'ssrf') THEN 'ssrf' WHEN contains(t, 'secret') OR contains(t, 'credential') THEN 'secret' ELSE 'default' END AS guidance FROM b""")
def f28(v: Views) -> DataFrame:
    names = ["pentest_hint", "vuln_type", "title", "cwe_id", "owasp_category"]
    return v.scan_findings.select("id", tx.guidance_key(*[F.col(n) for n in names]).alias("guidance"))


@query("f30_f31_links_lines", """SELECT id, CASE "references" WHEN '' THEN '' WHEN 'https://a.example/x' THEN 'a.example/x' ELSE 'a.example/x|b.example/y|c.example/z' END AS links,
  'L' || line_start || CASE WHEN line_end <> line_start THEN '-' || line_end ELSE '' END AS lines FROM scan_findings""")
def f30(v: Views) -> DataFrame:
    c = F.col
    return v.scan_findings.select("id", F.array_join(tx.reference_links(c("references")), "|").alias("links"),
                                  tx.line_range(c("line_start"), c("line_end"), c("line_number")).alias("lines"))


@query("f34_review_prompt", """SELECT id, 'Rule: ' || rule_id || chr(10) || 'Title: ' || title || chr(10) || 'CWE: ' || cwe_id || '  OWASP: ' || owasp_category || chr(10) ||
  'Severity: ' || severity || '  Confidence: ' || printf('%.2f', confidence) || chr(10) || 'File: ' || file_path || '  Lines: ' || line_start || '-' || line_end || chr(10) ||
  'Source: ' || coalesce(nullif(source, ''), 'unknown') || '  →  Sink: ' || coalesce(nullif(sink, ''), 'unknown') || chr(10) || chr(10) || 'Code snippet:' || chr(10) || '```' || chr(10) ||
  coalesce(nullif(code_snippet, ''), evidence) || chr(10) || '```' || chr(10) || chr(10) || 'Evidence (redacted): ' || coalesce(nullif(evidence, ''), 'n/a') AS prompt FROM scan_findings""")
def f34(v: Views) -> DataFrame:
    return v.scan_findings.select("id", tx.reviewer_prompt(F.col).alias("prompt"))


# --- correlation and policy ---------------------------------------------------
@query("j11_attack_chains", """WITH g AS (SELECT scan_id, bool_or(vuln_type IN ('Hardcoded Secret', 'Cryptographic Failures') OR contains(lower(title), 'api key')) AS leak,
  min(CASE WHEN contains(lower(vuln_type), 'ssrf') OR contains(owasp_category, 'A10') THEN seq END) AS at FROM scan_findings GROUP BY scan_id)
SELECT f.scan_id, 'Attack Chain' AS vuln_type, 'Critical' AS severity, CAST(9.7 AS DOUBLE) AS cvss4_score, f.file_path, f.line_start, f.code_snippet,
  'cwe-918' AS rule_id, substr(sha256('cwe-918:' || f.file_path || ':' || f.line_start), 1, 16) AS dedupe_hash
FROM g JOIN scan_findings f ON g.scan_id = f.scan_id AND g.at = f.seq WHERE leak""")
def j11(v: Views) -> DataFrame:
    return en.attack_chains(v.scan_findings).select(
        "scan_id", "vuln_type", "severity", "cvss4_score", "file_path", "line_start", "code_snippet", "rule_id", "dedupe_hash")


_POLICY = """p AS (SELECT project_id, enabled_engines AS e, coalesce(severity_threshold, 'Info') AS th, rule_overrides AS o FROM scanner_policies)"""
_ENGINE = "CASE engine WHEN 'eslint-security' THEN 'eslint' WHEN 'owasp-patterns' THEN 'owasp' WHEN 'secret-scan' THEN 'secrets' ELSE engine END"


@query("p8_engine_policy", f"""WITH {_POLICY} SELECT f.id FROM findings f LEFT JOIN p ON f.project_id = p.project_id
  WHERE e IS NULL OR e IN ('[]', 'not json') OR contains(e, '"' || {_ENGINE} || '"')""")
def p8(v: Views) -> DataFrame:
    return en.keep_enabled_engines(en.with_policy(v.findings, v.scanner_policies)).select("id")


@query("p7_severity_threshold", f"""WITH {_POLICY} SELECT f.id, severity FROM findings f LEFT JOIN p ON f.project_id = p.project_id
  WHERE {_RANK} >= CASE th WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END""")
def p7(v: Views) -> DataFrame:
    ruled = en.with_policy(v.findings, v.scanner_policies)
    return en.at_least(ruled, F.col("policy_threshold")).select("id", "severity")


@query("p8_rule_overrides", f"""WITH {_POLICY} SELECT f.id FROM findings f LEFT JOIN p ON f.project_id = p.project_id
  WHERE NOT (coalesce(o, '') LIKE '%enabled%' AND rule_id = 'rule-1')""")
def p8_overrides(v: Views) -> DataFrame:
    return en.apply_rule_overrides(en.with_policy(v.findings, v.scanner_policies)).select("id")


# --- history --------------------------------------------------------------
@query("j1_carry_forward", """WITH s AS (SELECT project_id, dedupe_hash, scan_id, max(created_at || '|' || id) AS k FROM findings GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY project_id, dedupe_hash ORDER BY k DESC) AS r FROM s),
p AS (SELECT f.id, max(n.k) AS k FROM findings f JOIN n ON f.project_id = n.project_id AND f.dedupe_hash = n.dedupe_hash AND n.scan_id <> f.scan_id AND n.r <= 2 GROUP BY f.id),
o AS (SELECT p.id, h.status, h.assignee_id, h.verification_status FROM p JOIN findings h ON h.created_at || '|' || h.id = p.k)
SELECT f.id, CASE WHEN o.status = 'fixed' THEN 'reopened' WHEN o.status IN ('false_positive', 'accepted_risk', 'ignored', 'in_progress', 'confirmed') THEN o.status ELSE 'open' END AS status,
  o.assignee_id, CASE WHEN o.id IS NOT NULL THEN o.verification_status ELSE f.verification_status END AS verification_status
FROM findings f LEFT JOIN o ON f.id = o.id""")
def j1(v: Views) -> DataFrame:
    return hi.carry_forward(v.project_findings, v.project_findings).select("id", "status", "assignee_id", "verification_status")


@query("j2_previous_false_positive", """SELECT id, EXISTS (SELECT 1 FROM findings o WHERE o.project_id = f.project_id AND o.dedupe_hash = f.dedupe_hash
  AND o.status = 'false_positive' AND o.scan_id <> f.scan_id) AS previously_false_positive FROM findings f""")
def j2(v: Views) -> DataFrame:
    return hi.flag_previous_false_positives(v.findings, v.findings).select("id", "previously_false_positive")


_LATEST = """l AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, scan_id DESC) AS r FROM scans)"""


@query("w1_latest_previous", f"""WITH {_LATEST} SELECT project_id, max(CASE WHEN r = 1 THEN scan_id END) AS current_id,
  coalesce(max(CASE WHEN r = 2 THEN scan_id END), -1) AS base_id FROM l WHERE r <= 2 GROUP BY project_id""")
def w1(v: Views) -> DataFrame:
    return an.scan_pairs(v.scans).withColumn("base_id", F.coalesce("base_id", F.lit(-1)))


@query("w2_risk_trend", f"""WITH {_LATEST} SELECT project_id, string_agg(CAST(CAST(floor(risk_percent + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY r DESC) AS trend
  FROM l WHERE r <= 5 GROUP BY project_id""")
def w2(v: Views) -> DataFrame:
    return an.risk_trend(v.scans).withColumn("trend", F.array_join(F.transform("trend", lambda x: x.cast("string")), ","))


@query("u1_compare_scans", f"""WITH {_LATEST}, p AS (SELECT project_id, max(CASE WHEN r = 1 THEN scan_id END) AS c, max(CASE WHEN r = 2 THEN scan_id END) AS b FROM l GROUP BY project_id),
k AS (SELECT DISTINCT scan_id, vuln_type, file_path, line_start FROM scan_findings),
n AS (SELECT c, b, vuln_type, file_path, line_start FROM k JOIN p ON k.scan_id = p.c), o AS (SELECT c, b, vuln_type, file_path, line_start FROM k JOIN p ON k.scan_id = p.b),
i AS (SELECT c, b, count(*) AS x FROM (SELECT * FROM n EXCEPT SELECT * FROM o) GROUP BY ALL), f AS (SELECT c, b, count(*) AS x FROM (SELECT * FROM o EXCEPT SELECT * FROM n) GROUP BY ALL)
SELECT p.c AS current_id, p.b AS base_id, coalesce(i.x, 0) AS introduced_count, coalesce(f.x, 0) AS fixed_count, s.risk_percent - t.risk_percent AS risk_delta
FROM p JOIN scans s ON s.scan_id = p.c JOIN scans t ON t.scan_id = p.b LEFT JOIN i ON i.c = p.c AND i.b = p.b LEFT JOIN f ON f.c = p.c AND f.b = p.b""")
def u1(v: Views) -> DataFrame:
    pairs = an.scan_pairs(v.scans).filter("base_id is not null")
    return an.compare_scans(v.scan_findings, v.scans, pairs)


@query("u2_project_changes", f"""WITH {_LATEST}, k AS (SELECT DISTINCT l.project_id, l.r, f.dedupe_hash AS h FROM scan_findings f JOIN l ON f.scan_id = l.scan_id WHERE l.r <= 2),
g AS (SELECT project_id, h, bool_or(r = 1) AS n, bool_or(r = 2) AS o FROM k GROUP BY ALL)
SELECT p.project_id, count(*) FILTER (n AND NOT o) AS new_findings, count(*) FILTER (o AND NOT n) AS fixed_findings, count(*) FILTER (n AND o) AS unchanged_findings
FROM (SELECT DISTINCT project_id FROM scans) p LEFT JOIN g ON p.project_id = g.project_id GROUP BY p.project_id""")
def u2(v: Views) -> DataFrame:
    return an.project_changes(v.scan_findings, v.scans)


@query("p6_unresolved_high", f"""WITH {_LATEST} SELECT l.project_id, count(*) FILTER (severity IN ('Critical', 'High') AND f.status NOT IN ('fixed', 'false_positive', 'ignored')) AS unresolved
  FROM scan_findings f JOIN l ON f.scan_id = l.scan_id WHERE r = 1 GROUP BY l.project_id""")
def p6(v: Views) -> DataFrame:
    newest = an.latest_scans(v.scans, 1).select("scan_id", "project_id")
    per_scan = an.unresolved_high(v.scan_findings, ["scan_id"])
    return per_scan.join(newest, "scan_id").select("project_id", "unresolved")


# --- filters, pages ---------------------------------------------------------
@query("p2_findings_filter", "SELECT id, scan_id, severity FROM scan_findings WHERE lower(severity) = 'high' AND status = 'open' AND engine = 'trivy'")
def p2(v: Views) -> DataFrame:
    return an.filter_findings(v.scan_findings, severity="HIGH", status="open", engine="trivy").select("id", "scan_id", "severity")


@query("p3_triage_filter", """SELECT id, file_path FROM findings f WHERE severity = 'Medium' AND (file_path LIKE '%.ts' OR file_path LIKE '%.tsx')
  AND NOT EXISTS (SELECT 1 FROM findings o WHERE o.project_id = f.project_id AND o.dedupe_hash = f.dedupe_hash AND o.status = 'false_positive' AND o.scan_id <> f.scan_id)""")
def p3(v: Views) -> DataFrame:
    flagged = hi.flag_previous_false_positives(v.findings, v.findings)
    return an.triage_filter(flagged, severity="medium", language="TypeScript", hide_previous_fp=True).select("id", "file_path")


@query("p4_text_search", """SELECT id, title FROM scan_findings WHERE severity = 'Low' AND contains(lower(concat_ws(' ', nullif(title, ''), nullif(rule_id, ''), nullif(engine, ''),
  nullif(scan_category, ''), nullif(vuln_type, ''), nullif(file_path, ''), nullif(source, ''), nullif(sink, ''), nullif(cwe_id, ''), nullif(owasp_category, ''),
  nullif(attack_scenario, ''), nullif(impact, ''), nullif(remediation, ''))), 'form body cwe-79')""")
def p4(v: Views) -> DataFrame:
    return an.search_findings(v.scan_findings, query="Form Body CWE-79", severity="Low").select("id", "title")


@query("p5_active_findings", "SELECT id, status FROM scan_findings WHERE status NOT IN ('false_positive', 'fixed')")
def p5(v: Views) -> DataFrame:
    return v.scan_findings.filter(an.is_active(F.col("status"))).select("id", "status")


@query("p16_api_projection", """SELECT id, engine, rule_id AS ruleId, scan_category AS scanCategory, title, vuln_type AS vulnType, severity, cvss4_score AS cvss4, confidence, cwe_id AS cweId,
  owasp_category AS owaspCategory, file_path AS filePath, line_number AS lineNumber, CASE WHEN line_start <> 0 THEN line_start ELSE line_number END AS lineStart,
  CASE WHEN line_end <> 0 THEN line_end ELSE line_number END AS lineEnd, source, sink, function_name AS functionName, dataflow_trace AS dataflowTrace, evidence, code_snippet AS codeSnippet,
  why_vulnerable AS whyVulnerable, attack_scenario AS attackScenario, impact, poc, remediation, secure_example AS secureExample, pentest_hint AS pentestHint, "references",
  verification_status AS verificationStatus, dedupe_hash AS dedupeHash FROM scan_findings""")
def p16(v: Views) -> DataFrame:
    return an.api_projection(v.scan_findings)


@query("o1_page_per_scan", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {_RANK} DESC, cvss4_score DESC, created_at, id) AS position,
  count(*) OVER (PARTITION BY scan_id) AS total FROM scan_findings)
SELECT id, scan_id, CAST(position AS INT) AS position, 2 AS page, total, CAST(ceil(total / 3) AS BIGINT) AS total_pages FROM r WHERE position BETWEEN 4 AND 6""")
def o1(v: Views) -> DataFrame:
    return an.page_per_scope(v.scan_findings, "scan_id", an.severity_order(), 2, 3).select("id", "scan_id", "position", "page", "total", "total_pages")


@query("o1_page_global", f"""SELECT id, severity, 3 AS page, (SELECT count(*) FROM scan_findings) AS total, CAST(ceil((SELECT count(*) FROM scan_findings) / 500) AS BIGINT) AS total_pages
  FROM scan_findings ORDER BY {_RANK} DESC, cvss4_score DESC, created_at, id LIMIT 500 OFFSET 1000""")
def o1_global(v: Views) -> DataFrame:
    return an.page(v.scan_findings, an.severity_order(), 3, 500).select("id", "severity", "page", "total", "total_pages")


@query("o1_deep_page_per_severity", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY cvss4_score DESC, created_at, id) AS position, count(*) OVER (PARTITION BY severity) AS total FROM scan_findings)
SELECT id, severity, position, 4000 AS page, total, CAST(ceil(total / 3) AS BIGINT) AS total_pages FROM r WHERE position BETWEEN 11998 AND 12000""")
def o1_deep(v: Views) -> DataFrame:
    order = [F.desc("cvss4_score"), F.asc("created_at"), F.asc("id")]
    return an.page_per_scope(v.scan_findings.select("id", "severity", "cvss4_score", "created_at"), "severity", order, 4000, 3).select("id", "severity", "position", "page", "total", "total_pages")


@query("o1_deep_page_global", f"""SELECT id, severity, 501 AS page, (SELECT count(*) FROM scan_findings) AS total, CAST(ceil((SELECT count(*) FROM scan_findings) / 100) AS BIGINT) AS total_pages
  FROM scan_findings ORDER BY {_RANK} DESC, cvss4_score DESC, created_at, id LIMIT 100 OFFSET 50000""")
def o1_deep_global(v: Views) -> DataFrame:
    return an.page(v.scan_findings.select("id", "severity", "cvss4_score", "created_at"), an.severity_order(), 501, 100).select("id", "severity", "page", "total", "total_pages")


@query("o2_severity_order", f"""SELECT id, scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY {_RANK} DESC, cvss4_score DESC, created_at, id) AS INT) AS position FROM scan_findings""")
def o2(v: Views) -> DataFrame:
    return an.list_positions(v.scan_findings)


@query("o3_sort_modes", f"""(SELECT 'risk' AS mode, id FROM scan_findings ORDER BY {_RANK} DESC, cvss4_score DESC, id LIMIT 50) UNION ALL (SELECT 'confidence' AS mode, id FROM scan_findings ORDER BY confidence DESC, id LIMIT 50) UNION ALL
  (SELECT 'file' AS mode, id FROM scan_findings ORDER BY file_path, id LIMIT 50)""")
def o3(v: Views) -> DataFrame:
    top = lambda m: v.scan_findings.orderBy(*an.sort_mode(m)).limit(50).select(F.lit(m).alias("mode"), "id")
    return top("risk").unionByName(top("confidence")).unionByName(top("file"))
