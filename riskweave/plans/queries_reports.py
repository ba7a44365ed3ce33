"""Queries that emit reports as lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from riskweave.operators import access as ac
from riskweave.plans.queries_corpus import mask_sql
from riskweave.plans.registry import query
from riskweave.session import checkpoint_root
from riskweave.sources import reports as rp, sinks, tables
from riskweave.views import Views

_WHEN = "2024-01-01T00:00:00"


def _scans(v: Views) -> DataFrame:
    return v.scans.select("scan_id", "project_id", "status", "risk_level", "risk_percent", "source_type", "source_value")


_FIRST = "x AS (SELECT *, seq = min(seq) OVER (PARTITION BY scan_id) AS is_first FROM scan_findings)"


def _object(fields: list[tuple[str, str]]) -> str:
    """SQL text of a JSON object from (key, expression) pairs; texts are escaped by to_json."""
    return " || ',' || ".join(f"'\"{k}\":' || to_json({e})" for k, e in fields)


_SERVICE_A = _object([
    ("id", "id"), ("engine", "engine"), ("ruleId", "rule_id"), ("scanCategory", "scan_category"), ("title", "title"), ("vulnType", "vuln_type"),
    ("owasp", "owasp_category"), ("cwe", "cwe_id"), ("severity", "severity"), ("cvss4", "cvss4_score"), ("confidence", "confidence"),
    ("verificationStatus", "verification_status"), ("dedupeHash", "dedupe_hash"), ("file", "file_path"),
    ("lineStart", "line_start"), ("lineEnd", "line_end"), ("source", "source"), ("sink", "sink"), ("functionName", "function_name")])
_SERVICE_B = _object([
    ("evidence", "evidence"), ("codeSnippet", "code_snippet"), ("impact", "impact"), ("whyVulnerable", "why_vulnerable"), ("attackScenario", "attack_scenario"),
    ("poc", "poc"), ("remediation", "remediation"), ("secureExample", "secure_example"), ("pentestHint", "pentest_hint"), ("references", '"references"')])


@query("s10_service_json", f"""WITH {_FIRST} SELECT scan_id, 0 AS section, '' AS place, '{{"scanId":"' || scan_id || '","status":"' || status || '","riskLevel":"' || risk_level ||
  '","riskPercent":' || to_json(risk_percent) || ',"generatedAt":"{_WHEN}","findings":[' AS line FROM scans
UNION ALL SELECT scan_id, 1, seq, CASE WHEN is_first THEN '' ELSE ',' END || '{{' || {_SERVICE_A} || ',"dataflowTrace":' || CASE WHEN dataflow_trace IN ('', 'not json') THEN '[]' ELSE dataflow_trace END || ',' || {_SERVICE_B} || '}}' FROM x
UNION ALL SELECT scan_id, 2, '', ']}}' FROM scans""")
def s10(v: Views) -> DataFrame:
    return rp.service_json(_scans(v), v.finding_rows, _WHEN, texts=v.finding_texts).withColumnRenamed("at", "place")


_MASKED = ("x AS (SELECT * REPLACE (" + ", ".join(f"{mask_sql(c)} AS {c}" for c in ("code_snippet", "evidence", "poc")) + "), seq = min(seq) OVER (PARTITION BY scan_id) AS is_first FROM scan_findings)")
_LEVELS = ["Critical", "High", "Medium", "Low", "Info"]
_STATES = ["open", "confirmed", "false_positive", "fixed", "accepted_risk"]


def _ranked(key: str, label: str, limit: str) -> str:
    """SQL of the list of a scan's counts by a key, most frequent first."""
    return (f"SELECT scan_id, '[' || string_agg('{{\"{label}\":' || to_json(k) || ',\"count\":' || n || '}}', ',' ORDER BY n DESC, k) || ']' AS l FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, k) AS r "
            f"FROM (SELECT scan_id, {key} AS k, count(*) AS n FROM scan_findings GROUP BY ALL)) WHERE {limit} GROUP BY scan_id")


_EXECUTIVE_HEAD = f"""h AS (SELECT s.*, coalesce(total, 0) AS total, {", ".join(f"coalesce({x.lower()}, 0) AS {x.lower()}" for x in _LEVELS + _STATES)},
  coalesce(a.l, '[]') AS files, coalesce(b.l, '[]') AS engines, coalesce(d.l, '[]') AS owasps FROM scans s
  LEFT JOIN (SELECT scan_id, count(*) AS total, {", ".join(f"count(*) FILTER (severity = '{x}') AS {x.lower()}" for x in _LEVELS)}, {", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in _STATES)} FROM scan_findings GROUP BY scan_id) c ON s.scan_id = c.scan_id
  LEFT JOIN ({_ranked("file_path", "filePath", "r <= 10")}) a ON s.scan_id = a.scan_id LEFT JOIN ({_ranked("engine", "engine", "true")}) b ON s.scan_id = b.scan_id
  LEFT JOIN ({_ranked("CASE WHEN owasp_category = '' THEN 'Unmapped' ELSE owasp_category END", "category", "true")}) d ON s.scan_id = d.scan_id)"""
_EXECUTIVE_BODY = _object([
    ("id", "id"), ("ruleId", "rule_id"), ("scanCategory", "scan_category"), ("engine", "engine"), ("title", "title"), ("vulnType", "vuln_type"), ("severity", "severity"),
    ("cvss4Score", "cvss4_score"), ("confidence", "confidence"), ("verificationStatus", "verification_status"), ("cweId", "cwe_id"), ("owaspCategory", "owasp_category"), ("filePath", "file_path"),
    ("lineNumber", "line_number"), ("lineStart", "line_start"), ("lineEnd", "line_end"), ("codeSnippet", "code_snippet"), ("evidence", "evidence"), ("poc", "poc"), ("remediation", "remediation"),
    ("source", "source"), ("sink", "sink"), ("status", "status"), ("dedupeHash", "dedupe_hash")])


@query("s11_executive_json", f"""WITH {_MASKED}, {_EXECUTIVE_HEAD}
SELECT scan_id, 0 AS section, '' AS place, '{{"scan":{{"id":"' || scan_id || '","status":"' || status || '","riskLevel":"' || risk_level || '","riskPercent":' || to_json(risk_percent) || ',"sourceType":' || to_json(source_type) || ',"sourceValue":' || to_json(source_value) ||
  '}},"executiveSummary":{{"riskLevel":"' || risk_level || '","riskScore":' || to_json(risk_percent) || ',"totalFindings":' || total || ',"topAffectedFiles":' || files || ',"byEngine":' || engines || ',"byOwaspCategory":' || owasps ||
  '}},"summary":{{"total":' || total || ',"riskScore":' || to_json(risk_percent) || {" || ".join(f"',\"{x.lower()}\":' || {x.lower()}" for x in _LEVELS + _STATES)} || ',"topAffectedFiles":' || files || ',"byEngine":' || engines || ',"byOwaspCategory":' || owasps ||
  '}},"generated_at":"{_WHEN}","scanner_version":"1.0.0","exported_by":"user-1","findings":[' AS line FROM h
UNION ALL SELECT scan_id, 1, seq, CASE WHEN is_first THEN '' ELSE ',' END || '{{' || {_EXECUTIVE_BODY} || '}}' FROM x
UNION ALL SELECT scan_id, 2, '', ']}}' FROM scans""")
def s11(v: Views) -> DataFrame:
    """Masked executive report of every scan."""
    return rp.executive_json(_scans(v), v.finding_rows, "user-1", _WHEN, texts=v.finding_texts).withColumnRenamed("at", "place")


@query("s11_report_summary", """WITH c AS (SELECT scan_id, count(*) AS total, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (status = 'open') AS open FROM scan_findings GROUP BY scan_id),
e AS (SELECT scan_id, string_agg(engine || '=' || n, ',' ORDER BY n DESC, engine) AS by_engine FROM (SELECT scan_id, engine, count(*) AS n FROM scan_findings GROUP BY ALL) GROUP BY scan_id),
f AS (SELECT scan_id, string_agg(file_path || '=' || n, ',' ORDER BY n DESC, file_path) AS by_file FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, file_path) AS r
  FROM (SELECT scan_id, file_path, count(*) AS n FROM scan_findings GROUP BY ALL)) WHERE r <= 10 GROUP BY scan_id)
SELECT s.scan_id, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(open, 0) AS open, coalesce(by_engine, '') AS by_engine, coalesce(by_file, '') AS by_file
FROM scans s LEFT JOIN c ON s.scan_id = c.scan_id LEFT JOIN e ON s.scan_id = e.scan_id LEFT JOIN f ON s.scan_id = f.scan_id""")
def s11_summary(v: Views) -> DataFrame:
    def shown(name, key):
        return F.array_join(F.transform(name, lambda x: F.concat(x[key], F.lit("="), x["count"].cast("string"))), ",").alias(name)
    return rp.report_summary(v.scan_findings, v.scans).select(
        "scan_id", "total", "critical", "high", "open", shown("by_engine", "engine"), shown("by_file", "filePath"))


@query("w6_rules_registry", """WITH f AS (SELECT scan_id, rule_id AS rule, min(seq) AS first_seq FROM scan_findings GROUP BY ALL)
SELECT f.scan_id, f.rule, CAST(row_number() OVER (PARTITION BY f.scan_id ORDER BY f.first_seq, f.rule) - 1 AS INT) AS rule_index, g.title, g.severity
FROM f JOIN scan_findings g ON g.scan_id = f.scan_id AND g.seq = f.first_seq""")
def w6(v: Views) -> DataFrame:
    return rp.rules_registry(v.finding_rows, v.finding_texts).select("scan_id", "rule", "rule_index", F.col("f.title").alias("title"), F.col("f.severity").alias("severity"))


_URI = """CASE WHEN "references" <> '' THEN trim(split_part("references", chr(10), 1)) WHEN cwe_id <> '' THEN 'https://cwe.mitre.org/data/definitions/' || replace(cwe_id, 'CWE-', '') || '.html' ELSE '' END"""
_PASCAL = "array_to_string(list_transform(list_slice(string_split(title, ' '), 1, 6), lambda w: upper(w[1:1]) || lower(w[2:])), '')"
_SERVICE_RULE = f"""'{{"id":' || to_json(rule_id) || ',"name":' || to_json({_PASCAL}) || ',"shortDescription":{{"text":' || to_json(title) || '}},"fullDescription":{{"text":' || to_json(CASE WHEN why_vulnerable <> '' THEN why_vulnerable ELSE attack_scenario END) ||
  '}},"helpUri":' || to_json({_URI}) || ',"help":{{"text":' || to_json('Remediation: ' || remediation || chr(10) || chr(10) || 'Pentest hint: ' || CASE WHEN pentest_hint = '' THEN 'N/A' ELSE pentest_hint END || chr(10) || chr(10) || 'References: ' || CASE WHEN "references" = '' THEN {_URI} ELSE "references" END) ||
  '}},"properties":{{"tags":["security"],' || {_object([("cwe", "cwe_id"), ("owasp", "owasp_category"), ("scanCategory", "scan_category"), ("severity", "severity"), ("cvss4", "cvss4_score"), ("impact", "impact"), ("pentestHint", "pentest_hint")])} || '}}}}'"""
_PLACE = """'{"uri":' || to_json(file_path) || ',"uriBaseId":"%SRCROOT%"}'"""
_STEP = '{"id":0,"message":{"text":"in"},"physicalLocation":{"artifactLocation":{"uri":"a.py","uriBaseId":"%SRCROOT%"},"region":{"startLine":3}}},{"id":1,"message":{"text":"out"},"physicalLocation":{"artifactLocation":'
_SERVICE_RESULT = f"""'{{"ruleId":' || to_json(rule_id) || ',"ruleIndex":' || i || ',"level":"' || CASE severity WHEN 'Critical' THEN 'error' WHEN 'High' THEN 'error' WHEN 'Medium' THEN 'warning' ELSE 'note' END || '","message":{{"text":' ||
  to_json(title || '. Source: ' || CASE WHEN source = '' THEN 'unknown' ELSE source END || ' → Sink: ' || CASE WHEN sink = '' THEN 'unknown' ELSE sink END || '. Confidence: ' || format('{{:.2f}}', confidence) || '. VerificationStatus: ' || verification_status || '.') ||
  '}},"locations":[{{"physicalLocation":{{"artifactLocation":' || {_PLACE} || ',"region":{{"startLine":' || line_start || ',"endLine":' || greatest(line_end, line_start) || CASE WHEN evidence <> '' THEN ',"snippet":{{"text":' || to_json(evidence) || '}}' ELSE '' END ||
  '}}}}}}],"fingerprints":{{"dedupeHash/v1":' || to_json(dedupe_hash) || '}},"properties":{{' || {_object([("engine", "engine"), ("scanCategory", "scan_category"), ("confidence", "confidence"), ("verificationStatus", "verification_status"), ("cwe", "cwe_id"), ("owasp", "owasp_category"),
  ("cvss4", "cvss4_score"), ("impact", "impact"), ("remediation", "remediation"), ("pentestHint", "pentest_hint")])} || '}}' || CASE WHEN contains(dataflow_trace, 'message') THEN ',"relatedLocations":[{_STEP}' || {_PLACE} || ',"region":{{"startLine":' || line_start || '}}}}}}]' ELSE '' END || '}}'"""


@query("s12_service_sarif", f"""WITH {_FIRST}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq, rule_id) - 1 AS i FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, rule_id ORDER BY seq) AS nth FROM x) WHERE nth = 1),
y AS (SELECT x.*, r.i FROM x JOIN r ON x.scan_id = r.scan_id AND x.rule_id = r.rule_id)
SELECT scan_id, 0 AS section, '' AS place, '{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"riskweave","version":"1.0.0","informationUri":"https://example.org/riskweave","rules":[' AS line FROM scans
UNION ALL SELECT scan_id, 1, lpad(CAST(i AS VARCHAR), 10, '0'), CASE WHEN i = 0 THEN '' ELSE ',' END || {_SERVICE_RULE} FROM r
UNION ALL SELECT scan_id, 2, '', ']}}}},"results":[' FROM scans
UNION ALL SELECT scan_id, 3, seq, CASE WHEN is_first THEN '' ELSE ',' END || {_SERVICE_RESULT} FROM y
UNION ALL SELECT scan_id, 4, '', '],"artifacts":[' FROM scans
UNION ALL SELECT scan_id, 5, seq, CASE WHEN is_first THEN '' ELSE ',' END || '{{"location":' || {_PLACE} || '}}' FROM x
UNION ALL SELECT scan_id, 6, '', '],"properties":{{"scanId":"' || scan_id || '","riskLevel":"' || risk_level || '","riskPercent":' || to_json(risk_percent) || ',"generatedAt":"{_WHEN}"}}}}]}}' FROM scans""")
def s12(v: Views) -> DataFrame:
    """Nested documents with conditional keys."""
    return rp.service_sarif(_scans(v), v.finding_rows, _WHEN, texts=v.finding_texts).withColumnRenamed("at", "place")


@query("s12_sarif_results", """WITH f AS (SELECT scan_id, rule_id AS rule, row_number() OVER (PARTITION BY scan_id ORDER BY min(seq), rule_id) - 1 AS i FROM scan_findings GROUP BY scan_id, rule_id)
SELECT x.scan_id, x.seq AS place, x.rule_id AS rule, CAST(f.i AS INT) AS rule_index, CASE severity WHEN 'Critical' THEN 'error' WHEN 'High' THEN 'error' WHEN 'Medium' THEN 'warning' ELSE 'note' END AS level,
  line_start, greatest(line_end, line_start) AS line_end, dedupe_hash FROM scan_findings x JOIN f ON x.scan_id = f.scan_id AND x.rule_id = f.rule""")
def s12_results(v: Views) -> DataFrame:
    lines = rp.sarif_results(v.finding_rows, v.finding_texts)
    shape = ("struct<ruleId:string,ruleIndex:int,level:string,fingerprints:struct<`dedupeHash/v1`:string>,"
             "locations:array<struct<physicalLocation:struct<region:struct<startLine:int,endLine:int>>>>>")
    # opened as a row: fields asked of one from_json would each parse the line again
    doc = lines.select("scan_id", F.col("at").alias("place"), F.inline(F.array(F.from_json(F.regexp_replace("line", "^,", ""), shape))))
    region = F.col("locations")[0]["physicalLocation"]["region"]
    return doc.select("scan_id", "place", F.col("ruleId").alias("rule"), F.col("ruleIndex").alias("rule_index"), "level",
                      region["startLine"].alias("line_start"), region["endLine"].alias("line_end"), F.col("fingerprints")["dedupeHash/v1"].alias("dedupe_hash"))


_TOOL_URI = "https://example.org/riskweave"
_SEVERITY_TEXT = "CASE WHEN cvss4_score = floor(cvss4_score) THEN CAST(CAST(cvss4_score AS BIGINT) AS VARCHAR) ELSE CAST(cvss4_score AS VARCHAR) END"
_DASHBOARD_LEVEL = "CASE lower(severity) WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"
_DASHBOARD_RULE = f"""'{{"id":' || to_json(rule_id) || ',"name":' || to_json(title) || ',"shortDescription":{{"text":' || to_json(title) || '}},"fullDescription":{{"text":' || to_json(CASE WHEN why_vulnerable <> '' THEN why_vulnerable ELSE attack_scenario END) ||
  '}},"help":{{"text":' || to_json(remediation) || '}},"properties":{{"tags":' || to_json(list_filter([scan_category, engine, cwe_id, owasp_category], lambda t: t <> '')) || ',"precision":"' || CASE WHEN confidence > 0.8 THEN 'very-high' ELSE 'high' END || '","security-severity":"' || {_SEVERITY_TEXT} || '"}}}}'"""
_DASHBOARD_RESULT = f"""'{{"ruleId":' || to_json(rule_id) || ',"level":"' || {_DASHBOARD_LEVEL} || '","message":{{"text":' || to_json(title) || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(file_path) || '}},"region":{{"startLine":' || line_start || ',"endLine":' || line_end ||
  CASE WHEN code_snippet <> '' THEN ',"snippet":{{"text":' || to_json(code_snippet) || '}}' ELSE '' END || '}}}}}}]}}'"""


@query("s13_dashboard_sarif", f"""WITH {_MASKED}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, rule_id ORDER BY seq) AS nth FROM x) WHERE nth = 1)
SELECT scan_id, 0 AS section, '' AS place, '{{"version":"2.1.0","$schema":"https://docs.oasis-open.org/sarif/sarif/v2.1.0/os/schemas/sarif-schema-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"riskweave","informationUri":"{_TOOL_URI}","version":"1.0.0","rules":[' AS line FROM scans
UNION ALL SELECT scan_id, 1, seq, CASE WHEN is_first THEN '' ELSE ',' END || {_DASHBOARD_RULE} FROM r
UNION ALL SELECT scan_id, 2, '', ']}}}},"results":[' FROM scans
UNION ALL SELECT scan_id, 3, seq, CASE WHEN is_first THEN '' ELSE ',' END || {_DASHBOARD_RESULT} FROM x
UNION ALL SELECT scan_id, 4, '', ']}}]}}' FROM scans""")
def s13(v: Views) -> DataFrame:
    return rp.dashboard_sarif(_scans(v), v.finding_rows, texts=v.finding_texts).withColumnRenamed("at", "place")


@query("s14_ci_reports", """WITH o AS (SELECT r.request_id, r.scan_id FROM token_requests r JOIN api_tokens t ON sha256(r.token) = t.token_hash JOIN scans s ON r.scan_id = s.scan_id
  WHERE r.token <> '' AND t.is_active = 'true' AND (contains(t.scopes, 'report:write') OR contains(t.scopes, 'scan:read')) AND s.project_id = t.project_id),
n AS (SELECT scan_id, count(*) AS n FROM scan_findings GROUP BY scan_id)
SELECT o.request_id, o.scan_id, coalesce(n, 0) + 2 AS lines FROM o LEFT JOIN n ON o.scan_id = n.scan_id""")
def s14(v: Views) -> DataFrame:
    resolved = ac.resolve_tokens(v.token_requests, v.api_tokens, v.scans, ["report:write", "scan:read"])
    asked = sinks.readable(resolved)
    scans, findings = (rows.join(asked.select("scan_id").distinct(), "scan_id", "left_semi") for rows in (_scans(v), v.finding_rows))
    lines = rp.executive_json(scans, findings, "ci_pipeline", _WHEN, short=True, texts=v.finding_texts)
    # a line's length stands for the line, which the request is not dealt with
    return sinks.ci_reports(resolved, lines.withColumn("line", F.length("line"))).groupBy("request_id", "scan_id").agg(F.count("line").alias("lines"))


@query("s16_findings_write", """SELECT id, scan_id, rule_id, CASE WHEN scan_id % 10 = 3 THEN 'rewritten' ELSE status END AS status
  FROM scan_findings WHERE scan_id % 10 <> 7""")
def s16(v: Views) -> DataFrame:
    """Write all findings, rewrite those of every tenth scan twice, empty another tenth, read back."""
    root = f"{checkpoint_root(v.spark)}/tables/{uuid.uuid4().hex}"
    rows = v.scan_findings.select("id", "scan_id", "rule_id", "status")
    sinks.write_findings(rows, v.scans.select("scan_id"), f"{root}/findings")
    again, gone = F.col("scan_id") % 10 == 3, F.col("scan_id") % 10 == 7
    for _ in range(2):
        sinks.write_findings(rows.filter(again).withColumn("status", F.lit("rewritten")), rows.filter(again | gone).select("scan_id"), f"{root}/findings")
    return tables.table(v.spark, root, "findings").select("id", "scan_id", "rule_id", "status")


@query("s17_event_append", "SELECT id, scan_id, event_type, CAST(created_at AS DATE) AS event_date FROM scan_events")
def s17(v: Views) -> DataFrame:
    """S9 reads it back: two appends, filed by day."""
    root = f"{checkpoint_root(v.spark)}/tables/{uuid.uuid4().hex}"
    for part in (0, 1):
        sinks.append_scan_events(v.scan_events.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == part), f"{root}/scan_events")
    tables.register(v.spark, root, ["scan_events"])
    return v.spark.sql("SELECT id, scan_id, event_type, event_date FROM scan_events")
