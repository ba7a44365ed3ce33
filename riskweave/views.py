"""The model tables as views over the star-schema test tables.

Each view is one SELECT in the dialect that Spark and the checking engine share, so
both sides read the same rows; only the hash functions are spelled differently.
Views name other views or base tables in FROM, as {name}.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations"]

AS_OF = "TIMESTAMP '1999-06-01 00:00:00'"


def _pick(expr: str, *values: str, otherwise: str | None = None) -> str:
    """CASE over 0, 1, 2, ... of an integer expression."""
    *head, last = values
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(head))
    return f"CASE {expr} {cases} ELSE {last} END"


_EXT = _pick("(l_partkey % 20) % 7", "'.py'", "'.js'", "'.ts'", "'.java'", "'.cs'", "'.yml'", "'.go'")
_SEQ = (
    "lpad(CAST(EXTRACT(YEAR FROM l_shipdate) * 10000 + EXTRACT(MONTH FROM l_shipdate) * 100 "
    "+ EXTRACT(DAY FROM l_shipdate) AS STRING), 8, '0') || lpad(CAST(l_partkey AS STRING), 10, '0') "
    "|| lpad(CAST(l_suppkey AS STRING), 8, '0') || lpad(CAST(l_linenumber AS STRING), 2, '0') "
    "|| lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), 12, '0')"
)
_PATH = f"'src/f' || CAST(l_partkey % 20 AS STRING) || {_EXT}"
_RULE = "'rule-' || CAST(l_partkey % 5 AS STRING)"

_FINDING = f"""
  CAST(l_orderkey AS STRING) || '-' || {_SEQ} AS id, l_orderkey AS scan_id, {_SEQ} AS seq,
  {_pick('l_suppkey % 6', "'semgrep'", "'bandit'", "'eslint-security'", "'owasp-patterns'", "'trivy'", "'secret-scan'")} AS engine,
  {_RULE} AS rule_id,
  {_pick('l_suppkey % 4', "'SAST source code'", "'Secret scan'", "'Dependency scan'", "'Config scan'")} AS scan_category,
  {_pick('l_partkey % 5', "'Potential injection sink'", "'DOM XSS sink'", "'SSRF sink with user url'", "'Hardcoded API key'", "'Debug mode enabled'")} AS title,
  {_pick('l_partkey % 5', "'Injection'", "'XSS (DOM)'", "'Server-Side Request Forgery (SSRF)'", "'Hardcoded Secret'", "'Security Misconfiguration'")} AS vuln_type,
  CASE WHEN l_quantity >= 46 THEN 'Critical' WHEN l_quantity >= 36 THEN 'High' WHEN l_quantity >= 20 THEN 'Medium'
       WHEN l_quantity >= 6 THEN 'Low' ELSE 'Info' END AS severity,
  l_quantity / 5 AS cvss4_score, round(0.5 + l_discount * 5, 2) AS confidence,
  {_pick('l_partkey % 5', "'CWE-89'", "'CWE-79'", "'CWE-918'", "'CWE-798'", "''")} AS cwe_id,
  CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 'A' || lpad(CAST(l_partkey % 11 AS STRING), 2, '0') || ':2021' END AS owasp_category,
  {_PATH} AS file_path, l_linenumber AS line_number, l_linenumber AS line_start,
  CAST(l_linenumber + l_partkey % 3 AS INT) AS line_end,
  {_pick('l_suppkey % 3', "''", "'HTTP query parameter'", "'HTTP form body'")} AS source,
  CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'SQL execute' END AS sink,
  {_pick('l_partkey % 3', "'handler'", "''", "'main'")} AS function_name,
  {_pick('l_partkey % 4', "'const id = req.query.id'", "'cursor.execute(sql + name)'", "'API_KEY=ABCDEF1234567890XYZ'", "''")} AS code_snippet,
  {_pick('l_linenumber % 3', "''", "'token ghp_0123456789abcdefABCDEF' || CAST(l_suppkey AS STRING)", "'http://localhost/test'")} AS evidence,
  {_pick('l_partkey % 2', "''", "'Because rule ' || CAST(l_partkey % 5 AS STRING)")} AS why_vulnerable,
  'Scenario ' || CAST(l_partkey % 5 AS STRING) AS attack_scenario,
  {_pick('l_suppkey % 2', "''", "'Impact'")} AS impact,
  {_pick('l_partkey % 3', "'CVE-2024-' || CAST(l_partkey % 7 AS STRING)", "'See advisory'", "''")} AS poc,
  'Fix rule ' || CAST(l_partkey % 5 AS STRING) AS remediation, 'safe()' AS secure_example,
  {_pick('l_partkey % 4', "''", "' '", "'Check in staging'", "'Ask the owner'")} AS pentest_hint,
  {_pick('l_partkey % 3', "''", "'https://a.example/x, http://b.example/y' || chr(10) || ' https://c.example/z'", "'https://a.example/x'")} AS references,
  {_pick('l_suppkey % 5', "''", "'not json'", "'[]'", "'[{{\"message\":\"in\",\"path\":\"a.py\",\"line\":3}},{{\"message\":\"out\"}}]'", "'{{\"k\":1}}'")} AS dataflow_trace,
  {_pick('l_linenumber % 6', "'unverified'", "'verified'", "'failed'", "'skipped'", "'needs_review'", "'false_positive_likely'")} AS verification_status,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'fixed' WHEN l_returnflag = 'A' THEN 'confirmed'
       WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'false_positive' WHEN l_returnflag = 'N' THEN 'open'
       WHEN l_linestatus = 'F' THEN 'accepted_risk' ELSE 'in_progress' END AS status,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'user-' || CAST(l_suppkey % 50 AS STRING) END AS assignee_id,
  l_shipdate AS created_at,
  substr({{sha}}({_RULE} || ':' || {_PATH} || ':' || CAST(l_linenumber AS STRING){{sha_end}}), 1, 16) AS dedupe_hash"""

# what a finding is made of, and what its rule goes by
FINDING_BASE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_returnflag", "l_linestatus", "l_shipdate"]

_SCAN_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END"

VIEWS = {
    "projects": """SELECT c_custkey AS project_id, c_name AS name,
        CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_nationkey END AS organization_id,
        'user-' || CAST(c_custkey % 97 AS STRING) AS created_by,
        CASE WHEN c_custkey % 10 = 0 THEN 'public' ELSE 'private' END AS visibility,
        'https://github.com/acme/' || CAST(c_custkey AS STRING) || '.git' AS repo_url, c_mktsegment AS status,
        'main branch' AS default_branch FROM {customer}""",
    "organizations": "SELECT n_nationkey AS organization_id, n_name AS name FROM {nation}",
    "organization_members": f"""SELECT 'user-' || CAST(s_suppkey AS STRING) AS user_id, s_nationkey AS organization_id,
        {_pick('s_suppkey % 4', "'owner'", "'admin'", "'member'", "'viewer'")} AS role FROM {{supplier}}""",
    "users": f"""SELECT 'user-' || CAST(s_suppkey AS STRING) AS user_id,
        CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS name,
        CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE 'u' || CAST(s_suppkey AS STRING) || '@example.org' END AS email,
        CASE WHEN s_suppkey % 9 = 0 THEN 'disabled' ELSE 'active' END AS status,
        {_pick('s_suppkey % 11', "'admin'", "'super_admin'", "'support_admin'", "'user'")} AS role_global FROM {{supplier}}""",
    "scans": f"""SELECT o_orderkey AS scan_id, o_custkey AS project_id, {_SCAN_STATUS} AS status,
        o_orderdate AS created_at, CAST(o_orderkey % 101 AS DOUBLE) AS risk_percent,
        CASE WHEN o_orderkey % 101 >= 85 THEN 'Critical' WHEN o_orderkey % 101 >= 70 THEN 'High'
             WHEN o_orderkey % 101 >= 40 THEN 'Medium' ELSE 'Low' END AS risk_level,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'user-' || CAST(o_orderkey % 97 AS STRING) END AS triggered_by,
        {_pick('o_orderkey % 3', "'repo_url'", "'archive'", "'paste'")} AS source_type,
        {_pick('o_orderkey % 3', "'https://github.com/acme/' || CAST(o_custkey AS STRING) || '.git'", "'upload'", "'[]'")} AS source_value,
        CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + (o_orderkey % 3600) * INTERVAL '1' SECOND END AS started_at,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + (3600 + o_orderkey % 7200) * INTERVAL '1' SECOND END AS completed_at
        FROM {{orders}}""",
    "scan_findings": f"SELECT {_FINDING} FROM {{lineitem}}",
    "findings": "SELECT f.*, o.o_custkey AS project_id FROM {scan_findings} f JOIN {orders} o ON f.scan_id = o.o_orderkey",
    "scan_events": f"""SELECT event_id AS id, user_id AS scan_id, ts AS created_at, props AS message,
        CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'sast_scan_started'
             WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS event_type FROM {{events}}""",
    "finding_events": f"""SELECT event_id AS id, user_id AS finding_id, ts AS created_at,
        'user-' || CAST(event_id % 120 AS STRING) AS user_id,
        CASE event_type WHEN 'signup' THEN 'status_changed' WHEN 'view' THEN 'verification_status_changed'
             WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'unassigned' ELSE 'assigned' END
             WHEN 'purchase' THEN 'comment' ELSE 'ai_review' END AS event_type,
        CASE event_type
             WHEN 'signup' THEN {_pick('event_id % 9', "'open'", "'confirmed'", "'in_progress'", "'fixed'", "'accepted_risk'", "'false_positive'", "'ignored'", "'reopened'", "'bogus'")}
             WHEN 'view' THEN {_pick('event_id % 7', "'unverified'", "'verified'", "'failed'", "'skipped'", "'needs_review'", "'false_positive_likely'", "'bogus'")}
             WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'user-' || CAST(event_id % 50 AS STRING) END END AS new_value,
        CASE event_type WHEN 'purchase' THEN 'note ' || props
             WHEN 'error' THEN {_pick('event_id % 3', "'{{\"isLikelyTruePositive\":true,\"confidence\":0.75,\"explanation\":\"reachable\"}}'", "'broken {{'", "'{{\"isLikelyTruePositive\":false,\"suggestedFix\":\"escape\"}}'")} END AS comment
        FROM {{events}}""",
    "audit_events": f"""SELECT event_id AS id, 'user-' || CAST(user_id AS STRING) AS user_id, ts AS created_at,
        CASE event_type WHEN 'signup' THEN 'finding.triage.update' WHEN 'view' THEN 'PROJECT_VIEWED'
             WHEN 'click' THEN 'finding.assign' WHEN 'purchase' THEN 'trigger_scan' ELSE 'ADMIN_SCAN_CANCELLED' END AS action,
        CASE WHEN event_type IN ('signup', 'click') THEN 'Finding' ELSE 'Scan' END AS entity_type,
        CASE WHEN event_type = 'error' THEN 'raw ' || props ELSE props END AS metadata FROM {{events}}""",
    "notifications": f"""SELECT o_orderkey AS id, 'user-' || CAST(o_orderkey % 97 AS STRING) AS user_id,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'scan_completed' WHEN o_orderpriority = '3-MEDIUM' THEN 'scan_failed'
             WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'finding_assigned' ELSE 'team_invite_accepted' END AS type,
        CASE WHEN o_orderstatus = 'P' THEN 'unread' ELSE 'read' END AS status, o_orderdate AS created_at,
        '{{{{"scanId":"' || CAST(o_orderkey AS STRING) || '"}}}}' AS payload FROM {{orders}}""",
    "scanner_policies": f"""SELECT c_custkey AS project_id,
        {_pick('c_custkey % 5', "'[]'", "'[\"semgrep\",\"trivy\"]'", "'not json'", "'[\"owasp\",\"secrets\",7,\"bandit\"]'", "NULL")} AS enabled_engines,
        {_pick('c_custkey % 6', "'Info'", "'Low'", "'Medium'", "'High'", "'Critical'", "NULL")} AS severity_threshold,
        c_custkey % 3 <> 0 AS ai_triage_enabled, c_custkey % 4 = 0 AS secret_verification_enabled,
        {_pick('c_custkey % 3', "'{{\"rule-1\":{{\"enabled\":false}}}}'", "'{{}}'", "'oops'")} AS rule_overrides
        FROM {{customer}} WHERE c_mktsegment <> 'BUILDING'""",
    "api_tokens": f"""SELECT c_custkey AS id, c_custkey AS project_id,
        {{sha}}('tok-' || CAST(c_custkey AS STRING){{sha_end}}) AS token_hash,
        {_pick('c_custkey % 3', "'scan:create,scan:read'", "'report:write'", "'scan:create'")} AS scopes,
        CASE WHEN c_custkey % 6 = 0 THEN 'false' ELSE 'true' END AS is_active FROM {{customer}}""",
    "token_requests": """SELECT o_orderkey AS request_id,
        CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderpriority = '1-URGENT' THEN 'tok-none'
             ELSE 'tok-' || CAST(o_custkey AS STRING) END AS token,
        CASE WHEN o_orderstatus = 'P' THEN o_orderkey + 1 ELSE o_orderkey END AS scan_id FROM {orders}""",
    "badge_publications": """SELECT 'badge-' || CAST(o_orderkey AS STRING) AS token, o_custkey AS scan_id,
        o_orderdate AS published_at FROM {orders} WHERE o_orderstatus = 'F'""",
    "support_grants": f"""SELECT c_custkey AS id, 'user-' || CAST(c_custkey % 89 AS STRING) AS actor_id,
        CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS project_id,
        CASE WHEN c_custkey % 2 = 1 THEN c_nationkey END AS organization_id,
        {_pick('c_custkey % 6', "'[\"view_findings\"]'", "'[\"all\"]'", "'manage_scan, view_source'", "'all'", "'\"manage_policy\"'", "'[\"manage_policy\",\"manage_scan\"]'")} AS scopes,
        TIMESTAMP '1999-01-01 00:00:00' + (c_custkey % 365) * INTERVAL '1' DAY AS expires_at,
        CASE WHEN c_custkey % 8 = 7 THEN TIMESTAMP '1999-01-01 00:00:00' END AS revoked_at,
        TIMESTAMP '1998-01-01 00:00:00' + (c_custkey % 365) * INTERVAL '1' DAY AS created_at FROM {{customer}}""",
    "invites": f"""SELECT c_custkey AS id, c_nationkey AS organization_id, lower(c_name) || '@example.org' AS email,
        {_pick('c_custkey % 5', "'pending'", "'accepted'", "'pending'", "'rejected'", "'cancelled'")} AS status,
        TIMESTAMP '1999-01-01 00:00:00' + (c_custkey % 365) * INTERVAL '1' DAY AS expires_at,
        TIMESTAMP '1998-06-01 00:00:00' + (c_custkey % 365) * INTERVAL '1' DAY AS created_at FROM {{customer}}""",
    "uploads": f"""SELECT doc_id AS upload_id, n_chars * 100000 AS size,
        source || '/' || lang || CAST(doc_id AS STRING) || {_pick('doc_id % 4', "'.zip'", "'.tar.gz'", "'.TGZ'", "'.rar'")} AS file_name
        FROM {{documents}}""",
    "source_files": f"""SELECT source AS scan_id, text AS content,
        CASE doc_id % 5 WHEN 0 THEN 'app/' || CAST(doc_id AS STRING) || '.py' WHEN 1 THEN 'web/' || CAST(doc_id AS STRING) || '.JS'
             WHEN 2 THEN 'src/' || CAST(doc_id AS STRING) || '.java' WHEN 3 THEN 'conf/' || CAST(doc_id AS STRING) || '.yml'
             ELSE 'doc/' || CAST(doc_id AS STRING) || '.txt' END AS file_path FROM {{documents}}
        UNION ALL SELECT 'web' AS scan_id, html AS content,
        CASE WHEN page_id % 3 = 0 THEN 'pages/' || CAST(page_id AS STRING) || '.tsx' ELSE 'pages/' || CAST(page_id AS STRING) || '.html' END AS file_path
        FROM {{pages}}""",
    "truth": f"""SELECT 'BenchmarkTest' || lpad(CAST(doc_id AS STRING), 5, '0') AS test_case_id, toxic = 1 AS is_vulnerable,
        'CWE-' || {_pick('doc_id % 3', "'89'", "'78'", "'22'")} AS cwe_id,
        {_pick('doc_id % 3', "'SQL Injection'", "'OS Command Injection'", "'Path Traversal'")} AS category FROM {{labels}}""",
    "truth_findings": """SELECT 'src/benchmarktest' || lpad(CAST(doc_id AS STRING), 5, '0') || '.java' AS file_path,
        CASE lang WHEN 'en' THEN '89' WHEN 'fr' THEN 'cwe-78' WHEN 'de' THEN 'cwe 22' ELSE '' END AS cwe_id FROM {documents}""",
    "scan_requests": """SELECT conv_id * 1000 + turn AS request_id, role = 'user' AS guest,
        CASE WHEN role = 'system' THEN 'archive' WHEN turn % 3 = 0 THEN 'paste' WHEN turn % 3 = 1 THEN 'repo_url' ELSE 'ftp' END AS source_type,
        CASE WHEN turn % 3 = 1 THEN CASE conv_id % 7 WHEN 0 THEN 'https://github.com/a/b' WHEN 1 THEN 'http://github.com/a/b'
             WHEN 2 THEN 'https://10.1.2.3/x' WHEN 3 THEN 'https://example.org/x' WHEN 4 THEN 'https://' WHEN 5 THEN '  '
             ELSE 'https://user@gitlab.com/x' END ELSE text END AS source_value FROM {conversations}""",
    "finding_updates": f"""SELECT event_id AS update_id,
        {_pick('event_id % 5', "'fixed'", "''", "'closed'", "NULL", "'open'")} AS status,
        {_pick('event_id % 4', "'verified'", "NULL", "'maybe'", "''")} AS verification_status,
        '  ' || props || ' ' AS comment FROM {{events}}""",
    "requests": "SELECT event_id AS id, '10.0.0.' || CAST(user_id AS STRING) AS ip, ts FROM {events}",
}


def _filled(text: str) -> str:
    return text.replace("{sha}", "sha2").replace("{sha_end}", ", 256")


class Views:
    """Model views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        if name not in VIEWS:
            raise AttributeError(name)
        refs = set(re.findall(r"\{(\w+)\}", VIEWS[name])) - {"sha", "sha_end"}
        return self.spark.sql(_filled(VIEWS[name]), **{r: getattr(self, r) for r in refs})

    @property
    def finding_rows(self) -> DataFrame:
        """Findings before their texts are made: what `finding_texts` needs, with scan_id, seq and the columns a rule is named by.

        Joins and first findings are worked out on these, so a shuffle moves no text that can be made behind it.
        """
        base = ", ".join(FINDING_BASE)
        made = self.spark.sql(_filled(f"SELECT {_FINDING}, {base} FROM {{lineitem}}"), lineitem=self.lineitem)
        return made.select(*FINDING_BASE, "scan_id", "seq", "rule_id", "cwe_id", "vuln_type")

    @property
    def project_findings(self) -> DataFrame:
        """The view findings, with its texts made behind the join that names the project: only what they are made of is shuffled."""
        orders = self.orders.select("o_orderkey", "o_custkey")
        rows = self.lineitem.select(*FINDING_BASE).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
        return self.spark.sql(_filled(f"SELECT {_FINDING}, o_custkey AS project_id FROM {{rows}}"), rows=rows)

    def finding_texts(self, rows: DataFrame) -> DataFrame:
        """scan_findings of rows that hold the columns of `finding_rows`, with what else they carry."""
        made = self.spark.sql(_filled(f"SELECT {_FINDING} FROM {{rows}}"), rows=rows).columns
        more = "".join(f", `{c}`" for c in rows.columns if c not in {*FINDING_BASE, *made})
        return self.spark.sql(_filled(f"SELECT {_FINDING}{more} FROM {{rows}}"), rows=rows)

    def sql(self, text: str) -> DataFrame:
        refs = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{r: getattr(self, r) for r in refs})


def oracle_text(body: str) -> str:
    """A checking query: the views it uses as CTEs in front of its body."""
    needed: list[str] = []

    def visit(text: str, braces: bool):
        pattern = r"\{(\w+)\}" if braces else r"\b(\w+)\b"
        for name in re.findall(pattern, text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name], True)
                if name not in needed:
                    needed.append(name)

    visit(body, False)
    if not needed:
        return body

    def cte(name: str) -> str:
        text = VIEWS[name].replace("{sha}", "sha256").replace("{sha_end}", "")
        text = re.sub(r"\{(\w+)\}", r"\1", text).replace("{{", "{").replace("}}", "}")
        return f"{name} AS ({text})"

    head = ", ".join(cte(n) for n in needed)
    stripped = body.strip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {stripped[15:]}"
    if stripped.upper().startswith("WITH "):
        return f"WITH {head}, {stripped[5:]}"
    return f"WITH {head} {stripped}"
