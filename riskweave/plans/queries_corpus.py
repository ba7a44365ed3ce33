"""Queries over source texts: detection, context, masking, evaluation, report readers."""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from riskweave.functions import text as tx
from riskweave.operators import detection as d, enrichment as en, evaluation as ev
from riskweave.plans.registry import query
from riskweave.plans.scan_plan import scan, scan_job
from riskweave.session import checkpoint_root
from riskweave.sources import archive_files as af, corpus as co, external_reports as xr, tree_source as ts
from riskweave.views import Views

# base name without folders, and its suffix ('' when the name starts or ends with its only dot)
_NAME = "lower(regexp_extract(file_path, '([^/]*)$', 1))"
_SUFFIX = f"regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)"
_SCANNABLE = (f"({_NAME} IN ('dockerfile', 'jenkinsfile', '.gitlab-ci.yml') OR {_SUFFIX} IN ('.py', '.js', '.jsx', '.ts', '.tsx', '.java', '.cs', '.go', '.rb', "
              "'.php', '.yml', '.yaml', '.json', '.env', '.ini', '.conf', '.properties', '.xml'))")


def _hits_sql(rules: list[tuple[str, str]], where: str) -> str:
    """Every match of every rule with its line, from match and gap texts in order."""
    union = " UNION ALL ".join(
        f"SELECT scan_id, file_path, content, '{rule}' AS rule_id, regexp_extract_all(content, '{rx}') AS ms, regexp_split_to_array(content, '{rx}') AS gs "
        f"FROM source_files WHERE {where} AND regexp_matches(content, '{rx}')" for rule, rx in rules)
    return f"""WITH m AS ({union}),
u AS (SELECT scan_id, file_path, rule_id, unnest(ms) AS snippet, unnest(gs[:len(ms)]) AS gap, unnest(range(len(ms))) AS pos FROM m),
n AS (SELECT *, len(gap) - len(replace(gap, chr(10), '')) AS g, len(snippet) - len(replace(snippet, chr(10), '')) AS s FROM u)
SELECT scan_id, file_path, rule_id, CAST(1 + sum(g) OVER w + sum(s) OVER w - s AS INT) AS line, snippet FROM n
WINDOW w AS (PARTITION BY scan_id, file_path, rule_id ORDER BY pos)"""


@query("p1_scannable_files", f"SELECT scan_id, file_path, {_SCANNABLE} AS scannable FROM source_files")
def p1(v: Views) -> DataFrame:
    return v.source_files.select("scan_id", "file_path", co.is_scannable(F.col("file_path")).alias("scannable"))


_D1 = [
    ("config.auth-bypass-flag", r"(?i)(allowanonymous|permitall|skip[_-]?auth|auth[_-]?disabled\s*=\s*true)"),
    ("sast.weak-crypto-primitive", r"(?i)(md5\(|sha1\(|des\.|rc4|sslv3|tlsv1)"),
    ("sast.injection-sink", r"(?i)(select\s+.+\+|execute\(f[\"'']|subprocess\..*shell\s*=\s*true|os\.system\(|Runtime\.getRuntime\(\)\.exec)"),
    ("sast.insecure-design-marker", r"(?i)(TODO\s*:\s*security|FIXME\s*:\s*auth|trust client side)"),
    ("config.security-misconfiguration", r"(?i)(debug\s*=\s*true|cors\s*[:=].*\*|origins?\s*=\s*\[?[''\"]\*[''\"]|default[_-]?password)"),
    ("sast.weak-auth-session", r"(?i)(jwt[_-]?secret\s*[:=]\s*[''\"].+[''\"]|session[_-]?id\s*=\s*request\.args|mfa[_-]?enabled\s*=\s*false)"),
    ("config.supply-chain-unsafe-install", r"(?i)(curl\s+.+\|\s*(bash|sh)|pip\s+install\s+--trusted-host|npm\s+install\s+--force)"),
    ("sast.logging-suppression", r"(?i)(except\s+Exception\s*:\s*pass|catch\s*\(.*\)\s*\{\s*\}|logger\.disabled\s*=\s*true)"),
    ("sast.ssrf-url-sink", r"(?i)(requests\.(get|post|put|patch)\(\s*(url|target_url|user_url|request\.|input)|axios\.(get|post)\(\s*(url|target_url|user_url)|fetch\(\s*(url|target_url|user_url))"),
]


@query("d1_pattern_rules", _hits_sql(_D1, _SCANNABLE))
def d1(v: Views) -> DataFrame:
    return d.pattern_findings(v.source_files).select(
        "scan_id", "file_path", "rule_id", F.col("line_start").alias("line"), F.col("code_snippet").alias("snippet"))


_D2_SQL = f"""WITH n AS (SELECT 'dangerouslySetInnerHTML' AS needle, 'regex-js.dangerouslysetinnerhtml' AS rule_id UNION ALL SELECT 'eval(', 'regex-js.eval' UNION ALL SELECT 'new Function(', 'regex-js.new function')
SELECT scan_id, file_path, rule_id, CAST(1 + len(p) - len(replace(p, chr(10), '')) AS INT) AS line FROM (SELECT scan_id, file_path, rule_id, substr(content, 1, strpos(content, needle) - 1) AS p
  FROM source_files, n WHERE {_SUFFIX} IN ('.js', '.jsx', '.ts', '.tsx') AND contains(content, needle))"""


@query("d2_script_sinks", _D2_SQL)
def d2(v: Views) -> DataFrame:
    return d.js_sink_findings(v.source_files).select("scan_id", "file_path", "rule_id", F.col("line_start").alias("line"))


def rule_hits_sql() -> str:
    """Hits of the pattern, script and secret rules together."""
    parts = [_hits_sql(_D1, _SCANNABLE), _D2_SQL, _hits_sql(_D7, "true")]
    return " UNION ALL ".join(f"SELECT scan_id, file_path, rule_id, line FROM ({p})" for p in parts)


def _components(v: Views) -> DataFrame:
    """One small script component per part, written from its columns."""
    return v.sql("""SELECT p_brand AS scan_id, 'ui/c' || CAST(p_partkey AS STRING) || CASE WHEN p_size % 2 = 0 THEN '.tsx' ELSE '.JS' END AS file_path,
      'const name = "' || p_name || '";' || chr(10) || CASE p_type WHEN 'ECONOMY' THEN 'eval(name);' || chr(10) || 'eval(name)' WHEN 'PROMO' THEN chr(10) || '<b dangerouslySetInnerHTML=x/>'
      ELSE chr(10) || 'new Function(name); eval(x)' END AS content FROM {part}""")


@query("d2_script_components", """SELECT p_brand AS scan_id, 'ui/c' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '.tsx' ELSE '.JS' END AS file_path,
  unnest(CASE p_type WHEN 'ECONOMY' THEN ['regex-js.eval'] WHEN 'PROMO' THEN ['regex-js.dangerouslysetinnerhtml'] ELSE ['regex-js.eval', 'regex-js.new function'] END) AS rule_id,
  CASE p_type WHEN 'ECONOMY' THEN 2 ELSE 3 END AS line FROM part""")
def d2_components(v: Views) -> DataFrame:
    return d.js_sink_findings(_components(v)).select("scan_id", "file_path", "rule_id", F.col("line_start").alias("line"))


_LANG = f"""CASE {_SUFFIX} WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript'
  WHEN '.java' THEN 'java' WHEN '.cs' THEN 'dotnet' WHEN '.go' THEN 'go' WHEN '.rb' THEN 'ruby' WHEN '.php' THEN 'php' END"""


@query("d3_language_summary", f"""WITH g AS (SELECT scan_id, {_LANG} AS language, count(*) AS n FROM source_files WHERE {_LANG} IS NOT NULL GROUP BY ALL)
SELECT * FROM g UNION ALL SELECT DISTINCT scan_id, 'unknown', CAST(1 AS BIGINT) FROM source_files WHERE scan_id NOT IN (SELECT scan_id FROM g)""")
def d3(v: Views) -> DataFrame:
    scans = v.source_files.select("scan_id").distinct()
    maps = d.language_summary(v.source_files, scans)
    return maps.select("scan_id", F.explode("language_summary").alias("language", "n"))


def _manifests(v: Views) -> DataFrame:
    """Root manifests written from parts and customers: one project each."""
    return v.sql("""SELECT 'npm-' || CAST(p_partkey AS STRING) AS scan_id, 'package.json' AS file_path,
        to_json(named_struct('name', p_name, 'dependencies', map('express', '^' || CAST(p_size AS STRING) || '.0.1', replace(p_name, ' ', '-'), '~1.' || CAST(p_size AS STRING)))) AS content FROM {part}
      UNION ALL SELECT 'pip-' || CAST(c_custkey AS STRING), 'requirements.txt',
        '# pins' || chr(10) || 'Flask==' || CAST(c_nationkey AS STRING) || '.1 ' || chr(10) || ' # old==1' || chr(10) || lower(c_mktsegment) || ' == 2.' || CAST(c_nationkey AS STRING) || chr(10) || 'loose>=1' FROM {customer}""")


_DEPS = """deps AS (SELECT 'npm-' || p_partkey AS scan_id, 'npm' AS ecosystem, 'express' AS package, p_size || '.0.1' AS version FROM part
UNION ALL SELECT 'npm-' || p_partkey, 'npm', replace(p_name, ' ', '-'), '1.' || p_size FROM part
UNION ALL SELECT 'pip-' || c_custkey, 'PyPI', 'Flask', c_nationkey || '.1' FROM customer UNION ALL SELECT 'pip-' || c_custkey, 'PyPI', lower(c_mktsegment), '2.' || c_nationkey FROM customer)"""


@query("d4_frameworks", """SELECT 'npm-' || p_partkey AS scan_id, 'express' AS framework, CAST(1 AS BIGINT) AS n FROM part UNION ALL SELECT 'pip-' || c_custkey, 'flask', 1 FROM customer""")
def d4(v: Views) -> DataFrame:
    return d.framework_counts(_manifests(v))


@query("d5_dependencies", f"WITH {_DEPS} SELECT * FROM deps")
def d5(v: Views) -> DataFrame:
    return d.dependencies(_manifests(v)).select("scan_id", "ecosystem", "package", "version")


def _advisories(v: Views) -> DataFrame:
    """Advisories written from suppliers, several for some versions."""
    return v.sql("""SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem, CASE WHEN s_suppkey % 2 = 0 THEN 'express' ELSE 'Flask' END AS package,
      CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS STRING) || '.0.1' ELSE CAST(s_nationkey AS STRING) || '.1' END AS version,
      s_acctbal AS rank, 'OSV-' || CAST(s_suppkey AS STRING) AS vuln_id, s_name AS summary FROM {supplier}""")


@query("d6_advisory_match", f"""WITH {_DEPS}, adv AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem, CASE WHEN s_suppkey % 2 = 0 THEN 'express' ELSE 'Flask' END AS package,
  CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey || '.0.1' ELSE s_nationkey || '.1' END AS version, s_acctbal AS rank, 'OSV-' || s_suppkey AS vuln_id, s_name AS summary FROM supplier),
top AS (SELECT *, row_number() OVER (PARTITION BY ecosystem, package, version ORDER BY rank, vuln_id) AS nth FROM adv)
SELECT d.scan_id, t.vuln_id AS rule_id, t.summary AS title, CASE WHEN d.ecosystem = 'npm' THEN 'package.json' ELSE 'requirements.txt' END AS file_path,
  CASE WHEN d.ecosystem = 'npm' THEN 'express@^' || d.version ELSE 'Flask==' || d.version END AS source
FROM deps d JOIN top t ON d.ecosystem = t.ecosystem AND d.package = t.package AND d.version = t.version""")
def d6(v: Views) -> DataFrame:
    """J12 and W5 inside: short advisory lists meet the dependencies."""
    return d.advisory_findings(d.dependencies(_manifests(v)), _advisories(v)).select("scan_id", "rule_id", "title", "file_path", "source")


_D7 = [
    ("secret.aws-access-key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("secret.github-token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("secret.gsk-key", r"\bgsk_[A-Za-z0-9]{20,}\b"),
    ("secret.sk-key", r"\bsk-[A-Za-z0-9_-]{20,}"),
    ("secret.private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("secret.assignment", r"(?i)\b[a-z0-9_]*(key|token|secret|password)[a-z0-9_]*\s*[:=]\s*[\"''][a-z0-9_./+-]{16,}[\"'']"),
]


@query("d7_secret_rules", f"""SELECT scan_id, file_path, rule_id, line, regexp_replace(snippet, '([a-zA-Z0-9_-]{{4}})[a-zA-Z0-9_-]{{8,}}([a-zA-Z0-9_-]{{4}})', '\\1...\\2', 'g') AS evidence
FROM ({_hits_sql(_D7, 'true')})""")
def d7(v: Views) -> DataFrame:
    return d.secret_findings(v.source_files).select(
        "scan_id", "file_path", "rule_id", F.col("line_start").alias("line"), "evidence")


@query("d8_taint_flows", """WITH f AS (SELECT *, 'app/h' || o_orderkey || '.py' AS path, CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 3 END AS line FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority < '3'))
SELECT o_custkey AS scan_id, path AS file_path, CASE WHEN o_orderpriority < '3' THEN 'python-command-injection-taint' ELSE 'python-ssrf-taint' END AS rule_id, line AS line_start,
  '[{"message":"source","path":"' || path || '","line":2},{"message":"sink","path":"' || path || '","line":' || line || '}]' AS dataflow_trace, 'High' AS severity FROM f""")
def d8(v: Views) -> DataFrame:
    """J13: source and sink lines come from the texts of lineitem-sized handlers."""
    return d.taint_findings(_handlers(v)).select("scan_id", "file_path", "rule_id", "line_start", "dataflow_trace", "severity")


def _dealt_orders(v: Views) -> DataFrame:
    """Orders dealt over the tasks while they are narrow: a few splits of the table become many files to read.

    Spark moves filters below a repartition, and the gates of the rules are one: they would run in the few tasks that
    read the table.  No filter on a generated column crosses its generator, so the dealt rows pass through one.
    """
    row = F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    dealt = v.orders.select(row.alias("o")).repartition(int(v.spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select(F.explode(F.array("o")).alias("o")).select("o.*")


def _handlers(v: Views) -> DataFrame:
    """One small Python handler per order, written from its columns."""
    return v.spark.sql("""SELECT o_custkey AS scan_id, 'app/h' || CAST(o_orderkey AS STRING) || '.py' AS file_path,
      'def handler_' || CAST(o_orderkey AS STRING) || '(request):' || chr(10) || '    v = request.args.get("q")' || chr(10) ||
      CASE WHEN o_orderstatus = 'F' THEN '    v = shlex.quote(v)' || chr(10) ELSE '' END ||
      CASE WHEN o_orderpriority < '3' THEN '    os.system("run " + v)' ELSE '    requests.get(v)' END || chr(10) AS content FROM {orders}""", orders=_dealt_orders(v))


@query("d8_handler_flows", """SELECT o_custkey AS scan_id, 'app/h' || o_orderkey || '.py' AS file_path, CASE WHEN o_orderpriority < '3' THEN 'python-command-injection-taint' ELSE 'python-ssrf-taint' END AS rule_id,
  CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 3 END AS line_start, CASE WHEN o_orderpriority < '3' THEN 'os.system("run " + v)' ELSE 'requests.get(v)' END AS snippet
FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority < '3')""")
def d8_handlers(v: Views) -> DataFrame:
    return d.taint_findings(_handlers(v)).select("scan_id", "file_path", "rule_id", "line_start", F.col("code_snippet").alias("snippet"))


_JAVA_FLOWS = """SELECT o_custkey AS scan_id, 'src/H' || o_orderkey || '.java' AS file_path,
  unnest(CASE o_orderkey % 7 WHEN 0 THEN [{'rule': 'java-sqli-taint', 'line': 5, 'origin': 3}] WHEN 1 THEN [{'rule': 'java-sqli-taint', 'line': 5, 'origin': 3}]
    WHEN 4 THEN [{'rule': 'java-command-injection-taint', 'line': 3, 'origin': 2}] WHEN 6 THEN [{'rule': 'java-path-traversal-taint', 'line': 4, 'origin': 3}, {'rule': 'java-ssrf-taint', 'line': 5, 'origin': 3}] ELSE [] END) AS f FROM orders"""


@query("d8_java_flows", f"SELECT scan_id, file_path, f.rule AS rule_id, f.line AS line_start, '[{{\"message\":\"source\",\"path\":\"' || file_path || '\",\"line\":' || f.origin || '}},{{\"message\":\"sink\",\"path\":\"' || file_path || '\",\"line\":' || f.line || '}}]' AS dataflow_trace FROM ({_JAVA_FLOWS})")
def d8_java(v: Views) -> DataFrame:
    """A renamed variable, a sanitizer on another variable, one on this, a name in two methods, an annotated parameter, an overwritten value, two rules."""
    files = v.spark.sql("""SELECT o_custkey AS scan_id, 'src/H' || CAST(o_orderkey AS STRING) || '.java' AS file_path, 'public class H {{' || chr(10) || CASE o_orderkey % 7
      WHEN 4 THEN '  public void run(@RequestParam(\"c\") String cmd) {{' || chr(10) || '    Runtime.getRuntime().exec(cmd);'
      ELSE '  public void get(HttpServletRequest req) {{' || chr(10) || '    String id = req.getParameter(\"id\");' || chr(10) || CASE o_orderkey % 7
        WHEN 0 THEN '    String q = \"select \" + id;' || chr(10) || '    stmt.executeQuery(q);'
        WHEN 1 THEN '    int n = Integer.parseInt(other);' || chr(10) || '    stmt.executeQuery(\"select \" + id);'
        WHEN 2 THEN '    int n = Integer.parseInt(id);' || chr(10) || '    stmt.executeQuery(\"select id \" + n);'
        WHEN 3 THEN '  }}' || chr(10) || '  private void put(String id) {{' || chr(10) || '    stmt.executeUpdate(id);'
        WHEN 5 THEN '    id = \"fixed\";' || chr(10) || '    stmt.executeQuery(id); // id was ' || CAST(o_orderkey AS STRING)
        ELSE '    File f = new File(\"/data/\" + id);' || chr(10) || '    new URL(id).openStream();' END END || chr(10) || '  }}' || chr(10) || '}}' || chr(10) AS content FROM {orders}""", orders=_dealt_orders(v))
    return d.taint_findings(files).select("scan_id", "file_path", "rule_id", "line_start", "dataflow_trace")


@query("u3_engine_order", """WITH f AS (SELECT o_custkey AS scan_id, 'app/h' || o_orderkey || '.py' AS file_path, unnest(CASE WHEN o_orderpriority >= '3' THEN [{'e': 0, 'r': 6, 'id': 'python-ssrf-taint'}]
  WHEN o_orderstatus = 'F' THEN [{'e': 3, 'r': 2, 'id': 'sast.injection-sink'}] ELSE [{'e': 0, 'r': 5, 'id': 'python-command-injection-taint'}, {'e': 3, 'r': 2, 'id': 'sast.injection-sink'}] END) AS x FROM orders)
SELECT scan_id, file_path, x.id AS rule_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY x.e, file_path, x.r) AS INT) AS position FROM f""")
def u3(v: Views) -> DataFrame:
    """Place of every finding among those of all engines: by engine, then file, then rule."""
    both = en.engine_places(d.rule_hits(_handlers(v), (d.TAINT, d.PATTERN))).filter(F.col("rule_id") != "sast.ssrf-url-sink")
    order = Window.partitionBy("scan_id").orderBy("seq")
    return both.select("scan_id", "file_path", "rule_id", F.row_number().over(order).alias("position"))


@query("f4_f5_context_function", """SELECT o_custkey AS scan_id, 'app/h' || o_orderkey || '.py' AS file_path, 'handler_' || o_orderkey AS function_name,
  'def handler_' || o_orderkey || '(request):' || chr(10) || '    v = request.args.get("q")' || chr(10) || CASE WHEN o_orderstatus = 'F' THEN '    v = shlex.quote(v)' || chr(10) ELSE '' END || '    os.system("run " + v)' AS context
FROM orders WHERE o_orderpriority < '3'""")
def f4_f5(v: Views) -> DataFrame:
    hits = d.rule_hits(_handlers(v), (d.PATTERN,)).filter(F.col("snippet") == "os.system(")
    return hits.select("scan_id", "file_path", F.col("context_function").alias("function_name"), "context")


@query("j15_attach_context", """SELECT o_custkey AS scan_id, 'app/h' || o_orderkey || '.py' AS file_path, 'handler_' || o_orderkey AS function_name,
  'def handler_' || o_orderkey || '(request):' || chr(10) || '    v = request.args.get("q")' || chr(10) || CASE WHEN o_orderstatus = 'F' THEN '    v = shlex.quote(v)' || chr(10) ELSE '' END ||
  CASE WHEN o_orderpriority < '3' THEN '    os.system("run " + v)' ELSE '    requests.get(v)' END AS context FROM orders""")
def j15(v: Views) -> DataFrame:
    external = v.sql("""SELECT o_custkey AS scan_id, 'app/h' || CAST(o_orderkey AS STRING) || '.py' AS file_path, 2 AS line_start, 2 AS line_end FROM {orders}""")
    return en.attach_context(external, _handlers(v)).select(
        "scan_id", "file_path", F.col("context_function").alias("function_name"), "context")


@query("full_scan_risk")
def full_scan(v: Views) -> DataFrame:
    """Detect, correlate, enrich, fold and score every source as a scan."""
    files = v.source_files
    scans = files.select("scan_id").distinct().select(
        "scan_id", F.lit("repo_url").alias("source_type"), F.concat(F.lit("https://github.com/acme/"), "scan_id").alias("source_value"))
    return scan(files, scans)[1]


# --- the scan job: one scan per customer over the handlers of its orders -------------
def _job(v: Views) -> dict[str, DataFrame]:
    """Policies of every third project switch the pattern engine off, those of the next the URL rule; older
    findings of the same places were dismissed or fixed; some notices were told before."""
    scans = v.sql("""SELECT c_custkey AS scan_id, c_custkey AS project_id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'user-' || CAST(c_custkey % 7 AS STRING) END AS triggered_by,
      'archive' AS source_type, 'upload' AS source_value, TIMESTAMP_NTZ '1999-06-01 00:00:00' AS started_at FROM {customer}""")
    policies = v.sql("""SELECT c_custkey AS project_id, CASE WHEN c_custkey % 3 = 0 THEN '["semgrep","secrets"]' ELSE '[]' END AS enabled_engines, 'Info' AS severity_threshold, false AS ai_triage_enabled, false AS secret_verification_enabled,
      CASE WHEN c_custkey % 3 = 1 THEN '{{"python-ssrf-taint":{{"enabled":false}}}}' ELSE '{{}}' END AS rule_overrides FROM {customer}""")
    history = v.sql("""SELECT o_custkey AS project_id, substring(sha2(CASE WHEN o_orderpriority < '3' THEN 'python-command-injection-taint' ELSE 'python-ssrf-taint' END || ':app/h' || CAST(o_orderkey AS STRING) || '.py:' ||
      CASE WHEN o_orderstatus = 'F' THEN '4' ELSE '3' END, 256), 1, 16) AS dedupe_hash, -1 - o_custkey AS scan_id, TIMESTAMP_NTZ '1999-01-01 00:00:00' AS created_at, 'old-' || CAST(o_orderkey AS STRING) AS id,
      CASE o_orderkey % 4 WHEN 1 THEN 'false_positive' WHEN 2 THEN 'fixed' ELSE 'open' END AS status, CASE WHEN o_orderkey % 4 = 1 THEN 'user-7' END AS assignee_id, 'unverified' AS verification_status FROM {orders}""")
    told = v.sql("""SELECT 'user-' || CAST(c_custkey % 7 AS STRING) AS user_id, 'scan_completed' AS type, '{{"scanId":"' || CAST(c_custkey AS STRING) || '"}}' AS payload FROM {customer} WHERE c_custkey % 5 = 0""")
    return scan_job(_handlers(v), scans, history, told, F.expr("TIMESTAMP_NTZ '1999-06-01 00:00:07'"), policies=policies)


_JOB = """job AS (SELECT o_custkey AS scan_id, 'app/h' || o_orderkey || '.py' AS file_path, o_orderkey, o_orderstatus, unnest(CASE WHEN o_orderpriority >= '3' THEN CASE WHEN o_custkey % 3 = 1 THEN [] ELSE ['python-ssrf-taint'] END
  ELSE list_concat(CASE WHEN o_orderstatus = 'F' THEN [] ELSE ['python-command-injection-taint'] END, CASE WHEN o_custkey % 3 = 0 THEN [] ELSE ['sast.injection-sink'] END) END) AS rule_id FROM orders)"""


@query("scan_job_findings", f"""WITH {_JOB} SELECT scan_id, file_path, rule_id, 'Critical' AS severity, CAST(CASE WHEN rule_id = 'sast.injection-sink' THEN 0.84 ELSE 0.9 END AS DOUBLE) AS confidence,
  CASE WHEN rule_id = 'sast.injection-sink' THEN 'open' WHEN o_orderkey % 4 = 1 THEN 'false_positive' WHEN o_orderkey % 4 = 2 THEN 'reopened' ELSE 'open' END AS status,
  CASE WHEN rule_id <> 'sast.injection-sink' AND o_orderkey % 4 = 1 THEN 'user-7' END AS assignee_id FROM job""")
def job_findings(v: Views) -> DataFrame:
    """What a scan job stores: detected, correlated, ruled by policy, folded, scored, with the state of older findings."""
    return _job(v)["findings"].select("scan_id", "file_path", "rule_id", "severity", "confidence", "status", "assignee_id")


@query("scan_job_outcome", f"""WITH {_JOB}, g AS (SELECT scan_id, greatest(least(round(sum(30 * CASE WHEN rule_id = 'sast.injection-sink' THEN 0.84 ELSE 0.9 END), 6), 100.0), 85.0) AS p FROM job GROUP BY scan_id)
SELECT c_custkey AS scan_id, 'completed' AS status, CASE WHEN p IS NULL THEN 'Low' ELSE 'Critical' END AS risk_level, CAST(coalesce(p, 5.0) AS DOUBLE) AS risk_percent, CAST(7000 AS BIGINT) AS duration_ms,
  'Scan completed with risk ' || CASE WHEN p IS NULL THEN 'Low' ELSE 'Critical' END AS message, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 5 <> 0 THEN 'user-' || (c_custkey % 7) END AS notified FROM customer LEFT JOIN g ON c_custkey = scan_id""")
def job_outcome(v: Views) -> DataFrame:
    """The scan rows with risk and duration, their events, and who is told."""
    out = _job(v)
    told = out["notifications"].select(F.get_json_object("payload", "$.scanId").cast("long").alias("scan_id"), F.col("user_id").alias("notified"))
    # staged files say little of the rows they hold: a row for every scan is merged, and never sent whole to the driver
    return (out["scans"].select("scan_id", "status", "risk_level", "risk_percent", F.col("duration_ms").cast("long").alias("duration_ms"))
            .join(out["events"].select("scan_id", "message").hint("merge"), "scan_id").join(told.hint("merge"), "scan_id", "left"))


# --- F16, S1, S2, S3, P11, W4 ---------------------------------------------------
@query("f16_mask_tokens", """SELECT scan_id, file_path, sha256(regexp_replace(content, '([a-zA-Z0-9_-]{4})[a-zA-Z0-9_-]{8,}([a-zA-Z0-9_-]{4})', '\\1...\\2', 'g')) AS masked FROM source_files""")
def f16(v: Views) -> DataFrame:
    return v.source_files.select("scan_id", "file_path", F.sha2(tx.mask_long_tokens(F.col("content")), 256).alias("masked"))


def mask_sql(text: str) -> str:
    """SQL of both masking steps: the assignments that are found are replaced one by one, the longest first, then every long word."""
    hits = f"regexp_extract_all({text}, '(?i)(?:^|[^A-Za-z0-9_])([A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD)[A-Z0-9_]*[ \\t\\n\\x0b\\f\\r]*=[ \\t\\n\\x0b\\f\\r]*[a-zA-Z0-9_-]{{16,}})', 1)"
    longest = f"list_transform(list_reverse_sort(list_transform(list_distinct({hits}), lambda m: {{'n': length(m), 'm': m}})), lambda h: h.m)"
    assigned = f"list_reduce(list_prepend({text}, {longest}), lambda a, m: replace(a, m, left(m, 4) || '...' || right(m, 4)))"
    return f"regexp_replace({assigned}, '([a-zA-Z0-9_-]{{4}})[a-zA-Z0-9_-]{{8,}}([a-zA-Z0-9_-]{{4}})', '\\1...\\2', 'g')"


@query("f16_mask_secrets", f"SELECT scan_id, file_path, sha256({mask_sql('content')}) AS masked FROM source_files")
def f16_full(v: Views) -> DataFrame:
    """Both masking steps."""
    return v.source_files.select("scan_id", "file_path", F.sha2(tx.mask_secrets(F.col("content")), 256).alias("masked"))


@query("s1_utf8_decode", "SELECT doc_id, sha256(replace(text, chr(65533), '')) AS decoded FROM documents")
def s1(v: Views) -> DataFrame:
    broken = F.concat(F.encode(F.col("text"), "UTF-8"), F.unhex(F.lit("ff80")))
    return v.documents.select("doc_id", F.sha2(co.decode_utf8(broken), 256).alias("decoded"))


def _write_tree(batches, folder):
    """Every document as a file, with a byte behind it that is no text."""
    for batch in batches:
        for scan, path, content in zip(batch["scan_id"], batch["file_path"], batch["content"]):
            system, inside = af.locate(f"{folder}/{scan}/{path}")
            system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(inside, compression=None) as out:
                out.write(content.encode() + b"\xff")
        yield batch[["scan_id"]]


def _tree(v: Views) -> DataFrame:
    folder = f"{checkpoint_root(v.spark)}/trees/{uuid.uuid4().hex}"
    v.source_files.where("scan_id <> 'web'").select("scan_id", "file_path", "content").mapInPandas(partial(_write_tree, folder=folder), "scan_id string").count()
    ts.register(v.spark)
    return v.spark.read.format(ts.NAME).option("partition_bytes", 1 << 20).load(folder)


@query("s1_source_tree", "SELECT scan_id, file_path, sha256(replace(content, chr(65533), '')) AS content, CAST(octet_length(encode(content)) + 1 AS BIGINT) AS size FROM source_files WHERE scan_id <> 'web'")
def s1_tree(v: Views) -> DataFrame:
    """The documents written as a tree and read as a data source, in partitions of a megabyte."""
    return _tree(v).select("scan_id", "file_path", F.sha2("content", 256).alias("content"), "size")


@query("s1_pruned_tree", "SELECT scan_id, file_path, sha256(replace(content, chr(65533), '')) AS content FROM source_files WHERE scan_id <> 'web' AND file_path LIKE 'conf/%' AND file_path LIKE '%.yml'")
def s1_pruned(v: Views) -> DataFrame:
    """Conditions on the path drop files before their bodies are opened."""
    return _tree(v).where(F.col("file_path").startswith("conf/") & F.col("file_path").endswith(".yml")).select("scan_id", "file_path", F.sha2("content", 256).alias("content"))


@query("s2_pasted_payload", """SELECT conv_id AS scan_id, CASE WHEN role = 'system' THEN '../' ELSE 'src/' END || role || turn || '.py' AS file_path, text AS content, CAST(octet_length(encode(text)) AS BIGINT) AS size, role = 'system' AS rejected FROM conversations
UNION ALL SELECT conv_id, 'empty.py', '', 0, role = 'system' FROM conversations""")
def s2(v: Views) -> DataFrame:
    payloads = v.conversations.select(F.col("conv_id").alias("scan_id"), F.col("role"), F.to_json(F.array(
        F.struct(F.concat(F.when(F.col("role") == "system", "../").otherwise("src/"), "role", F.col("turn").cast("string"), F.lit(".py")).alias("path"),
                 F.col("text").alias("content")),
        F.struct(F.lit("empty.py").alias("path"), F.lit(None).cast("string").alias("content")),
        F.struct(F.lit("").alias("path"), F.lit("dropped").alias("content")))).alias("files"))
    wrapped = F.when(F.col("role") == "user", F.concat(F.lit('{"files":'), "files", F.lit("}"))).otherwise(F.col("files"))
    return co.expand_pasted(payloads.select("scan_id", wrapped.alias("payload")))


def _zip_documents(batches):
    for batch in batches:
        bodies = []
        for doc_id, source, text in zip(batch["doc_id"], batch["source"], batch["text"]):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
                zf.writestr(f"{source}/main.py", text)
                zf.writestr("../evil.py" if doc_id % 10 == 0 else "notes.md", "x")
            bodies.append(out.getvalue())
        yield pd.DataFrame({"archive": [f"{d}.zip" for d in batch["doc_id"]], "body": bodies})


def _archives(v: Views) -> DataFrame:
    """One zip per document, packed by Spark tasks."""
    return v.documents.select("doc_id", "source", "text").mapInPandas(_zip_documents, "archive string, body binary")


def _mixed_documents(batches):
    """A zip, a compressed tar, a zip cut in half or a file of another kind for every document."""
    for batch in batches:
        names, bodies = [], []
        for doc_id, source, text in zip(batch["doc_id"], batch["source"], batch["text"]):
            out, files = io.BytesIO(), [(f"{source}/main.py", text.encode()), ("../evil.py" if doc_id % 10 == 0 else "notes.md", b"x")]
            if doc_id % 5 == 2:
                with tarfile.open(fileobj=out, mode="w:gz") as tf:
                    for name, body in files:
                        info = tarfile.TarInfo(name)
                        info.size = len(body)
                        tf.addfile(info, io.BytesIO(body))
            else:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
                    for name, body in files:
                        zf.writestr(name, body)
            whole = out.getvalue()
            names.append(f"{doc_id}{'.tar.gz' if doc_id % 5 == 2 else '.rar' if doc_id % 5 == 4 else '.zip'}")
            bodies.append(whole[:len(whole) // 2] if doc_id % 5 == 3 else whole)
        yield pd.DataFrame({"archive": names, "body": bodies})


def _mixed_archives(v: Views) -> DataFrame:
    return v.documents.select("doc_id", "source", "text").mapInPandas(_mixed_documents, "archive string, body binary")


_EXPANDED = """SELECT doc_id || CASE WHEN doc_id % 5 = 2 THEN '.tar.gz' ELSE '.zip' END AS archive, 1 AS ordinal, source || '/main.py' AS member, CAST(octet_length(encode(text)) AS BIGINT) AS size, 'file' AS kind, sha256(text) AS content FROM documents WHERE doc_id % 5 < 3
UNION ALL SELECT doc_id || CASE WHEN doc_id % 5 = 2 THEN '.tar.gz' ELSE '.zip' END, 2, CASE WHEN doc_id % 10 = 0 THEN '../evil.py' ELSE 'notes.md' END, 1, 'file', sha256('x') FROM documents WHERE doc_id % 5 < 3
UNION ALL SELECT doc_id || CASE WHEN doc_id % 5 = 3 THEN '.zip' ELSE '.rar' END, CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 0 END, '', 0, CASE WHEN doc_id % 5 = 3 THEN 'corrupt' ELSE 'unsupported' END, NULL FROM documents WHERE doc_id % 5 >= 3"""


@query("s3_archive_expansion", _EXPANDED)
def s3(v: Views) -> DataFrame:
    return co.expand_archives(_mixed_archives(v)).select("archive", "ordinal", "member", "size", "kind", F.sha2(F.col("content"), 256).alias("content"))


def _write_archives(batches, folder):
    for batch in batches:
        for name, body in zip(batch["archive"], batch["body"]):
            system, inside = af.locate(f"{folder}/{int(name.split('.')[0]) % 16}/{name}")
            system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(inside, compression=None) as out:
                out.write(bytes(body))
        yield batch[["archive"]]


@query("s3_archive_files", _EXPANDED)
def s3_files(v: Views) -> DataFrame:
    """The same archives as files of the shared folder: an index by ranges, then bodies dealt by bytes."""
    folder = f"{checkpoint_root(v.spark)}/archives/{uuid.uuid4().hex}"
    _mixed_archives(v).mapInPandas(partial(_write_archives, folder=folder), "archive string").count()
    return af.expand_archive_files(v.spark, folder).select("archive", "ordinal", "member", "size", "kind", F.sha2(F.col("content"), 256).alias("content"))


@query("w4_archive_limits", """SELECT doc_id || '.zip' AS archive, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS total_size, CAST(2 AS BIGINT) AS member_count, doc_id % 10 = 0 AS unsafe,
  octet_length(encode(text)) + 1 > 20000 AS too_large, NOT (doc_id % 10 = 0 OR octet_length(encode(text)) + 1 > 20000) AS accepted FROM documents""")
def w4(v: Views) -> DataFrame:
    verdicts = co.archive_verdicts(co.expand_archives(_archives(v), co.ArchiveLimits(20000, 2)).drop("content"), co.ArchiveLimits(20000, 2))
    return verdicts.select("archive", "total_size", "member_count", "unsafe", "too_large", "accepted")


_PATHS = """p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'a/b.py' WHEN 1 THEN '../b.py' WHEN 2 THEN 'a/../b.py' WHEN 3 THEN 'a/../../b.py' WHEN 4 THEN '/etc/passwd' ELSE 'a/%2e%2E/x' END AS path FROM pages)"""


@query("p11_unsafe_paths", f"""WITH {_PATHS} SELECT page_id, path, path IN ('../b.py', 'a/../../b.py', '/etc/passwd') AS escapes, path <> 'a/b.py' AS bad_proxy FROM p""")
def p11(v: Views) -> DataFrame:
    p = v.sql("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'a/b.py' WHEN 1 THEN '../b.py' WHEN 2 THEN 'a/../b.py' WHEN 3 THEN 'a/../../b.py' WHEN 4 THEN '/etc/passwd' ELSE 'a/%2e%2E/x' END AS path FROM {pages}""")
    return p.select("page_id", "path", co.escapes_root(F.col("path")).alias("escapes"), co.bad_proxy_path(F.col("path")).alias("bad_proxy"))


# --- evaluation -----------------------------------------------------------------
@query("f17_f18_cwe_case", """SELECT file_path, upper(regexp_extract(file_path, '(?i)(BenchmarkTest[0-9]+)', 1)) AS test_case,
  CASE cwe_id WHEN '89' THEN 'CWE-89' WHEN 'cwe-78' THEN 'CWE-78' WHEN 'cwe 22' THEN 'CWE-22' ELSE '' END AS cwe FROM truth_findings""")
def f17(v: Views) -> DataFrame:
    return v.truth_findings.select("file_path", tx.test_case_id(F.col("file_path")).alias("test_case"), tx.normalise_cwe(F.col("cwe_id")).alias("cwe"))


_MATCH = """s AS (SELECT DISTINCT upper(regexp_extract(file_path, '(?i)(BenchmarkTest[0-9]+)', 1)) AS tc,
  CASE cwe_id WHEN '89' THEN 'CWE-89' WHEN 'cwe-78' THEN 'CWE-78' WHEN 'cwe 22' THEN 'CWE-22' ELSE '' END AS cwe FROM truth_findings),
m AS (SELECT t.*, s.tc IS NOT NULL AS has_match FROM truth t LEFT JOIN s ON upper(t.test_case_id) = s.tc AND t.cwe_id = s.cwe)"""


@query("j10_truth_match", f"WITH {_MATCH} SELECT test_case_id, is_vulnerable, cwe_id, has_match FROM m")
def j10(v: Views) -> DataFrame:
    return ev.match_truth(v.truth, v.truth_findings).select("test_case_id", "is_vulnerable", "cwe_id", "has_match")


@query("a14_accuracy", f"""WITH {_MATCH}, g AS (SELECT coalesce(cwe_id, 'ALL') AS cwe, CASE WHEN cwe_id IS NULL THEN 'Overall' ELSE min(category) END AS category,
  count(*) FILTER (is_vulnerable AND has_match) AS tp, count(*) FILTER (NOT is_vulnerable AND has_match) AS fp, count(*) FILTER (is_vulnerable AND NOT has_match) AS fn,
  count(*) FILTER (NOT is_vulnerable AND NOT has_match) AS tn, count(*) AS total FROM m GROUP BY ROLLUP (cwe_id)),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS q FROM g)
SELECT cwe, category, tp, fp, fn, tn, round(p, 6) AS "precision", round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 6) AS f1, total FROM r""")
def a14(v: Views) -> DataFrame:
    return ev.accuracy(v.truth, v.truth_findings).withColumns({n: F.round(n, 6) for n in ("precision", "recall", "f1")})


@query("s8_truth_csv", """SELECT 'Case' || doc_id AS test_case_id, toxic = 1 AS is_vulnerable, 'CWE-' || (doc_id % 100) AS cwe_id, CASE WHEN quality = 1 THEN 'Good, kind' ELSE '' END AS category FROM labels""")
def s8(v: Views) -> DataFrame:
    lines = v.sql("""SELECT ' Case' || CAST(doc_id AS STRING) || ',' || CASE WHEN toxic = 1 THEN 'TRUE ' ELSE 'false' END || ',' || CAST(doc_id % 100 AS STRING) ||
        CASE WHEN quality = 1 THEN ',"Good, kind"' ELSE '' END AS value FROM {labels}
      UNION ALL SELECT '# comment,' || CAST(doc_id AS STRING) || ',1' FROM {labels} UNION ALL SELECT 'short,' || CAST(doc_id AS STRING) FROM {labels} UNION ALL SELECT 'a,"b,c"' FROM {labels} UNION ALL SELECT '"#q",true,1' FROM {labels} UNION ALL SELECT '' FROM {labels}""")
    return xr.parse_truth(lines)


_ACCURACY_CELL = """'{"cwe":' || to_json(cwe) || ',"category":' || to_json(category) || ',"tp":' || tp || ',"fp":' || fp || ',"fn":' || fn || ',"tn":' || tn ||
  ',"precision":' || to_json(p) || ',"recall":' || to_json(r) || ',"f1":' || to_json(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END) || ',"total":' || n || '}'"""


@query("s15_accuracy_report", f"""WITH seen AS (SELECT DISTINCT upper(regexp_extract(file_path, '(?i)benchmarktest[0-9]+')) AS k, 'CWE-' || ltrim(regexp_extract(cwe_id, '[0-9]+'), '0') AS cwe FROM truth_findings WHERE regexp_extract(cwe_id, '[0-9]+') <> ''),
m AS (SELECT t.*, seen.k IS NOT NULL AS hit FROM truth t LEFT JOIN seen ON upper(t.test_case_id) = seen.k AND t.cwe_id = seen.cwe),
g AS (SELECT CASE WHEN grouping(cwe_id) = 1 THEN 'ALL' ELSE cwe_id END AS cwe, CASE WHEN grouping(cwe_id) = 1 THEN 'Overall' ELSE min(category) END AS category, count(*) FILTER (is_vulnerable AND hit) AS tp, count(*) FILTER (NOT is_vulnerable AND hit) AS fp,
  count(*) FILTER (is_vulnerable AND NOT hit) AS fn, count(*) FILTER (NOT is_vulnerable AND NOT hit) AS tn, count(*) AS n FROM m GROUP BY ROLLUP (cwe_id)),
h AS (SELECT *, CAST(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS DOUBLE) AS p, CAST(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS DOUBLE) AS r FROM g)
SELECT '{{"overall":' || max({_ACCURACY_CELL}) FILTER (cwe = 'ALL') || ',"per_cwe":[' || string_agg({_ACCURACY_CELL}, ',' ORDER BY cwe) FILTER (cwe <> 'ALL') || ']}}' AS report FROM h""")
def s15(v: Views) -> DataFrame:
    return ev.accuracy_report(ev.accuracy(v.truth, v.truth_findings))


# --- external reports -------------------------------------------------------------
_SHOW = ["scan_id", "title", "vuln_type", "severity", "cvss4_score", "confidence", "cwe_id", "owasp_category", "file_path", "line_start", "line_end", "rule_id", "source", "sink"]


@query("s4_semgrep_report", """SELECT CAST(l_orderkey AS VARCHAR) AS scan_id, CASE WHEN l_suppkey % 2 = 0 THEN 'msg' ELSE 'Semgrep finding' END AS title, 'Security Misconfiguration' AS vuln_type,
  CASE l_returnflag WHEN 'A' THEN 'High' WHEN 'N' THEN 'Medium' ELSE 'Medium' END AS severity, CAST(CASE WHEN l_returnflag = 'A' THEN 7.5 ELSE 5.0 END AS DOUBLE) AS cvss4_score,
  CAST(CASE WHEN l_linestatus = 'F' THEN 0.9 ELSE 0.8 END AS DOUBLE) AS confidence, 'CWE-' || l_linenumber AS cwe_id, CASE WHEN l_suppkey % 2 = 0 THEN 'A01' ELSE '' END AS owasp_category,
  'p' || l_partkey AS file_path, l_linenumber AS line_start, CASE WHEN l_suppkey % 2 = 0 THEN l_linenumber + 2 ELSE l_linenumber END AS line_end, 'r' || (l_partkey % 5) AS rule_id,
  '' AS source, '' AS sink, CASE WHEN l_suppkey % 2 = 0 THEN 'u1' || chr(10) || 'u2' ELSE 'u0' END AS refs FROM lineitem""")
def s4(v: Views) -> DataFrame:
    reports = v.sql("""SELECT CAST(l_orderkey AS STRING) AS scan_id, '{{"results":[{{"check_id":"r' || CAST(l_partkey % 5 AS STRING) || '","path":"p' || CAST(l_partkey AS STRING) || '","start":{{"line":' || CAST(l_linenumber AS STRING) || '}}' ||
      CASE WHEN l_suppkey % 2 = 0 THEN ',"end":{{"line":' || CAST(l_linenumber + 2 AS STRING) || '}}' ELSE '' END || ',"extra":{{' || CASE WHEN l_suppkey % 2 = 0 THEN '"message":"msg",' ELSE '' END ||
      '"severity":"' || CASE l_returnflag WHEN 'A' THEN 'ERROR' WHEN 'N' THEN 'WARNING' ELSE 'odd' END || '","lines":" x ","metadata":{{"cwe":' ||
      CASE WHEN l_suppkey % 2 = 0 THEN '["CWE-' || CAST(l_linenumber AS STRING) || '","CWE-0"],"owasp":["A01"],"references":["u1","u2"]' ELSE '"CWE-' || CAST(l_linenumber AS STRING) || '","references":"u0"' END ||
      ',"confidence":"' || CASE WHEN l_linestatus = 'F' THEN 'high' ELSE 'x' END || '"}}}}}}]}}' AS report FROM {lineitem}""")
    return xr.semgrep_findings(reports).select(*_SHOW, F.col("references").alias("refs"))


@query("s5_bandit_report", """SELECT CAST(l_orderkey AS VARCHAR) AS scan_id, 'text' AS title, 'tn' || (l_partkey % 3) AS vuln_type, CASE l_returnflag WHEN 'A' THEN 'High' WHEN 'N' THEN 'Low' ELSE 'Medium' END AS severity,
  CAST(CASE l_returnflag WHEN 'A' THEN 7.4 WHEN 'N' THEN 3.1 ELSE 5.4 END AS DOUBLE) AS cvss4_score, CAST(0.9 AS DOUBLE) AS confidence, '' AS cwe_id, 'A05:2021-Security Misconfiguration' AS owasp_category, 'p' || l_partkey AS file_path,
  l_linenumber AS line_start, l_linenumber AS line_end, CASE WHEN l_suppkey % 2 = 0 THEN 'B1' ELSE 'tn' || (l_partkey % 3) END AS rule_id, '' AS source, 'tn' || (l_partkey % 3) AS sink FROM lineitem""")
def s5(v: Views) -> DataFrame:
    reports = v.sql("""SELECT CAST(l_orderkey AS STRING) AS scan_id, '{{"results":[{{"filename":"p' || CAST(l_partkey AS STRING) || '","line_number":' || CAST(l_linenumber AS STRING) || ',' ||
      CASE WHEN l_suppkey % 2 = 0 THEN '"test_id":"B1",' ELSE '' END || '"test_name":"tn' || CAST(l_partkey % 3 AS STRING) || '","issue_text":"text","issue_severity":"' ||
      CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'low' ELSE 'odd' END || '","code":" c "}}]}}' AS report FROM {lineitem}""")
    return xr.bandit_findings(reports).select(*_SHOW)


@query("s6_eslint_report", """SELECT CAST(l_orderkey AS VARCHAR) AS scan_id, 'm' AS title, CASE WHEN l_suppkey % 2 = 0 THEN 'no-eval' ELSE 'JS/TS Security Issue' END AS vuln_type, CASE WHEN l_returnflag = 'A' THEN 'High' ELSE 'Medium' END AS severity,
  CAST(CASE WHEN l_returnflag = 'A' THEN 7.1 ELSE 5.2 END AS DOUBLE) AS cvss4_score, CAST(0.8 AS DOUBLE) AS confidence, '' AS cwe_id, 'A03:2021-Injection' AS owasp_category, 'p' || l_partkey AS file_path, l_linenumber AS line_start,
  l_linenumber AS line_end, CASE WHEN l_suppkey % 2 = 0 THEN 'no-eval' ELSE 'js/ts-security-issue' END AS rule_id, '' AS source, CASE WHEN l_suppkey % 2 = 0 THEN 'no-eval' ELSE '' END AS sink FROM lineitem""")
def s6(v: Views) -> DataFrame:
    reports = v.sql("""SELECT CAST(l_orderkey AS STRING) AS scan_id, '[{{"filePath":"p' || CAST(l_partkey AS STRING) || '","messages":[{{"ruleId":' || CASE WHEN l_suppkey % 2 = 0 THEN '"no-eval"' ELSE 'null' END ||
      ',"severity":' || CASE WHEN l_returnflag = 'A' THEN '2' ELSE '1' END || ',"message":"m","line":' || CAST(l_linenumber AS STRING) || '}}]}},{{"filePath":"none","messages":[]}}]' AS report FROM {lineitem}""")
    return xr.eslint_findings(reports).select(*_SHOW)


@query("s7_trivy_report", """SELECT CAST(l_orderkey AS VARCHAR) AS scan_id, CASE WHEN l_suppkey % 2 = 0 THEN 'T' ELSE 'CVE-' || l_partkey END AS title, 'Dependency Vulnerability' AS vuln_type,
  CASE l_returnflag WHEN 'A' THEN 'Critical' WHEN 'N' THEN 'High' ELSE 'Medium' END AS severity, CAST(CASE l_returnflag WHEN 'A' THEN 9.0 WHEN 'N' THEN 7.9 ELSE 5.1 END AS DOUBLE) AS cvss4_score, CAST(0.93 AS DOUBLE) AS confidence, '' AS cwe_id,
  'A06:2021-Vulnerable and Outdated Components' AS owasp_category, 'lock' || l_suppkey AS file_path, 1 AS line_start, 1 AS line_end, 'CVE-' || l_partkey AS rule_id, 'pkg@' || l_linenumber AS source, 'Known vulnerable dependency' AS sink FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'Secret detected', 'Hardcoded Secrets', CASE l_returnflag WHEN 'A' THEN 'Critical' WHEN 'N' THEN 'Unknown' ELSE 'High' END, CAST(8.0 AS DOUBLE), CAST(0.9 AS DOUBLE), 'CWE-798', 'A02:2021-Cryptographic Failures', 'lock' || l_suppkey,
  l_linenumber, l_linenumber, 'key', 'committed source file', 'secret material' FROM lineitem
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'Configuration issue', 'Security Misconfiguration', CASE WHEN l_returnflag = 'A' THEN 'High' ELSE 'Medium' END, CAST(CASE WHEN l_returnflag = 'A' THEN 7.0 ELSE 5.0 END AS DOUBLE), CAST(0.86 AS DOUBLE), 'CWE-16',
  'A05:2021-Security Misconfiguration', 'lock' || l_suppkey, 1, 1, 'DS1', 'lock' || l_suppkey, 'docker' FROM lineitem""")
def s7(v: Views) -> DataFrame:
    reports = v.sql("""SELECT CAST(l_orderkey AS STRING) AS scan_id, '{{"Results":[{{"Target":"lock' || CAST(l_suppkey AS STRING) || '","Vulnerabilities":[{{"VulnerabilityID":"CVE-' || CAST(l_partkey AS STRING) || '","PkgName":"pkg","InstalledVersion":"' ||
      CAST(l_linenumber AS STRING) || '","Severity":"' || CASE l_returnflag WHEN 'A' THEN 'CRITICAL' WHEN 'N' THEN 'HIGH' ELSE 'UNKNOWN' END || '"' || CASE WHEN l_suppkey % 2 = 0 THEN ',"Title":"T"' ELSE '' END ||
      '}}],"Secrets":[{{"RuleID":"key","StartLine":' || CAST(l_linenumber AS STRING) || CASE l_returnflag WHEN 'A' THEN ',"Severity":"CRITICAL"' WHEN 'N' THEN ',"Severity":"UNKNOWN"' ELSE '' END ||
      '}}],"Misconfigurations":[{{"ID":"DS1","Type":"docker","Severity":"' || CASE WHEN l_returnflag = 'A' THEN 'HIGH' ELSE 'odd' END || '"}}]}},{{"Target":"empty"}}]}}' AS report FROM {lineitem}""")
    return xr.trivy_findings(reports).select(*_SHOW)
