"""Readers of external scanner reports (JSON text, one report a row).

Each takes (scan_id, report) and gives raw findings.  Shapes are declared, never
inferred; absent keys take the published defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave import fixed_values as fv
from riskweave.functions import scoring as sc, text as tx
from riskweave.schemas import as_raw_findings, first_text, missing, seq


def read_report_files(spark: SparkSession, root: str) -> DataFrame:
    """Report files below root, named <scan_id>.json, as (scan_id, report)."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return raw.select(name.alias("scan_id"), F.col("value").alias("report"))


def _or(col: Column, default: str) -> Column:
    return F.coalesce(col, F.lit(default))


def _lits(text: dict, names: list[str]) -> list[Column]:
    return [F.lit(text[n]).alias(n) for n in names]


_ADVICE = ["attack_scenario", "poc", "remediation", "secure_example"]

# S4 / F11 -----------------------------------------------------------------
_SEMGREP = """struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,
  end:struct<line:int>,extra:struct<message:string,severity:string,lines:string,dataflow_trace:string,
  metadata:struct<cwe:string,owasp:string,vulnerability_class:string,confidence:string,impact:string,
  pentest_hint:string,references:string>>>>>"""


def scalar_or_first(raw: Column) -> Column:
    """Text that may hold a JSON list: its first element, else the text itself."""
    as_list = F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>"))
    return F.when(as_list.isNotNull(), F.coalesce(F.get(as_list, F.lit(0)), F.lit(""))).otherwise(_or(raw, ""))


def scalar_or_joined(raw: Column) -> Column:
    as_list = F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>"))
    return F.when(as_list.isNotNull(), F.array_join(as_list, "\n")).otherwise(_or(raw, ""))


def semgrep_findings(reports: DataFrame) -> DataFrame:
    t = fv.SEMGREP_TEXT
    rows = reports.select("scan_id", F.posexplode(F.from_json("report", _SEMGREP)["results"]).alias("n", "r"))
    meta, extra = F.col("r.extra.metadata"), F.col("r.extra")
    severity = sc.semgrep_severity(extra["severity"])
    lines = tx.strip(_or(extra["lines"], ""))
    start = F.coalesce(F.col("r.start.line"), F.lit(1))
    return as_raw_findings(rows.select(
        "scan_id", seq(0, F.lit(""), 0, F.col("n")).alias("seq"), F.lit("semgrep").alias("engine"),
        _or(extra["message"], t["title"]).alias("title"),
        _or(meta["vulnerability_class"], t["vuln_type"]).alias("vuln_type"),
        severity.alias("severity"), sc.cvss_for("semgrep", severity).alias("cvss4_score"),
        sc.semgrep_confidence(meta["confidence"]).alias("confidence"),
        scalar_or_first(meta["cwe"]).alias("cwe_id"), scalar_or_first(meta["owasp"]).alias("owasp_category"),
        _or(F.col("r.path"), "").alias("file_path"), start.alias("line_number"), start.alias("line_start"),
        F.coalesce(F.col("r.end.line"), start).alias("line_end"),
        lines.alias("code_snippet"), lines.alias("evidence"),
        F.coalesce(missing(tx.strip(_or(meta["impact"], ""))), F.lit(t["impact"])).alias("impact"),
        F.coalesce(missing(tx.strip(_or(meta["pentest_hint"], ""))), F.lit(t["pentest_hint"])).alias("pentest_hint"),
        scalar_or_joined(meta["references"]).alias("references"),
        *_lits(t, _ADVICE), _or(F.col("r.check_id"), "").alias("rule_id"),
        _or(extra["dataflow_trace"], "").alias("dataflow_trace"),
    ))


# S5 -----------------------------------------------------------------------
_BANDIT = """struct<results:array<struct<filename:string,line_number:int,test_id:string,test_name:string,
  issue_text:string,issue_severity:string,code:string>>>"""


def bandit_findings(reports: DataFrame) -> DataFrame:
    t = fv.BANDIT_TEXT
    rows = reports.select("scan_id", F.posexplode(F.from_json("report", _BANDIT)["results"]).alias("n", "r"))
    r = lambda name: F.col(f"r.{name}")
    severity = sc.bandit_severity(r("issue_severity"))
    return as_raw_findings(rows.select(
        "scan_id", seq(1, F.lit(""), 0, F.col("n")).alias("seq"), F.lit("bandit").alias("engine"),
        _or(r("issue_text"), t["title"]).alias("title"), _or(r("test_name"), t["vuln_type"]).alias("vuln_type"),
        severity.alias("severity"), sc.cvss_for("bandit", severity).alias("cvss4_score"),
        F.lit(t["confidence"]).alias("confidence"), F.lit(t["owasp"]).alias("owasp_category"),
        _or(r("filename"), "").alias("file_path"), F.coalesce(r("line_number"), F.lit(1)).alias("line_number"),
        tx.strip(_or(r("code"), "")).alias("code_snippet"), *_lits(t, _ADVICE),
        F.coalesce(r("test_id"), r("test_name"), F.lit("")).alias("rule_id"),
        _or(r("test_name"), "").alias("sink"), _or(r("issue_text"), "").alias("why_vulnerable"),
    ))


# S6 -----------------------------------------------------------------------
_ESLINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int>>>>"


def eslint_findings(reports: DataFrame) -> DataFrame:
    t = fv.ESLINT_TEXT
    files = reports.select("scan_id", F.posexplode(F.from_json("report", _ESLINT)).alias("f", "file"))
    rows = files.select("scan_id", "f", F.col("file.filePath").alias("path"),
                        F.posexplode("file.messages").alias("n", "m"))
    severity = sc.eslint_severity(F.col("m.severity"))
    rule = _or(F.col("m.ruleId"), "")
    return as_raw_findings(rows.select(
        "scan_id", seq(2, F.lit(""), F.col("f"), F.col("n")).alias("seq"),
        F.lit("eslint-security").alias("engine"), _or(F.col("m.message"), t["title"]).alias("title"),
        F.coalesce(missing(rule), F.lit(t["vuln_type"])).alias("vuln_type"), severity.alias("severity"),
        sc.cvss_for("eslint-security", severity).alias("cvss4_score"), F.lit(t["confidence"]).alias("confidence"),
        F.lit(t["owasp"]).alias("owasp_category"), _or(F.col("path"), "").alias("file_path"),
        F.coalesce("m.line", F.lit(1)).alias("line_number"), *_lits(t, _ADVICE),
        rule.alias("rule_id"), rule.alias("sink"), _or(F.col("m.message"), "").alias("why_vulnerable"),
    ))


# S7 -----------------------------------------------------------------------
# the three lists share one item shape, so that they open as rows of one column; a kind reads its own fields
_TRIVY_ITEM = """struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,PrimaryURL:string,
  Severity:string,Title:string,RuleID:string,StartLine:int,Match:string,Code:struct<Lines:string>,Category:string,
  ID:string,Type:string,Message:string,Description:string,Resolution:string,CauseMetadata:struct<StartLine:int>>"""
_TRIVY = f"""struct<Results:array<struct<Target:string,Vulnerabilities:array<{_TRIVY_ITEM}>,Secrets:array<{_TRIVY_ITEM}>,
  Misconfigurations:array<{_TRIVY_ITEM}>>>>"""


def trivy_findings(reports: DataFrame) -> DataFrame:
    """Vulnerabilities, secrets and misconfigurations of every target, in that order.

    The report is parsed once and its lists are opened as rows; what an item says is then worked out a row,
    in generated code, and fields nobody asks for are not.
    """
    results = reports.select("scan_id", F.posexplode(F.from_json("report", _TRIVY)["Results"]).alias("n", "r"))
    v, s, m = fv.TRIVY_VULN_TEXT, fv.TRIVY_SECRET_TEXT, fv.TRIVY_MISCONFIG_TEXT
    target = _or(F.col("file_path"), "")

    def vuln(x):
        severity = sc.trivy_severity(x["Severity"])
        package = F.concat(_or(x["PkgName"], ""), F.lit("@"), _or(x["InstalledVersion"], ""))
        return {
            "title": F.coalesce(missing(x["Title"]), x["VulnerabilityID"], F.lit(v["title"])),
            "vuln_type": F.lit(v["vuln_type"]), "severity": severity,
            "cvss4_score": sc.cvss_for("trivy", severity), "confidence": F.lit(v["confidence"]),
            "cwe_id": F.lit(""), "owasp_category": F.lit(v["owasp"]), "line_number": F.lit(1),
            "code_snippet": package, "attack_scenario": F.lit(v["attack_scenario"]),
            "poc": _or(x["PrimaryURL"], v["poc"]), "remediation": F.lit(v["remediation"]),
            "secure_example": F.concat(F.lit("Upgrade to "), _or(x["FixedVersion"], v["fixed_version"])),
            "rule_id": _or(x["VulnerabilityID"], ""), "scan_category": F.lit("Dependency scan"),
            "source": package, "sink": F.lit(v["sink"]),
            "why_vulnerable": F.concat(
                F.lit("Dependency "), _or(x["PkgName"], ""), F.lit(" version "), _or(x["InstalledVersion"], ""),
                F.lit(" matches advisory "), _or(x["VulnerabilityID"], ""), F.lit(".")),
        }

    def secret(x):
        return {
            "title": _or(x["Title"], s["title"]), "vuln_type": F.lit(s["vuln_type"]),
            "severity": sc.trivy_secret_severity(x["Severity"]), "cvss4_score": F.lit(s["cvss"]),
            "confidence": F.lit(s["confidence"]), "cwe_id": F.lit(s["cwe_id"]),
            "owasp_category": F.lit(s["owasp"]), "line_number": F.coalesce(x["StartLine"], F.lit(1)),
            "code_snippet": F.coalesce(x["Match"], x["Code"]["Lines"], F.lit("")),
            "attack_scenario": F.lit(s["attack_scenario"]), "poc": _or(x["RuleID"], s["poc"]),
            "remediation": F.lit(s["remediation"]), "secure_example": F.lit(s["secure_example"]),
            "rule_id": _or(x["RuleID"], ""), "scan_category": F.lit("Secret scan"),
            "source": F.lit(s["source"]), "sink": _or(x["Category"], s["sink"]), "why_vulnerable": F.lit(s["why"]),
        }

    def misconfig(x):
        severity = sc.trivy_severity(x["Severity"])
        return {
            "title": _or(x["Title"], m["title"]), "vuln_type": F.lit(m["vuln_type"]), "severity": severity,
            "cvss4_score": sc.cvss_for("trivy-misconfig", severity), "confidence": F.lit(m["confidence"]),
            "cwe_id": F.lit(m["cwe_id"]), "owasp_category": F.lit(m["owasp"]),
            "line_number": F.coalesce(x["CauseMetadata"]["StartLine"], F.lit(1)),
            "code_snippet": _or(x["Message"], ""), "attack_scenario": F.lit(m["attack_scenario"]),
            "poc": _or(x["ID"], m["poc"]), "remediation": _or(x["Resolution"], m["remediation"]),
            "secure_example": _or(x["Resolution"], m["secure_example"]), "rule_id": _or(x["ID"], ""),
            "scan_category": F.lit("Config scan"), "source": target, "sink": _or(x["Type"], m["sink"]),
            "why_vulnerable": F.coalesce(x["Description"], x["Message"], F.lit("")),
        }

    lists = results.select("scan_id", "n", _or(F.col("r.Target"), "").alias("file_path"), F.posexplode(
        F.array("r.Vulnerabilities", "r.Secrets", "r.Misconfigurations")).alias("kind", "items"))
    flat = lists.select("scan_id", "n", "file_path", "kind", F.posexplode("items").alias("pos", "i"))
    item, kind = F.col("i"), F.col("kind")
    of = [fields(item) for fields in (vuln, secret, misconfig)]
    said = [F.when(kind == 0, of[0][name]).when(kind == 1, of[1][name]).otherwise(of[2][name]).alias(name) for name in of[0]]
    return as_raw_findings(flat.select(
        "scan_id", "file_path", seq(4, F.lpad(F.col("n").cast("string"), 9, "0"), kind, F.col("pos")).alias("seq"),
        F.lit("trivy").alias("engine"), *said))


# S8 -----------------------------------------------------------------------
def parse_truth(lines: DataFrame) -> DataFrame:
    """Ground truth from CSV lines in column `value`."""
    cells = F.from_csv("value", "c0 string, c1 string, c2 string, c3 string", {"mode": "PERMISSIVE", "emptyValue": "", "nullValue": "\u0000"})
    # fields count once the line is parsed: a quoted comma parts nothing, a quoted '#' is a comment too
    return (
        lines.filter(F.col("value") != "").select(cells.alias("c"))
        .filter(~F.coalesce("c.c0", F.lit("")).startswith("#") & F.col("c.c2").isNotNull())
        .select(
            tx.strip(F.col("c.c0")).alias("test_case_id"),
            (F.lower(tx.strip(F.coalesce("c.c1", F.lit("")))) == "true").alias("is_vulnerable"),
            tx.normalise_cwe(F.col("c.c2")).alias("cwe_id"),
            tx.strip(F.coalesce("c.c3", F.lit(""))).alias("category"),
        )
    )


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return parse_truth(spark.read.text(path))
