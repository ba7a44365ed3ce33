"""Correlation and enrichment of raw findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave import fixed_values as fv
from riskweave.functions import scoring as sc, text as tx
from riskweave.operators.detection import RULES_OF, enclosing_function, function_names, line_window, split_lines
from riskweave.schemas import as_raw_findings, missing, seq


# U3 -----------------------------------------------------------------------
def union_engines(*engine_outputs: DataFrame) -> DataFrame:
    """Outputs of several engines as one; `seq` already carries the engine order."""
    out = engine_outputs[0]
    for more in engine_outputs[1:]:
        out = out.unionByName(more)
    return out


def engine_places(hits: DataFrame) -> DataFrame:
    """scan_id, file_path, seq, rule_id of the findings of `detection.rule_hits`, as the union of the engines has them.

    For questions of order alone: hits of all families come from one pass, and no text of a finding is made.
    """
    rule_id = F.lit(None).cast("string")
    for family, rules in RULES_OF.items():
        rule_id = F.when(F.col("family") == family, sc.lookup(F.col("rule"), {i: r["rule_id"] for i, r in enumerate(rules)}, F.lit(None))).otherwise(rule_id)
    return hits.select("scan_id", F.coalesce("file_path", F.lit("")).alias("file_path"), seq(F.col("family"), F.col("file_path"), F.col("rule"), F.col("pos")).alias("seq"), rule_id.alias("rule_id"))


# P8 / J16 -----------------------------------------------------------------
def policy_engine(engine: Column) -> Column:
    return sc.lookup(engine, fv.ENGINE_TO_POLICY, F.lit(None).cast("string"))


def with_policy(df: DataFrame, policies: DataFrame, key: str = "project_id") -> DataFrame:
    """Scanner policy columns per row, defaults where a project has none."""
    p = policies.select(
        key,
        F.coalesce(tx.json_string_array(F.col("enabled_engines"), []), F.array().cast("array<string>")).alias("policy_engines"),
        F.coalesce("severity_threshold", F.lit("Info")).alias("policy_threshold"),
        F.coalesce("ai_triage_enabled", F.lit(True)).alias("policy_ai_triage"),
        F.coalesce("secret_verification_enabled", F.lit(False)).alias("policy_verify_secrets"),
        tx.json_object(F.col("rule_overrides")).alias("policy_overrides"),
    )
    return df.join(p, key, "left").withColumns({
        "policy_engines": F.coalesce("policy_engines", F.array().cast("array<string>")),
        "policy_threshold": F.coalesce("policy_threshold", F.lit("Info")),
        "policy_ai_triage": F.coalesce("policy_ai_triage", F.lit(True)),
        "policy_verify_secrets": F.coalesce("policy_verify_secrets", F.lit(False)),
        "policy_overrides": F.coalesce("policy_overrides", F.create_map().cast("map<string,string>")),
    })


def serialised_policy(policies: DataFrame) -> DataFrame:
    """Policies as the dashboard shows them: absent or broken engine lists mean all."""
    return policies.select(
        "project_id",
        tx.json_string_array(F.col("enabled_engines"), fv.POLICY_ENGINES).alias("enabled_engines"),
        F.coalesce("severity_threshold", F.lit("Info")).alias("severity_threshold"),
        F.coalesce("ai_triage_enabled", F.lit(True)).alias("ai_triage_enabled"),
        F.coalesce("secret_verification_enabled", F.lit(False)).alias("secret_verification_enabled"),
        tx.json_object(F.col("rule_overrides")).alias("rule_overrides"),
    )


def keep_enabled_engines(findings: DataFrame) -> DataFrame:
    """Findings of enabled engines; an empty list enables every engine."""
    eng = policy_engine(F.col("engine"))
    return findings.filter((F.size("policy_engines") == 0) | eng.isNull() | F.array_contains("policy_engines", eng))


def apply_rule_overrides(findings: DataFrame) -> DataFrame:
    """Honour {rule_id: {enabled, severity}} of the policy."""
    o = F.from_json(F.try_element_at("policy_overrides", F.col("rule_id")), "struct<enabled:boolean,severity:string>")
    return (findings.withColumn("_o", o).filter(F.coalesce(F.col("_o.enabled"), F.lit(True)))
            .withColumn("severity", F.coalesce("_o.severity", "severity")).drop("_o"))


# P7 -----------------------------------------------------------------------
def at_least(findings: DataFrame, threshold: Column) -> DataFrame:
    """Findings whose severity reaches the threshold (unknown names rank lowest)."""
    return findings.filter(sc.severity_rank(F.col("severity")) >= sc.severity_rank(threshold))


# J11 ----------------------------------------------------------------------
def is_ssrf(vuln_type: Column, owasp: Column) -> Column:
    return F.lower(vuln_type).contains("ssrf") | owasp.contains("A10")


def leaks_secret(vuln_type: Column, title: Column) -> Column:
    return vuln_type.isin(*fv.CHAIN_SECRET_TYPES) | F.lower(title).contains("api key")


def attack_chains(findings: DataFrame) -> DataFrame:
    """One chained finding per scan that has a leaked secret and an SSRF finding."""
    carried = [c for c in ("context", "context_function") if c in findings.columns]
    ref = F.when(is_ssrf(F.col("vuln_type"), F.col("owasp_category")),
                 F.struct("seq", "file_path", "line_start", "code_snippet", "evidence", *carried))
    per_scan = findings.groupBy("scan_id").agg(
        F.max(leaks_secret(F.col("vuln_type"), F.col("title"))).alias("leak"), F.min(ref).alias("ref"))
    hit = per_scan.filter(F.col("leak") & F.col("ref").isNotNull())
    return as_raw_findings(hit.select(
        "scan_id", seq(6, F.lit(""), 0, 0).alias("seq"),
        *[F.lit(v).alias(k) for k, v in fv.ATTACK_CHAIN.items()],
        F.col("ref.file_path").alias("file_path"), F.col("ref.line_start").alias("line_number"),
        F.col("ref.code_snippet").alias("code_snippet"), F.col("ref.evidence").alias("evidence"),
        *[F.col(f"ref.{c}").alias(c) for c in carried],
    ))


def correlate(findings: DataFrame) -> DataFrame:
    return findings.unionByName(attack_chains(findings))


# J15 / F4 / F5 -------------------------------------------------------------
def attach_context(findings: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """Context window and enclosing function for findings that came without them.

    Used for external reports only.  Findings are first reduced to the distinct line ranges of
    each file; only that list meets the bodies, in one join, and each body is split into lines
    once.  What comes back to the findings are contexts, one for each distinct range.
    """
    place = ["scan_id", "file_path"]
    ranges = findings.groupBy(*place).agg(F.collect_set(F.struct("line_start", "line_end")).alias("_ranges"))
    lines = (
        files.join(ranges, place).select(*place, "_ranges", split_lines(F.col("content")).alias("_lines"))
        .withColumn("_names", function_names(F.col("_lines"), strict))
        .select(*place, "_lines", "_names", F.explode("_ranges").alias("_r"))
    )
    at = F.greatest(F.least(F.col("_r.line_start"), F.size("_lines")), F.lit(1))
    found = lines.select(
        *[F.col(c).alias(f"_{c}") for c in place], F.col("_r.line_start").alias("_start"), F.col("_r.line_end").alias("_end"),
        line_window(F.col("_lines"), F.col("_r.line_start"), F.col("_r.line_end")).alias("context"),
        enclosing_function(F.col("_names"), at).alias("context_function"))
    same = ((F.col("scan_id") == F.col("_scan_id")) & (F.col("file_path") == F.col("_file_path"))
            & F.col("line_start").eqNullSafe(F.col("_start")) & F.col("line_end").eqNullSafe(F.col("_end")))
    return findings.drop("context", "context_function").join(found, same, "left").drop("_scan_id", "_file_path", "_start", "_end").withColumns(
        {"context": F.coalesce("context", F.lit("")), "context_function": F.coalesce("context_function", F.lit(""))})


# Enrichment, in its fixed order -------------------------------------------
def enrich(findings: DataFrame) -> DataFrame:
    """Category, source and sink, function, snippet, rule id, explanation, severity,
    evidence and link.  Needs columns context, context_function, source_type, source_value.

    Order matters: the category sees the raw snippet, source and sink see snippet and
    context, the calibration sees the widened snippet.
    """
    c = F.col
    text = sc.blob(c("title"), c("vuln_type"), c("code_snippet"), c("context"))
    step1 = findings.withColumns({
        "scan_category": sc.scan_category(c("engine"), c("title"), c("vuln_type"), c("file_path")),
        "source": sc.source_label(c("source"), text),
        "sink": sc.sink_label(c("sink"), text),
        "function_name": F.coalesce(missing(c("function_name")), c("context_function"), F.lit("")),
        "code_snippet": tx.widened_snippet(c("code_snippet"), c("context")),
    })
    step2 = step1.withColumns({
        "rule_id": sc.rule_id_or_default(c("rule_id"), c("scan_category"), c("engine"), c("cwe_id"), c("vuln_type")),
        "why_vulnerable": tx.default_explanation(c("why_vulnerable"), c("scan_category"), c("engine"), c("source"),
                                                 c("sink"), c("attack_scenario")),
        "_cal": sc.calibrate(c("severity"), c("cvss4_score"), c("confidence"), c("scan_category"), c("title"),
                             c("vuln_type"), c("code_snippet"), c("source"), c("sink"), c("evidence"), c("poc")),
    })
    return step2.withColumns({
        "severity": c("_cal.severity"), "cvss4_score": c("_cal.cvss"), "confidence": c("_cal.confidence"),
        "evidence": tx.default_evidence(c("evidence"), c("code_snippet")),
        "code_link": tx.code_link(c("source_type"), c("source_value"), c("file_path"), c("line_start"), c("line_end")),
    }).drop("_cal", "context", "context_function", "source_type", "source_value")
