"""The full scan: corpus in, scored findings out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.operators import detection as d, enrichment as en, risk, triage as tr
from riskweave.operators.analytics import scan_durations
from riskweave.operators.dedupe import deduplicate
from riskweave.operators.governance import reopened_events, scan_notifications
from riskweave.operators.history import carry_forward
from riskweave.session import stage as write_stage
from riskweave.sources import sinks


def built_in_findings(hits: DataFrame, files: DataFrame | None = None,
                      advisories: DataFrame | None = None) -> DataFrame:
    """Findings of all built-in detectors from the hits of one corpus pass."""
    parts = [d.taint_findings_of(hits), d.js_sink_findings_of(hits), d.pattern_findings_of(hits),
             d.secret_findings_of(hits)]
    if advisories is not None:
        parts.append(d.advisory_findings(d.dependencies(files), advisories))
    return en.union_engines(*parts)


def scan(files: DataFrame, scans: DataFrame, policies: DataFrame | None = None,
         advisories: DataFrame | None = None, verdicts: DataFrame | None = None,
         external: DataFrame | None = None, triage: str = "none", strict: bool = False,
         stage: Callable[[DataFrame, str], DataFrame] = write_stage) -> tuple[DataFrame, DataFrame]:
    """(findings, risk) for every scan at once.

    scans: scan_id, source_type, source_value and, with policies, project_id.
    triage: none, heuristic or verdicts.

    The corpus is read once and never shuffled: its hits, with their surrounding lines,
    are staged as a small table that the taint pairing, the correlation and the fold
    read.  The enriched findings are staged a second time because the fold looks at
    them three times.
    """
    hits = stage(d.rule_hits(files, strict=strict), "hits")
    found = built_in_findings(hits, files, advisories)
    if external is not None:
        found = en.union_engines(en.attach_context(external, files, strict).select(*found.columns), found)
    head = scans.select("scan_id", "source_type", "source_value", *(["project_id"] if policies is not None else []))
    if policies is not None:
        ruled = en.with_policy(head, policies).drop("source_type", "source_value")
        found = en.keep_enabled_engines(found.join(ruled, "scan_id", "left"))
        found = en.apply_rule_overrides(found).drop(*[c for c in ruled.columns if c != "scan_id"])
    # findings of a scan that `scans` does not hold stay, with an empty head
    headed = en.correlate(found).join(head.drop("project_id"), "scan_id", "left").fillna("", ["source_type", "source_value"])
    enriched = stage(en.enrich(headed), "enriched")
    out = deduplicate(enriched)
    if triage == "heuristic":
        out = tr.heuristic_triage(out)
    elif triage == "verdicts":
        out = tr.apply_verdicts(stage(out, "folded"), verdicts)
    out = tr.floor_confidence(out)
    if policies is not None:
        limits = en.with_policy(head, policies).select("scan_id", "policy_threshold")
        out = en.at_least(out.join(limits, "scan_id", "left"), F.col("policy_threshold")).drop("policy_threshold")
    out = stage(out, "findings")
    return out, risk.scan_risk(out, scans)


def scan_job(files: DataFrame, scans: DataFrame, history: DataFrame, notifications: DataFrame, as_of: Column,
             path: str | None = None, **options) -> dict[str, DataFrame]:
    """A scan from its files to what is stored and told, for every scan at once.

    scans: scan_id, project_id, triggered_by, source_type, source_value, started_at.  history: earlier
    findings (J1).  Gives findings (with the state carried over), scans (completed, with risk, language
    and framework maps and duration), events and notifications not told before.  With a path, findings
    are written below it (replacing those of these scans) and events appended.
    """
    found, risks = scan(files, scans, **options)
    projects = scans.select("scan_id", "project_id")
    named = found.drop("project_id").join(projects, "scan_id", "left").withColumns(
        {"id": F.concat_ws("-", F.col("scan_id").cast("string"), F.substring(F.sha2(F.to_json("seq"), 256), 1, 16)), "created_at": as_of})
    carried = write_stage(carry_forward(named, history), "carried")
    # the risk is that of the findings as carried: dismissed ones stay in, as in the scan itself
    done = (
        scans.join(risks, "scan_id", "left").join(d.language_summary(files, scans), "scan_id", "left")
        .join(d.framework_summary(files, scans), "scan_id", "left")
        .withColumns({"status": F.lit("completed"), "completed_at": as_of})
    )
    done = write_stage(scan_durations(done), "done")
    events = done.select("scan_id", F.lit("completed").alias("event_type"),
                         F.concat(F.lit("Scan completed with risk "), "risk_level").alias("message"), as_of.alias("created_at"))
    if path is not None:
        sinks.write_findings(carried, scans, f"{path}/findings")
        sinks.append_scan_events(events, f"{path}/scan_events")
    return {"findings": carried, "scans": done, "events": events, "reopened": reopened_events(carried),
            "notifications": scan_notifications(done, notifications)}
