"""Severity, confidence, CVSS, category and risk-band expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskweave import fixed_values as fv
from riskweave.schemas import first_text, missing


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def ends_with_any(text: Column, tails: list[str]) -> Column:
    out = F.lit(False)
    for tail in tails:
        out = out | text.endswith(tail)
    return out


def lookup(key: Column, table: dict, default) -> Column:
    """Constant map lookup as a CASE, which stays inside generated code."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def blob(*cols: Column) -> Column:
    """Lower-cased text of several columns joined by single blanks, empties kept."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))


# F22 ----------------------------------------------------------------------
def severity_rank(severity: Column) -> Column:
    return lookup(severity, fv.SEVERITY_RANK, 0)


def severity_list_order(severity: Column) -> Column:
    return lookup(F.lower(severity), fv.LIST_ORDER, 99)


def severity_weight(severity: Column) -> Column:
    return lookup(severity, fv.SEVERITY_WEIGHT, 1)


# F23 ----------------------------------------------------------------------
def risk_band(percent: Column) -> Column:
    out = None
    for limit, name in fv.RISK_BANDS:
        out = F.when(percent >= limit, name) if out is None else out.when(percent >= limit, name)
    return out.otherwise("Low")


def gauge_band(score: Column) -> Column:
    safe = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    out = None
    for limit, name in fv.GAUGE_BANDS:
        out = F.when(safe >= limit, name) if out is None else out.when(safe >= limit, name)
    return out.otherwise("Low Risk")


# F8 -----------------------------------------------------------------------
def capitalise(text: Column) -> Column:
    """First character upper, the rest lower (blanks do not start a new word)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def semgrep_severity(raw: Column) -> Column:
    cap = capitalise(F.coalesce(raw, F.lit("MEDIUM")))
    named = lookup(cap, fv.SEMGREP_SEVERITY, cap)
    return F.when(named.isin("Critical", "High", "Medium", "Low"), named).otherwise("Medium")


def bandit_severity(raw: Column) -> Column:
    cap = capitalise(F.coalesce(raw, F.lit("MEDIUM")))
    return F.when(cap.isin("High", "Medium", "Low"), cap).otherwise("Medium")


def eslint_severity(level: Column) -> Column:
    return F.when(F.coalesce(level, F.lit(1)) == 2, "High").otherwise("Medium")


def trivy_severity(raw: Column) -> Column:
    cap = capitalise(F.coalesce(raw, F.lit("MEDIUM")))
    return F.when(cap.isin("Critical", "High", "Medium", "Low"), cap).otherwise("Medium")


def trivy_secret_severity(raw: Column) -> Column:
    return capitalise(F.coalesce(raw, F.lit("HIGH")))


# F9 -----------------------------------------------------------------------
def cvss_for(engine: str, severity: Column) -> Column:
    table = {
        "semgrep": ({"High": 7.5, "Critical": 7.5}, 5.0),
        "bandit": ({"High": 7.4, "Medium": 5.4}, 3.1),
        "eslint-security": ({"High": 7.1}, 5.2),
        "trivy": ({"Critical": 9.0, "High": 7.9}, 5.1),
        "trivy-misconfig": ({"High": 7.0}, 5.0),
    }
    by_severity, default = table[engine]
    return lookup(severity, by_severity, default)


# F10 ----------------------------------------------------------------------
def semgrep_confidence(raw: Column) -> Column:
    return lookup(F.upper(F.coalesce(raw, F.lit(""))), fv.SEMGREP_CONFIDENCE, fv.SEMGREP_CONFIDENCE_DEFAULT)


# F1 -----------------------------------------------------------------------
def scan_category(engine: Column, title: Column, vuln_type: Column, file_path: Column) -> Column:
    text = blob(engine, title, vuln_type, file_path)
    out = None
    for eng, name in fv.CATEGORY_BY_ENGINE.items():
        out = F.when(engine == eng, name) if out is None else out.when(engine == eng, name)
    return (
        out.when(text.contains("dependency"), "Dependency scan")
        .when(contains_any(text, fv.SECRET_WORDS), "Secret scan")
        .when(ends_with_any(F.lower(file_path), fv.CONFIG_SUFFIXES), "Config scan")
        .when(contains_any(text, fv.CONFIG_WORDS), "Config scan")
        .otherwise(fv.DEFAULT_CATEGORY)
    )


# F2 / F3 ------------------------------------------------------------------
def _ladder(existing: Column, text: Column, needles) -> Column:
    first = None
    for needle, label in needles:
        hit = text.contains(needle)
        first = F.when(hit, label) if first is None else first.when(hit, label)
    return F.coalesce(missing(existing), first, F.lit(""))


def source_label(existing: Column, text: Column) -> Column:
    return _ladder(existing, text, fv.SOURCE_NEEDLES)


def sink_label(existing: Column, text: Column) -> Column:
    return _ladder(existing, text, fv.SINK_NEEDLES)


# F6 -----------------------------------------------------------------------
def rule_id_or_default(rule_id: Column, category: Column, engine: Column, cwe: Column, vuln_type: Column) -> Column:
    dashed = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("-"))
    tail = F.coalesce(F.lower(missing(cwe)), dashed(vuln_type))
    made = F.concat_ws(".", lookup(category, fv.CATEGORY_PREFIX, "rule"), dashed(engine), tail)
    return F.coalesce(missing(rule_id), made)


# F12 ----------------------------------------------------------------------
def calibrate(severity, cvss, confidence, category, title, vuln_type, snippet, source, sink, evidence, poc) -> Column:
    """Evidence-based calibration: struct(severity, cvss, confidence)."""
    text = blob(title, vuln_type, snippet, source, sink)
    injection = contains_any(text, fv.INJECTION_WORDS)
    has_source, has_sink = source != "", sink != ""
    known_secret = first_text(evidence, snippet).rlike(fv.RECOGNISED_SECRET)
    odd_secret = (category == "Secret scan") & ~known_secret
    # an unrecognised secret ends the ladder, so dependencies are looked at last
    unproven_dep = (category == "Dependency scan") & ~F.concat_ws(" ", title, poc).contains("CVE-")

    def triple(s, v, c):
        return F.struct(
            (s if isinstance(s, Column) else F.lit(s)).alias("severity"),
            v.alias("cvss"), c.alias("confidence"),
        )

    clamp = lambda lo, hi: F.least(F.greatest(cvss, F.lit(lo)), F.lit(hi))
    return (
        F.when(injection & has_source & has_sink & (confidence >= 0.82),
               triple("Critical", F.greatest(cvss, F.lit(9.0)), confidence))
        .when(injection & has_source & has_sink, triple("High", clamp(7.0, 8.9), confidence))
        .when(injection & has_sink, triple("Medium", clamp(5.0, 6.9), F.least(confidence, F.lit(0.72))))
        .when(injection, triple("Low", F.least(cvss, F.lit(3.9)), F.least(confidence, F.lit(0.55))))
        .when(odd_secret, triple("Medium", F.least(cvss, F.lit(6.9)), confidence))
        .when(unproven_dep & severity.isin("Critical", "High"), triple("Medium", cvss, confidence))
        .otherwise(triple(severity, cvss, confidence))
    )


# F19 ----------------------------------------------------------------------
def sarif_level(severity: Column, flavour: str = "service") -> Column:
    if flavour == "service":
        exact = {name.capitalize(): level for name, level in fv.SARIF_LEVELS.items()}
        return lookup(severity, exact, "warning")
    return lookup(F.lower(severity), fv.SARIF_LEVELS, "none")


# F33 ----------------------------------------------------------------------
def attack_surface(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """array<struct<category,count>>: six linear forms of the severity counts."""
    total = critical + high + medium + low
    times = F.when(total > 0, F.lit(1.0)).otherwise(F.lit(float(fv.SURFACE_EMPTY_MULTIPLIER)))
    rows = []
    for label, floor, factor, weights in fv.SURFACE_FORMS:
        form = None
        for part, weight in zip((critical, high, medium, low), weights):
            if weight:
                term = part.cast("double") * F.lit(weight)
                form = term if form is None else form + term
        value = F.floor(F.round(form * times * F.lit(factor), 9) + 0.5)
        rows.append(F.struct(F.lit(label).alias("category"),
                             F.greatest(F.lit(floor).cast("bigint"), value).alias("count")))
    return F.array(*rows)
