"""Text expressions: masking, links, labels, tolerant JSON, dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskweave import fixed_values as fv
from riskweave.schemas import first_text, missing

# Masking patterns.  Java's case-insensitive flag stands in for /i.
_LONG_WORD = r"([a-zA-Z0-9_-]{4})[a-zA-Z0-9_-]{8,}([a-zA-Z0-9_-]{4})"
# The kept four leading characters of an assignment are read by lookahead: the
# name part may be shorter than four, so they can reach into the '=' or value.
_ASSIGNMENT_MASK = (
    r"(?i)(?<![A-Za-z0-9_])(?=([\s\S]{4}))[A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD)[A-Z0-9_]*\s*=\s*"
    r"[a-zA-Z0-9_-]{12,}([a-zA-Z0-9_-]{4})"
)


# F16 ----------------------------------------------------------------------
def mask_secrets(text: Column) -> Column:
    """Shorten credential assignments, then every long token, to 4 + ... + 4."""
    value = F.coalesce(text, F.lit(""))
    assigned = F.regexp_replace(value, _ASSIGNMENT_MASK, "$1...$2")
    return F.regexp_replace(assigned, _LONG_WORD, "$1...$2")


def mask_long_tokens(text: Column) -> Column:
    """Second half of the masking alone: words of sixteen or more characters."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _LONG_WORD, "$1...$2")


# F13 ----------------------------------------------------------------------
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def widened_snippet(snippet: Column, context: Column) -> Column:
    use = (context != "") & (snippet != "") & (newline_count(context) <= 24)
    return F.when(use, strip(context)).otherwise(snippet)


def default_evidence(evidence: Column, snippet: Column) -> Column:
    return F.coalesce(missing(evidence), snippet)


# F14 ----------------------------------------------------------------------
def default_explanation(why, category, engine, source, sink, scenario) -> Column:
    made = F.concat(
        category, F.lit(" finding from "), engine, F.lit(". Source: "),
        F.coalesce(missing(source), F.lit("not proven")), F.lit("; sink: "),
        F.coalesce(missing(sink), F.lit("not proven")), F.lit(". "), scenario,
    )
    return F.coalesce(missing(why), made)


# F15 ----------------------------------------------------------------------
def code_link(source_type: Column, source_value: Column, path: Column, start: Column, end: Column) -> Column:
    value = F.coalesce(source_value, F.lit(""))
    base = F.regexp_replace(F.regexp_replace(value, "/$", ""), r"\.git$", "")
    lines = F.concat(
        F.lit("#L"), start.cast("string"),
        F.when(end > start, F.concat(F.lit("-L"), end.cast("string"))).otherwise(""),
    )
    is_repo = F.coalesce(source_type == "repo_url", F.lit(False)) & value.startswith("http")
    inside = F.concat(F.lit("/dashboard/scans/snippet?file="), path, F.lit("&line="), start.cast("string"))
    return F.when(is_repo, F.concat(base, F.lit("/blob/main/"), path, lines)).otherwise(inside)


def percent_encode(segment: Column) -> Column:
    """URI-component encoding: blanks as %20, and ! ' ( ) * left as they are."""
    out = F.url_encode(segment)
    for encoded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def browse_link(existing, repo_url, source_type, source_value, branch, path, line_start, line_end, line_number) -> Column:
    """Dashboard link: encoded path on the project's default branch, else null."""
    fallback = F.when(source_type.isin("repo_url", "github"), source_value).otherwise("")
    url = F.coalesce(missing(repo_url), fallback, F.lit(""))
    base = F.regexp_replace(F.regexp_replace(url, "/$", ""), r"(?i)\.git$", "")
    encoded = F.array_join(F.transform(F.split(path, r"[\\/]+"), percent_encode), "/")
    start = F.coalesce(F.nullif(line_start, F.lit(0)), F.nullif(line_number, F.lit(0)), F.lit(1))
    tail = F.when(F.coalesce(line_end, F.lit(0)) > start, F.concat(F.lit("-L"), line_end.cast("string"))).otherwise("")
    made = F.concat(base, F.lit("/blob/"), percent_encode(F.coalesce(missing(branch), F.lit("main"))),
                    F.lit("/"), encoded, F.lit("#L"), start.cast("string"), tail)
    return F.coalesce(missing(existing), F.when(url.rlike("(?i)^https?://"), made))


# F17 / F18 ----------------------------------------------------------------
def normalise_cwe(raw: Column) -> Column:
    text = strip(F.coalesce(raw, F.lit("")))
    digits = F.regexp_extract(text, r"\d+", 0)
    return (
        F.when(F.upper(text).startswith("CWE-"), F.upper(text))
        .when(digits != "", F.concat(F.lit("CWE-"), digits))
        .otherwise(F.upper(text))
    )


def test_case_id(path: Column) -> Column:
    """Upper-cased benchmark case in a path, or null."""
    return missing(F.upper(F.regexp_extract(path, r"(?i)(BenchmarkTest\d+)", 1)))


# F20 ----------------------------------------------------------------------
def help_uri(references: Column, cwe: Column) -> Column:
    by_cwe = F.concat(F.lit("https://cwe.mitre.org/data/definitions/"),
                      F.replace(cwe, F.lit("CWE-"), F.lit("")), F.lit(".html"))
    return (
        F.when(F.coalesce(references, F.lit("")) != "", strip(F.element_at(F.split(references, "\n"), 1)))
        .when(F.coalesce(cwe, F.lit("")) != "", by_cwe)
        .otherwise("")
    )


def title_case(word: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the others."""
    pieces = F.regexp_extract_all(word, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)),
                                                              F.lower(F.substring(p, 2, 1 << 30)))), "")


def rule_name(title: Column, rule_id: Column) -> Column:
    words = F.slice(F.filter(F.split(first_text(title, rule_id), r"\s+"), lambda w: w != ""), 1, 6)
    return F.array_join(F.transform(words, title_case), "")


# F24 / F25 ----------------------------------------------------------------
# Display forms of the dashboard's locale and its zone
DATE_TIME, DATE, TIME = "HH:mm d 'thg' M, yyyy", "d 'thg' M, yyyy", "HH:mm:ss"
ZONE = "Asia/Ho_Chi_Minh"


def local_time(ts: Column, pattern: str = DATE_TIME, tz: str = ZONE) -> Column:
    """Wall-clock text of a UTC timestamp in a zone; '' for a missing value."""
    moved = F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))
    return F.coalesce(F.date_format(moved, pattern), F.lit(""))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds from earlier to later, rounded down."""
    return F.floor(micros_between(later, earlier) / 1000000).cast("bigint")


def micros_between(later: Column, earlier: Column) -> Column:
    # UTC session zone: the cast only relabels the zone-free timestamp
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))


def relative_age(ts: Column, as_of: Column, tz: str = ZONE) -> Column:
    secs = seconds_between(as_of, ts)
    mins = F.floor(secs / 60)
    hours = F.floor(secs / 3600)
    days = F.floor(secs / 86400)

    def ago(n, unit):
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    return (
        F.when(secs < 60, "just now")
        .when(mins < 60, ago(mins, "min"))
        .when(hours < 24, ago(hours, "hour"))
        .when(days < 30, ago(days, "day"))
        .otherwise(local_time(ts, DATE, tz))
    )


# F26 ----------------------------------------------------------------------
_REVIEW = ("struct<isLikelyTruePositive:boolean,confidence:double,explanation:string,"
           "suggestedFix:string,pentestSuggestion:string>")


def review_comment(event_type: Column, comment: Column) -> Column:
    """Readable text of a review verdict; anything else is shown as stored."""
    review = F.from_json(comment, _REVIEW)
    usable = (event_type == "ai_review") & F.try_parse_json(comment).isNotNull() & comment.rlike(r"^\s*\{")
    lines = F.concat_ws(
        "\n",
        F.when(review["isLikelyTruePositive"], "AI verdict: likely true positive.")
        .otherwise("AI verdict: likely false positive."),
        F.concat(F.lit("Confidence: "), F.floor(review["confidence"] * 100 + 0.5).cast("string"), F.lit("%.")),
        F.concat(F.lit("Explanation: "), missing(review["explanation"])),
        F.concat(F.lit("Suggested fix: "), missing(review["suggestedFix"])),
        F.concat(F.lit("Pentest: "), missing(review["pentestSuggestion"])),
    )
    return F.when(usable, lines).otherwise(comment)


# F27 ----------------------------------------------------------------------
def json_string_array(text: Column, fallback: list[str] | None) -> Column:
    """Strings of a JSON array; the fallback when it is not an array."""
    parsed = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    strings = F.transform(
        F.filter(parsed, lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: v.cast("string"),
    )
    other = F.array(*[F.lit(x) for x in fallback]).cast("array<string>") if fallback is not None \
        else F.lit(None).cast("array<string>")
    return F.coalesce(strings, other)


def json_object(text: Column) -> Column:
    """A JSON object as map of texts; {} for anything else."""
    is_object = F.try_parse_json(text).isNotNull() & F.coalesce(text, F.lit("")).rlike(r"^\s*\{")
    return F.coalesce(
        F.when(is_object, F.from_json(text, "map<string,string>")),
        F.create_map().cast("map<string,string>"),
    )


# F28 ----------------------------------------------------------------------
def guidance_key(hint, vuln_type, title, cwe, owasp) -> Column:
    text = F.lower(F.concat_ws(" ", vuln_type, title, cwe, owasp))
    out = F.when(strip(F.coalesce(hint, F.lit(""))) != "", "own")
    for words, key, _ in fv.GUIDANCE:
        hit = F.lit(True) if not words else F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        out = out.when(hit, key)
    return out


def guidance_text(hint, vuln_type, title, cwe, owasp) -> Column:
    key = guidance_key(hint, vuln_type, title, cwe, owasp)
    out = F.when(key == "own", hint)
    for _, name, text in fv.GUIDANCE:
        out = out.when(key == name, text)
    return out


# F29 ----------------------------------------------------------------------
def slugify(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "(^-|-$)", "")


def normalise_email(email: Column) -> Column:
    return F.lower(strip(F.coalesce(email, F.lit(""))))


def is_valid_email(email: Column) -> Column:
    return email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & (F.length(email) <= 254)


# F30 / F31 / F32 -----------------------------------------------------------
def reference_links(references: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(references, F.lit("")), r"[\n,]+"), strip), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, "^https?://", ""))


def line_range(start: Column, end: Column, number: Column) -> Column:
    s = F.coalesce(F.nullif(start, F.lit(0)), number)
    span = (F.coalesce(start, F.lit(0)) != 0) & (F.coalesce(end, F.lit(0)) != 0) & (end != start)
    return F.concat(F.lit("L"), s.cast("string"),
                    F.when(span, F.concat(F.lit("-"), end.cast("string"))).otherwise(""))


def event_phase(event_type: Column) -> Column:
    return (
        F.when(event_type.contains("started") | event_type.contains("running"), "started")
        .when(event_type.contains("failed") | event_type.contains("error"), "failed")
        .when(event_type.contains("completed"), "completed")
        .otherwise("other")
    )


def event_label(event_type: Column) -> Column:
    return F.replace(event_type, F.lit("_"), F.lit(" "))


# F21 ----------------------------------------------------------------------
def related_locations(trace: Column, path: Column, line_start: Column) -> Column:
    """Trace steps as array<struct<id,message,uri,line>>; empty for no or bad JSON."""
    steps = F.from_json(trace, "array<struct<message:string,path:string,line:int>>", {"mode": "PERMISSIVE"})
    good = F.when(trace.rlike(r"^\s*\[") & F.try_parse_json(trace).isNotNull(), steps)
    made = F.transform(good, lambda s, i: F.struct(
        i.alias("id"),
        F.coalesce(s["message"], F.concat(F.lit("Step "), i.cast("string"))).alias("message"),
        F.coalesce(s["path"], path).alias("uri"),
        F.coalesce(s["line"], line_start).alias("line"),
    ))
    empty = F.array().cast("array<struct<id:int,message:string,uri:string,line:int>>")
    return F.coalesce(made, empty)


# F34 ----------------------------------------------------------------------
def reviewer_prompt(f) -> Column:
    """Message text for one finding; f maps a field name to its column."""
    snippet = first_text(f("code_snippet"), f("evidence"))
    or_text = lambda c, d: F.coalesce(missing(c), F.lit(d))
    return F.concat(
        F.lit("Rule: "), f("rule_id"), F.lit("\nTitle: "), f("title"),
        F.lit("\nCWE: "), f("cwe_id"), F.lit("  OWASP: "), f("owasp_category"),
        F.lit("\nSeverity: "), f("severity"), F.lit("  Confidence: "),
        F.format_string("%.2f", f("confidence")),
        F.lit("\nFile: "), f("file_path"), F.lit("  Lines: "), f("line_start").cast("string"),
        F.lit("-"), f("line_end").cast("string"),
        F.lit("\nSource: "), or_text(f("source"), "unknown"),
        F.lit("  →  Sink: "), or_text(f("sink"), "unknown"),
        F.lit("\n\nCode snippet:\n```\n"), snippet, F.lit("\n```\n\nEvidence (redacted): "),
        or_text(f("evidence"), "n/a"),
    )
