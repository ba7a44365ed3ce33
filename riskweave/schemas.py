"""Table shapes shared by readers, operators and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

SOURCE_FILES = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("size", T.LongType()),
])

# Raw finding: what every detector and report reader emits.
_RAW = [
    ("engine", "string"), ("title", "string"), ("vuln_type", "string"), ("severity", "string"),
    ("cvss4_score", "double"), ("confidence", "double"), ("cwe_id", "string"),
    ("owasp_category", "string"), ("file_path", "string"), ("line_number", "int"),
    ("code_snippet", "string"), ("attack_scenario", "string"), ("poc", "string"),
    ("remediation", "string"), ("secure_example", "string"), ("rule_id", "string"),
    ("scan_category", "string"), ("source", "string"), ("sink", "string"),
    ("function_name", "string"), ("why_vulnerable", "string"), ("line_start", "int"),
    ("line_end", "int"), ("evidence", "string"), ("impact", "string"), ("pentest_hint", "string"),
    ("references", "string"), ("code_link", "string"), ("exploitability", "string"),
    ("false_positive_reason", "string"), ("verification_status", "string"),
    ("dedupe_hash", "string"), ("dataflow_trace", "string"),
]
RAW_FIELDS = [name for name, _ in _RAW]
_DEFAULTS = {
    "scan_category": "SAST source code",
    "verification_status": "unverified",
}
# Position of a finding in its scan: engine, file, rule, hit.  Sortable as it is.
SEQ_TYPE = "struct<engine_ord:int,file_path:string,rule_ord:int,hit_ord:int>"
# Carried from detection so that enrichment needs no second read of the corpus.
CONTEXT_FIELDS = ["context", "context_function"]
FINDING_COLUMNS = ["scan_id", "seq", *RAW_FIELDS, *CONTEXT_FIELDS]

GROUND_TRUTH = T.StructType([
    T.StructField("test_case_id", T.StringType()),
    T.StructField("is_vulnerable", T.BooleanType()),
    T.StructField("cwe_id", T.StringType()),
    T.StructField("category", T.StringType()),
])


def seq(engine_ord, file_path: Column, rule_ord, hit_ord) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(engine_ord).cast("int").alias("engine_ord"),
        file_path.alias("file_path"),
        as_col(rule_ord).cast("int").alias("rule_ord"),
        as_col(hit_ord).cast("int").alias("hit_ord"),
    )


def missing(col: Column) -> Column:
    """Null for null, empty and zero-length text: 'no value' in the data model."""
    return F.nullif(col, F.lit(""))


def first_text(*cols: Column) -> Column:
    """First non-empty text, else ''."""
    return F.coalesce(*[missing(c) for c in cols], F.lit(""))


def as_raw_findings(df: DataFrame) -> DataFrame:
    """Complete a partial detector output to the raw-finding shape.

    Missing columns get their defaults, then the construction rules apply: rule id
    from CWE, type or title; explanation from the attack scenario; line positions;
    fingerprint over rule, path and line (engine left out on purpose).
    """
    have = set(df.columns)
    cols = []
    for name, dtype in _RAW:
        if name in have:
            c = F.col(name).cast(dtype)
            if dtype == "string":
                c = F.coalesce(c, F.lit(_DEFAULTS.get(name, "")))
            elif dtype == "int":
                c = F.coalesce(c, F.lit(0))
        else:
            default = _DEFAULTS.get(name, "" if dtype == "string" else 0)
            c = F.lit(default).cast(dtype)
        cols.append(c.alias(name))
    for name in CONTEXT_FIELDS:
        cols.append((F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")).alias(name))
    out = df.select("scan_id", "seq", *cols)

    number = F.when(F.col("line_number") == 0, 1).otherwise(F.col("line_number"))
    start = F.when(F.col("line_start") == 0, number).otherwise(F.col("line_start"))
    end = F.when(F.col("line_end") == 0, start).otherwise(F.col("line_end"))
    rule = F.coalesce(
        missing(F.col("rule_id")),
        F.replace(
            F.lower(first_text(F.col("cwe_id"), F.col("vuln_type"), F.col("title"))),
            F.lit(" "), F.lit("-"),
        ),
    )
    out = out.withColumns({
        "rule_id": rule,
        "why_vulnerable": first_text(F.col("why_vulnerable"), F.col("attack_scenario")),
        "line_start": start,
        "line_end": end,
    })
    return out.withColumn(
        "dedupe_hash",
        F.coalesce(missing(F.col("dedupe_hash")), fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line_start"))),
    )


def fingerprint(rule_id: Column, file_path: Column, line_start: Column) -> Column:
    raw = F.concat_ws(":", rule_id, file_path, line_start.cast("string"))
    return F.substring(F.sha2(raw, 256), 1, 16)
