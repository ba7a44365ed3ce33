"""Detectors: source files in, raw findings out.

All text work is one pass per file row inside the scan stage; only hits leave it.
The lines around a hit and its enclosing function are taken here, while the file
is at hand, so that nothing later has to shuffle the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskweave import fixed_values as fv
from riskweave.functions import text as tx
from riskweave.functions.scoring import lookup
from riskweave.operators import dataflow
from riskweave.operators.spread_join import spread_join
from riskweave.schemas import as_raw_findings, seq
from riskweave.sources.corpus import has_suffix, is_scannable, suffix

# (?d): only \n ends a line for '.'; (?U): Unicode classes and case rules.
_FLAGS = "(?dU)"
# A mark put before each match.  Marks already in a text are turned into another
# control character first, which no rule tells apart.
_MARK, _OTHER = "\x01", "\x02"
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

_DEF_FIXED = r"\bdef\s+([A-Za-z_]\w*)\s*\("
_DEF_STRICT = r"\bdef\s+([A-Za-z_]\w*)\\s*\("
# The method-header pattern names the identifier before '(' when whitespace and an
# earlier word of the same run of header characters come before it.
_FUNCTION_PATTERNS = [  # with a literal that every match contains
    ("function", r"\bfunction\s+([A-Za-z_]\w*)\s*\("),
    ("(", r"\w[<>\[\],\s]*\s([A-Za-z_]\w*)\s*\("),
    ("=>", r"\b([A-Za-z_]\w*)\s*=\s*\([^)]*\)\s*=>"),
]


def split_lines(content: Column) -> Column:
    """Lines without their ends; a closing line end opens no further line."""
    parts = F.split(content, _LINE_END, -1)
    return F.when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def marked_lines(content: Column, pattern: str) -> Column:
    """array<int>: start line of every match, in match order, in linear time."""
    marked = F.regexp_replace(F.translate(content, _MARK, _OTHER), pattern, f"{_MARK}$0")
    per_line = F.transform(
        F.split(marked, "\n", -1),
        lambda line, i: F.array_repeat(i + 1, F.length(line) - F.length(F.replace(line, F.lit(_MARK), F.lit("")))),
    )
    return F.flatten(F.filter(per_line, lambda a: F.size(a) > 0))


def match_hits(content: Column, pattern: str) -> Column:
    """array<struct<snippet,line>>: every non-overlapping match with its line."""
    snippets = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    return F.zip_with(snippets, marked_lines(content, pattern),
                      lambda s, n: F.struct(s.alias("snippet"), n.alias("line")))


def function_names(lines: Column, strict: bool = False) -> Column:
    """array<struct<line,name>> of the lines that open a function."""
    patterns = [("def", _DEF_STRICT if strict else _DEF_FIXED), *_FUNCTION_PATTERNS]

    def name(line):
        # the filter's lambda binds each name, so that no pattern runs twice on a line
        found = F.array(*[F.when(line.contains(word), F.regexp_extract(line, "(?U)" + p, 1)) for word, p in patterns])
        return F.try_element_at(F.filter(found, lambda n: n != ""), F.lit(1))

    # cheap literals rule out most lines before any pattern runs
    named = F.transform(lines, lambda s, i: F.struct(
        (i + 1).alias("line"), F.when(s.contains("("), name(s)).alias("name")))
    return F.filter(named, lambda x: x["name"].isNotNull())


def enclosing_function(names: Column, line: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(names, lambda x: x["line"] <= line), F.lit(-1))["name"], F.lit(""))


def line_window(lines: Column, start: Column, end: Column, radius: int = 10) -> Column:
    """Text of the lines from start - radius to end + radius."""
    low = F.greatest(start - radius - 1, F.lit(0))
    high = F.least(end + radius, F.size(lines))
    return F.when(high > low, F.array_join(F.slice(lines, low + 1, high - low), "\n")).otherwise("")


# One pass over the corpus ----------------------------------------------------
TAINT, SCRIPT, PATTERN, SECRET = 0, 2, 3, 5  # families, numbered by engine order
RULES_OF = {TAINT: fv.TAINT_RULES, SCRIPT: fv.JS_SINKS, PATTERN: fv.PATTERN_RULES, SECRET: fv.SECRET_RULES}
_HIT = "array<struct<family:int,rule:int,pos:int,snippet:string,line:int,origin:int>>"


def _hit(family: int, rule: int, pos: Column, snippet: Column, line: Column, origin: Column | None = None) -> Column:
    return F.struct(F.lit(family).alias("family"), F.lit(rule).alias("rule"), pos.alias("pos"), snippet.alias("snippet"), line.cast("int").alias("line"),
                    (F.lit(None).cast("int") if origin is None else origin).alias("origin"))


def _tagger(family: int, rule: int):
    def tag(h, i):
        return _hit(family, rule, i, h["snippet"], h["line"])
    return tag


# Literals of which a match must contain at least one (all of a tuple), in lower case.
# They only rule files out; what passes is still decided by the rule's own pattern.
_NEEDLES = {
    "config.auth-bypass-flag": ["allowanonymous", "permitall", "skipauth", "skip_auth", "skip-auth",
                                "authdisabled", "auth_disabled", "auth-disabled"],
    "sast.weak-crypto-primitive": ["md5(", "sha1(", "des.", "rc4", "sslv3", "tlsv1"],
    "sast.injection-sink": [("select", "+"), "execute(f", ("subprocess.", "shell"), "os.system(",
                            "runtime.getruntime().exec"],
    "sast.insecure-design-marker": [("todo", "security"), ("fixme", "auth"), "trust client side"],
    "config.security-misconfiguration": [("debug", "true"), ("cors", "*"), ("origin", "*"), "defaultpassword",
                                         "default_password", "default-password"],
    "sast.weak-auth-session": ["jwtsecret", "jwt_secret", "jwt-secret", ("session", "request.args"), ("mfa", "false")],
    "config.supply-chain-unsafe-install": [("curl", "|"), ("pip", "--trusted-host"), ("npm", "--force")],
    "sast.logging-suppression": [("except", "exception"), "catch", "logger.disabled"],
    "sast.ssrf-url-sink": ["requests.", "axios.", "fetch("],
    "secret.aws-access-key": ["akia"],
    "secret.github-token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "secret.gsk-key": ["gsk_"],
    "secret.sk-key": ["sk-"],
    "secret.private-key": ["private key-----"],
    "secret.assignment": ["key", "token", "secret", "password"],
}
# Letters that equal i, k or s when case is ignored but do not lower to them: texts
# with one of these skip the literal test.
_ODD_LETTERS = ["\u0130", "\u0131", "\u017f", "\u212a"]


def _may_match(content: Column, low: Column, rule: dict) -> Column:
    """Whether the literals of a rule allow a match."""
    options = []
    for needle in _NEEDLES[rule["rule_id"]]:
        words = (needle,) if isinstance(needle, str) else needle
        together = low.contains(words[0])
        for word in words[1:]:
            together = together & low.contains(word)
        options.append(together)
    return _either(options + [content.contains(x) for x in _ODD_LETTERS])


def _table_gate(content: Column, low: Column, rules: list[dict]) -> Column:
    return _either([_may_match(content, low, rule) & content.rlike(_FLAGS + rule["regex"]) for rule in rules])


def _table_hits(content: Column, low: Column, family: int, rules: list[dict]) -> Column:
    parts = []
    for n, rule in enumerate(rules):
        pattern = _FLAGS + rule["regex"]
        found = F.transform(match_hits(content, pattern), _tagger(family, n))
        here = _may_match(content, low, rule) & content.rlike(pattern)
        parts.append(F.when(here, found).otherwise(F.array().cast(_HIT)))
    return F.concat(*parts)


def _script_hits(content: Column) -> Column:
    options = []
    for n, rule in enumerate(fv.JS_SINKS):
        at = F.instr(content, rule["needle"])
        line = tx.newline_count(F.substring(content, F.lit(1), at - 1)) + 1
        options.append(F.when(at > 0, _hit(SCRIPT, n, F.lit(0), F.lit(rule["needle"]), line)))
    return F.array_compact(F.array(*options))


# Literals of which a source, a sink, a sanitizer of a flow rule must contain at least one.
_FLOW_NEEDLES = {
    "java-sqli-taint": (
        [".getParameter(", ".getHeader(", ".getQueryString(", "@RequestParam", "@PathVariable", "@RequestBody"],
        [".execute", ".prepareStatement(", ".createNativeQuery(", ".createQuery("],
        [".parseInt(", ".parseLong(", ".setString(", ".setInt("]),
    "java-command-injection-taint": (
        [".getParameter(", "@RequestParam", "@PathVariable"], [".exec(", "ProcessBuilder("], [".compile("]),
    "java-path-traversal-taint": (
        [".getParameter(", "@RequestParam", "@PathVariable"], ["File(", "FileInputStream(", "FileReader(", "Paths.get("],
        [".normalize()", ".getCanonicalPath()"]),
    "java-ssrf-taint": (
        [".getParameter(", "@RequestParam", "@RequestBody"],
        [".openConnection()", ".openStream()", ".connect()", ".retrieve()", ".getForEntity("], [".validateUrl("]),
    "python-sqli-taint": (["request."], [".execute("], ["int(", "float(", ".execute("]),
    "python-command-injection-taint": (["request."], ["os.system(", "os.popen(", "subprocess.", "eval("], ["shlex.quote("]),
    "python-ssrf-taint": (["request."], ["requests.", "httpx.", "urllib.request.urlopen("], [".validate_url("]),
    "python-path-traversal-taint": (["request."], ["open(", "Path("], ["os.path.realpath(", ".joinpath("]),
}


def _flow_marks(rule: dict) -> list:
    """Tests of a text for a source, a sink and a sanitizer of a flow rule: literals first, then the pattern."""
    def test(words: list[str], pattern: str):
        return lambda text: _either([text.contains(w) for w in words]) & text.rlike("(?d)" + pattern)
    return [test(words, rule[part]) for words, part in zip(_FLOW_NEEDLES[rule["rule_id"]], ("sources", "sinks", "sanitizers"))]


def _taint_pair(content: Column, rule: dict) -> Column:
    source, sink, _ = _flow_marks(rule)
    return source(content) & sink(content)


def _taint_gate(path: Column, content: Column) -> Column:
    """Files that hold a source and a sink of one rule; the suffix is read once a language."""
    literals = {".py": ["request."], ".java": [".get", "@Request", "@PathVariable"]}
    out = []
    for tail, words in literals.items():
        pairs = [_taint_pair(content, r) for r in fv.TAINT_RULES if r["suffix"] == tail]
        out.append(has_suffix(path, [tail]) & _either([content.contains(w) for w in words]) & _either(pairs))
    return _either(out)


def _reached_sinks(rule: int, sinks: Column, flows: Column) -> Column:
    def with_origin(found: Column) -> Column:
        def tag(h: Column, i: Column) -> Column:
            at = F.try_element_at(F.filter(found, lambda f: f["line"] == h["line"]), F.lit(1))
            return _hit(TAINT, rule, i, h["snippet"], h["line"], at["origin"])
        return F.filter(F.transform(sinks, tag), lambda h: h["origin"].isNotNull())

    # the lambda binds the flows once, for all sinks of the file
    return F.element_at(F.transform(F.array(flows), with_origin), 1)


def _taint_hits(content: Column, lines: Column) -> Column:
    """Sinks that a source of their rule reaches; origin is the source's line."""
    none, parts = F.array().cast(_HIT), {}
    for n, rule in enumerate(fv.TAINT_RULES):
        source, sink, clean = _flow_marks(rule)
        steps = dataflow.statements(lines, rule["suffix"], source, clean, sink)
        made = _reached_sinks(n, match_hits(content, "(?d)" + rule["sinks"]), dataflow.flows(steps))
        parts.setdefault(rule["suffix"], []).append(F.when(_taint_pair(content, rule), made).otherwise(none))
    # the suffix is read once a language
    return F.concat(*[F.when(has_suffix(F.col("file_path"), [tail]), F.concat(*made)).otherwise(none) for tail, made in parts.items()])


def _either(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def rule_hits(files: DataFrame, families: tuple[int, ...] = (TAINT, SCRIPT, PATTERN, SECRET),
              strict: bool = False) -> DataFrame:
    """Every hit of the chosen rule families, from a single read of each file.

    Columns: scan_id, file_path, family, rule, pos, snippet, line, origin (of a flow: its
    source's line), context, context_function.  Files without a hit are dropped by cheap gates
    before any array is built.  A flow carries its sink's whole line as snippet.
    """
    path, content = F.col("file_path"), F.col("content")
    gates = {
        TAINT: lambda f: _taint_gate(f["path"], f["text"]),
        SCRIPT: lambda f: has_suffix(f["path"], fv.JS_SUFFIXES) & _either([f["text"].contains(r["needle"]) for r in fv.JS_SINKS]),
        PATTERN: lambda f: is_scannable(f["path"]) & _table_gate(f["text"], f["low"], fv.PATTERN_RULES),
        SECRET: lambda f: _table_gate(f["text"], f["low"], fv.SECRET_RULES),
    }
    none = F.array().cast(_HIT)
    made = {
        TAINT: lambda low: _taint_hits(content, F.col("lines")),
        SCRIPT: lambda low: F.when(has_suffix(path, fv.JS_SUFFIXES), _script_hits(content)).otherwise(none),
        PATTERN: lambda low: F.when(is_scannable(path), _table_hits(content, low, PATTERN, fv.PATTERN_RULES)).otherwise(none),
        SECRET: lambda low: _table_hits(content, low, SECRET, fv.SECRET_RULES),
    }
    # one lower-cased copy per file serves every literal test: the lambda binds it once; it binds path and text too, since
    # Spark moves the filter below the projection that makes them, where each mention would make them again
    file = F.struct(path.alias("path"), content.alias("text"), F.lower(content).alias("low"))
    passes = F.exists(F.array(file), lambda f: _either([gates[family](f) for family in families]))
    marked = files.select("scan_id", "file_path", "content").filter(passes)
    hits = F.flatten(F.transform(F.array(F.lower(content)), lambda low: F.concat(*[made[f](low) for f in families])))
    found = marked.withColumn("lines", split_lines(content)).withColumn("names", function_names(F.col("lines"), strict))
    # one row a hit first: the surroundings are then plain columns, in memory for one hit at a
    # time, and absent from the plan where nobody asks for them
    h = F.col("h")
    # exploded as an expression: of a column, Spark would ask first whether it is empty, and make the hits three times
    return found.select("scan_id", "file_path", "lines", "names", F.explode(hits).alias("h")).select(
        "scan_id", "file_path", h["family"].alias("family"), h["rule"].alias("rule"), h["pos"].alias("pos"),
        F.when(h["family"] == TAINT, F.coalesce(F.get(F.col("lines"), h["line"] - 1), F.lit("")))
        .otherwise(h["snippet"]).alias("snippet"),
        h["line"].alias("line"), h["origin"].alias("origin"),
        line_window(F.col("lines"), h["line"], h["line"]).alias("context"),
        # a position past the last line looks up from the last line
        enclosing_function(F.col("names"), F.greatest(F.least(h["line"], F.size("lines")), F.lit(1)))
        .alias("context_function"),
    )


def _by_rule(rules: list[dict], field: str) -> Column:
    return lookup(F.col("rule"), {i: r[field] for i, r in enumerate(rules)}, F.lit(None))


_PLACE = ["scan_id", "file_path", "context", "context_function"]


# D1 -----------------------------------------------------------------------
def pattern_findings(files: DataFrame, strict: bool = False) -> DataFrame:
    """Every match of the nine pattern rules in every scannable file."""
    return pattern_findings_of(rule_hits(files, (PATTERN,), strict))


def pattern_findings_of(hits: DataFrame) -> DataFrame:
    rules = fv.PATTERN_RULES
    rule_id = _by_rule(rules, "rule_id")
    return as_raw_findings(hits.filter(F.col("family") == PATTERN).select(
        *_PLACE, seq(PATTERN, F.col("file_path"), F.col("rule"), F.col("pos")).alias("seq"),
        F.lit("owasp-patterns").alias("engine"),
        _by_rule(rules, "title").alias("title"), _by_rule(rules, "vuln_type").alias("vuln_type"),
        _by_rule(rules, "severity").alias("severity"), _by_rule(rules, "cvss").alias("cvss4_score"),
        _by_rule(rules, "confidence").alias("confidence"), _by_rule(rules, "cwe_id").alias("cwe_id"),
        _by_rule(rules, "owasp").alias("owasp_category"),
        F.col("line").alias("line_number"), F.col("snippet").alias("code_snippet"),
        _by_rule(rules, "attack_scenario").alias("attack_scenario"), _by_rule(rules, "poc").alias("poc"),
        _by_rule(rules, "remediation").alias("remediation"),
        _by_rule(rules, "secure_example").alias("secure_example"), rule_id.alias("rule_id"),
        F.concat(F.lit("Pattern rule "), rule_id, F.lit(
            " matched a potential sink. Severity is calibrated later based on source-to-sink evidence."
        )).alias("why_vulnerable"),
    ))


# D2 -----------------------------------------------------------------------
def js_sink_findings(files: DataFrame, strict: bool = False) -> DataFrame:
    """First occurrence of each unsafe call in JavaScript and TypeScript files."""
    return js_sink_findings_of(rule_hits(files, (SCRIPT,), strict))


def js_sink_findings_of(hits: DataFrame) -> DataFrame:
    rules, common = fv.JS_SINKS, fv.JS_SINK_TEXT
    vuln, needle = _by_rule(rules, "vuln_type"), F.col("snippet")
    return as_raw_findings(hits.filter(F.col("family") == SCRIPT).select(
        *_PLACE, seq(SCRIPT, F.col("file_path"), F.col("rule"), 0).alias("seq"),
        F.lit("eslint-security").alias("engine"),
        F.concat(F.lit("Potential "), vuln, F.lit(" due to "), needle).alias("title"),
        vuln.alias("vuln_type"), F.lit(common["severity"]).alias("severity"),
        F.lit(common["cvss"]).alias("cvss4_score"), F.lit(common["confidence"]).alias("confidence"),
        _by_rule(rules, "cwe_id").alias("cwe_id"), F.lit(common["owasp"]).alias("owasp_category"),
        F.col("line").alias("line_number"), needle.alias("code_snippet"),
        F.lit(common["attack_scenario"]).alias("attack_scenario"), F.lit(common["poc"]).alias("poc"),
        F.lit(common["remediation"]).alias("remediation"),
        F.lit(common["secure_example"]).alias("secure_example"),
        _by_rule(rules, "rule_id").alias("rule_id"), needle.alias("sink"),
        F.concat(F.lit("Potential unsafe JavaScript sink "), needle, F.lit(" is present.")).alias("why_vulnerable"),
    ))


# D7 -----------------------------------------------------------------------
def secret_findings(files: DataFrame, strict: bool = False) -> DataFrame:
    """Credential-like text in every file; evidence is shortened, never the raw value."""
    return secret_findings_of(rule_hits(files, (SECRET,), strict))


def secret_findings_of(hits: DataFrame) -> DataFrame:
    rules, common = fv.SECRET_RULES, fv.SECRET_TEXT
    shown = tx.mask_long_tokens(F.col("snippet"))
    return as_raw_findings(hits.filter(F.col("family") == SECRET).select(
        *_PLACE, seq(SECRET, F.col("file_path"), F.col("rule"), F.col("pos")).alias("seq"),
        F.lit("secret-scan").alias("engine"), _by_rule(rules, "title").alias("title"),
        F.lit(common["vuln_type"]).alias("vuln_type"), _by_rule(rules, "severity").alias("severity"),
        _by_rule(rules, "cvss").alias("cvss4_score"), F.lit(common["confidence"]).alias("confidence"),
        F.lit(common["cwe_id"]).alias("cwe_id"), F.lit(common["owasp"]).alias("owasp_category"),
        F.col("line").alias("line_number"), shown.alias("code_snippet"), shown.alias("evidence"),
        F.lit(common["attack_scenario"]).alias("attack_scenario"), F.lit(common["poc"]).alias("poc"),
        F.lit(common["remediation"]).alias("remediation"),
        F.lit(common["secure_example"]).alias("secure_example"),
        _by_rule(rules, "rule_id").alias("rule_id"), F.lit("Secret scan").alias("scan_category"),
        F.lit("committed source file").alias("source"), F.lit("secret material").alias("sink"),
    ))


# D8 / J13 -----------------------------------------------------------------
def taint_findings(files: DataFrame, strict: bool = False) -> DataFrame:
    """Candidate flows of the eight taint rules: a sink that uses a value which comes from a source of the
    same function, with no sanitizer on the way.  What counts as a use is told in `dataflow`.
    """
    return taint_findings_of(rule_hits(files, (TAINT,), strict))


def taint_findings_of(hits: DataFrame) -> DataFrame:
    rules, common = fv.TAINT_RULES, fv.SEMGREP_TEXT
    text = tx.strip(F.col("snippet"))

    def step(message: str, line: str) -> Column:
        return F.struct(F.lit(message).alias("message"), F.col("file_path").alias("path"), F.col(line).alias("line"))

    return as_raw_findings(hits.filter(F.col("family") == TAINT).select(
        *_PLACE, seq(TAINT, F.col("file_path"), F.col("rule"), F.col("pos")).alias("seq"),
        F.lit("semgrep").alias("engine"), _by_rule(rules, "message").alias("title"),
        _by_rule(rules, "vuln_type").alias("vuln_type"), F.lit("High").alias("severity"),
        F.lit(7.5).alias("cvss4_score"), F.lit(0.9).alias("confidence"),
        _by_rule(rules, "cwe_id").alias("cwe_id"), _by_rule(rules, "owasp").alias("owasp_category"),
        F.col("line").alias("line_number"), text.alias("code_snippet"),
        text.alias("evidence"), _by_rule(rules, "rule_id").alias("rule_id"),
        F.lit(common["impact"]).alias("impact"), F.lit(common["attack_scenario"]).alias("attack_scenario"),
        F.lit(common["poc"]).alias("poc"), F.lit(common["remediation"]).alias("remediation"),
        F.lit(common["secure_example"]).alias("secure_example"),
        F.lit(common["pentest_hint"]).alias("pentest_hint"),
        F.to_json(F.array(step("source", "origin"), step("sink", "line"))).alias("dataflow_trace"),
    ))


# D3 / D4 ------------------------------------------------------------------
def _summary_map(counts: DataFrame, scans: DataFrame, key: str, name: str) -> DataFrame:
    per_scan = counts.groupBy("scan_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))
    unknown = F.create_map(F.lit("unknown"), F.lit(1).cast("bigint"))
    return scans.select("scan_id").join(per_scan, "scan_id", "left").withColumn(name, F.coalesce(name, unknown))


def language_counts(files: DataFrame) -> DataFrame:
    """Files per scan and language; at most eight rows a scan."""
    lang = lookup(suffix(F.col("file_path")), fv.LANGUAGE_BY_SUFFIX, F.lit(None).cast("string"))
    return (files.select("scan_id", lang.alias("language")).filter("language is not null")
            .groupBy("scan_id", "language").agg(F.count(F.lit(1)).alias("n")))


def language_summary(files: DataFrame, scans: DataFrame) -> DataFrame:
    return _summary_map(language_counts(files), scans, "language", "language_summary")


def framework_counts(files: DataFrame) -> DataFrame:
    """Framework marks in root manifests, one per manifest and framework."""
    low = F.lower("content")
    marks = None
    for manifest, words in fv.FRAMEWORK_MARKS.items():
        found = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(name)) for w, name in words]))
        here = F.col("file_path") == manifest
        marks = F.when(here, found) if marks is None else marks.when(here, found)
    return (
        files.filter(F.col("file_path").isin(*fv.FRAMEWORK_MARKS))
        .select("scan_id", F.explode(marks).alias("framework"))
        .groupBy("scan_id", "framework").agg(F.count(F.lit(1)).alias("n"))
    )


def framework_summary(files: DataFrame, scans: DataFrame) -> DataFrame:
    return _summary_map(framework_counts(files), scans, "framework", "framework_summary")


# D5 -----------------------------------------------------------------------
def dependencies(files: DataFrame) -> DataFrame:
    """(scan_id, ecosystem, package, version, declared, file_path) of root manifests."""
    npm = (
        files.filter(F.col("file_path") == "package.json")
        .select("scan_id", "file_path",
                F.explode(F.from_json("content", "struct<dependencies:map<string,string>>")["dependencies"])
                .alias("package", "declared"))
        .select("scan_id", "file_path", F.lit("npm").alias("ecosystem"), "package",
                F.translate("declared", "^~", "").alias("version"), "declared",
                F.concat(F.lit('"'), F.col("package"), F.lit('": "'), F.col("declared"), F.lit('"')).alias("snippet"))
    )
    line = F.col("line")
    pypi = (
        files.filter(F.col("file_path") == "requirements.txt")
        .select("scan_id", "file_path", F.explode(split_lines(F.col("content"))).alias("line"))
        .filter(line.contains("==") & ~tx.strip(line).startswith("#"))
        .withColumn("cut", F.instr(line, "=="))
        .select("scan_id", "file_path", F.lit("PyPI").alias("ecosystem"),
                tx.strip(F.substring(line, F.lit(1), F.col("cut") - 1)).alias("package"),
                tx.strip(F.substring(line, F.col("cut") + 2, F.length(line))).alias("version"),
                tx.strip(F.substring(line, F.col("cut") + 2, F.length(line))).alias("declared"),
                tx.strip(line).alias("snippet"))
    )
    return npm.unionByName(pypi)


# D6 / J12 / W5 -------------------------------------------------------------
def match_advisories(deps: DataFrame, advisories: DataFrame, limit: int | None = None) -> DataFrame:
    """The advisories of every dependency, numbered by advisory rank; all of them unless a limit is named.

    Numbers are given per package version before the join, so they cost no sort of the dependencies.
    """
    key = ["ecosystem", "package", "version"]
    best = W.partitionBy(*key).orderBy("rank", "vuln_id")
    kept = advisories.withColumn("nth", F.row_number().over(best))
    return spread_join(deps, kept if limit is None else kept.filter(F.col("nth") <= limit), key, ["scan_id", "file_path"], ["rank", "vuln_id"])


def advisory_findings(deps: DataFrame, advisories: DataFrame, limit: int | None = None) -> DataFrame:
    """A finding for every dependency and advisory of its version.

    What one side alone decides is worked out before they meet: there are far more pairs than rows on either side.
    """
    t = fv.ADVISORY_TEXT
    npm = F.col("ecosystem") == "npm"
    pinned = F.when(npm, F.concat_ws("@", "package", "declared")).otherwise(F.concat_ws("==", "package", "version"))
    patched = F.when(npm, F.concat(F.lit('"'), F.col("package"), F.lit('": "<patched_version>"'))) \
        .otherwise(F.concat("package", F.lit("==<patched_version>")))
    place = F.concat_ws(":", F.when(npm, "0").otherwise("1"), "package", "version")
    vuln = F.col("vuln_id")
    placed = deps.withColumns({"_pinned": pinned, "_patched": patched, "_place": place})
    named = advisories.withColumns({"_title": F.coalesce("summary", F.lit(t["title"])), "_poc": F.coalesce(vuln, F.lit(t["poc"])), "_rule": F.coalesce(vuln, F.lit(""))})
    return as_raw_findings(match_advisories(placed, named, limit).select(
        "scan_id", "file_path", seq(4, F.col("_place"), 0, F.col("nth")).alias("seq"),
        F.lit("trivy").alias("engine"), F.col("_title").alias("title"),
        F.lit(t["vuln_type"]).alias("vuln_type"), F.lit(t["severity"]).alias("severity"),
        F.lit(t["cvss"]).alias("cvss4_score"), F.lit(t["confidence"]).alias("confidence"),
        F.lit(t["owasp"]).alias("owasp_category"), F.lit(1).alias("line_number"),
        F.col("snippet").alias("code_snippet"), F.lit(t["attack_scenario"]).alias("attack_scenario"),
        F.col("_poc").alias("poc"), F.lit(t["remediation"]).alias("remediation"),
        F.col("_patched").alias("secure_example"), F.col("_rule").alias("rule_id"),
        F.lit("Dependency scan").alias("scan_category"), F.col("_pinned").alias("source"), F.lit(t["sink"]).alias("sink"),
        F.concat(F.lit("OSV returned advisory "), F.coalesce(vuln, F.lit("unknown")), F.lit(" for "), F.col("_pinned"),
                 F.lit(".")).alias("why_vulnerable"),
    ))
