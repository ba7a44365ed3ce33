"""The corpus pass: every expression runs once a file, literals never rule out a match."""

import re

import pytest
from pyspark.sql import functions as F

from riskweave import fixed_values as fv
from riskweave.operators import detection as d
from riskweave.plans import queries_corpus as qc
from riskweave.streaming import jobs
from riskweave.views import Views

SF = "/root/testdata/sf0.001"
FILES = "scan_id string, file_path string, content string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hits_are_made_once(spark):
    files = spark.createDataFrame([("s", "a.py", "x")], FILES)
    filters = [line for line in plan(d.rule_hits(files)).splitlines() if re.match(r"[\s:+-]*Filter ", line)]
    assert filters and not any("aggregate(" in line or "array_repeat(" in line for line in filters)


def test_each_detector_runs_its_own_family(spark):
    files = spark.createDataFrame([("s", "a.js", "x")], FILES)
    text = plan(jobs.incremental_findings(files))
    assert text.count("regexp_extract_all(") == len(fv.PATTERN_RULES) + len(fv.SECRET_RULES)


def test_orders_are_dealt_before_they_become_files(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert qc._handlers(Views(spark, SF)).rdd.getNumPartitions() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


FLOWS = {
    "python-sqli-taint": (['request.args.get(', 'request.json[', 'request.values.get('], ["c.execute("], ["int(", "float(", ".execute(q, ["]),
    "python-command-injection-taint": (["request.form.get("], ["os.system(", "os.popen(", "subprocess.run(c, shell=True", "eval("], ["shlex.quote("]),
    "python-ssrf-taint": (["request.json.get("], ["requests.get(", "httpx.post(", "urllib.request.urlopen("], ["u.validate_url("]),
    "python-path-traversal-taint": (["request.args.get("], ["open(", "Path(p).open("], ["os.path.realpath(", "p.joinpath(a).resolve("]),
    "java-sqli-taint": (["r.getParameter(", "r.getHeader(", "r.getQueryString(", "@RequestParam", "@PathVariable", "@RequestBody"],
                        ["s.executeQuery(", "s.executeUpdate(", "s.executeBatch(", "s.execute(", "c.prepareStatement(", "m.createNativeQuery(", "m.createQuery("],
                        ["Integer.parseInt(", "Long.parseLong(", "s.setString(", "s.setInt("]),
    "java-command-injection-taint": (["r.getParameter(", "@RequestParam", "@PathVariable"], ["r.getRuntime().exec(", "r.exec(", "new ProcessBuilder("],
                                     ["Pattern.compile(x).matcher(y).matches("]),
    "java-path-traversal-taint": (["r.getParameter(", "@RequestParam", "@PathVariable"], ["new File(", "new java.io.FileInputStream(", "new FileReader(", "Paths.get("],
                                  ["p.normalize()", "f.getCanonicalPath()"]),
    "java-ssrf-taint": (["r.getParameter(", "@RequestParam", "@RequestBody"],
                        ["u.openConnection()", "u.openStream()", "c.connect()", "c.retrieve()", "t.getForEntity("], ["v.validateUrl("]),
}


@pytest.mark.parametrize("rule", fv.TAINT_RULES, ids=lambda r: r["rule_id"])
def test_literals_of_flow_rules_lose_no_match(spark, rule):
    cells = [(part, text) for part, texts in enumerate(FLOWS[rule["rule_id"]]) for text in texts]
    tests = d._flow_marks(rule)
    rows = spark.createDataFrame(cells, "part int, text string")
    marks = rows.select("text", *[F.when(F.col("part") == n, test(F.col("text"))).alias(f"m{n}") for n, test in enumerate(tests)])
    # tests come as source, sink, sanitizer, and so do the samples
    assert [r.text for r in marks.collect() if not (r.m0 or r.m1 or r.m2)] == []


def test_function_names_in_every_form(spark):
    lines = ["def  run(a):", "async def\tgo(x):", "function  load(", "public void get(HttpServletRequest r) {", "const f = (a, b) => a", "x = (1)", "v = def_of(1)"]
    got = spark.createDataFrame([(lines,)], "l array<string>").select(d.function_names(F.col("l"))).first()[0]
    assert [(r["line"], r["name"]) for r in got] == [(1, "run"), (2, "go"), (3, "load"), (4, "get"), (5, "f")]
