"""Data flow of the taint rules, case by case."""

import pytest

from riskweave.operators import detection as d
from tests import fixtures as fx

PYTHON = {
    "renamed": ("def f(request):\n    a = request.args.get('q')\n    b = 'x' + a\n    c = b.strip()\n    os.system(c)\n", [(5, 2)]),
    "sanitizer on another": ("def f(request):\n    a = request.args.get('q')\n    b = shlex.quote(other)\n    os.system(a)\n", [(4, 2)]),
    "sanitizer on this": ("def f(request):\n    a = request.args.get('q')\n    b = shlex.quote(a)\n    os.system(b)\n", []),
    "still dirty beside a clean copy": ("def f(request):\n    a = request.args.get('q')\n    b = shlex.quote(a)\n    os.system(a + b)\n", [(4, 2)]),
    "two functions": ("def f(request):\n    a = request.args.get('q')\n\ndef g(a):\n    os.system(a)\n", []),
    "after the function": ("def f(request):\n    a = request.args.get('q')\n\nos.system(a)\n", []),
    "at the margin": ("a = request.args.get('q')\nos.system(a)\n", [(2, 1)]),
    "overwritten": ("def f(request):\n    a = request.args.get('q')\n    a = 'ls'\n    os.system(a)\n", []),
    "added to": ("def f(request):\n    c = 'ls '\n    c += request.args.get('q')\n    c += ' -l'\n    os.system(c)\n", [(5, 3)]),
    "in one line": ("def f(request):\n    os.system(request.form.get('q'))\n", [(2, 2)]),
    "only named in a text": ("def f(request):\n    a = request.args.get('q')\n    os.system('a')\n    os.system(f'{a}')\n", [(4, 2)]),
    "two at once": ("def f(request):\n    a, b = 1, request.args.get('q')\n    os.system(b)\n", [(3, 2)]),
    "other rows": ("def f(request):\n    a = request.args.get('q')\n    os.system('ls')\n", []),
    "nearest source": ("def f(request):\n    a = request.args.get('q')\n    b = request.form.get('r')\n    os.system(a + b)\n", [(4, 3)]),
    "an attribute": ("def f(self, request):\n    self.q = request.args.get('q')\n    os.system(self.q)\n", [(3, 2)]),
    "two sinks in a line": ("def f(request):\n    a = request.args.get('q')\n    os.system(a); os.popen(a)\n", [(3, 2), (3, 2)]),
    "a named argument": ("def f(request):\n    a = request.args.get('q')\n    log(a=1)\n    os.system(a)\n", [(4, 2)]),
}


def test_python_flows(spark):
    files = fx.files(spark, s={f"{name}.py": text for name, (text, _) in PYTHON.items()})
    got = {}
    for r in d.rule_hits(files, (d.TAINT,)).collect():
        if d.fv.TAINT_RULES[r.rule]["rule_id"] == "python-command-injection-taint":
            got.setdefault(r.file_path[:-3], []).append((r.line, r.origin))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, (_, v) in PYTHON.items() if v}


@pytest.mark.parametrize("body,want", [
    ("  public void a(HttpServletRequest req) {\n    Map<String, String> m = load();\n    final String id = req.getParameter(\"x\");\n    String q = build(id);\n    stmt.executeQuery(q);\n  }\n", [5]),
    ("  @GetMapping(\"/x\")\n  public String a(@PathVariable(\"id\") final String id, Model model) {\n    return jdbc.execute(\"x\" + id);\n  }\n", [3]),
    ("  String a(HttpServletRequest req) {\n    String id = req.getHeader(\"x\");\n    if (id == null) {\n      return \"\";\n    }\n    File f = new File(\"a\");\n    stmt.execute(id);\n  }\n", [7]),
    ("  void a(HttpServletRequest req) {\n    String id = req.getParameter(\"x\");\n  }\n  void b(String id) {\n    stmt.execute(id);\n  }\n", []),
    ("  void a(HttpServletRequest req) {\n    String id = req.getParameter(\"x\");\n    stmt.execute(\"id\"); // id\n  }\n", [])])
def test_java_flows(spark, body, want):
    hits = d.rule_hits(fx.files(spark, s={"A.java": body}), (d.TAINT,)).collect()
    assert sorted(r.line for r in hits if d.fv.TAINT_RULES[r.rule]["rule_id"] == "java-sqli-taint") == want


def test_only_flows_leave_the_scan_and_without_python(spark):
    hits = d.rule_hits(fx.files(spark, s={"a.py": "x = request.args.get('q')\n" * 50 + "os.system('ls')\n"}), (d.TAINT,))
    assert hits.count() == 0 and "Python" not in hits._jdf.queryExecution().executedPlan().toString()
