"""Which values reach a sink: definitions and uses inside a function, followed in the order of its lines.

A file becomes a list of statements, one a line: the names it defines, the names it uses, whether it
opens a function, and whether a rule's source, sanitizer or sink stands on it.  A fold over the list keeps,
for every name, the line of the source its present value comes from.  A definition takes the origin of
what it uses, or its own line where a source stands on it; a sanitizer, or values without an origin,
make its names clean; a new function starts with nothing.  Every use meets the definition that reaches
it, so in straight code this is the closure of the def-use edges, whatever the number of renamings.  The fold
is one expression inside the corpus pass: no statement leaves the scan stage, only flows do.

An approximation by design: statements are lines, branches and loops are read as straight code, calls give
back what goes into them, and functions do not see each other's names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

PYTHON, JAVA = ".py", ".java"
_NAME = r"[A-Za-z_]\w*"
# quoted text names nothing, but what stands inside an f-string does
_QUOTED = r"""(?<![fF])(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
_COMMENT = {PYTHON: r"#.*$", JAVA: r"//.*$"}
_LEFT = r"^([^=!<>(]*(?:<[^=()]*>[^=!<>(]*)?)(?<![-+*/%&|^@])=(?!=)"
_ADDED = r"^([^=!<>(]*)(?:[-+*/%&|^@]|<<|>>)=(?!=)"
_OPENS = {
    PYTHON: r"^\s*(?:async\s+)?def\s+\w+\s*\(",
    JAVA: r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?!(?:return|new|else|if|for|while|switch|throw|case|do|try|catch)\b)(?:[\w<>\[\],.?]+\s+)+\w+\s*\([^;=]*$",
}
# an annotated parameter is a source of its own name
_PARAMETER = r"@(?:RequestParam|PathVariable|RequestBody)(?:\([^)]*\))?\s+(?:final\s+)?[\w<>\[\].?]+(?:\s*<[^>]*>)?\s+(" + _NAME + ")"
_STATE = "struct<inside:boolean,origin:map<string,int>,flows:array<struct<line:int,origin:int>>>"


def _targets(left: Column) -> Column:
    """Names that the part before '=' defines: the last one before every comma and at the end."""
    bare = F.regexp_replace(F.regexp_replace(left, r"\[[^\]]*\]|<[^>]*>", ""), r":[^,]*", "")
    return F.regexp_extract_all(bare, F.lit("(" + _NAME + r")\s*(?:,|$)"), F.lit(1))


def statements(lines: Column, suffix: str, source: Callable[[Column], Column], clean: Callable[[Column], Column],
               sink: Callable[[Column], Column]) -> Column:
    """array<struct>: the lines that open a function, define a name or carry a mark of the rule.

    source, clean, sink: tests of a line.  A pattern runs on a line that holds a literal of it only.
    """
    # one step after the other, each bound by its lambda, so that no text is taken apart twice
    def marked(text: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).cast("int").alias("line"), text.alias("text"),
            (text.contains("def" if suffix == PYTHON else "(") & text.rlike(_OPENS[suffix])).alias("opens"),
            (F.lit(suffix == PYTHON) & text.rlike(r"^[^\s#@)\]}]")).alias("outermost"),
            source(text).alias("source"), clean(text).alias("clean"), sink(text).alias("sink"))

    def bared(s: Column) -> Column:
        quoted = s["text"].contains('"') | s["text"].contains("'")
        unquoted = F.when(quoted, F.regexp_replace(s["text"], _QUOTED, '""')).otherwise(s["text"])
        code = F.when(s["text"].contains(_COMMENT[suffix][:-3]), F.regexp_replace(unquoted, _COMMENT[suffix], "")).otherwise(unquoted)
        return F.struct(*[s[c].alias(c) for c in ("line", "text", "opens", "outermost", "source", "clean", "sink")], code.alias("code"))

    def parted(s: Column) -> Column:
        none, assigns = F.array().cast("array<string>"), s["code"].contains("=")
        added = s["code"].rlike(_ADDED)
        left = F.when(added, F.regexp_extract(s["code"], _ADDED, 1)).otherwise(F.regexp_extract(s["code"], _LEFT, 1))
        right = F.when(~assigns | added, s["code"]).otherwise(F.regexp_replace(s["code"], _LEFT, ""))
        parameters = F.when(s["text"].contains("@"), F.regexp_extract_all(s["text"], F.lit(_PARAMETER), F.lit(1))).otherwise(none) if suffix == JAVA else none
        return F.struct(*[s[c].alias(c) for c in ("line", "opens", "outermost", "source", "clean", "sink")], F.when(assigns, _targets(left)).otherwise(none).alias("defines"),
                        F.regexp_extract_all(right, F.lit(_NAME), F.lit(0)).alias("uses"), parameters.alias("parameters"))

    def tells(s: Column) -> Column:
        return s["opens"] | s["outermost"] | s["source"] | s["clean"] | s["sink"] | s["text"].contains("=")
    return F.transform(F.transform(F.filter(F.transform(lines, marked), tells), bared), parted)


def flows(steps: Column) -> Column:
    """array<struct<line,origin>>: the sinks that a source reaches, with the source's line (the nearest of several)."""
    nothing = F.create_map().cast("map<string,int>")
    start = F.struct(F.lit(False).alias("inside"), nothing.alias("origin"), F.array().cast("array<struct<line:int,origin:int>>").alias("flows")).cast(_STATE)

    def step(state: Column, s: Column) -> Column:
        # a statement at the margin ends a function, an opening line begins one
        leaves = state["inside"] & s["outermost"] & ~s["opens"]
        known = F.when(s["opens"] | leaves, nothing).otherwise(state["origin"])
        reached = F.array_max(F.transform(s["uses"], lambda name: F.try_element_at(known, name)))
        origin = F.when(s["clean"], F.lit(None).cast("int")).otherwise(F.when(s["source"], s["line"]).otherwise(reached))
        given = F.concat(s["defines"], F.when(s["source"] & ~s["clean"], s["parameters"]).otherwise(F.array().cast("array<string>")))
        others = F.map_filter(known, lambda name, _: ~F.array_contains(given, name))
        fresh = F.map_from_arrays(F.array_distinct(given), F.transform(F.array_distinct(given), lambda _: origin))
        after = F.when(F.size(given) == 0, known).when(origin.isNull(), others).otherwise(F.map_concat(others, fresh))
        # an opening line names its parameters as uses; only an annotated one is a source, and none is a flow by itself
        told = s["sink"] & origin.isNotNull()
        return F.struct(
            (s["opens"] | (state["inside"] & ~leaves)).alias("inside"), after.alias("origin"),
            F.when(told, F.concat(state["flows"], F.array(F.struct(s["line"].alias("line"), origin.alias("origin"))))).otherwise(state["flows"]).alias("flows")).cast(_STATE)

    return F.aggregate(steps, start, step)["flows"]
