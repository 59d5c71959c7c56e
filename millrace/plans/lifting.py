"""Raw samples to programs: tool calls, SQL texts and small Python functions become nodes."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .program import Node, Program, to_text
from .validator import validate

# Fixed values: (pattern on the tool's name, op, fixed parameter, how sure), first match counts.
TOOL_RULES = (
    ("flight", "SEARCH", {"domain": "flight"}, "exact"),
    ("hotel|lodging|accommodation", "SEARCH", {"domain": "hotel"}, "exact"),
    ("weather|forecast", "SEARCH", {"domain": "weather"}, "exact"),
    ("news|article", "SEARCH", {"domain": "news"}, "exact"),
    ("map|direction|route|navigat", "SEARCH", {"domain": "maps"}, "exact"),
    ("restaurant|food|recipe", "SEARCH", {"domain": "product"}, "exact"),
    ("stock|market|ticker|quote", "QUERY_DB", {"table": "market"}, "exact"),
    ("currency|convert.*money|exchange.*rate", "CONVERT", {}, "exact"),
    ("calendar|event|meeting|appointment|schedule", "EXEC_ACTION", {"action": "create_event"}, "exact"),
    ("book|reserv|order|purchase|buy|checkout", "EXEC_ACTION", {"action": "book"}, "exact"),
    ("translat", "TRANSLATE", {}, "exact"),
    ("summar", "SUMMARIZE", {}, "exact"),
    ("entit|ner", "EXTRACT_ENTITIES", {}, "exact"),
    ("classif|categor|label", "CLASSIFY", {}, "exact"),
    ("code|program|script", "CODEGEN", {}, "exact"),
    ("search|find|lookup", "SEARCH", {"domain": "web"}, "heuristic"),
    ("email|mail", "SEND", {"channel": "email"}, "heuristic"),
    ("sms|text|message|notify", "SEND", {"channel": "sms"}, "heuristic"),
    ("calculat|math|comput|evaluate|arithmetic", "CALCULATE", {}, "heuristic"),
    ("database|sql|db|repo.*query", "QUERY_DB", {"table": "generic"}, "heuristic"),
    ("fetch|download|get_|http|url", "FETCH", {}, "heuristic"),
)
# Confidence of a mapping.
CONFIDENCE = {"exact": 0.95, "heuristic": 0.70, "fallback": 0.30}
MAX_VALUE = 200


def map_tool(name: str, args: dict) -> tuple[str, dict, str]:
    """(op, params, kind): all arguments stay under their names, nested ones as JSON of at most 200
    characters; the rule's own parameter wins over one of that name. An unknown tool is a generic action
    named after its words, without the vendor in front."""
    low = (name or "").lower()
    own: dict = {}
    op, kind = "EXEC_ACTION", "fallback"
    for pattern, rule_op, fixed, sure in TOOL_RULES:
        if re.search(pattern, low):
            op, kind = rule_op, sure
            own = dict(fixed)
            break
    else:
        words = re.findall(r"[^.:_\-\s]+", low)
        own = {"action": " ".join(words[1:] or words) or "call"}
    for key, value in args.items():
        if value is not None and key not in own:
            own[key] = value if isinstance(value, (str, int, float, bool)) else json.dumps(value, ensure_ascii=False)[:MAX_VALUE]
    return op, own, kind


def tool_rules(name_column):
    """The same mapping of names to ops as a column."""
    from ..functions.text import first_match

    return first_match(F.lower(name_column), [(p, op) for p, op, _, _ in TOOL_RULES], "EXEC_ACTION")


def lift_calls(name: str, calls: list[tuple[str, dict]]) -> tuple[Program, list[str]]:
    """A chain of calls: ops that need data read the call before (the request, if there is none), the others
    are ordered after it."""
    from . import isa

    nodes, kinds = [], []
    for i, (tool, args) in enumerate(calls):
        op, params, kind = map_tool(tool, args)
        kinds.append(kind)
        before = f"%c{i}" if i else "@request"
        spec = isa.TABLE[op]
        takes_data = spec.min_inputs > 0
        fits = spec.input_types[0] == "Any" or (i == 0)
        inputs = (before,) if takes_data and fits else ("@request",) if takes_data else ()
        after = (before,) if i and before not in inputs else ()
        nodes.append(Node(f"%c{i + 1}", op, inputs, params, after=after))
    used = any("@request" in n.inputs for n in nodes)
    return Program(name, tuple(nodes), nodes[-1].id if nodes else "", (("@request", "Str"),) if used else ()), kinds


def lift_sql(name: str, sql: str) -> tuple[Program | None, str]:
    """A query, and an extraction of its columns if these are plain names; (None, reason) if it is no SELECT
    with a FROM."""
    flat = " ".join(sql.split()).rstrip("; ")
    m = re.match(r"(?i)select\s+(.+?)\s+from\s+([\w.\"`]+)", flat)
    if not m:
        return None, "no select from a table"
    nodes = [Node("%q", "QUERY_DB", ("@sql",), {"table": m[2].strip('"`')})]
    columns = [c.strip() for c in re.sub(r"(?i)^distinct\s+", "", m[1]).split(",")]
    if all(re.fullmatch(r"(?:\w+\.)?\w+", c) for c in columns):
        nodes.append(Node("%x", "EXTRACT", ("%q",), {"fields": [c.split(".")[-1] for c in columns]}))
    return Program(name, tuple(nodes), nodes[-1].id, (("@sql", "Str"),)), ""


_REDUCERS = {"sum": "SUM", "len": "COUNT", "max": "MAX", "min": "MIN", "sorted": "SORT"}


def lift_function(name: str, code: str) -> tuple[Program | None, str]:
    """A Python function of one return: list comprehensions with a condition filter, others transform; sum,
    len, min, max and sorted are ops; set(...) removes repeats; + of two lists joins them."""
    try:
        tree = ast.parse(code)
    except SyntaxError as fault:
        return None, f"syntax: {fault.msg}"
    found = [n for n in tree.body if isinstance(n, ast.FunctionDef)]
    if not found:
        return None, "no function"
    body = [s for s in found[-1].body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
    if len(body) != 1 or not isinstance(body[0], ast.Return) or body[0].value is None:
        return None, "more than one statement"
    arguments = {a.arg for a in found[-1].args.args}
    nodes: list[Node] = []

    def put(op: str, *inputs: str, **params: object) -> str:
        nodes.append(Node(f"%n{len(nodes) + 1}", op, inputs, params))
        return nodes[-1].id

    def walk(e: ast.expr) -> str | None:
        if isinstance(e, ast.Name) and e.id in arguments:
            return f"@{e.id}"
        if isinstance(e, (ast.ListComp, ast.GeneratorExp)) and len(e.generators) == 1:
            source = walk(e.generators[0].iter)
            if source is None:
                return None
            for test in e.generators[0].ifs:
                source = put("FILTER", source, predicate=ast.unparse(test))
            same = isinstance(e.elt, ast.Name) and isinstance(e.generators[0].target, ast.Name) and e.elt.id == e.generators[0].target.id
            return source if same else put("TRANSFORM", source, op=ast.unparse(e.elt))
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and len(e.args) == 1:
            inner = walk(e.args[0])
            if inner is None:
                return None
            if e.func.id == "list":
                return inner
            if e.func.id == "set":
                return put("DEDUP", inner)
            return put(_REDUCERS[e.func.id], inner) if e.func.id in _REDUCERS else None
        if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add):
            a, b = walk(e.left), walk(e.right)
            return put("JOIN", a, b) if a and b else None
        return None

    output = walk(body[0].value)
    if output is None or not nodes:
        return None, "no operation that is known"
    inputs = tuple((f"@{a}", "List[Any]") for a in sorted(arguments) if any(f"@{a}" in n.inputs for n in nodes))
    return Program(name, tuple(nodes), output, inputs), ""


_SIGNAL = re.compile(r"\b(?:input|output|inout)\s+(?:wire|reg|logic)?\s*(?:\[[^\]]*\]\s*)?([A-Za-z_]\w*)")


def lift_rtl(name: str, task: str | None, rtl: str) -> tuple[Program | None, str]:
    """Repair of a hardware design: its ports and failures are read, known bugs looked up, a fix is written and
    verified, three times at most."""
    if not isinstance(task, str) or not task:
        return None, "no task"
    ports = _SIGNAL.findall(rtl) or ["clk", "rst", "data"]
    nodes = (
        Node("%design", "LOAD", ("@task",), {"source": "design.sv + waveform.vcd", "kind": "design_artifacts"}),
        Node("%facts", "EXTRACT", ("%design",), {"fields": [*ports, "assertion_failures"]}),
        Node("%known", "SEARCH", ("@task",), {"domain": "rtl", "corpus": "known_bug_db"}, output_type="List[Rtl]"),
        Node("%fix", "CODEGEN", ("%facts", "%known", "@task"), {"role": "rtl_fix", "target": "design.sv"}, retry=(3, "%verify")),
        Node("%verify", "VERIFY", ("%fix", "%facts"), {"check": "syntax_and_lint_and_assertion_pass"}),
    )
    return Program(name, nodes, "%fix", (("@task", "Str"),)), ""


LIFTED = "id string, source string, text string, reason string, kinds array<string>, valid boolean, warnings array<string>"


def lift_table(raw: DataFrame) -> DataFrame:
    """Raw samples -> program text, the reason where there is none, mapping kinds and the validator's word."""

    def one(row) -> tuple:
        kinds: list[str] = []
        if row.trajectory is not None and len(row.trajectory):
            calls = []
            for step in row.trajectory:
                try:
                    args = json.loads(step["args"] or "{}")
                except ValueError:
                    args = {"value": step["args"]}
                calls.append((step["tool"], args if isinstance(args, dict) else {"value": args}))
            program, kinds = lift_calls(row.id, calls)
            reason = ""
        elif isinstance(row.sql, str):
            program, reason = lift_sql(row.id, row.sql)
        elif isinstance(row.code, str):
            program, reason = lift_function(row.id, row.code)
        elif isinstance(row.rtl, str):
            program, reason = lift_rtl(row.id, row.input_text, row.rtl)
        else:
            program, reason = None, "unsupported"
        if program is None:
            return row.id, row.source, None, reason, kinds, False, []
        report = validate(program)
        return row.id, row.source, to_text(program), None, kinds, report.valid, sorted(report.codes("warning"))

    def lift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame([one(r) for r in frame.itertuples(index=False)], columns=[c.split()[0] for c in LIFTED.split(", ")])

    return raw.select("id", "source", "trajectory", "sql", "code", "rtl", "input_text").mapInPandas(lift, LIFTED)


def corpus(raw: DataFrame) -> DataFrame:
    """Lifted samples with their quality tier, in one pass."""
    from ..operators.corpus import quality_tier

    lifted = lift_table(raw)
    synthetic = F.contains("source", F.lit("synthetic"))
    return lifted.withColumn("tier", quality_tier(F.coalesce("kinds", F.array().cast("array<string>")), synthetic))
