from __future__ import annotations

import pytest
from pyspark.sql import types as T

from millrace.functions import paths
from millrace.operators import graph
from millrace.plans import isa, lifting, program, rewrite
from millrace.plans.engine import Engine, RunFailure
from millrace.plans.program import Node, Program
from millrace.plans.validator import validate

TEXT = """; program v0.1  module=demo
; task: two\\nlines
; provenance.source: unit
inputs: @rows: List[Map[Str, List[Int]]]

%a = FILTER(@rows, predicate="x > 1, y")  -> List[Any]  hints(tool="t")
%v = VERIFY(%a, check="x > 1")
%b = EXEC_ACTION(action="go", n=[1, 2])  after(%a)  bind(k=%a)  guard(%v == true)  retry(on=error, max=3)

return %b
"""


def test_text_round_trip():
    p = program.parse(TEXT)
    assert p.description == "two\nlines"
    assert p.inputs == (("@rows", "List[Map[Str, List[Int]]]"),)
    assert p.nodes[0].params == {"predicate": "x > 1, y"}
    assert p.nodes[2].guard == ("%v", True) and p.nodes[2].retry == (3, "error") and p.nodes[2].param_refs == {"k": "%a"}
    assert program.parse(program.to_text(p)) == p
    assert program.from_dict(program.to_dict(p)) == p


@pytest.mark.parametrize("text", ["", "return %a", "%a = FILTER(@x", "%a = COUNT(@x)\nreturn a", "%a = COUNT(@x) what(1)\nreturn %a"])
def test_bad_text(text):
    with pytest.raises(program.SyntaxFault):
        program.parse(text)


def codes(text: str, **more) -> set[str]:
    return validate(program.parse("; program v0.1  module=m\n" + text), **more).codes()


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("%a = COUNT(@x)\nreturn %a", "UNDEFINED_REF"),
        ("%a = COUNT(%b)\n%b = LOAD(@s)\nreturn %a", "UNDEFINED_REF"),
        ("inputs: @s: Str\n%a = COUNT(%b)\n%b = LOAD(@s)\nreturn %a", "USE_BEFORE_DEF"),
        ("inputs: @s: Str\n%a = NOPE(@s)\nreturn %a", "SKILL_UNKNOWN"),
        ("inputs: @s: Str\n%a = LOAD(@s)\n%b = JOIN(%a)\nreturn %b", "ARITY"),
        ("inputs: @s: Str\n%a = COUNT(@s)\nreturn %a", "TYPE_MISMATCH"),
        ("inputs: @s: Str\n%a = LOAD(@s)\nreturn %z", "OUTPUT"),
        ("inputs: @s: Str\n%a = LOAD(@s)  guard(@s == true)\nreturn %a", "TYPE_MISMATCH"),
        ("inputs: @s: Str\n%a = LOAD(@s)  retry(on=%b, max=2)\n%b = LOAD(@s)\nreturn %a", "CONTROL"),
        ("inputs: @s: Str\n%a = EXEC_ACTION(action=\"x\", k=1)  bind(k=@s)\nreturn %a", "PARAM_CONFLICT"),
        ("%a = EXTRACT_FIELD(%b, field=\"_x\")\n%b = EXEC_ACTION(action=\"t\")\nreturn %a", "FIELD_PATH_SYNTAX"),
        ("%a = LOAD(%b)\n%b = LOAD(%a)\nreturn %a", "CYCLE"),
    ],
)
def test_validator_finds(text, code):
    assert code in codes(text)


def test_validator_warnings_and_schemas():
    report = validate(program.parse("inputs: @s: Str, @u: Str\n%a = LOAD(@s)\n%b = LOAD(@s)\nreturn %a"))
    assert report.valid and {"DEAD_NODE", "UNUSED_INPUT"} <= report.codes("warning")
    schema = T.StructType([T.StructField("orders", T.ArrayType(T.StructType([T.StructField("id", T.StringType())]))), T.StructField("free", T.VariantType())])
    tools = {"t": {"output_schema": schema}}
    text = '%%p = EXEC_ACTION(action="t")\n%%f = EXTRACT_FIELD(%%p, field="%s")\nreturn %%f'
    found = validate(program.parse(text % "orders[0].id"), tools)
    assert found.valid and found.types["%f"] == "Str"
    assert "FIELD_NOT_FOUND" in validate(program.parse(text % "orders.id"), tools).codes()
    assert "DYNAMIC_CHECK_BOUNDARY" in validate(program.parse(text % "free.x.y"), tools).codes("warning")


def test_types():
    assert isa.compatible("Map[Str, List[Int]]", "Map[Str,List[Any]]")
    assert not isa.compatible("List[Int]", "List[Float]") and not isa.compatible("Int", "Float")
    assert isa.TABLE["ARGMIN"].output_type(["List[Flight]"]) == "Flight"
    assert len(isa.TABLE) == 35


def run(spark, text, inputs=None, **actions):
    return Engine(spark, {}, actions).run(program.parse("; program v0.1  module=m\n" + text), inputs)


def test_guard_select_and_skip(spark):
    text = 'inputs: @c: Bool\n%a = EXEC_ACTION(action="one")  guard(@c == true)\n%b = EXEC_ACTION(action="two")  guard(@c == false)\n%s = SELECT(@c, %a, %b)\nreturn %s'
    actions = {"one": lambda i, p, n: 1, "two": lambda i, p, n: 2}
    assert run(spark, text, {"@c": True}, **actions).value == 1
    result = run(spark, text, {"@c": False}, **actions)
    assert result.value == 2 and [e.status for e in result.events] == ["ok", "ok"]
    with pytest.raises(RunFailure, match="skipped"):
        run(spark, 'inputs: @c: Bool\n%a = EXEC_ACTION(action="one")  guard(@c == true)\n%b = EXEC_ACTION(%a, action="one")\nreturn %b', {"@c": False}, **actions)


def test_skipped_condition_skips(spark):
    text = 'inputs: @c: Bool\n%a = VERIFY(@c)  guard(@c == true)\n%b = EXEC_ACTION(action="one")  guard(%a == true)\nreturn %b'
    assert repr(run(spark, text, {"@c": False}, one=lambda i, p, n: 1).value) == "<skipped>"


def test_retry_on_error(spark):
    def flaky(inputs, params, attempt):
        if attempt < 3:
            raise RunFailure("no")
        return attempt

    text = '%a = EXEC_ACTION(action="f")  retry(on=error, max=3)\nreturn %a'
    result = run(spark, text, f=flaky)
    assert result.value == 3 and [e.status for e in result.events] == ["error", "error", "ok"]
    with pytest.raises(RunFailure):
        run(spark, text.replace("max=3", "max=2"), f=flaky)


def test_rollback_reruns_dependents(spark):
    calls = []

    def produce(inputs, params, attempt):
        return attempt

    def follow(inputs, params, attempt):
        calls.append(inputs[0])
        return inputs[0] >= 2

    text = '%a = EXEC_ACTION(action="p")  retry(on=%v, max=3)\n%b = EXEC_ACTION(%a, action="q")\n%v = VERIFY(%b)\n%o = EXEC_ACTION(%a, action="p2")  after(%v)\nreturn %o'
    result = run(spark, text, p=produce, q=follow, p2=lambda i, p, n: i[0])
    assert result.value == 2 and calls == [1, 2]
    assert sum(e.superseded for e in result.events) == 4
    with pytest.raises(RunFailure, match="stays false"):
        run(spark, text.replace("max=3", "max=1"), p=produce, q=follow, p2=lambda i, p, n: i[0])


def test_bind_and_field(spark):
    text = '%u = EXEC_ACTION(action="user")\n%f = EXTRACT_FIELD(%u, field="orders[0].id")\n%g = EXEC_ACTION(action="get")  bind(id=%f)\nreturn %g'
    found = run(spark, text, user=lambda i, p, n: {"orders": [{"id": "o1"}]}, get=lambda i, p, n: p["id"])
    assert found.value == "o1"
    with pytest.raises(RunFailure, match="INDEX_OUT_OF_RANGE"):
        run(spark, text, user=lambda i, p, n: {"orders": []}, get=lambda i, p, n: p)


def test_collection_ops(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 3.0), (2, "b", None), (2, "b", None)], "id int, name string, price double")
    engine = Engine(spark, {"t": rows, "rates": spark.createDataFrame([("USD", "EUR", 0.5)], "from string, to string, rate double")})
    assert engine.apply("COUNT", {}, [engine.apply("DEDUP", {}, [rows])]) == 2
    assert engine.apply("ARGMIN", {"key": "price"}, [rows]).first().id == 2
    assert engine.apply("SUM", {"key": "price"}, [rows]) == 3.0
    assert engine.apply("AVG", {"key": "price"}, [rows.where("false")]) == 0.0
    assert engine.apply("CONVERT", {"from": "USD", "to": "EUR"}, [3.0]) == 1.5
    assert engine.apply("CALCULATE", {"expression": "v0 * 2 + v1"}, [2, 1]) == 5
    assert engine.apply("COMPARE", {"operator": ">="}, [2, 1]) is True
    assert engine.apply("QUERY_DB", {"query": "SELECT max(id) AS m FROM {t}"}, []).first().m == 2
    assert engine.apply("MERGE", {}, [{"a": 1}, {"a": 2}]) == {"a": 2}
    assert engine.apply("JOIN", {"separator": "-"}, ["x", "y"]) == "x-y"
    assert engine.apply("SAVE", {"path": str(tmp_path / "out")}, [rows])["status"] == "saved"
    with pytest.raises(RunFailure):
        engine.apply("ARGMAX", {"key": "price"}, [rows.where("false")])
    with pytest.raises(ValueError):
        engine.apply("CALCULATE", {"expr": "java_method('x')"}, [])


def test_paths():
    assert paths.parse("orders[0].order_id") == ["orders", 0, "order_id"] and paths.parse("") == []
    for bad in ("a.", ".a", "a..b", "a[-1]", "a[01]", "_x", "a.__class__", "a[0]b", "[0]", "a b"):
        with pytest.raises(paths.PathError):
            paths.parse(bad)
    assert paths.resolve({"a": [1]}, "a[1]")[0] == "INDEX_OUT_OF_RANGE"
    assert paths.resolve({"a": 1}, "a[0]")[0] == "INDEX_ON_NON_LIST"
    assert paths.resolve({"a": 1}, "b")[0] == "FIELD_NOT_FOUND"


def test_lifting():
    assert lifting.map_tool("Vendor.do_thing", {"x": [1]}) == ("EXEC_ACTION", {"action": "do thing", "x": "[1]"}, "fallback")
    assert lifting.map_tool("search_flights", {"domain": "no", "q": "z"}) == ("SEARCH", {"domain": "flight", "q": "z"}, "exact")
    p, kinds = lifting.lift_calls("x", [("search_web", {"q": "a"}), ("send_email", {"to": "b"})])
    assert kinds == ["heuristic", "heuristic"] and validate(p).valid
    q, _ = lifting.lift_sql("s", "SELECT t.a, b FROM t WHERE c = 1")
    assert q.nodes[1].params == {"fields": ["a", "b"]} and validate(q).valid
    assert lifting.lift_sql("s", "DELETE FROM t")[0] is None
    f, _ = lifting.lift_function("f", "def f(xs):\n    'doc'\n    return sum([x for x in xs if x > 1])")
    assert [n.op for n in f.nodes] == ["FILTER", "SUM"] and validate(f).valid
    assert lifting.lift_function("f", "def f(x):\n    y = 1\n    return y")[0] is None


def test_patch_and_lowering():
    p = Program("p", (Node("%a", "LOAD", ("@s",)), Node("%b", "COUNT", ("%a",))), "%b", (("@s", "Str"),))
    q = rewrite.patch(p, [{"kind": "RENAME_SSA", "node": "%a", "new": "%z"}, {"kind": "INSERT_BEFORE", "node": "%b", "new": Node("%d", "DEDUP", ("%z",))}, {"kind": "REPLACE_INPUT", "node": "%b", "old": "%z", "new": "%d"}])
    assert [n.id for n in q.nodes] == ["%z", "%d", "%b"]
    with pytest.raises(rewrite.PatchError, match="frozen"):
        rewrite.patch(p, [{"kind": "RENAME_SSA", "node": "%a", "new": "%z"}], scope={"%b"})
    assert rewrite.slice_of(p, {"%b"}, 1)["over_budget"]
    steps = [rewrite.Step("s1", "find"), rewrite.Step("s2", "pay", {"id": ("ref", "s1", "orders[0].id"), "also": ("ref", "s1", "orders[0].id")}, mutates=True), rewrite.Step("s3", "mail", {"x": ("literal", 1)}, mutates=True)]
    low = rewrite.lower("l", steps)
    assert [n.op for n in low.nodes] == ["EXEC_ACTION", "EXTRACT_FIELD", "EXEC_ACTION", "EXEC_ACTION"]
    assert low.node("%s3").after == ("%s2",) and validate(low).valid
    with pytest.raises(rewrite.PatchError):
        rewrite.lower("l", [rewrite.Step("s", "t", {"x": ("unresolved",)})])
    idle = Program("i", (Node("%a", "EXEC_ACTION", (), {"action": "r"}), Node("%b", "EXEC_ACTION", ("%a",), {"action": "r"})), "%b")
    assert rewrite.drop_idle_inputs(idle, {"%a", "%b"})[0].node("%b").inputs == ()
    assert rewrite.drop_idle_inputs(idle, {"%b"})[0].node("%b").inputs == ("%a",)


def test_schedulers(spark):
    nodes = spark.createDataFrame([("p", "a", 0, "api", 120.0), ("p", "b", 1, "api", 50.0), ("p", "c", 2, "python", 5.0)], "program_id string, node string, pos int, resource_class string, weight double")
    edges = spark.createDataFrame([("p", "a", "c", 0.1), ("p", "b", "c", 0.1)], "program_id string, src string, dst string, cost double")
    one = {r.node: r.end_ms for r in graph.list_schedule(nodes, edges).collect()}
    assert one == {"a": 120.0, "b": 170.0, "c": 175.0}
    two = {r.node: r.end_ms for r in graph.list_schedule(nodes, edges, {"api": 2}).collect()}
    assert two == {"a": 120.0, "b": 50.0, "c": 125.0}
    heft = {r.node: r.end_ms for r in graph.heft_schedule(nodes, edges).collect()}
    assert heft == {"a": 120.0, "b": 50.0, "c": 125.1}


def test_graph_small(spark):
    nodes = spark.createDataFrame([("p", n, o) for n, o in (("a", "LOAD"), ("f", "EXTRACT_FIELD"), ("g", "EXTRACT_FIELD"), ("b", "COUNT"))], "program_id string, node string, op string")
    edges = spark.createDataFrame([("p", "a", "f"), ("p", "f", "g"), ("p", "g", "b")], "program_id string, src string, dst string")
    assert {(r.node, r.producer) for r in graph.producers(nodes, edges).collect()} == {("f", "a"), ("g", "a")}
    assert [(r.src, r.dst) for r in graph.contract_nodes(edges, nodes, "EXTRACT_FIELD").collect()] == [("a", "b")]
    assert graph.shapes(nodes, edges).first().shape == "linear"
    assert {r.node for r in graph.reachable(edges, nodes.where("node = 'f'")).collect()} == {"f", "g", "b"}


def test_parse_table(spark):
    texts = spark.createDataFrame([("good", TEXT), ("bad", "nope")], "id string, text string")
    nodes, edges, faults = program.parse_table(texts, "id", "text")
    assert nodes.count() == 3 and nodes.where("is_output").first().node == "%b"
    assert {(r.src, r.dst, r.kind) for r in edges.collect()} == {("%a", "%v", "input"), ("%a", "%b", "bind"), ("%a", "%b", "after"), ("%v", "%b", "guard")}
    assert faults.first().program_id == "bad"


@pytest.mark.parametrize("small", [100_000, 0])
def test_long_chains_and_cycles(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    n = 1500 if small else 12  # in rounds a shorter one: each is a job
    rows = [("chain", f"n{i}") for i in range(n)] + [("ring", x) for x in "abcd"]
    links = [("chain", f"n{i}", f"n{i + 1}") for i in range(n - 1)] + [("ring", "a", "b"), ("ring", "b", "c"), ("ring", "c", "b"), ("ring", "c", "d"), ("ring", "x", "a")]
    nodes, edges = spark.createDataFrame(rows, "program_id string, node string"), spark.createDataFrame(links, "program_id string, src string, dst string")
    assert {(r.program_id, r.depth) for r in graph.depth_and_width(nodes, edges).collect()} == {("chain", n), ("ring", 1)}
    assert [(r.program_id, r.n_stuck) for r in graph.cyclic_programs(nodes, edges).collect()] == [("ring", 3)]
    starts = spark.createDataFrame([("chain", "n3"), ("ring", "b")], "program_id string, node string")
    reached = graph.reachable(edges, starts).collect()
    assert sum(r.program_id == "chain" for r in reached) == n - 3 and {r.node for r in reached if r.program_id == "ring"} == {"b", "c", "d"}
    back = graph.reachable(edges, starts, forward=False).collect()
    assert sum(r.program_id == "chain" for r in back) == 4 and {r.node for r in back if r.program_id == "ring"} == {"a", "b", "c", "x"}


def test_heft_with_weights_of_zero(spark):
    nodes = spark.createDataFrame([("p", n, i, 0.0) for i, n in enumerate("zyx")], "program_id string, node string, pos int, weight double")
    edges = spark.createDataFrame([("p", "z", "y", 0.0), ("p", "y", "x", 0.0)], "program_id string, src string, dst string, cost double")
    assert {r.node: r.end_ms for r in graph.heft_schedule(nodes, edges).collect()} == {"x": 0.0, "y": 0.0, "z": 0.0}


def test_producers_through_long_chains(spark):
    rows = [("p", "a", "LOAD")] + [("p", f"f{i}", "EXTRACT_FIELD") for i in range(11)]
    links = [("p", "a", "f0")] + [("p", f"f{i}", f"f{i + 1}") for i in range(10)]
    nodes, edges = spark.createDataFrame(rows, "program_id string, node string, op string"), spark.createDataFrame(links, "program_id string, src string, dst string")
    assert {r.producer for r in graph.producers(nodes, edges).collect()} == {"a"} and graph.producers(nodes, edges).count() == 11
    with pytest.raises(ValueError, match="cycle"):
        graph.producers(nodes, edges.unionByName(spark.createDataFrame([("p", "f3", "f1")], edges.schema)).where("src <> 'f0' OR dst <> 'f1'"))


def test_rtl_samples_are_lifted(spark):
    from millrace.sources import generators

    found = lifting.corpus(generators.samples(spark, 200)).where("source = 'rtl'").collect()
    assert found and all(r.valid and "CODEGEN" in r.text and "VERIFY" in r.text for r in found)
