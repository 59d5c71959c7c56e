from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import generators, guard, readers, sinks
from millrace.streaming import contracts, windows

from .test_operators import WANTED, submission_rows


def test_firewall():
    assert guard.assert_not_external("/data/train/x", ["/data/eval"])
    for path in ("/data/eval/x", "/data/train/../eval/x", "file:///data/eval"):
        with pytest.raises(guard.ExternalDataError):
            guard.assert_not_external(path, ["/data/eval"])
    assert guard.assert_not_external("/data/eval/x", ["/data/eval"], allow=True)


def test_readers(spark, tmp_path):
    put = lambda name, value: (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
    put("x.json", [{"id": 1, "query": "q", "answers": json.dumps([{"name": "f", "arguments": {"a": 1}}])}, {"id": 2, "query": "r", "answers": "[]"}])
    x = readers.xlam(spark, str(tmp_path / "x.json")).collect()
    assert [(r.id, r.trajectory[0].tool) for r in x] == [("xlam:1", "f")]
    put("tree.json", {"query": "q", "steps": [{"name": "f", "arguments": {"a": 1}}, {"deep": [{"name": "f", "arguments": {"a": 1}}, {"action": "g", "action_input": "{}"}]}]})
    tree = readers.tool_trees(spark, str(tmp_path / "tree.json")).first()
    assert [c.tool for c in tree.trajectory] == ["f", "g"] and tree.input_text == "q"
    put("react.jsonl", json.dumps({"id": "1", "conversations": [{"from": "user", "value": "u"}, {"from": "assistant", "value": 'Action: t\nAction Input: {"k": 1}'}]}))
    react = readers.react_dialogs(spark, str(tmp_path / "react.jsonl")).first()
    assert react.input_text == "u" and react.trajectory[0].args == '{"k": 1}'
    put("api.json", {"samples": [{"id": 1, "input": "i", "api": "a", "args": "{}"}]})
    assert readers.api_calls(spark, str(tmp_path / "api.json")).first().trajectory[0].tool == "a"
    put("train.json", [{"question": "q", "SQL": "SELECT 1", "db_id": "d"}, {"question": "r", "SQL": "SELECT 2", "db_id": "d"}])
    assert readers.text_to_sql(spark, {"train": str(tmp_path / "train.json")}, max_per_split=1).count() == 1
    with gzip.open(tmp_path / "code.jsonl.gz", "wt") as f:
        f.write(json.dumps({"task_id": "t/1", "prompt": "def f():\n", "canonical_solution": "    return 1\n"}))
    assert readers.code_jsonl(spark, str(tmp_path / "code.jsonl.gz")).first().code.endswith("return 1\n")
    put("m.csv", 'task_id,text,code\n1,t,"return 1"\n')
    assert readers.code_csv(spark, str(tmp_path / "m.csv")).first().code.startswith("def solve")
    (tmp_path / "rtl").mkdir()
    put("rtl/p1_prompt.txt", "make it")
    put("rtl/p1_test.sv", "input clk; output [3:0] q; input clk;")
    assert json.loads(readers.rtl_pairs(spark, str(tmp_path / "rtl")).first().metadata) == {"signals": ["clk", "q"]}
    with pytest.raises(ValueError):
        readers.eval_samples(spark.range(1).withColumn("gold_plan", F.lit(1)))
    with pytest.raises(KeyError):
        readers.readers_for(["nope"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    sinks.write_splits(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    messages = spark.createDataFrame([("hi",), ("hi",)], "m string")
    sinks.append_outbox(messages, str(tmp_path / "o"), "mail", "m")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
    sinks.write_manifest(df, str(tmp_path / "m"), ["split"])
    frozen = spark.read.json(str(tmp_path / "m"))
    assert sinks.check_manifest(df, frozen, ["split"]).isEmpty()
    assert sinks.check_manifest(df.where("id = 1"), frozen, ["split"]).count() == 1
    assert sinks.markdown(df.orderBy("id")).splitlines()[2] == "| 1 | train |"


def test_generators_repeat(spark):
    assert generators.programs(spark, 50).collect() == generators.programs(spark, 50).collect()
    assert generators.samples(spark, 50, seed=1).collect() != generators.samples(spark, 50, seed=2).collect()


def drain(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_stream_equals_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "e"))
    stream = windows.windowed(windows.event_stream(spark, str(tmp_path / "e")), "1 day")
    got = {tuple(r) for r in drain(stream, "w").collect()}
    table = spark.read.parquet(str(tmp_path / "e")).withColumn("ts", F.col("ts").cast("timestamp"))
    wanted = {tuple(r) for r in windows.windowed(table, "1 day").collect()}
    assert got and got <= wanted  # windows that the watermark has not passed stay open


def test_contract_stream(spark, tmp_path):
    last = {name: max(r[1] for r in submission_rows() if r[0] == name) for name in WANTED}
    rows = [(*r, r[1] == last[r[0]]) for r in submission_rows()]
    schema = "sequence string, at int, op string, reg string, ready boolean, empty boolean, last boolean"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "c"))
    got = drain(contracts.check_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "c"))), "c").collect()
    assert {r.sequence: (r.judgment, r.contract) for r in got} == WANTED
