"""Datasets of several formats as one raw-sample table:

(id, source, input_text, trajectory array<struct<tool, args json>>, code, sql, rtl, metadata json).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CALL = "array<struct<tool:string,args:string>>"
COLUMNS = ("id", "source", "input_text", "trajectory", "code", "sql", "rtl", "metadata")
MAX_DEPTH = 12


def _raw(df: DataFrame, source: str, id_: Column, **given: Column) -> DataFrame:
    kinds = {"trajectory": CALL}
    cells = [given[c].alias(c) if c in given else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS[2:]]
    return df.select(F.concat(F.lit(f"{source}:"), id_.cast("string")).alias("id"), F.lit(source).alias("source"), *cells)


def _any(df: DataFrame, *names: str) -> Column:
    """The first of several column names that is there and not null, as text."""
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def xlam(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays; ``answers`` is JSON text of calls (name, arguments); records without a call go."""
    df = spark.read.json(path, multiLine=True)
    calls = F.from_json(_any(df, "answers"), "array<struct<name:string,arguments:string>>")
    steps = F.transform(calls, lambda c: F.struct(c["name"].alias("tool"), c["arguments"].alias("args")))
    out = _raw(df, "xlam", _any(df, "id"), input_text=_any(df, "query", "instruction"), trajectory=steps, metadata=_any(df, "tools"))
    return out.where(F.size("trajectory") > 0)


def tool_trees(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files in which calls may stand anywhere: each object with a name and arguments is a call,
    in order of appearance, repeats once; MAX_DEPTH levels deep."""

    def walk(value: object, depth: int) -> Iterator[tuple[str, str]]:
        if depth > MAX_DEPTH:
            return
        if isinstance(value, dict):
            name = value.get("name") or value.get("action")
            args = value.get("arguments", value.get("action_input"))
            if isinstance(name, str) and args is not None:
                yield name, args if isinstance(args, str) else json.dumps(args, sort_keys=True)
            for inner in value.values():
                yield from walk(inner, depth + 1)
        elif isinstance(value, list):
            for inner in value:
                yield from walk(inner, depth + 1)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for file, text in zip(frame["file"], frame["value"], strict=True):
                try:
                    record = json.loads(text)
                except ValueError:
                    continue
                calls = list(dict.fromkeys(walk(record, 0)))
                asked = record.get("query") if isinstance(record, dict) else None
                rows.append((file, asked, [{"tool": t, "args": a} for t, a in calls]))
            yield pd.DataFrame(rows, columns=["file", "asked", "calls"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    found = files.mapInPandas(read, f"file string, asked string, calls {CALL}")
    return _raw(found, "tooltree", F.element_at(F.split("file", "/"), -1), input_text=F.col("asked"), trajectory=F.col("calls"))


def react_dialogs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of conversations: the last user message, and calls in Action / Action Input text."""
    df = spark.read.schema("id string, conversations array<struct<from:string,value:string>>").json(path)
    said = lambda who: F.filter("conversations", lambda m: m["from"] == who)
    answers = F.array_join(F.transform(said("assistant"), lambda m: m["value"]), "\n")
    names = F.regexp_extract_all(answers, F.lit("Action:[ ]*([^\\n]+)"), F.lit(1))
    args = F.regexp_extract_all(answers, F.lit("Action Input:[ ]*([^\\n]+)"), F.lit(1))
    steps = F.transform(names, lambda n, i: F.struct(n.alias("tool"), F.coalesce(F.get(args, i), F.lit("{}")).alias("args")))
    asked = F.get(F.reverse(said("user")), F.lit(0))["value"]
    return _raw(df, "react", F.col("id"), input_text=asked, trajectory=steps)


def api_calls(spark: SparkSession, path: str) -> DataFrame:
    """A document with ``samples``, or a bare list; several key names for the same thing."""
    df = spark.read.json(path, multiLine=True)
    if "samples" in df.columns:
        df = df.select(F.explode("samples").alias("s")).select("s.*")
    call = F.struct(_any(df, "api", "tool", "name").alias("tool"), _any(df, "args", "arguments", "parameters").alias("args"))
    steps = F.when(call["tool"].isNotNull(), F.array(call)).otherwise(F.array().cast(CALL))
    return _raw(df, "api", _any(df, "id", "sample_id"), input_text=_any(df, "instruction", "input", "query"), trajectory=steps)


def text_to_sql(spark: SparkSession, paths: dict[str, str], max_per_split: int | None = None, source: str = "sql") -> DataFrame:
    """JSON arrays by split name: question, SQL or query, db_id."""
    out = None
    for split, path in paths.items():
        df = spark.read.option("recursiveFileLookup", "true").json(path, multiLine=True)
        rows = df.select(_any(df, "question").alias("q"), _any(df, "SQL", "query").alias("s"), _any(df, "db_id").alias("db"))
        keyed = rows.withColumn("k", F.md5(F.concat_ws("|", "db", "q", "s")))
        if max_per_split is not None:
            keyed = keyed.orderBy("k").limit(max_per_split)
        meta = F.to_json(F.struct(F.lit(split).alias("split"), F.col("db").alias("db_id")))
        part = _raw(keyed, source, F.concat(F.lit(f"{split}:"), F.left("k", F.lit(12))), input_text=F.col("q"), sql=F.col("s"), metadata=meta)
        out = part if out is None else out.unionByName(part)
    return out


def code_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, gzip or not: task_id, prompt, canonical_solution."""
    df = spark.read.schema("task_id string, prompt string, canonical_solution string").json(path)
    return _raw(df, "code", F.col("task_id"), input_text=F.col("prompt"), code=F.concat("prompt", "canonical_solution"))


def code_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header: task_id, text, code; a body without ``def`` is put into one."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    wrapped = F.concat(F.lit("def solve():\n    "), F.regexp_replace("code", "\n", "\n    "))
    return _raw(df, "snippets", F.col("task_id"), input_text=F.col("text"), code=F.when(F.contains("code", F.lit("def ")), F.col("code")).otherwise(wrapped))


def rtl_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``x_prompt.txt`` with ``x_test.sv``: the prompt and the first six port names of the test bench."""

    def files(suffix: str, column: str) -> DataFrame:
        read = spark.read.text(f"{folder}/*{suffix}", wholetext=True)
        stem = F.regexp_extract(F.input_file_name(), f"([^/]+){suffix}$", 1)
        return read.select(stem.alias("stem"), F.col("value").alias(column))

    both = files("_prompt.txt", "prompt").join(files("_test.sv", "bench"), "stem")
    ports = F.regexp_extract_all("bench", F.lit("\\b(?:input|output|wire|reg|logic)\\s+(?:\\[[^\\]]*\\]\\s*)?([A-Za-z_]\\w*)"), F.lit(1))
    signals = F.slice(F.array_distinct(ports), 1, 6)
    return _raw(both, "rtl", F.col("stem"), input_text=F.col("prompt"), rtl=F.col("bench"), metadata=F.to_json(F.struct(signals.alias("signals"))))


def with_gold(questions: DataFrame, gold: DataFrame, marked: DataFrame | None = None, on: str = "id") -> DataFrame:
    """Questions with their reference answers by id, and whether a marker list names them."""
    out = questions.join(gold, on, "left")
    if marked is None:
        return out.withColumn("marked", F.lit(False))
    ids = marked.select(on).distinct().withColumn("_m", F.lit(True))
    return out.join(ids, on, "left").withColumn("marked", F.coalesce("_m", F.lit(False))).drop("_m")


def with_split(tasks: DataFrame, split_map: DataFrame, on: str = "id") -> DataFrame:
    """Tasks with the split that a table (split, ids array) puts them in."""
    listed = split_map.select("split", F.explode("ids").alias(on))
    return tasks.join(listed, on, "left")


FORBIDDEN = ("plan_target", "gold_plan", "op_sequence", "lowering")


def eval_samples(df: DataFrame) -> DataFrame:
    """Refuses tables that carry supervision."""
    bad = [c for c in df.columns if c in FORBIDDEN]
    if bad:
        raise ValueError(f"evaluation samples hold supervision: {bad}")
    return df


def distinct_steps(df: DataFrame, by: str, step: str, columns: list[str]) -> DataFrame:
    """The first of each repeated call of a trajectory."""
    first = F.row_number().over(Window.partitionBy(by, *columns).orderBy(step))
    return df.withColumn("_r", first).where("_r = 1").drop("_r")


READERS: dict[str, Callable[..., DataFrame]] = {
    "xlam": xlam,
    "tooltree": tool_trees,
    "react": react_dialogs,
    "api": api_calls,
    "sql": text_to_sql,
    "code": code_jsonl,
    "snippets": code_csv,
    "rtl": rtl_pairs,
}


def readers_for(names: list[str]) -> list[Callable[..., DataFrame]]:
    unknown = [n for n in names if n not in READERS]
    if unknown:
        raise KeyError(f"no reader for {unknown}")
    return [READERS[n] for n in names]
