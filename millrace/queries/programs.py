"""Programs over the tables: parsing, validation, lifting and running them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lm
from ..operators import corpus, graph
from ..plans import isa, lifting, program
from ..plans.engine import Engine
from ..sources import generators
from . import Registry, table
from .core import r2

R = Registry()

CHEAPEST = """; program v0.1  module=cheapest
inputs: @rows: List[Any]
%near = FILTER(@rows, predicate="l_shipdate < '1996-01-01' AND l_quantity > 10")
%own = EXTRACT(%near, fields=["l_orderkey", "l_linenumber", "l_extendedprice"])  -> List[Any]
%ok = VERIFY(%near, check="l_quantity > 10")
%best = ARGMIN(%own, key="l_extendedprice")  after(%ok)
return %best
"""


@R.add(
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 10 ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 1"
)
def program_cheapest(spark: SparkSession, sf: str) -> DataFrame:
    engine = Engine(spark, {})
    return engine.run(program.parse(CHEAPEST), {"@rows": table(spark, sf, "lineitem")}).value


BRANCH = """; program v0.1  module=branch
inputs: @rows: List[Any]
%sum = SUM(@rows, key="o_totalprice")
%part = CALCULATE(%sum, expr="v0 / 100")
%big = COMPARE(%part, %sum, op="<")
%a = SORT(@rows, key="o_totalprice", order="desc")  guard(%big == true)
%b = DEDUP(@rows)  guard(%big == false)
%pick = SELECT(%big, %a, %b)
%top = ARGMAX(%pick, key="o_totalprice")
return %top
"""


@R.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def program_branch(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return Engine(spark, {}).run(program.parse(BRANCH), {"@rows": rows}).value


TRACED = ("FILTER", "TRANSFORM", "EXTRACT", "ARGMAX")


@R.add(
    f"""WITH c(ms, tokens) AS (VALUES {', '.join(f'({isa.TABLE[o].latency_ms}::DOUBLE, {isa.TABLE[o].tokens_in + isa.TABLE[o].tokens_out})' for o in TRACED)})
SELECT 'program' AS program_id, count(*) AS n_ok, sum(ms) AS latency_ms, sum(tokens)::BIGINT AS tokens, 0::BIGINT AS n_skipped FROM c"""
)
def program_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Trace totals of a run over the orders: the nominal costs of its four operations."""
    text = '%a = FILTER(@r, predicate="o_totalprice > 0")\n%b = TRANSFORM(%a, op={"x": "o_totalprice * 2"})\n%c = EXTRACT(%b, fields=["x"])\n%d = ARGMAX(%c, key="x")\nreturn %d'
    run = Engine(spark, {}).run(program.parse("inputs: @r: List[Any]\n" + text), {"@r": table(spark, sf, "orders").select("o_totalprice")})
    totals = corpus.trace_totals(run.trace(spark, "program"))
    events = run.trace(spark, "program").groupBy("program_id").agg(F.count_if(F.col("status") == "ok").alias("n_ok"))
    return totals.join(events, "program_id").select("program_id", "n_ok", "latency_ms", (F.col("tokens_in") + F.col("tokens_out")).cast("long").alias("tokens"), "n_skipped")


STEPS = ("FILTER", "SORT", "DEDUP")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, text): a program an order, a step a line; a step reads the line before, or the first one where that line's
    quantity is 25 or more. Programs of every tenth order lack a bracket."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    first, before = F.first("l_linenumber").over(order), F.lag("l_linenumber").over(order)
    source = F.when(F.lag("q").over(order) < 25, before).otherwise(first)
    params = F.array(F.lit(', predicate="v > 1")'), F.lit(', key="v")'), F.lit(")"))
    kind = F.pmod(F.col("l_linenumber"), 3).cast("int") + 1
    step = F.concat(F.lit(" = "), F.element_at(F.array(*[F.lit(s) for s in STEPS]), kind), F.lit("(%n"), source.cast("string"), F.element_at(params, kind))
    told = lines.select("l_orderkey", "l_linenumber", F.concat(F.lit("%n"), F.col("l_linenumber").cast("string"), F.when(before.isNull(), F.lit(' = LOAD("rows")')).otherwise(step)).alias("line"))
    whole = told.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))).alias("lines"), F.max("l_linenumber").alias("last"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    broken = F.when(F.col("l_orderkey") % 10 == 0, "\n%bad = SORT(%n1").otherwise("")
    return whole.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("; program v0.1  module=m\n"), body, broken, F.lit("\nreturn %n"), F.col("last").cast("string")).alias("text"))


PARSED = f"""n AS (SELECT l_orderkey, l_linenumber AS pos, max(l_quantity) AS q, lag(l_linenumber) OVER w AS before, min(l_linenumber) OVER w AS head, lag(max(l_quantity)) OVER w AS bq
  FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY l_orderkey, l_linenumber WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
e AS (SELECT l_orderkey, CASE WHEN bq < 25 THEN before ELSE head END AS src, pos AS dst FROM n WHERE before IS NOT NULL)"""


@R.add(
    f"WITH {PARSED} SELECT CASE WHEN before IS NULL THEN 'LOAD' ELSE {list(STEPS)}[pos % 3 + 1] END AS op, count(*) AS n FROM n GROUP BY 1 UNION ALL SELECT 'fault', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 10 = 0"
)
def parsed_programs(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _, faults = program.parse_table(_texts(spark, sf), "id", "text")
    return corpus.histogram(nodes, "op").unionByName(corpus.histogram(faults.select(F.lit("fault").alias("op")), "op"))


@R.add(
    f"""WITH RECURSIVE {PARSED}, d AS (SELECT l_orderkey, pos, 1 AS depth FROM n WHERE before IS NULL UNION ALL SELECT d.l_orderkey, e.dst, depth + 1 FROM d JOIN e ON e.l_orderkey = d.l_orderkey AND e.src = d.pos),
w AS (SELECT l_orderkey, depth, count(*) AS c FROM d GROUP BY ALL) SELECT l_orderkey::VARCHAR AS program_id, sum(c)::BIGINT AS n_nodes, max(depth)::BIGINT AS depth, max(c) AS width FROM w GROUP BY l_orderkey"""
)
def parsed_program_metrics(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = program.parse_table(_texts(spark, sf), "id", "text")
    return graph.depth_and_width(nodes, edges)


@R.add()
def lifted_samples(spark: SparkSession, sf: str) -> DataFrame:
    found = lifting.corpus(generators.samples(spark, 500))
    return corpus.coverage(found, ["source"], lifted="text IS NOT NULL", valid="valid", tier_a="tier = 'A'")


@R.add(
    "SELECT event_type, CASE "
    + " ".join(f"WHEN regexp_matches(lower(event_type), '{p}') THEN '{op}'" for p, op, _, _ in lifting.TOOL_RULES)
    + " ELSE 'EXEC_ACTION' END AS op, count(*) AS n FROM events GROUP BY ALL"
)
def tool_mapping(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return events.select("event_type", lifting.tool_rules(F.col("event_type")).alias("op"), "n")


@R.add(
    f"WITH t AS (SELECT l_orderkey, sum(l_linenumber * 10.0::DOUBLE) AS ms, sum(l_quantity) AS e FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS n, {r2('avg(ms)', 3)} AS mean_latency_ms, {r2('avg(e)', 3)} AS mean_energy_j, {r2('avg(ms) * 100 / 2500.0::DOUBLE', 3)} AS pct_latency, {r2('avg(e) * 100 / 900.0::DOUBLE', 3)} AS pct_energy FROM t"
)
def benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    totals = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_linenumber") * 10.0).alias("latency_ms"), F.sum("l_quantity").alias("energy_j"))
    return corpus.benchmark_summary(totals, 2500.0, 900.0)


@R.add()
def lm_ops_default(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", lm.column("CLASSIFY", F.col("text")).alias("topic"), F.size(lm.column("EXTRACT_ENTITIES", F.col("text"))).alias("n_entities"), F.length(lm.column("SUMMARIZE", F.col("text"))).alias("n_summary"))
