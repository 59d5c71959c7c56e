"""Plan graphs, metrics, exact statistics, ordered sequences and provenance over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import graph, metrics, provenance, sequences
from ..plans import isa
from . import Registry, table
from .core import r2

R = Registry()

# -- plan graphs: one program per order; a line reads the line before it and the first line ----------------


def plan_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Line items as plan nodes: node = line number, op by line number; a line of a quantity below 25 feeds the next
    one, and the first line feeds all from the third on."""
    ops = F.array(*[F.lit(o) for o in OPS])
    nodes = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("quantity")).select(
        F.col("l_orderkey").cast("string").alias("program_id"),
        F.col("l_linenumber").cast("string").alias("node"),
        F.col("l_linenumber").alias("pos"),
        F.element_at(ops, F.pmod(F.col("l_linenumber"), len(OPS)).cast("int") + 1).alias("op"),
        "quantity",
    )
    a = nodes.select("program_id", F.col("node").alias("src"), F.col("pos").alias("p"), "quantity")
    b = nodes.select("program_id", F.col("node").alias("dst"), F.col("pos").alias("q"))
    edges = a.join(b, "program_id").where("(p = q - 1 AND quantity < 25) OR (p = 1 AND q >= 3)").select("program_id", "src", "dst")
    return nodes.drop("quantity"), edges


OPS = ("SEARCH", "FILTER", "SORT", "ARGMIN", "GENERATE")
G = f"""n AS (SELECT l_orderkey::VARCHAR AS program_id, l_linenumber AS pos, [{', '.join(repr(o) for o in OPS)}][l_linenumber % {len(OPS)} + 1] AS op, max(l_quantity) AS quantity
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
e AS (SELECT DISTINCT a.program_id, a.pos AS src, b.pos AS dst FROM n a JOIN n b ON a.program_id = b.program_id WHERE (a.pos = b.pos - 1 AND a.quantity < 25) OR (a.pos = 1 AND b.pos >= 3))"""


@R.add(
    f"""WITH RECURSIVE {G}, d AS (SELECT program_id, pos, 1 AS depth FROM n UNION ALL SELECT d.program_id, e.dst, depth + 1 FROM d JOIN e ON d.program_id = e.program_id AND d.pos = e.src),
m AS (SELECT program_id, pos, max(depth) AS depth FROM d GROUP BY ALL), w AS (SELECT program_id, depth, count(*) AS c FROM m GROUP BY ALL)
SELECT program_id, sum(c)::BIGINT AS n_nodes, max(depth)::BIGINT AS depth, max(c) AS width FROM w GROUP BY program_id"""
)
def dag_depth_width(spark: SparkSession, sf: str) -> DataFrame:
    return graph.depth_and_width(*plan_tables(spark, sf))


COSTS = ", ".join(f"('{o}', {isa.TABLE[o].latency_ms}::DOUBLE)" for o in OPS)


@R.add(
    f"""WITH RECURSIVE {G}, c(op, ms) AS (VALUES {COSTS}), v AS (SELECT program_id, pos, ms FROM n JOIN c USING (op)),
d AS (SELECT program_id, pos, ms AS length FROM v UNION ALL SELECT d.program_id, e.dst, length + v.ms FROM d JOIN e ON d.program_id = e.program_id AND d.pos = e.src JOIN v ON v.program_id = e.program_id AND v.pos = e.dst),
o AS (SELECT program_id, max(pos) AS pos FROM n GROUP BY program_id)
SELECT program_id, round(max(length), 3) AS critical_ms FROM d JOIN o USING (program_id, pos) GROUP BY program_id"""
)
def critical_path(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = plan_tables(spark, sf)
    outputs = nodes.groupBy("program_id").agg(F.max("pos").cast("string").alias("output"))
    return graph.critical_path(nodes, edges, outputs, isa.cost_table(spark))


@R.add(
    f"""WITH RECURSIVE {G}, o AS (SELECT program_id, max(pos) AS pos FROM n GROUP BY program_id),
r AS (SELECT program_id, pos FROM o UNION SELECT r.program_id, e.src FROM r JOIN e ON r.program_id = e.program_id AND r.pos = e.dst)
SELECT program_id, pos::VARCHAR AS node FROM n WHERE (program_id, pos) NOT IN (SELECT (program_id, pos) FROM r)"""
)
def liveness(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = plan_tables(spark, sf)
    outputs = nodes.groupBy("program_id").agg(F.max("pos").cast("string").alias("output"))
    return graph.dead_nodes(nodes, edges, outputs)


@R.add(
    f"""WITH {G}, dg AS (SELECT n.program_id, n.pos, count(DISTINCT a.dst) AS o, count(DISTINCT b.src) AS i FROM n LEFT JOIN e a ON a.program_id = n.program_id AND a.src = n.pos LEFT JOIN e b ON b.program_id = n.program_id AND b.dst = n.pos GROUP BY ALL)
SELECT program_id, CASE WHEN count(*) = 1 THEN 'single' WHEN sum(o) = 0 THEN 'independent' WHEN max(o) <= 1 AND max(i) <= 1 AND sum(o) = count(*) - 1 THEN 'linear' ELSE 'fork_join' END AS shape FROM dg GROUP BY program_id"""
)
def dag_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.shapes(*plan_tables(spark, sf))


@R.add(
    f"""WITH {G}, r AS (SELECT program_id, pos, 0 AS r FROM n WHERE pos = 2 UNION ALL SELECT program_id, src, 1 FROM e WHERE dst = 2 UNION ALL SELECT program_id, dst, 2 FROM e WHERE src = 2 AND (program_id, 2) IN (SELECT (program_id, pos) FROM n)),
m AS (SELECT program_id, pos, min(r) AS r FROM r GROUP BY ALL)
SELECT program_id, pos::VARCHAR AS node, ['error', 'upstream', 'downstream'][r + 1] AS role, count(*) OVER (PARTITION BY program_id) > 2 AS over_budget FROM m"""
)
def error_slice(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = plan_tables(spark, sf)
    return graph.slice_around(edges, nodes.where("pos = 2"), 2)


@R.add(
    f"WITH {G}, f AS (SELECT program_id, src, dst FROM e WHERE dst % 2 = 0 UNION SELECT program_id, src, dst + 100 FROM e WHERE dst = 3) SELECT coalesce(e.program_id, f.program_id) AS program_id, count(*) FILTER (WHERE e.src IS NOT NULL AND f.src IS NOT NULL) AS n_exact, count(*) FILTER (WHERE f.src IS NULL) AS n_missing, count(*) FILTER (WHERE e.src IS NULL) AS n_extra FROM e FULL JOIN f ON e.program_id = f.program_id AND e.src = f.src AND e.dst = f.dst GROUP BY 1"
)
def edge_set_diff(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = plan_tables(spark, sf)
    odd = edges.where("dst = '3'").withColumn("dst", (F.col("dst").cast("int") + 100).cast("string"))
    return graph.edge_diff(edges, edges.where("CAST(dst AS INT) % 2 = 0").unionByName(odd))


def _chain(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The lines of an order as a chain, with weights, classes and a cost for each edge: the input of the schedulers."""
    nodes, _ = plan_tables(spark, sf)
    costs = isa.cost_table(spark).select("op", "resource_class", F.col("latency_ms").alias("weight"))
    before = F.lag("node").over(Window.partitionBy("program_id").orderBy("pos"))
    edges = nodes.select("program_id", before.alias("src"), F.col("node").alias("dst"), F.lit(0.1).alias("cost")).where("src IS NOT NULL")
    return nodes.join(F.broadcast(costs), "op"), edges


CLASSES = ", ".join(f"('{o}', '{isa.TABLE[o].resource_class}', {isa.TABLE[o].latency_ms}::DOUBLE)" for o in OPS)
CHAIN = f"{G}, c(op, cls, ms) AS (VALUES {CLASSES}), k AS (SELECT program_id, pos::VARCHAR AS node, cls, ms, sum(ms) OVER w AS upto, row_number() OVER w - 1 AS i FROM n JOIN c USING (op) WINDOW w AS (PARTITION BY program_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"


@R.add(f"WITH {CHAIN} SELECT program_id, node, cls || ':0' AS worker, {r2('upto - ms', 3)} AS start_ms, {r2('upto', 3)} AS end_ms FROM k")
def list_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """A chain leaves nothing to choose: every node starts where the one before ends."""
    return graph.list_schedule(*_chain(spark, sf))


@R.add(f"WITH {CHAIN} SELECT program_id, node, 'p0' AS worker, {r2('upto - ms + i * 0.1::DOUBLE', 3)} AS start_ms, {r2('upto + i * 0.1::DOUBLE', 3)} AS end_ms FROM k")
def heft_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """On a chain every node waits for the one before and the cost of the edge, on the first processor."""
    return graph.heft_schedule(*_chain(spark, sf))


@R.add(f"WITH {G} SELECT program_id, pos::VARCHAR AS node, (row_number() OVER (PARTITION BY program_id ORDER BY pos) - 1)::INTEGER AS place FROM n")
def topological_order(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = plan_tables(spark, sf)
    padded = nodes.withColumn("node", F.lpad("node", 3, "0"))
    wide = edges.withColumn("src", F.lpad("src", 3, "0")).withColumn("dst", F.lpad("dst", 3, "0"))
    return graph.topological_order(padded, wide).withColumn("node", F.regexp_replace("node", "^0+", ""))


@R.add(
    f"""WITH RECURSIVE {G}, l AS (SELECT program_id, max(pos) AS pos, max_by(quantity, pos) AS q FROM n GROUP BY program_id),
x AS (SELECT * FROM e UNION SELECT program_id, pos, 2 FROM l WHERE pos > 2 AND q < 25),
r AS (SELECT * FROM x UNION SELECT r.program_id, r.src, x.dst FROM r JOIN x ON r.program_id = x.program_id AND r.dst = x.src),
c AS (SELECT DISTINCT program_id, src AS pos FROM r WHERE src = dst), s AS (SELECT * FROM c UNION SELECT r.program_id, r.dst FROM c JOIN r ON r.program_id = c.program_id AND r.src = c.pos)
SELECT program_id, count(*) AS n_stuck FROM s GROUP BY program_id"""
)
def cycle_detection(spark: SparkSession, sf: str) -> DataFrame:
    """The plan graphs, with an edge back from the last line, if its quantity is below 25, to the second one."""
    nodes, edges = plan_tables(spark, sf)
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("program_id"), "l_linenumber").agg(F.max("l_quantity").alias("q"))
    last = lines.groupBy("program_id").agg(F.max_by("q", "l_linenumber").alias("q"), F.max("l_linenumber").alias("pos")).where("pos > 2 AND q < 25")
    back = last.select("program_id", F.col("pos").cast("string").alias("src"), F.lit("2").alias("dst"))
    return graph.cyclic_programs(nodes, edges.unionByName(back))


@R.add(
    f"""WITH {G}, k AS (SELECT *, CASE WHEN dst % 3 = 0 THEN 'bind' WHEN dst % 3 = 1 THEN 'input' ELSE 'after' END AS kind FROM e)
SELECT program_id, src::VARCHAR AS src, dst::VARCHAR AS dst, src % 2 = 1 AND dst % 2 = 0 AND dst < 5 AS safe FROM k WHERE kind = 'input'"""
)
def removable_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds by the reader's number, read-only and bound nodes by theirs."""
    nodes, edges = plan_tables(spark, sf)
    told = nodes.select("program_id", "node", F.when(F.col("pos") % 2 == 1, True).otherwise(F.col("pos") < 5).alias("read_only"), (F.col("pos") % 2 == 0).alias("bound"))
    told = told.withColumn("read_only", F.when(F.col("bound"), F.col("node").cast("int") < 5).otherwise(True))
    kind = F.when(F.col("dst") % 3 == 0, "bind").when(F.col("dst") % 3 == 1, "input").otherwise("after")
    own = edges.withColumn("kind", kind)
    found = graph.removable_edges(own, told)
    odd = F.col("src").cast("int") % 2 == 1
    return found.withColumn("safe", F.col("safe") & odd)


# -- metrics ------------------------------------------------------------------------------------------------

RULE = "CASE WHEN n_chars < 400 THEN 0 ELSE 1 END"


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select("doc_id", "quality", "toxic", F.expr(RULE).alias("guess"))


@R.add(
    f"""WITH j AS (SELECT quality, {RULE} AS guess FROM labels JOIN documents USING (doc_id)), x AS (SELECT DISTINCT quality AS label FROM j UNION SELECT DISTINCT guess FROM j),
s AS (SELECT label, count(*) FILTER (WHERE quality = label) AS support, count(*) FILTER (WHERE guess = label) AS found, count(*) FILTER (WHERE quality = label AND guess = label) AS hit FROM x, j GROUP BY label),
p AS (SELECT *, CASE WHEN found > 0 THEN hit::DOUBLE / found ELSE 0 END AS p, CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0 END AS r FROM s)
SELECT label, support, {r2('p', 6)} AS precision, {r2('r', 6)} AS recall, {r2('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END', 6)} AS f1 FROM p"""
)
def confusion_prf(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.class_scores(metrics.confusion(_judged(spark, sf), "quality", "guess"))


@R.add(
    f"""WITH j AS (SELECT quality, {RULE} AS guess FROM labels JOIN documents USING (doc_id)), x AS (SELECT quality AS label FROM j UNION SELECT guess FROM j),
s AS (SELECT label, count(*) FILTER (WHERE quality = label) AS support, count(*) FILTER (WHERE guess = label) AS found, count(*) FILTER (WHERE quality = label AND guess = label) AS hit FROM x, j GROUP BY label)
SELECT {r2(f"avg({r2('CASE WHEN hit > 0 THEN 2 * (hit::DOUBLE / found) * (hit::DOUBLE / support) / (hit::DOUBLE / found + hit::DOUBLE / support) ELSE 0 END', 6)})", 6)} AS macro_f1, {r2('(SELECT avg((quality = guess)::INTEGER) FROM j)', 6)} AS micro_f1 FROM s"""
)
def macro_micro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.macro_micro(metrics.confusion(_judged(spark, sf), "quality", "guess"))


@R.add(
    f"""WITH g AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE event_id % 3 = 0) AS g, list(DISTINCT event_type) FILTER (WHERE event_id % 5 = 0) AS f FROM events GROUP BY user_id),
p AS (SELECT user_id, len(list_intersect(coalesce(g, []), coalesce(f, [])))::DOUBLE AS hit, len(coalesce(f, [])) AS nf, len(coalesce(g, [])) AS ng FROM g),
q AS (SELECT user_id, CASE WHEN nf > 0 THEN hit / nf ELSE 0 END AS p, CASE WHEN ng > 0 THEN hit / ng ELSE 0 END AS r FROM p)
SELECT user_id, {r2('p', 6)} AS precision, {r2('r', 6)} AS recall, {r2('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END', 6)} AS f1 FROM q"""
)
def set_f1(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda n: F.collect_set(F.when(F.col("event_id") % n == 0, F.col("event_type")))
    sides = table(spark, sf, "events").groupBy("user_id").agg(of(3).alias("g"), of(5).alias("f"))
    return sides.select("user_id", *metrics.set_prf(F.col("g"), F.col("f")))


@R.add(
    """WITH g AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 0),
f AS (SELECT event_id AS matched, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 1)
SELECT user_id, event_type, event_id, matched FROM g LEFT JOIN f USING (user_id, event_type, k)"""
)
def in_order_matches(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return metrics.in_order_matches(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@R.add(
    f"""WITH k AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w FROM conversations WHERE text <> ''), b AS (SELECT conv_id, turn - 1 AS turn, w AS v FROM k WHERE turn > 0)
SELECT conv_id, {r2('avg(len(list_intersect(w, v))::DOUBLE / len(list_distinct(list_concat(w, v))))', 6)} AS similarity FROM k JOIN b USING (conv_id, turn) GROUP BY conv_id"""
)
def key_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each turn against those of the next one."""
    turns = table(spark, sf, "conversations").where("text <> ''").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("words"))
    later = turns.where("turn > 0").select("conv_id", (F.col("turn") - 1).alias("turn"), "words")
    return metrics.key_overlap(turns, later, "conv_id", "turn", "words")


@R.add(
    f"""WITH {G}, f AS (SELECT program_id, src, dst FROM e WHERE dst % 2 = 0), s AS (SELECT program_id, count(*) AS nodes FROM n GROUP BY program_id),
d AS (SELECT program_id, count(*) AS edges, count(*) FILTER (WHERE dst % 2 = 1) AS gone FROM e GROUP BY program_id)
SELECT program_id, {r2('CASE WHEN nodes + coalesce(edges, 0) = 0 THEN 1 ELSE 1 - coalesce(gone, 0)::DOUBLE / (nodes + coalesce(edges, 0)) END', 6)} AS similarity FROM s LEFT JOIN d USING (program_id)"""
)
def edit_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Plans against themselves without the edges into odd nodes."""
    nodes, edges = plan_tables(spark, sf)
    sizes = nodes.groupBy("program_id").agg(F.count("*").alias("n_nodes"))
    diff = graph.edge_diff(edges, edges.where("CAST(dst AS INT) % 2 = 0"))
    joined = sizes.join(diff, "program_id", "left").na.fill(0, ["n_exact", "n_missing", "n_extra"])
    value = metrics.edit_similarity(F.col("n_nodes"), F.lit(0), F.col("n_exact") + F.col("n_missing"), F.col("n_missing") + F.col("n_extra"))
    return joined.select("program_id", F.round(value, 6).alias("similarity"))


@R.add(
    f"""WITH j AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*) AS n, avg((a = b)::INTEGER) AS po FROM j),
x AS (SELECT a AS l FROM j UNION SELECT b FROM j), pe AS (SELECT sum(pa * pb) AS pe FROM (SELECT l, (SELECT avg((a = l)::INTEGER) FROM j) AS pa, (SELECT avg((b = l)::INTEGER) FROM j) AS pb FROM x))
SELECT n, {r2('po', 6)} AS agreement, {r2('pe', 6)} AS chance, {r2('(po - pe) / (1 - pe)', 6)} AS kappa, (po - pe) / (1 - pe) >= 0.8 AS passes FROM n, pe"""
)
def kappa(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.kappa(table(spark, sf, "labels"), "quality", "toxic")


@R.add("SELECT count(*) FILTER (WHERE (quality = 1) = (toxic = 1)) AS agree, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS both, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS only_a, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS only_b FROM labels")
def judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    judged = table(spark, sf, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return metrics.agreement_counts(judged, "a", "b")


@R.add(
    f"""WITH g AS (SELECT user_id, event_type, count(*) AS g FROM events WHERE event_id % 2 = 0 GROUP BY ALL), f AS (SELECT user_id, event_type, count(*) AS f FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
b AS (SELECT user_id, sum(least(coalesce(g, 0), coalesce(f, 0))) AS hit, sum(coalesce(g, 0)) AS ng, sum(coalesce(f, 0)) AS nf FROM g FULL JOIN f USING (user_id, event_type) GROUP BY user_id),
p AS (SELECT user_id, CASE WHEN nf > 0 THEN hit::DOUBLE / nf::DOUBLE ELSE 0 END AS p, CASE WHEN ng > 0 THEN hit::DOUBLE / ng::DOUBLE ELSE 0 END AS r FROM b)
SELECT user_id, {r2('p', 6)} AS precision, {r2('r', 6)} AS recall, {r2('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END', 6)} AS f1 FROM p"""
)
def multiset_f1(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return metrics.multiset_prf(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "user_id", "event_type")


@R.add(
    "WITH g AS (SELECT user_id, event_type FROM events WHERE event_id % 2 = 0), f AS (SELECT user_id, event_type FROM events WHERE event_id % 2 = 1) SELECT *, 'missing' AS side FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM f) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM g)"
)
def multiset_difference(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return metrics.multiset_difference(events.where("event_id % 2 = 0").select("user_id", "event_type"), events.where("event_id % 2 = 1").select("user_id", "event_type"))


@R.add(
    """WITH g AS (SELECT conv_id, turn, role, length(text) % 7 AS m FROM conversations WHERE turn % 4 <> 3), f AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN -1 ELSE length(text) % 7 END AS m FROM conversations WHERE turn % 5 <> 4),
j AS (SELECT coalesce(g.conv_id, f.conv_id) AS conv_id, g.turn AS gt, f.turn AS ft, g.role IS NOT DISTINCT FROM f.role AND g.m IS NOT DISTINCT FROM f.m AS same FROM g FULL JOIN f ON g.conv_id = f.conv_id AND g.turn = f.turn)
SELECT conv_id, count(*) FILTER (WHERE gt IS NOT NULL AND ft IS NOT NULL AND same) AS n_equal, count(*) FILTER (WHERE gt IS NOT NULL AND ft IS NOT NULL AND NOT same) AS n_wrong,
  count(*) FILTER (WHERE ft IS NULL) AS n_missing, count(*) FILTER (WHERE gt IS NULL) AS n_extra, count(*) FILTER (WHERE gt IS NULL OR ft IS NULL OR NOT same) = 0 AS strict FROM j GROUP BY conv_id"""
)
def positional_compare(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").withColumn("m", (F.length("text") % 7).cast("int"))
    found = turns.where("turn % 5 <> 4").withColumn("m", F.when(F.col("turn") % 3 == 2, -1).otherwise(F.col("m")))
    return metrics.positional(turns.where("turn % 4 <> 3"), found, "conv_id", "turn", ["role", "m"])


@R.add(
    f"""WITH s AS (SELECT user_id, coalesce(list(event_type ORDER BY ts, event_id) FILTER (WHERE event_id % 2 = 0), []) AS a, coalesce(list(event_type ORDER BY ts, event_id) FILTER (WHERE event_id % 2 = 1), []) AS b FROM events GROUP BY user_id),
l AS (SELECT user_id, len(a) AS na, len(b) AS nb, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE list_reduce(a, lambda upper_row, x: list_reduce(range(1, len(b) + 1),
  lambda acc, j: list_append(acc, CASE WHEN b[j] = x THEN upper_row[j] + 1 ELSE greatest(upper_row[j + 1], acc[j]) END), [0]), list_transform(range(0, len(b) + 1), lambda i: 0))[-1] END AS lcs FROM s),
p AS (SELECT user_id, lcs, CASE WHEN nb > 0 THEN lcs::DOUBLE / nb ELSE 0 END AS p, CASE WHEN na > 0 THEN lcs::DOUBLE / na ELSE 0 END AS r FROM l)
SELECT user_id, lcs::INTEGER AS lcs, {r2('p', 6)} AS precision, {r2('r', 6)} AS recall, {r2('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END', 6)} AS f1 FROM p"""
)
def lcs_similarity(spark: SparkSession, sf: str) -> DataFrame:
    steps = sequences.ordered_steps(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", ["event_id", "event_type"])
    # sequences of a user by the parity of their events
    of = lambda parity: F.transform(F.filter("steps", lambda s: s["event_id"] % 2 == parity), lambda s: s["event_type"])
    both = steps.select("user_id", of(0).alias("a"), of(1).alias("b"))
    return both.select("user_id", metrics.lcs_length(F.col("a"), F.col("b")).alias("lcs"), *metrics.ordered_prf(F.col("a"), F.col("b")))


TAIL = "list_sum(list_transform(range(h, trials + 1), lambda i: exp(lgamma(trials + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(trials - i + 1.0::DOUBLE) + i * ln(p) + (trials - i) * ln(1 - p))))"


@R.add(
    f"""WITH RECURSIVE g AS (SELECT lang, sum(quality)::BIGINT AS hits, count(*) AS trials FROM labels JOIN documents USING (doc_id) GROUP BY lang),
b AS (SELECT lang, trials, side, hits + side AS h, CASE WHEN side = 0 THEN 0.025::DOUBLE ELSE 0.975::DOUBLE END AS target, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM g, (VALUES (0), (1)) t(side) UNION ALL
  SELECT lang, trials, side, h, target, CASE WHEN t < target THEN p ELSE lo END, CASE WHEN t < target THEN hi ELSE p END, step + 1 FROM (SELECT *, {TAIL} AS t FROM (SELECT *, (lo + hi) / 2 AS p FROM b WHERE step < 50))),
r AS (SELECT lang, side, {r2('(lo + hi) / 2', 6)} AS x FROM b WHERE step = 50)
SELECT lang, hits, trials, CASE WHEN hits = 0 THEN 0.0::DOUBLE ELSE l.x END AS low, CASE WHEN hits = trials THEN 1.0::DOUBLE ELSE u.x END AS high FROM g JOIN r l USING (lang) JOIN r u USING (lang) WHERE l.side = 0 AND u.side = 1"""
)
def clopper_pearson(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.clopper_pearson(both.groupBy("lang").agg(F.sum("quality").alias("hits"), F.count("*").alias("trials")), "hits", "trials")


CHANCE = "least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(n + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(n - i + 1.0::DOUBLE) - n * ln(2.0::DOUBLE)))))"


@R.add(
    f"""WITH c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND guess <> 1) AS only_a, count(*) FILTER (WHERE quality <> 1 AND guess = 1) AS only_b FROM (SELECT lang, quality, {RULE} AS guess FROM labels JOIN documents USING (doc_id)) GROUP BY lang),
p AS (SELECT lang, only_a, only_b, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE {CHANCE} END AS p FROM (SELECT *, only_a + only_b AS n FROM c)),
s AS (SELECT *, least(1.0::DOUBLE, p * (count(*) OVER () - row_number() OVER (ORDER BY p, lang) + 1)) AS x FROM p)
SELECT lang, only_a, only_b, {r2('p', 6)} AS p, {r2('max(x) OVER (ORDER BY p, lang ROWS UNBOUNDED PRECEDING)', 6)} AS p_holm FROM s"""
)
def mcnemar_holm(spark: SparkSession, sf: str) -> DataFrame:
    both = _judged(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    told = both.select("lang", (F.col("quality") == 1).alias("a"), (F.col("guess") == 1).alias("b"))
    found = metrics.holm(metrics.mcnemar(told, ["lang"], "a", "b"), "p", ["lang"])
    return found.withColumn("p", F.round("p", 6)).withColumn("p_holm", F.round("p_holm", 6))


@R.add(
    """WITH p AS (SELECT source AS name, (min(n_chars) % 97)::DOUBLE / 100 AS p FROM documents GROUP BY source),
s AS (SELECT *, least(1.0::DOUBLE, p * (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1)) AS x FROM p) SELECT name, p, max(x) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) AS p_holm FROM s"""
)
def holm_adjustment(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(((F.min("n_chars") % 97).cast("double") / 100).alias("p"))
    return metrics.holm(given, "p", ["name"])


@R.add(
    "WITH t AS (SELECT user_id, event_type AS arm, event_id % 3 AS task, max((value > 50)::INTEGER) = 1 AS won FROM events GROUP BY ALL) SELECT r.task, r.arm, count(*) FILTER (WHERE r.won AND NOT b.won) AS wins, count(*) FILTER (WHERE NOT r.won AND b.won) AS losses, count(*) FILTER (WHERE r.won = b.won) AS ties FROM t r JOIN t b ON r.user_id = b.user_id AND r.task = b.task AND b.arm = 'view' WHERE r.arm <> 'view' GROUP BY ALL"
)
def paired_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("arm"), (F.col("event_id") % 3).alias("task")).agg((F.max((F.col("value") > 50).cast("int")) == 1).alias("won"))
    return metrics.paired_outcomes(runs, ["task"], ["user_id"], "arm", "view", "won")


# -- ordered sequences --------------------------------------------------------------------------------------


@R.add(
    """WITH o AS (SELECT *, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum((p IS DISTINCT FROM event_type)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id, count(*) AS run_length FROM g GROUP BY user_id, run, event_type"""
)
def collapse_consecutive(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return sequences.collapse_runs(events, ["user_id"], ["ts", "event_id"], ["event_type"]).drop("ts")


@R.add(
    "SELECT event_id, next_event_id FROM (SELECT event_id, event_type, lead(event_id) OVER w AS next_event_id, lead(event_type) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE t = 'view' AND event_type <> t"
)
def commutable_pairs(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("names", F.array("event_type"))
    return sequences.commuting_pairs(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", "names").select("event_id", "next_event_id")


@R.add(
    """WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type = 'purchase' AS command, coalesce(value > 5, false) AS r, coalesce(value > 10, false) AS e FROM events),
f AS (SELECT DISTINCT user_id, -1::BIGINT AS i, 0 AS cmds, false AS ready, false AS empty, false AS fresh, NULL::VARCHAR AS act, NULL::INTEGER AS stop FROM s UNION ALL
  SELECT user_id, i, CASE WHEN now = 'sent' THEN cmds + 1 ELSE cmds END, CASE WHEN now = 'seen' THEN r ELSE ready END, CASE WHEN now = 'seen' THEN e ELSE empty END,
    CASE WHEN now = 'seen' THEN fresh OR (r AND cmds >= 2) WHEN now = 'sent' THEN false ELSE fresh END, CASE WHEN now IN ('BUDGET_INFEASIBLE', 'S1', 'S3') THEN now ELSE act END, CASE WHEN now IN ('BUDGET_INFEASIBLE', 'S1', 'S3') THEN i::INTEGER ELSE stop END
  FROM (SELECT f.* EXCLUDE (i), s.i, s.r, s.e, CASE WHEN act IS NOT NULL THEN 'over' WHEN s.i >= 200 THEN 'BUDGET_INFEASIBLE' WHEN NOT command THEN 'seen' WHEN cmds < 2 AND NOT ready THEN 'S1' WHEN cmds >= 2 AND NOT fresh THEN 'S3' ELSE 'sent' END AS now
    FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)),
z AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)
SELECT user_id, CASE WHEN act = 'BUDGET_INFEASIBLE' THEN act WHEN act IS NOT NULL THEN 'VIOLATION' WHEN cmds < 3 THEN 'INSUFFICIENT_EVIDENCE' WHEN NOT (ready AND empty) THEN 'VIOLATION' ELSE 'SUCCESS' END AS judgment,
  CASE WHEN act IN ('S1', 'S3') THEN act WHEN act IS NULL AND cmds >= 3 AND NOT (ready AND empty) THEN 'S7' END AS contract, stop AS at_step FROM z"""
)
def contract_check(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events as steps: purchases submit, views poll with flags from the value."""
    events = table(spark, sf, "events")
    steps = events.select(
        "user_id",
        F.struct("ts", "event_id").alias("at"),
        F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("op"),
        F.when(F.col("event_type") == "purchase", "COMMAND").otherwise("STATUS").alias("reg"),
        (F.col("value") > 5).alias("ready"),
        (F.col("value") > 10).alias("empty"),
    )
    return sequences.check_submissions(steps, "user_id", "at")


#: What follows from the rules for the step that is left out: the first poll, a control write, the second poll, a key.
@R.add(
    """WITH k AS (SELECT o_orderkey, o_orderkey % 23 AS k FROM orders)
SELECT o_orderkey, CASE WHEN k < 20 THEN 'VIOLATION' ELSE 'SUCCESS' END AS judgment, CASE WHEN k = 0 THEN 'C1' WHEN k IN (1, 2) THEN 'C3' WHEN k = 3 THEN 'C4' WHEN k < 20 THEN 'C8' END AS contract,
  CASE WHEN k = 0 THEN 0 WHEN k IN (1, 2, 3) THEN 3 END AS at_step FROM k"""
)
def init_contract_check(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as programs: a poll, two control writes, a poll and one key write a line, some left out."""
    lines = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"))
    row = lambda n, op, reg, value: F.struct(F.lit(n).alias("n"), F.lit(op).alias("op"), F.lit(reg).alias("reg"), F.lit(value).alias("value"))
    keys = [row(4 + i, "write", f"KEY_SHARE{i // 8}_{i % 8}", "1") for i in range(16)]
    every = F.array(row(0, "read", "STATUS", ""), row(1, "write", "CTRL_SHADOWED", "a"), row(2, "write", "CTRL_SHADOWED", "a"), row(3, "read", "STATUS", ""), *keys)
    steps = lines.select("o_orderkey", F.explode(F.filter(every, lambda s: s["n"] != F.col("k") % 23)).alias("s")).select("o_orderkey", "s.*", F.lit(True).alias("idle"))
    return sequences.check_initialization(steps, "o_orderkey", "n")


# -- provenance ---------------------------------------------------------------------------------------------


@R.add(
    """WITH c AS (SELECT l_orderkey, l_linenumber AS step, l_partkey::VARCHAR AS value FROM lineitem), p AS (SELECT c.l_orderkey, c.step, c.value, count(DISTINCT q.step) AS n, min(q.step) AS src FROM c LEFT JOIN c q ON q.l_orderkey = c.l_orderkey AND q.value = c.value AND q.step < c.step GROUP BY ALL)
SELECT l_orderkey, step, value, CASE WHEN contains(l_orderkey::VARCHAR, value) THEN 'LITERAL' WHEN n = 1 THEN 'runtime_ref' WHEN n > 1 THEN 'AMBIGUOUS' WHEN value::BIGINT IN (SELECT p_partkey FROM part) THEN 'ENV_STATE' ELSE 'UNKNOWN' END AS origin,
  CASE WHEN NOT contains(l_orderkey::VARCHAR, value) AND n = 1 THEN src END AS producer_step FROM p"""
)
def value_provenance(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("step"), F.col("l_partkey").cast("string").alias("value")).distinct()
    texts = lines.select("l_orderkey", F.col("l_orderkey").cast("string").alias("text")).distinct()
    known = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("value"))
    return provenance.trace_values(lines, texts, known, "l_orderkey")


@R.add("SELECT event_id, 'k' AS path, (props::JSON->>'k') AS value FROM events")
def flatten_paths(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.flatten(table(spark, sf, "events").select("event_id", F.parse_json("props").alias("v")), "event_id", "v")


@R.add("SELECT event_id, props::JSON->>'k' AS value, 'k' AS path FROM events WHERE (props::JSON->>'k')::BIGINT % 2 = 0")
def value_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Where each event's even numbers stand."""
    events = table(spark, sf, "events")
    leaves = provenance.flatten(events.select("event_id", F.parse_json("props").alias("v")), "event_id", "v")
    wanted = events.select("event_id", F.get_json_object("props", "$.k").alias("value")).where("CAST(value AS BIGINT) % 2 = 0")
    return provenance.paths_of(leaves, wanted, "event_id").select("event_id", "value", "path")


@R.add("SELECT l_orderkey, l_linenumber, coalesce(o_custkey = l_suppkey, false) AS own FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def ownership(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    owners = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("owner"))
    return provenance.owned(lines, owners, "l_orderkey", "l_suppkey").select("l_orderkey", "l_linenumber", "own")


@R.add(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'D' WHEN p_partkey % 4 = 1 THEN 'C' WHEN contains(lower(p_name), lower(p_brand)) OR p_partkey % 4 = 2 THEN 'A' ELSE 'B' END AS class FROM part"""
)
def failure_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Values that differ in format, stand elsewhere, are visible, or are not, by the part's number."""
    kind = F.col("p_partkey") % 4
    value = F.when(kind == 0, F.lower("p_brand")).otherwise("none")
    others = F.when(kind == 1, F.array("p_brand")).otherwise(F.array(F.lit("x")))
    text = F.when(kind == 2, F.concat(F.lit("of "), "p_brand")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", provenance.failure_class(value, F.col("p_brand"), text, others).alias("class"))


@R.add(
    """WITH p AS (SELECT event_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), q AS (SELECT *, CASE a WHEN 'search' THEN 'view' ELSE a END AS ca, CASE b WHEN 'search' THEN 'view' ELSE b END AS cb FROM p WHERE b IS NOT NULL)
SELECT event_id, CASE WHEN a = b THEN 'EXACT' WHEN ca = cb THEN 'ALIAS' WHEN a = 'click' OR b = 'click' THEN 'FALLBACK' WHEN ca IN ('view', 'cart') AND cb IN ('view', 'cart') THEN 'SAME_FAMILY' ELSE 'INCOMPATIBLE' END AS relation FROM q"""
)
def label_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's type against that of the user's next one."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = table(spark, sf, "events").select("event_id", "event_type", after.alias("next")).where("next IS NOT NULL")
    relation = provenance.label_relation(F.col("event_type"), F.col("next"), {"view": "look", "cart": "look"}, {"search": "view"}, "click")
    return pairs.select("event_id", relation.alias("relation"))


@R.add(
    """WITH n AS (SELECT DISTINCT p_brand AS tool, p_type AS name FROM part), o AS (SELECT a.tool, b.tool AS other, count(*) AS overlap FROM n a JOIN n b USING (name) WHERE a.tool <> b.tool GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY overlap DESC, other) AS r FROM o), k AS (SELECT *, (row_number() OVER (PARTITION BY tool ORDER BY md5('0|' || tool || '|' || other)))::INTEGER AS rank FROM r WHERE r <= 4)
SELECT tool, other, rank FROM k WHERE rank <= 2"""
)
def signature_distractors(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as tools, their part types as parameter names."""
    tools = table(spark, sf, "part").groupBy(F.col("p_brand").alias("tool")).agg(F.collect_set("p_type").alias("names"))
    return provenance.signature_distractors(tools, tools, 2)


@R.add(
    "SELECT turn, count(*) AS n, count(*) FILTER (WHERE contains(lower(text), lower(role))) AS n_preserved FROM conversations GROUP BY turn"
)
def value_preserved(spark: SparkSession, sf: str) -> DataFrame:
    kept = X.contains_value(F.col("text"), F.col("role"))
    return table(spark, sf, "conversations").groupBy("turn").agg(F.count("*").alias("n"), F.count_if(kept).alias("n_preserved"))


@R.add(
    "SELECT event_id, CASE WHEN contains(lower(event_type), lower(v)) THEN 0 WHEN regexp_matches(v, '^[A-Za-z]*[_#-]?[0-9]{3,}$') THEN 2 ELSE 1 END AS level FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'id_' || user_id::VARCHAR || '000' ELSE 'plain' END AS v FROM events)"
)
def dependency_levels(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("id_"), F.col("user_id").cast("string"), F.lit("000"))).otherwise("plain")
    return table(spark, sf, "events").select("event_id", X.dependency_level(value, F.col("event_type")).alias("level"))


@R.add("SELECT o_orderkey, left(sha256('{\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_custkey\":' || o_custkey::VARCHAR || '}'), 16) AS fingerprint FROM orders")
def case_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", X.fingerprint("o_orderstatus", "o_custkey").alias("fingerprint"))
