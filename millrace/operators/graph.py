"""Analytics over execution plans: many small graphs in two tables.

nodes: (program_id, node, op, ...), edges: (program_id, src, dst, kind). Programs of up to ``SMALL`` edges are each
solved in one go, many to an Arrow batch. Larger ones run as frontier loops over all of them at once, until nothing
changes, and each round is written to the shared folder so that the plan does not grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch

#: Edges of a program that is solved in one go.
SMALL = 100_000


def _by_size(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(program_id) of the programs of more than SMALL edges; None if there is none."""
    large = scratch.save(edges.groupBy("program_id").count().where(F.col("count") > SMALL).select("program_id"))
    return None if large.isEmpty() else large


def _longest(own: list[dict]) -> list[tuple]:
    """(node, length) of the nodes that are on no cycle and behind none."""
    weight = {n["node"]: n["w"] for n in own}
    ins = {n["node"]: [(i["src"], i["cost"]) for i in n["ins"] or () if i["src"] in weight] for n in own}
    after: dict[str, list[str]] = {}
    for node, before in ins.items():
        for src, _ in before:
            after.setdefault(src, []).append(node)
    need = {node: len(before) for node, before in ins.items()}
    ready, length = [n for n, k in need.items() if not k], {}
    while ready:
        node = ready.pop()
        length[node] = weight[node] + max((length[src] + cost for src, cost in ins[node]), default=0.0)
        for n in after.get(node, ()):
            need[n] -= 1
            if not need[n]:
                ready.append(n)
    return list(length.items())


def longest_paths(nodes: DataFrame, edges: DataFrame, weight: Column | None = None, edge_cost: Column | None = None) -> DataFrame:
    """(program_id, node, length): the heaviest path ending at each node, its own weight included (1 each by
    default: the depth). Nodes on or behind a cycle are left out: relaxation runs over the nodes whose
    predecessors are all settled. Edges from or to nodes that are not there do not count."""
    scratch = Scratch(nodes.sparkSession, "paths")
    own = nodes.select("program_id", "node", (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"))
    links = edges.select("program_id", "src", "dst", (edge_cost if edge_cost is not None else F.lit(0.0)).cast("double").alias("cost")).distinct()
    large = _by_size(links, scratch)
    if large is None:
        return _per_program(own, links, _longest, "program_id string, node string, length double")
    small = _per_program(
        own.join(large, "program_id", "left_anti"), links.join(large, "program_id", "left_anti"), _longest, "program_id string, node string, length double"
    )
    return small.unionByName(_longest_in_rounds(own.join(large, "program_id", "left_semi"), links.join(large, "program_id", "left_semi"), scratch))


def _longest_in_rounds(own: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    own = scratch.save(own)
    links = links.join(own.select("program_id", F.col("node").alias("src")), ["program_id", "src"], "left_semi")
    links = scratch.save(links.join(own.select("program_id", F.col("node").alias("dst")), ["program_id", "dst"], "left_semi"))
    wanted = scratch.save(
        own.join(links.groupBy("program_id", F.col("dst").alias("node")).agg(F.count("*").alias("need")), ["program_id", "node"], "left")
        .withColumn("need", F.coalesce("need", F.lit(0)))
    )
    done = scratch.save(wanted.where("need = 0").select("program_id", "node", F.col("w").alias("length")))
    size, grown = -1, done.count()
    while grown != size:
        size = grown
        reached = links.join(done.withColumnRenamed("node", "src"), ["program_id", "src"]).groupBy(
            "program_id", F.col("dst").alias("node")
        ).agg(F.count("*").alias("have"), F.max(F.col("length") + F.col("cost")).alias("upto"))
        ready = reached.join(wanted, ["program_id", "node"]).where("have = need").select(
            "program_id", "node", (F.col("upto") + F.col("w")).alias("length")
        )
        after = scratch.save(ready.unionByName(wanted.where("need = 0").select("program_id", "node", F.col("w").alias("length"))))
        grown = after.count()
        scratch.drop(done)
        done = after
    return done


def depth_and_width(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(program_id, n_nodes, depth, width): depth is the longest chain, width the most nodes on one level."""
    depth = longest_paths(nodes, edges)
    levels = depth.groupBy("program_id", "length").agg(F.count("*").alias("n"))
    return levels.groupBy("program_id").agg(
        F.sum("n").cast("long").alias("n_nodes"), F.max("length").cast("long").alias("depth"), F.max("n").cast("long").alias("width")
    )


def critical_path(nodes: DataFrame, edges: DataFrame, outputs: DataFrame, costs: DataFrame) -> DataFrame:
    """(program_id, critical_ms): the heaviest path to each program's output, node weights from ``costs``
    (op, latency_ms)."""
    weighted = nodes.join(costs.select("op", "latency_ms"), "op", "left").withColumn("latency_ms", F.coalesce("latency_ms", F.lit(5.0)))
    paths = longest_paths(weighted, edges, F.col("latency_ms"))
    ends = outputs.select("program_id", F.col("output").alias("node"))
    return paths.join(ends, ["program_id", "node"]).select("program_id", F.round("length", 3).alias("critical_ms"))


def _reached(own: list[dict]) -> list[tuple]:
    """(node,) of all that the starts reach, by the edges that lead into each node."""
    after: dict[str, list[str]] = {}
    for n in own:
        for i in n["ins"] or ():
            after.setdefault(i["src"], []).append(n["node"])
    seen = {n["node"] for n in own if n["start"]}
    todo = list(seen)
    while todo:
        for n in after.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return [(n,) for n in seen]


def reachable(edges: DataFrame, starts: DataFrame, forward: bool = True) -> DataFrame:
    """(program_id, node): all that the start nodes reach along (or against) the edges, themselves included.
    Cycles are no harm: a round only keeps nodes not seen before."""
    scratch = Scratch(edges.sparkSession, "reach")
    a, b = ("src", "dst") if forward else ("dst", "src")
    links = scratch.save(edges.select("program_id", F.col(a).alias("src"), F.col(b).alias("dst")).distinct())
    first = starts.select("program_id", "node").distinct()
    large = _by_size(links, scratch)
    few = (lambda df: df) if large is None else (lambda df: df.join(large, "program_id", "left_anti"))
    ends = few(links).select("program_id", F.col("src").alias("node")).unionByName(few(links).select("program_id", F.col("dst").alias("node")))
    told = few(first).withColumn("start", F.lit(True)).unionByName(ends.withColumn("start", F.lit(False))).groupBy("program_id", "node").agg(F.bool_or("start").alias("start"))
    seen = _per_program(told, few(links).withColumn("cost", F.lit(0.0)), _reached, "program_id string, node string")
    if large is None:
        return seen
    links, found = links.join(large, "program_id", "left_semi"), scratch.save(first.join(large, "program_id", "left_semi"))
    frontier = found
    while not frontier.isEmpty():
        step = links.join(frontier.withColumnRenamed("node", "src"), ["program_id", "src"]).select("program_id", F.col("dst").alias("node")).distinct()
        frontier = scratch.save(step.join(found, ["program_id", "node"], "left_anti"))
        found = scratch.save(found.unionByName(frontier))
    return seen.unionByName(found)


def dead_nodes(nodes: DataFrame, edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """Nodes that no path leads from to their program's output."""
    live = reachable(edges, outputs.select("program_id", F.col("output").alias("node")), forward=False)
    return nodes.select("program_id", "node").join(live, ["program_id", "node"], "left_anti")


def cyclic_programs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(program_id, n_stuck): programs in which peeling off nodes without predecessors leaves some over."""
    settled = longest_paths(nodes, edges).select("program_id", "node")
    left = nodes.select("program_id", "node").join(settled, ["program_id", "node"], "left_anti")
    return left.groupBy("program_id").agg(F.count("*").cast("long").alias("n_stuck"))


def slice_around(edges: DataFrame, errors: DataFrame, budget: int) -> DataFrame:
    """(program_id, node, role, over_budget): erroneous nodes, direct predecessors and successors."""
    e = errors.select("program_id", "node").distinct()
    up = edges.join(e.withColumnRenamed("node", "dst"), ["program_id", "dst"]).select("program_id", F.col("src").alias("node"), F.lit(1).alias("r"))
    down = edges.join(e.withColumnRenamed("node", "src"), ["program_id", "src"]).select("program_id", F.col("dst").alias("node"), F.lit(2).alias("r"))
    every = e.withColumn("r", F.lit(0)).unionByName(up).unionByName(down).groupBy("program_id", "node").agg(F.min("r").alias("r"))
    role = F.element_at(F.array(F.lit("error"), F.lit("upstream"), F.lit("downstream")), F.col("r") + 1)
    size = every.groupBy("program_id").agg((F.count("*") > budget).alias("over_budget"))
    return every.join(size, "program_id").select("program_id", "node", role.alias("role"), "over_budget")


def producers(nodes: DataFrame, edges: DataFrame, through: str = "EXTRACT_FIELD") -> DataFrame:
    """(program_id, node, producer): for each ``through`` node the real producer at the end of its chain."""
    scratch = Scratch(nodes.sparkSession, "chain")
    skip = nodes.where(F.col("op") == through).select("program_id", "node")
    into = edges.join(skip.withColumnRenamed("node", "dst"), ["program_id", "dst"]).select("program_id", F.col("dst").alias("node"), F.col("src").alias("producer"))
    now, left = scratch.save(into), -1
    while left:  # a chain's steps double in every round
        hop = now.select("program_id", F.col("node").alias("producer"), F.col("producer").alias("further"))
        after = scratch.save(
            now.join(hop, ["program_id", "producer"], "left").select("program_id", "node", F.coalesce("further", "producer").alias("producer"), F.col("further").isNotNull().alias("moved"))
        )
        before, left = left, after.where("moved").count()
        if left and left == before:
            raise ValueError(f"a cycle of {through} nodes has no producer")
        now = after.drop("moved")
    return now


def shapes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(program_id, shape): single, independent, linear or fork_join, by degrees."""
    out = edges.groupBy("program_id", F.col("src").alias("node")).agg(F.count_distinct("dst").alias("outs"))
    ins = edges.groupBy("program_id", F.col("dst").alias("node")).agg(F.count_distinct("src").alias("ins"))
    degrees = nodes.select("program_id", "node").join(out, ["program_id", "node"], "left").join(ins, ["program_id", "node"], "left")
    per = degrees.groupBy("program_id").agg(
        F.count("*").alias("n"), F.coalesce(F.max("outs"), F.lit(0)).alias("o"), F.coalesce(F.max("ins"), F.lit(0)).alias("i"), F.coalesce(F.sum("outs"), F.lit(0)).alias("m")
    )
    kind = F.when(F.col("n") == 1, "single").when(F.col("m") == 0, "independent").when((F.col("o") <= 1) & (F.col("i") <= 1) & (F.col("m") == F.col("n") - 1), "linear")
    return per.select("program_id", kind.otherwise("fork_join").alias("shape"))


def edge_diff(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(program_id, n_exact, n_missing, n_extra) of two edge sets."""
    a, b = gold.distinct().withColumn("g", F.lit(1)), found.distinct().withColumn("f", F.lit(1))
    both = a.join(b, ["program_id", "src", "dst"], "full_outer")
    return both.groupBy("program_id").agg(
        F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).cast("long").alias("n_exact"),
        F.count_if(F.col("f").isNull()).cast("long").alias("n_missing"),
        F.count_if(F.col("g").isNull()).cast("long").alias("n_extra"),
    )


def contract_nodes(edges: DataFrame, nodes: DataFrame, op: str) -> DataFrame:
    """Edges after the nodes of ``op`` are contracted into what feeds them."""
    feeds = producers(nodes, edges, op)
    own = edges.join(nodes.where(F.col("op") == op).select("program_id", F.col("node").alias("dst")), ["program_id", "dst"], "left_anti")
    real = own.join(feeds.withColumnRenamed("node", "src"), ["program_id", "src"], "left")
    return real.select("program_id", F.coalesce("producer", "src").alias("src"), "dst").distinct()


def _per_program(nodes: DataFrame, edges: DataFrame, plan: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Runs ``plan`` on each program's nodes (dicts with their incoming edges as ``ins``): one row a program
    is gathered by Spark, and programs come to Python in batches. A program is bounded by what one author
    wrote."""
    id_kind = nodes.schema["program_id"].dataType.simpleString()
    schema = schema.replace("program_id string", f"program_id {id_kind}")
    ins = edges.groupBy("program_id", F.col("dst").alias("node")).agg(F.collect_list(F.struct("src", "cost")).alias("ins"))
    whole = nodes.join(ins, ["program_id", "node"], "left").groupBy("program_id").agg(
        F.collect_list(F.struct(*[c for c in nodes.columns if c != "program_id"], "ins")).alias("nodes")
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(id_, *row) for id_, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in plan(own)]
            kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
            told = [c.split()[1] for c in schema.split(", ")]
            columns = [pa.array([r[i] for r in rows], kinds[k] if i else batch.schema.field(0).type) for i, k in enumerate(told)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return whole.select("program_id", "nodes").mapInArrow(run, schema)


def _upward(nodes: list[dict]) -> tuple[dict, dict, dict]:
    """Weights, predecessors with costs, and each node's longest way to a sink, found from the sinks up."""
    weight = {n["node"]: n["weight"] for n in nodes}
    before = {n["node"]: [(i["src"], i["cost"]) for i in n["ins"] or () if i["src"] in weight] for n in nodes}
    rank = dict(weight)
    for _ in range(len(weight) + 1):
        moved = False
        for node, ins in before.items():
            for src, cost in ins:
                way = weight[src] + cost + rank[node]
                if way > rank[src] + 1e-12:
                    rank[src], moved = way, True
        if not moved:
            return weight, before, rank
    raise ValueError("a cycle cannot be scheduled")


SCHEDULE = "program_id string, node string, worker string, start_ms double, end_ms double"


def list_schedule(nodes: DataFrame, edges: DataFrame, pools: dict[str, int] | None = None) -> DataFrame:
    """Per program: nodes (program_id, node, pos, resource_class, weight) are placed by critical-path
    priority, ties in program order, each on the earliest free worker of its class (pool of 1 by default)."""
    pools = pools or {}

    def plan(own: list[dict]) -> list[tuple]:
        own = sorted(own, key=lambda n: n["pos"])
        weight, before, rank = _upward(own)
        pos = {n["node"]: i for i, n in enumerate(own)}
        kind = {n["node"]: n["resource_class"] for n in own}
        free = {k: [0.0] * pools.get(k, 1) for k in set(kind.values())}
        end: dict[str, float] = {}
        out = []
        while len(end) < len(weight):
            ready = [n for n in weight if n not in end and all(s in end for s, _ in before[n])]
            node = min(ready, key=lambda n: (-rank[n], pos[n]))
            workers = free[kind[node]]
            w = workers.index(min(workers))
            start = max([workers[w], *(end[s] for s, _ in before[node])])
            workers[w] = end[node] = start + weight[node]
            out.append((node, f"{kind[node]}:{w}", round(start, 3), round(end[node], 3)))
        return out

    return _per_program(nodes, edges.withColumn("cost", F.lit(0.0)), plan, SCHEDULE)


def heft_schedule(nodes: DataFrame, edges: DataFrame, processors: int = 2) -> DataFrame:
    """Per program: nodes by descending upward rank (ties in topological order, then by name), each on the processor
    that ends it first; edges (program_id, src, dst, cost) delay their targets."""

    def plan(own: list[dict]) -> list[tuple]:
        weight, before, rank = _upward(own)
        free, end, out, place = [0.0] * processors, {}, [], {}
        while ready := sorted(n for n in before if n not in place and all(s in place for s, _ in before[n])):
            place |= {n: len(place) + k for k, n in enumerate(ready)}
        for node in sorted(weight, key=lambda n: (-round(rank[n], 9), place[n])):
            data = max((end[s] + c for s, c in before[node]), default=0.0)
            p = min(range(processors), key=lambda i: (max(free[i], data), i))
            start = max(free[p], data)
            free[p] = end[node] = start + weight[node]
            out.append((node, f"p{p}", round(start, 3), round(end[node], 3)))
        return out

    return _per_program(nodes, edges, plan, SCHEDULE)


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(program_id, node, place): repeatedly the smallest name among nodes whose predecessors are placed."""

    def plan(own: list[dict]) -> list[tuple]:
        before = {n["node"]: {i["src"] for i in n["ins"] or ()} for n in own}
        out: dict[str, int] = {}
        while ready := [n for n in before if n not in out and before[n] <= out.keys()]:
            out[min(ready)] = len(out)
        return list(out.items())

    return _per_program(nodes, edges.withColumn("cost", F.lit(0.0)), plan, "program_id string, node string, place int")


def removable_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(program_id, src, dst, safe): positional edges that nothing reads by name; only those between
    read-only nodes whose parameters are all bound may go. nodes: (…, read_only, bound); edges: kind is
    input, bind, after or guard; order edges always stay."""
    named = edges.where("kind = 'bind'").select("program_id", "src", "dst")
    idle = edges.where("kind = 'input'").select("program_id", "src", "dst").join(named, ["program_id", "src", "dst"], "left_anti")
    a = nodes.select("program_id", F.col("node").alias("src"), F.col("read_only").alias("ra"))
    b = nodes.select("program_id", F.col("node").alias("dst"), F.col("read_only").alias("rb"), "bound")
    joined = idle.join(a, ["program_id", "src"]).join(b, ["program_id", "dst"])
    return joined.select("program_id", "src", "dst", (F.col("ra") & F.col("rb") & F.col("bound")).alias("safe"))
