"""Runs programs: every node becomes a lazy DataFrame or a scalar; only what the output needs is built.

Values are DataFrames (lists of records) or plain Python scalars. A scalar that comes from data (SUM, VERIFY,
COMPARE ...) is one row fetched when a guard, SELECT or binding needs it; everything else stays a plan, so
Catalyst sees a chain of collection operations as one query. A skipped value is no null: a node that reads
one by its inputs fails, one whose condition was skipped is skipped too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import collection as C
from . import isa
from .program import Node, Program
from .validator import downstream, upstream, validate

SKIPPED = type("Skipped", (), {"__repr__": lambda self: "<skipped>"})()


class RunFailure(RuntimeError):
    pass


@dataclass
class Event:
    node: str
    op: str
    attempt: int
    status: str
    note: str = ""
    superseded: bool = False


@dataclass
class Run:
    value: object
    events: list[Event] = field(default_factory=list)

    def trace(self, spark: SparkSession, program_id: str) -> DataFrame:
        """The events as a table, with each op's nominal cost."""
        rows = []
        for seq, e in enumerate(self.events):
            o = isa.TABLE[e.op]
            ran = e.status != "skipped"
            rows.append(
                (program_id, seq, e.node, e.op, e.attempt, e.status, o.latency_ms * ran, o.tokens_in * ran, o.tokens_out * ran, o.energy_j * ran, o.memory_mb, e.superseded)
            )
        return spark.createDataFrame(
            rows,
            "program_id string, seq int, node string, op string, attempt int, status string, latency_ms double, tokens_in int, tokens_out int, energy_j double, memory_mb double, superseded boolean",
        )


Action = Callable[..., object]


class Engine:
    """``tables`` feed LOAD, SEARCH, FETCH and QUERY_DB; ``actions`` are functions (inputs, params, attempt)
    for EXEC_ACTION and for ops that need a model. Sinks only run once a value is asked for, in the order
    that ``after`` gives."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], actions: dict[str, Action] | None = None) -> None:
        self.spark, self.tables, self.actions = spark, tables, dict(actions or {})
        self.outbox: list[tuple[str, object]] = []

    def run(self, program: Program, inputs: dict[str, object] | None = None, check: bool = True) -> Run:
        if check and not (report := validate(program)).valid:
            raise RunFailure("; ".join(f"{i.code} {i.node or ''} {i.message}" for i in report.issues if i.severity == "error"))
        return _Execution(self, program, inputs or {}).go()

    def apply(self, op: str, params: dict, inputs: list, attempt: int = 1) -> object:
        """One operation on values; parameter names of either dialect (expr or expression, order or descending)."""
        a = inputs[0] if inputs else None
        b = inputs[1] if len(inputs) > 1 else None
        key = params.get("key")
        if op in self.actions and op != "EXEC_ACTION":
            return self.actions[op](inputs, params, attempt)
        match op:
            case "LOAD":
                return self._table(a or params.get("source"))
            case "QUERY_DB":
                return C.query_db(self.spark, a or params["query"], **self.tables)
            case "SEARCH":
                domain = self._table(params.get("domain")) if b is None else b
                text = params.get("text", "text")
                return C.search(domain, text, str(a or params.get("query", "")).split(), int(params.get("limit", 10)), params.get("id", domain.columns[0]))
            case "FETCH":
                found = C.fetch(self._table(params.get("table", "pages")), params.get("key", "url"), a)
                return _scalar(found.select(params.get("content", "html")).limit(1))
            case "FILTER":
                return C.filter_rows(a, params.get("predicate"), key, params.get("value"))
            case "TRANSFORM":
                return C.transform_rows(a, **(params.get("op") or {}))
            case "EXTRACT":
                return C.extract_fields(a, list(params.get("fields") or []))
            case "DEDUP":
                return C.dedup_rows(a, params.get("keys"), params.get("order_by"))
            case "SORT":
                return C.sort_rows(a, key, params.get("order", "asc"), params.get("tiebreak", _ties(a, key)), params.get("descending"))
            case "JOIN":
                return C.concat_rows(a, b) if isinstance(a, DataFrame) else str(params.get("separator", " ")).join(map(str, inputs))
            case "MERGE":
                if isinstance(a, DataFrame) and isinstance(b, DataFrame):
                    return C.concat_rows(a, b)
                return {**a, **b} if isinstance(a, dict) and isinstance(b, dict) else (b if a is None else a)
            case "MIN" | "MAX" | "ARGMIN" | "ARGMAX":
                how = "min" if op.endswith("MIN") else "max"
                if key is None:
                    return _scalar(a.agg((F.min if how == "min" else F.max)(a.columns[0])))
                best = C.arg_extreme(a, key, how, params.get("tiebreak", _ties(a, key)))
                if op.startswith("ARG") and best.isEmpty():
                    raise RunFailure(f"{op} of no rows")
                return best
            case "SUM" | "AVG":
                column = key or next(n for n, t in a.dtypes if t in ("double", "float", "int", "bigint", "smallint") or t.startswith("decimal"))
                return _scalar(a.agg((C.total if op == "SUM" else C.mean)(column).alias("v")))
            case "COUNT":
                return a.count()
            case "CALCULATE":
                names = {f"v{i}": v for i, v in enumerate(inputs)} | {k: v for k, v in params.items() if k not in ("expr", "expression")}
                value = C.calculate(params.get("expr") or params["expression"], list(names))
                row = self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in names.items()] or [F.lit(0).alias("_")])
                return _scalar(row.select(value))
            case "COMPARE":
                row = self.spark.range(1).select(C.compare(F.lit(a), params.get("op") or params.get("operator", "=="), F.lit(b)))
                return _scalar(row)
            case "CONVERT":
                amount = params.get("amount") if a is None else a
                if "rate" in params:
                    return round(float(amount) * float(params["rate"]), 2)
                row = self.spark.range(1).select(F.lit(float(amount)).alias("amount"))
                return _scalar(C.convert(row, "amount", self._table("rates"), F.lit(params["from"]), F.lit(params["to"])).select("converted"))
            case "EXTRACT_FIELD":
                return self._field(a, params["field"])
            case "MAKE_LIST":
                return list(inputs)
            case "VERIFY":
                if isinstance(a, DataFrame):
                    return bool(_scalar(C.verify(a, params.get("check", "true")).select(F.coalesce("verified", F.lit(True)))))
                return all(bool(i) for i in inputs)
            case "SAVE":
                a.write.mode(params.get("mode", "errorifexists")).parquet(params["path"])
                return {"status": "saved", "path": params["path"]}
            case "SEND":
                self.outbox.append((params.get("channel", ""), a))
                return {"status": "sent"}
            case "EXEC_ACTION":
                if params.get("action") not in self.actions:
                    raise RunFailure(f"no action {params.get('action')!r}")
                return self.actions[params["action"]](inputs, params, attempt)
        raise RunFailure(f"{op} needs a function in actions")

    def _table(self, name: str | None) -> DataFrame:
        if name not in self.tables:
            raise RunFailure(f"no table {name!r}")
        return self.tables[name]

    def _field(self, value: object, path: str) -> object:
        if isinstance(value, DataFrame):
            steps = paths.parse(path)
            if not steps:
                return _scalar(value.limit(1))
            column = F.col(str(steps[0]))
            for step in steps[1:]:
                column = F.get(column, F.lit(step)) if isinstance(step, int) else column[step]
            return _scalar(value.select(column).limit(1))
        status, found = paths.resolve(value, path)
        if status != "ok":
            raise RunFailure(f"{status}: {path!r}")
        return found


def _ties(df: DataFrame, key: str | None) -> list[str]:
    return [c for c, t in df.dtypes if c != key and not t.startswith(("map", "variant"))]


def _scalar(df: DataFrame) -> object:
    rows = df.take(2)
    if len(rows) > 1:
        raise RunFailure("one value was expected, there are several rows")
    return rows[0][0] if rows else None


class _Execution:
    def __init__(self, engine: Engine, program: Program, inputs: dict[str, object]) -> None:
        self.engine, self.program = engine, program
        self.values: dict[str, object] = dict(inputs)
        self.attempts: dict[str, int] = {}
        self.events: list[Event] = []

    def go(self) -> Run:
        p = self.program
        value = self._value(p.output)
        checks = {n.id: n.retry for n in p.nodes if n.retry and n.retry[1] != "error" and n.id in upstream(p, {p.output}, with_retry=True)}
        while failed := [(i, on) for i, (most, on) in checks.items() if self._value(on) is False and self.attempts.get(i, 0) < most]:
            for i, _ in failed[:1]:  # roll back this node and all that rests on it
                gone = downstream(p, i)
                for e in self.events:
                    e.superseded |= e.node in gone
                for g in gone:
                    self.values.pop(g, None)
            value = self._value(p.output)
        for i, (_, on) in checks.items():
            if self._value(on) is False:
                self.events.append(Event(i, p.node(i).op, self.attempts.get(i, 0), "retry_exhausted"))
                raise RunFailure(f"{on} stays false after {self.attempts.get(i, 0)} attempts of {i}")
        return Run(value, self.events)

    def _value(self, ref: str) -> object:
        if ref in self.values:
            return self.values[ref]
        if ref.startswith("@"):
            raise RunFailure(f"input {ref} is missing")
        node = self.program.node(ref)
        self.values[ref] = value = self._eval(node)
        return value

    def _eval(self, n: Node) -> object:
        if n.guard:
            cond = self._value(n.guard[0])
            if cond is SKIPPED or bool(cond) != n.guard[1]:
                return self._skip(n)
        for ref in n.after:
            self._value(ref)
        if n.op == "SELECT":
            cond = self._value(n.inputs[0])
            if cond is SKIPPED:
                return self._skip(n)
            chosen = self._value(n.inputs[1 if cond else 2])
            if chosen is SKIPPED:
                raise RunFailure(f"{n.id}: the chosen branch was skipped")
            return self._done(n, chosen)
        inputs = [self._value(r) for r in n.inputs]
        bound = {k: self._value(r) for k, r in n.param_refs.items()}
        if any(v is SKIPPED for v in [*inputs, *bound.values()]):
            raise RunFailure(f"{n.id} reads a skipped value")
        most = n.retry[0] if n.retry and n.retry[1] == "error" else 1
        for left in range(most - 1, -1, -1):
            self.attempts[n.id] = attempt = self.attempts.get(n.id, 0) + 1
            try:
                return self._done(n, self.engine.apply(n.op, n.params | bound, inputs, attempt))
            except RunFailure as fault:
                self.events.append(Event(n.id, n.op, attempt, "error", str(fault)))
                if not left:
                    raise
        raise AssertionError

    def _skip(self, n: Node) -> object:
        self.events.append(Event(n.id, n.op, 0, "skipped"))
        return SKIPPED

    def _done(self, n: Node, value: object) -> object:
        self.events.append(Event(n.id, n.op, self.attempts.setdefault(n.id, 1), "ok"))
        return value


