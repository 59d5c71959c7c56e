"""The instruction set: signatures and nominal costs of 35 operations, as a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Nominal cost of a single-shot answer by a 70B model.
BASELINE_LATENCY_MS = 2500.0
BASELINE_ENERGY_J = 900.0
BASELINE_MEMORY_MB = 140000.0
# Energy per call or per token, FLOPs per token, resident memory.
CALL_ENERGY_J = 0.005
TOKEN_ENERGY_J = 0.02
TOKEN_FLOPS = 4e9
PYTHON_MEMORY_MB = 30.0
LM_MEMORY_MB = 4600.0


@dataclass(frozen=True)
class Op:
    op: str
    cls: str
    input_types: tuple[str, ...]
    min_inputs: int
    max_inputs: int | None
    output_rule: str
    resource_class: str
    latency_ms: float
    tokens_in: int
    tokens_out: int

    @property
    def energy_j(self) -> float:
        tokens = self.tokens_in + self.tokens_out
        return TOKEN_ENERGY_J * tokens if tokens else CALL_ENERGY_J

    @property
    def flops(self) -> float:
        return TOKEN_FLOPS * (self.tokens_in + self.tokens_out)

    @property
    def memory_mb(self) -> float:
        return {"lm": LM_MEMORY_MB, "python": PYTHON_MEMORY_MB, "runtime": PYTHON_MEMORY_MB}.get(self.resource_class, 0.0)

    def output_type(self, inputs: list[str]) -> str:
        """FIXED:t is t; SAME_AS:i the i-th input's type; ITEM_OF:i what that list holds."""
        rule, _, rest = self.output_rule.partition(":")
        if rule == "FIXED":
            return rest
        given = inputs[int(rest)] if int(rest) < len(inputs) else "Any"
        return given if rule == "SAME_AS" else item_of(given)


def item_of(type_name: str) -> str:
    for kind in ("List[", "Set["):
        if type_name.startswith(kind) and type_name.endswith("]"):
            return type_name[len(kind) : -1]
    return "Any"


def compatible(a: str, b: str) -> bool:
    """Equal after spaces go, or either is Any or Unknown; brackets are compared inside."""
    a, b = a.replace(" ", ""), b.replace(" ", "")
    if a == b or {a, b} & {"Any", "Unknown"}:
        return True
    if "[" in a and "[" in b:
        (head_a, _, rest_a), (head_b, _, rest_b) = a.partition("["), b.partition("[")
        if head_a != head_b or not (rest_a.endswith("]") and rest_b.endswith("]")):
            return False
        x, y = _arguments(rest_a[:-1]), _arguments(rest_b[:-1])
        return len(x) == len(y) and all(map(compatible, x, y))
    return False


def _arguments(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "[") - (c == "]")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


# Operation, class, input types, fewest and most inputs (None: any number), output rule, resource class,
# latency in ms, tokens in and out. Energy and memory follow from the class.
OPERATIONS = (
    Op("LOAD", "io", ("Str",), 1, 1, "FIXED:Any", "python", 20.0, 0, 0),
    Op("SAVE", "io", ("Any",), 1, 1, "FIXED:Any", "python", 20.0, 0, 0),
    Op("SEARCH", "retrieval", ("Str", "Any"), 1, 2, "FIXED:List[Any]", "api", 120.0, 0, 0),
    Op("FETCH", "retrieval", ("Str",), 1, 1, "FIXED:Str", "api", 150.0, 0, 0),
    Op("QUERY_DB", "retrieval", ("Str",), 1, 1, "FIXED:Table", "db", 40.0, 0, 0),
    Op("FILTER", "transform", ("List[Any]",), 1, 1, "SAME_AS:0", "python", 5.0, 0, 0),
    Op("TRANSFORM", "transform", ("List[Any]",), 1, 1, "SAME_AS:0", "python", 10.0, 0, 0),
    Op("EXTRACT", "transform", ("Any",), 1, 1, "FIXED:Any", "python", 8.0, 0, 0),
    Op("DEDUP", "transform", ("List[Any]",), 1, 1, "SAME_AS:0", "python", 3.0, 0, 0),
    Op("SORT", "transform", ("List[Any]",), 1, 1, "SAME_AS:0", "python", 4.0, 0, 0),
    Op("JOIN", "transform", ("List[Any]", "List[Any]"), 2, 2, "FIXED:List[Any]", "python", 8.0, 0, 0),
    Op("MERGE", "transform", ("Any", "Any"), 2, 2, "SAME_AS:0", "python", 2.0, 0, 0),
    Op("ARGMIN", "compute", ("List[Any]",), 1, 1, "ITEM_OF:0", "python", 1.0, 0, 0),
    Op("ARGMAX", "compute", ("List[Any]",), 1, 1, "ITEM_OF:0", "python", 1.0, 0, 0),
    Op("MIN", "compute", ("List[Any]",), 1, 1, "ITEM_OF:0", "python", 1.0, 0, 0),
    Op("MAX", "compute", ("List[Any]",), 1, 1, "ITEM_OF:0", "python", 1.0, 0, 0),
    Op("SUM", "compute", ("List[Float]",), 1, 1, "FIXED:Float", "python", 1.0, 0, 0),
    Op("AVG", "compute", ("List[Float]",), 1, 1, "FIXED:Float", "python", 1.0, 0, 0),
    Op("COUNT", "compute", ("List[Any]",), 1, 1, "FIXED:Int", "python", 1.0, 0, 0),
    Op("CALCULATE", "compute", ("Float",), 0, None, "FIXED:Float", "python", 1.0, 0, 0),
    Op("COMPARE", "compute", ("Any", "Any"), 2, 2, "FIXED:Bool", "python", 1.0, 0, 0),
    Op("CONVERT", "compute", ("Float",), 0, 1, "FIXED:Float", "api", 80.0, 0, 0),
    Op("GENERATE", "lm", ("Any",), 1, None, "FIXED:Str", "lm", 600.0, 800, 300),
    Op("SUMMARIZE", "lm", ("Str",), 1, 1, "FIXED:Str", "lm", 400.0, 2000, 300),
    Op("TRANSLATE", "lm", ("Str",), 1, 1, "FIXED:Str", "lm", 500.0, 1000, 1000),
    Op("CLASSIFY", "lm", ("Any",), 1, 1, "FIXED:Str", "lm", 200.0, 600, 5),
    Op("EXTRACT_ENTITIES", "lm", ("Any",), 1, 1, "FIXED:List[Entity]", "lm", 300.0, 1000, 200),
    Op("CODEGEN", "lm", ("Any",), 1, None, "FIXED:Str", "lm", 900.0, 1000, 600),
    Op("PLAN", "lm", ("Str",), 1, 1, "FIXED:Json", "lm", 500.0, 600, 400),
    Op("SEND", "action", ("Str",), 1, 1, "FIXED:Any", "api", 100.0, 0, 0),
    Op("EXEC_ACTION", "action", ("Any",), 0, None, "FIXED:Any", "api", 150.0, 0, 0),
    Op("EXTRACT_FIELD", "control", ("Any",), 1, 1, "FIXED:Any", "runtime", 0.001, 0, 0),
    Op("MAKE_LIST", "control", ("Any",), 1, None, "FIXED:List[Any]", "runtime", 0.001, 0, 0),
    Op("VERIFY", "control", ("Any",), 1, None, "FIXED:Bool", "lm", 50.0, 400, 1),
    Op("SELECT", "control", ("Bool", "Any", "Any"), 3, 3, "SAME_AS:1", "runtime", 0.1, 0, 0),
)
TABLE = {o.op: o for o in OPERATIONS}


def cost_table(spark: SparkSession) -> DataFrame:
    """The 35 rows as a dimension table."""
    rows = [
        (o.op, o.cls, list(o.input_types), o.min_inputs, o.max_inputs, o.output_rule, o.resource_class, o.latency_ms, o.tokens_in, o.tokens_out, o.flops, o.energy_j, o.memory_mb)
        for o in TABLE.values()
    ]
    return spark.createDataFrame(
        rows,
        "op string, cls string, input_types array<string>, min_inputs int, max_inputs int, output_rule string, resource_class string, latency_ms double, tokens_in int, tokens_out int, flops double, energy_j double, memory_mb double",
    )
