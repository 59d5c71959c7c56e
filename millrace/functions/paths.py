"""Typed paths into nested values: ``orders[0].order_id``; the empty path is the whole value."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = re.compile(r"(?P<name>[A-Za-z][A-Za-z0-9_]*)|\[(?P<index>0|[1-9][0-9]*)\]")


class PathError(ValueError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def parse(path: str) -> list[str | int]:
    """Names and list indexes. Names that begin with an underscore, signed or padded indexes and stray dots
    are refused."""
    steps: list[str | int] = []
    at = 0
    while at < len(path):
        if steps and path[at] == ".":
            at += 1
            if at == len(path) or path[at] == "[":
                raise PathError("SYNTAX", f"a name must follow the dot in {path!r}")
        elif steps and path[at] != "[":
            raise PathError("SYNTAX", f"unexpected {path[at]!r} in {path!r}")
        m = _STEP.match(path, at)
        if not m or (not steps and m["index"] is not None):
            raise PathError("SYNTAX", f"bad step at {at} in {path!r}")
        steps.append(m["name"] if m["name"] is not None else int(m["index"]))
        at = m.end()
    return steps


@dataclass(frozen=True)
class Resolution:
    """``status``: static (fully known), dynamic (from step ``at`` on only the value can tell) or refuted."""

    status: str
    at: int | None
    type: T.DataType | None
    code: str = ""


def check(schema: T.DataType, path: str) -> Resolution:
    """Follows a path through a Spark type. A variant is the boundary beyond which nothing is known."""
    here = schema
    for k, step in enumerate(parse(path)):
        if isinstance(here, T.VariantType):
            return Resolution("dynamic", k, None)
        if isinstance(step, int):
            if not isinstance(here, T.ArrayType):
                return Resolution("refuted", k, None, "INDEX_ON_NON_LIST")
            here = here.elementType
        elif isinstance(here, T.StructType):
            if step not in here.names:
                return Resolution("refuted", k, None, "FIELD_NOT_FOUND")
            here = here[step].dataType
        elif isinstance(here, T.MapType):
            here = here.valueType
        else:
            return Resolution("refuted", k, None, "FIELD_ON_PRIMITIVE")
    return Resolution("static", None, here)


def extract(value: Column, path: str) -> Column:
    """The value at the path of structs, maps and arrays; null where it is absent."""
    for step in parse(path):
        value = F.get(value, F.lit(step)) if isinstance(step, int) else value[step]
    return value


def extract_variant(value: Column, path: str, as_type: str) -> Column:
    """The value at the path of a variant; null where it is absent or of another type. Booleans are no
    integers, which the cast alone would let through."""
    text = "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in parse(path))
    out = F.try_variant_get(value, text, as_type)
    if as_type in ("int", "bigint", "long", "double", "float"):
        kind = F.schema_of_variant(F.try_variant_get(value, text, "variant"))
        return F.when(kind != "BOOLEAN", out)
    return out


def resolve(value: object, path: str) -> tuple[str, object]:
    """On a plain Python value: ('ok', value) or an error code and where it arose."""
    for step in parse(path):
        if isinstance(step, int):
            if not isinstance(value, list):
                return "INDEX_ON_NON_LIST", step
            if step >= len(value):
                return "INDEX_OUT_OF_RANGE", step
            value = value[step]
        elif isinstance(value, dict) and step in value:
            value = value[step]
        else:
            return "FIELD_NOT_FOUND", step
    return "ok", value
