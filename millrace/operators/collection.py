"""The collection algebra: rows of a DataFrame are the items of a list.

Parameter names follow the instruction set (predicate, key, order, expr, fields, from/to). A missing sort or
extreme key counts as 0; ties go by the ``tiebreak`` columns, which make every result deterministic.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_MATH = {"abs", "round", "floor", "ceil", "sqrt", "least", "greatest", "pow", "exp", "ln", "try_divide"}
_COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def filter_rows(df: DataFrame, predicate: str | None = None, key: str | None = None, value: object = None) -> DataFrame:
    """Rows that meet a SQL predicate, or whose ``key`` equals ``value``; without either, rows that hold a value."""
    if predicate is not None:
        return df.where(predicate)
    if key is not None:
        return df.where(F.col(key) == F.lit(value))
    return df.dropna("all")


def transform_rows(df: DataFrame, **exprs: str) -> DataFrame:
    return df.withColumns({name: F.expr(e) for name, e in exprs.items()})


def extract_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """The named columns; null for one that is absent; all for an empty list."""
    return df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]) if fields else df


def make_list(*columns: str | Column) -> Column:
    return F.array(*columns)


def compare(a: Column, op: str, b: Column) -> Column:
    """False for an unknown operator."""
    return _COMPARE[op](a, b) if op in _COMPARE else F.lit(False)


def guarded(cond: Column, value: Column, expect: bool = True) -> Column:
    """(status, value): the value where the condition is as expected, else skipped. A null condition is a
    skipped one, and passes the skip on; skipped is not null."""
    run = F.coalesce(cond == F.lit(expect), F.lit(False))
    return F.struct(F.when(run, "ok").otherwise("skipped").alias("status"), F.when(run, value).alias("value"))


def select_phi(cond: Column, a: Column, b: Column) -> Column:
    """Picks one of two (status, value) structs; a null condition skips; a chosen branch that was skipped is
    an error."""
    chosen = F.when(cond, a).when(~cond, b)
    status = F.when(cond.isNull(), "skipped").when(chosen["status"] == "skipped", "error").otherwise(chosen["status"])
    return F.struct(status.alias("status"), F.when(status == "ok", chosen["value"]).alias("value"))


def verify(df: DataFrame, predicate: str, by: list[str] | None = None) -> DataFrame:
    """Whether all rows (of each group) meet the predicate, and how many do not; null counts as not met."""
    met = F.coalesce(F.expr(predicate), F.lit(False))
    return df.groupBy(*(by or [])).agg(F.bool_and(met).alias("verified"), F.count_if(~met).cast("long").alias("n_failed"))


def concat_rows(*frames: DataFrame) -> DataFrame:
    """Lists end to end; columns by name, null where one lacks them."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def join_strings(df: DataFrame, column: str, separator: str, order_by: list[str], by: list[str] | None = None) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(*order_by, F.col(column).alias("_item"))))
    joined = F.array_join(F.transform(items, lambda r: r["_item"].cast("string")), separator)
    return df.groupBy(*(by or [])).agg(joined.alias("joined"))


def merge_values(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def merge_maps(a: Column, b: Column) -> Column:
    """Keys of ``b`` win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def dedup_rows(df: DataFrame, keys: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Distinct rows, or the first row by ``order_by`` of each key."""
    if not keys:
        return df.dropDuplicates()
    if not order_by:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_first"))  # one row a key, map-side
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def sort_rows(df: DataFrame, key: str, order: str = "asc", tiebreak: list[str] | None = None, descending: bool | None = None) -> DataFrame:
    down = order == "desc" if descending is None else descending
    main = F.coalesce(F.col(key), F.lit(0))
    return df.orderBy(main.desc() if down else main.asc(), *[F.col(c).asc_nulls_last() for c in tiebreak or []])


def arg_extreme(df: DataFrame, key: str, how: str, tiebreak: list[str], by: list[str] | None = None) -> DataFrame:
    """The row with the smallest ('min') or largest ('max') key, of each group; first by ``tiebreak`` on ties."""
    measure = F.coalesce(F.col(key).cast("double"), F.lit(0.0))
    order = F.struct((measure if how == "min" else -measure).alias("_k"), *tiebreak)
    rest = [c for c in df.columns if c not in (by or [])]
    found = df.groupBy(*(by or [])).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return found.where(F.col("_row").isNotNull()).select(*(by or []), "_row.*")


def total(column: str) -> Column:
    """Sum to two places; 0 for no rows."""
    return F.round(F.coalesce(F.sum(column), F.lit(0)).cast("double"), 2)


def mean(column: str) -> Column:
    return F.round(F.coalesce(F.avg(column), F.lit(0.0)), 2)


def calculate(expr: str, allowed: list[str]) -> Column:
    """An arithmetic expression over known columns; anything else in it is refused."""
    unknown = set(_NAME.findall(expr)) - set(allowed) - _MATH
    if unknown or re.search(r"[^\w\s.+\-*/%(),]", expr):
        raise ValueError(f"not arithmetic over {allowed}: {expr!r}")
    return F.expr(expr)


def convert(df: DataFrame, amount: str, rates: DataFrame, source: Column, target: Column, alias: str = "converted") -> DataFrame:
    """amount * rate to two places, by a rate table (from, to, rate); null where it has no such pair. The
    join is broadcast when the table is small enough by Spark's own size check."""
    named = rates.select(F.col("from").alias("_from"), F.col("to").alias("_to"), F.col("rate").alias("_rate"))
    joined = df.join(named, (source == F.col("_from")) & (target == F.col("_to")), "left")
    return joined.withColumn(alias, F.round(F.col(amount) * F.col("_rate"), 2)).drop("_from", "_to", "_rate")


def bind_scalars(df: DataFrame, **values: DataFrame) -> DataFrame:
    """Named values from frames of one row and column each, as columns; of several rows the largest counts."""
    for name, frame in values.items():
        df = df.join(F.broadcast(frame.agg(F.max(frame.columns[0]).alias(name))))  # one row, by the aggregate
    return df


def lookup(df: DataFrame, other: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    return df.join(other, on, how)


def members(df: DataFrame, other: DataFrame, on: list[str], keep: bool = True) -> DataFrame:
    return df.join(other.select(*on), on, "left_semi" if keep else "left_anti")


def top_k(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def search(df: DataFrame, text: str, words: list[str], k: int, id_col: str) -> DataFrame:
    """The k rows with most of the words, ties by id; each word counts once."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    score = reduce(lambda a, b: a + b, [F.contains(low, F.lit(w.lower())).cast("int") for w in words])
    return df.withColumn("score", score).where(F.col("score") > 0).orderBy(F.desc("score"), id_col).limit(k)


def fetch(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def query_db(spark, query: str, **tables: DataFrame) -> DataFrame:
    """Runs SQL over the given tables; they go in as arguments, so no session view is left behind."""
    return spark.sql(query, **tables)
