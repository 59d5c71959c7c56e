"""Where values come from: nested leaves, earlier outputs, the user's text, the environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 8


def flatten(df: DataFrame, id_col: str, variant: str, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, path, value): leaves of a variant as text, empty containers kept; below ``depth`` levels the rest
    is one leaf. The levels are unrolled, each a generator over what is still nested."""
    spark = df.sparkSession
    level = df.select(id_col, F.lit("").alias("path"), F.col(variant).alias("v"))
    out = None
    for _ in range(depth):
        kind = F.schema_of_variant("v")
        inner = kind.startswith("OBJECT<") & (kind != "OBJECT<>") | (kind.startswith("ARRAY<") & (F.to_json("v") != "[]"))
        leaves = level.where(~F.coalesce(inner, F.lit(False))).select(id_col, "path", _leaf(F.col("v")).alias("value"))
        out = leaves if out is None else out.unionAll(leaves)
        nested = level.where(inner)
        exploded = spark.sql(
            f"SELECT n.{id_col}, n.path AS above, e.key, e.pos, e.value AS v FROM {{nested}} n, LATERAL variant_explode(n.v) e", nested=nested
        )
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(
            F.concat(F.when(F.col("above") == "", "").otherwise("."), F.col("key"))
        )
        level = exploded.select(id_col, F.concat("above", step).alias("path"), "v")
    return out.unionAll(level.select(id_col, "path", _leaf(F.col("v")).alias("value")))


def _leaf(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def paths_of(leaves: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """All paths at which a wanted (id, value) occurs."""
    return wanted.join(leaves, [id_col, "value"])


def trace_values(steps: DataFrame, texts: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """(by, step, value, origin, producer_step) for steps (by, step, value): LITERAL if the text (by, text)
    holds the value; runtime_ref if exactly one earlier step of the sequence has it, AMBIGUOUS if several;
    ENV_STATE if it is in ``known`` (value); else UNKNOWN."""
    earlier = steps.select(by, F.col("step").alias("before"), "value")
    seen = (
        steps.join(earlier, [by, "value"])
        .where("before < step")
        .groupBy(by, "step", "value")
        .agg(F.count_distinct("before").alias("n"), F.min("before").alias("first"))
    )
    state = known.select("value").distinct().withColumn("in_state", F.lit(True))
    joined = steps.join(seen, [by, "step", "value"], "left").join(texts, by, "left").join(state, "value", "left")
    origin = (
        F.when(F.contains("text", "value"), "LITERAL")
        .when(F.col("n") == 1, "runtime_ref")
        .when(F.col("n") > 1, "AMBIGUOUS")
        .when(F.col("in_state"), "ENV_STATE")
        .otherwise("UNKNOWN")
    )
    return joined.withColumn("origin", origin).select(
        by, "step", "value", "origin", F.when(F.col("origin") == "runtime_ref", F.col("first")).alias("producer_step")
    )


def trace_lists(lists: DataFrame, earlier: DataFrame, by: str) -> DataFrame:
    """lists (by, step, items) against earlier outputs (by, before, items): ``whole`` if one equals the list,
    ``elements`` if every item occurs in some earlier output, else ``unknown``."""
    old = earlier.select(by, "before", F.col("items").alias("old"))
    whole = lists.join(old, by).where("before < step AND items = old").select(by, "step").distinct().withColumn("whole", F.lit(True))
    single = old.select(by, "before", F.explode("old").alias("item")).distinct()
    parts = lists.select(by, "step", F.explode("items").alias("item")).distinct()
    found = parts.join(single, [by, "item"], "left").groupBy(by, "step", "item").agg(F.bool_or(F.coalesce(F.col("before") < F.col("step"), F.lit(False))).alias("hit"))
    every = found.groupBy(by, "step").agg(F.bool_and("hit").alias("every"))
    out = lists.join(whole, [by, "step"], "left").join(every, [by, "step"], "left")
    kind = F.when(F.col("whole"), "whole").when(F.col("every"), "elements").otherwise("unknown")
    return out.select(by, "step", "items", kind.alias("origin"))


def owned(paths: DataFrame, owners: DataFrame, entity: str, actor: str) -> DataFrame:
    """Whether the entity a path points to belongs to the acting user; owners: (entity, owner)."""
    joined = paths.join(owners.select(entity, "owner"), entity, "left")
    return joined.withColumn("own", F.coalesce(F.col("owner") == F.col(actor), F.lit(False))).drop("owner")


def literal_observed(text: Column, value: Column) -> Column:
    """Whether the value occurs in the text; 3.0 counts as 3, and thousands commas do not matter."""
    plain = F.regexp_replace(F.lower(text), "(?<=\\d),(?=\\d{3})", "")
    short = F.regexp_replace(F.regexp_replace(F.lower(value), "(?<=\\d),(?=\\d{3})", ""), "^(-?\\d+)\\.0+$", "$1")
    return F.contains(plain, short)


def failure_class(value: Column, expected: Column, text: Column, others: Column) -> Column:
    """D: only the format differs; C: the expected value stands under another key; A: it is visible in the
    text; B: it is not."""
    from ..functions.text import format_difference

    return (
        F.when(format_difference(value, expected) == "format", "D")
        .when(F.array_contains(others, expected), "C")
        .when(literal_observed(text, expected), "A")
        .otherwise("B")
    )


def signature_distractors(own: DataFrame, pool: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(tool, other, rank): of the 2n pool tools whose parameter names overlap most, n by hash. Both tables
    are tool catalogs: (tool, names)."""
    from pyspark.sql.window import Window

    a = own.select("tool", F.explode("names").alias("name"))
    b = pool.select(F.col("tool").alias("other"), F.explode("names").alias("name"))
    shared = a.join(b, "name").where("tool <> other").groupBy("tool", "other").agg(F.count_distinct("name").alias("overlap"))
    near = shared.withColumn("r", F.row_number().over(Window.partitionBy("tool").orderBy(F.desc("overlap"), "other"))).where(F.col("r") <= 2 * n)
    order = F.md5(F.concat_ws("|", F.lit(seed), "tool", "other"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("tool").orderBy(order))).where(F.col("rank") <= n).select("tool", "other", "rank")


def label_relation(a: Column, b: Column, family: dict[str, str], aliases: dict[str, str], fallback: str) -> Column:
    """EXACT, ALIAS, FALLBACK, SAME_FAMILY or INCOMPATIBLE, from small label tables."""
    def of(table: dict[str, str], c: Column) -> Column:
        pairs = [x for kv in table.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
        return F.create_map(*pairs)[c] if pairs else F.lit(None).cast("string")

    canonical = lambda c: F.coalesce(of(aliases, c), c)
    return (
        F.when(a == b, "EXACT")
        .when(canonical(a) == canonical(b), "ALIAS")
        .when((a == fallback) | (b == fallback), "FALLBACK")
        .when(of(family, canonical(a)) == of(family, canonical(b)), "SAME_FAMILY")
        .otherwise("INCOMPATIBLE")
    )
