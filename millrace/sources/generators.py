"""Synthetic programs and samples, by hash of a row number and a seed: the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = ("flight", "hotel", "product", "news", "weather")
KEYS = ("price", "rating", "stock", "duration")

#: archetype -> text of a program; {domain}, {key}, {n} are filled in by the row's hash.
ARCHETYPES = {
    "linear": '%a = SEARCH("q", domain="{domain}")\n%b = FILTER(%a, predicate="{key} < {n}")\n%c = ARGMIN(%b, key="{key}")\nreturn %c',
    "parallel": '%a = SEARCH("q", domain="{domain}")\n%b = SEARCH("r", domain="{domain}")\n%c = JOIN(%a, %b)\n%d = COUNT(%c)\nreturn %d',
    "branch": '%a = SEARCH("q", domain="{domain}")\n%n = COUNT(%a)\n%c = COMPARE(%n, %n, op="==")\n%x = SORT(%a, key="{key}")  guard(%c == true)\n%y = DEDUP(%a)\n%z = SELECT(%c, %x, %y)\nreturn %z',
    "compute": '%a = LOAD("{domain}")\n%b = SUM(%a, key="{key}")\n%c = CALCULATE(%b, expr="v0 * {n}")\nreturn %c',
    "summary": '%a = FETCH("u")\n%b = SUMMARIZE(%a)\n%v = VERIFY(%b, check="length")\n%s = SEND(%b, channel="mail")  after(%v)\nreturn %s',
    "entities": '%a = FETCH("u")\n%b = EXTRACT_ENTITIES(%a)\n%c = DEDUP(%b)\nreturn %c',
}


def _pick(salt: str, seed: int, options: tuple) -> Column:
    place = F.pmod(F.xxhash64(F.lit(f"{salt}|{seed}"), "id"), F.lit(len(options))).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), place + 1)


def programs(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, archetype, text)."""
    rows = spark.range(n).select("id", _pick("a", seed, tuple(ARCHETYPES)).alias("archetype"), _pick("d", seed, DOMAINS).alias("domain"), _pick("k", seed, KEYS).alias("key"))
    number = F.pmod(F.xxhash64(F.lit(f"n|{seed}"), "id"), F.lit(97)).cast("string")
    text = F.element_at(F.create_map(*[F.lit(x) for kv in ARCHETYPES.items() for x in kv]), F.col("archetype"))
    for name, value in (("domain", F.col("domain")), ("key", F.col("key")), ("n", number)):
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return rows.select("id", "archetype", F.concat(F.lit("; program v0.1  module=synthetic\n"), text).alias("text"))


def samples(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Raw samples of four kinds: tool calls, SQL, code, RTL."""
    kind = _pick("s", seed, ("tool", "sql", "code", "rtl"))
    rows = spark.range(n).select("id", kind.alias("source"), _pick("d", seed, DOMAINS).alias("domain"), _pick("k", seed, KEYS).alias("key"))
    is_ = lambda s: F.col("source") == s
    call = F.struct(F.concat(F.lit("search_"), "domain").alias("tool"), F.to_json(F.struct("key")).alias("args"))
    return rows.select(
        F.concat_ws(":", "source", "id").alias("id"),
        "source",
        F.concat(F.lit("Find the best "), "domain", F.lit(" by "), "key").alias("input_text"),
        F.when(is_("tool"), F.array(call)).alias("trajectory"),
        F.when(is_("sql"), F.concat(F.lit("SELECT "), "key", F.lit(" FROM "), "domain")).alias("sql"),
        F.when(is_("code"), F.concat(F.lit("def best(rows):\n    return min(rows, key=lambda r: r['"), "key", F.lit("'])"))).alias("code"),
        F.when(is_("rtl"), F.concat(F.lit("module "), "domain", F.lit("(input clk);"))).alias("rtl"),
    )
