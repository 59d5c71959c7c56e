"""Grouped corpus statistics: coverage, distributions, ambiguity, tiers, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ordered (substring of the reason, class); anything else keeps its first 40 characters.
REASON_CLASSES = (
    ("parse", "parse"),
    ("type", "type"),
    ("undefined", "reference"),
    ("unsupported", "unsupported"),
    ("empty", "empty"),
)


def coverage(df: DataFrame, by: list[str], **flags: str) -> DataFrame:
    """Rows per group, and for every flag (a SQL condition) its count and percentage to two places."""
    n = F.count("*")
    columns = [n.cast("long").alias("n")]
    for name, condition in flags.items():
        hit = F.count_if(F.coalesce(F.expr(condition), F.lit(False)))
        columns += [hit.cast("long").alias(f"n_{name}"), F.round(hit * 100.0 / n, 2).alias(f"pct_{name}")]
    return df.groupBy(*by).agg(*columns)


def histogram(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), column).agg(F.count("*").cast("long").alias("n"))


def bucket_reason(reason: Column) -> Column:
    out = F
    for part, name in REASON_CLASSES:
        out = out.when(F.contains(F.lower(reason), F.lit(part)), F.lit(name))
    return out.otherwise(F.left(reason, F.lit(40)))


def ranked_value(df: DataFrame, column: str, rank: Column, by: list[str] | None = None) -> DataFrame:
    """The value at a 1-based exact rank (an expression over ``n``, the group's non-null count)."""
    by = by or []
    sizes = df.groupBy(*by).agg(F.count(column).alias("n"))
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("c"))
    # running sums run over distinct values, not rows
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("upto", upto)
    joined = placed.join(sizes, by) if by else placed.join(F.broadcast(sizes))
    wanted = F.greatest(F.lit(1), F.least(F.col("n"), rank))
    return joined.where(F.col("upto") >= wanted).groupBy(*by).agg(F.min(column).alias("value"))


def nearest_rank(q: float) -> Column:
    """round-half-even(q * (n - 1)) + 1."""
    return F.bround(F.lit(q) * (F.col("n") - 1), 0).cast("long") + 1


def floor_rank(q: float) -> Column:
    """floor(q * n) + 1, at most n."""
    return F.floor(F.lit(q) * F.col("n")).cast("long") + 1


def distribution(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """count, mean (two places), exact median, nearest-rank p90, min and max."""
    base = df.groupBy(*by).agg(
        F.count(column).cast("long").alias("n"),
        F.round(F.avg(column), 2).alias("mean"),
        F.median(column).alias("median"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    return base.join(ranked_value(df, column, nearest_rank(0.9), by).withColumnRenamed("value", "p90"), by)


def estimated_tokens(chars: Column) -> Column:
    """floor(characters / 3.5) + 1."""
    return (F.floor(chars / F.lit(3.5)) + 1).cast("long")


def token_length_audit(df: DataFrame, chars: str, limits: tuple[int, ...] = (1024, 1536, 2048)) -> DataFrame:
    """One row: percentiles of estimated tokens by exact rank, and the share over each limit."""
    counted = df.select(estimated_tokens(F.col(chars)).alias("tokens"))
    out = counted.agg(
        F.count("*").cast("long").alias("n"),
        F.max("tokens").alias("max_tokens"),
        *[F.round(F.avg((F.col("tokens") > x).cast("int")), 4).alias(f"over_{x}") for x in limits],
    )
    for q in (50, 90, 95, 99):
        out = out.join(F.broadcast(ranked_value(counted, "tokens", nearest_rank(q / 100)).withColumnRenamed("value", f"p{q}")))
    return out


def ambiguity(df: DataFrame, key: Column, outcome: str, context: str) -> DataFrame:
    """Keys with more than one outcome: how many rows, outcomes and contexts, and whether contexts differ."""
    grouped = df.groupBy(key.alias("key")).agg(
        F.count("*").cast("long").alias("n"),
        F.count_distinct(outcome).cast("long").alias("n_outcomes"),
        F.count_distinct(context).cast("long").alias("n_contexts"),
    )
    return grouped.where("n_outcomes > 1").withColumn("context_differs", F.col("n_contexts") > 1)


def quality_tier(kinds: Column, synthetic: Column) -> Column:
    """C with any fallback or a synthetic origin, B with any heuristic, else A."""
    return (
        F.when(F.array_contains(kinds, "fallback") | synthetic, "C").when(F.array_contains(kinds, "heuristic"), "B").otherwise("A")
    )


def provenance_mix(df: DataFrame, id_col: str, kind: str) -> DataFrame:
    """Share of each mapping kind over rows, and of samples with no, some or only fallbacks."""
    per = df.groupBy(id_col).agg(
        F.bool_or(F.col(kind) == "fallback").alias("any_fallback"), F.bool_and(F.col(kind) == "fallback").alias("all_fallback")
    )
    kinds = histogram(df, kind).select(F.concat(F.lit("kind:"), kind).alias("measure"), "n")
    level = F.when(F.col("all_fallback"), "all").when(F.col("any_fallback"), "some").otherwise("none")
    samples = per.groupBy(F.concat(F.lit("fallback:"), level).alias("measure")).agg(F.count("*").cast("long").alias("n"))
    return kinds.unionByName(samples)


def trace_totals(events: DataFrame) -> DataFrame:
    """Per program: sums over events that ran and were not superseded, the largest memory, counts by status."""
    ran = (F.col("status") != "skipped") & ~F.col("superseded")
    of = lambda c: F.coalesce(F.sum(F.when(ran, F.col(c))), F.lit(0))
    return events.groupBy("program_id").agg(
        of("latency_ms").alias("latency_ms"),
        of("tokens_in").alias("tokens_in"),
        of("tokens_out").alias("tokens_out"),
        of("energy_j").alias("energy_j"),
        F.max(F.when(ran, F.col("memory_mb"))).alias("peak_memory_mb"),
        F.count_if(F.col("status") == "skipped").cast("long").alias("n_skipped"),
        F.count_if(F.col("attempt") > 1).cast("long").alias("n_retries"),
    )


def benchmark_summary(totals: DataFrame, latency_baseline: float, energy_baseline: float) -> DataFrame:
    """Means over programs and their ratios, in percent, to a baseline."""
    return totals.agg(
        F.count("*").cast("long").alias("n"),
        F.round(F.avg("latency_ms"), 3).alias("mean_latency_ms"),
        F.round(F.avg("energy_j"), 3).alias("mean_energy_j"),
        F.round(F.avg("latency_ms") * 100 / latency_baseline, 3).alias("pct_latency"),
        F.round(F.avg("energy_j") * 100 / energy_baseline, 3).alias("pct_energy"),
    )


def weighted_rollup(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.sum(weight).cast("long").alias("weight"), F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 4).alias("mean")
    )


def seen_unseen(df: DataFrame, is_seen: str, value: str, weight: str) -> DataFrame:
    """Weighted means of seen rows, and of the rest as total less seen."""
    seen = F.coalesce(F.expr(is_seen), F.lit(False))
    w, v = F.col(weight), F.col(value) * F.col(weight)
    total_w, total_v = F.sum(w), F.sum(v)
    seen_w, seen_v = F.sum(F.when(seen, w).otherwise(0)), F.sum(F.when(seen, v).otherwise(0))
    return df.agg(
        F.round(try_ratio(seen_v, seen_w), 4).alias("seen"), F.round(try_ratio(total_v - seen_v, total_w - seen_w), 4).alias("unseen")
    )


def try_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def prioritized(df: DataFrame, by: list[str], priority: Column, tiebreak: list[str]) -> DataFrame:
    """The row of least priority (null: never chosen) of each group, first by ``tiebreak``."""
    rest = [c for c in df.columns if c not in by]
    ranked = df.withColumn("_p", priority).where("_p IS NOT NULL")
    best = ranked.groupBy(*by).agg(F.min_by(F.struct(*rest, "_p"), F.struct("_p", *tiebreak)).alias("_row"))
    return best.select(*by, *[F.col(f"_row.{c}").alias(c) for c in rest], F.col("_row._p").alias("priority"))


def manifest(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows and an order-free sha256 fingerprint of each group: of the sum and xor of 60 bits of each row's md5. A row counts
    as its values' texts, each with its length before it, null or not."""
    text = lambda c: F.col(c).cast("string")
    parts = [F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("null")) for c in df.columns]
    told = df.select(*by, F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long").alias("_h"))
    return told.groupBy(*by).agg(
        F.count("*").cast("long").alias("n"),
        F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(F.col("_h").cast("decimal(38,0)")).cast("string"), F.bit_xor("_h").cast("string")), 256).alias("sha256"),
    )
