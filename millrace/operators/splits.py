"""Deterministic splits, samples and resampling, all driven by hashes of the row's id and a seed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def _before(df: DataFrame, by: list[str], order: Column, tiebreak: str, size: Column) -> DataFrame:
    """``df`` with ``_before``, the sizes of the group's rows that come earlier by (order, tiebreak), and ``_total``, those of
    all. ``order`` is a hash in hex digits: sums run over its 65,536 leading cells first, then inside each cell, so no
    task sees a whole group."""
    cell = F.substring(order, 1, 4)
    told = df.withColumn("_order", order).withColumn("_cell", cell).withColumn("_size", size)
    cells = told.groupBy(*by, "_cell").agg(F.sum("_size").alias("_n"))
    group = Window.partitionBy(*by)
    sums = cells.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        F.col("_cell").alias("_in"),
        (F.sum("_n").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_under"),
        F.sum("_n").over(group).alias("_total"),
    )
    same = F.col("_cell") == F.col("_in")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inner = Window.partitionBy(*by, "_cell").orderBy("_order", tiebreak).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = told.join(sums, same).withColumn("_before", F.col("_under") + F.sum("_size").over(inner) - F.col("_size"))
    return placed.drop("_order", "_cell", "_size", "_in", "_under", *[f"_by{i}" for i in range(len(by))])


def exact_split(df: DataFrame, id_col: str, ratio: float, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """``val`` for exactly max(1, floor(n * ratio)) rows (of each group), the first by hash, else ``train``."""
    placed = _before(df, by or [], hash_order(id_col, seed), id_col, F.lit(1))
    quota = F.greatest(F.lit(1), F.floor(F.col("_total") * ratio))
    return placed.withColumn("split", F.when(F.col("_before") < quota, "val").otherwise("train")).drop("_before", "_total")


def bucket_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """A split by the hash of ``key`` alone: whole families stay together, without any shuffle."""
    place = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, upto = F, 0.0
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name]
        out = out.when(place < upto, F.lit(name))
    return df.withColumn("split", out.otherwise(F.lit(names[-1])) if names[:-1] else F.lit(names[-1]))


def greedy_family_split(sizes: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(family, n) -> (family, n, split): families in hash order, each to the split with the largest relative
    deficit. The walk is sequential over family sizes (16 bytes each, not rows), so it runs in one task: it is meant for up
    to some 10^8 families, beyond which ``cumulative_family_split`` or ``bucket_split`` serve."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    caps = {s: total * x for s, x in shares.items()}

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fill = dict.fromkeys(caps, 0)
        for batch in batches:
            chosen = []
            for n in batch["n"]:
                best = max(caps, key=lambda s: (caps[s] - fill[s]) / max(caps[s], 1e-9))
                fill[best] += n
                chosen.append(best)
            yield batch[["family", "n"]].assign(split=chosen)

    ordered = sizes.orderBy(hash_order("family", seed), "family").coalesce(1)
    kind = sizes.schema["family"].dataType.simpleString()
    return ordered.select("family", "n").mapInPandas(walk, f"family {kind}, n long, split string")


def cumulative_family_split(sizes: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Families in hash order, cut where their running size passes the shares."""
    placed = _before(sizes, [], hash_order("family", seed), "family", F.col("n"))
    place = F.col("_before") / F.col("_total")
    out, upto, names = F, 0.0, list(shares)
    for name in names[:-1]:
        upto += shares[name]
        out = out.when(place < upto, F.lit(name))
    return placed.withColumn("split", out.otherwise(F.lit(names[-1]))).drop("_before", "_total")


def stratified_sample(df: DataFrame, id_col: str, strata: list[str], n: int, seed: int = 0) -> DataFrame:
    """round(n * stratum / total) rows of each stratum, then topped up or cut to n, all by hash order."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size"))
    quota = F.round(F.lit(n) * F.col("_size") / F.sum("_size").over(Window.partitionBy()), 0).cast("long")
    quotas = sizes.select(*strata, quota.alias("_quota"))
    order = hash_order(id_col, seed)
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(order, id_col))
    placed = df.join(quotas, strata).withColumn("_order", order).withColumn("_over", (rank > F.col("_quota")).cast("int"))
    return placed.orderBy("_over", "_order", id_col).limit(n).drop("_quota", "_order", "_over")


def _first_of(own: DataFrame, by: list[str], k: int, seed: int) -> DataFrame:
    """(by, negative, nl, nc, ng): for each ``by`` the rows that hold the first k by hash whatever one label is left
    out: k rows a label, of the k + 1 labels that come first. At most k (k + 1) rows."""
    order = [hash_order("id", seed), F.col("id")]
    row = F.row_number().over(Window.partitionBy(*by, "l").orderBy(*order))
    label = F.dense_rank().over(Window.partitionBy(*by).orderBy("_first", "l"))
    heads = own.withColumn("_r", row).where(F.col("_r") <= k)
    heads = heads.withColumn("_first", F.min(F.struct(hash_order("id", seed).alias("h"), "id")).over(Window.partitionBy(*by, "l")))
    few = heads.withColumn("_l", label).where(F.col("_l") <= k + 1)
    return few.select(*by, F.col("id").alias("negative"), F.col("l").alias("nl"), F.col("c").alias("nc"), F.col("g").alias("ng"))


def hard_negatives(df: DataFrame, id_col: str, group: str, label: str, cue: Column, k: int, seed: int = 0, anchors: str = "true") -> DataFrame:
    """(id, negative, rank): for each anchor k rows with another label, those of its group and cue first, then
    those of its group, then any others (the backfill), each by hash. Rows without a label take no part. The answer
    depends on an anchor's group, label and cue alone, so it is found once for each of these from short lists: the
    first k of the group and cue, and the first 2k of the group and of the table, as fewer than k of the
    better kinds can be among them."""
    own = df.select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.col(label).alias("l"), cue.alias("c")).where("l IS NOT NULL")
    kinds = own.where(anchors).select("g", "l", "c").distinct()
    near = kinds.join(_first_of(own.where("g IS NOT NULL AND c IS NOT NULL"), ["g", "c"], k, seed), ["g", "c"])
    same = kinds.join(_first_of(own.where("g IS NOT NULL"), ["g"], 2 * k, seed), ["g"])
    extra = kinds.join(F.broadcast(_first_of(own.withColumn("_all", F.lit(0)), ["_all"], 2 * k, seed).drop("_all")))  # at most 2k (2k + 1) rows
    columns = ["g", "l", "c", "negative", "nl", "nc", "ng"]
    pairs = near.select(*columns).unionAll(same.select(*columns)).unionAll(extra.select(*columns)).where("l <> nl").distinct()
    tier = F.when(F.col("g") == F.col("ng"), F.when(F.col("c") == F.col("nc"), 0).otherwise(1)).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("g", "l", "c").orderBy(tier, hash_order("negative", seed), "negative"))
    best = pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.struct("g", "l", "c").alias("kind"), "negative", "rank")
    asked = own.where(anchors).select("id", F.struct("g", "l", "c").alias("own_kind"))
    return asked.join(best, F.col("own_kind").eqNullSafe(F.col("kind"))).select("id", "negative", "rank")


def capped_pool(own: DataFrame, others: DataFrame, by: str, name: str, cap: int) -> DataFrame:
    """Each task's own names, then others in alphabetical order, up to ``cap``."""
    both = own.select(by, name, F.lit(0).alias("extra")).unionByName(others.select(by, name, F.lit(1).alias("extra")))
    best = both.groupBy(by, name).agg(F.min("extra").alias("extra"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("extra", name))
    return best.withColumn("rank", rank).where(F.col("rank") <= cap)


def _copies(unit: Column, seed: int) -> Column:
    """How often a unit is drawn in a replicate: a Poisson(1) law by hash of seed, replicate and unit."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("replicate"), unit.cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    # cumulative probabilities of 0, 1, 2 ... copies under Poisson(1)
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    return sum((u >= c).cast("int") for c in cuts)


def bootstrap(df: DataFrame, id_col: str, value: str, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, mean): resamples with replacement. Rows draw their multiplicity from a Poisson(1) law by
    hash, so a replicate is one aggregate and no row is looked up by position."""
    drawn = df.where(F.col(value).isNotNull()).select(id_col, value, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    weighted = drawn.withColumn("copies", _copies(F.col(id_col), seed))
    return weighted.groupBy("replicate").agg(F.round(F.sum(F.col("copies") * F.col(value)) / F.sum("copies"), 6).alias("mean"))


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, mean): whole clusters (tasks) are drawn, each with all its values. Clusters are summed first, so
    a replicate reads one row a cluster."""
    sums = df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    drawn = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn("copies", _copies(F.col(cluster), seed))
    return drawn.groupBy("replicate").agg(F.round(F.sum(F.col("copies") * F.col("total")) / F.sum(F.col("copies") * F.col("n")), 6).alias("mean"))


def paired_deltas(df: DataFrame, unit: str, arm: str, one: str, other: str, value: str) -> DataFrame:
    """(unit, delta): the mean value of arm ``one`` less that of arm ``other``, for the units that have both."""
    of = lambda a: F.avg(F.when(F.col(arm) == a, F.col(value)))
    return df.groupBy(unit).agg((of(one) - of(other)).alias("delta")).where("delta IS NOT NULL")


def interval(replicates: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row: the means at ranks floor(q * n) + 1."""
    from .corpus import floor_rank, ranked_value

    a = ranked_value(replicates, "mean", floor_rank(low)).withColumnRenamed("value", "low")
    b = ranked_value(replicates, "mean", floor_rank(high)).withColumnRenamed("value", "high")
    return a.join(F.broadcast(b))
