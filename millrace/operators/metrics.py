"""Similarity metrics and exact statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _prf(hit: Column, found: Column, wanted: Column) -> list[Column]:
    p, r = _ratio(hit, found), _ratio(hit, wanted)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(_ratio(2 * p * r, p + r), 6).alias("f1")]


def confusion(df: DataFrame, target: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(target).alias("target"), F.col(predicted).alias("predicted")).agg(F.count("*").cast("long").alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) from a confusion matrix."""
    hit = matrix.where("target = predicted").select(F.col("target").alias("label"), F.col("n").alias("hit"))
    wanted = matrix.groupBy(F.col("target").alias("label")).agg(F.sum("n").alias("wanted"))
    found = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("found"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = wanted.join(found, "label", "full_outer").join(hit, "label", "left")
    return joined.select("label", z("wanted").cast("long").alias("support"), *_prf(z("hit"), z("found"), z("wanted")))


def macro_micro(matrix: DataFrame) -> DataFrame:
    macro = class_scores(matrix).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    micro = matrix.agg(F.round(F.sum(F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("micro_f1"))
    return macro.join(F.broadcast(micro))  # one row each


def multiset_prf(gold: DataFrame, found: DataFrame, by: str, item: str) -> DataFrame:
    """Per key: precision, recall and F1 of multiset overlap."""
    a = gold.groupBy(by, item).agg(F.count("*").alias("g"))
    b = found.groupBy(by, item).agg(F.count("*").alias("f"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = a.join(b, [by, item], "full_outer").select(by, z("g").alias("g"), z("f").alias("f"))
    sums = both.groupBy(by).agg(F.sum(F.least("g", "f")).alias("hit"), F.sum("f").alias("nf"), F.sum("g").alias("ng"))
    return sums.select(by, *_prf(F.col("hit"), F.col("nf"), F.col("ng")))


def multiset_difference(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (with repeats) that one side has beyond the other, with ``side`` missing or extra."""
    return gold.exceptAll(found).withColumn("side", F.lit("missing")).unionByName(found.exceptAll(gold).withColumn("side", F.lit("extra")))


def set_prf(gold: Column, found: Column) -> list[Column]:
    return _prf(F.size(F.array_intersect(gold, found)), F.size(F.array_distinct(found)), F.size(F.array_distinct(gold)))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two judgments per row: n, agreement, chance agreement, kappa, and whether it is 0.8
    or more. Null judgments leave the row out; full chance agreement gives 1."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    cells = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    n = F.sum("n").over(Window.partitionBy())
    rows = cells.withColumn("total", n)
    marginal = (
        rows.select("a", "n", "total", F.lit(0).alias("side"))
        .unionByName(rows.select(F.col("b").alias("a"), "n", "total", F.lit(1).alias("side")))
        .groupBy(F.col("a").alias("label"))
        .agg(
            (F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)) / F.max("total")).alias("pa"),
            (F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)) / F.max("total")).alias("pb"),
        )
    )
    chance = marginal.agg(F.sum(F.col("pa") * F.col("pb")).alias("pe"))
    seen = cells.agg(
        F.sum("n").cast("long").alias("n"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("po")
    )
    value = F.when(F.col("pe") == 1, F.lit(1.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    out = seen.join(F.broadcast(chance)).withColumn("kappa", value)  # one row each
    return out.select("n", F.round("po", 6).alias("agreement"), F.round("pe", 6).alias("chance"), F.round("kappa", 6).alias("kappa"), (F.col("kappa") >= 0.8).alias("passes"))


def agreement_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two boolean judges: agreements, both, only one."""
    x, y = F.col(a), F.col(b)
    return df.agg(
        F.count_if(x == y).cast("long").alias("agree"),
        F.count_if(x & y).cast("long").alias("both"),
        F.count_if(x & ~y).cast("long").alias("only_a"),
        F.count_if(~x & y).cast("long").alias("only_b"),
    )


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: a fold over one, whose state is a row of the
    dynamic program over the other."""
    zero = F.transform(F.concat(F.array(F.lit(None).cast("string")), b), lambda _: F.lit(0))

    def row(previous: Column, x: Column) -> Column:
        cells = F.arrays_zip(b.alias("y"), F.slice(previous, 1, F.size(b)).alias("diagonal"), F.slice(previous, 2, F.size(b)).alias("above"))
        return F.aggregate(
            cells,
            F.array(F.lit(0)),
            lambda acc, c: F.array_append(
                acc, F.when(c["y"] == x, c["diagonal"] + 1).otherwise(F.greatest(c["above"], F.element_at(acc, -1)))
            ),
        )

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(F.aggregate(a, zero, row), -1))


def ordered_prf(gold: Column, found: Column) -> list[Column]:
    return _prf(lcs_length(gold, found), F.size(found), F.size(gold))


def edit_similarity(nodes: Column, node_edits: Column, edges: Column, edge_edits: Column) -> Column:
    """1 - edits / sizes; negative when there are more edits than parts."""
    return F.when(nodes + edges == 0, 1.0).otherwise(1 - (node_edits + edge_edits) / (nodes + edges))


def positional(gold: DataFrame, found: DataFrame, by: str, pos: str, columns: list[str]) -> DataFrame:
    """Per key: positions equal in all columns, wrong, missing and extra, and whether all are equal."""
    g = gold.select(by, pos, F.struct(*columns).alias("g"))
    f = found.select(by, pos, F.struct(*columns).alias("f"))
    both = g.join(f, [by, pos], "full_outer")
    one = lambda c: F.count_if(c).cast("long")
    out = both.groupBy(by).agg(
        one(F.col("g").isNotNull() & F.col("g").eqNullSafe(F.col("f"))).alias("n_equal"),
        one(F.col("g").isNotNull() & F.col("f").isNotNull() & ~F.col("g").eqNullSafe(F.col("f"))).alias("n_wrong"),
        one(F.col("f").isNull()).alias("n_missing"),
        one(F.col("g").isNull()).alias("n_extra"),
    )
    return out.withColumn("strict", F.col("n_wrong") + F.col("n_missing") + F.col("n_extra") == 0)


def in_order_matches(gold: DataFrame, found: DataFrame, key: list[str], order: str) -> DataFrame:
    """Pairs the n-th occurrence of a key on one side with the n-th on the other."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    a, b = gold.withColumn("_n", rank), found.select(*key, F.col(order).alias("matched"), rank.alias("_n"))
    return a.join(b, [*key, "_n"], "left").drop("_n")


def assignment(weight: list[list[int]]) -> list[int]:
    """Column of each row in a one-to-one matching of the largest total weight (whole numbers, rows no more than
    columns): shortest augmenting paths over reduced costs. Exact at every size, in rows * rows * columns steps."""
    n, m = len(weight), len(weight[0]) if weight else 0
    row_price, column_price, row_of = [0] * n, [0] * m, [-1] * m
    for i in range(n):
        slack, via, done = [None] * m, [-1] * m, [False] * m
        row, column = i, -1
        while True:
            least, best = None, -1
            for j in range(m):
                if done[j]:
                    continue
                cost = row_price[row] + column_price[j] - weight[row][j]
                if slack[j] is None or cost < slack[j]:
                    slack[j], via[j] = cost, column
                if least is None or slack[j] < least:
                    least, best = slack[j], j
            row_price[i] -= least
            for j in range(m):
                if done[j]:
                    row_price[row_of[j]] -= least
                    column_price[j] += least
                elif slack[j] is not None:
                    slack[j] -= least
            done[best], column, row = True, best, row_of[best]
            if row < 0:
                break
        while column >= 0:  # turn the path around
            before = via[column]
            row_of[column] = i if before < 0 else row_of[before]
            column = before
    chosen = [-1] * n
    for j, row in enumerate(row_of):
        if row >= 0:
            chosen[row] = j
    return chosen


def best_matches(pairs: DataFrame, group: str) -> DataFrame:
    """pairs (group, gold, found, score): the one-to-one matching of each group with the largest total score, and of
    these one with the most pairs. Groups are sets of equal calls; scores count to 12 binary digits after the
    millionth, negative ones never help, and rows that repeat a pair count with their best score."""

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        score: dict[tuple, float] = {}
        for g, f, s in zip(frame["gold"], frame["found"], frame["score"], strict=True):
            if s >= 0:
                score[g, f] = max(s, score.get((g, f), s))
        sides = sorted({g for g, _ in score}), sorted({f for _, f in score})
        few = int(len(sides[0]) > len(sides[1]))  # rows are the smaller side
        rows, columns = sides[few], sides[1 - few]
        key = (lambda r, c: (c, r)) if few else (lambda r, c: (r, c))
        unit = 1 << max(1, len(rows)).bit_length()  # one more pair never outweighs score
        weight = [[round(score[k] * (1 << 32)) * unit + 1 if (k := key(r, c)) in score else 0 for c in columns] for r in rows]
        chosen = [key(r, columns[j]) for r, j in zip(rows, assignment(weight), strict=True)]
        out = [(frame[group].iloc[0], *k, score[k]) for k in sorted(k for k in chosen if k in score)]
        return pd.DataFrame(out, columns=[group, "gold", "found", "score"])

    return pairs.groupBy(group).applyInPandas(match, f"{group} {pairs.schema[group].dataType.simpleString()}, gold long, found long, score double")


def beta_share(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function I_x(a, b), by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d, step = 1.0, 1.0, 0.0, 0
    while True:  # the steps grow with the square root of a + b
        step += 1
        m = step // 2
        if step % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + term * d) or 1e-300)
        c = (1 + term / c) or 1e-300
        value *= c * d
        if abs(c * d - 1) < 1e-14:
            return front / value


def clopper_pearson(df: DataFrame, hits: str, trials: str, confidence: float = 0.95) -> DataFrame:
    """Exact binomial intervals (low, high), by bisection on the binomial tail."""
    tail = (1 - confidence) / 2

    def solve(k: int, n: int, target: float) -> float:
        """p for which P(X >= k) is the target."""
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if beta_share(k, n - k + 1, mid) < target else (low, mid)
        return (low + high) / 2

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[int, int], tuple[float, float]] = {}
        for frame in batches:
            pairs = [(int(k), int(n)) for k, n in zip(frame[hits], frame[trials], strict=True)]
            for k, n in set(pairs) - set(known):
                known[k, n] = (0.0 if k == 0 else solve(k, n, tail), 1.0 if k == n else solve(k + 1, n, 1 - tail))
            yield frame.assign(low=[round(known[p][0], 6) for p in pairs], high=[round(known[p][1], 6) for p in pairs])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(bounds, f"{names}, low double, high double")


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided p of b against c discordant pairs: twice the smaller binomial tail, to 12 digits."""
    few, many = min(b, c), max(b, c)
    return min(1.0, float(f"{2 * beta_share(many, few + 1, 0.5):.12g}")) if b + c else 1.0


def mcnemar(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Per group: pairs won by only one of two boolean columns, and the exact p value."""
    counts = df.groupBy(*by).agg(
        F.count_if(F.col(a) & ~F.col(b)).cast("long").alias("only_a"), F.count_if(~F.col(a) & F.col(b)).cast("long").alias("only_b")
    )

    def p_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame.assign(p=[mcnemar_p(int(x), int(y)) for x, y in zip(frame["only_a"], frame["only_b"], strict=True)])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema)
    return counts.mapInPandas(p_values, f"{names}, p double")


def holm(df: DataFrame, p: str, tiebreak: list[str]) -> DataFrame:
    """Step-down adjusted p values: the running maximum of p * (number of hypotheses left), at most 1."""
    order = Window.orderBy(p, *tiebreak)
    m = F.count("*").over(Window.partitionBy())
    scaled = df.withColumn("_scaled", F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1)))
    running = F.max("_scaled").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return scaled.withColumn("p_holm", running).drop("_scaled")


def paired_outcomes(df: DataFrame, by: list[str], unit: list[str], arm: str, baseline: str, won: str) -> DataFrame:
    """Against the baseline arm, per group and other arm: wins, losses and ties over the same units."""
    base = df.where(F.col(arm) == baseline).select(*by, *unit, F.col(won).alias("_base"))
    rest = df.where(F.col(arm) != baseline).join(base, [*by, *unit])
    return rest.groupBy(*by, arm).agg(
        F.count_if(F.col(won) & ~F.col("_base")).cast("long").alias("wins"),
        F.count_if(~F.col(won) & F.col("_base")).cast("long").alias("losses"),
        F.count_if(F.col(won) == F.col("_base")).cast("long").alias("ties"),
    )


def key_overlap(a: DataFrame, b: DataFrame, by: str, pos: str, keys: str) -> DataFrame:
    """Mean Jaccard similarity of parameter keys over the positions that both sequences have."""
    from ..functions.text import jaccard

    both = a.join(b.select(by, pos, F.col(keys).alias("_other")), [by, pos])
    return both.groupBy(by).agg(F.round(F.avg(jaccard(F.col(keys), F.col("_other"))), 6).alias("similarity"))
