"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

A document's place is a 60-bit hash. Per source, words are summed by hash cell; the cell where the running
sum passes the budget is the boundary, and only that cell is cut finer, until single documents decide.
A document is then in the mix if its hash lies below its source's threshold: no sort of the documents.
What the boundary document left unfilled is a new, smaller budget for the documents behind it that are
small enough, so the thresholds of the rounds are nested, one behind the other. Rounds go on until nothing behind
a threshold fits: together they take what a walk through the documents by hash would take that passes over each
one too large for what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, read_table

HASH_BITS = 60
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(id_col: Column, text: Column, seed: int) -> Column:
    """60 bits of the md5 of seed, id and text; rows equal in both share a place."""
    joined = F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("long")


def measure(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        place(F.col(id_col), F.col(text_col), seed).alias("place"),
    )


def targets(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target): all sizes shared by weight; a target stops at ``max_repeat`` times its
    source's size and the excess goes to the others by weight. With caps taken in order of cap per weight,
    the level at which the first k are capped is (total - their caps) / (weights of the rest); the first
    level that does not exceed the next cap per weight is the answer. One row a source, however many
    documents."""
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1)
    ranked = sizes.select("source", "source_size", weight.cast("long").alias("weight"))
    capped = ranked.withColumn("cap", F.col("source_size") * max_repeat).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everywhere = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ) / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    found = capped.withColumn("level", level).withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.col("ratio")))
    chosen = F.min_by("level", "fits").over(everywhere)
    return found.withColumn("chosen", chosen).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("chosen") * F.col("weight")).alias("target")
    )


def plan_mix(
    measured: DataFrame,
    scratch: Scratch,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    cell_bits: int = 15,
) -> DataFrame:
    """One row a source: source_size, target, ``base`` whole repeats for every document and ``rules``, the
    hash ranges of the documents taken once more. ``measured`` should be a stored table: it is read once a
    level. Documents of one place that cross the threshold together are taken or left together. What a source
    misses of its budget is less than each document left out holds. A histogram has 2 ** cell_bits cells a source at
    most, and one row a document at most."""
    goal = targets(measured, weights, max_repeat)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goal.withColumn("base", base).withColumn(
        "left", F.floor(F.col("target") - F.col("base") * F.col("source_size")).cast("long")
    )
    state = state.withColumn("left", F.when(F.col("base") >= max_repeat, 0).otherwise(F.col("left")))
    state = state.withColumn("start", F.lit(0).cast("long")).withColumn(
        "rules", F.array().cast("array<struct<start:bigint,most:bigint,end:bigint>>")
    )
    top = 1 << HASH_BITS
    while True:
        # a round: find each source's threshold among documents from ``start`` on, no larger than ``left``
        state = scratch.save(state.withColumn("most", F.col("left")).withColumn("cell", F.lit(0).cast("long")).withColumn("open", (F.col("left") > 0) & (F.col("start") < top)))
        if state.where("open").isEmpty():
            break
        level = 0
        while level < HASH_BITS // cell_bits:
            above = HASH_BITS - level * cell_bits
            below = above - cell_bits
            level += 1
            of = state.where("open").select(F.col("source").alias("s"), "start", "most", "cell")
            rows = measured.where("size > 0").join(
                of,
                F.col("source").eqNullSafe(F.col("s"))
                & (F.shiftright("place", above) == F.col("cell"))
                & (F.col("place") >= F.col("start"))
                & (F.col("size") <= F.col("most")),
            )
            hist = rows.groupBy("s", F.shiftright("place", below).alias("sub")).agg(
                F.sum("size").alias("words"), F.count("*").alias("docs")
            )
            run = Window.partitionBy("s").orderBy("sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            sums = hist.withColumn("upto", F.sum("words").over(run))
            over = sums.join(state.where("open").select(F.col("source").alias("s2"), "left"), F.col("s").eqNullSafe(F.col("s2")))
            edge = (
                over.where("upto > left")
                .groupBy("s")
                .agg(F.min_by(F.struct("sub", (F.col("upto") - F.col("words")).alias("under"), "docs"), "sub").alias("edge"))
            )
            total = hist.groupBy(F.col("s").alias("s3")).agg(F.sum("words").alias("words"))
            joined = (
                state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
                .join(total, F.col("source").eqNullSafe(F.col("s3")), "left")
                .select(
                    *[c for c in state.columns if c not in ("left", "cell", "open", "rules", "start")],
                    F.when(~F.col("open"), F.col("left"))
                    .when(F.col("edge").isNull(), F.col("left") - F.coalesce("words", F.lit(0)))
                    .otherwise(F.col("left") - F.col("edge.under"))
                    .alias("left"),
                    F.coalesce(F.when(F.col("open"), F.col("edge.sub")), F.col("cell")).alias("cell"),
                    F.when(
                        F.col("open") & (F.col("edge").isNull() | (F.col("edge.docs") <= 1) | F.lit(below == 0)),
                        F.array_append(
                            "rules",
                            F.struct(
                                "start",
                                "most",
                                F.when(F.col("edge").isNull(), F.lit(top))
                                .otherwise(F.shiftleft(F.col("edge.sub"), below))
                                .cast("long")
                                .alias("end"),
                            ),
                        ),
                    )
                    .otherwise(F.col("rules"))
                    .alias("rules"),
                    F.when(F.col("open") & F.col("edge").isNull(), F.lit(top))
                    .when(
                        F.col("open") & ((F.col("edge.docs") <= 1) | F.lit(below == 0)),
                        F.shiftleft(F.col("edge.sub") + 1, below),
                    )
                    .otherwise(F.col("start"))
                    .cast("long")
                    .alias("start"),
                    (F.col("open") & F.col("edge").isNotNull() & (F.col("edge.docs") > 1) & F.lit(below > 0)).alias("open"),
                )
            )
            after = scratch.save(joined)
            scratch.drop(state)
            state = after
            if state.where("open").isEmpty():
                break
    return state.select("source", "source_size", "target", "base", "rules")


def apply_mix(measured: DataFrame, plan: DataFrame) -> DataFrame:
    """``measured`` rows (any further columns stay) with source_size, target and ``repeats`` (0 to the most)."""
    own = plan.withColumnRenamed("source", "_plan_source")
    extra = F.exists("rules", lambda r: (F.col("place") >= r["start"]) & (F.col("place") < r["end"]) & (F.col("size") <= r["most"]))
    joined = measured.join(own, F.col("source").eqNullSafe(F.col("_plan_source")), "left")
    return joined.withColumn("repeats", F.col("base") + F.when(extra, 1).otherwise(0)).drop("_plan_source", "base", "rules")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 11,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
) -> tuple[DataFrame, DataFrame]:
    """(measured documents with their repeats, the plan by source).

    Null sources are a source of their own, last in order; null and blank texts have size 0, so no word
    of them is taken; an empty table gives an empty mix. Rows equal in id and text are taken or left together. The
    words taken from a source stay at or below its target; what is missing is less than any document left out
    holds. Columns of any further names do not matter: only the three are read."""
    scratch = Scratch(docs.sparkSession, "mix")
    measured = scratch.save(measure(docs, id_col, source_col, text_col, seed))
    plan = plan_mix(measured, scratch, weights, max_repeat)
    return apply_mix(measured, plan), plan


def mixed_documents(docs: DataFrame, seed: int = 11) -> DataFrame:
    """``docs`` as the mix takes them: a row as often as it is repeated, left out at 0; the same columns. Rows of size 0
    come as often as all of their source does."""
    scratch = Scratch(docs.sparkSession, "mix")
    plan = plan_mix(scratch.save(measure(docs, "doc_id", "source", "text", seed)), scratch)
    packed = docs.select(
        F.struct("*").alias("record"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        place(F.col("doc_id"), F.col("text"), seed).alias("place"),
    )
    taken = apply_mix(packed, plan).where("repeats > 0")
    return taken.select("record", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("record.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


#: A walk through the documents of each source by place, taking what still fits; places are taken to be distinct.
OP9_SQL = """
WITH RECURSIVE m AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws('|', '11', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS weight FROM m GROUP BY source),
c AS (SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight::DOUBLE AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM c WINDOW w AS (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
r0 AS (SELECT m.*, b.source_size, b.target, b.base,
    CASE WHEN b.base >= 3 THEN 0 ELSE floor(b.target - b.base * b.source_size)::BIGINT END AS budget
  FROM m JOIN b ON m.source IS NOT DISTINCT FROM b.source),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) AS i FROM r0 WHERE size > 0),
w AS (SELECT source, 0::BIGINT AS i, max(budget) AS remaining, 0::BIGINT AS took FROM r0 GROUP BY source UNION ALL
  SELECT w.source, o.i, w.remaining - CASE WHEN o.size <= w.remaining THEN o.size ELSE 0 END, (o.size <= w.remaining)::BIGINT
  FROM w JOIN o ON o.source IS NOT DISTINCT FROM w.source AND o.i = w.i + 1)
SELECT doc_id, size, source_size, target, (size * (base + took))::BIGINT AS taken FROM o JOIN w ON o.source IS NOT DISTINCT FROM w.source AND o.i = w.i
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM r0 WHERE size = 0
"""
