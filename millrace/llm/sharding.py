"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records uniformly into buckets that fit in memory, by a seeded hash. Pass two
shuffles every bucket by Fisher-Yates (Spark's ``shuffle``) and lays the buckets end to end; the place in
that global order decides shard and slot, so shard sizes differ by one row at most (law ``rows``).

A bucket is scattered by a number whose hash is the bucket's own number, so that hash partitioning gives every
task one bucket and none gets several by chance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, row_digest

#: Offsets of so many buckets (16 bytes each) may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_BUCKETS = 50_000


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32, in steps that a signed 64-bit number holds."""
    low, high = x * F.lit(factor & 0xFFFF), F.shiftleft((x * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(0xFFFFFFFF))


def hashed_to(number: Column) -> Column:
    """The int whose hash, as ``F.hash`` and hash partitioning take it (32-bit MurmurHash3, seed 42), is ``number``:
    every step of the hash undone in turn."""
    inverse = lambda factor: pow(factor, -1, 1 << 32)
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    back = lambda x, by: low(F.shiftright(x, by).bitwiseOR(F.shiftleft(x, 32 - by)))
    steps = (
        lambda x: _times(x.bitwiseXOR(F.shiftright(x, 16)), inverse(0xC2B2AE35)),
        lambda x: _times(x.bitwiseXOR(F.shiftright(x, 13)).bitwiseXOR(F.shiftright(x, 26)), inverse(0x85EBCA6B)),
        lambda x: x.bitwiseXOR(F.shiftright(x, 16)).bitwiseXOR(F.lit(4)),  # 4 bytes were hashed
        lambda x: _times(low(x + F.lit((1 << 32) - 0xE6546B64)), inverse(5)),
        lambda x: _times(back(x, 13).bitwiseXOR(F.lit(42)), inverse(0x1B873593)),
        lambda x: _times(back(x, 15), inverse(0xCC9E2D51)),
        lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int"),
    )
    bound = F.array(low(number.cast("long")))  # each step is bound as the element of an array: it uses its number twice
    for step in steps:
        bound = F.transform(bound, step)
    return F.get(bound, F.lit(0))


def external_shuffle(
    df: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    bucket_bytes: int = 24 << 20,
    bucket_rows: int = 200_000,
) -> DataFrame:
    """Every record of ``df`` in a struct column ``record`` (so no name can clash, and any type of column may be
    there), with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in a shard).

    The bucket comes from a hash of id and text, so neither a null or repeated id nor a group of equal
    texts fills a bucket; only rows equal in both stay together. Rows that repeat as a whole are
    interchangeable. An empty table gives an empty table. Null texts count as empty; a text larger than a bucket is a
    bucket of that size. The order depends on seed, bucket count and the rows alone.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    total = df.agg(F.count("*").alias("n"), F.sum(text_size(F.col(text_col))).alias("bytes")).first()
    rows, n_bytes = total.n, total.bytes or 0
    n_buckets = max(1, math.ceil(n_bytes / bucket_bytes), math.ceil(rows / bucket_rows))
    bucket = F.pmod(key, F.lit(n_buckets)).cast("int")

    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    ends = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = counts.select(hashed_to(F.col("bucket")).alias("to"), (ends - F.col("n")).alias("start"))
    if n_buckets <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)

    scattered = df.select(hashed_to(bucket).alias("to"), key.alias("key"), row_digest(df).alias("tie"), F.struct("*").alias("record"))
    filled = (
        scattered.repartition(n_buckets, "to")
        .sortWithinPartitions("to", "key", "tie")  # a list keeps this order, so a task that runs again draws the same
        .groupBy("to")
        .agg(F.collect_list("record").alias("records"))
    )
    mixed = filled.select("to", F.shuffle("records", seed).alias("records")).join(starts, "to")
    placed = mixed.select("start", F.posexplode("records").alias("i", "record")).select(
        "record", (F.col("start") + F.col("i")).alias("place")
    )
    shard = F.expr(f"(place * {n_shards}L) div {max(rows, 1)}L")
    first = F.expr(f"(shard * {rows}L + {n_shards - 1}L) div {n_shards}L")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", (F.col("place") - first).cast("long"))
        .select("record", F.col("shard").cast("int").alias("shard"), "slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows of a file in slot order."""
    flat = sharded.select("record.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    flat.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.col("record.text")
    return external_shuffle(docs, n_shards=8).select(
        F.col("record.doc_id").alias("doc_id"),
        text_size(text).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
