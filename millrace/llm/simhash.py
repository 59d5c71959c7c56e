"""SimHash near-duplicates: tiled exact comparison of fingerprints with numpy xor and bit counts.

Fingerprints are compared once per distinct value. Two fingerprints within ``RADIUS`` bits agree in at least
one of RADIUS + 1 bit blocks, so the comparison runs inside the groups that share a block; a group is cut
into tiles ordered by population count, and tile pairs whose counts differ beyond the radius are skipped.
Groups beyond ``GROUP_ROWS`` are dealt out as pairs of parts to many tasks. Only spanning links leave a
task, so a dense group costs as many links as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, grouped, join_sets, read_table, row_digest, row_name

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Small, so that the tiles of one block group span few population counts.
TILE = 256
GROUP_ROWS = 100_000
#: Shingles hashed at a time, which bounds the memory for a very long text.
CHUNK = 1 << 16
#: (first bit, bits) of the blocks: RADIUS + 1 of them, 64 bits in all.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a whole text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII spaces alone
    if not words:
        return 0
    shingles = len(words) - SHINGLE + 1
    if shingles < 2:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, shingles, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        hashes = np.array([digest(join(s), SEED) for s in zip(*(part[i:] for i in range(SHINGLE)))], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(ones * 2 > shingles, bitorder="little")
    return int(packed.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(3)), np.int64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], ["doc_id", "r1", "r2", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, r1, r2, fp) for every row; r1 and r2 name it."""
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_name(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    return told.mapInArrow(_fingerprints, "doc_id long, r1 long, r2 long, fp long")


def tile_pairs(counts: np.ndarray, tile: int, radius: int) -> Iterator[tuple[int, int]]:
    """First rows of the tiles to compare, given the rows' population counts in ascending order: a pair of tiles
    is skipped where the counts differ by more than the radius throughout."""
    for i in range(0, len(counts), tile):
        most = counts[min(i + tile, len(counts)) - 1] + radius
        for j in range(i, len(counts), tile):
            if counts[j] > most:
                break
            yield i, j


def linked(fps: np.ndarray, side: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fp, smallest fp of its set) among distinct fingerprints within the radius.
    With ``side`` only pairs from different sides are compared."""
    order = np.lexsort((fps, np.bitwise_count(fps.view(np.uint64))))
    x = fps[order].view(np.uint64)
    sides = None if side is None else side[order]
    counts = np.bitwise_count(x).astype(np.int64)
    labels = np.arange(len(x))
    for i, j in tile_pairs(counts, tile, radius):
        near = np.bitwise_count(x[i : i + tile, None] ^ x[None, j : j + tile]) <= radius
        if sides is not None:
            near &= sides[i : i + tile, None] != sides[None, j : j + tile]
        a, b = np.nonzero(near)
        later = a + i < b + j
        join_sets(labels, a[later] + i, b[later] + j)
    smallest = np.full(len(x), np.iinfo(np.int64).max)
    signed = x.view(np.int64)
    np.minimum.at(smallest, labels, signed)
    root = smallest[labels]
    moved = root != signed
    return signed[moved], root[moved]


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, part, fp) sorted by (key, i, j): the links of each group of equal (key, i, j)."""
    for group in grouped(batches, 3):
        if group.num_rows > 1:
            crossed = group.column("i")[0] != group.column("j")[0]
            src, dst = linked(group.column("fp").to_numpy(), group.column("part").to_numpy() if crossed else None)
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])


def near_links(distinct: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``distinct`` (fp) -> links (src, dst) whose components are those of all pairs within the radius."""
    keys = [
        (F.lit(n).cast("long") * F.lit(1 << 16)) + F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))
        for n, (at, bits) in enumerate(BLOCKS)
    ]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    # A key's rows are counted by a hash part of the rows first; keys number 5 * 2^13 at most.
    big = keyed.groupBy("key").count().where(F.col("count") > group_rows)
    parts = big.select("key", F.ceil(F.col("count") / group_rows).cast("int").alias("parts"))
    dealt = keyed.join(F.broadcast(parts), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("long"))
    every = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1),
        lambda t: F.struct(F.least(t, "part").alias("i"), F.greatest(t, "part").alias("j")),
    )
    tiles = dealt.select("key", F.explode(every).alias("t"), "part", "fp").select(
        "key", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "part", "fp"
    )
    # (fp is sorted too, so that a lost task gives the same links again)
    return (
        tiles.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "fp")
        .mapInArrow(_group_links, "src long, dst long")
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, r1, r2, fp, component, component_id) for every row: component_id is the smallest doc_id reachable by links of
    ``RADIUS`` differing bits or fewer. Null and wordless texts have fingerprint 0 and link like any other;
    repeated rows stay; a null doc_id keeps its row and is never a component's name unless all are null. An empty
    table gives an empty table; a very long text is hashed ``CHUNK`` shingles at a time."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, id_col, text_col))
    reps = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = scratch.save(near_links(reps.select("fp")))
    found = components(links, scratch)
    member = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    name = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = member.join(name, "component").select("fp", "component", "component_id")
    return rows.join(named, "fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the smallest id (null ids last; then by name);
    the same columns, whatever their names and types. Of rows equal in id and text one stays, the same one each time."""
    scratch = Scratch(docs.sparkSession, "simhash")
    found = scratch.save(near_duplicates(docs, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "r1", "r2")).alias("first")
    chosen = scratch.save(found.groupBy("component").agg(first).select("first.r1", "first.r2"))
    packed = docs.select(F.struct("*").alias("record"), *row_name(id_col, text_col), row_digest(docs).alias("tie"))
    kept = packed.join(chosen, ["r1", "r2"], "left_semi")
    if not found.groupBy("r1", "r2").count().where("count > 1").isEmpty():  # rows may repeat as a whole
        kept = kept.groupBy("r1", "r2").agg(F.min_by("record", "tie").alias("record"))
    return kept.select("record.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
