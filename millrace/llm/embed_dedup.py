"""Embedding near-duplicates by random median splits.

A pass cuts the vectors by random projections, each at the median of the vectors that it cuts, until at most
``WINDOW`` stay together; these are all compared. Cuts at local medians halve a cone as they halve isotropic
data. A cut that passes a vector at margin m parts it from a partner at the threshold with a known
probability (the partner's projection differs by a normal law), so every vector knows how surely its
passes would have met a partner. Vectors below the recall asked for get further passes, against all vectors,
until few are left; these are compared with all. Verified links are united across passes. Links are
counted afterwards by comparing all vectors within each component, in tiles: exact however large a group is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, grouped, join_sets, read_table
from .topk import usable

COSINE = 0.95
WINDOW = 2048
RECALL = 0.995
#: Rows of a matrix product.
BLOCK = 512
#: Vectors of a component that one task holds of a side; a component of m is read ceil(m / TILE) times.
TILE = 8192
#: Passes shuffled at a time; their files go before the next ones.
AT_ONCE = 2
SEED = 17
#: Vectors that one task cuts further; cuts above follow from a sample of so many values.
LEAF = 8192
SAMPLE_VALUES = 1 << 21
#: So many values of vectors that still lack recall are compared with all vectors.
REST_VALUES = 1 << 18
MOST_PASSES = 16


def passes_needed(n: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes of the first round, as isotropic data need them: log2(n / window) cuts, each of which a pair at the
    threshold survives with probability 1 - angle / pi. Later rounds follow from the margins measured."""
    bits = max(1.0, math.log2(max(2, n) / window) + 1)
    both = (1 - math.acos(cosine) / math.pi) ** bits
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - both))) if both < 1 else 2


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (length, cid, copies, x as a list) -> the same with x as its numbers' bytes, which rows carry cheaply."""
    for batch in batches:
        lists = batch.column(3)
        flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False))
        offsets = np.concatenate([[0], np.cumsum(batch.column(0).to_numpy().astype(np.int64))]) * flat.itemsize
        x = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], x.cast(pa.binary())], ["length", "cid", "copies", "x"])


def _matrix(column: pa.ChunkedArray, rows: int, d: int) -> np.ndarray:
    raw = b"".join(v.as_buffer() for v in column)
    return np.frombuffer(raw, f"f{len(raw) // (rows * d)}").astype(np.float64).reshape(rows, d)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _plane(number: int, d: int, level: int) -> np.ndarray:
    return np.random.default_rng([SEED, number, d, level]).standard_normal(d)


def _together(margin: np.ndarray, cosine: float) -> np.ndarray:
    """Probability that a partner at the threshold lies on the same side of a cut (normal law; Abramowitz and
    Stegun 7.1.26)."""
    z = np.abs(margin) / math.sqrt(4 * (1 - cosine))  # the difference has variance 2 (1 - cosine)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 1 - poly * np.exp(-z * z) / 2


def _tree(sample: np.ndarray, n: int, number: int) -> dict[int, float]:
    """Node (the root is 1, the children of i are 2i and 2i + 1) -> where it is cut, down to about LEAF of n vectors."""
    cuts: dict[int, float] = {}
    todo = [(1, sample)]
    while todo:
        node, own = todo.pop()
        if len(own) < 32 or len(own) * n <= LEAF * len(sample):
            continue
        at = own @ _plane(number, sample.shape[1], node.bit_length() - 1)
        high = at > np.median(at)
        if high.any():
            cuts[node] = float(np.median(at))
            todo += [(2 * node, own[~high]), (2 * node + 1, own[high])]
    return cuts


def _route(numbers: list[int], trees: dict[tuple[int, int], dict[int, float]], cosine: float):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (length, cid, x, open) -> each once a pass, with its leaf and its chance to be there with a partner."""
        for batch in batches:
            lengths = batch.column(0).to_numpy()
            for d in np.unique(lengths).tolist():
                own = pa.Table.from_batches([batch.filter(pa.array(lengths == d))])
                x = _unit(_matrix(own.column("x"), own.num_rows, d))
                for number in numbers:
                    cuts = trees.get((number, d), {})
                    leaf, alive = np.ones(len(x), np.int64), np.ones(len(x))
                    todo = [(1, np.arange(len(x)))]
                    while todo:
                        node, rows = todo.pop()
                        leaf[rows] = node
                        if node in cuts and len(rows):
                            margin = x[rows] @ _plane(number, d, node.bit_length() - 1) - cuts[node]
                            alive[rows] *= _together(margin, cosine)
                            todo += [(2 * node, rows[margin <= 0]), (2 * node + 1, rows[margin > 0])]
                    yield from pa.table(
                        {
                            "pass": pa.array(np.full(len(x), number, np.int32)),
                            "length": own.column("length"),
                            "leaf": pa.array(leaf),
                            "cid": own.column("cid"),
                            "x": own.column("x"),
                            "open": own.column("open"),
                            "alive": pa.array(alive),
                        }
                    ).to_batches()

    return route


def _unite(x: np.ndarray, rows: np.ndarray, cosine: float) -> np.ndarray:
    """A label for each of ``x``, equal where links of ``rows`` join them."""
    labels = np.arange(len(x))
    for i in range(0, len(rows), BLOCK):
        own = rows[i : i + BLOCK]
        r, c = np.nonzero(x[own] @ x.T >= cosine)
        join_sets(labels, own[r], c)
    return labels


def _cell_links(window: int, cosine: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (pass, length, leaf, cid, x, open, alive), sorted -> (src, dst, miss): what the pass joins, and the
        logarithm of the chance that it misses a partner of src (null where src was not open)."""
        for group in grouped(batches, 3):
            n = group.num_rows
            d = int(group.column("length")[0].as_py())
            x, cid = _unit(_matrix(group.column("x"), n, d)), group.column("cid").to_numpy()
            open_ = group.column("open").to_numpy(zero_copy_only=False).astype(bool)
            alive = group.column("alive").to_numpy().copy()
            number, node = (int(group.column(k)[0].as_py()) for k in ("pass", "leaf"))
            labels = np.arange(n)
            todo = [(node.bit_length() - 1, np.arange(n))]
            while todo:
                level, rows = todo.pop()
                if not open_[rows].any():
                    continue
                if len(rows) <= window:
                    labels[rows] = rows[_unite(x[rows], np.flatnonzero(open_[rows]), cosine)]
                    continue
                at = x[rows] @ _plane(number, d, level)
                order, half = np.argsort(at, kind="stable"), len(rows) // 2
                cut = (at[order[half - 1]] + at[order[half]]) / 2
                alive[rows] *= _together(at - cut, cosine)
                todo += [(level + 1, np.sort(rows[order[:half]])), (level + 1, np.sort(rows[order[half:]]))]
            told = np.flatnonzero(open_ | (labels != np.arange(n)))
            if len(told):
                miss = np.log(np.maximum(1 - alive[told], 1e-9))
                columns = [pa.array(cid[told]), pa.array(cid[labels[told]]), pa.array(miss, mask=~open_[told])]
                yield pa.RecordBatch.from_arrays(columns, ["src", "dst", "miss"])

    return find


def _rest_links(rest: dict[int, tuple[np.ndarray, np.ndarray]], cosine: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (length, cid, x) -> (src, dst): links with the vectors of ``rest``, which are compared with all."""
        for batch in batches:
            lengths = batch.column(0).to_numpy()
            for d in set(np.unique(lengths).tolist()) & set(rest):
                own = pa.Table.from_batches([batch.filter(pa.array(lengths == d))])
                ids, y = rest[d]
                x = np.concatenate([y, _unit(_matrix(own.column("x"), own.num_rows, d))])
                cid = np.concatenate([ids, own.column("cid").to_numpy()])
                labels = _unite(x, np.arange(len(y)), cosine)
                moved = np.flatnonzero(labels != np.arange(len(x)))
                yield pa.RecordBatch.from_arrays([pa.array(cid[moved]), pa.array(cid[labels[moved]])], ["src", "dst"])

    return find


def _by_length(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> ids and unit vectors, on the driver: of the sample, or of the few that are left."""
    told = rows.select("length", "cid", "x").toArrow()
    lengths, found = told.column("length").to_numpy(), {}
    for d in np.unique(lengths).tolist():
        own = told.filter(pa.array(lengths == d))
        found[d] = own.column("cid").to_numpy(), _unit(_matrix(own.column("x"), own.num_rows, d))
    return found


def _links(classes: DataFrame, scratch: Scratch, cosine: float, window: int, recall: float) -> DataFrame:
    """(src, dst) over ``classes`` (length, cid, x)."""
    counts = {r.length: r["count"] for r in classes.groupBy("length").count().collect()}
    if not counts:
        return classes.select(F.col("cid").alias("src"), F.col("cid").alias("dst"))
    most = max(counts)
    sample = {}
    if max(counts.values()) > LEAF:
        sample = _by_length(classes.orderBy(F.xxhash64("cid", F.lit(SEED)), "cid").limit(max(1024, SAMPLE_VALUES // most)))
    keys = ["pass", "length", "leaf"]
    marked = classes.withColumn("open", F.lit(True))
    done, take, found = 0, passes_needed(max(counts.values()), cosine, window, recall), []
    while True:
        for first in range(done, done + take, AT_ONCE):
            numbers = list(range(first, min(first + AT_ONCE, done + take)))
            trees = {(p, d): _tree(x, counts[d], p) for p in numbers for d, (_, x) in sample.items()}
            routed = marked.mapInArrow(
                _route(numbers, trees, cosine), "pass int, length int, leaf long, cid long, x binary, open boolean, alive double"
            )
            cells = routed.repartition(*keys).sortWithinPartitions(*keys, "cid")
            found.append(scratch.save(cells.mapInArrow(_cell_links(window, cosine), "src long, dst long, miss double")))
        done += take
        told = found[0]
        for more in found[1:]:
            told = told.unionAll(more)
        missed = told.where("miss IS NOT NULL").groupBy(F.col("src").alias("cid")).agg(F.sum("miss").alias("miss"))
        wanted = math.log(1 - recall)
        lack = missed.where(F.col("miss") > wanted)
        left, further = lack.agg(F.count("*"), F.percentile_approx((wanted / F.col("miss") - 1) * done, 0.9)).first()
        links = told.select("src", "dst").where("src <> dst").distinct()
        if not left:
            return links
        marked = classes.join(lack.select("cid", F.lit(True).alias("open")), "cid", "left")
        marked = marked.select("length", "cid", "x", F.coalesce("open", F.lit(False)).alias("open"))
        if left * most <= max(REST_VALUES, most):
            rest = _by_length(marked.where("open"))
            return links.unionAll(classes.mapInArrow(_rest_links(rest, cosine), "src long, dst long")).distinct()
        take = min(MOST_PASSES, max(2, math.ceil(further)))


def _count_links(cosine: float):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (component, i, j, part, cid, copies, length, x), sorted: how many vectors each one links with in its tile."""
        for group in grouped(batches, 3):
            n = group.num_rows
            x, cid = _unit(_matrix(group.column("x"), n, int(group.column("length")[0].as_py()))), group.column("cid").to_numpy()
            copies, part = group.column("copies").to_numpy(), group.column("part").to_numpy()
            crossed = group.column("i")[0] != group.column("j")[0]
            links = np.zeros(n, np.int64)
            for a in range(0, n, BLOCK):
                near = x[a : a + BLOCK] @ x.T >= cosine
                near[np.arange(len(near)), a + np.arange(len(near))] = False
                if crossed:
                    near &= part[a : a + BLOCK, None] != part[None, :]
                links[a : a + BLOCK] = near @ copies
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(links)], ["cid", "links"])

    return count


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    window: int = WINDOW,
    recall: float = RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id), one for each row of ``df``. Equal vectors are one class and are compared
    once. Null, empty and zero vectors and vectors with null or non-finite components link with nothing; vectors
    link with those of their own length only. Ids may repeat or be null: every row counts as a vector of its own;
    component_id is the smallest id there is in a component, null if none has one."""
    scratch = Scratch(df.sparkSession, "embed")
    some = F.exists(F.col(vector_col), lambda x: x != 0)
    vector = F.col(vector_col)
    if df.schema[vector_col].dataType.elementType.typeName() not in ("float", "double"):
        vector = vector.cast("array<double>")
    # 128 bits that name a vector; null where it links with nothing
    name = [F.when(usable(F.col(vector_col)) & some, F.xxhash64(F.lit(n), vector)).alias(f"v{n}") for n in (1, 2)]
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("x"), *name)
    named = rows.where("v1 IS NOT NULL").groupBy("v1", "v2").agg(F.first("x").alias("x"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    listed = scratch.save(named.withColumn("cid", F.monotonically_increasing_id()))
    packed = listed.select(F.size("x").alias("length"), "cid", "copies", "x").mapInArrow(_packed, "length int, cid long, copies long, x binary")
    classes = scratch.save(packed)
    links = scratch.save(_links(classes.drop("copies"), scratch, cosine, window, recall))

    member = scratch.save(components(links, scratch))
    parts = member.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("long").alias("parts"))
    dealt = (
        member.join(parts, "component")
        .join(classes, F.col("node") == F.col("cid"))
        .withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")))
    )
    every = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda t: F.struct(F.least(t, "part").alias("i"), F.greatest(t, "part").alias("j")),
    )
    vectors = ["part", "cid", "copies", "length", "x"]
    tiles = dealt.select("component", F.explode(every).alias("t"), *vectors).select("component", "t.i", "t.j", *vectors)
    counted = (
        tiles.repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j", "cid")
        .mapInArrow(_count_links(cosine), "cid long, links long")
        .groupBy("cid")
        .agg(F.sum("links").alias("links"))
    )
    known = scratch.save(
        listed.drop("x")
        .join(counted, "cid", "left")
        .join(member.withColumnRenamed("node", "cid"), "cid", "left")
        .select("v1", "v2", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    )
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    told = known.join(least, "component").select("v1", "v2", "n_links", "component_id", F.lit(True).alias("told"))
    return rows.drop("x").join(told, ["v1", "v2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("told"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
