"""Pieces that the training-data operators share, beside the engine's scratch tables and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..storage import Scratch

__all__ = ["Scratch", "components", "grouped", "join_sets", "read_table", "row_digest", "row_name"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_name(id_col: str, text_col: str) -> list[Column]:
    """r1 and r2: 128 bits that name a row by id and text, null or not; rows that agree in both repeat each other."""
    return [F.xxhash64(F.lit(n), F.col(id_col), F.col(text_col)).alias(f"r{n}") for n in (1, 2)]


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_digest(df: DataFrame) -> Column:
    """A hash of all columns, to order rows that agree in everything that matters; types without a hash count as JSON."""
    cols = [(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return F.xxhash64(F.lit(0), *[c if _hashable(kind) else F.to_json(F.struct(c)) for c, kind in cols])


def grouped(batches, n_keys: int):
    """Arrow batches sorted by their first ``n_keys`` columns -> one table per run of equal keys."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(k[a] for k in keys)
            if held and own != key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            key = own
    if held:
        yield pa.Table.from_batches(held)


def join_sets(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by smallest index: afterwards a[i] and b[i] have one label, in place."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        x, y = x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(labels, up := labels[labels]):
            labels[:] = up
