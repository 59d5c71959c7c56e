"""Queries over whole tables, against brute force in Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.operators import splits

from .compare import connect, plain


def negatives(rows, k):
    """{(id, negative, rank)} by brute force over (id, group, label, cue)."""
    key = lambda i: (hashlib.md5(f"0|{i}".encode()).hexdigest(), i)
    out = set()
    for i, g, label, c in rows:
        tier = lambda r: 2 if g is None or r[1] != g else int(c is None or r[3] != c)
        others = sorted((r for r in rows if None not in (label, r[2]) and r[2] != label), key=lambda r: (tier(r), key(r[0])))
        out |= {(i, r[0], n + 1) for n, r in enumerate(others[:k])}
    return out


def test_hard_negatives_of_every_document(spark, sf):
    rows = [(r.doc_id, r.source, r.lang, r.text.split(" ")[0].lower()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [(r.id, r.negative, r.rank) for r in catalog.QUERIES["hard_negatives"](spark, sf).collect()]
    assert len(got) == len(set(got)) == 3 * len(rows) and set(got) == negatives(rows, 3)


@pytest.mark.parametrize("labels", [2, 30])
def test_hard_negatives_fill_up_from_other_groups(spark, labels):
    rng = random.Random(labels)
    rows = [(i, rng.choice(["a", "a", "a", f"g{i % 40}", None]), rng.choice([f"l{rng.randrange(labels)}"] * 9 + [None]), rng.choice(["x", "y", f"c{i % 7}", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, l string, c string")
    got = [(r.id, r.negative, r.rank) for r in splits.hard_negatives(df, "id", "g", "l", F.col("c"), 3).collect()]
    assert len(got) == len(set(got)) and set(got) == negatives(rows, 3)


def test_truncated_keys_of_every_document(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = [(r.doc_id, r["head"]) for r in catalog.QUERIES["truncated_keys"](spark, sf).collect()]
    assert sorted(got) == sorted((r.doc_id, (r.lang + r.source)[:3]) for r in rows)


def test_make_list_path_of_every_order(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").collect()
    got = [(r.o_custkey, r.pair, r.first_key) for r in catalog.QUERIES["make_list_path"](spark, sf).collect()]
    assert sorted(got) == sorted((r.o_custkey, [r.o_orderkey, r.o_orderkey + 1], r.o_orderkey) for r in rows)


@pytest.mark.parametrize("name", ["hard_negatives", "make_list_path", "truncated_keys"])
def test_rows_of_the_filtered_sql_are_among_them(spark, sf, name):
    asked = connect(sf).execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in asked.description]
    got = {tuple(plain(r[c]) for c in columns) for r in catalog.QUERIES[name](spark, sf).collect()}
    assert {tuple(plain(v) for v in r) for r in asked.fetchall()} <= got


def test_every_part_is_known_state(spark, sf):
    parts = {str(r.p_partkey) for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    got = [(r.value, r.origin) for r in catalog.QUERIES["value_provenance"](spark, sf).collect()]
    assert {o for v, o in got if v in parts} >= {"ENV_STATE"} and not [v for v, o in got if v in parts and o == "UNKNOWN"]
    assert not [v for v, o in got if v not in parts and o == "ENV_STATE"]
