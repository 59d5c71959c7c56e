from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.llm import embed_dedup, queries, topk
from tests.compare import connect, same

from .fixtures import table_dir


def vectors(n=300, d=16, seed=9):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) / 4
    x[40:60] = x[40] + rng.normal(size=(20, d)) * 0.01
    x[60:70] = x[5]
    x[70] = 2 * x[71]
    rows = [(i, [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    rows[100] = (100, None, 1)
    rows[101] = (101, [float("nan")] + rows[101][1][1:], 1)
    rows[102] = (102, [None] + rows[102][1][1:], 1)
    rows[103] = (103, [0.0] * d, 1)
    rows[104] = (104, [float("inf")] + rows[104][1][1:], 1)
    rows[105] = (105, rows[105][1][:4], 1)
    rows[106] = (106, [], 1)
    rows.append(rows[7])
    rows.append((None, rows[8][1], 0))
    return rows


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return table_dir(spark, tmp_path_factory.mktemp("vectors"), vectors=vectors())


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return table_dir(spark, tmp_path_factory.mktemp("no_vectors"))


@pytest.mark.parametrize("name", ["op5_embedding_near_dedup", "op6_exact_topk"])
def test_empty_table(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).count() == 0


def able(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows):
    """Per row: how many others it links with, and the smallest id it reaches (its own, null or not, if it links with none)."""
    x = [np.array(v) if able(v) else None for _, v, _ in rows]
    near = [
        [j for j, b in enumerate(x) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95]
        for i, a in enumerate(x)
    ]
    group = list(range(len(rows)))
    while True:
        before = list(group)
        for i in range(len(rows)):
            group[i] = min([group[i], *(group[j] for j in near[i])])
        if group == before:
            break
    ids = {}
    for (i, _, _), g in zip(rows, group, strict=True):
        ids.setdefault(g, []).append(i)
    return [(r[0], len(n), min((i for i in ids[g] if i is not None), default=None)) for r, n, g in zip(rows, near, group, strict=True)]


def test_near_duplicates_equal_brute_force(spark, awkward):
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in queries.QUERIES["op5_embedding_near_dedup"](spark, awkward).collect())
    assert got == Counter(brute_links(vectors()))


def test_kept_rows(spark, awkward):
    for r in queries.QUERIES["op5_embedding_near_dedup"](spark, awkward).collect():
        assert r.kept == (r.vec_id == r.component_id)


def test_rows_that_repeat_or_lack_an_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (None, [1.0, 0.01], 0), (None, [-1.0, -1.0], 0), (7, [0.01, 1.0], 0), (7, [0.01, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter(tuple(r) for r in embed_dedup.near_duplicates(df).collect())
    assert got == Counter(brute_links(rows)) and sum(got.values()) == 6


def test_windows_across_blocks_and_dense_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(200, 12)), rng.normal(size=12) + rng.normal(size=(150, 12)) * 0.02])
    rows = [(i, [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    monkeypatch.setattr(embed_dedup, "TILE", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = Counter(tuple(r) for r in embed_dedup.near_duplicates(df, window=8).collect())
    assert got == Counter(brute_links(rows))  # windows of 8 find a group of 150, counted in full


@pytest.mark.parametrize("cone", [0.0, 0.7])
def test_recall_of_links(spark, cone):
    """Links found of those there are, over groups of two to forty around common centres."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    centre = unit(np.sqrt(cone) * np.eye(32)[0] + np.sqrt(1 - cone) * unit(rng.normal(size=(1500, 32))))
    x = np.concatenate([centre, *(unit(centre[:n] + 0.03 * rng.normal(size=(n, 32))) for n in (300, 100, *([20] * 38)))])
    near = unit(x) @ unit(x).T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    total = sum(r.n_links for r in embed_dedup.near_duplicates(df, window=64).collect())
    assert 0.98 * near.sum() <= total <= near.sum()


@pytest.mark.parametrize(("n", "cone", "share"), [(8000, 0.8, 1.0), (20_000, 0.8, 0.34), (20_000, 0.0, 0.0)])
def test_isolated_pairs_are_found_in_cones(spark, tmp_path, n, cone, share):
    """A share of the vectors lies around one axis (``cone`` is their mean cosine); each planted pair is at 0.952."""
    rng = np.random.default_rng(n)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = unit(rng.normal(size=(n, 64)))
    m = int(n * share)
    x[:m] = unit(np.sqrt(cone) * np.eye(64)[0] + np.sqrt(1 - cone) * x[:m])
    at = rng.choice(m or n, 500, replace=False)
    off = rng.normal(size=(500, 64))
    off = unit(off - (off * x[at]).sum(axis=1, keepdims=True) * x[at])
    x = np.concatenate([x, 0.952 * x[at] + np.sqrt(1 - 0.952**2) * off])
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), tmp_path / "e.parquet")
    got = {r.vec_id: r.component_id for r in embed_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "e.parquet"))).collect()}
    assert np.mean([got[n + i] == got[int(a)] for i, a in enumerate(at)]) >= 0.99


def test_passes_grow_with_the_table():
    few, many = embed_dedup.passes_needed(10_000), embed_dedup.passes_needed(1_000_000_000)
    assert 2 <= few < many < 500


def brute_topk(rows, step, k=5):
    fine = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wanted = Counter()
    for n, (q, x) in enumerate(fine):
        if q is not None and q % step == 0:
            scored = [(-sum(a * b for a, b in zip(x, y, strict=True)), i is None, i) for m, (i, y) in enumerate(fine) if m != n and len(y) == len(x)]
            best = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
            wanted.update((q, r + 1, i, -s) for r, (s, _, i) in enumerate(best))
    return wanted


def test_topk_equals_brute_force(spark, awkward):
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in queries.QUERIES["op6_exact_topk"](spark, awkward).collect())
    assert got == brute_topk(vectors(), 50)


def test_topk_of_large_components_and_repeated_ids(spark):
    """Components of 2^21 and far more; ids that repeat with other vectors, copies."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=4)], 0) for i in range(60)]
    rows[3] = (3, [float(1 << 21), 0.5, 0.0, 0.0], 0)
    rows[4] = (4, [-float(1 << 21), 0.25, 1.0, 0.0], 0)
    rows[5] = (5, [2.0**42, -(2.0**42), 0.0, 0.0], 0)
    rows[10] = (10, [2.0**20, 0.0, -1.0, 3.0], 0)
    rows += [(1, [3.0, 1.0, 1.0, 1.0], 0), (1, [-3.0, 1.0, 1.0, 1.0], 0), (20, [5.0, 5.0, 5.0, 5.0], 0), (None, [9.0, 9.0, 9.0, 9.0], 0), rows[30], rows[30], rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, "vec_id % 10 = 0 AND vec_id <> 10").collect())
    assert got == Counter({k: n for k, n in brute_topk(rows, 10).items() if k[0] != 10})
    many = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df.where("vec_id IS NULL OR vec_id <> 5"), "vec_id = 10").collect())
    assert many == Counter({k: n for k, n in brute_topk([r for r in rows if r[0] != 5], 10).items() if k[0] == 10})


def test_topk_that_fits_no_long_is_an_error(spark):
    df = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.search(df, "vec_id = 0").collect()


def test_topk_equals_sql(spark, sf):
    same(queries.QUERIES["op6_exact_topk"](spark, sf), connect(sf), queries.ORACLE_SQL["op6_exact_topk"])


def test_topk_over_several_blocks(spark, monkeypatch, sf):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    same(queries.QUERIES["op6_exact_topk"](spark, sf), connect(sf), queries.ORACLE_SQL["op6_exact_topk"])


@pytest.mark.parametrize(("n", "d", "high"), [(3, 4, 9), (300, 8, 200), (1000, 3, 1 << 20), (70, 1, 2), (65, 2, 1)])
def test_bit_slices(n, d, high):
    rng = np.random.default_rng(n)
    x = rng.integers(-high, high, (n, d))
    ids = rng.permutation(n)
    block = lambda m: topk.Block(np.arange(n)[:m], ids[:m], np.ones(n, bool)[:m], x[:m].astype(float))
    got = {}
    for q, row, s in topk.best(block(n), block(20), 6):
        if q != row:
            got.setdefault(q, []).append((-s, ids[row]))
    for k in range(min(20, n)):
        assert got[k][:5] == sorted((-(x[m] @ x[k]), ids[m]) for m in range(n) if m != k)[:5]
