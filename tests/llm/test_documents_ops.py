"""Operators on documents against brute force, on a small table that holds every awkward case."""

from __future__ import annotations

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from millrace.llm import langid, license_scan, mixing, piece_sampling, quality, queries, sharding, simhash, suffix_dedup
from tests.compare import connect, same

from .fixtures import documents, frame, table_dir


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    labels = [(i, int(i % 4 != 0), 0) for i in range(40)] + [(1, None, 0), (2, 0, None)]
    return table_dir(spark, tmp_path_factory.mktemp("awkward"), labels=labels)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return table_dir(spark, tmp_path_factory.mktemp("nothing"), rows=[])


DOCUMENT_QUERIES = [n for n in queries.QUERIES if n.split("_")[0] not in ("op5", "op6")]


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_table(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name])


def size(text):
    return (len(text.encode()) if text is not None else 0) + 1


def test_sharding(spark, awkward):
    rows = queries.QUERIES["op1_sharding"](spark, awkward).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d[0], size(d[1]), None if d[1] is None else zlib.crc32(d[1].encode())) for d in documents()
    )
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_sharding_is_a_seeded_shuffle(spark, tmp_path):
    df = frame(spark)
    order = lambda seed: [r.record.doc_id for r in sharding.external_shuffle(df, 4, seed=seed, bucket_rows=10).orderBy("shard", "slot").collect()]
    assert order(1) == order(1) != order(2)
    sharded = sharding.external_shuffle(df, 4)
    assert sharded.select("record.*").columns == df.columns
    sharding.write_shards(sharded, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == df.count()


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, awkward):
    rows = [(d[0], fingerprint(d[1])) for d in documents()]
    label = {f: f for _, f in rows}
    while True:
        before = dict(label)
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    names: dict = {}
    for d, f in rows:
        if d is not None:
            names[label[f]] = min(d, names.get(label[f], d))
    wanted = Counter((d, f"{f:016x}", names.get(label[f])) for d, f in rows)
    got = queries.QUERIES["op2_simhash_near_dedup"](spark, awkward)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == wanted


def test_simhash_tiles_and_parts(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    flips = base[:, None] ^ (np.int64(1) << rng.integers(0, 62, (40, 30)))
    fps = np.unique(np.concatenate([base, flips.ravel(), rng.integers(0, 1 << 63, 300, dtype=np.int64)]))
    labels = np.arange(len(fps))
    near = np.bitwise_count((fps[:, None] ^ fps[None]).view(np.uint64)) <= 4
    simhash.join_sets(labels, *np.nonzero(near))
    for tile in (7, 2048):
        src, dst = simhash.linked(fps, None, tile=tile)
        again = np.arange(len(fps))
        simhash.join_sets(again, np.searchsorted(fps, src), np.searchsorted(fps, dst))
        assert (again == labels).all()
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    for group_rows in (5, 100_000):  # a few rows a part: groups are dealt out as pairs of parts
        found = simhash.near_links(df, group_rows).collect()
        again = np.arange(len(fps))
        simhash.join_sets(again, np.searchsorted(fps, [r.src for r in found]), np.searchsorted(fps, [r.dst for r in found]))
        assert (again == labels).all()


def test_one_of_each_group(spark):
    df = frame(spark)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 2 and 7 not in ids  # the copy goes; another text under the same id stays


def test_tiles_of_distant_population_counts_are_skipped():
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.int64))
    counts = np.sort(np.bitwise_count(fps.view(np.uint64)).astype(np.int64))
    pairs = set(simhash.tile_pairs(counts, simhash.TILE, 4))
    tiles = range(0, len(counts), simhash.TILE)
    every = {(i, j) for i in tiles for j in tiles if i <= j}
    assert pairs < every and len(every - pairs) > len(every) // 4
    for i, j in every - pairs:  # nothing in a skipped pair can be near
        assert counts[j] - counts[min(i + simhash.TILE, len(counts)) - 1] > 4


def test_names_and_types_of_columns_do_not_matter(spark):
    from pyspark.sql import functions as F

    df = frame(spark)
    names = ("chosen", "_row_name", "r1", "r2", "tie", "fp", "component", "to", "bucket", "records", "start")
    wide = df.select("*", *[F.col("doc_id").alias(n) for n in names], F.create_map(F.lit("k"), F.col("source")).alias("m"), F.parse_json(F.lit("[1]")).alias("v"))
    kept = simhash.one_of_each(wide)
    assert kept.columns == wide.columns
    assert Counter((r.doc_id, r.text, r.chosen, r._row_name, r.m["k"]) for r in kept.collect()) == Counter((r.doc_id, r.text, r.doc_id, r.doc_id, r.source) for r in simhash.one_of_each(df).collect())
    sharded = sharding.external_shuffle(wide, 4)
    assert sharded.select("record.*").columns == wide.columns and sharded.count() == wide.count()


def test_rows_equal_in_id_and_text_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "y"), (1, "a b c", "y")], "doc_id long, text string, chosen string")
    found = {tuple(map(tuple, simhash.one_of_each(df.repartition(n)).collect())) for n in (1, 2, 3)}
    assert len(found) == 1 and len(next(iter(found))) == 1


def test_every_bucket_has_a_task_of_its_own(spark):
    from pyspark.sql import functions as F

    n = 1250
    told = spark.range(n).select("id", sharding.hashed_to(F.col("id")).alias("to")).repartition(n, "to")
    assert told.groupBy(F.spark_partition_id()).count().where("count > 1").isEmpty()


def test_license_scan_rows(spark, awkward):
    same(queries.QUERIES["op4_license_scan"](spark, awkward).where("doc_id IS NOT NULL AND doc_id NOT IN (3, 10)"), connect(awkward), f"SELECT * FROM ({queries.ORACLE_SQL['op4_license_scan']}) WHERE doc_id NOT IN (3, 10)")


def test_license_filters_lose_nothing():
    import random

    rng = random.Random(1)
    vocabulary = sorted({t for _, notice in license_scan.TEMPLATES for t in license_scan.normalized(notice).split()})
    join = license_scan.Join(license_scan.TEMPLATES, {t: rng.randint(0, 9) for t in vocabulary})
    for _ in range(400):
        label, notice = rng.choice(license_scan.TEMPLATES)
        block = {t for t in license_scan.normalized(notice).split() if rng.random() < 0.85} | set(rng.sample(vocabulary, 3))
        wanted = {}
        for other, text in license_scan.TEMPLATES:
            own = set(license_scan.normalized(text).split())
            if len(own & block) * 5 >= 4 * len(own):
                wanted[other] = len(own & block) / len(own)
        assert dict(join.matches(block)) == wanted


@pytest.mark.parametrize("prefix", range(0, 70, 3))
@pytest.mark.parametrize("width", [3, 5, 7, 11])
def test_wrapped_notices_are_found(prefix, width):
    """Every template behind ``prefix`` words, its own words wrapped after every ``width``."""
    join = license_scan.Join(license_scan.TEMPLATES, {})
    for label, notice in license_scan.TEMPLATES:
        words = notice.split()
        wrapped = "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))
        text = " ".join(["river"] * prefix) + "\n" + wrapped + "\n\n" + "house " * 90
        found = license_scan.scan_text(text, join)
        assert label in found[5].split(",") and found[6] == 1.0


def test_wrapped_notices_equal_all_blocks(spark):
    """Labels by brute force: all lines, and all windows of words at the operator's places."""
    import random

    rng = random.Random(3)
    texts = []
    for _ in range(150):
        words = [w for _ in range(4) for w in rng.choice(license_scan.TEMPLATES)[1].split() + ["river"] * rng.randrange(30) if rng.random() < 0.95]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\n\n"]) for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_scan.scan(df, keep=("doc_id",)).collect():
        text = texts[r.record.doc_id]
        words = text.split()
        lines = [line.split() for line in text.split("\n")]
        wanted = {p for p, w in license_scan.BASE_PHRASES.items() if f" {w} " in f" {' '.join(words)} "}
        for label, notice in license_scan.TEMPLATES:
            own, step = set(notice.split()), 1
            while step < len(notice.split()):
                step *= 2
            tried = lines + [words[i : i + 2 * step] for i in range(0, len(words), step) if len(lines) > 1]
            if any(5 * len(own & set(b)) >= 4 * len(own) for b in tried):
                wanted.add(label)
        assert r.labels == ",".join(sorted(wanted))


def test_license_base_places_of_a_long_text_take_linear_time():
    import time

    words = b"all rights reserved cc by river".split() * 100_000
    began = time.time()
    places = license_scan.base_places(words)
    assert time.time() - began < 10
    assert places == {"reserved": list(range(0, 600_000, 6)), "cc-by": list(range(3, 600_000, 6))}


def covered(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                mark[i] += 1
                mark[i + 200] -= 1
        yield np.cumsum(mark)[:-1] > 0


def test_suffix_dedup(spark, awkward):
    docs = [(d[0], (d[1] or "").encode()) for d in documents()]
    wanted = Counter()
    for (doc, text), gone in zip(docs, covered([t for _, t in docs]), strict=True):
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        wanted[doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = Counter(tuple(r) for r in queries.QUERIES["op7_suffix_dedup"](spark, awkward).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == wanted


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in [*range(1, 40), 300]:
        for k in (1, 2, 5):
            s = rng.integers(1, k + 1, n)
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_sorting_takes_little_memory():
    rng = np.random.default_rng(4)
    first = rng.integers(97, 123, 60_000).astype(np.uint8).tobytes()
    segments = [first, rng.integers(97, 123, 140_000).astype(np.uint8).tobytes(), first[500:9000]]
    tracemalloc.start()
    found = suffix_dedup.repeats(segments)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x.tolist() for x in found] == [list(range(500, 9000 - suffix_dedup.SPAN + 1)), [], list(range(8500 - suffix_dedup.SPAN + 1))]
    assert most < 64 * sum(map(len, segments))


def test_anchors_are_shared_by_equal_windows():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 100, 200).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, a).astype(np.uint8), shared, rng.integers(97, 123, b).astype(np.uint8)]) for a, b in ((0, 300), (57, 0), (400, 33))]
    at = []
    for text, start in zip(texts, (0, 57, 400), strict=True):
        place, _ = suffix_dedup.anchors(text)
        inside = (place >= start) & (place <= start + suffix_dedup.REACH)
        at.append(set((place[inside] - start).tolist()))
    assert at[0] & at[1] & at[2]


def n_removed(texts):
    """Bytes covered by a repeated string, by the digests of all of them."""
    seen = Counter(xxhash.xxh3_128_intdigest(t[i : i + 200]) for t in texts for i in range(len(t) - 199))
    for t in texts:
        upto = total = 0
        for i in range(len(t) - 199):
            if seen[xxhash.xxh3_128_intdigest(t[i : i + 200])] > 1:
                total += i + 200 - max(upto, i)
                upto = i + 200
        yield total


def passages(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.id: r.n for r in suffix_dedup.dedup(df, **kw).selectExpr("record.doc_id AS id", "n_removed AS n").collect()}


def letters(rng, alphabet, n):
    return "".join(rng.choices(alphabet, k=n))


@pytest.mark.parametrize("most", [1 << 20, 6000, 600])
@pytest.mark.parametrize("core", [150, 195, 230])
def test_hot_anchors_are_split_without_loss(spark, monkeypatch, most, core):
    """Rows that share a core shorter or longer than a repeat, at several cuts, so that contexts differ on both sides."""
    import random

    rng = random.Random(core)
    passage = letters(rng, "abcdef", core)
    texts = []
    for i in range(80):
        own = passage[(i % 4) * (core > 200) * 9 :]
        texts.append(letters(rng, "uvwxyz", rng.randint(0, 250)) + own + letters(rng, "uvwxyz", rng.randint(0, 200)))
    texts += [texts[5][20:], texts[6] + "tail"]
    texts += ["the " * 90 + texts[7][:40] + "the " * 120, texts[8][:30] + "the " * 100 + "end", "he the " * 40 + "a " * 300]
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    assert passages(spark, texts) == dict(enumerate(n_removed([t.encode() for t in texts])))


def test_a_core_shared_by_very_many_rows(spark):
    import random
    import time

    rng = random.Random(9)
    core = letters(rng, "abcdef", 150)
    texts = [letters(rng, "uvwxyz", 55) + core + letters(rng, "uvwxyz", 55) for _ in range(20_000)]
    texts += [texts[0], texts[1][:230], texts[2][10:]]
    began = time.time()
    assert passages(spark, texts) == dict(enumerate(n_removed([t.encode() for t in texts])))
    assert time.time() - began < 240


def test_a_row_repeated_very_often(spark):
    import random

    rng = random.Random(10)
    line = letters(rng, "abcdefgh", 700)
    other = letters(rng, "ijkl", 100) + line[50:400] + letters(rng, "mnop", 100)
    rows = [(1, line)] * 10_000 + [(2, other), (3, letters(rng, "qrst", 400)), (4, "short"), (4, "short")]
    found = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = Counter((r.record.doc_id, r.n_removed, r.n_spans, r.kept) for r in found.collect())
    assert got == {(1, 700, 1, ""): 10_000, (2, 350, 1, other[:100] + other[450:]): 1, (3, 0, 0, None): 1, (4, 0, 0, None): 2}


def test_texts_of_several_pieces(spark):
    """Texts of over a megabyte, with a stretch of 300 KB in common that crosses a piece's edge, and one within a text."""
    import random

    rng = random.Random(11)
    shared = letters(rng, "abcdefgh", 300_000)
    a = letters(rng, "ijklmnop", 400_000) + shared + letters(rng, "ijklmnop", 500_000)
    b = letters(rng, "qrstuvwx", 100) + shared + letters(rng, "qrstuvwx", 10_000)
    b += b[-5000:-4000] + "." + letters(rng, "qrstuvwx", 1000)
    texts = [a, b, "z" * 3000, "no " * 100_000]
    assert passages(spark, texts) == dict(enumerate(n_removed([t.encode() for t in texts])))


def test_language_id(spark, awkward):
    rows = queries.QUERIES["op8_language_id"](spark, awkward).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in documents())
    by_text = {d[0]: d[1] for d in documents() if d[0] not in (3, 10)}
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
        if r.doc_id in by_text:
            letters = any(c.isalpha() for c in by_text[r.doc_id] or "")
            assert r.lang_pred in (("en", "fr") if letters else ("und",))


def test_language_id_held_out_accuracy(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.QUERIES["op8_language_id"](spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) >= 0.95


def test_language_grams_of_chunks(monkeypatch):
    text = "Wörter über Wörter " * 50
    whole = Counter(int(k) for g in langid.grams(text) for k in g)
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert Counter(int(k) for g in langid.grams(text) for k in g) == whole


def plain_bayes(rows):
    """Naive Bayes over hashed runs in plain Python: rows (text, lang) -> a function text -> (lang, posterior)."""
    import math

    full = (1 << 32) - 1

    def runs(text):
        low = " " + text.lower() + " "
        for i in range(len(low) - 1):
            two = (ord(low[i]) * 0x9E3779B1 & full) ^ (ord(low[i + 1]) * 0x85EBCA77 & full)
            yield ((two ^ (two >> 15)) * 0x165667B1 & full) >> 17
            if i + 2 < len(low):
                three = (two * 0xC2B2AE3D & full) ^ (ord(low[i + 2]) * 0x27D4EB2F & full)
                yield ((three ^ (three >> 15)) * 0x9E3779B1 & full) >> 17

    counts, docs = {}, Counter()
    for text, lang in rows:
        docs[lang] += 1
        counts.setdefault(lang, Counter()).update(runs(text))

    def predict(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        total = {}
        for lang, own in counts.items():
            n = sum(own.values())
            total[lang] = math.log(docs[lang] / sum(docs.values())) + math.fsum(math.log((own[r] + 0.5) / (n + 0.5 * (1 << 15))) for r in runs(text))
        best = min(total, key=lambda x: (-total[x], x))
        return best, 1 / math.fsum(math.exp(max(v - total[best], -700)) for v in total.values())

    return predict


@pytest.mark.parametrize("at_once", [512, 1])
def test_language_id_equals_plain_bayes(spark, awkward, sf, monkeypatch, at_once):
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", at_once)
    for folder in (awkward, sf):
        docs = [r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2
        predict = plain_bayes([(r.text, r.lang) for r in docs if r.text is not None and r.lang is not None and not held(r.doc_id)])
        wanted = Counter((r.doc_id, held(r.doc_id), predict(r.text)[0], round(predict(r.text)[1], 9)) for r in docs)
        got = queries.QUERIES["op8_language_id"](spark, folder).collect()
        assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in got) == wanted


def test_language_scores_do_not_depend_on_the_batch(monkeypatch):
    rng = np.random.default_rng(5)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)), np.zeros(3))
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in (0, 1, 2, 500, 3, 900, 40)]
    together = model.totals(texts)
    assert (together == np.concatenate([model.totals([t]) for t in texts])).all()
    monkeypatch.setattr(langid, "CHUNK", 100)  # some share a slice, some are cut
    assert np.allclose(model.totals(texts), together)


def test_mixing(spark, awkward):
    rows = queries.QUERIES["op9_mixing"](spark, awkward).collect()
    docs = documents()
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d[0], words(d[1])) for d in docs)
    sizes = Counter()
    for d in docs:
        sizes[d[3]] += words(d[1])
    weights = dict(zip(sorted((s for s in sizes if s is not None)) + [None], (5, 2, 1, 5), strict=True))
    total, targets, open_ = sum(sizes.values()), {}, set(sizes)
    left = float(total)
    while True:  # cap by cap, as the rule is worded
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            targets |= share
            break
        for s in over:
            targets[s] = 3.0 * sizes[s]
            left -= targets[s]
        open_ -= over
    source_of = {d[0]: d[3] for d in docs if d[0] != 3}
    for r in rows:
        assert r.taken in {r.size * k for k in range(4)}
        if r.doc_id in source_of:
            assert r.source_size == sizes[source_of[r.doc_id]] and r.target == pytest.approx(targets[source_of[r.doc_id]])
    assert sum(r.taken for r in rows) <= total
    again = queries.QUERIES["op9_mixing"](spark, awkward).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mixing_leaves_out_only_what_does_not_fit(spark, tmp_path):
    """Sizes that leave a rest at every threshold: the walk by hash goes on until nothing fits."""
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * min(5000, int(1.3 ** rng.randint(0, 32)))), "en", f"s{i % 3}", 0, 0, "", "", 0) for i in range(400)]
    sf = table_dir(spark, tmp_path / "m", rows=rows)
    got = queries.QUERIES["op9_mixing"](spark, sf)
    same(got, connect(sf), queries.ORACLE_SQL["op9_mixing"])
    source = {r[0]: r[3] for r in rows}
    by: dict = {}
    for r in got.collect():
        by.setdefault(source[r.doc_id], []).append(r)
    for own in by.values():
        least = min(r.taken // r.size for r in own)
        left = own[0].target - sum(r.taken for r in own)
        assert 0 <= left and all(r.size > left for r in own if r.taken // r.size == least and least < 3)


def test_mixed_documents_keep_columns(spark):
    df = frame(spark)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() > 0


def test_quality(spark, awkward):
    rows = queries.QUERIES["op10_quality"](spark, awkward).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in documents())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.score for r in rows if r.doc_id in (12, 14)} == {0.0}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op10_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) >= 0.9


def test_quality_without_labels(spark, tmp_path):
    rows = queries.QUERIES["op10_quality"](spark, table_dir(spark, tmp_path / "none")).collect()
    assert {round(r.score, 6) for r in rows} <= {0.0, 0.5}


def test_crf_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    field = quality.Field(rng.normal(size=quality.WIDTH), (0.7, -0.4))
    x = rng.normal(size=(5, quality.WIDTH))
    u, total, good = x @ field.weights, 0.0, np.zeros(5)
    for path in itertools.product((0, 1), repeat=5):
        w = np.exp(sum(u[i] for i in range(5) if path[i]) + sum(field.stay[a] for a, b in itertools.pairwise(path) if a == b))
        total += w
        good += w * np.array(path)
    assert np.allclose(field.marginals(x), good / total)


def test_crf_gradient_equals_differences():
    rng = np.random.default_rng(2)
    X, on, y = rng.normal(size=(2, 4, quality.WIDTH)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]]), np.array([1.0, 0.0])
    X *= on[:, :, None]
    theta = rng.normal(size=quality.WIDTH + 2) * 0.3

    def likelihood(t):
        out = 0.0
        for k, n in ((0, 4), (1, 2)):
            u = X[k, :n] @ t[: quality.WIDTH]
            import itertools

            score = lambda p: sum(u[i] for i in range(n) if p[i]) + sum(t[quality.WIDTH + a] for a, b in itertools.pairwise(p) if a == b)  # noqa: B023, E731
            z = np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=n)))
            out += (score((int(y[k]),) * n) - z) / n
        return out

    step = np.eye(len(theta)) * 1e-5
    numeric = np.array([(likelihood(theta + s) - likelihood(theta - s)) / 2e-5 for s in step])
    assert np.allclose(quality._gradient(theta, X, on, y), numeric, atol=1e-3)


def plain_quality(text, field):
    """The score by sums over all labellings, two lines at a time, in plain Python."""
    import math

    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    if not lines:
        return 0.0
    own = []
    for k, line in enumerate(lines):
        words, n = line.split(), len(line)
        count = lambda keep: sum(keep(c) for c in line)  # noqa: B023, E731
        letters, upper = count(lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128), count(lambda c: 65 <= c <= 90)
        symbols = count(lambda c: 33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,;:'\"?-()")
        digits, again = count(lambda c: 48 <= c <= 57), sum(a == b for a, b in zip(words, words[1:]))
        own.append([min(math.log1p(n) / 8, 2.0), letters / n, digits / n, symbols / n, min(symbols / len(words), 2.0), upper / max(letters, 1)])
        own[-1] += [again / len(words), len(set(words)) / len(words), min(n / len(words) / 10, 3.0), float(line in lines[:k])]
    none = [0.0] * len(own[0])
    u = []
    for k in range(len(own)):
        x = [1.0, *own[k], *(own[k - 1] if k else none), *(own[k + 1] if k + 1 < len(own) else none), float(k == 0), float(k == len(own) - 1)]
        u.append(math.fsum(a * b for a, b in zip(x, field.weights, strict=True)))
    stay = lambda a, b: math.exp(field.stay[a]) if a == b else 1.0
    ahead = [[1.0, math.exp(u[0])]]
    for v in u[1:]:
        step = [sum(ahead[-1][a] * stay(a, b) for a in (0, 1)) * (math.exp(v) if b else 1.0) for b in (0, 1)]
        ahead.append([s / sum(step) for s in step])
    back = [[1.0, 1.0]]
    for v in u[:0:-1]:
        step = [sum(stay(a, b) * (math.exp(v) if b else 1.0) * back[0][b] for b in (0, 1)) for a in (0, 1)]
        back.insert(0, [s / sum(step) for s in step])
    good = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(ahead, back, strict=True)]
    return math.fsum(g * len(x) for g, x in zip(good, lines, strict=True)) / sum(map(len, lines))


def test_quality_equals_plain_forward_backward(spark, awkward):
    for folder in (awkward, "/root/testdata/sf0.001"):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        field = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
        wanted = Counter((r.doc_id, round(plain_quality(r.text, field), 7)) for r in docs.collect())
        assert Counter((r.doc_id, round(r.score, 7)) for r in queries.QUERIES["op10_quality"](spark, folder).collect()) == wanted


def test_training_takes_a_bounded_number_of_lines():
    x = np.arange(2000.0)[:, None]
    kept = quality._some_chains(x)[:, 0]
    assert len(kept) <= quality.CHAINS * quality.CHAIN and kept[0] == 0 and kept[-1] == 1999
    assert (quality._some_chains(x[:500]) == x[:500]).all()


def test_piece_sampling(spark, awkward):
    rows = queries.QUERIES["op3_piece_sampling"](spark, awkward).collect()
    docs = documents()
    assert all(r.round_trip for r in rows) and {r.doc_id for r in rows} == {d[0] for d in docs}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, {}).setdefault(r["sample"], []).append(r)
    assert by[10][1][0].ids == [] and 2 not in by[10]
    for doc, samples in by.items():
        if doc in (3, 10):
            continue
        if 2 in samples:
            assert samples[1][0].ids != samples[2][0].ids and samples[1][0].perturbed >= samples[2][0].perturbed
    copies = Counter(tuple(r.ids) for r in by[3][1])
    assert sorted(copies.values()) == [1, 2]  # a repeated row gives the same sample


def test_piece_samples_follow_their_law():
    import math

    pieces = piece_sampling.Pieces.load(piece_sampling.MODEL)
    n, text = 20_000, "to then"
    first, weight, per = Counter(), Counter(), {}
    law = {}
    for t, k, ids, log_p, _, inclusion in piece_sampling.encode_texts([text] * n, np.arange(n) * 7919, pieces, 3):
        s = tuple(ids.tolist())
        law[s] = math.exp(log_p)
        first[s] += k == 1
        weight[s] += 1 / math.exp(inclusion)
        per.setdefault(t, []).append(s)
    assert all(len(set(v)) == 3 for v in per.values())
    for s, p in law.items():
        if p > 0.05:
            assert first[s] / n == pytest.approx(p, abs=0.02)
            assert weight[s] / n == pytest.approx(1, abs=0.03)  # inverse inclusion probabilities count each once


def test_piece_samples_do_not_depend_on_slices(monkeypatch):
    pieces = piece_sampling.Pieces.load(piece_sampling.MODEL)
    texts = [d[1] or "" for d in documents()]
    together = {(t, k): (ids.tolist(), p, g) for t, k, ids, p, g, _ in piece_sampling.encode_texts(texts, np.arange(len(texts)), pieces, 2)}
    for i in (0, 3, 21):
        for _, k, ids, p, g, _ in piece_sampling.encode_texts([texts[i]], np.array([i]), pieces, 2):
            assert together[i, k] == (ids.tolist(), p, g)


def test_all_segmentations_of_a_short_text():
    pieces = piece_sampling.Pieces.load(piece_sampling.MODEL)
    found = list(piece_sampling.encode_texts(["a"], np.array([1]), pieces, 50))
    assert len({tuple(f[2].tolist()) for f in found}) == len(found) < 50
    assert sum(np.exp(f[3]) for f in found) == pytest.approx(1)
    assert {f[5] for f in found} == {0.0}  # nothing was left out
