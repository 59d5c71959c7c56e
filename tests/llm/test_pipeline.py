from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from millrace.llm import piece_sampling

from .fixtures import DOC, documents, frame, table_dir
from .test_documents_ops import covered, fingerprint, plain_bayes


def test_stages_keep_columns_and_effects(spark, tmp_path):
    sf = table_dir(spark, tmp_path / "t")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts, names = [docs.count()], [name for name, _ in pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "mix_sources", "sample_pieces"]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, sf).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        counts.append(docs.count())
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == before
        if k == 0:
            ids = {r.doc_id for r in docs.collect()}
            assert not ids & {12, 14, 22} and {r.lang for r in docs.collect()} <= {"en", "fr"}
        if k == 1:
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len(set(texts))
        if k == 2:
            assert all(r.n_chars == len(r.text) and r.text.strip() for r in docs.collect())
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[5] > 0
    assert all(r.round_trip for r in docs.collect())


def test_run_equals_stages(spark, tmp_path):
    sf = table_dir(spark, tmp_path / "t")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
    wanted = sorted((r.doc_id is None, r.doc_id, r["sample"], r.ids) for r in docs.collect())
    got = sorted((r.doc_id is None, r.doc_id, r["sample"], r.ids) for r in pipeline.run(spark, sf).collect())
    assert got == wanted


def test_empty_documents(spark, tmp_path):
    assert pipeline.run(spark, table_dir(spark, tmp_path / "t", rows=[])).count() == 0


def test_clean_documents_stay(spark):
    clean = [(i, f"Number {i} tells of {w} hills and {w} rivers near the town of {w}ville.", "en", "s1", 0, 0, "", "", 0) for i, w in enumerate(("north", "amber", "quiet", "bright", "seven", "golden"))]
    docs = frame(spark, clean)
    for _, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
    assert {r.doc_id for r in docs.collect()} == set(range(6))
    assert DOC and documents()


def plain_pipeline(rows):
    """The rows that the first four stages leave, in plain Python: (doc_id, text, lang, source), with repeats."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2
    predict = plain_bayes([(t, lang) for d, t, lang, _ in rows if t is not None and lang is not None and not held(d)])
    docs = []
    for d, t, lang, source in rows:
        found, score = predict(t)
        if found != "und" and score >= 0.5:
            docs.append((d, t, lang or found, source))

    prints = [fingerprint(t) for _, t, _, _ in docs]
    group = list(range(len(docs)))
    while True:
        before = list(group)
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    first = {}
    for doc, g in zip(docs, group, strict=True):
        if g not in first or (doc[0] is None, doc[0]) < (first[g][0] is None, first[g][0]):
            first[g] = doc
    docs = list(first.values())

    cut = []
    for (d, t, lang, source), gone in zip(docs, covered([t.encode() for _, t, _, _ in docs]), strict=True):
        raw = t.encode()
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        if left.strip(" \t\n\r"):
            cut.append((d, left, lang, source))

    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    place = lambda r: int(hashlib.md5(f"11|{'' if r[0] is None else r[0]}|{r[1]}".encode()).hexdigest()[:15], 16)
    size = Counter()
    for r in cut:
        size[r[3]] += words(r[1])
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped, level = sum(size.values()), 0, 0.0
    open_ = sum(weight.values())
    for s in sorted(names, key=lambda s: 3 * size[s] / weight[s]):
        level = (total - capped) / open_
        if level <= 3 * size[s] / weight[s]:
            break
        capped, open_ = capped + 3 * size[s], open_ - weight[s]
    out = []
    for s in names:
        target = min(3.0 * size[s], level * weight[s])
        base = math.floor(target / size[s])
        left = 0 if base >= 3 else math.floor(target - base * size[s])
        for r in sorted((r for r in cut if r[3] == s), key=place):
            more = words(r[1]) <= left
            left -= words(r[1]) * more
            out += [r] * (base + more)
    return out


def test_run_equals_plain_python(spark, tmp_path):
    rows = documents()
    wanted = Counter((d, t) for d, t, _, _ in plain_pipeline([r[:4] for r in rows]))
    pieces = piece_sampling.Pieces.load(piece_sampling.MODEL)
    got = pipeline.run(spark, table_dir(spark, tmp_path / "t", rows=rows)).collect()
    assert len(wanted) > 20
    for k in (1, 2):
        told = Counter((r.doc_id, piece_sampling.decode_ids(__import__("numpy").array(r.ids), pieces).decode()) for r in got if r["sample"] == k)
        assert told == wanted


@pytest.mark.parametrize("number", range(5))
def test_each_stage_takes_nulls_in_any_column(spark, number):
    full = (1, "Some words of a text that stands by itself.", "en", "s", 5, 1, "r", "k", 2)
    rows = [full, (None,) * len(full)] + [tuple(None if i == k else v for i, v in enumerate(full)) for k in range(len(full))] + [(9, "", "fr", None, 0, 0, "", "", 0)]
    docs = frame(spark, rows)
    found = pipeline.STAGES[number][1](spark, docs, "")
    assert number == 4 or found.columns == docs.columns
    texts = [r.text for r in found.collect()] if number < 4 else []
    assert number in (2, 4) or texts.count(full[1]) >= 1
    if number == 1:  # one of each text; nulls and empty ones are one group
        assert len(texts) == 2
    if number == 3:  # what weighs nothing comes as often as its whole source
        sizes = Counter(r.source for r in found.collect() if not r.text)
        assert set(sizes) <= {"s", None}
