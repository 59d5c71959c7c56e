from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import metrics, neardup, provenance, sequences, splits


def column(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr).first()[0]


def test_text_functions(spark):
    assert column(spark, X.normalize(F.col("t")), t="  Héllo,  WORLD-42! ") == "h llo world 42"
    assert column(spark, X.tokens(F.col("t")), t="The cat is on a mat") == ["cat", "mat"]
    assert column(spark, X.shingles(F.split("t", " "), 2), t="a b c") == ["a b", "b c"]
    assert column(spark, X.shingles(F.split("t", " "), 9), t="a b c") == ["a b c"]
    assert column(spark, X.react_calls(F.col("t")), t="Action: go\nAction Input: {}\n")[0].tool == "go"
    assert column(spark, X.fenced_blocks(F.col("t")), t="x ```json\n{1}``` y") == ["{1}"]
    assert column(spark, X.tagged(F.col("t"), "p"), t="<p>a</p><p>b</p>") == ["a", "b"]
    assert column(spark, X.escape_lines(F.col("t")), t="a\n\\") == "a\\n\\\\"
    assert column(spark, X.object_noun(F.col("t"), ["get"]), t="get_user_name_x") == "user name"
    assert column(spark, provenance.literal_observed(F.col("t"), F.col("v")), t="pay 1,250 now", v="1250.0")


def test_jaccard_of_empty(spark):
    none = F.array().cast("array<string>")
    assert column(spark, X.jaccard(none, F.array(F.lit("a")))) == 0.0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(0 for _ in b)] if not row else row
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize(("a", "b"), [("abcd", "bde"), ("", "x"), ("aaa", "aa"), ("xyz", "abc"), ("banana", "atana")])
def test_lcs(spark, a, b):
    df = spark.createDataFrame([(list(a), list(b))], "a array<string>, b array<string>")
    assert df.select(metrics.lcs_length(F.col("a"), F.col("b"))).first()[0] == lcs(a, b)


def test_exact_statistics(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (3, 10)], "k long, n long")
    got = {r.k: (r.low, r.high) for r in metrics.clopper_pearson(df, "k", "n").collect()}
    assert got[0] == (0.0, 0.308497) and got[10] == (0.691503, 1.0) and got[3] == (0.06674, 0.652453)
    assert metrics.mcnemar_p(0, 0) == 1.0 and metrics.mcnemar_p(1, 8) == 0.0390625


def test_best_matches(spark):
    pairs = spark.createDataFrame([("g", 0, 0, 1.0), ("g", 0, 1, 0.9), ("g", 1, 0, 0.9)], "k string, gold long, found long, score double")
    got = {(r.gold, r.found) for r in metrics.best_matches(pairs, "k").collect()}
    assert got == {(0, 1), (1, 0)}


R, W = "read", "write"
POLL = (R, "STATUS", True, True)
CASES = {
    "good": [POLL, (W, "COMMAND", None, None), POLL, (W, "COMMAND", None, None), POLL, (W, "COMMAND", None, None), POLL],
    "s1": [(W, "COMMAND", None, None)],
    "s3": [POLL, (W, "COMMAND", None, None), (W, "COMMAND", None, None), (W, "COMMAND", None, None)],
    "s7": [POLL, (W, "COMMAND", None, None), (W, "COMMAND", None, None), POLL, (W, "COMMAND", None, None), (R, "STATUS", True, False)],
    "few": [POLL, (W, "COMMAND", None, None)],
    "op": [("poke", "X", None, None)],
    "long": [POLL] * 201,
}
WANTED = {
    "good": ("SUCCESS", None),
    "s1": ("VIOLATION", "S1"),
    "s3": ("VIOLATION", "S3"),
    "s7": ("VIOLATION", "S7"),
    "few": ("INSUFFICIENT_EVIDENCE", None),
    "op": ("VIOLATION", "UNKNOWN_OP"),
    "long": ("BUDGET_INFEASIBLE", None),
}


def submission_rows():
    return [(name, i, *s) for name, steps in CASES.items() for i, s in enumerate(steps)]


def test_submission_contract(spark):
    df = spark.createDataFrame(submission_rows(), "id string, at int, op string, reg string, ready boolean, empty boolean")
    got = {r.id: (r.judgment, r.contract) for r in sequences.check_submissions(df, "id", "at").collect()}
    assert got == WANTED


def test_initialization_contract(spark):
    idle, busy = (R, "STATUS", None, True), (R, "STATUS", None, False)
    commit = [(W, "CTRL_SHADOWED", "7", None)] * 2
    keys = [(W, f"KEY_SHARE{s}_{i}", "1", None) for s in (0, 1) for i in range(8)]
    cases = {
        "good": [idle, *commit, idle, *keys],
        "C1": commit,
        "C3": [idle, keys[0]],
        "C4": [idle, *commit, keys[0]],
        "C8": [idle, *commit, idle, *keys[:-1]],
        "reset": [idle, commit[0], (R, "CTRL_SHADOWED", None, None), commit[0], idle, keys[0]],
        "differ": [idle, commit[0], (W, "CTRL_SHADOWED", "8", None)],
        "busy": [idle, busy, *commit],
        "UNKNOWN_REG": [idle, (W, "X", "1", None)],
    }
    rows = [(n, i, *s) for n, steps in cases.items() for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "id string, at int, op string, reg string, value string, idle boolean")
    got = {r.id: (r.judgment, r.contract) for r in sequences.check_initialization(df, "id", "at").collect()}
    none = ("INSUFFICIENT_EVIDENCE", None)
    wanted = {"good": ("SUCCESS", None), "reset": ("VIOLATION", "C3"), "differ": none, "busy": none}
    assert got == wanted | {c: ("VIOLATION", c) for c in ("C1", "C3", "C4", "C8", "UNKNOWN_REG")}


def test_families_and_leakage(spark):
    texts = ["red green blue black white grey"] * 2 + ["red green blue black white pink", "one two three four five six", None, ""]
    df = spark.createDataFrame([(i, t, "train" if i % 2 else "test") for i, t in enumerate(texts)], "id long, text string, split string")
    found = {r.id: r.family for r in neardup.families(df, "id", "text").collect()}
    assert found[1] == 0 and found[3] == 3 and found[5] == 4
    assert neardup.exact_leakage(df, "text", "split").first().exact_pairs == 2
    assert {(r.a, r.b) for r in neardup.verified_pairs(df, "id", "text", 0.99).collect()} == {(0, 1)}


def test_splits_are_whole_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 50).alias("family"))
    shares = {"train": 0.8, "val": 0.1, "test": 0.1}
    once = splits.bucket_split(df, "family", shares).groupBy("family").agg(F.count_distinct("split").alias("n"))
    assert once.where("n > 1").isEmpty()
    sizes = df.groupBy("family").agg(F.count("*").alias("n"))
    greedy = {r.split: r["sum(n)"] for r in splits.greedy_family_split(sizes, shares).groupBy("split").sum("n").collect()}
    assert greedy == {"train": 800, "val": 100, "test": 100}
    assert splits.exact_split(df, "id", 0.05).where("split = 'val'").count() == 50


def test_list_provenance(spark):
    lists = spark.createDataFrame([("q", 3, ["a", "b"]), ("q", 4, ["a", "c"]), ("q", 5, ["a", "z"])], "id string, step int, items array<string>")
    earlier = spark.createDataFrame([("q", 1, ["a", "b"]), ("q", 2, ["c"])], "id string, before int, items array<string>")
    got = {r.step: r.origin for r in provenance.trace_lists(lists, earlier, "id").collect()}
    assert got == {3: "whole", 4: "elements", 5: "unknown"}


def test_flatten_nested(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, "x"]}, "e": [], "o": {}, "t": true}')], "id int, j string").select("id", F.parse_json("j").alias("v"))
    got = {r.path: r.value for r in provenance.flatten(df, "id", "v").collect()}
    assert got == {"a.b[0]": "1", "a.b[1]": "x", "e": "[]", "o": "{}", "t": "true"}


@pytest.mark.parametrize("few", [0, 5, 1 << 20])
def test_components_in_rounds_and_in_one_task(spark, tmp_path, few):
    import random

    from millrace.operators.components import components
    from millrace.storage import Scratch

    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(25)] + [(3, 3), (-5, 100)]
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(len(label)):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "test"), few)
    assert {r.node: r.component for r in found.collect()} == label


def test_best_matches_are_best_at_every_size(spark):
    import itertools
    import random

    rng = random.Random(4)
    rows, best = [], {}
    for group in range(40):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        score = {(i, j): rng.choice([0.0, 0.25, 0.5, rng.random()]) for i in range(n) for j in range(m) if rng.random() < 0.8}
        rows += [(f"g{group}", i, j, s) for (i, j), s in score.items()]
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        totals = []
        for chosen in itertools.permutations(large, len(small)):
            own = [score.get((a, b) if n <= m else (b, a)) for a, b in zip(small, chosen, strict=True)]
            totals.append((sum(s for s in own if s is not None), sum(s is not None for s in own)))
        best[f"g{group}"] = max((round(t, 6), k) for t, k in totals)
    rows += [("big", i, j, 1.0 if i == j else 0.9 if j == i + 1 else 0.1) for i in range(30) for j in range(30)]
    rows += [("trap", 0, 0, 1.0), ("trap", 0, 1, 0.9), ("trap", 1, 0, 0.9), *[("trap", i, i, 0.0) for i in range(2, 13)]]
    found = metrics.best_matches(spark.createDataFrame(rows, "g string, gold long, found long, score double"), "g").collect()
    by = {}
    for r in found:
        by.setdefault(r.g, []).append(r)
    for g, own in by.items():
        assert len({r.gold for r in own}) == len({r.found for r in own}) == len(own)
        if g in best:
            assert (round(sum(r.score for r in own), 6), len(own)) == best[g]
    assert sum(r.score for r in by["big"]) == 30 and sum(r.score for r in by["trap"]) == 1.8


def test_exact_tails_of_large_numbers(spark):
    import math
    from fractions import Fraction

    for b, c in ((1, 8), (40, 60), (5, 300), (450, 550), (0, 12), (7, 7)):
        n, k = b + c, min(b, c)
        exact = min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n)))
        assert metrics.mcnemar_p(b, c) == pytest.approx(exact, rel=1e-9)
    assert metrics.mcnemar_p(499_000, 501_000) == pytest.approx(0.0456, abs=2e-4)  # a million pairs, by the normal law
    low, high = metrics.clopper_pearson(spark.createDataFrame([(300_000, 1_000_000)], "k long, n long"), "k", "n").select("low", "high").first()
    assert low == pytest.approx(0.299102, abs=2e-5) and high == pytest.approx(0.3009, abs=2e-5)


def test_texts_without_words_are_not_contaminated(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "!!"), (4, "a b c"), (5, "x a b c y")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " - "), (8, "A b, c"), (9, None)], "item_id long, text string")
    assert {(r.item_id, r.doc_id) for r in neardup.contamination(docs, items).collect()} == {(8, 4)}


def test_exact_split_of_groups_with_nulls_and_few_rows(spark):
    import hashlib

    rows = [(i, [None, "a", "b", "b"][i % 4] if i < 200 else "hot") for i in range(1000)] + [(5000, "one")]
    found = splits.exact_split(spark.createDataFrame(rows, "id long, g string"), "id", 0.1, by=["g"]).collect()
    for g in (None, "a", "b", "hot", "one"):
        own = sorted((r.id for r in found if r.g == g), key=lambda i: hashlib.md5(f"0|{i}".encode()).hexdigest())
        assert {r.id for r in found if r.g == g and r.split == "val"} == set(own[: max(1, len(own) // 10)])
    assert len(found) == 1001 and found[0].asDict().keys() == {"id", "g", "split"}


def purged(rows, priority, most=25, prefix=12, most_prefix=50, threshold=0.8, n=8):
    """Ids that ``rare_gram_purge`` drops, by brute force over (id, text, split); an id has one split."""
    words = [(i, re.sub("[^a-z0-9 ]", " ", (t or "").lower()).split()) for i, t, _ in rows]
    grams, heads, split = defaultdict(set), defaultdict(list), {i: s for i, _, s in rows}
    for i, w in words:
        grams[i] |= {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set()
        if w:
            heads[tuple(w[:prefix])].append(i)
    holders = defaultdict(set)
    for i, own in grams.items():
        for g in own:
            holders[g].add(i)
    groups = [h for h in holders.values() if len(h) <= most] + [set(h) for h in heads.values() if len(h) <= most_prefix]
    out = set()
    for group in groups:
        for a, b in itertools.combinations(sorted(i for i in group if i is not None), 2):
            both = len(grams[a] & grams[b])
            if split[a] != split[b] and both > (len(grams[a]) + len(grams[b]) - both) * threshold:
                out.add(a if priority[split[a]] > priority[split[b]] else b)
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rare_gram_purge_by_brute_force(spark, kind):
    rng = random.Random(7)
    name = int if kind == "long" else "d{:03}".format
    word = lambda: f"w{rng.randrange(400)}"
    common = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.choice([3, 7, 8, 9, 60, 200]))] for _ in range(60)]
    rows = []
    for k in range(400):
        w = list(rng.choice(bases[:45] if k % 3 else bases[45:]))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = word()
        rows.append((name(k), " ".join(w + common * (k % 4 == 0)), ["train", "val", "test"][k % 7 % 3]))
    rows += [(name(900), None, "val"), (name(901), " -- ", "train"), (None, " ".join(bases[0]), "test"), (None, " ".join(bases[1]), "test")]
    rows += [(i, " ".join(rng.choice(bases)), s) for i, _, s in rows[:60]] + rows[60:90]  # ids that repeat
    priority = {"val": 0, "test": 0, "train": 1}
    wanted = purged(rows, priority)
    df = spark.createDataFrame(rows, f"id {kind}, text string, split string")
    got = [r.id for r in neardup.rare_gram_purge(df, "split", priority).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 20
    assert purged(rows, priority, most=3, most_prefix=2) != wanted
    assert {r.id for r in neardup.rare_gram_purge(df.repartition(3), "split", priority, most=3, most_prefix=2).collect()} == purged(rows, priority, most=3, most_prefix=2)


def test_rare_gram_purge_moves_no_gram_texts(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(f"{rng.randrange(10**5):05}" for _ in range(600)), "val" if k % 5 else "train") for k in range(600)]
    df = spark.createDataFrame(rows, "id long, text string, split string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert neardup.rare_gram_purge(df, "split", {"val": 0, "train": 1}).count() == 0
    assert 0 < written() - before < 6 * sum(len(t) for _, t, _ in rows)
