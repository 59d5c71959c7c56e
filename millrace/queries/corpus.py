"""Corpus statistics, near-duplicates, leakage, splits and samples over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus, neardup, splits
from . import Registry, spread, table
from .core import r2

R = Registry()

NORM = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
TOKS = f"list_filter(string_split({NORM}, ' '), lambda t: t <> '' AND NOT list_contains({STOP}, t))"


def docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "documents").select(*(columns or ("*",)))


@R.add(
    f"""SELECT source, count(*) AS n, count(*) FILTER (WHERE quality IS NOT NULL) AS n_labelled,
  {r2('count(*) FILTER (WHERE quality IS NOT NULL) * 100.0::DOUBLE / count(*)')} AS pct_labelled,
  count(*) FILTER (WHERE quality = 1) AS n_good, {r2('count(*) FILTER (WHERE quality = 1) * 100.0::DOUBLE / count(*)')} AS pct_good
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"""
)
def coverage_by_source(spark: SparkSession, sf: str) -> DataFrame:
    both = docs(spark, sf, "doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return corpus.coverage(both, ["source"], labelled="quality IS NOT NULL", good="quality = 1")


@R.add(
    f"""WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(n) AS n, {r2('avg(n_chars)')} AS mean, median(n_chars) AS median, min(n_chars) AS min, max(n_chars) AS max,
  max(CASE WHEN k = round_even(0.9 * (n - 1), 0)::BIGINT + 1 THEN n_chars END) AS p90 FROM r GROUP BY lang"""
)
def distribution_summary(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.distribution(docs(spark, sf, "lang", "n_chars"), "n_chars", ["lang"])


@R.add(
    "WITH t AS (SELECT floor(n_chars / 3.5)::BIGINT + 1 AS tokens FROM documents), r AS (SELECT tokens, row_number() OVER (ORDER BY tokens) AS k, count(*) OVER () AS n FROM t) SELECT max(n) AS n, max(tokens) AS max_tokens, "
    + ", ".join(f"{r2(f'avg((tokens > {x})::INTEGER)', 4)} AS over_{x}" for x in (1024, 1536, 2048))
    + ", "
    + ", ".join(f"max(CASE WHEN k = round_even({q / 100} * (n - 1), 0)::BIGINT + 1 THEN tokens END) AS p{q}" for q in (50, 90, 95, 99))
    + " FROM r"
)
def token_length_audit(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.token_length_audit(docs(spark, sf, "n_chars"), "n_chars")


@R.add(
    "SELECT md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS key, count(*) AS n, count(DISTINCT role) AS n_outcomes, count(DISTINCT conv_id) AS n_contexts, count(DISTINCT conv_id) > 1 AS context_differs FROM conversations GROUP BY 1 HAVING count(DISTINCT role) > 1"
)
def ambiguity_groups(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.ambiguity(table(spark, sf, "conversations"), F.md5(X.collapse(F.col("text"))), "role", "conv_id")


@R.add(
    """SELECT d.doc_id, CASE WHEN list_contains(k, 'fallback') OR source = 'src0' THEN 'C' WHEN list_contains(k, 'heuristic') THEN 'B' ELSE 'A' END AS tier FROM
 (SELECT d.doc_id, source, [CASE WHEN quality IS NULL THEN 'heuristic' WHEN quality = 0 THEN 'fallback' ELSE 'exact' END] AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) d"""
)
def quality_tier(spark: SparkSession, sf: str) -> DataFrame:
    both = docs(spark, sf, "doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    kind = F.when(F.col("quality").isNull(), "heuristic").when(F.col("quality") == 0, "fallback").otherwise("exact")
    return both.select("doc_id", corpus.quality_tier(F.array(kind), F.col("source") == "src0").alias("tier"))


@R.add(
    "SELECT 'kind:' || kind AS measure, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN 'exact' WHEN event_type = 'click' THEN 'heuristic' ELSE 'fallback' END AS kind FROM events) GROUP BY 1 UNION ALL SELECT 'fallback:' || CASE WHEN bool_and(f) THEN 'all' WHEN bool_or(f) THEN 'some' ELSE 'none' END, 0 FROM (SELECT user_id, event_type NOT IN ('view', 'click') AS f FROM events) GROUP BY user_id HAVING false UNION ALL SELECT 'fallback:' || c, count(*) FROM (SELECT CASE WHEN bool_and(f) THEN 'all' WHEN bool_or(f) THEN 'some' ELSE 'none' END AS c FROM (SELECT user_id, event_type NOT IN ('view', 'click') AS f FROM events) GROUP BY user_id) GROUP BY c"
)
def provenance_mix(spark: SparkSession, sf: str) -> DataFrame:
    kind = X.first_match(F.col("event_type"), [("^view$", "exact"), ("^click$", "heuristic")], "fallback")
    return corpus.provenance_mix(table(spark, sf, "events").select("user_id", kind.alias("kind")), "user_id", "kind")


@R.add(
    "SELECT CASE WHEN contains(lower(text), 'license') THEN 'parse' WHEN contains(lower(text), 'rights') THEN 'type' ELSE left(lang, 40) END AS reason, count(*) AS n FROM documents GROUP BY 1"
)
def reason_buckets(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    reason = F.when(F.contains(low, F.lit("license")), "Parse error").when(F.contains(low, F.lit("rights")), "bad TYPE").otherwise(F.col("lang"))
    return corpus.histogram(docs(spark, sf, "text", "lang").select(corpus.bucket_reason(reason).alias("reason")), "reason")


@R.add(
    f"SELECT lang, sum(n_chars)::BIGINT AS weight, {r2('sum(quality * n_chars)::DOUBLE / sum(n_chars)::DOUBLE', 4)} AS mean FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang"
)
def weighted_rollup(spark: SparkSession, sf: str) -> DataFrame:
    both = docs(spark, sf, "doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return corpus.weighted_rollup(both, ["lang"], "quality", "n_chars")


@R.add(
    f"""SELECT {r2("sum(CASE WHEN lang = 'en' THEN quality * n_chars ELSE 0 END)::DOUBLE / sum(CASE WHEN lang = 'en' THEN n_chars ELSE 0 END)::DOUBLE", 4)} AS seen,
  {r2("sum(CASE WHEN lang <> 'en' THEN quality * n_chars ELSE 0 END)::DOUBLE / sum(CASE WHEN lang <> 'en' THEN n_chars ELSE 0 END)::DOUBLE", 4)} AS unseen
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
)
def seen_unseen_rollup(spark: SparkSession, sf: str) -> DataFrame:
    both = docs(spark, sf, "doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return corpus.seen_unseen(both, "lang = 'en'", "quality", "n_chars")


@R.add(
    """SELECT source, doc_id, n_chars, lang, priority FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority, n_chars, doc_id) AS r FROM
  (SELECT source, doc_id, n_chars, lang, CASE WHEN n_chars BETWEEN 500 AND 1000 THEN 1 WHEN lang = 'en' THEN 2 ELSE 3 END AS priority FROM documents)) WHERE r = 1"""
)
def priority_choice(spark: SparkSession, sf: str) -> DataFrame:
    rule = F.when(F.col("n_chars").between(500, 1000), 1).when(F.col("lang") == "en", 2).otherwise(3)
    return corpus.prioritized(docs(spark, sf, "source", "doc_id", "n_chars", "lang"), ["source"], rule, ["n_chars", "doc_id"])


def _value(c: str) -> str:
    return f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, 'null')"


@R.add(
    f"""WITH r AS (SELECT lang, ('0x' || substr(md5(concat_ws('|', {', '.join(_value(c) for c in ('doc_id', 'text', 'lang', 'source', 'n_chars'))})), 1, 15))::BIGINT AS h FROM documents)
SELECT lang, count(*) AS n, sha256(concat_ws('|', count(*), sum(h), bit_xor(h))) AS sha256 FROM r GROUP BY lang"""
)
def table_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.manifest(docs(spark, sf, "doc_id", "text", "lang", "source", "n_chars"), ["lang"])


@R.add(f"SELECT doc_id, len({TOKS})::INTEGER AS n_tokens, md5({NORM}) AS norm_md5 FROM documents")
def text_normalize_tokens(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return spread(docs(spark, sf, "doc_id", "text"), "doc_id").select("doc_id", F.size(X.tokens(text)).alias("n_tokens"), F.md5(X.normalize(text)).alias("norm_md5"))


@R.add("SELECT doc_id, md5(replace(lower(regexp_replace(source || '-' || lang || '.x', '[ ,./\\-_*^]', '', 'g')), '''', '\"')) AS std FROM documents")
def standardize_values(spark: SparkSession, sf: str) -> DataFrame:
    value = F.concat_ws("-", "source", F.concat("lang", F.lit(".x")))
    return docs(spark, sf, "doc_id", "source", "lang").select("doc_id", F.md5(X.standardize(value)).alias("std"))


@R.add(f"SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY md5({NORM}) HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.exact_groups(docs(spark, sf, "doc_id", "text"), "doc_id", "text")


SIG = ", ".join(f"list_min(list_transform(toks, lambda t: substr(md5('{s}|' || t), 1, 16)))" for s in range(neardup.PERMUTATIONS))
SIGNED = f"""k AS (SELECT doc_id AS id, CASE WHEN len(t0) > 0 THEN list_distinct(t0) ELSE ['<empty>'] END AS toks FROM (SELECT doc_id, {TOKS} AS t0 FROM documents)),
sg AS (SELECT id, [{SIG}] AS sig FROM k)"""


@R.add(f"WITH {SIGNED} SELECT id, md5(array_to_string(sig, '')) AS sig_md5 FROM sg")
def minhash_signature(spark: SparkSession, sf: str) -> DataFrame:
    signed = neardup.signatures(spread(docs(spark, sf, "doc_id", "text"), "doc_id"), "doc_id", "text")
    return signed.select("id", F.md5(F.array_join("sig", "")).alias("sig_md5"))


BANDED = f"""{SIGNED}, bd AS (SELECT id, b AS band, array_to_string(sig[b * 4 + 1:b * 4 + 4], '') AS key FROM sg, range(8) r(b))"""


@R.add(
    f"WITH {BANDED}, h AS (SELECT band, key, min(id) AS head FROM bd GROUP BY ALL HAVING count(*) > 1) SELECT DISTINCT id AS src, head AS dst FROM bd JOIN h USING (band, key) WHERE id <> head"
)
def lsh_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.candidate_links(spread(docs(spark, sf, "doc_id", "text"), "doc_id"), "doc_id", "text")


@R.add(
    f"""WITH RECURSIVE {BANDED}, h AS (SELECT band, key, min(id) AS head FROM bd GROUP BY ALL HAVING count(*) > 1),
e AS (SELECT DISTINCT id AS a, head AS b FROM bd JOIN h USING (band, key) WHERE id <> head),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT id AS n, id AS m FROM k UNION SELECT l.b, w.m FROM w JOIN l ON l.a = w.n)
SELECT n AS id, min(m) AS family FROM w GROUP BY n"""
)
def dup_families(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.families(spread(docs(spark, sf, "doc_id", "text"), "doc_id"), "doc_id", "text")


NEAR = f"""k AS (SELECT doc_id AS id, list_sort(list_distinct({TOKS})) AS toks FROM documents), z AS (SELECT min(id) AS id, toks, list(id) AS ids FROM k WHERE len(toks) > 0 GROUP BY toks),
sg AS (SELECT id, [{SIG}] AS sig FROM z), bd AS (SELECT id, b AS band, array_to_string(sig[b * 4 + 1:b * 4 + 4], '') AS key FROM sg, range(8) r(b)),
p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bd x JOIN bd y USING (band, key) WHERE x.id < y.id),
j AS (SELECT a, b, len(list_intersect(x.toks, y.toks))::DOUBLE / len(list_distinct(list_concat(x.toks, y.toks))) AS similarity FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b),
near AS (SELECT a, b, {r2('similarity', 6)} AS similarity FROM j WHERE similarity >= 0.8 UNION ALL SELECT id, unnest(list_filter(ids, lambda i: i > id)), 1.0::DOUBLE FROM z)"""


@R.add(f"WITH {NEAR} SELECT a, b, similarity FROM near")
def near_dup_verified(spark: SparkSession, sf: str) -> DataFrame:
    found = neardup.verified_pairs(spread(docs(spark, sf, "doc_id", "text"), "doc_id"), "doc_id", "text")
    return found.withColumn("similarity", F.round("similarity", 6))


HASH = "md5('{seed}|' || doc_id::VARCHAR)"
H0 = HASH.format(seed=0)


@R.add(
    f"SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {H0}, doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY lang) * 0.05::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM documents"
)
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.exact_split(docs(spark, sf, "doc_id", "lang"), "doc_id", 0.05, by=["lang"]).select("doc_id", "split")


FAMILY = f"SELECT min(doc_id) OVER (PARTITION BY md5({NORM})) AS family, doc_id, text FROM documents"


def _families(spark: SparkSession, sf: str) -> DataFrame:
    """Exact families: (family, n), named by the smallest id."""
    own = docs(spark, sf, "doc_id", "text").groupBy(F.md5(X.normalize(F.col("text"))).alias("k"))
    return own.agg(F.min("doc_id").alias("family"), F.count("*").alias("n")).drop("k")


SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


@R.add(
    f"""WITH RECURSIVE f AS (SELECT family, count(*) AS n FROM ({FAMILY}) GROUP BY family), o AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || family::VARCHAR), family) AS i, sum(n) OVER ()::DOUBLE AS total FROM f),
w AS (SELECT 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, '' AS split UNION ALL
  SELECT i, a + CASE WHEN split = 'train' THEN n ELSE 0 END, b + CASE WHEN split = 'val' THEN n ELSE 0 END, c + CASE WHEN split = 'test' THEN n ELSE 0 END, split FROM
    (SELECT o.i, o.n, w.a, w.b, w.c, CASE WHEN x >= y AND x >= z THEN 'train' WHEN y >= z THEN 'val' ELSE 'test' END AS split FROM w JOIN
      (SELECT *, total * 0.8::DOUBLE AS ta, total * 0.1::DOUBLE AS tb FROM o) o ON o.i = w.i + 1, LATERAL (SELECT (ta - w.a) / ta AS x, (tb - w.b) / tb AS y, (tb - w.c) / tb AS z)))
SELECT family, n, split FROM o JOIN w USING (i)"""
)
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.greedy_family_split(_families(spark, sf), SHARES)


@R.add(
    f"""WITH f AS (SELECT family, count(*) AS n FROM ({FAMILY}) GROUP BY family), o AS (SELECT *, sum(n) OVER (ORDER BY md5('0|' || family::VARCHAR), family) - n AS before, sum(n) OVER () AS total FROM f)
SELECT family, n, CASE WHEN before::DOUBLE / total < 0.8::DOUBLE THEN 'train' WHEN before::DOUBLE / total < 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split FROM o"""
)
def cumulative_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.cumulative_family_split(_families(spark, sf), SHARES)


PLACE = "('0x' || substr({h}, 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"


def _bucketed(spark: SparkSession, sf: str) -> DataFrame:
    return splits.bucket_split(docs(spark, sf, "doc_id", "text", "source"), "doc_id", SHARES)


BUCKETED = f"(SELECT *, CASE WHEN {PLACE.format(h=H0)} < 0.8::DOUBLE THEN 'train' WHEN {PLACE.format(h=H0)} < 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split FROM documents)"


@R.add(
    f"WITH s AS (SELECT md5({NORM}) AS k, split, count(*) AS n FROM {BUCKETED} GROUP BY ALL) SELECT coalesce(sum(c), 0)::BIGINT AS exact_pairs FROM (SELECT sum(n) * (sum(n) - 1) / 2 - sum(n * (n - 1) / 2) AS c FROM s GROUP BY k)"
)
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.exact_leakage(_bucketed(spark, sf), "text", "split")


@R.add(f"SELECT source, count(DISTINCT split) AS n_splits FROM {BUCKETED} GROUP BY source HAVING count(DISTINCT split) > 1")
def split_isolation(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.spanning_keys(_bucketed(spark, sf), "source", "split")


@R.add(
    f"""WITH {NEAR}, s AS (SELECT doc_id AS id, list_position(['test', 'val', 'train'], split) AS r FROM {BUCKETED})
SELECT DISTINCT CASE WHEN x.r > y.r THEN a ELSE b END AS id FROM near JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE x.r <> y.r"""
)
def cross_split_purge(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.purge(_bucketed(spark, sf), "doc_id", "text", "split", ["test", "val", "train"])


WORDS = f"list_filter(string_split({NORM}, ' '), lambda w: w <> '')"


def _grams(source: str, key: str) -> str:
    w = f"(SELECT * FROM (SELECT {key}, {WORDS} AS w FROM {source}) WHERE len(w) > 0)"
    return f"(SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM {w})"


@R.add(
    f"""WITH g AS {_grams(BUCKETED, 'doc_id, split')}, w AS (SELECT doc_id, split, {WORDS} AS w FROM {BUCKETED}),
k AS (SELECT doc_id, split, g AS key FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) BETWEEN 2 AND 25) UNION ALL
  SELECT doc_id, split, key FROM (SELECT doc_id, split, array_to_string(w[1:12], ' ') AS key, count(*) OVER (PARTITION BY array_to_string(w[1:12], ' ')) AS n FROM w WHERE len(w) > 0) WHERE n BETWEEN 2 AND 50),
p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.split AS sa FROM k x JOIN k y USING (key) WHERE x.doc_id < y.doc_id AND x.split <> y.split),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), h AS (SELECT a, b, sa, count(*) AS h FROM p JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b AND x.g = y.g GROUP BY ALL)
SELECT DISTINCT CASE WHEN sa = 'train' THEN a ELSE b END AS id FROM h JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE h > (x.n + y.n - h) * 0.8::DOUBLE"""
)
def rare_gram_purge(spark: SparkSession, sf: str) -> DataFrame:
    rows = _bucketed(spark, sf).select(F.col("doc_id").alias("id"), "text", "split")
    return neardup.rare_gram_purge(rows, "split", {"val": 0, "test": 0, "train": 1})


@R.add(
    f"""WITH i AS {_grams('benchmark', 'item_id')}, d AS {_grams('documents', 'doc_id')}, z AS (SELECT item_id, count(*) AS size FROM i GROUP BY item_id),
h AS (SELECT item_id, doc_id, count(*) AS hits FROM d JOIN i USING (g) GROUP BY ALL)
SELECT item_id, doc_id, {r2('hits::DOUBLE / size', 4)} AS contained FROM h JOIN z USING (item_id) WHERE hits >= size * 0.8::DOUBLE"""
)
def contamination(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.contamination(spread(docs(spark, sf, "doc_id", "text"), "doc_id"), table(spark, sf, "benchmark"))


@R.add(
    f"""WITH i AS {_grams('benchmark', 'item_id')}, d AS {_grams('documents', 'doc_id')}, z AS (SELECT item_id, count(*) AS size FROM i GROUP BY item_id),
h AS (SELECT DISTINCT doc_id FROM (SELECT item_id, doc_id, count(*) AS hits FROM d JOIN i USING (g) GROUP BY ALL) JOIN z USING (item_id) WHERE hits >= size * 0.8::DOUBLE),
b AS (SELECT DISTINCT {NORM} AS norm FROM benchmark WHERE {NORM} <> ''),
t AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE {NORM} IN (SELECT norm FROM b)) AS n_exact, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM h)) AS n_contained FROM documents GROUP BY source)
SELECT *, {r2('n_contained * 100.0::DOUBLE / n')} AS pct_contained, CASE WHEN n_contained::DOUBLE / n >= 0.2::DOUBLE THEN 'in_distribution' WHEN n_contained > 0 THEN 'near' ELSE 'out_of_distribution' END AS kind FROM t"""
)
def external_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.external_overlap(spread(docs(spark, sf, "doc_id", "text", "source"), "doc_id"), table(spark, sf, "benchmark"), "source")


@R.add(
    f"""WITH s AS (SELECT lang, source, count(*) AS z FROM documents GROUP BY ALL), q AS (SELECT *, {r2('100 * z::DOUBLE / sum(z) OVER ()', 0)}::BIGINT AS quota FROM s),
r AS (SELECT doc_id, lang, source, {H0} AS h, row_number() OVER (PARTITION BY lang, source ORDER BY {H0}, doc_id) AS k FROM documents)
SELECT doc_id, lang, source FROM r JOIN q USING (lang, source) ORDER BY (k > quota)::INTEGER, h, doc_id LIMIT 100"""
)
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_sample(docs(spark, sf, "doc_id", "lang", "source"), "doc_id", ["lang", "source"], 100)


@R.add(
    """WITH d AS (SELECT doc_id AS id, source AS g, lang AS l, lower(split_part(text, ' ', 1)) AS c FROM documents),
p AS (SELECT a.id, b.id AS negative, row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN a.g = b.g AND a.c = b.c THEN 0 WHEN a.g = b.g THEN 1 ELSE 2 END, md5('0|' || b.id::VARCHAR), b.id) AS rank FROM d a JOIN d b ON a.l <> b.l)
SELECT id, negative, rank::INTEGER AS rank FROM p WHERE rank <= 3"""
)
def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    cue = F.lower(F.split_part("text", F.lit(" "), F.lit(1)))
    return splits.hard_negatives(docs(spark, sf, "doc_id", "source", "lang", "text"), "doc_id", "source", "lang", cue, 3)


@R.add(
    """WITH own AS (SELECT conv_id, role AS name, 0 AS extra FROM conversations), names AS (SELECT DISTINCT lang || source AS name FROM documents),
b AS (SELECT conv_id, name, min(extra) AS extra FROM (SELECT * FROM own UNION ALL SELECT c.conv_id, n.name, 1 FROM (SELECT DISTINCT conv_id FROM conversations) c, names n) GROUP BY ALL)
SELECT conv_id, name, extra, (row_number() OVER (PARTITION BY conv_id ORDER BY extra, name))::INTEGER AS rank FROM b QUALIFY rank <= 5"""
)
def capped_pool(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    names = docs(spark, sf, "lang", "source").select(F.concat("lang", "source").alias("name")).distinct().orderBy("name").limit(5)
    others = turns.select("conv_id").distinct().join(F.broadcast(names))  # five names
    return splits.capped_pool(turns.withColumnRenamed("role", "name"), others, "conv_id", "name", 5)


BOOT_U = "('0x' || substr(md5(concat_ws('|', 0, replicate, doc_id)), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE"
CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


@R.add(
    f"""WITH d AS (SELECT replicate, quality, {' + '.join(f'(u >= {c}::DOUBLE)::INTEGER' for c in CUTS)} AS copies FROM (SELECT replicate, quality, {BOOT_U} AS u FROM labels, range(1, 201) r(replicate) WHERE quality IS NOT NULL)),
m AS (SELECT replicate, {r2('sum(copies * quality)::DOUBLE / sum(copies)::DOUBLE', 6)} AS mean FROM d GROUP BY replicate),
k AS (SELECT mean, row_number() OVER (ORDER BY mean) AS k FROM m)
SELECT max(CASE WHEN k = floor(0.025 * 200) + 1 THEN mean END) AS low, max(CASE WHEN k = floor(0.975 * 200) + 1 THEN mean END) AS high FROM k"""
)
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return splits.interval(splits.bootstrap(table(spark, sf, "labels"), "doc_id", "quality", 200))


def _boot(unit: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', 0, replicate, {unit})), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE"


BOUNDS = "k AS (SELECT mean, row_number() OVER (ORDER BY mean) AS k FROM m) SELECT max(CASE WHEN k = floor(0.025 * 200) + 1 THEN mean END) AS low, max(CASE WHEN k = floor(0.975 * 200) + 1 THEN mean END) AS high FROM k"
TIMES = " + ".join(f"(u >= {c}::DOUBLE)::INTEGER" for c in CUTS)


@R.add(
    f"""WITH c AS (SELECT conv_id, sum(length(text))::DOUBLE AS total, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
d AS (SELECT replicate, total, n, {TIMES} AS copies FROM (SELECT *, {_boot('conv_id')} AS u FROM c, range(1, 201) r(replicate))),
m AS (SELECT replicate, {r2('sum(copies * total)::DOUBLE / sum(copies * n)::DOUBLE', 6)} AS mean FROM d GROUP BY replicate), {BOUNDS}"""
)
def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The mean length of a turn; whole conversations are drawn."""
    turns = table(spark, sf, "conversations").select("conv_id", F.length("text").alias("n_chars"))
    return splits.interval(splits.cluster_bootstrap(turns, "conv_id", "n_chars", 200))


@R.add(
    f"""WITH v AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, (event_id % 3 = 0)::INTEGER::DOUBLE AS won FROM events),
p AS (SELECT user_id, avg(won) FILTER (WHERE arm = 'a') - avg(won) FILTER (WHERE arm = 'b') AS delta FROM v GROUP BY user_id HAVING delta IS NOT NULL),
d AS (SELECT replicate, delta, {TIMES} AS copies FROM (SELECT *, {_boot('user_id')} AS u FROM p, range(1, 201) r(replicate))),
m AS (SELECT replicate, {r2('sum(copies * delta)::DOUBLE / sum(copies)::DOUBLE', 6)} AS mean FROM d GROUP BY replicate), {BOUNDS}"""
)
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The difference of two arms' success over the users that have both; users are drawn with both."""
    runs = table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("arm"), (F.col("event_id") % 3 == 0).cast("double").alias("won"))
    deltas = splits.paired_deltas(runs, "user_id", "arm", "a", "b", "won")
    return splits.interval(splits.bootstrap(deltas, "user_id", "delta", 200))


@R.add("SELECT doc_id, left(lang || source, 3) AS head FROM documents")
def truncated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf, "doc_id", "lang", "source").select("doc_id", F.left(F.concat("lang", "source"), F.lit(3)).alias("head"))
