"""The collection algebra over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as X
from ..operators import collection as C
from . import Registry, table

R = Registry()


def r2(x: str, places: int = 2) -> str:
    """SQL that rounds a double as Spark does: half up on its shortest decimal form."""
    return f"round(({x})::VARCHAR::DECIMAL(34, 16), {places})::DOUBLE"


@R.add("SELECT l_orderkey, l_linenumber, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 45")
def filter_predicate(spark: SparkSession, sf: str) -> DataFrame:
    found = C.filter_rows(table(spark, sf, "lineitem"), "l_shipdate < '1996-01-01' AND l_quantity > 45")
    return found.select("l_orderkey", "l_linenumber", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))


@R.add("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 1")
def filter_argmin(spark: SparkSession, sf: str) -> DataFrame:
    shipped = C.filter_rows(table(spark, sf, "lineitem"), "l_shipdate < '1996-01-01'")
    own = shipped.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return C.arg_extreme(own, "l_extendedprice", "min", ["l_orderkey", "l_linenumber"])


@R.add(
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(o_totalprice, 0) DESC, o_orderkey) AS r FROM orders) WHERE r = 1"
)
def argmax_by_group(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return C.arg_extreme(own, "o_totalprice", "max", ["o_orderkey"], by=["o_custkey"])


@R.add(f"SELECT o_orderkey, {r2('o_totalprice * 1.1::DOUBLE')} AS gross, lower(o_orderstatus) AS status FROM orders")
def transform_project(spark: SparkSession, sf: str) -> DataFrame:
    changed = C.transform_rows(table(spark, sf, "orders"), gross="round(o_totalprice * 1.1D, 2)", status="lower(o_orderstatus)")
    return C.extract_fields(changed, ["o_orderkey", "gross", "status"])


@R.add("SELECT p_partkey, p_brand, CAST(NULL AS VARCHAR) AS p_colour FROM part")
def extract_missing_field(spark: SparkSession, sf: str) -> DataFrame:
    return C.extract_fields(table(spark, sf, "part"), ["p_partkey", "p_brand", "p_colour"])


@R.add(
    "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1"
)
def dedup_rows(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    return C.dedup_rows(own, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@R.add("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def dedup_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return C.dedup_rows(table(spark, sf, "customer").select("c_mktsegment", "c_nationkey"))


@R.add("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY coalesce(c_acctbal, 0) DESC, c_custkey LIMIT 20")
def sort_topk(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return C.sort_rows(own, "c_acctbal", "desc", ["c_custkey"]).limit(20)


@R.add(
    "SELECT c_name AS name, c_nationkey AS nationkey, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier"
)
def concat_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").selectExpr("c_name AS name", "c_nationkey AS nationkey", "c_mktsegment AS segment")
    return C.concat_rows(a, table(spark, sf, "supplier").selectExpr("s_name AS name", "s_nationkey AS nationkey"))


@R.add("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS joined FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def string_join(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return C.join_strings(both, "n_name", ", ", ["n_name"], by=["r_name"])


@R.add(
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, min(l_discount) AS min_disc, max(l_discount) AS max_disc, count(*) AS n FROM lineitem GROUP BY ALL"
)
def agg_basic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        C.total("l_quantity").alias("sum_qty"),
        C.mean("l_extendedprice").alias("avg_price"),
        F.min("l_discount").alias("min_disc"),
        F.max("l_discount").alias("max_disc"),
        F.count("*").alias("n"),
    )


@R.add("SELECT round(coalesce(sum(l_quantity), 0), 2)::DOUBLE AS total, round(coalesce(avg(l_quantity), 0), 2)::DOUBLE AS mean, count(*) AS n FROM lineitem WHERE l_quantity < 0")
def agg_empty_default(spark: SparkSession, sf: str) -> DataFrame:
    none = C.filter_rows(table(spark, sf, "lineitem"), "l_quantity < 0")
    return none.agg(C.total("l_quantity").alias("total"), C.mean("l_quantity").alias("mean"), F.count("*").alias("n"))


@R.add(f"SELECT l_orderkey, l_linenumber, {r2('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} AS charge FROM lineitem")
def calculate_expr(spark: SparkSession, sf: str) -> DataFrame:
    names = ["l_extendedprice", "l_discount", "l_tax"]
    value = C.calculate("round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2)", names)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", value.alias("charge"))


@R.add("SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge, false AS unknown FROM part")
def compare_ops(spark: SparkSession, sf: str) -> DataFrame:
    ops = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "unknown": "~"}
    size = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", *[C.compare(size, op, F.lit(10)).alias(n) for n, op in ops.items()])


RATES = (("F", "EUR", 0.9), ("O", "EUR", 1.1), ("F", "GBP", 0.8))


@R.add(
    f"SELECT o_orderkey, o_orderstatus, {r2('o_totalprice * rate')} AS converted FROM orders LEFT JOIN (VALUES ('F', 0.9::DOUBLE), ('O', 1.1::DOUBLE)) r(s, rate) ON o_orderstatus = s"
)
def convert_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates = spark.createDataFrame(RATES, "from string, to string, rate double")
    own = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return C.convert(own, "o_totalprice", rates, F.col("o_orderstatus"), F.lit("EUR")).drop("o_totalprice")


@R.add(
    f"""SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN 'skipped' WHEN o_orderstatus = 'F' AND o_totalprice <= 100000 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN {r2('o_totalprice * 0.9::DOUBLE')} WHEN o_orderstatus NOT IN ('P', 'F') THEN {r2('o_totalprice')} END AS value
FROM orders"""
)
def guard_select(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    cut = C.guarded(price > 100000, F.round(price * 0.9, 2))
    whole = F.struct(F.lit("ok").alias("status"), F.round(price, 2).alias("value"))
    cond = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    return table(spark, sf, "orders").withColumn("v", C.select_phi(cond, cut, whole)).select("o_orderkey", "v.status", "v.value")


@R.add("SELECT l_orderkey, bool_and(l_quantity <= 45) AS verified, count(*) FILTER (WHERE NOT l_quantity <= 45) AS n_failed FROM lineitem GROUP BY l_orderkey")
def verify_gate(spark: SparkSession, sf: str) -> DataFrame:
    return C.verify(table(spark, sf, "lineitem"), "l_quantity <= 45", by=["l_orderkey"])


@R.add("SELECT o_orderkey FROM orders WHERE o_totalprice > 1.5 * (SELECT round(avg(o_totalprice), 2) FROM orders)")
def bind_scalar(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    bound = C.bind_scalars(orders, mean=orders.agg(C.mean("o_totalprice").alias("m")))
    return bound.where("o_totalprice > 1.5 * mean").select("o_orderkey")


@R.add("SELECT event_id, (props::JSON->>'k')::INTEGER AS k FROM events")
def field_path_json(spark: SparkSession, sf: str) -> DataFrame:
    parsed = table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return parsed.select("event_id", paths.extract_variant(F.col("v"), "k", "int").alias("k"))


@R.add(
    "SELECT o_custkey, [o_orderkey, o_orderkey + 1] AS pair, o_orderkey AS first_key FROM orders"
)
def make_list_path(spark: SparkSession, sf: str) -> DataFrame:
    nested = table(spark, sf, "orders").select("o_custkey", F.struct(C.make_list(F.col("o_orderkey"), F.col("o_orderkey") + 1).alias("keys")).alias("v"))
    return nested.select("o_custkey", F.col("v.keys").alias("pair"), paths.extract(F.col("v"), "keys[0]").alias("first_key"))


QUERY = """SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
GROUP BY n_name HAVING count(*) > 10"""


@R.add(QUERY.format(orders="orders", customer="customer", nation="nation"))
def query_db_sql(spark: SparkSession, sf: str) -> DataFrame:
    return C.query_db(spark, QUERY, **{t: table(spark, sf, t) for t in ("orders", "customer", "nation")})


WORDS = ["license", "version", "rights", "public"]


@R.add(
    "SELECT doc_id, score FROM (SELECT doc_id, "
    + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INTEGER" for w in WORDS)
    + " AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10"
)
def search_keyword(spark: SparkSession, sf: str) -> DataFrame:
    return C.search(table(spark, sf, "documents"), "text", WORDS, 10, "doc_id").select("doc_id", "score")


@R.add("SELECT page_id, length(html) AS n FROM pages WHERE url = (SELECT url FROM pages WHERE page_id = 7)")
def fetch_page(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    url = pages.where("page_id = 7").select("url")
    bound = C.bind_scalars(pages, wanted=url)
    return bound.where("url = wanted").select("page_id", F.length("html").cast("long").alias("n"))


@R.add("SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def lookup_left_join(spark: SparkSession, sf: str) -> DataFrame:
    return C.lookup(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


@R.add(
    "SELECT c_custkey, true AS has_orders FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)"
)
def semi_anti_membership(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey")
    orders = table(spark, sf, "orders").selectExpr("o_custkey AS c_custkey")
    inside, outside = C.members(customers, orders, ["c_custkey"]), C.members(customers, orders, ["c_custkey"], keep=False)
    return inside.withColumn("has_orders", F.lit(True)).unionByName(outside.withColumn("has_orders", F.lit(False)))


@R.add("SELECT o_orderkey, 2 AS n, o_orderstatus AS status, o_orderkey::VARCHAR AS key, coalesce(nullif(o_orderstatus, 'P'), 'none') AS merged FROM orders")
def merge_values(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    raw = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("key"), F.lit("raw"))
    merged = C.merge_maps(raw, F.create_map(F.lit("key"), key))
    return orders.select(
        "o_orderkey",
        F.size(merged).alias("n"),
        merged["status"].alias("status"),
        merged["key"].alias("key"),
        C.merge_values(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("none")).alias("merged"),
    )


@R.add(
    "SELECT url, regexp_extract(url, '[^/]*$') AS terminal, len(list_filter(string_split(url, '/'), lambda s: s <> ''))::INTEGER AS depth, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages"
)
def path_string_functions(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "url", X.path_terminal(url).alias("terminal"), X.path_depth(url).alias("depth"), F.regexp_extract(url, "^[a-z]+://([^/]+)", 1).alias("host")
    )


@R.add(
    """SELECT c_custkey, CASE WHEN c_name = c_custkey::VARCHAR THEN 'same'
  WHEN (regexp_replace(c_name, '[^0-9]', '', 'g') <> '' AND ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0') = c_custkey::VARCHAR) THEN 'format' ELSE 'different' END AS difference FROM customer"""
)
def format_only_difference(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.regexp_replace("c_name", "^[^0-9]*0*", "")
    key = F.col("c_custkey").cast("string")
    kind = F.when(F.col("c_name") == key, "same").otherwise(X.format_difference(F.concat(F.lit("#"), bare), key))
    return table(spark, sf, "customer").select("c_custkey", kind.alias("difference"))


@R.add(
    """SELECT event_id, event_type, CASE WHEN regexp_matches(event_type, 'view|click|search') THEN 'read' WHEN regexp_matches(event_type, 'purchase|cart|order') THEN 'write'
  ELSE 'other' END AS effect FROM events"""
)
def rule_classify(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("view|click|search", "read"), ("purchase|cart|order", "write")]
    return table(spark, sf, "events").select("event_id", "event_type", X.first_match(F.col("event_type"), rules, "other").alias("effect"))


SQL_TEXTS = (
    (1, "SELECT a FROM t WHERE a > 1 ORDER BY a LIMIT 3"),
    (2, "SELECT count(*) FROM t JOIN u ON t.a = u.a GROUP BY b HAVING count(*) > 1"),
    (3, "SELECT DISTINCT a FROM t"),
)


@R.add(
    "SELECT id, "
    + ", ".join(
        f"regexp_matches(lower(q), '{p}') AS {n}"
        for n, p in {
            "has_where": r"\bwhere\b",
            "has_group": r"\bgroup\s+by\b",
            "has_having": r"\bhaving\b",
            "has_order": r"\border\s+by\b",
            "has_limit": r"\blimit\b",
            "has_join": r"\bjoin\b",
            "has_aggregate": r"\b(count|sum|avg|min|max)\s*\(",
            "has_distinct": r"\bdistinct\b",
        }.items()
    )
    + " FROM (VALUES "
    + ", ".join(f"({i}, '{q}')" for i, q in SQL_TEXTS)
    + ") t(id, q)"
)
def sql_feature_flags(spark: SparkSession, sf: str) -> DataFrame:
    texts = spark.createDataFrame(SQL_TEXTS, "id int, q string")
    return texts.select("id", *[c.alias(n) for n, c in X.sql_features(F.col("q")).items()])


@R.add("SELECT c_custkey, contains(trim(c_name), trim(c_mktsegment)) OR contains(trim(c_mktsegment), trim(c_name)) OR contains(c_name, c_custkey::VARCHAR) AS alike FROM customer")
def loose_match(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("c_name")
    alike = X.loose_match(name, F.col("c_mktsegment")) | X.loose_match(name, F.col("c_custkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", alike.alias("alike"))


ASKED = "'Show the ' || CASE l_linenumber WHEN 1 THEN 'cheapest' WHEN 2 THEN 'largest' WHEN 3 THEN 'average' WHEN 4 THEN 'number of' ELSE 'sorted' END || ' items'"
DONE = "CASE WHEN l_returnflag = 'R' THEN 'MIN' WHEN l_returnflag = 'A' THEN 'COUNT' ELSE 'AVG' END"


@R.add(
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, {DONE} AS op, CASE WHEN l_linestatus = 'O' THEN 'select x order by y' ELSE '' END AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber
  WHEN 1 THEN CASE WHEN op <> 'MIN' AND NOT contains(q, 'order by') THEN 'MISSING_CONSTRAINT:optimization(min)' ELSE '' END
  WHEN 2 THEN 'MISSING_CONSTRAINT:optimization(max)' WHEN 3 THEN CASE WHEN op <> 'AVG' THEN 'MISSING_CONSTRAINT:average' ELSE '' END
  WHEN 4 THEN CASE WHEN op <> 'COUNT' THEN 'MISSING_CONSTRAINT:count' ELSE '' END
  ELSE CASE WHEN NOT contains(q, 'order by') THEN 'MISSING_CONSTRAINT:sort' ELSE '' END END AS missing FROM t"""
)
def missing_constraints(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.when(F.col("l_linestatus") == "O", "SELECT x ORDER BY y")
    found = X.missing_constraints(F.expr(ASKED), F.array(F.expr(DONE)), payload)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(found, ",").alias("missing"))


@R.add(
    "SELECT p_partkey, p_size::DOUBLE = 10 OR p_size % 7 = 0 AS by_number, upper(p_brand) IN ('BRAND#11', 'BRAND#23') AS by_text, p_size > 25 AS optional FROM part"
)
def accepted_values(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    sevens = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: (i * 7).cast("string"))
    given = F.when(F.col("p_size") <= 25, F.lit("never"))
    return table(spark, sf, "part").select(
        "p_partkey",
        X.accepted(size, F.concat(F.array(F.lit("10.0")), sevens)).alias("by_number"),
        X.accepted(F.col("p_brand"), F.array(F.lit("brand 11"), F.lit("Brand#11"), F.lit("brand#23"))).alias("by_text"),
        X.accepted(given, F.array(F.lit(""), F.lit("x"))).alias("optional"),
    )
