"""Queries: classification, look-ups, set operations, ranking and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import relational as R
from terrane.plans.registry import Registry
from terrane.session import table

registry = Registry()
query = registry.query

HASH31 = "((({seed} * 48271 + ({a} % 2147483648) * 69621 + 12345) % 2147483647) * 16807) % 2147483647"


def hash31_sql(key: str, seed: int = 17) -> str:
    return "(" + HASH31.format(seed=seed, a=key) + ")"


@query("""SELECT p_partkey, CASE WHEN p_size < 5 THEN 'shed' WHEN p_type IN ('ECONOMY', 'SMALL') AND p_size < 25 THEN 'house'
  WHEN p_type = 'LARGE' OR p_size > 45 THEN 'hall' WHEN p_name LIKE '%ring' THEN 'annex' ELSE 'other' END AS kind FROM part""")
def q_classify_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, kind = F.col("p_size"), F.col("p_type")
    rules = [
        (size < 5, "shed"),
        (kind.isin("ECONOMY", "SMALL") & (size < 25), "house"),
        ((kind == "LARGE") | (size > 45), "hall"),
        (F.col("p_name").endswith("ring"), "annex"),
    ]
    return table(spark, sf_dir, "part").select("p_partkey", S.first_match(rules, "other").alias("kind"))


@query("""SELECT o_orderkey, CAST((CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) | (CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END)
  | (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 4 ELSE 0 END) | (CASE WHEN o_totalprice > 200000 THEN 8 ELSE 0 END) AS INTEGER) AS flags FROM orders""")
def q_context_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    flags = S.bit_flags([status == "F", status == "P", priority.isin("1-URGENT", "2-HIGH"), F.col("o_totalprice") > 200000])
    return table(spark, sf_dir, "orders").select("o_orderkey", flags.cast("int").alias("flags"))


@query("""SELECT event_id, hour(ts) >= 22 OR hour(ts) < 6 AS night FROM events""")
def q_wrap_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.in_wrapping_range(F.hour("ts"), 22, 6).alias("night"))


@query("""SELECT o_orderkey, (month(o_orderdate) * 100 + day(o_orderdate)) >= 1101 OR (month(o_orderdate) * 100 + day(o_orderdate)) <= 229 AS closed FROM orders""")
def q_season_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.in_season(F.col("o_orderdate"), (11, 1), (2, 29)).alias("closed"))


@query("""WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' AND value > 50 THEN 3 WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' AND k > 50 THEN -2
  WHEN event_type = 'error' THEN -1 WHEN event_type = 'signup' THEN 2 ELSE 0 END) AS BIGINT) AS score FROM e GROUP BY user_id""")
def q_event_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    delta = (
        F.when((kind == "purchase") & (F.col("value") > 50), 3)
        .when(kind == "purchase", 1)
        .when((kind == "error") & (k > 50), -2)
        .when(kind == "error", -1)
        .when(kind == "signup", 2)
        .otherwise(0)
    )
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(delta).alias("score"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_lookup_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("SELECT n_nationkey, n_name, coalesce(c_custkey, -1) AS c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900")
def q_lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9900")
    return table(spark, sf_dir, "nation").join(rich, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("c_custkey", F.lit(-1)).alias("c_custkey"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left_anti")


@query("""SELECT conv_id, coalesce(string_agg(md5(text), ' ' ORDER BY turn, md5(text)) FILTER (text IS NOT NULL), '') AS turns FROM conversations GROUP BY conv_id""")
def q_ordered_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("digest"))
    return R.assembled(turns, ["conv_id"], "turn", "digest", "turns")


@query("""WITH u AS (SELECT 0 AS s, s_nationkey AS id, s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT 1, c_nationkey, c_custkey, c_name FROM customer)
SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, k) AS n FROM u) WHERE n = 1""")
def q_union_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda t, p, k: table(spark, sf_dir, t).select(F.col(f"{p}_nationkey").alias("id"), F.col(k).alias("k"), F.col(f"{p}_name").alias("name"))
    return R.first_source_wins([named("supplier", "s", "s_suppkey"), named("customer", "c", "c_custkey")], ["id"], [F.col("k")]).select("id", "name")


@query("""WITH changes AS (SELECT c_custkey AS id, c_acctbal * 2 AS balance FROM customer WHERE c_acctbal < 0)
SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_custkey NOT IN (SELECT id FROM changes) UNION ALL SELECT * FROM changes""")
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return R.replaced(base, base.where("balance < 0").select("id", (F.col("balance") * 2).alias("balance")), ["id"])


@query("""SELECT source, min(doc_id) AS first_position, count(*) AS times, CASE WHEN count(*) > 1 THEN count(*) || '× ' || source ELSE source END AS label FROM documents GROUP BY source""")
def q_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_in_order(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@query("""WITH a AS (SELECT DISTINCT l_suppkey % 64 AS ix, l_partkey % 64 AS iz FROM lineitem WHERE l_quantity > 48), b AS (SELECT DISTINCT l_suppkey % 64 AS ix, l_partkey % 64 AS iz FROM lineitem WHERE l_discount > 0.09)
SELECT 'both' AS part, ix, iz FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first only', ix, iz FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def q_mask_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 64).alias("ix"), (F.col("l_partkey") % 64).alias("iz"), "l_quantity", "l_discount")
    a, b = cells.where("l_quantity > 48").select("ix", "iz"), cells.where("l_discount > 0.09").select("ix", "iz")
    named = lambda df, part: df.select(F.lit(part).alias("part"), "ix", "iz")
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "first only"))


@query("SELECT p_partkey, p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM part")
def q_dict_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.encoded(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "p_name", F.col("code").cast("long").alias("code"))


@query("""SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 50""")
def q_topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return R.top_per_group(orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 50)


@query("""WITH r AS (SELECT c_custkey, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS INTEGER) AS n FROM customer)
SELECT c_custkey, c_nationkey, CASE WHEN n = 1 THEN 2 WHEN n = 2 THEN 1 ELSE n END AS place FROM r""")
def q_multikey_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")
    n = F.row_number().over(w)
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(n == 1, 2).when(n == 2, 1).otherwise(n).alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20")
def q_limit_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(20)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5 ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def q_global_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal >= 5").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5)


@query(f"SELECT o_orderkey FROM orders ORDER BY {hash31_sql('o_orderkey')}, o_orderkey LIMIT 500")
def q_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return R.sampled(orders, S.hash31(F.col("o_orderkey")), [F.col("o_orderkey")], 500)


@query("""WITH t AS (SELECT count(*) AS total FROM part), s AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type),
r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part)
SELECT p_partkey, p_type FROM r JOIN s USING (p_type) CROSS JOIN t WHERE total <= 100 OR k <= floor(n * 100 / total::DOUBLE)""")
def q_budget_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.capped_in_proportion(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", [F.col("p_partkey")], 100)


@query(f"""WITH w AS (SELECT n_regionkey, n_nationkey, CAST(n_nationkey + 1 AS DOUBLE) AS weight FROM nation),
s AS (SELECT *, sum(weight) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS hi, sum(weight) OVER (PARTITION BY n_regionkey) AS total FROM w),
c AS (SELECT s_suppkey, n_regionkey, {hash31_sql('s_suppkey', 5)} / 2147483647.0::DOUBLE AS draw FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, c.n_regionkey, n_nationkey AS chosen FROM c JOIN s ON c.n_regionkey = s.n_regionkey AND draw * total >= hi - weight AND draw * total < hi""")
def q_weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    options = nation.select("n_regionkey", "n_nationkey", (F.col("n_nationkey") + 1).cast("double").alias("weight"))
    choosers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    chosen = R.weighted_choice(choosers, options, ["n_regionkey"], "n_nationkey", "weight", S.hash01(F.col("s_suppkey"), seed=5))
    return chosen.select("s_suppkey", "n_regionkey", F.col("n_nationkey").alias("chosen"))


@query("SELECT s_name FROM supplier WHERE starts_with('Supplier#000000001', substr(s_name, 1, 17)) ORDER BY s_suppkey DESC LIMIT 1")
def q_prefix_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.lit("Supplier#000000001")
    return table(spark, sf_dir, "supplier").where(F.startswith(owner, F.substring("s_name", 1, 17))).orderBy(F.desc("s_suppkey")).limit(1).select("s_name")
