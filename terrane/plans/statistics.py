"""Queries: aggregation, robust statistics, ordered sequences and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import scalars as S
from terrane.operators import sequences as Q
from terrane.operators import stats as A
from terrane.operators.ranks import quantiles
from terrane.plans.registry import Registry
from terrane.session import table

registry = Registry()
query = registry.query

GRID = "grid AS (SELECT CAST(l_suppkey % 64 AS INTEGER) AS ix, CAST(l_partkey % 64 AS INTEGER) AS iz, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
CURVE = [(0.0, 0.2), (60.0, 0.5), (150.0, 1.0), (240.0, 0.8), (330.0, 0.3)]
MONTHLY = [1.0, 2.0, 4.0, 7.0, 9.0, 10.0, 9.5, 8.0, 6.0, 4.0, 2.5, 1.5]


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items' quantities on a grid of 64 by 64 cells."""
    cell = lambda c: (F.col(c) % 64).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(cell("l_suppkey").alias("ix"), cell("l_partkey").alias("iz")).agg(F.sum("l_quantity").alias("v"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def q_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT CAST(l_suppkey % 64 AS INTEGER) AS ix, CAST(l_partkey % 64 AS INTEGER) AS iz, count(*) AS n FROM lineitem GROUP BY 1, 2")
def q_cell_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: (F.col(c) % 64).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(cell("l_suppkey").alias("ix"), cell("l_partkey").alias("iz")).agg(F.count("*").alias("n"))


@query(f"WITH {GRID} SELECT ix, iz, v FROM grid")
def q_cell_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir)


@query("""SELECT n_nationkey, round(coalesce(sum(CASE WHEN c_acctbal > 9800 THEN c_acctbal END), 0) / greatest(count(CASE WHEN c_acctbal > 9800 THEN 1 END), 1), 4) AS mean
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def q_group_mean_zero_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return pairs.groupBy("n_nationkey").agg(F.round(A.mean_or_zero(F.when(F.col("c_acctbal") > 9800, F.col("c_acctbal"))), 4).alias("mean"))


@query("""SELECT ix, iz, l_returnflag AS flag FROM (SELECT l_suppkey % 64 AS ix, l_partkey % 64 AS iz, l_returnflag, row_number() OVER (PARTITION BY l_suppkey % 64, l_partkey % 64 ORDER BY count(*) DESC, l_returnflag) AS r
  FROM lineitem GROUP BY 1, 2, 3) WHERE r = 1""")
def q_cell_mode_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 64).alias("ix"), (F.col("l_partkey") % 64).alias("iz"), "l_returnflag")
    return A.mode_lowest(rows, ["ix", "iz"], "l_returnflag", "flag")


@query("SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def q_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"median": 0.5}).select("o_orderpriority", F.round("median", 4).alias("median"))


@query("SELECT o_custkey, CASE WHEN count(*) >= 5 THEN list_sort(list(o_totalprice))[CAST(floor(count(*) / 2) AS INTEGER) + 1] ELSE -1 END AS upper FROM orders GROUP BY 1")
def q_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = A.upper_medians(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice")
    return medians.withColumn("upper", F.coalesce("upper", F.lit(-1.0)))


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.2), 4) AS p20, round(quantile_cont(o_totalprice, 0.8), 4) AS p80, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1""")
def q_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"p10": 0.1, "p20": 0.2, "p80": 0.8, "p90": 0.9}
    found = quantiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", wanted)
    return found.select("o_orderpriority", *[F.round(p, 4).alias(p) for p in wanted])


@query("""WITH s AS (SELECT l_returnflag, median(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1)
SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, round((l_extendedprice - m) / greatest(s, 1e-9), 5) AS z FROM lineitem JOIN s USING (l_returnflag)""")
def q_group_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = A.z_scores(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return scored.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", F.round("z", 5).alias("z"))


@query("""WITH a AS (SELECT p_brand, l_extendedprice AS y, l_quantity AS x FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (SELECT p_brand, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM a GROUP BY 1), r AS (SELECT a.*, y - (s * x + i) AS r FROM a JOIN f USING (p_brand)),
d AS (SELECT p_brand, stddev_pop(r) AS sd FROM r GROUP BY 1)
SELECT p_brand, round(regr_slope(y, x), 3) AS slope, round(regr_intercept(y, x), 2) AS intercept, count(*) AS n FROM r JOIN d USING (p_brand) WHERE abs(r) <= 1.5 * sd GROUP BY 1""")
def q_regression_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_extendedprice", "l_quantity")
    fit = A.trimmed_regression(rows, ["p_brand"], "l_extendedprice", "l_quantity", 1.5)
    return fit.select("p_brand", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


@query("""WITH g AS (SELECT l_quantity AS x, l_discount AS z, l_extendedprice AS u FROM lineitem), m AS (SELECT avg(x) mx, avg(z) mz, avg(u) mu FROM g),
s AS (SELECT sum((x-mx)*(x-mx)) xx, sum((z-mz)*(z-mz)) zz, sum((x-mx)*(z-mz)) xz, sum((x-mx)*(u-mu)) xu, sum((z-mz)*(u-mu)) zu, any_value(mx) mx, any_value(mz) mz, any_value(mu) mu FROM g, m)
SELECT round((xu*zz-zu*xz)/(xx*zz-xz*xz), 2) AS a, round((zu*xx-xu*xz)/(xx*zz-xz*xz), 1) AS b, round(mu - (xu*zz-zu*xz)/(xx*zz-xz*xz)*mx - (zu*xx-xu*xz)/(xx*zz-xz*xz)*mz, 1) AS c FROM s""")
def q_affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = A.affine_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice")
    return fit.select(F.round("a", 2).alias("a"), F.round("b", 1).alias("b"), F.round("c", 1).alias("c"))


@query(f"""WITH {GRID}, c AS (SELECT CASE WHEN v > 500 THEN 'dense' WHEN v > 250 THEN 'mid' ELSE 'sparse' END AS class FROM grid), n AS (SELECT class, count(*) AS n FROM c GROUP BY 1)
SELECT class, n, n * 16 / 10000.0::DOUBLE AS area, round(100.0 * n / (SELECT sum(n) FROM n), 6) AS percent FROM n""")
def q_area_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = grid(spark, sf_dir).select(S.first_match([(F.col("v") > 500, "dense"), (F.col("v") > 250, "mid")], "sparse").alias("class"))
    out = A.shares(classes, ["class"], F.lit(1), 16)
    return out.select("class", "n", (F.col("area") / 10000.0).alias("area"), F.round("percent", 6).alias("percent"))


@query("""WITH n AS (SELECT c_nationkey, count(*) AS members, avg(c_acctbal) AS respect FROM customer GROUP BY 1)
SELECT n_regionkey, round(least(greatest(sum(respect * members) / sum(members) / 100, 0), 100), 6) AS score FROM n JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def q_weighted_respect(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("members"), F.avg("c_acctbal").alias("respect"))
    pairs = groups.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return pairs.groupBy("n_regionkey").agg(F.round(S.clamp(A.weighted_mean(F.col("respect"), F.col("members")) / 100, 0.0, 100.0), 6).alias("score"))


@query("SELECT l_suppkey, round(coalesce(sum(CASE WHEN l_returnflag IN ('R', 'A') AND l_linestatus = 'O' THEN l_quantity END), 0), 2) AS opened FROM lineitem GROUP BY 1")
def q_filtered_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_kinds = F.col("l_returnflag").isin("R", "A") & (F.col("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.coalesce(F.sum(F.when(open_kinds, F.col("l_quantity"))), F.lit(0.0)), 2).alias("opened"))


@query("""WITH m AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, sum(o_totalprice) AS s, count(CASE WHEN o_totalprice > 400000 THEN 1 END) AS large FROM orders GROUP BY 1, 2)
SELECT y, round(max(s) / min(s), 6) AS ratio, round(avg(s), 0) AS mean, CAST(sum(large) AS BIGINT) AS large FROM m GROUP BY 1""")
def q_month_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").alias("m"))
    sums = months.agg(F.sum("o_totalprice").alias("s"), F.count(F.when(F.col("o_totalprice") > 400000, 1)).alias("large"))
    return sums.groupBy("y").agg(F.round(F.max("s") / F.min("s"), 6).alias("ratio"), F.round(F.avg("s"), 0).alias("mean"), F.sum("large").alias("large"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice / 1000 AS x, o_orderkey % 97 AS z FROM orders),
d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)), 0) AS d FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, round(sum(d) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 4) AS s FROM d""")
def q_cumlen(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderkey") % 97).alias("z"))
    return Q.running_length(points, ["o_custkey"], ["o_orderkey"], "x", "z").select("o_custkey", "o_orderkey", F.round("s", 4).alias("s"))


@query("SELECT o_orderkey, round(coalesce(o_totalprice - lag(o_totalprice) OVER w, 0), 4) AS change FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def q_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.change(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_totalprice")
    return rows.select("o_orderkey", F.round(F.coalesce("change", F.lit(0.0)), 4).alias("change"))


@query("SELECT o_orderkey, round(coalesce((lead(o_totalprice, 3) OVER w - o_totalprice) / 3, 0), 4) AS slope FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def q_lead_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Q.along(["o_custkey"], ["o_orderkey"])
    ahead = (F.lead("o_totalprice", 3).over(w) - F.col("o_totalprice")) / 3
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.coalesce(ahead, F.lit(0.0)), 4).alias("slope"))


@query("""WITH e AS (SELECT o_orderkey, o_totalprice AS x, first_value(o_totalprice) OVER f AS a, last_value(o_totalprice) OVER f AS b, lag(o_totalprice, 2) OVER w AS l2, lag(o_totalprice) OVER w AS l1, lead(o_totalprice) OVER w AS r1, lead(o_totalprice, 2) OVER w AS r2
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), f AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT o_orderkey, list_sort([coalesce(l2, a), coalesce(l1, a), x, coalesce(r1, b), coalesce(r2, b)])[3] AS median FROM e""")
def q_roll_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.running_median(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_totalprice").select("o_orderkey", "median")


@query("""WITH m AS (SELECT *, o_totalprice > 200000 AS k, coalesce(lag(o_totalprice > 200000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), false) AS before FROM orders),
r AS (SELECT *, sum(CASE WHEN k AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM m)
SELECT o_custkey, CAST(run AS BIGINT) AS run, count(*) AS n, min(o_orderkey) AS first FROM r WHERE k GROUP BY 1, 2""")
def q_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Q.runs(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], F.col("o_totalprice") > 200000)
    return kept.groupBy("o_custkey", "run").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def _step_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {a} THEN {v}" for a, v in reversed(CURVE[1:])) + f" ELSE {CURVE[0][1]} END"


@query(f"SELECT o_orderkey, CAST({_step_sql('dayofyear(o_orderdate)')} AS DOUBLE) AS factor FROM orders")
def q_asof_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.step_curve(CURVE, F.dayofyear("o_orderdate")).alias("factor"))


@query(f"""WITH d AS (SELECT o_orderkey, CAST((dayofyear(o_orderdate) - 15) / 30.44::DOUBLE AS DOUBLE) AS m, {MONTHLY} AS t FROM orders), i AS (SELECT *, CAST(floor(m) AS BIGINT) AS lo FROM d)
SELECT o_orderkey, round(t[((lo % 12) + 12) % 12 + 1] + (t[((lo + 1) % 12 + 12) % 12 + 1] - t[((lo % 12) + 12) % 12 + 1]) * (m - lo), 6) AS value FROM i""")
def q_month_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(S.cyclic_monthly(MONTHLY, F.dayofyear("o_orderdate").cast("double")), 6).alias("value"))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), a AS (SELECT y, y % 19 AS g, y // 100 AS c FROM y),
h AS (SELECT *, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h FROM a), i AS (SELECT *, h - (h // 28) * (1 - (h // 28) * (29 // (h + 1)) * ((21 - g) // 11)) AS i FROM h),
l AS (SELECT *, i - (y + y // 4 + i + 2 - c + c // 4) % 7 AS l FROM i), m AS (SELECT *, 3 + (l + 40) // 44 AS mo FROM l)
SELECT y, mo AS month, l + 28 - 31 * (mo // 4) AS day FROM m""")
def q_easter(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("y")).distinct()
    day = S.easter(F.col("y"))
    return years.select("y", F.month(day).cast("long").alias("month"), F.dayofmonth(day).cast("long").alias("day"))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588 AS BIGINT) AS jdn, CAST((date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588) % 7 AS BIGINT) AS weekday FROM orders")
def q_julian_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    jdn = S.julian_day(F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", jdn.alias("jdn"), (jdn % 7).alias("weekday"))


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, sum(value) AS p FROM events WHERE event_type = 'purchase' GROUP BY 1), w AS (SELECT hour, p FROM h WHERE p > 100),
g AS (SELECT *, CASE WHEN lag(hour) OVER (ORDER BY hour) IS NULL OR hour - lag(hour) OVER (ORDER BY hour) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM w),
s AS (SELECT *, sum(opens) OVER (ORDER BY hour) AS session FROM g) SELECT min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS hours, round(sum(p), 2) AS total FROM s GROUP BY session""")
def q_event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias("p"))
    wet = hours.where("p > 100").withColumn("station", F.lit(0))
    spells = Q.sessions(wet, ["station"], "hour", 6 * 3600).groupBy("station", "session")
    return spells.agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.count("*").alias("hours"), F.round(F.sum("p"), 2).alias("total")).drop("station", "session")


@query("""WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, avg(value) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2)
SELECT user_id, day, n, round(CASE WHEN n >= 3 THEN mean ELSE 50.0 END, 4) AS mean, CASE WHEN n >= 3 THEN low ELSE 0.0 END AS low, CASE WHEN n >= 3 THEN high ELSE 100.0 END AS high FROM d""")
def q_day_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    valid = lambda c, usual: F.when(F.col("n") >= 3, F.col(c)).otherwise(F.lit(usual))
    return days.select("user_id", "day", "n", F.round(valid("mean", 50.0), 4).alias("mean"), valid("low", 0.0).alias("low"), valid("high", 100.0).alias("high"))


@query("""WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS t FROM events GROUP BY 1, 2)
SELECT user_id, day, round(sum(greatest(0, t - 40)) OVER (PARTITION BY user_id, substr(day, 1, 4) ORDER BY day), 4) AS degree_days FROM d""")
def q_degree_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("t")).withColumn("year", F.substring("day", 1, 4))
    w = Q.along(["user_id", "year"], ["day"]).rowsBetween(Window.unboundedPreceding, 0)
    return days.select("user_id", "day", F.round(F.sum(F.greatest(F.lit(0.0), F.col("t") - 40)).over(w), 4).alias("degree_days"))


@query("""WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, avg(value) AS t FROM events GROUP BY 1, 2), c AS (SELECT *, sum(greatest(0, t - 40)) OVER (PARTITION BY user_id ORDER BY day) AS s FROM d)
SELECT user_id, min(day) AS reached FROM c WHERE s >= 200 GROUP BY 1""")
def q_first_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("t"))
    return A.first_crossing(days, ["user_id"], "day", F.greatest(F.lit(0.0), F.col("t") - 40), F.lit(200.0))


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_type, n, t AS last, event_id, true AS kept FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.event_type, o.n, CASE WHEN o.t - f.last >= 86400000000 THEN o.t ELSE f.last END, o.event_id, o.t - f.last >= 86400000000 FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.n = f.n + 1)
SELECT event_id, user_id, event_type FROM f WHERE kept""")
def q_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return Q.cooled_down(events, ["user_id", "event_type"], "ts", 86400, "event_id").select("event_id", "user_id", "event_type")


@query("""WITH l AS (SELECT user_id, event_type, max(ts) AS t, sum(value) AS v FROM events GROUP BY 1, 2), a AS (SELECT *, (epoch_us(TIMESTAMP '2024-02-05') - epoch_us(t)) / 86400000000.0::DOUBLE AS age FROM l)
SELECT user_id, event_type, round(v * exp(-age / 5.0), 6) AS value FROM a WHERE age <= 10""")
def q_ttl_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("t"), F.sum("value").alias("v"))
    now = F.lit("2024-02-05 00:00:00").cast("timestamp")
    return last.select("user_id", "event_type", F.round(Q.decayed(F.col("t"), now, F.col("v"), 5.0, 10.0), 6).alias("value")).where("value IS NOT NULL")


@query("SELECT user_id, event_id, event_type, CAST(trunc(value * 10) AS BIGINT) AS tenths FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND ts >= TIMESTAMP '2024-01-29'")
def q_snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("ts", "event_id", "event_type", "value")
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(row).alias("e")).where(F.col("e.ts") >= F.lit("2024-01-29 00:00:00").cast("timestamp"))
    return last.select("user_id", "e.event_id", "e.event_type", (F.col("e.value") * 10).cast("long").alias("tenths"))


@query("""WITH h AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS hour FROM events), g AS (SELECT *, coalesce(date_diff('hour', lag(hour) OVER (PARTITION BY user_id ORDER BY hour), hour), 1) AS gap FROM h)
SELECT user_id, hour - to_hours(CAST(b AS INTEGER)) AS hour, CAST(CASE WHEN gap <= 12 THEN 1 ELSE gap END AS BIGINT) AS dt FROM g, unnest(CASE WHEN gap <= 12 THEN range(0, gap) ELSE [0] END) AS u(b)""")
def q_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour"))
    return Q.filled_hours(hours, ["user_id"], "hour", 12).select("user_id", "hour", F.col("dt").cast("long").alias("dt"))
