"""Queries of the table surface: projection, filter, grouping, joins, set operations, windows, reshaping, scalars."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reshape, temporal
from ..session import table as t
from .registry import query


def r6(c):
    return F.round(c, 6)


@query("scan_parquet", "SELECT r_regionkey, r_name FROM region")
def scan_parquet(s, d):
    return t(s, d, "region")


@query("project_filter", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity > 45 AND l_discount BETWEEN 0.02 AND 0.05 AND l_returnflag IN ('R', 'N') AND NOT (l_linestatus = 'F')""")
def project_filter(s, d):
    x = t(s, d, "lineitem")
    return x.where((x.l_quantity > 45) & x.l_discount.between(0.02, 0.05) & x.l_returnflag.isin("R", "N") & ~(x.l_linestatus == "F")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("derived_column", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def derived_column(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"))


@query("row_count", "SELECT count(*) AS n, 11 AS n_columns FROM lineitem")
def row_count(s, d):
    x = t(s, d, "lineitem")
    return x.agg(F.count("*").alias("n"), F.lit(len(x.columns)).alias("n_columns"))


@query("group_agg", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
min(l_discount) AS min_disc, max(l_discount) AS max_disc, round(median(l_tax), 6) AS med_tax, round(stddev_samp(l_quantity), 6) AS std_qty,
round(var_samp(l_quantity), 6) AS var_qty, count(DISTINCT l_suppkey) AS n_supp FROM lineitem GROUP BY ALL""")
def group_agg(s, d):
    return t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_discount").alias("min_disc"),
        F.max("l_discount").alias("max_disc"), r6(F.median("l_tax")).alias("med_tax"), r6(F.stddev_samp("l_quantity")).alias("std_qty"), r6(F.var_samp("l_quantity")).alias("var_qty"),
        F.countDistinct("l_suppkey").alias("n_supp"))


@query("group_first_last", """SELECT l_suppkey, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS first_price,
arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS last_price FROM lineitem GROUP BY l_suppkey""")
def group_first_last(s, d):
    k = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(F.min_by("l_extendedprice", k).alias("first_price"), F.max_by("l_extendedprice", k).alias("last_price"))


@query("group_by_month", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1")
def group_by_month(s, d):
    return t(s, d, "orders").groupBy(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("frequency_share", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM events GROUP BY event_type")
def frequency_share(s, d):
    g = t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 8))


@query("distinct_values", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_values(s, d):
    return t(s, d, "orders").select("o_orderpriority", "o_orderstatus").distinct()


@query("elementwise_sign", "SELECT c_custkey, CAST(sign(c_acctbal) AS DOUBLE) AS sgn FROM customer")
def elementwise_sign(s, d):
    return t(s, d, "customer").select("c_custkey", F.signum("c_acctbal").alias("sgn"))


@query("join_inner", """SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_inner(s, d):
    o, c, n = (t(s, d, x) for x in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("join_left", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(s, d):
    o = t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    return t(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("n_orders"))


@query("join_right", "SELECT s_suppkey, c_custkey FROM supplier RIGHT JOIN customer ON s_suppkey = c_custkey")
def join_right(s, d):
    return t(s, d, "supplier").join(t(s, d, "customer"), F.col("s_suppkey") == F.col("c_custkey"), "right").select("s_suppkey", "c_custkey")


@query("join_full", """SELECT coalesce(a.k, b.k) AS k, na, nb FROM (SELECT c_nationkey AS k, count(*) AS na FROM customer GROUP BY 1) a
FULL JOIN (SELECT p_size AS k, count(*) AS nb FROM part GROUP BY 1) b ON a.k = b.k""")
def join_full(s, d):
    a = t(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("na"))
    b = t(s, d, "part").groupBy(F.col("p_size").alias("k")).agg(F.count("*").alias("nb"))
    return a.join(b, "k", "full")


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_semi(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(s, d):
    return t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("join_null_safe", """WITH a AS (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer), b AS (SELECT nullif(n_nationkey, 3) AS k, n_name FROM nation)
SELECT c_custkey, n_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_safe(s, d):
    a = t(s, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    b = t(s, d, "nation").select(F.nullif("n_nationkey", F.lit(3)).alias("k2"), "n_name")
    return a.join(b, F.col("k").eqNullSafe(F.col("k2"))).select("c_custkey", "n_name")


@query("join_range", """WITH b AS (SELECT * FROM (VALUES (0, 0.0, 1000.0), (1, 1000.0, 3000.0), (2, 3000.0, 6000.0), (3, 6000.0, 20000.0)) v(band, lo, hi))
SELECT c_custkey, CAST(band AS INTEGER) AS band FROM customer JOIN b ON c_acctbal >= lo AND c_acctbal < hi""")
def join_range(s, d):
    bands = s.createDataFrame([(0, 0.0, 1000.0), (1, 1000.0, 3000.0), (2, 3000.0, 6000.0), (3, 6000.0, 20000.0)], "band int, lo double, hi double")
    return temporal.range_join(t(s, d, "customer"), bands, "c_acctbal", "lo", "hi").select("c_custkey", "band")



def _asof_sides(s, d):
    e = t(s, d, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    return e, kinds


@query("join_asof", """WITH k AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT a FROM k)),
v AS (SELECT user_id, ts, max(event_id) AS e FROM events WHERE event_type = (SELECT b FROM k) GROUP BY user_id, ts)
SELECT p.event_id, v.e AS last_b FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def join_asof(s, d):
    e, kinds = _asof_sides(s, d)
    left = e.where(F.col("event_type") == kinds[0]).select("event_id", "user_id", "ts")
    right = e.where(F.col("event_type") == kinds[-1]).groupBy("user_id", "ts").agg(F.max("event_id").alias("last_b"))
    return temporal.asof_join(left, right, "ts", by=["user_id"]).select("event_id", "last_b")


@query("merge_ordered", """WITH a AS (SELECT date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS k, min(o_totalprice) AS x FROM orders GROUP BY 1),
b AS (SELECT date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS k, max(l_extendedprice) AS y FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, x, y FROM a FULL JOIN b ON a.k = b.k)
SELECT k, last_value(x IGNORE NULLS) OVER w AS x, last_value(y IGNORE NULLS) OVER w AS y FROM j WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def merge_ordered(s, d):
    day = lambda c: F.datediff(c, F.lit("1992-01-01").cast("date")).cast("bigint").alias("k")
    a = t(s, d, "orders").groupBy(day("o_orderdate")).agg(F.min("o_totalprice").alias("x"))
    b = t(s, d, "lineitem").groupBy(day("l_shipdate")).agg(F.max("l_extendedprice").alias("y"))
    return temporal.forward_fill(a.join(b, "k", "full"), "k", ["x", "y"])


@query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(t(s, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(s, d):
    return union_all(s, d).distinct()


@query("union_by_name", "SELECT c_custkey AS id, c_mktsegment AS seg, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def union_by_name(s, d):
    a = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")), allowMissingColumns=True)


@query("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(s, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(s, d):
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(t(s, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("sort_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_topk(s, d):
    return t(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


def _by_cust():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")

_SQL_W = "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query("rank_average", """SELECT event_id, rank() OVER w + (count(*) OVER (PARTITION BY user_id, event_type) - 1) / 2.0::DOUBLE AS avg_rank,
rank() OVER w AS min_rank, dense_rank() OVER w AS dense, round(percent_rank() OVER w, 9) AS pct FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)""")
def rank_average(s, d):
    w = Window.partitionBy("user_id").orderBy("event_type")
    ties = F.count("*").over(Window.partitionBy("user_id", "event_type"))
    return t(s, d, "events").select(
        "event_id", (F.rank().over(w) + (ties - 1) / 2.0).alias("avg_rank"), F.rank().over(w).cast("bigint").alias("min_rank"), F.dense_rank().over(w).cast("bigint").alias("dense"), F.round(F.percent_rank().over(w), 9).alias("pct"))


@query("cumcount", f"SELECT o_orderkey, row_number() OVER w - 1 AS k FROM orders {_SQL_W}")
def cumcount(s, d):
    return t(s, d, "orders").select("o_orderkey", (F.row_number().over(_by_cust()) - 1).cast("bigint").alias("k"))


@query("lag_diff", f"""SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice) OVER w AS next, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS diff,
round(o_totalprice / lag(o_totalprice) OVER w - 1, 6) AS pct FROM orders {_SQL_W}""")
def lag_diff(s, d):
    p = F.lag("o_totalprice").over(_by_cust())
    return t(s, d, "orders").select(
        "o_orderkey", p.alias("prev"), F.lead("o_totalprice").over(_by_cust()).alias("next"), F.round(F.col("o_totalprice") - p, 4).alias("diff"), r6(F.try_divide("o_totalprice", p) - 1).alias("pct"))


@query("ffill_bfill", """WITH x AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS v FROM orders)
SELECT o_orderkey, last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS ff,
first_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf FROM x""")
def ffill_bfill(s, d):
    x = t(s, d, "orders").withColumn("v", F.when(F.col("o_orderstatus") == "F", None).otherwise(F.col("o_totalprice")))
    return x.select("o_orderkey", F.last("v", ignorenulls=True).over(_by_cust().rowsBetween(Window.unboundedPreceding, 0)).alias("ff"), F.first("v", ignorenulls=True).over(_by_cust().rowsBetween(0, Window.unboundedFollowing)).alias("bf"))


@query("cumulative", f"""SELECT o_orderkey, round(sum(o_totalprice) OVER w, 4) AS cs, max(o_totalprice) OVER w AS cmax, min(o_totalprice) OVER w AS cmin,
round(sum(ln(o_totalprice)) OVER w, 6) AS log_cumprod FROM orders {_SQL_W[:-1]} ROWS UNBOUNDED PRECEDING)""")
def cumulative(s, d):
    w = _by_cust().rowsBetween(Window.unboundedPreceding, 0)
    return t(s, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 4).alias("cs"), F.max("o_totalprice").over(w).alias("cmax"), F.min("o_totalprice").over(w).alias("cmin"), r6(F.sum(F.log("o_totalprice")).over(w)).alias("log_cumprod"))


@query("cumprod_signed", """WITH x AS (SELECT r_regionkey AS k, CAST(r_regionkey AS DOUBLE) - 1.5 AS v FROM region)
SELECT k, round(product(v) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 9) AS p FROM x""")
def cumprod_signed(s, d):
    x = t(s, d, "region").select(F.col("r_regionkey").alias("k"), (F.col("r_regionkey").cast("double") - 1.5).alias("v"), F.lit(1).alias("g"))
    return x.select("k", F.round(reshape.cumprod("v", Window.partitionBy("g").orderBy("k")), 9).alias("p"))


@query("rolling_rows", """SELECT o_orderkey, CASE WHEN count(*) OVER w = 3 THEN round(avg(o_totalprice) OVER w, 4) END AS m3 FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING)""")
def rolling_rows(s, d):
    w = _by_cust().rowsBetween(-2, 0)
    return t(s, d, "orders").select("o_orderkey", F.when(F.count("*").over(w) == 3, F.round(F.avg("o_totalprice").over(w), 4)).alias("m3"))


@query("rolling_range", """SELECT o_orderkey, count(*) OVER w AS n7, round(sum(o_totalprice) OVER w, 3) AS s7 FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)""")
def rolling_range(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").cast("timestamp").cast("long")).rangeBetween(-30 * 86400, 0)
    return t(s, d, "orders").select("o_orderkey", F.count("*").over(w).alias("n7"), F.round(F.sum("o_totalprice").over(w), 3).alias("s7"))


@query("expanding_mean", f"SELECT o_orderkey, round(avg(o_totalprice) OVER w, 4) AS m FROM orders {_SQL_W[:-1]} ROWS UNBOUNDED PRECEDING)")
def expanding_mean(s, d):
    return t(s, d, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(_by_cust().rowsBetween(Window.unboundedPreceding, 0)), 4).alias("m"))


@query("ewm_mean", """WITH x AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, pow(0.7, -row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS w FROM orders)
SELECT o_orderkey, round(sum(o_totalprice * w) OVER v / sum(w) OVER v, 6) AS ewm FROM x WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def ewm_mean(s, d):
    return temporal.ewm(t(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", alpha=0.3).select("o_orderkey", r6("ewm").alias("ewm"))


@query("resample_daily", """WITH g AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY 1),
c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM g), (SELECT max(day) FROM g), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT CAST(c.day AS VARCHAR) AS day, coalesce(n, 0) AS n, round(coalesce(v, 0), 4) AS v FROM c LEFT JOIN g USING (day)""")
def resample_daily(s, d):
    g = temporal.resample(t(s, d, "events"), "ts", "day", {"n": F.count("*"), "v": F.sum("value")})
    return g.select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("v", F.lit(0.0)), 4).alias("v"))


@query("pivot_counts", """SELECT l_shipmode AS flag, f, o FROM (SELECT l_returnflag AS l_shipmode, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1)""")
def pivot_counts(s, d):
    p = t(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).pivot("l_linestatus", ["F", "O"]).count().na.fill(0)
    return p.withColumnsRenamed({"F": "f", "O": "o"})


@query("unpivot", "SELECT c_custkey, 'c_acctbal' AS variable, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::DOUBLE FROM customer")
def unpivot(s, d):
    return t(s, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("double")).unpivot("c_custkey", ["c_acctbal", "c_nationkey"], "variable", "value")


@query("cube_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(s, d):
    return t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


@query("rollup_margins", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_margins(s, d):
    return t(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("cut_bins", """SELECT bin, count(*) AS n FROM (SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 35 THEN 2 ELSE 3 END AS bin FROM lineitem) GROUP BY bin""")
def cut_bins(s, d):
    return t(s, d, "lineitem").groupBy(reshape.cut("l_quantity", [10, 20, 35]).alias("bin")).agg(F.count("*").alias("n"))


@query("qcut_bins", """WITH e AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders)
SELECT CASE WHEN o_totalprice <= q[1] THEN 0 WHEN o_totalprice <= q[2] THEN 1 WHEN o_totalprice <= q[3] THEN 2 ELSE 3 END AS bin, count(*) AS n FROM orders, e GROUP BY 1""")
def qcut_bins(s, d):
    return reshape.qcut(t(s, d, "orders"), "o_totalprice", 4).groupBy("bin").agg(F.count("*").alias("n"))


@query("one_hot", """SELECT o_orderkey, (o_orderstatus = 'F')::INT AS status_F, (o_orderstatus = 'O')::INT AS status_O, (o_orderstatus = 'P')::INT AS status_P FROM orders""")
def one_hot(s, d):
    return t(s, d, "orders").select("o_orderkey", *(F.when(F.col("o_orderstatus") == v, 1).otherwise(0).alias(f"status_{v}") for v in ("F", "O", "P")))


@query("factorize", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def factorize(s, d):
    return reshape.factorize(t(s, d, "customer"), "c_mktsegment", "code").select("c_custkey", "code")


@query("fill_replace_clip", """SELECT l_orderkey, l_linenumber, coalesce(nullif(l_tax, 0.0), -1.0) AS filled, CASE l_returnflag WHEN 'R' THEN 'returned' ELSE l_returnflag END AS flag,
greatest(least(l_quantity, 40.0), 5.0) AS clipped FROM lineitem""")
def fill_replace_clip(s, d):
    x = t(s, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", F.coalesce(F.nullif("l_tax", F.lit(0.0)), F.lit(-1.0)).alias("filled"), F.when(F.col("l_returnflag") == "R", "returned").otherwise(F.col("l_returnflag")).alias("flag"), F.greatest(F.least("l_quantity", F.lit(40.0)), F.lit(5.0)).alias("clipped"))


@query("interpolate_linear", """WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS v FROM orders),
y AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN k END) OVER a AS k0, min(CASE WHEN v IS NOT NULL THEN k END) OVER b AS k1, last_value(v IGNORE NULLS) OVER a AS v0, first_value(v IGNORE NULLS) OVER b AS v1 FROM x
WINDOW a AS (PARTITION BY o_custkey ORDER BY k ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY o_custkey ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT o_orderkey, round(CASE WHEN v IS NOT NULL THEN v WHEN k0 IS NULL THEN NULL WHEN k1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (k - k0) / (k1 - k0) END, 4) AS v FROM y""")
def interpolate_linear(s, d):
    x = t(s, d, "orders").withColumn("v", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))
    return temporal.interpolate(x, "o_custkey", "o_orderkey", "v").select("o_orderkey", F.round("v", 4).alias("v"))


@query("explode_embedding", "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings")
def explode_embedding(s, d):
    return t(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("x").cast("double").alias("v"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(s, d):
    return t(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("string_funcs", r"""SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, replace(p_name, ' ', '_') AS rep, split_part(p_name, ' ', 1) AS head, lpad(CAST(p_size AS VARCHAR), 4, '0') AS z,
starts_with(p_brand, 'Brand') AS sw, regexp_extract(p_brand, '([0-9]+)', 1) AS num, regexp_matches(p_type, 'E') AS has_e, substring(p_name, 2, 3) AS sub, instr(p_name, 'a') AS pos, concat(p_brand, '-', p_type) AS cat,
length(p_name) - length(replace(p_name, 'e', '')) AS n_e FROM part""")
def string_funcs(s, d):
    n = F.col("p_name")
    return t(s, d, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.length(n).cast("bigint").alias("len"), F.replace(n, F.lit(" "), F.lit("_")).alias("rep"), F.split_part(n, F.lit(" "), F.lit(1)).alias("head"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("z"),
        F.startswith("p_brand", F.lit("Brand")).alias("sw"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("num"), F.col("p_type").rlike("E").alias("has_e"), F.substring(n, 2, 3).alias("sub"), F.instr(n, "a").cast("bigint").alias("pos"),
        F.concat("p_brand", F.lit("-"), "p_type").alias("cat"), F.regexp_count(n, F.lit("e")).cast("bigint").alias("n_e"))


@query("date_funcs", """SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS dd, quarter(o_orderdate)::INT AS q, (isodow(o_orderdate) - 1)::INT AS wd, dayofyear(o_orderdate)::INT AS doy,
weekofyear(o_orderdate)::INT AS wk, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday, strftime(o_orderdate, '%Y/%m/%d') AS txt, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))::INT AS days FROM orders""")
def date_funcs(s, d):
    x = F.col("o_orderdate")
    return t(s, d, "orders").select(
        "o_orderkey", F.year(x).alias("y"), F.month(x).alias("m"), F.dayofmonth(x).alias("dd"), F.quarter(x).alias("q"), F.weekday(x).alias("wd"), F.dayofyear(x).alias("doy"), F.weekofyear(x).alias("wk"),
        F.date_format(F.date_trunc("week", x), "yyyy-MM-dd").alias("monday"), F.date_format(x, "yyyy/MM/dd").alias("txt"), F.datediff(x, F.lit("1992-01-01").cast("date")).alias("days"))


@query("math_funcs", """SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS c, round(sqrt(abs(c_acctbal)), 6) AS sq, round(ln(abs(c_acctbal) + 1), 6) AS lg, round(exp(c_acctbal / 10000), 6) AS ex,
c_custkey % 7 AS md, round(pow(c_acctbal / 1000, 3), 5) AS cube, round(sin(c_acctbal), 6) AS sn, CASE WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band FROM customer""")
def math_funcs(s, d):
    b = F.col("c_acctbal")
    return t(s, d, "customer").select(
        "c_custkey", F.abs(b).alias("a"), F.floor(b).alias("f"), F.ceil(b).alias("c"), r6(F.sqrt(F.abs(b))).alias("sq"), r6(F.log(F.abs(b) + 1)).alias("lg"), r6(F.exp(b / 10000)).alias("ex"), (F.col("c_custkey") % 7).alias("md"),
        F.round(F.pow(b / 1000, F.lit(3)), 5).alias("cube"), r6(F.sin(b)).alias("sn"), F.when(b < 0, "neg").when(b < 5000, "mid").otherwise("high").alias("band"))


@query("type_conversion", "SELECT p_partkey, TRY_CAST(p_brand AS INTEGER) AS bad, TRY_CAST(substr(p_brand, 7) AS INTEGER) AS num, CAST(p_size AS VARCHAR) AS txt, CAST(p_retailprice AS BIGINT) AS whole FROM (SELECT p_partkey, p_brand, p_size, trunc(p_retailprice) AS p_retailprice FROM part)")
def type_conversion(s, d):
    return t(s, d, "part").select("p_partkey", F.expr("try_cast(p_brand as int)").alias("bad"), F.expr("try_cast(substr(p_brand, 7) as int)").alias("num"), F.col("p_size").cast("string").alias("txt"), F.col("p_retailprice").cast("bigint").alias("whole"))


@query("statistics", """SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 6) AS cov, round(skewness(l_extendedprice), 5) AS skew, round(kurtosis(l_extendedprice), 5) AS kurt,
round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 8) AS sem, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90, round(mad(l_quantity), 6) AS mad FROM lineitem""")
def statistics(s, d):
    return reshape.statistics(t(s, d, "lineitem"))


@query("mode_value", "SELECT l_returnflag, l_linenumber AS m FROM (SELECT l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def mode_value(s, d):
    g = t(s, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))
    return g.groupBy("l_returnflag").agg(F.max_by("l_linenumber", F.struct("n", -F.col("l_linenumber"))).alias("m"))


@query("map_values", "SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS total, count(*) AS k FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def map_values(s, d):
    g = t(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("m"))
    return g.select("c_nationkey", F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"), F.size("m").cast("bigint").alias("k"))


# ---- extensions over the event table ---------------------------------------------------------------------------------------------

@query("stream_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):
    from ..streaming import windows

    e = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.tumbling(e).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sessions", """WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM k GROUP BY user_id, g""")
def stream_sessions(s, d):
    from ..streaming import windows

    e = t(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sessions(e).select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))
