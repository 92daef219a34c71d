"""Queries of the quality profile and the closed-form validation metrics."""
from pyspark.sql import functions as F

from ..operators import metrics, quality
from ..session import table as t
from .registry import query


def dirty(s, d):
    """Orders with missing values and repeated rows."""
    o = t(s, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price"), F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_orderpriority", F.lit("x").alias("fixed"))
    return o.unionByName(o.where("o_orderkey % 50 = 1"))


_DIRTY = """o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS price, nullif(o_orderstatus, 'P') AS status, o_orderpriority, 'x' AS fixed FROM orders),
x AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE o_orderkey % 50 = 1)"""
_COLS = {"o_orderkey": "bigint", "price": "double", "status": "string", "o_orderpriority": "string", "fixed": "string"}


@query("dq_missing", f"WITH {_DIRTY} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) - count({c}) AS missing_count, round_even((count(*) - count({c})) * 100.0::DOUBLE / greatest(count(*), 1), 2) AS missing_pct FROM x" for c, k in _COLS.items()))
def dq_missing(s, d):
    return quality.missing(dirty(s, d))


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("dq_describe", "SELECT \"column\", count, mean, std, \"min\", \"max\", q25, q50, q75 FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS \"min\", max({c}) AS \"max\", round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem" for c in _NUM) + ")")
def dq_describe(s, d):
    x = quality.describe(t(s, d, "lineitem").select(*_NUM))
    return x.select("column", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", *(F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")))


def _top(c):
    return f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM x) AS count, (SELECT count(DISTINCT {c}) FROM x) AS "unique", {c} AS top, n AS freq
FROM (SELECT {c}, count(*) AS n FROM x WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, {c} LIMIT 1)"""


@query("dq_describe_categories", f"WITH {_DIRTY} " + " UNION ALL ".join(_top(c) for c in ("status", "o_orderpriority", "fixed")))
def dq_describe_categories(s, d):
    return quality.describe(dirty(s, d).select("status", "o_orderpriority", "fixed"))


def _out(c):
    return f"""SELECT '{c}' AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper,
count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers, round_even(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0::DOUBLE / count({c}), 2) AS outlier_pct
FROM lineitem, (SELECT quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.75)::DOUBLE AS q3 FROM lineitem) GROUP BY q1, q3"""


@query("dq_outliers_iqr", " UNION ALL ".join(_out(c) for c in ("l_quantity", "l_extendedprice")))
def dq_outliers_iqr(s, d):
    x = quality.outliers_iqr(t(s, d, "lineitem").select("l_quantity", "l_extendedprice"))
    return x.select("column", *(F.round(c, 6).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")), "outliers", "outlier_pct")


@query("dq_column_validity", f"WITH {_DIRTY} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, round_even(count(DISTINCT {c}) * 100.0::DOUBLE / greatest(count(*), 1), 2) AS pct_unique, count(DISTINCT {c}) <= 1 AS is_constant, count(DISTINCT {c}) = count(*) AND count(*) > 0 AS is_id_like FROM x" for c in _COLS))
def dq_column_validity(s, d):
    return quality.column_validity(dirty(s, d))


@query("dq_validity_summary", f"""WITH {_DIRTY} SELECT 'duplicate rows' AS "check", (SELECT count(*) FROM x) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x)) AS value, '' AS detail
UNION ALL SELECT 'constant columns', 1, 'fixed' UNION ALL SELECT 'id-like columns', 0, '' UNION ALL SELECT 'columns with missing values', 2, 'price, status'""")
def dq_validity_summary(s, d):
    return quality.validity_summary(dirty(s, d))


@query("dq_histogram", """WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem)
SELECT 'l_extendedprice' AS "column", CAST(least(floor((l_extendedprice - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 2""")
def dq_histogram(s, d):
    return quality.histogram(t(s, d, "lineitem"), ["l_extendedprice"]).select("column", "bin", "n")


@query("dq_boxplot", """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25)::DOUBLE AS a, quantile_cont(l_extendedprice, 0.5)::DOUBLE AS m, quantile_cont(l_extendedprice, 0.75)::DOUBLE AS b FROM lineitem)
SELECT 'l_extendedprice' AS "column", round(a, 6) AS q1, round(m, 6) AS median, round(b, 6) AS q3, min(l_extendedprice) FILTER (WHERE l_extendedprice >= a - 1.5 * (b - a)) AS whisker_low,
max(l_extendedprice) FILTER (WHERE l_extendedprice <= b + 1.5 * (b - a)) AS whisker_high, count(*) FILTER (WHERE l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)) AS fliers FROM lineitem, q GROUP BY a, m, b""")
def dq_boxplot(s, d):
    x = quality.boxplot(t(s, d, "lineitem"), ["l_extendedprice"])
    return x.select("column", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3")), "whisker_low", "whisker_high", "fliers")


def _freq(c):
    return f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS rank FROM x WHERE {c} IS NOT NULL GROUP BY {c}"


@query("dq_frequency", f"WITH {_DIRTY} SELECT * FROM (" + " UNION ALL ".join(_freq(c) for c in ("status", "o_orderpriority", "fixed")) + ") WHERE rank <= 10")
def dq_frequency(s, d):
    return quality.frequency(dirty(s, d))


@query("dq_high_cardinality", "SELECT 'p_name' AS \"column\", count(DISTINCT p_name) AS n_unique FROM part HAVING count(DISTINCT p_name) > 50 UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part HAVING count(DISTINCT p_brand) > 50 UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part HAVING count(DISTINCT p_type) > 50")
def dq_high_cardinality(s, d):
    return quality.high_cardinality(t(s, d, "part"))


@query("table_overview", "SELECT 'c_custkey' AS \"column\", 'bigint' AS dtype, count(c_custkey) AS non_null, CAST(arg_min(c_custkey, c_custkey) AS VARCHAR) AS example, count(DISTINCT c_custkey) AS n_unique FROM customer UNION ALL SELECT 'c_name', 'string', count(c_name), substr(arg_min(c_name, c_custkey), 1, 40), count(DISTINCT c_name) FROM customer UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment), substr(arg_min(c_mktsegment, c_custkey), 1, 40), count(DISTINCT c_mktsegment) FROM customer")
def table_overview(s, d):
    return quality.overview(t(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), order_by=["c_custkey"])


# ---- validation -----------------------------------------------------------------------------------------------------------------

def scored(s, d):
    """Line items as a scored table: label, score, split."""
    x = t(s, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), (F.col("l_discount") * 10).alias("score"), F.col("l_linestatus").alias("split"), "l_extendedprice", "l_quantity", "l_discount", "l_tax")


_S = "s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount * 10 AS score, l_linestatus AS split, l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem)"
_AREAS = f"""{_S}, g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY score), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC)),
a AS (SELECT sum(neg * (tp - pos) + neg * pos / 2.0::DOUBLE) / (sum(pos)::DOUBLE * sum(neg)) AS roc_auc, sum(pos * (tp::DOUBLE / (tp + fp))) / sum(pos) AS pr_auc FROM c)"""


@query("clf_metrics", f"""WITH {_AREAS}, k AS (SELECT count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn FROM s)
SELECT k.tp, k.fp, fn, tn, round((k.tp + tn) / (k.tp + k.fp + fn + tn)::DOUBLE, 8) AS accuracy, round(k.tp / (k.tp + k.fp)::DOUBLE, 8) AS precision, round(k.tp / (k.tp + fn)::DOUBLE, 8) AS recall, round(2 * k.tp / (2 * k.tp + k.fp + fn)::DOUBLE, 8) AS f1,
round(roc_auc, 8) AS roc_auc, round(pr_auc, 8) AS pr_auc, round(2 * roc_auc - 1, 8) AS gini FROM k, a""")
def clf_metrics(s, d):
    x = metrics.classification(scored(s, d), "y", "score", 0.5)
    return x.select("tp", "fp", "fn", "tn", *(F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "gini")))


@query("confusion_matrix", f"WITH {_S} SELECT a AS actual, p AS predicted, count(y) AS n FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, p) LEFT JOIN s ON y = a AND (score >= 0.5)::INT = p GROUP BY 1, 2")
def confusion_matrix(s, d):
    return metrics.confusion_matrix(scored(s, d), "y", "score", 0.5)


@query("roc_curve", f"""WITH {_AREAS}, t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM g), l AS (SELECT *, lead(pos) OVER (ORDER BY score DESC) AS pn, lead(neg) OVER (ORDER BY score DESC) AS nn FROM c)
SELECT round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr, score AS threshold FROM l, t WHERE pn IS NULL OR pos * nn <> neg * pn UNION ALL SELECT 0.0, 0.0, NULL""")
def roc_curve(s, d):
    return metrics.roc_curve(scored(s, d), "y", "score").select(F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"), "threshold")


_CONT = """WITH s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice AS score FROM orders), g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY score),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC)),
a AS (SELECT sum(neg * (tp - pos) + neg * pos / 2.0::DOUBLE) / (sum(pos)::DOUBLE * sum(neg)) AS roc_auc, sum(pos * (tp::DOUBLE / (tp + fp))) / sum(pos) AS pr_auc FROM c) """


@query("roc_auc", _CONT + "SELECT round(roc_auc, 9) AS roc_auc FROM a")
def roc_auc(s, d):
    o = t(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), F.col("o_totalprice").alias("score"))
    return metrics.areas(o, "y", "score").select(F.round("roc_auc", 9).alias("roc_auc"))


@query("pr_auc", _CONT + "SELECT round(pr_auc, 9) AS pr_auc FROM a")
def pr_auc(s, d):
    o = t(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), F.col("o_totalprice").alias("score"))
    return metrics.areas(o, "y", "score").select(F.round("pr_auc", 9).alias("pr_auc"))


@query("gini", f"WITH {_AREAS} SELECT round(2 * roc_auc - 1, 9) AS gini FROM a")
def gini(s, d):
    return metrics.areas(scored(s, d), "y", "score").select(F.round("gini", 9).alias("gini"))


@query("smote_counts", "SELECT o_orderstatus AS class, count(*) AS original, max(count(*)) OVER () AS post FROM orders GROUP BY o_orderstatus")
def smote_counts(s, d):
    return metrics.smote_counts(t(s, d, "orders"), "o_orderstatus")


def priced(s, d):
    x = t(s, d, "lineitem").join(t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("pred"))


_P = "p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity * p_retailprice AS pred FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("reg_metrics", f"""WITH {_P}, m AS (SELECT median(y) AS m FROM p) SELECT count(*) AS n, round(sqrt(avg((y - pred) * (y - pred))), 4) AS rmse, round(avg(abs(y - pred)), 4) AS mae,
round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2, round(median(abs(y - m)), 4) AS mad FROM p, m""")
def reg_metrics(s, d):
    x = metrics.regression(priced(s, d), "y", "pred")
    return x.select("n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"), F.round("mad", 4).alias("mad"))


@query("residuals", f"WITH {_P} SELECT l_orderkey, l_linenumber, pred AS predicted, y - pred AS residual FROM p")
def residuals(s, d):
    return metrics.residuals(priced(s, d), "y", "pred", ["l_orderkey", "l_linenumber"])


@query("vif", """WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_tax) AS b, sum(l_tax * l_tax) AS c FROM lineitem)
SELECT 'l_quantity' AS variable, round(a * c / (a * c - b * b), 6) AS vif FROM g UNION ALL SELECT 'l_tax', round(a * c / (a * c - b * b), 6) FROM g""")
def vif(s, d):
    return metrics.vif(t(s, d, "lineitem"), ["l_quantity", "l_tax"]).select("variable", F.round("vif", 6).alias("vif"))


_EDGES = ", ".join(f"quantile_cont(l_extendedprice, {k / 10})::DOUBLE AS q{k}" for k in range(1, 10))
_BIN = " + ".join(f"(l_extendedprice > q{k})::INT" for k in range(1, 10))


@query("psi_drift", f"""WITH e AS (SELECT {_EDGES} FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT l_linestatus AS s, {_BIN} AS bin FROM lineitem, e),
c AS (SELECT v.bin, count(*) FILTER (WHERE s = 'F') AS a, count(*) FILTER (WHERE s = 'O') AS o FROM (SELECT unnest(range(10)) AS bin) v LEFT JOIN b ON b.bin = v.bin GROUP BY v.bin),
r AS (SELECT a / sum(a) OVER () + 1e-4 AS a, o / sum(o) OVER () + 1e-4 AS o FROM c), n AS (SELECT a / sum(a) OVER () AS a, o / sum(o) OVER () AS o FROM r) SELECT round(sum((a - o) * ln(a / o)), 4) AS psi FROM n""")
def psi_drift(s, d):
    return metrics.psi(t(s, d, "lineitem"), "l_extendedprice", "l_linestatus", "F", "O")


@query("hhi", "SELECT round(sum(p * p), 9) AS hhi FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM customer GROUP BY c_mktsegment)")
def hhi(s, d):
    return metrics.hhi(t(s, d, "customer"), "c_mktsegment").select(F.round("hhi", 9).alias("hhi"))


@query("correlation_matrix", "SELECT x, y, round(r, 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM lineitem" for a in _NUM for b in _NUM) + ")")
def correlation_matrix(s, d):
    return metrics.correlation_matrix(t(s, d, "lineitem"), list(_NUM)).select("x", "y", F.round("r", 6).alias("r"))


@query("pca_variance", """WITH m AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_extendedprice / 1000) AS b, var_samp(l_extendedprice / 1000) AS c FROM lineitem), e AS (SELECT a + c AS t, sqrt((a - c) * (a - c) + 4 * b * b) AS r FROM m)
SELECT 1 AS component, round((t + r) / 2 / t, 8) AS ratio FROM e UNION ALL SELECT 2, round((t - r) / 2 / t, 8) FROM e""")
def pca_variance(s, d):
    x = t(s, d, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("p"))
    return metrics.pca_variance(x, ["l_quantity", "p"]).select("component", F.round("ratio", 8).alias("ratio"))


@query("variable_summary", f"WITH {_DIRTY} SELECT v AS variable, round_even((n - k) * 100.0::DOUBLE / n, 2) AS missing_pct, k AS non_missing, kind FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS v, count({c}) AS k, count(*) AS n, '{'numeric' if k in ('bigint', 'double') else 'categorical'}' AS kind FROM x" for c, k in _COLS.items()) + ")")
def variable_summary(s, d):
    return metrics.variable_summary(dirty(s, d))


_E = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM v GROUP BY 1, 2)"


@query("davies_bouldin", f"""WITH {_E}, s AS (SELECT label, avg(dist) AS s FROM (SELECT vec_id, v.label, sqrt(sum((x - m) * (x - m))) AS dist FROM v JOIN c ON v.label = c.label AND v.i = c.i GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dd FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT la, max((sa.s + sb.s) / dd) AS r FROM p JOIN s sa ON sa.label = la JOIN s sb ON sb.label = lb GROUP BY la)""")
def davies_bouldin(s, d):
    return metrics.davies_bouldin(t(s, d, "embeddings"), "embedding", "label").select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query("calinski_harabasz", f"""WITH {_E}, g AS (SELECT i, avg(x) AS g FROM v GROUP BY i), w AS (SELECT sum((x - m) * (x - m)) AS w FROM v JOIN c ON v.label = c.label AND v.i = c.i), b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM c JOIN g USING (i)),
k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM embeddings) SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS calinski_harabasz, round(w, 5) AS label_wcss FROM w, b, k""")
def calinski_harabasz(s, d):
    x = metrics.calinski_harabasz(t(s, d, "embeddings"), "embedding", "label")
    return x.select(F.round("calinski_harabasz", 5).alias("calinski_harabasz"), F.round("label_wcss", 5).alias("label_wcss"))


@query("silhouette", """WITH d AS (SELECT a.vec_id AS i, a.label AS la, b.label AS lb, avg(array_distance(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64])) AS m FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
r AS (SELECT i, max(m) FILTER (WHERE la = lb) AS a, min(m) FILTER (WHERE la <> lb) AS b FROM d GROUP BY i) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM r""")
def silhouette(s, d):
    return metrics.silhouette(t(s, d, "embeddings"), "embedding", "label").select(F.round("silhouette", 6).alias("silhouette"))


@query("silhouette_centroid", """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS c FROM e GROUP BY 1, 2),
d AS (SELECT e.vec_id, e.label AS la, m.label AS lb, sqrt(sum((e.v - m.c) * (e.v - m.c))) AS d FROM e JOIN m USING (i) GROUP BY 1, 2, 3), r AS (SELECT vec_id, max(d) FILTER (WHERE la = lb) AS a, min(d) FILTER (WHERE la <> lb) AS b FROM d GROUP BY vec_id)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM r""")
def silhouette_centroid(s, d):
    return metrics.centroid_silhouette(t(s, d, "embeddings"), "embedding", "label").select(F.round("silhouette", 6).alias("silhouette"))
