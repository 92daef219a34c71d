"""Queries of the model-based tests and of the battery as a whole."""
from pyspark.sql import functions as F

from ..operators import battery, surrogate
from ..session import table as t
from .registry import query

_X = ["p_retailprice", "p_size", "noise"]


def parts(s, d):
    """Parts as a small supervised table: the label depends on size, the target on price."""
    return t(s, d, "part").select(
        "p_partkey", "p_retailprice", "p_size", F.pmod(F.xxhash64("p_partkey"), F.lit(1000)).cast("double").alias("noise"), F.when(F.col("p_size") > 25, 1).otherwise(0).alias("y"),
        (F.col("p_retailprice") * 2 + F.col("p_size")).alias("target"))


@query("cv_score")
def cv_score(s, d):
    return surrogate.cv_score(parts(s, d), "y", _X, "p_partkey", True)


@query("learning_curve")
def learning_curve(s, d):
    return surrogate.learning_curve(parts(s, d), "target", _X, "p_partkey", False, rows=None)


@query("feature_importance")
def feature_importance(s, d):
    return surrogate.feature_importance(parts(s, d), "y", _X, "p_partkey", True)


@query("shap_importance")
def shap_importance(s, d):
    return surrogate.shap_importance(parts(s, d), "y", _X, "p_partkey", True)


@query("robustness")
def robustness(s, d):
    return surrogate.robustness(parts(s, d), "y", _X, "p_partkey", True)


@query("kmeans_wcss")
def kmeans_wcss(s, d):
    return surrogate.kmeans_wcss(t(s, d, "embeddings"), "embedding", "label")


_SCORED = "s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount * 10 AS score, l_linestatus AS split, l_orderkey || '-' || l_linenumber AS k FROM lineitem)"


@query("execution_metrics", f"""WITH {_SCORED}, g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY score), c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC)),
a AS (SELECT sum(neg * (tp - pos) + neg * pos / 2.0::DOUBLE) / (sum(pos)::DOUBLE * sum(neg)) AS auc, sum(pos * (tp::DOUBLE / (tp + fp))) / sum(pos) AS ap FROM c),
k AS (SELECT count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn FROM s),
f AS (SELECT split, min(k) AS k FROM s GROUP BY split), ab AS (SELECT arg_min(split, k) AS a, arg_max(split, k) AS b FROM f),
e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM s, ab WHERE split = a),
n AS (SELECT split, len(list_filter(q[2:-2], lambda x: score > x)) AS bin FROM s, e), v AS (SELECT unnest(range(len(q) - 1)) AS bin FROM e),
h AS (SELECT v.bin, count(*) FILTER (WHERE split = a) AS na, count(*) FILTER (WHERE split = b) AS nb FROM v LEFT JOIN n USING (bin), ab GROUP BY v.bin), i AS (SELECT na / sum(na) OVER () + 1e-4 AS pa, nb / sum(nb) OVER () + 1e-4 AS pb FROM h),
j AS (SELECT pa / sum(pa) OVER () AS pa, pb / sum(pb) OVER () AS pb FROM i)
SELECT 'performance' AS test, k.tp, k.fp, fn, tn, round((k.tp + tn) / (k.tp + k.fp + fn + tn)::DOUBLE, 8) AS accuracy, round(k.tp / (k.tp + k.fp)::DOUBLE, 8) AS precision, round(k.tp / (k.tp + fn)::DOUBLE, 8) AS recall,
round(2 * k.tp / (2 * k.tp + k.fp + fn)::DOUBLE, 8) AS f1, round(auc, 8) AS roc_auc, round(ap, 8) AS pr_auc, round(2 * auc - 1, 8) AS gini, NULL::DOUBLE AS psi FROM k, a
UNION ALL BY NAME SELECT 'gini' AS test, round(2 * auc - 1, 8) AS gini FROM a UNION ALL BY NAME SELECT 'drift' AS test, round(sum((pa - pb) * ln(pa / pb)), 4) AS psi FROM j""")
def execution_metrics(s, d):
    x = t(s, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), (F.col("l_discount") * 10).alias("score"), "l_linestatus", "l_quantity", "l_tax", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"))
    m = battery.execution_metrics(battery.run(x, "classification", "y", "score", "l_linestatus", ["performance", "gini"], key="k"))
    return m.select("test", "tp", "fp", "fn", "tn", *(F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "gini")), "psi")


@query("test_dictionary", "SELECT * FROM (VALUES " + ", ".join("('" + "', '".join(x.replace("'", "''") for x in r[:3]) + "')" for r in battery.CATALOG) + ") v(model_type, test, description)")
def test_dictionary(s, d):
    return battery.dictionary(s)
