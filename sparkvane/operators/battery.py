"""The validation battery: a catalogue of tests per model type, each a pure function of a scored table, run in isolation."""
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions.types import numeric_columns
from . import metrics, surrogate, vision
from .ordered import places

DEFAULTS = {"clf_threshold": 0.5, "surrogate_depth": 5, "smote_neighbors": 5, "psi_bins": 10, "blur_threshold": 100.0, "trees": surrogate.TREES}
SUPERVISED = ("classification", "regression")


@dataclass
class Context:
    """A scored table: observed, predicted and split columns, a unique key, the features, and the options."""

    raw: object
    df: object
    model_type: str
    observed: str
    predicted: str
    split: str | None
    key: str
    features: list
    options: dict


@dataclass
class TestResult:
    name: str
    tables: dict = field(default_factory=dict)
    metrics: object = None
    error: str | None = None


def _performance(c):
    o = c.options
    if c.model_type == "classification":
        m = metrics.classification(c.df, c.observed, c.predicted, o["clf_threshold"])
        two = c.df.select(c.observed).where(F.col(c.observed).isNotNull()).distinct().limit(3).count() == 2
        curves = {"roc_curve": metrics.roc_curve(c.df, c.observed, c.predicted), "confusion_matrix": metrics.confusion_matrix(c.df, c.observed, c.predicted, o["clf_threshold"])} if two else {}
        return m, curves
    return metrics.regression(c.df, c.observed, c.predicted), {"residuals": metrics.residuals(c.df, c.observed, c.predicted)}


def _drift(c):
    if not c.split:
        return None, {}
    a, b = metrics.split_values(c.df, c.split, [c.key])
    return metrics.psi(c.df, c.predicted, c.split, a, b, c.options["psi_bins"]), {}


def _model(f):
    def run(c):
        return None, {f.__name__: f(c.df, c.observed, c.features, c.key, c.model_type == "classification", depth=c.options["surrogate_depth"], trees=c.options["trees"])}

    return run


def _cv(c):
    return surrogate.cv_score(c.df, c.observed, c.features, c.key, c.model_type == "classification", trees=c.options["trees"]), {}


def _vectors(c):
    return c.df.select(F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in c.features)).alias("v"), F.col(c.predicted).alias("label"))


def _clusters(c):
    v = _vectors(c)
    return metrics.silhouette(v, "v", "label").crossJoin(metrics.davies_bouldin(v, "v", "label")).crossJoin(metrics.calinski_harabasz(v, "v", "label")).crossJoin(surrogate.kmeans_wcss(v, "v", "label")), {}  # single rows


#: (model type, test name, what it reports, function). The same text makes the dictionary table.
CATALOG = [
    ("classification", "performance", "accuracy, precision, recall, F1, areas under ROC and PR, ROC curve, confusion matrix", _performance),
    ("classification", "gini", "2 · AUC − 1", lambda c: (metrics.areas(c.df, c.observed, c.predicted).select("gini"), {})),
    ("classification", "class_imbalance", "class counts before and after oversampling", lambda c: (None, {"smote_counts": metrics.smote_counts(c.df, c.observed, c.options["smote_neighbors"])})),
    ("classification", "multicollinearity", "variance inflation factors", lambda c: (None, {"vif": metrics.vif(c.df, c.features)})),
    ("classification", "cross_validation", "mean and deviation of five fold scores", _cv),
    ("classification", "learning_curve", "scores by training size", lambda c: (None, {"learning_curve": surrogate.learning_curve(c.df, c.observed, c.features, c.key, True, depth=c.options["surrogate_depth"], trees=c.options["trees"])})),
    ("classification", "feature_importance", "impurity importance of the surrogate", _model(surrogate.feature_importance)),
    ("classification", "shap", "mean absolute Shapley values of the surrogate", _model(surrogate.shap_importance)),
    ("classification", "robustness", "score under noise", _model(surrogate.robustness)),
    ("regression", "performance", "RMSE, MAE, R², median absolute deviation, residuals", _performance),
    ("regression", "multicollinearity", "variance inflation factors", lambda c: (None, {"vif": metrics.vif(c.df, c.features)})),
    ("regression", "cross_validation", "mean and deviation of five fold scores", _cv),
    ("regression", "learning_curve", "scores by training size", lambda c: (None, {"learning_curve": surrogate.learning_curve(c.df, c.observed, c.features, c.key, False, depth=c.options["surrogate_depth"], trees=c.options["trees"])})),
    ("regression", "feature_importance", "impurity importance of the surrogate", _model(surrogate.feature_importance)),
    ("regression", "shap", "mean absolute Shapley values of the surrogate", _model(surrogate.shap_importance)),
    ("regression", "robustness", "score under noise", _model(surrogate.robustness)),
    ("clustering", "cluster_quality", "silhouette, Davies-Bouldin, Calinski-Harabasz, within sum of squares", _clusters),
    ("clustering", "concentration", "Herfindahl index of the predicted labels", lambda c: (metrics.hhi(c.df, c.predicted), {})),
    ("dim-reduction", "pca_variance", "shares of variance of the components", lambda c: (None, {"pca_variance": metrics.pca_variance(c.df, c.features)})),
    ("dim-reduction", "correlation", "correlation matrix of the features", lambda c: (None, {"correlation_matrix": metrics.correlation_matrix(c.df, c.features)})),
    ("vision", "image_quality", "Laplacian variance, edge density, verdict", None),
    ("vision", "image_noise", "images with added noise", None),
]


def dictionary(spark, model_type=None):
    """The catalogue as a table."""
    return spark.createDataFrame([(a, b, c) for a, b, c, _ in CATALOG if model_type in (None, a)], "model_type string, test string, description string")


def names(model_type):
    return [b for a, b, _, _ in CATALOG if a == model_type]


def numbered(df):
    """`df` with its rows numbered in `_row`, in the order of their hashed values, so that the numbers do not depend on the partitioning."""
    cols = [f"`{c}`" for c in df.columns if not dict(df.dtypes)[c].startswith("map")]
    return places(df.withColumn("_h", F.xxhash64(*cols)), ["_h", *cols], "_row").drop("_h")


def run(df, model_type, observed, predicted, split=None, tests=None, key=None, options=None):
    """Results by test name; no tests means all of the type. Each test fails on its own: its error is kept and the others run.

    Rows without observed or predicted value are left out; features are the other numeric columns. Columns and names are checked first."""
    if model_type not in {a for a, *_ in CATALOG} - {"vision"}:
        raise ValueError(f"unknown model type {model_type!r}")
    for c in (observed, predicted, *([split] if split else [])):
        if c not in df.columns:
            raise ValueError(f"no column {c!r}")
    wanted = list(tests or names(model_type))
    if unknown := [x for x in wanted if x not in names(model_type)]:
        raise ValueError(f"unknown tests for {model_type}: {', '.join(unknown)}; one of {', '.join(names(model_type))}")
    opts = DEFAULTS | (options or {})
    raw = df
    if key is None:
        key, df = "_row", numbered(df)
    x = df.where(F.col(observed).isNotNull() & F.col(predicted).isNotNull())
    feats = numeric_columns(x, but=(observed, predicted, split, key))
    c = Context(raw, x, model_type, observed, predicted, split, key, feats, opts)
    out = {"variable_summary": TestResult("variable_summary", {"variable_summary": metrics.variable_summary(raw)})}
    for a, b, _, f in CATALOG:
        if a == model_type and b in wanted:
            try:
                m, tables = f(c)
                out[b] = TestResult(b, tables, m)
            except Exception as e:  # kept with the test; the rest of the battery goes on
                out[b] = TestResult(b, error=f"{type(e).__name__}: {e}")
    if split:
        try:
            out["drift"] = TestResult("drift", {}, _drift(c)[0])
        except Exception as e:
            out["drift"] = TestResult("drift", error=f"{type(e).__name__}: {e}")
    return out


def run_vision(spark, folder, tests=None, options=None):
    """Results of the image tests over a folder; a folder without images gives none."""
    opts = DEFAULTS | (options or {})
    try:
        x = vision.images(spark, folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}  # the folder is missing: no result and no error
    out = {}
    for t in tests or names("vision"):
        out[t] = TestResult(t, {t: vision.quality(x, opts["blur_threshold"]) if t == "image_quality" else vision.noisy(x)})
    return out


def execution_metrics(results):
    """One row per test with metrics, over the union of their columns."""
    out = None
    for r in results.values():
        if r.metrics is not None:
            row = r.metrics.withColumn("test", F.lit(r.name))
            out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def summary_text(results, rows=40):
    """What the results say, tables cut at 40 rows; curve data are named by size only."""
    out = []
    for r in results.values():
        out.append(f"## {r.name}" + (f": {r.error}" if r.error else ""))
        if r.metrics is not None:
            out.append(r.metrics.limit(1).toPandas().to_string(index=False))
        for n, t in r.tables.items():
            if n in ("roc_curve", "residuals"):
                out.append(f"{n}: {t.count()} rows")
            else:
                out.append(f"{n}:\n{t.limit(rows).toPandas().to_string(index=False)}")
    return "\n".join(out)
