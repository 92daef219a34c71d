"""Closed-form validation metrics: classification, curves, regression, drift, concentration, collinearity, clusters, components."""
import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.types import nan_to_null, numeric_columns, one_row_to_rows
from .ordered import cumulative, following, quantiles
from .reshape import safe_corr


def confusion_counts(df, y, score, threshold=0.5):
    """tp, fp, fn, tn in one pass; rows that lack a label or score are left out."""
    p = F.col(score) >= threshold
    a = F.col(y) == 1
    x = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    return x.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in (("tp", a & p), ("fp", ~a & p), ("fn", a & ~p), ("tn", ~a & ~p))))


def classification(df, y, score, threshold=0.5):
    """Accuracy, precision, recall and F1 at a threshold; a ratio without cases is 0. Single class: areas are null."""
    c = confusion_counts(df, y, score, threshold)

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    base = c.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
    return base.crossJoin(areas(df, y, score))  # both are single rows


def score_frame(df, y, score):
    """One row per distinct score with its positives and negatives and their sums from the highest score down. All curves come from it."""
    x = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select(F.col(score).cast("double").alias("score"), F.col(y).alias("y"))
    g = x.groupBy("score").agg(F.count(F.when(F.col("y") == 1, 1)).alias("pos"), F.count(F.when(F.col("y") != 1, 1)).alias("neg"))
    return cumulative(g, "score", ["pos", "neg"], ascending=False)


def areas(df, y, score):
    """roc_auc, pr_auc (average precision) and gini in one row; null unless both classes occur."""
    g = score_frame(df, y, score)
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("cum_pos", "cum_neg", "pos", "neg"))
    row = g.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(neg * (tp - pos) + neg * pos / 2).alias("u"), F.sum(pos * F.try_divide(tp, tp + fp)).alias("ap"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    auc = F.when(both, F.try_divide(F.col("u"), F.col("p").cast("double") * F.col("n")))
    return row.select(auc.alias("roc_auc"), F.when(both, F.try_divide("ap", "p")).alias("pr_auc"), (auc * 2 - 1).alias("gini"))


def roc_curve(df, y, score, drop_collinear=True):
    """(fpr, tpr, threshold) by falling score from (0, 0); points on a straight line between their neighbours are dropped. Empty for one class."""
    g = score_frame(df, y, score)
    tot = g.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    x = g.crossJoin(F.broadcast(tot)).where("p > 0 and n > 0")  # the totals are one row
    if drop_collinear:
        # a point is on the line where its step and the next have the same direction; the next step is that of the next lower score
        x = following(x, "score", ["pos", "neg"])
        x = x.where(F.col("next_pos").isNull() | (F.col("pos") * F.col("next_neg") != F.col("neg") * F.col("next_pos")))
    pts = x.select((F.col("cum_neg") / F.col("n")).alias("fpr"), (F.col("cum_pos") / F.col("p")).alias("tpr"), F.col("score").alias("threshold"))
    zero = tot.where("p > 0 and n > 0").select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return pts.unionByName(zero)


def confusion_matrix(df, y, score, threshold=0.5):
    """(actual, predicted, n): the 2 × 2 table with zeros."""
    c = confusion_counts(df, y, score, threshold)
    return one_row_to_rows(c, [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("n")) for a, p, n in ((1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn"))])


def regression(df, y, pred):
    """rmse, mae, r2 and mad (of y about its own median); r2 is null for a constant y."""
    x = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(pred).cast("double").alias("p"))
    e = F.col("y") - F.col("p")
    med = quantiles(x, ["y"], [0.5]).first()
    m = med["value"] if med else None
    one = x.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"), (F.var_pop("y") * F.count("*")).alias("sst"))
    mad = quantiles(x.select(F.abs(F.col("y") - F.lit(m)).alias("d")), ["d"], [0.5]).select(F.col("value").alias("mad"))
    return one.select("n", "rmse", "mae", (1 - F.try_divide("sse", "sst")).alias("r2")).crossJoin(mad)  # single rows


def residuals(df, y, pred, keep=()):
    """Predicted value and residual of each row."""
    x = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    return x.select(*keep, F.col(pred).alias("predicted"), (F.col(y) - F.col(pred)).alias("residual"))


def psi(df, value, split, train, test, bins=10):
    """Population stability between two values of `split`: bins at the train part's quantiles, repeats dropped, right-closed; shares
    + 1e-4, renormalised; 4 digits. Null for an empty part or a non-numeric value; 0 for a constant train part."""
    if value not in numeric_columns(df):
        return df.sparkSession.createDataFrame([(None,)], "psi double")
    x = nan_to_null(df).where(F.col(value).isNotNull())
    a = x.where(F.col(split) == train)
    edges = sorted({r["value"] for r in quantiles(a, [value], [k / bins for k in range(bins + 1)]).collect() if r["value"] is not None})
    inner = edges[1:-1]
    k = len(inner) + 1
    v = F.col(value).cast("double")
    b = F.lit(0)
    for e in inner:
        b = b + F.when(v > e, 1).otherwise(0)
    side = F.when(F.col(split) == train, "a").when(F.col(split) == test, "b") if train != test else F.lit("a")
    g = x.select(b.alias("bin"), side.alias("side")).where("side is not null").groupBy("side", "bin").agg(F.count("*").alias("n")).collect()  # at most two rows a bin
    n = {(r["side"], r["bin"]): r["n"] for r in g}
    other = "b" if train != test else "a"
    ta, tb = (sum(c for (s, _), c in n.items() if s == side) for side in ("a", other))
    out = None
    if ta and tb:
        if len(edges) < 2:
            out = 0.0
        else:
            pa = [n.get(("a", i), 0) / ta + 1e-4 for i in range(k)]
            pb = [n.get((other, i), 0) / tb + 1e-4 for i in range(k)]
            sa, sb = sum(pa), sum(pb)
            out = round(sum((p / sa - q / sb) * math.log((p / sa) / (q / sb)) for p, q in zip(pa, pb, strict=True)), 4)
    return df.sparkSession.createDataFrame([(out,)], "psi double")


def split_values(df, split, order_by):
    """(first, last) value of `split` by its first appearance in the given order."""
    rows = df.groupBy(split).agg(F.min(F.struct(*order_by)).alias("at")).agg(F.min_by(split, "at").alias("a"), F.max_by(split, "at").alias("b")).first()
    return rows["a"], rows["b"]


def hhi(df, label):
    """Sum of squared shares of the labels; missing ones are left out."""
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return g.agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("hhi"))


def smote_counts(df, y, neighbours=5):
    """(class, original, post): after oversampling each class has as many rows as the largest; none where a smaller class has too few."""
    g = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("class")).agg(F.count("*").alias("original"))
    w = Window.partitionBy(F.lit(1))  # one row per class
    g = g.withColumn("post", F.max("original").over(w)).withColumn("_least", F.min(F.when(F.col("original") < F.col("post"), F.col("original"))).over(w))
    return g.where(F.col("_least").isNull() | (F.col("_least") > neighbours)).select("class", "original", "post")


#: Rows of a slice of hashes.
SLICE = 8192


def smote_rows(df, y, features, key, neighbours=5, block=32768):
    """(class, number, features): the rows that oversampling adds to the classes smaller than the largest. No rows where smote_counts gives none.

    Each new row lies between a row of its class and one of that row's nearest neighbours; which, and where, follows from hashes of the
    keys, so the result is repeatable. Missing features are 0; rows with infinite ones or NaN are left out. Only rows that a new one starts
    from look for neighbours, in ranges of about `block` rows, so no class is in one place."""
    from .neighbours import nearest_rows

    spark, kind = df.sparkSession, dict(df.dtypes)[y]
    short = [r for r in smote_counts(df, y, neighbours).collect() if r["post"] > r["original"]]  # one row per class
    if not short:
        return spark.createDataFrame([], f"class {kind}, number bigint, features array<double>")
    p = len(features)
    more = spark.createDataFrame([(r["class"], i, r["post"] - r["original"]) for i, r in enumerate(short)], f"class {kind}, g int, extra bigint")
    x = df.where(F.col(y).isNotNull()).select(F.col(y).alias("class"), F.col(key).cast("string").alias("key"), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, f in enumerate(features)))
    x = x.where(" and ".join(["true"] + [f"abs(f{i}) < double('infinity')" for i in range(p)])).join(F.broadcast(more), "class").withColumn("h", F.xxhash64("key"))
    # row number i of a class starts from its row number i modulo the class size, in the order of hashed keys; leading bits of the hash make slices of about one size
    bits = max(0, min((max(r["original"] for r in short) // SLICE).bit_length(), 16 - len(short).bit_length()))
    x = x.withColumn("s", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("bigint"))
    w = Window.partitionBy("g")
    slices = x.groupBy("g", "s").agg(F.count("*").alias("n"))
    slices = slices.select("g", "s", (F.sum("n").over(w.orderBy("s")) - F.col("n")).alias("start"), F.sum("n").over(w).alias("n"))
    x = x.join(F.broadcast(slices), ["g", "s"])  # at most 2 ** 16 rows, or one per class
    at = (F.col("start") + F.row_number().over(Window.partitionBy("g", "s").orderBy("h", "key")) - 1).cast("bigint")
    first = x.where("start < extra").withColumn("at", at).withColumn("number", F.when(F.col("at") < F.col("extra"), F.col("at")))
    rest = x.where("start >= extra").withColumn("number", F.lit(None).cast("bigint"))
    columns = ["g", "key", "number", *(f"f{i}" for i in range(p))]
    near = nearest_rows(first.select(*columns).unionByName(rest.select(*columns)), sum(r["original"] for r in short), p, neighbours, block)
    sizes = slices.groupBy("g").agg(F.first("n").alias("n"))
    at = near.where("size(near) > 0").join(F.broadcast(more.join(sizes, "g")), "g")  # one row per class
    at = at.withColumn("number", F.explode(F.sequence("number", F.col("extra") - 1, F.col("n")))).withColumnRenamed("key", "k")
    r = F.pmod(F.xxhash64("k", "number"), F.lit(1_000_003))
    pick = F.element_at("near", (F.pmod(r, F.size("near")) + 1).cast("int"))["w"]
    gap = F.pmod(F.xxhash64("number", "k"), F.lit(1_000_003)) / 1_000_003
    return at.select("class", "number", F.zip_with("v", pick, lambda a, b: a + (b - a) * gap).alias("features"))


def gram(df, columns):
    """Matrix of sums of products of columns and the row count, in one aggregation of p(p+1)/2 sums."""
    p = len(columns)
    cols = [F.col(c).cast("double") for c in columns]
    aggs = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    r = df.agg(F.count("*").alias("n"), F.count(F.when(sum((c.isNull().cast("int") for c in cols), F.lit(0)) > 0, 1)).alias("gone"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)), *aggs).first()
    g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    return g, np.array([r[f"s{i}"] or 0.0 for i in range(p)]), r["n"], r["gone"]


def vif(df, columns):
    """(variable, vif) from the uncentred fit of each column on the others, falling. Any missing value, or a singular matrix, gives no rows."""
    g, _, _, gone = gram(df, columns)
    rows = []
    if not gone and len(columns) > 1:
        try:
            inv = np.linalg.inv(g)
            rows = [(c, float(g[i, i] * inv[i, i])) for i, c in enumerate(columns)]
        except np.linalg.LinAlgError:
            rows = []
    return df.sparkSession.createDataFrame(rows, "variable string, vif double").orderBy(F.desc("vif"), "variable")


def correlation_matrix(df, columns, fill=0.0):
    """(x, y, r) for every pair; missing values are filled with `fill`, or left out pairwise where it is None. Null where one is constant."""
    x = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(fill)).alias(c) if fill is not None else F.col(c).cast("double").alias(c) for c in columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = x.agg(*(safe_corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    cells = [F.struct(F.lit(p).alias("x"), F.lit(q).alias("y"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs) for p, q in ({(a, b), (b, a)})]
    return one_row_to_rows(row, cells)


def pca_variance(df, columns):
    """(component, ratio): shares of variance of the principal components, missing values as 0, falling. The matrix is p × p on the driver."""
    x = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    g, s, n, _ = gram(x, columns)
    if n < 2:
        return df.sparkSession.createDataFrame([], "component int, ratio double")
    cov = (g - np.outer(s, s) / n) / (n - 1)
    w = np.clip(np.linalg.eigvalsh(cov)[::-1], 0, None)[: min(n, len(columns))]
    total = w.sum() or 1.0
    return df.sparkSession.createDataFrame([(i + 1, float(v / total)) for i, v in enumerate(w)], "component int, ratio double")


def variable_summary(df):
    """Variable, share missing in per cent (2 digits), non-missing count and kind of each column, before any row is dropped."""
    from .quality import missing

    m = missing(df)
    n = df.agg(F.count("*").alias("_n"))
    num = F.lit(False)
    cols = numeric_columns(df)
    if cols:
        num = F.col("column").isin(cols)
    return m.crossJoin(F.broadcast(n)).select(F.col("column").alias("variable"), "missing_pct", (F.col("_n") - F.col("missing_count")).alias("non_missing"), F.when(num, "numeric").otherwise("categorical").alias("kind"))


# ---- clusters -------------------------------------------------------------------------------------------------------------------

def _moments(df, vector, label):
    """Per label: count and mean of each dimension, from one exploded aggregation."""
    x = df.select(F.col(label).cast("string").alias("label"), F.posexplode(vector).alias("i", "v"))
    return x.groupBy("label", "i").agg(F.count("*").alias("n"), F.avg(F.col("v").cast("double")).alias("m"))


def centroids(df, vector, label):
    """label, n, centre: labels are few, so the result is small."""
    m = _moments(df, vector, label)
    return m.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


def _sq(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _with_centre(df, vector, label):
    c = centroids(df, vector, label)
    x = df.select(F.col(label).cast("string").alias("label"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    return x.join(c, "label"), c  # the planner measures the centres, one row per label


def davies_bouldin(df, vector, label):
    """Mean over labels of the worst (S_i + S_j) / d_ij, S the mean distance to the centre."""
    x, c = _with_centre(df, vector, label)
    s = x.groupBy("label").agg(F.avg(F.sqrt(_sq("v", "centre"))).alias("s")).join(c, "label")
    every = s.agg(F.collect_list(F.struct("label", "s", "centre")).alias("all"))  # one row; labels are few by the nature of clusters
    worst = F.array_max(F.transform(F.filter("all", lambda k: k["label"] != F.col("label")), lambda k: F.try_divide(F.col("s") + k["s"], F.sqrt(_sq(F.col("centre"), k["centre"])))))
    return s.crossJoin(F.broadcast(every)).select(worst.alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df, vector, label):
    """Between over within dispersion by degrees of freedom; also the within sum of squares of the given labels."""
    x, c = _with_centre(df, vector, label)
    w = x.agg(F.sum(_sq("v", "centre")).alias("within"), F.count("*").alias("n"))
    dims = c.select("n", F.posexplode("centre").alias("i", "m"))
    grand = dims.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    b = dims.join(F.broadcast(grand), "i").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), F.lit(2))).alias("between"))
    k = c.agg(F.count("*").alias("k"))
    one = w.crossJoin(b).crossJoin(k)  # single rows
    return one.select(
        F.try_divide(F.col("between") / F.try_subtract("k", F.lit(1)), F.try_divide(F.col("within"), F.col("n") - F.col("k"))).alias("calinski_harabasz"), F.col("within").alias("label_wcss"))


def centroid_silhouette(df, vector, label):
    """Mean silhouette with distances to cluster centres in place of mean distances to their rows: linear in rows times labels, where the
    exact form is quadratic in rows. Centres travel in one array, so rows are not multiplied; labels are few by the nature of clusters."""
    c = centroids(df, vector, label)
    every = c.agg(F.collect_list(F.struct("label", "centre")).alias("centres"))  # one row
    x = df.select(F.col(label).cast("string").alias("label"), F.transform(vector, lambda v: v.cast("double")).alias("v")).crossJoin(F.broadcast(every))
    far = F.transform("centres", lambda k: F.struct(k["label"].alias("label"), F.sqrt(_sq(F.col("v"), k["centre"])).alias("d")))
    x = x.select("label", far.alias("far"))
    a = F.filter("far", lambda k: k["label"] == F.col("label"))[0]["d"]
    b = F.array_min(F.transform(F.filter("far", lambda k: k["label"] != F.col("label")), lambda k: k["d"]))
    return x.select(a.alias("a"), b.alias("b")).agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def silhouette(df, vector, label, block=2048):
    """Mean Euclidean silhouette over labels. Exact, so quadratic: rows are cut into blocks by hash, and every pair of blocks is one task
    that returns sums of distances per row and label; nothing but a block pair is ever in one place. Singletons count 0. For tables that are too
    large for this there is `centroid_silhouette`."""
    import pandas as pd

    x = df.select(F.monotonically_increasing_id().alias("i"), F.col(label).cast("string").alias("label"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    from ..session import checkpoint

    x = checkpoint(x)
    n = x.count()
    parts = max(1, -(-n // block))
    x = x.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int"))
    ids = F.sequence(F.lit(0), F.lit(parts - 1))
    left = x.withColumn("o", F.explode(ids)).withColumn("side", F.lit(0))
    right = x.withColumn("o", F.col("b")).withColumn("b", F.explode(ids)).withColumn("side", F.lit(1))
    u = left.unionByName(right)

    def pair(pdf):
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"i": [], "label": [], "other": [], "s": [], "n": []}).astype({"i": "int64", "n": "int64", "s": "float64"})
        va, vb = np.stack(a.v.to_list()), np.stack(b.v.to_list())
        d = np.sqrt(np.clip((va * va).sum(1)[:, None] + (vb * vb).sum(1)[None, :] - 2 * va @ vb.T, 0, None))
        same = a.i.to_numpy()[:, None] == b.i.to_numpy()[None, :]
        d[same] = 0.0
        out = []
        for lab, idx in b.reset_index(drop=True).groupby("label").indices.items():
            out.append(pd.DataFrame({"i": a.i.to_numpy(), "label": a.label.to_numpy(), "other": lab, "s": d[:, idx].sum(1), "n": (~same[:, idx]).sum(1)}))
        return pd.concat(out)

    g = u.groupBy("b", "o").applyInPandas(pair, "i bigint, label string, other string, s double, n bigint")
    g = g.groupBy("i", "label", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("d", F.try_divide("s", "n"))
    r = g.groupBy("i", "label").agg(F.max(F.when(F.col("label") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("other"), F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return r.agg(F.avg(s).alias("silhouette"))
