"""Model-based validation tests: forests as surrogates, folds, learning curves, importance, Shapley values, robustness, k-means."""
import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from .ordered import cumulative

TREES, SEED, CURVE_ROWS, TOP_FEATURES = 100, 42, 3000, 15


def prepare(df, y, features, key):
    """(key, label, features): rows with a label; missing features are 0."""
    x = df.where(F.col(y).isNotNull()).select(*key, F.col(y).cast("double").alias("label"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(x)


def forest(classification, depth=5, trees=TREES):
    kind = RandomForestClassifier if classification else RandomForestRegressor
    return kind(featuresCol="features", labelCol="label", maxDepth=depth, numTrees=trees, seed=SEED)


def score(model, df, classification):
    """Accuracy or R² of a model."""
    p = model.transform(df)
    if classification:
        return p.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    r = p.agg(F.sum(F.pow(F.col("label") - F.col("prediction"), F.lit(2))).alias("sse"), (F.var_pop("label") * F.count("*")).alias("sst")).first()
    return 1 - r["sse"] / r["sst"] if r["sst"] else None


def positions(df, key):
    """`df` with `_pos` from 0 in order of a unique key, without a single-task sort."""
    one = df.withColumn("_one", F.lit(1))
    return cumulative(one, key, ["_one"]).withColumn("_pos", F.col("cum__one") - 1).drop("_one", "cum__one")


def folds(df, key, k, stratify=None):
    """`df` with `fold`: contiguous blocks in order of the key, as even as can be, within each class if `stratify` is given."""
    if stratify is None:
        n = df.count()
        return _blocks(positions(df, key), n, k)
    out = None
    for r in df.groupBy(stratify).agg(F.count("*").alias("n")).orderBy(stratify).collect():  # one row per class
        part = _blocks(positions(df.where(F.col(stratify) == r[0]), key), r["n"], k)
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(df, n, k):
    size, more = divmod(n, k)
    cut = more * (size + 1)
    fold = F.when(F.col("_pos") < cut, F.floor(F.col("_pos") / (size + 1))).otherwise(more + F.floor((F.col("_pos") - cut) / max(size, 1)))
    return df.withColumn("fold", fold.cast("int")).drop("_pos")


def cv_score(df, y, features, key, classification, k=5, depth=5, trees=TREES):
    """(mean, std): scores over k folds, with the population deviation."""
    x = folds(prepare(df, y, features, [key]), key, k, "label" if classification else None).cache()
    out = [score(forest(classification, depth, trees).fit(x.where(F.col("fold") != i)), x.where(F.col("fold") == i), classification) for i in range(k)]
    x.unpersist()
    return df.sparkSession.createDataFrame([(float(np.mean(out)), float(np.std(out)))], "cv_mean double, cv_std double")


def learning_curve(df, y, features, key, classification, k=3, depth=5, trees=TREES, rows=CURVE_ROWS):
    """(train_size, train_score, test_score): means over k folds at five sizes from 10 % to 100 % of the training part of the first rows, or of all if `rows` is None."""
    first = df.where(F.col(y).isNotNull())
    if rows is not None:
        first = first.orderBy(key).limit(rows)
    x = folds(prepare(first, y, features, [key]), key, k, "label" if classification else None).cache()
    n = x.count()
    sizes = [max(1, int(f * (n - -(-n // k)))) for f in np.linspace(0.1, 1.0, 5)]
    tr, te = [[] for _ in sizes], [[] for _ in sizes]
    for i in range(k):
        train = positions(x.where(F.col("fold") != i).withColumn("_h", F.xxhash64(key)), "_h").cache()  # in a seeded order, and no single task has it all
        test = x.where(F.col("fold") == i)
        for j, size in enumerate(sizes):
            part = train.where(F.col("_pos") < size)
            m = forest(classification, depth, trees).fit(part)
            tr[j].append(score(m, part, classification))
            te[j].append(score(m, test, classification))
        train.unpersist()
    out = [(size, float(np.mean(a)), float(np.mean(b))) for size, a, b in zip(sizes, tr, te, strict=True)]
    x.unpersist()
    return df.sparkSession.createDataFrame(out, "train_size int, train_score double, test_score double")


def feature_importance(df, y, features, key, classification, depth=5, trees=TREES):
    """(feature, importance) of the forest's impurity decrease; the highest fifteen, rising."""
    m = forest(classification, depth, trees).fit(prepare(df, y, features, [key]))
    rows = sorted(zip(features, (float(v) for v in m.featureImportances.toArray()), strict=True), key=lambda r: (r[1], r[0]))[-TOP_FEATURES:]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def _tree(node, classification, positive):
    """A fitted tree as leaves: (value, [(feature, threshold or left set, goes left, share of the parent's rows)])."""
    out = []

    def value(n):
        st = list(n.impurityStats().stats())
        if classification:
            t = sum(st) or 1.0
            return st[positive] / t
        return st[1] / st[0] if st[0] else 0.0

    def count(n):
        st = list(n.impurityStats().stats())
        return sum(st) if classification else st[0]

    def walk(n, path):
        if n.getClass().getSimpleName() == "LeafNode":
            out.append((value(n), path))
            return
        s, c = n.split(), count(n) or 1.0
        cond = (s.featureIndex(), float(s.threshold()))
        walk(n.leftChild(), [*path, (*cond, True, count(n.leftChild()) / c)])
        walk(n.rightChild(), [*path, (*cond, False, count(n.rightChild()) / c)])

    walk(node, [])
    return out


def tree_shap(leaves, x):
    """Path-dependent Shapley values of one tree for rows x (n × p), and its mean prediction.

    A leaf's value belongs to the features on its path. With o the share of a feature's conditions that a row meets (0 or 1) and z
    the share of training rows that pass them, a feature's part is the weighted sum over subsets of the others, gathered as the
    coefficients of the product of (z + o·t)."""
    n, p = x.shape
    phi = np.zeros((n, p))
    base = 0.0
    for value, path in leaves:
        o, z = {}, {}
        for f, thr, left, share in path:
            ok = x[:, f] <= thr if left else x[:, f] > thr
            o[f] = o[f] * ok if f in o else ok.astype(float)
            z[f] = z.get(f, 1.0) * share
        m = len(o)
        base += value * math.prod(z.values())
        for i in o:
            poly = [np.ones(n)]
            for j in o:
                if j == i:
                    continue
                new = [np.zeros(n) for _ in range(len(poly) + 1)]
                for d, c in enumerate(poly):
                    new[d] += c * z[j]
                    new[d + 1] += c * o[j]
                poly = new
            w = sum(c * (math.factorial(d) * math.factorial(m - d - 1) / math.factorial(m)) for d, c in enumerate(poly))
            phi[:, i] += w * (o[i] - z[i]) * value
    return phi, base


def shap_values(model, df, features, key, classification, positive=1):
    """(key, one column per feature, base): Shapley values of each row. The forest is small (trees of bounded depth) and is shared once."""
    trees = [_tree(t._java_obj.rootNode(), classification, positive) for t in model.trees]
    shared = df.sparkSession.sparkContext.broadcast(trees)
    kind = dict(df.dtypes)

    def run(batches):
        for b in batches:
            x = b[list(features)].to_numpy(float)
            phi, base = np.zeros(x.shape), 0.0
            for t in shared.value:
                q, c = tree_shap(t, x)
                phi += q
                base += c
            k = len(shared.value)
            out = pd.DataFrame(phi / k, columns=list(features))
            out.insert(0, key, b[key].to_numpy())
            out["base"] = base / k
            yield out

    schema = f"`{key}` {kind[key]}, " + ", ".join(f"`{f}` double" for f in features) + ", base double"
    return df.select(key, *features).mapInPandas(run, schema)


def shap_importance(df, y, features, key, classification, depth=5, trees=TREES):
    """(feature, mean_abs_shap), the highest fifteen, falling."""
    x = prepare(df, y, features, [key])
    m = forest(classification, depth, trees).fit(x)
    s = shap_values(m, x.drop("features"), features, key, classification)
    row = s.agg(*(F.avg(F.abs(f)).alias(f) for f in features))
    return row.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_shap")) for f in features)))).orderBy(F.desc("mean_abs_shap"), "feature").limit(TOP_FEATURES)


def noise(key, salt):
    """A standard normal number from a row's key, the same in every run and partitioning."""
    u = (F.pmod(F.xxhash64(key, F.lit(f"{salt}a")), F.lit(2**31 - 1)) + 1) / float(2**31)
    v = F.pmod(F.xxhash64(key, F.lit(f"{salt}b")), F.lit(2**31 - 1)) / float(2**31)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def robustness(df, y, features, key, classification, level=0.05, depth=5, trees=TREES):
    """(test, score): the forest on its own data, on data with seeded noise of 5 % of each deviation, and the difference."""
    x = prepare(df, y, features, [key]).cache()
    m = forest(classification, depth, trees).fit(x)
    sd = x.agg(*(F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias(f) for f in features)).first()
    noisy = x.drop("features").withColumns({f: F.col(f) + noise(key, f) * (level * sd[f]) for f in features})
    noisy = VectorAssembler(inputCols=list(features), outputCol="features").transform(noisy)
    a, b = score(m, x, classification), score(m, noisy, classification)
    x.unpersist()
    return df.sparkSession.createDataFrame([("baseline", a), ("noisy", b), ("degradation", a - b)], "test string, score double")


def kmeans_wcss(df, vector, label):
    """Within sum of squares of a fresh k-means with as many clusters as there are labels."""
    k = df.select(label).distinct().count()
    m = KMeans(k=max(k, 2), seed=SEED, featuresCol="f").fit(df.select(array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("f")))
    return df.sparkSession.createDataFrame([(k, float(m.summary.trainingCost))], "k int, wcss double")
