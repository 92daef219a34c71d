"""Binning, encoding, products and corrected moments."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from .ordered import quantiles, ranks


def cut(column, edges):
    """The number of right-closed bins below a value: 0 up to the first edge, then one more for each edge passed. Null stays null."""
    x = F.col(column)
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(x <= edges[k], k).otherwise(out)
    return F.when(x.isNull(), None).otherwise(out)


def qcut(df, column, bins):
    """`df` with `bin`: equal-frequency bins at exact quantiles, right-closed, repeated edges dropped."""
    rows = quantiles(df, [column], [k / bins for k in range(1, bins)]).collect()
    edges = sorted({r["value"] for r in rows if r["value"] is not None})
    return df.withColumn("bin", cut(column, edges))


def factorize(df, column, name):
    """`df` with codes 0.. of the sorted distinct values, -1 for null. Distinct values are ranked, not rows, by ranges."""
    return df.join(ranks(df, column, name), column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def cumprod(column, window):
    """Running product by logarithms, with sign and zeros kept apart."""
    w = window.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(column)
    zero = F.max(F.when(x == 0, 1).otherwise(0)).over(w)
    sign = F.pmod(F.sum(F.when(x < 0, 1).otherwise(0)).over(w), F.lit(2))
    size = F.exp(F.sum(F.when(x != 0, F.log(F.abs(x)))).over(w))
    return F.when(zero == 1, F.lit(0.0)).otherwise(F.when(sign == 1, -size).otherwise(size))


def skew(column):
    """Bias-corrected skewness; null under three values or without spread."""
    n = F.count(column)
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def kurt(column):
    """Bias-corrected excess kurtosis; null under four values or without spread."""
    n = F.count(column)
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(column) + 6.0))


def safe_corr(x, y):
    """Pearson correlation over rows that have both; null where either is constant."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sx = F.stddev_pop(F.when(b.isNotNull(), a))
    sy = F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), sx * sy)


def statistics(df, x="l_quantity", y="l_extendedprice", z="l_discount"):
    """One row: correlation, covariance, corrected skewness and kurtosis, standard error, 0.9 quantile, median absolute deviation."""
    q = quantiles(df, [y], [0.9]).select(F.round("value", 6).alias("q90"))
    med = quantiles(df, [x], [0.5]).first()["value"]
    mad = quantiles(df.select(F.abs(F.col(x) - med).alias("e")), ["e"], [0.5]).select(F.round("value", 6).alias("mad"))
    one = df.agg(
        F.round(safe_corr(x, y), 6).alias("r"), F.round(F.covar_samp(x, z), 6).alias("cov"), F.round(skew(y), 5).alias("skew"), F.round(kurt(y), 5).alias("kurt"),
        F.round(F.stddev_samp(x) / F.sqrt(F.count(x)), 8).alias("sem"))
    return one.crossJoin(q).crossJoin(mad)  # single rows
