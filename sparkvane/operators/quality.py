"""Data-quality profile of a table: missing values, description, outliers, validity, and the data of its plots."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.types import nan_to_null, numeric_columns, one_row_to_rows, other_columns
from .ordered import quantiles

#: Numeric columns that are plotted, bins of a histogram, distinct values up to which a column has a frequency plot, and its bars.
PLOT_COLUMNS, HISTOGRAM_BINS, MAX_CATEGORIES, TOP_VALUES = 12, 30, 50, 10


def missing(df):
    """column, dtype, missing_count, missing_pct (half-even, 2 digits) of every column, in one pass. An empty table has 0 %."""
    df = nan_to_null(df)
    row = df.agg(F.count("*").alias("_n"), *(F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"m{k}") for k, c in enumerate(df.columns)))
    kinds = dict(df.dtypes)
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(f"m{k}").alias("missing_count"), F.bround(F.col(f"m{k}") * 100.0 / F.greatest("_n", F.lit(1)), 2).alias("missing_pct"))
        for k, c in enumerate(df.columns)]
    return one_row_to_rows(row, cells).orderBy(F.desc("missing_pct"), "column")


def long_values(df, columns):
    """(column, value as string) of the non-null cells of columns; the one expansion that the frequency tables share."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return df.select(F.inline(cells)).where("value is not null")


def value_counts(df, columns):
    """(column, value, n): counted with map-side partial aggregation over all columns at once."""
    return long_values(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def describe(df):
    """count, unique, top, freq of non-numeric columns; count, mean, std, min, quartiles, max of numeric ones. Of ties the least value is top."""
    df = nan_to_null(df)
    num, rest = numeric_columns(df), [c for c in other_columns(df) if not dict(df.dtypes)[c].startswith("map")]
    parts = []
    if num:
        row = df.agg(*(a for k, c in enumerate(num) for a in (F.count(c).alias(f"c{k}"), F.avg(c).alias(f"a{k}"), F.stddev_samp(c).alias(f"s{k}"), F.min(F.col(c).cast("double")).alias(f"l{k}"), F.max(F.col(c).cast("double")).alias(f"h{k}"))))
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"c{k}").alias("count"), F.col(f"a{k}").alias("mean"), F.col(f"s{k}").alias("std"), F.col(f"l{k}").alias("min"), F.col(f"h{k}").alias("max")) for k, c in enumerate(num)]
        q = quantiles(df, num, [0.25, 0.5, 0.75]).groupBy("column").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
        q = q.toDF("column", "q25", "q50", "q75")
        parts.append(one_row_to_rows(row, cells).join(q, "column", "left"))
    if rest:
        v = value_counts(df, rest).groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique"), F.min_by("value", F.struct(-F.col("n"), "value")).alias("top"), F.max("n").alias("freq"))
        names = df.sparkSession.createDataFrame([(c,) for c in rest], "column string")
        parts.append(names.join(v, "column", "left").withColumn("count", F.coalesce("count", F.lit(0))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def outliers_iqr(df):
    """Numeric columns with four values or more: quartiles, bounds at 1.5 IQR and the share of values strictly outside. IQR 0 gives no bounds.

    Bounds are one row per column; they go back into the second pass as literals."""
    df = nan_to_null(df)
    num = numeric_columns(df)
    q = {}
    for r in quantiles(df, num, [0.25, 0.75]).collect():
        q.setdefault(r["column"], {})[r["prob"]] = r["value"]
    aggs = []
    for k, c in enumerate(num):
        lo, hi = q.get(c, {}).get(0.25), q.get(c, {}).get(0.75)
        bounds = None if lo is None or hi - lo == 0 else (lo - 1.5 * (hi - lo), hi + 1.5 * (hi - lo))
        q.setdefault(c, {})["bounds"] = bounds
        outside = F.lit(False) if bounds is None else (F.col(c) < bounds[0]) | (F.col(c) > bounds[1])
        aggs += [F.count(c).alias(f"n{k}"), F.count(F.when(outside, 1)).alias(f"o{k}")]
    if not num:
        return df.sparkSession.createDataFrame([], "column string, q1 double, q3 double, iqr double, lower double, upper double, outliers bigint, outlier_pct double")
    cells = []
    for k, c in enumerate(num):
        lo, hi, b = q[c].get(0.25), q[c].get(0.75), q[c]["bounds"]
        cells.append(F.struct(
            F.lit(c).alias("column"), F.lit(lo).cast("double").alias("q1"), F.lit(hi).cast("double").alias("q3"), F.lit(None if lo is None else hi - lo).cast("double").alias("iqr"), F.lit(b and b[0]).cast("double").alias("lower"),
            F.lit(b and b[1]).cast("double").alias("upper"), F.col(f"o{k}").alias("outliers"), F.bround(F.col(f"o{k}") * 100.0 / F.greatest(f"n{k}", F.lit(1)), 2).alias("outlier_pct"), F.col(f"n{k}").alias("_n")))
    return one_row_to_rows(df.agg(*aggs), cells).where("_n >= 4").drop("_n").orderBy(F.desc("outlier_pct"), "column")


def column_validity(df):
    """n_unique, pct_unique (of all rows), is_constant, is_id_like of every column. Maps have no equality and get null."""
    df = nan_to_null(df)
    kinds = dict(df.dtypes)
    cols = [c for c in df.columns if not kinds[c].startswith("map")]
    n = df.agg(F.count("*").alias("rows"))
    u = value_counts(df, cols).groupBy("column").agg(F.count("*").alias("n_unique")) if cols else None
    names = df.sparkSession.createDataFrame([(c, c in cols) for c in df.columns], "column string, known boolean")
    j = names.join(u, "column", "left").crossJoin(F.broadcast(n))  # the count is one row
    k = F.when(F.col("known"), F.coalesce("n_unique", F.lit(0)))
    return j.select(
        "column", k.alias("n_unique"), F.bround(k * 100.0 / F.greatest("rows", F.lit(1)), 2).alias("pct_unique"), (k <= 1).alias("is_constant"), ((k == F.col("rows")) & (F.col("rows") > 0)).alias("is_id_like"))


def duplicate_rows(df):
    """Rows that repeat an earlier one, nulls equal: their number. Whole rows are grouped, partial counts first."""
    df = nan_to_null(df)
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def validity_summary(df):
    """check, value, detail: duplicate rows, constant columns, columns like an id, columns with missing values."""
    v, m = column_validity(df), missing(df)

    def named(rows, check):
        return rows.agg(F.count("*").alias("value"), F.concat_ws(", ", F.array_sort(F.collect_list("column"))).alias("detail")).select(F.lit(check).alias("check"), "value", "detail")  # one name per column

    dup = duplicate_rows(df).select(F.lit("duplicate rows").alias("check"), F.col("duplicates").alias("value"), F.lit("").alias("detail"))
    return dup.unionByName(named(v.where("is_constant"), "constant columns")).unionByName(named(v.where("is_id_like"), "id-like columns")).unionByName(named(m.where("missing_count > 0"), "columns with missing values"))


def summary_line(df):
    """A sentence with rows, columns, missing cells and repeats."""
    n = df.count()
    gone = sum(r["missing_count"] for r in missing(df).collect())
    dup = duplicate_rows(df).first()["duplicates"]
    return f"{n} rows × {len(df.columns)} columns · {gone} missing values · {dup} duplicate row{'' if dup == 1 else 's'}"


def histogram(df, columns=None, bins=HISTOGRAM_BINS):
    """(column, bin, lower, upper, n): equal-width bins between minimum and maximum, the last one closed. Empty bins are left out."""
    df = nan_to_null(df)
    columns = columns or numeric_columns(df)[:PLOT_COLUMNS]
    ends = df.agg(*(a for c in columns for a in (F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))))).first()
    cells = []
    for k, c in enumerate(columns):
        lo, hi = ends[2 * k], ends[2 * k + 1]
        if lo is None:
            continue
        w = (hi - lo) / bins
        b = F.lit(0) if w == 0 else F.least(F.floor((F.col(c) - lo) / w), F.lit(bins - 1))
        cells.append(F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), b).cast("int").alias("bin"), F.lit(lo).alias("_lo"), F.lit(w).alias("_w")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, bin int, lower double, upper double, n bigint")
    g = df.select(F.inline(F.array(*cells))).where("bin is not null").groupBy("column", "bin", "_lo", "_w").agg(F.count("*").alias("n"))
    return g.select("column", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lower"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("upper"), "n")


def boxplot(df, columns=None):
    """Quartiles, whiskers at the last value within 1.5 IQR, and the number of fliers of each column."""
    df = nan_to_null(df)
    columns = columns or numeric_columns(df)[:PLOT_COLUMNS]
    q = {}
    for r in quantiles(df, columns, [0.25, 0.5, 0.75]).collect():
        q.setdefault(r["column"], {})[r["prob"]] = r["value"]
    aggs, cells = [], []
    for k, c in enumerate(columns):
        a, m, b = (q.get(c, {}).get(p) for p in (0.25, 0.5, 0.75))
        if a is None:
            continue
        lo, hi = a - 1.5 * (b - a), b + 1.5 * (b - a)
        aggs += [F.min(F.when(F.col(c) >= lo, F.col(c).cast("double"))).alias(f"l{k}"), F.max(F.when(F.col(c) <= hi, F.col(c).cast("double"))).alias(f"h{k}"), F.count(F.when((F.col(c) < lo) | (F.col(c) > hi), 1)).alias(f"f{k}")]
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(a).alias("q1"), F.lit(m).alias("median"), F.lit(b).alias("q3"), F.col(f"l{k}").alias("whisker_low"), F.col(f"h{k}").alias("whisker_high"), F.col(f"f{k}").alias("fliers")))
    return one_row_to_rows(df.agg(*aggs), cells)


def frequency(df):
    """(column, value, n, rank) of the top values of non-numeric columns with few distinct values, the first twelve such columns."""
    cols = [c for c in other_columns(df) if not dict(df.dtypes)[c].startswith(("map", "array", "struct"))]
    v = value_counts(df, cols)
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    u = v.groupBy("column").agg(F.count("*").alias("k"))
    order = df.sparkSession.createDataFrame([(c, k) for k, c in enumerate(cols)], "column string, pos int")
    few = u.where(F.col("k") <= MAX_CATEGORIES).join(order, "column").orderBy("pos").limit(PLOT_COLUMNS).select("column")
    return v.join(few, "column").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_VALUES)


def high_cardinality(df):
    """Non-numeric columns left out of the frequency plots, with their distinct values."""
    cols = [c for c in other_columns(df) if not dict(df.dtypes)[c].startswith(("map", "array", "struct"))]
    return value_counts(df, cols).groupBy("column").agg(F.count("*").alias("n_unique")).where(F.col("n_unique") > MAX_CATEGORIES)


def overview(df, order_by=None):
    """Per column: dtype, non-null values, distinct values, and an example (the value of the first row by `order_by`), in two passes."""
    df = nan_to_null(df).select(df.columns[:120])
    kinds = dict(df.dtypes)
    aggs = []
    for k, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        ex = F.min_by(x.cast("string"), F.when(x.isNotNull(), F.struct(*order_by))) if order_by else F.min(x.cast("string"))
        aggs += [F.count(x).alias(f"n{k}"), F.substring(ex, 1, 40).alias(f"e{k}")]
    row = df.agg(*aggs)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(f"n{k}").alias("non_null"), F.col(f"e{k}").alias("example")) for k, c in enumerate(df.columns)]
    u = column_validity(df).select("column", "n_unique")
    return one_row_to_rows(row, cells).join(u, "column", "left")
