"""Data behind charts: each kind is a small query plus a spec; no figure is drawn here."""
import json
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions.types import nan_to_null, numeric_columns, resolve_column
from . import quality
from .metrics import correlation_matrix
from .ordered import grouped_quantiles

# Caps that are part of the charts, and other names for kinds.
MAX_PANELS, SCATTER_POINTS, MAX_BARS, MAX_COUNTS, MAX_SLICES = 24, 20_000, 50, 30, 12
ALIASES = {"hist": "histogram", "corr": "heatmap", "correlation": "heatmap", "donut": "pie", "boxplot": "box", "countplot": "count", "barplot": "bar", "lineplot": "line"}
KINDS = ("histogram", "box", "violin", "count", "bar", "line", "area", "scatter", "pie", "heatmap")
AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count, "median": F.median, "min": F.min, "max": F.max}


class ChartError(ValueError):
    """A chart cannot be made from what was asked."""


@dataclass
class ChartSpec:
    kind: str
    title: str
    x: str | None = None
    y: str | None = None
    notes: list = field(default_factory=list)
    data: object = None  # a DataFrame

    def to_json(self):
        return json.dumps({k: getattr(self, k) for k in ("kind", "title", "x", "y", "notes")})


def kind_of(name):
    """The kind meant by a name: itself, another name for it, or its plural."""
    k = str(name).strip().lower().replace(" ", "")
    for c in (k, k.removesuffix("s"), ALIASES.get(k), ALIASES.get(k.removesuffix("s"))):
        if c in KINDS:
            return c
    raise ChartError(f"unknown chart kind {name!r}; one of {', '.join(KINDS)}")


def label(column):
    """A category as text, missing ones as '(missing)'."""
    return F.coalesce(F.col(column).cast("string"), F.lit("(missing)"))


def counts(df, x, limit=MAX_COUNTS):
    """(x, n) of the most frequent categories; ties by name."""
    return df.groupBy(label(x).alias("x")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x").limit(limit)


def aggregate(df, x, y, agg="sum", limit=None, by_x=False):
    """(x, y): one aggregate per x with missing x kept; bars are the largest by y, lines are in order of x. An all-missing sum is 0."""
    if agg not in AGGREGATES:
        raise ChartError(f"unknown aggregate {agg!r}; one of {', '.join(AGGREGATES)}")
    v = AGGREGATES[agg](F.col(y))
    g = nan_to_null(df).groupBy(F.col(x).alias("x")).agg((F.coalesce(v, F.lit(0)) if agg == "sum" else v).alias("y"))
    g = g.orderBy(F.asc_nulls_last("x")) if by_x else g.orderBy(F.desc_nulls_last("y"), F.asc_nulls_last("x"))
    return g.limit(limit) if limit else g


def scatter(df, x, y, key, limit=SCATTER_POINTS):
    """(x, y) of rows that have both; beyond the limit the rows with the smallest MD5 digest of `key`, so the sample is repeatable."""
    pts = nan_to_null(df).where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"), F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key))).alias("_h"), *key)
    return pts.orderBy("_h", *key, "x", "y").limit(limit).drop("_h")


def trend(df, x, y):
    """slope and intercept of the least-squares line; null where x is constant."""
    return df.agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"), F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"))


def pie(df, x, y=None, limit=MAX_SLICES):
    """(x, value): sums of y, or counts, of the largest categories."""
    v = F.coalesce(F.sum(y), F.lit(0)) if y else F.count("*")
    return df.groupBy(label(x).alias("x")).agg(v.alias("value")).orderBy(F.desc("value"), "x").limit(limit)


def crosstab(df, x, y):
    """(x, y, n) of all pairs that occur."""
    return df.groupBy(label(x).alias("x"), label(y).alias("y")).agg(F.count("*").alias("n"))


def box(df, value, group=None):
    """Quartiles and whiskers of a value, per group if one is given."""
    if group is None:
        return quality.boxplot(df, [value])
    v = F.col("v")
    x = nan_to_null(df).select(label(group).alias("group"), F.col(value).cast("double").alias("v")).where("v is not null")
    q = grouped_quantiles(x, "group", "v", [0.25, 0.5, 0.75]).groupBy("group").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value")).toDF("group", "q1", "median", "q3")
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    j = x.join(q, "group")
    return j.groupBy("group", "q1", "median", "q3").agg(F.min(F.when(v >= lo, v)).alias("whisker_low"), F.max(F.when(v <= hi, v)).alias("whisker_high"), F.count(F.when((v < lo) | (v > hi), 1)).alias("fliers"))


def violin(df, value, group=None, points=64):
    """(group, at, density): a Gaussian kernel estimate on an even grid from 512 equal-width bins, so that only binned counts leave the scan."""
    v = F.col(value).cast("double")
    x = nan_to_null(df).where(v.isNotNull()).select((label(group) if group else F.lit("all")).alias("group"), v.alias("v"))
    st = x.groupBy("group").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
    h = F.greatest(F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)), F.lit(1e-9))
    b = x.join(st, "group").withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / F.greatest((F.col("hi") - F.col("lo")) / 512, F.lit(1e-300))), F.lit(511)))
    b = b.groupBy("group", "bin", "lo", "hi", "sd", "n").agg(F.count("*").alias("k"))
    g = b.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("at", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("j") / (points - 1))
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / 512
    dens = F.sum(F.col("k") * F.exp(-F.pow((F.col("at") - mid) / h, F.lit(2)) / 2)) / F.first(F.col("n") * h * 2.5066282746310002)
    return g.groupBy("group", "at").agg(dens.alias("density"))


def build(df, kind, x=None, y=None, agg=None, group=None, key=None, title=None):
    """A ChartSpec with its data. Column names are forgiving; an empty table is an error."""
    kind = kind_of(kind)
    if df.isEmpty():
        raise ChartError("the table has no rows")
    x, y, group = (resolve_column(c, df.columns) if c else None for c in (x, y, group))
    notes, num = [], numeric_columns(df)
    if kind == "histogram":
        cols = [x] if x else num[:MAX_PANELS]
        if x and x not in num:
            raise ChartError(f"{x} is not numeric")
        if not x and len(num) > MAX_PANELS:
            notes.append(f"first {MAX_PANELS} of {len(num)} numeric columns")
        data = quality.histogram(df, cols)
    elif kind in ("box", "violin"):
        if not (y or x):
            data = quality.boxplot(df, num[:MAX_PANELS])
        else:
            v, g = (y, group or x) if y else (x, group)
            data = box(df, v, g) if kind == "box" else violin(df, v, g)
    elif kind == "count" or kind == "bar" and not y:
        if not x:
            raise ChartError("x is needed")
        data = counts(df, x)
        notes.append(f"at most {MAX_COUNTS} categories")
    elif kind in ("bar", "line", "area"):
        if not (x and y):
            raise ChartError("x and y are needed")
        data = aggregate(df, x, y, agg or ("sum" if kind == "bar" else "mean"), MAX_BARS if kind == "bar" else None, kind != "bar")
    elif kind == "scatter":
        if not (x and y):
            raise ChartError("x and y are needed")
        data = scatter(df, x, y, key or [x, y])
    elif kind == "pie":
        data = pie(df, x, y)
    elif x and y:
        data = crosstab(df, x, y)
    else:
        if len(num) < 2:
            raise ChartError("a correlation heatmap needs two numeric columns")
        data = correlation_matrix(df, num, fill=None)
    return ChartSpec(kind, title or f"{kind} of {y or x or 'all columns'}", x, y, notes, data)


def frame_from_result(result):
    """A query result as a frame to chart: a DataFrame with one or two columns gets the names x and y; other results are refused."""
    if not hasattr(result, "columns") or not hasattr(result, "schema"):
        raise ChartError("the expression did not give a table")
    if len(result.columns) == 2:
        return result.toDF("x", "y")
    return result


