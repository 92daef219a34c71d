"""Ordered joins and time operators: as-of and range joins, fills, resampling, exponential windows."""
from pyspark.sql import Window
from pyspark.sql import functions as F


def asof_join(left, right, on, by=(), direction="backward", tolerance=None):
    """Each left row with the last right row at or before it (`backward`), or the first at or after it (`forward`), per group `by`.

    Both sides are put in one ordered stream per group, so there is no pairwise join; of equal times the right row comes first. Right
    columns are null where nothing matches or the distance in seconds exceeds `tolerance`."""
    by = list(by)
    extra = [c for c in right.columns if c not in [*by, on]]
    stamp = F.struct(F.col(on).alias("_at"), *(F.col(c) for c in extra))
    a = left.select(*left.columns, F.lit(None).cast(right.select(stamp.alias("x")).schema["x"].dataType).alias("_r"), F.lit(1).alias("_side"))
    b = right.select(*by, on, stamp.alias("_r"), F.lit(0 if direction == "backward" else 2).alias("_side"))
    u = a.unionByName(b, allowMissingColumns=True)
    back = direction == "backward"
    if not by:  # buckets of time stand in for groups; what a bucket lacks comes from the nearest one that has a right row
        from .ordered import bucket_of, split_points

        u = u.withColumn("_b", bucket_of(on, split_points(u, on)))
        ends = u.groupBy("_b").agg((F.max_by if back else F.min_by)("_r", F.when(F.col("_r").isNotNull(), F.struct(on, "_side"))).alias("_e"))
        w = Window.partitionBy(F.lit(1)).orderBy("_b")  # one row for a bucket
        near = F.last("_e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if back else F.first("_e", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        u = u.join(F.broadcast(ends.select("_b", near.alias("_e"))), "_b")
    w = Window.partitionBy(*(by or ["_b"])).orderBy(on, "_side")
    if back:
        m = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        m = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = u.withColumn("_m", m if by else F.coalesce(m, F.col("_e"))).where("_side = 1")
    if tolerance is not None:
        far = F.abs(F.col(on).cast("timestamp").cast("double") - F.col("_m._at").cast("timestamp").cast("double")) > tolerance
        out = out.withColumn("_m", F.when(~far, F.col("_m")))
    return out.select(*left.columns, *(F.col(f"_m.{c}").alias(c) for c in extra))


#: A table of ranges is broadcast up to this many rows; beyond it the join goes by buckets of the value.
RANGES_BROADCAST = 10_000


def range_join(df, ranges, value, lo, hi, width=None):
    """Rows of `df` with each range that holds `value` (lo <= value < hi).

    Few ranges are broadcast after they are counted. Otherwise both sides meet on buckets of `width`: a range is listed under every
    bucket it touches, a value under its own, so the join is an equality join whatever the number of ranges."""
    n = ranges.limit(RANGES_BROADCAST + 1).count()
    inside = (F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))
    if n <= RANGES_BROADCAST:
        return df.join(F.broadcast(ranges), inside)
    if width is None:
        width = ranges.agg(F.avg(F.col(hi) - F.col(lo))).first()[0] or 1.0
    r = ranges.withColumn("_k", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return df.withColumn("_k", F.floor(F.col(value) / width)).join(r, "_k").where(inside).drop("_k")


def forward_fill(df, key, columns):
    """Each column with its last non-null value in order of `key`, over the whole table.

    Done in key buckets: the last value of each bucket is carried to the next ones, so that no task holds all rows."""
    from .ordered import bucket_of, split_points

    b = df.withColumn("_b", bucket_of(key, split_points(df, key)))
    inside = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    ends = b.groupBy("_b").agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(key))).alias(f"_e_{c}") for c in columns))
    before = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    carried = ends.select("_b", *(F.last(f"_e_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in columns))
    j = b.join(F.broadcast(carried), "_b")
    rest = [c for c in df.columns if c not in columns]
    return j.select(*rest, *(F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c_{c}")).alias(c) for c in columns))


def interpolate(df, group, key, column):
    """Linear interpolation of `column` by row position within `group`; after the last value it is carried on, before the first it stays null."""
    w = Window.partitionBy(group).orderBy(key)
    a, b = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    x = df.withColumn("_k", F.row_number().over(w))
    has = F.when(F.col(column).isNotNull(), F.col("_k"))
    x = x.withColumns({"_k0": F.max(has).over(a), "_k1": F.min(has).over(b), "_v0": F.last(column, ignorenulls=True).over(a), "_v1": F.first(column, ignorenulls=True).over(b)})
    v = F.when(F.col(column).isNotNull(), F.col(column)).when(F.col("_k0").isNull(), None).when(F.col("_k1").isNull(), F.col("_v0")).otherwise(
        F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_k") - F.col("_k0")) / (F.col("_k1") - F.col("_k0")))
    return x.withColumn(column, v).drop("_k", "_k0", "_k1", "_v0", "_v1")


def resample(df, ts, unit, aggs):
    """Tumbling buckets of a time column with all empty buckets between the first and the last: bucket and the named aggregates."""
    g = df.groupBy(F.date_trunc(unit, F.col(ts)).alias("bucket")).agg(*(e.alias(n) for n, e in aggs.items()))
    step = F.expr({"hour": "interval 1 hour", "day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[unit])
    every = g.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", step)).alias("bucket"))
    return every.join(g, "bucket", "left")


def ewm(df, group, order, column, alpha):
    """Exponentially weighted mean with adjusted weights per group in the given order; nulls are passed over but still age the weights.

    Rows are cut into ranges of (group, order), so that a large group is worked on by many tasks. Two running sums are carried from row to row
    within a range; what earlier ranges of a group leave, aged by the rows since, is added afterwards, from one row for a range."""
    from ..session import checkpoint

    cols = list(dict.fromkeys([group, *order, column]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cols).schema) + ", _p int, _k bigint, _num double, _den double"

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        now, k, num, den = object(), 0, 0.0, 0.0
        for b in batches:
            out = []
            for g, x in zip(b[group].tolist(), b[column].tolist(), strict=True):
                if g != now:
                    now, k, num, den = g, 0, 0.0, 0.0
                k, num, den = k + 1, num * (1 - alpha), den * (1 - alpha)
                if x is not None and x == x:
                    num, den = num + x, den + 1.0
                out.append((part, k, num, den))
            yield b.assign(**{n: [r[i] for r in out] for i, n in enumerate(("_p", "_k", "_num", "_den"))})

    t = df.select(*cols).repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInPandas(run, schema)
    t = checkpoint(t)  # the ranges are sampled, so they are fixed before they are read twice
    ends = t.groupBy(group, "_p").agg(F.max_by(F.struct("_k", "_num", "_den"), "_k").alias("_e"))
    before = F.collect_list("_e").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row for a range
    fade = lambda k: F.pow(F.lit(1.0 - alpha), k.cast("double"))
    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    left = F.aggregate("_b", zero, lambda s, e: F.struct((s["num"] * fade(e["_k"]) + e["_num"]).alias("num"), (s["den"] * fade(e["_k"]) + e["_den"]).alias("den")))
    carried = ends.withColumn("_b", before).where(F.size("_b") > 0).select(F.col(group).alias("_g"), F.col("_p").alias("_q"), left.alias("_c"))
    j = t.join(F.broadcast(carried), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")), "left")  # fewer rows than ranges
    num, den = (F.col(f"_{n}") + F.coalesce(F.col(f"_c.{n}"), F.lit(0.0)) * fade(F.col("_k")) for n in ("num", "den"))
    return j.select(*cols, F.when(den > 0, num / den).alias("ewm"))
