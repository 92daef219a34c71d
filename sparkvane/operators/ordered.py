"""Order statistics over whole tables without a single-task sort: cumulative weights by buckets, and exact quantiles.

A window without partitions puts all rows in one task. Here keys fall into buckets between sampled split points; the weights of the
buckets before are added to a window within each bucket. The splits only steer the load: the result is exact for any of them."""
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Buckets of a column; each holds about one part in so many of the distinct keys.
BUCKETS = 64


def split_points(df, key, buckets=BUCKETS):
    """Approximate quantiles of `key` that cut it into even buckets; a list of at most buckets - 1 values."""
    probs = [k / buckets for k in range(1, buckets)]
    row = df.agg(F.percentile_approx(key, probs, 1000).alias("q")).first()
    return sorted(set(row["q"] or []))


def bucket_of(key, splits):
    """The number of splits below `key`."""
    if not splits:
        return F.lit(0)
    arr = F.array(*(F.lit(x) for x in splits))
    return F.size(F.filter(arr, lambda x: x < F.col(key)))


def cumulative(df, key, weights, ascending=True, splits=None):
    """`df`, one row per key, with `cum_<w>`: the sum of each weight over keys up to and with the row's own, in key order."""
    splits = split_points(df, key) if splits is None else splits
    b = df.withColumn("_b", bucket_of(key, splits) * (1 if ascending else -1))
    sums = b.groupBy("_b").agg(*(F.sum(w).alias(f"_s_{w}") for w in weights))
    before = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    offset = sums.select("_b", *(F.coalesce(F.sum(f"_s_{w}").over(before), F.lit(0)).alias(f"_o_{w}") for w in weights))
    order = F.asc(key) if ascending else F.desc(key)
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(F.broadcast(offset), "_b").select(*df.columns, *((F.sum(w).over(inside) + F.col(f"_o_{w}")).alias(f"cum_{w}") for w in weights))
    return out


def following(df, key, columns, ascending=False, splits=None):
    """`df`, one row per key, with `next_<c>`: each column of the row that comes next in key order; null at the end.

    The last row of a bucket takes the first row of the next bucket that has any: one row per bucket is compared."""
    splits = split_points(df, key) if splits is None else splits
    b = df.withColumn("_b", bucket_of(key, splits) * (1 if ascending else -1))
    order = F.asc(key) if ascending else F.desc(key)
    row = F.struct(*(F.col(c) for c in columns))
    pick = F.min_by if ascending else F.max_by
    heads = b.groupBy("_b").agg(pick(row, key).alias("_h"))
    after = heads.select("_b", F.lead("_h").over(Window.partitionBy(F.lit(1)).orderBy("_b")).alias("_a"))  # at most BUCKETS rows
    j = b.join(F.broadcast(after), "_b").withColumn("_n", F.coalesce(F.lead(row).over(Window.partitionBy("_b").orderBy(order)), F.col("_a")))
    return j.select(*df.columns, *(F.col(f"_n.{c}").alias(f"next_{c}") for c in columns))


#: Cuts up to which their search is compiled into the scan.
COMPILED_CUTS = 500
#: Relative error in rank of the approximate quantiles that a bracket is built around, and the cuts within a bracket.
RANK_ERROR, CUTS = 1 / 5000, 4


def _segment(x, cuts, a, b):
    """How many of the rising `cuts` (value, closed) lie before x, from a on, by binary search: x >= value where closed, else x > value."""
    if a == b:
        return F.lit(a)
    m = (a + b) // 2
    v, closed = cuts[m]
    return F.when(x >= v if closed else x > v, _segment(x, cuts, m + 1, b)).otherwise(_segment(x, cuts, a, m))


def quantiles(df, columns, probs):
    """(column, prob, value): exact quantiles with linear interpolation, nulls and NaN left out; null for a column without values.

    Two passes over `df`, whatever the number of columns. The first finds approximate quantiles of all columns; their error is bounded,
    so each wanted rank lies in a bracket between two of them. The second counts what lies in and between the brackets, and distinct
    values only within them: about one row in a thousand is shuffled as a value. Brackets are cut into segments, so no task orders a
    whole one. A rank outside of its bracket would be noticed in the counts, and is then looked for among all values of its column.
    The result has one row for a column and probability, so it is computed here."""
    spark = df.sparkSession
    schema = "column string, prob double, value double"
    if not columns:
        return spark.createDataFrame([], schema)
    probs = [float(p) for p in probs]
    near = [min(1.0, max(0.0, p + k * 2 * RANK_ERROR / CUTS)) for p in probs for k in range(-CUTS, CUTS + 1)]
    x = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    x = x.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in x.columns))
    row = x.agg(*(F.percentile_approx(c, near, int(1 / RANK_ERROR)).alias(c) for c in x.columns)).first()
    width, got, open_ = 2 * CUTS + 1, {}, {}
    for k in range(len(columns)):
        if row[k] is not None:
            open_[k] = [[(v, i == 0) for i, v in enumerate(row[k][j * width : (j + 1) * width])] for j in range(len(probs))]
    while open_:
        found = _within(x, open_, probs)
        open_ = {k: [[] for _ in probs] for k in open_ if any(found.get((k, j)) is None for j in range(len(probs)))}  # one segment: all values
        got |= {kj: v for kj, v in found.items() if kj[0] not in open_}
    return spark.createDataFrame([(c, p, got.get((k, j))) for k, c in enumerate(columns) for j, p in enumerate(probs)], schema)


def _within(x, brackets, probs):
    """{(column number, prob number): value} of the quantiles whose ranks lie in their brackets, lists of (value, closed) cuts by column."""
    cells, wanted, every = [], [], {}
    for k, by_prob in brackets.items():
        cuts = sorted({c for b in by_prob for c in b}, key=lambda c: (c[0], not c[1]))
        at = {c: i for i, c in enumerate(cuts)}
        inside = set()
        for j, b in enumerate(by_prob):
            lo, hi = (at[b[0]] + 1, at[b[-1]]) if b else (0, 0)
            inside |= set(range(lo, hi + 1))
            wanted.append((k, j, probs[j], lo, hi))
        every[k] = (cuts, sorted(inside))
    if sum(len(c) for c, _ in every.values()) <= COMPILED_CUTS:
        for k, (cuts, runs) in every.items():
            v = F.col(f"c{k}")
            s = _segment(v, cuts, 0, len(cuts))
            keep = F.lit(True) if len(runs) == len(cuts) + 1 else s.isin(runs)
            cells.append(F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), s.alias("s"), F.when(keep, v).alias("v"))))
        long = x.select(F.explode(F.array(*cells)).alias("x")).where("x is not null").select("x.*")
    else:  # the cuts of a wide table come as a small table, as code for all of them would be too long to compile
        table = x.sparkSession.createDataFrame([(k, c, r) for k, (c, r) in every.items()], "k int, cuts array<struct<at:double,closed:boolean>>, runs array<int>")
        long = x.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("v")) for k in every))).alias("x")).select("x.*").where("v is not null")
        long = long.join(F.broadcast(table), "k")  # one row for a column
        s = F.size(F.filter("cuts", lambda c: (F.col("v") > c["at"]) | (c["closed"] & (F.col("v") == c["at"]))))
        long = long.select("k", s.alias("s"), "v", "runs").select("k", "s", F.when(F.array_contains("runs", F.col("s")), F.col("v")).alias("v"))
    g = long.groupBy("k", "s", "v").agg(F.count("*").alias("n"))
    sums = g.groupBy("k", "s").agg(F.sum("n").alias("m"))  # a few rows for a column and probability
    w = Window.partitionBy("k")
    sums = sums.select("k", "s", (F.sum("m").over(w.orderBy("s")) - F.col("m")).alias("before"), F.sum("m").over(w).alias("t"))
    c = g.where("v is not null").join(sums, ["k", "s"])
    c = c.withColumn("cum", F.col("before") + F.sum("n").over(Window.partitionBy("k", "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    aims = x.sparkSession.createDataFrame(wanted, "k int, j int, p double, lo int, hi int")
    c = c.join(F.broadcast(aims), "k").where("s between lo and hi")  # one row for a column and probability
    h = (F.col("t") - 1) * F.col("p")
    first, last = (F.when((F.col("cum") > r) & (F.col("cum") - F.col("n") <= r), F.col("v")) for r in (F.floor(h), F.ceil(h)))
    r = c.groupBy("k", "j", "p", "t").agg(F.max(first).alias("a"), F.max(last).alias("b"))
    value = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a") + F.when(F.col("a") == F.col("b"), 0.0).otherwise((F.col("b") - F.col("a")) * (h - F.floor(h))))
    return {(r["k"], r["j"]): r["value"] for r in r.select("k", "j", value.alias("value")).collect()}


def grouped_quantiles(df, group, value, probs):
    """(group, prob, value): exact quantiles of a value within each group, nulls and NaN left out.

    Values are counted by group first. Buckets between split points of the whole column cut every group, so a large group is ordered by
    many tasks; what the earlier buckets of a group hold is added by a join on (group, bucket)."""
    x = df.select(F.col(group).alias("group"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    splits = split_points(x, "x")
    g = x.groupBy("group", "x").agg(F.count("*").alias("n")).withColumn("_b", bucket_of("x", splits))
    sums = g.groupBy("group", "_b").agg(F.sum("n").alias("m"))
    w = Window.partitionBy("group")  # at most BUCKETS rows
    sums = sums.select(F.col("group").alias("_g"), F.col("_b").alias("_c"), (F.sum("m").over(w.orderBy("_b")) - F.col("m")).alias("before"), F.sum("m").over(w).alias("t"))
    c = g.join(sums, F.col("group").eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
    c = c.withColumn("cum", F.col("before") + F.sum("n").over(Window.partitionBy("group", "_b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("prob", F.explode(F.array(*(F.lit(float(p)) for p in probs))))
    h = (F.col("t") - 1) * F.col("prob")
    first, last = (F.when((F.col("cum") > r) & (F.col("cum") - F.col("n") <= r), F.col("x")) for r in (F.floor(h), F.ceil(h)))
    r = c.where((F.col("cum") > F.floor(h)) & (F.col("cum") - F.col("n") <= F.ceil(h))).groupBy("group", "prob", "t").agg(F.max(first).alias("a"), F.max(last).alias("b"))
    return r.select("group", "prob", (F.col("a") + F.when(F.col("a") == F.col("b"), 0.0).otherwise((F.col("b") - F.col("a")) * (h - F.floor(h)))).alias("value"))


def next_key(df, group, key):
    """(group, key, next): each distinct key with the one that follows it in its group; the last key of a group has none.

    Keys are cut into ranges, so that a large group is ordered by many tasks; the first key of a group's next range is added to the last of each."""
    from ..session import checkpoint

    x = df.select(group, key).distinct().repartitionByRange(group, key).withColumn("_p", F.spark_partition_id())
    x = checkpoint(x)  # the ranges are sampled, so they are fixed before they are read twice
    heads = x.groupBy(group, "_p").agg(F.min(key).alias("_h"))
    heads = heads.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), F.lead("_h").over(Window.partitionBy(group).orderBy("_p")).alias("_h"))  # one row for a range
    j = x.join(heads, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return j.select(group, key, F.coalesce(F.lead(key).over(Window.partitionBy(group, "_p").orderBy(key)), F.col("_h")).alias("next")).where("next is not null")


def places(df, order_by, name):
    """`df` with the place from 0 of each row in the order of columns; ties are broken by range, so the order should be unique."""
    from ..session import checkpoint

    x = checkpoint(df.repartitionByRange(*order_by).withColumn("_p", F.spark_partition_id()))  # the ranges are sampled, so they are fixed before they are read twice
    sizes = x.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for a range
    start = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    k = F.row_number().over(Window.partitionBy("_p").orderBy(*order_by))
    return x.join(F.broadcast(start), "_p").select(*df.columns, (F.col("_s") + k - 1).cast("bigint").alias(name))


def ranks(df, column, name):
    """(column, name): the distinct non-null values with their place from 0 in ascending order."""
    return places(df.where(F.col(column).isNotNull()).select(column).distinct(), [column], name)
