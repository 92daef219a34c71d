"""Mixing of sources to target weights (problem 8): raking of cell weights, then systematic sampling of whole documents."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .tokens import VOCABULARY, with_counts


def rake(cells, margins, rounds=200, eps=1e-10):
    """Iterative proportional fitting on a list of cells.

    `cells` are dicts with the margin columns and a positive 'size'; `margins` map a column to {value: share}. Each round
    scales the cells of every value to its share; values without a cell are left out and the rest is renormalised. Returns
    the share of each cell. Margins that contradict each other end after `rounds` with the last one met."""
    w = [float(c["size"]) for c in cells]
    for _ in range(rounds):
        worst = 0.0
        for col, shares in margins.items():
            have = {}
            for c, x in zip(cells, w, strict=True):
                have[c[col]] = have.get(c[col], 0.0) + x
            reach = sum(s for v, s in shares.items() if have.get(v, 0) > 0)
            if reach <= 0:
                return [0.0] * len(cells)
            for i, c in enumerate(cells):
                want = shares.get(c[col], 0.0) / reach
                got = have[c[col]]
                f = want / got if got > 0 else 0.0
                worst = max(worst, abs(want - got))
                w[i] *= f
        if worst < eps:
            break
    total = sum(w)
    return [x / total if total > 0 else 0.0 for x in w]


#: Target rows, and values of a margin, that a plan takes at most. They are arguments of it, not data that grows with the documents.
MAX_TARGETS = 100_000


def sized(documents, *margins, path=VOCABULARY):
    """(doc_id, source, margins, n_tokens), written once, so that the tokenizer runs once; what follows reads ids, sizes and cell columns."""
    return checkpoint(with_counts(documents.select("doc_id", "source", "text", *margins), path=path).drop("text"))


def tempered_shares(docs, column, power=0.5):
    """{value: share} of the tokens of each value raised to a power: 1 keeps the shares of the documents, 0 makes them even. Null is no value."""
    rows = docs.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum("n_tokens").alias("k")).where("k > 0").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"{column} has more than {MAX_TARGETS} values")
    w = {r[column]: float(r["k"]) ** power for r in rows}
    total = sum(w.values())
    return {v: x / total for v, x in sorted(w.items(), key=lambda kv: str(kv[0]))}


def plan(documents, targets, *, margins=(), margin_shares=None, total=None, path=VOCABULARY, per_bucket=50_000, docs=None):
    """(uses, shares): how often each document is used, and the target and actual share of every collection.

    Cells are listed collections with a weight, crossed with the columns in `margins`, whose target shares are given in `margin_shares`
    ({column: {value: share}}). So there are at most as many as the product of the lists given, whatever the documents, and raking runs
    on the driver. The total is the largest that no cell's cap of repeats forbids, or `total` if smaller. Null, empty and unlisted
    documents, and those of values without a share, get 0 uses. Repeated target rows count once; weights that are null, negative or NaN
    count as 0, a null cap as 1. `docs` may give the result of `sized`."""
    docs = sized(documents, *margins, path=path) if docs is None else docs
    spark = docs.sparkSession
    keys = ["source", *margins]
    aims = {}
    rows = targets.select("source", "weight", "max_repeats").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    for r in rows:
        x = r["weight"] if r["weight"] is not None and r["weight"] == r["weight"] and r["weight"] > 0 else 0.0
        aims[r["source"]] = (x, max(0, 1 if r["max_repeats"] is None else r["max_repeats"]))
    sum_w = sum(x for x, _ in aims.values())
    live = spark.createDataFrame([(s,) for s, (x, cap) in aims.items() if x > 0 and cap > 0], "source string")
    inside = docs.where("n_tokens > 0").join(F.broadcast(live.withColumnRenamed("source", "_s")), docs["source"].eqNullSafe(F.col("_s")), "left_semi")  # at most MAX_TARGETS rows
    goal = {m: (margin_shares or {})[m] for m in margins}
    for m in margins:
        inside = inside.join(F.broadcast(spark.createDataFrame([(v,) for v, x in goal[m].items() if x > 0], f"`{m}` {dict(docs.dtypes)[m]}")), m, "left_semi")
    cells = [r.asDict() for r in inside.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("size")).collect()]
    shares = {s: x / sum_w for s, (x, _) in aims.items() if sum_w > 0}
    goal = goal | {"source": shares}  # the collections are met last, so exactly
    for c, share in zip(cells, rake(cells, goal), strict=True):
        c["share"] = share
    limit = min((c["size"] * aims[c["source"]][1] / c["share"] for c in cells if c["share"] > 0), default=0.0)
    want = min(limit, total) if total is not None else limit
    rate = [(*(c[k] for k in keys), want * c["share"] / c["size"], int(aims[c["source"]][1]), 1 + c["n"] // per_bucket) for c in cells if c["share"] > 0]
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "rate double", "cap int", "buckets bigint"])
    rates = spark.createDataFrame(rate, schema)
    on = None
    for k in keys:
        one = docs[k].eqNullSafe(rates[k])
        on = one if on is None else on & one
    d = docs.join(F.broadcast(rates), on, "left").select(docs["doc_id"], *(docs[k] for k in keys), "n_tokens", "rate", "cap", "buckets")
    rest = d.where(F.col("rate").isNull() | (F.col("n_tokens") == 0)).withColumn("uses", F.lit(0))  # never sampled, so never sorted
    h = F.xxhash64("doc_id")
    d = d.where(F.col("rate").isNotNull() & (F.col("n_tokens") > 0)).withColumn("_b", F.pmod(h, "buckets")).withColumn("_h", h)
    # whole uses for all, one more for a systematic sample over the sizes: the share of tokens is met to about one document a bucket
    w = Window.partitionBy(*keys, "_b").orderBy("n_tokens", "_h", "doc_id")
    base = F.floor("rate")
    frac = F.col("rate") - base
    start = F.pmod(F.xxhash64(*keys, "_b"), F.lit(1_000_003)) / 1_000_003
    k = F.row_number().over(w)
    extra = F.floor(k * frac + start) - F.floor((k - 1) * frac + start)
    d = d.withColumn("uses", F.least(base + extra, F.col("cap")).cast("int"))
    out = d.select("doc_id", *keys, "n_tokens", "uses").unionByName(rest.select("doc_id", *keys, "n_tokens", "uses"))
    sums = out.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    listed = spark.createDataFrame([(s, shares.get(s, 0.0), cap) for s, (_, cap) in aims.items()], "source string, target_share double, max_repeats int")
    both = sums.join(listed, sums["source"].eqNullSafe(listed["source"]), "full").select(
        F.coalesce(sums["source"], listed["source"]).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    return out, both.crossJoin(F.broadcast(_all_used(sums))).withColumn("actual_share", F.when(F.col("_all") > 0, F.col("used_tokens") / F.col("_all")).otherwise(F.lit(0.0))).drop("_all")


def _all_used(sums):
    """One row: the tokens used in all."""
    return sums.agg(F.coalesce(F.sum("used_tokens"), F.lit(0)).alias("_all"))


def margin_report(uses, goals):
    """(margin, value, target_share, actual_share) of the values of every margin, by the uses of a plan."""
    spark = uses.sparkSession
    out = None
    for m, shares in goals.items():
        kind = dict(uses.dtypes)[m]
        sums = uses.groupBy(m).agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"))
        aims = spark.createDataFrame(list(shares.items()), f"`{m}` {kind}, target_share double")
        one = aims.join(sums, m, "left").crossJoin(F.broadcast(_all_used(sums)))
        one = one.select(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value"), "target_share", F.when(F.col("_all") > 0, F.coalesce("used_tokens", F.lit(0)) / F.col("_all")).otherwise(F.lit(0.0)).alias("actual_share"))
        out = one if out is None else out.unionByName(one)
    return out
