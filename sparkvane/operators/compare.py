"""Comparison of tables, texts and folders of files."""
import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import one_row_to_rows
from .ordered import places
from .retrieval import split_lines, tokens

# Lines shown of a block and of a diff, lines up to which the ratio is exact, files reported.
BLOCK_LINES, DIFF_LINES, EXACT_LINES, TOP_FILES, NEAR_COPY = 40, 400, 40_000, 8, 0.3


def schema_diff(a, b):
    """(column, in_a, in_b, status): only in a, only in b, type changed, same."""
    ta, tb = dict(a.dtypes), dict(b.dtypes)
    rows = []
    for c in list(dict.fromkeys([*a.columns, *b.columns])):
        x, y = ta.get(c), tb.get(c)
        rows.append((c, x, y, "only in A" if y is None else "only in B" if x is None else "same" if x == y else "type changed"))
    return a.sparkSession.createDataFrame(rows, "column string, in_a string, in_b string, status string")


def _number(df, c):
    t = df.schema[c].dataType
    if isinstance(t, T.BooleanType):
        return F.col(c).cast("int").cast("double")
    return F.col(c).cast("double") if isinstance(t, T.NumericType) else None


def _stats(df, cols):
    aggs = [F.count("*").alias("_n")]
    for k, c in enumerate(cols):
        x = _number(df, c)
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"z{k}"), *((f(x) if x is not None else F.lit(None).cast("double")).alias(f"{n}{k}") for n, f in (("m", F.avg), ("s", F.stddev_samp), ("l", F.min), ("h", F.max)))]
    cells = [
        F.struct(F.lit(c).alias("column"), F.bround(F.col(f"z{k}") * 100.0 / F.greatest("_n", F.lit(1)), 2).alias("null_pct"), *(F.col(f"{n}{k}").cast("double").alias(v) for n, v in (("m", "mean"), ("s", "std"), ("l", "min"), ("h", "max"))))
        for k, c in enumerate(cols)]
    return one_row_to_rows(df.agg(*aggs), cells)


def column_stats(a, b):
    """Null share, mean, deviation, least and largest value of each common column on both sides, and the change of the mean in per cent
    (null for a mean of 0). Booleans count as numbers; other columns have null shares only."""
    cols = [c for c in a.columns if c in b.columns]
    x, y = _stats(a, cols), _stats(b, cols)
    j = x.toDF("column", *(f"{c}_a" for c in x.columns[1:])).join(y.toDF("column", *(f"{c}_b" for c in y.columns[1:])), "column")
    return j.withColumn("mean_delta_pct", F.try_divide(F.col("mean_b") - F.col("mean_a"), F.abs("mean_a")) * 100)


def category_diff(a, b, column, examples=5):
    """Distinct values on each side, those on one side only, and the first values that only B has."""
    x = a.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct().withColumn("a", F.lit(1))
    y = b.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct().withColumn("b", F.lit(1))
    j = x.join(y, "v", "full")
    only = F.col("a").isNull()
    k = j.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(only, 1)).alias("only_b"))
    ex = j.where(only).orderBy("v").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("new_values"))  # five at most
    return k.crossJoin(ex).select(F.lit(column).alias("column"), "*")


def cell_diff(a, b, key):
    """(column, changed): null-safe differences of cells of rows with the same key; empty unless both have the same columns in order."""
    if a.columns != b.columns:
        return a.sparkSession.createDataFrame([], "column string, changed bigint")
    rest = [c for c in a.columns if c not in key]
    j = a.alias("a").join(b.alias("b"), key)
    row = j.agg(*(F.count(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), 1)).alias(f"d{k}") for k, c in enumerate(rest)))
    return one_row_to_rows(row, [F.struct(F.lit(c).alias("column"), F.col(f"d{k}").alias("changed")) for k, c in enumerate(rest)])


def aligned_cell_diff(a, b, order_by):
    """(column, changed): null-safe differences of cells of rows at the same place in the order of `order_by`, which must be unique on
    each side; empty unless both sides have the same columns in order and the same number of rows.

    Rows are numbered by ranges (ordered.places), so that no task holds a whole table."""
    if a.columns != b.columns or a.count() != b.count():
        return a.sparkSession.createDataFrame([], "column string, changed bigint")
    x, y = places(a, order_by, "_at"), places(b, order_by, "_at")
    j = x.alias("a").join(y.alias("b"), "_at")
    row = j.agg(*(F.count(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), 1)).alias(f"d{k}") for k, c in enumerate(a.columns)))
    return one_row_to_rows(row, [F.struct(F.lit(c).alias("column"), F.col(f"d{k}").alias("changed")) for k, c in enumerate(a.columns)])


def line_counts(corpus, keys):
    """(keys, line digest, n): the multiset of lines of each text."""
    return corpus.where("text is not null").select(*keys, F.explode(split_lines(F.col("text"))).alias("line")).groupBy(*keys, F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), "line").agg(F.count("*").alias("n")).drop("h1", "h2")


def tree_diff(a, b):
    """(rel, status, similarity): identical, changed with the line similarity, only in A, only in B. Texts are compared before lines are counted."""
    x, y = a.select("rel", F.col("text").alias("ta"), F.lit(True).alias("ia")), b.select("rel", F.col("text").alias("tb"), F.lit(True).alias("ib"))
    j = x.join(y, "rel", "full").select(
        "rel", "ta", "tb", F.when(F.col("ib").isNull(), "only in A").when(F.col("ia").isNull(), "only in B").when(F.col("ta").eqNullSafe(F.col("tb")), "identical").otherwise("changed").alias("status"))
    c = j.where("status = 'changed'")
    sim = quick_ratio(c.select("rel", F.coalesce("ta", F.lit("")).alias("text_a"), F.coalesce("tb", F.lit("")).alias("text_b")), ["rel"])
    return j.select("rel", "status").join(sim, "rel", "left").withColumnRenamed("ratio", "similarity")


def quick_ratio(pairs, keys):
    """(keys, ratio) of pairs (keys, text_a, text_b): twice the common lines, as multisets, over all lines; 1 for two empty texts.

    Lines of both sides are counted together with a sign, so there is one shuffle and no pairwise step."""
    u = pairs.select(*keys, F.explode(split_lines(F.col("text_a"))).alias("line"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    u = u.unionByName(pairs.select(*keys, F.explode(split_lines(F.col("text_b"))).alias("line"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    g = u.groupBy(*keys, "line").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).groupBy(*keys).agg(F.sum(F.least("a", "b")).alias("m"), F.sum(F.col("a") + F.col("b")).alias("t"))
    return pairs.select(*keys).join(g, keys, "left").select(*keys, F.coalesce(2.0 * F.col("m") / F.col("t"), F.lit(1.0)).alias("ratio"))


def file_to_corpus(text, corpus, top=TOP_FILES, own=None):
    """The files most like a text: 0.4 · shared vocabulary + 0.3 · share of the text's terms + 0.3 · line similarity.

    `own`, the (source, rel) of the text itself, is left out, and so are files without terms; a text without terms is like none.

    The text's terms and lines are joined as tables, so the corpus is scanned once and only counts are shuffled."""
    spark = corpus.sparkSession
    one = spark.createDataFrame([(text,)], "text string")
    terms = one.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    n_terms = terms.count()
    lns = one.select(F.explode(split_lines(F.col("text"))).alias("line")).groupBy("line").agg(F.count("*").alias("k"))
    n_lines = one.select(F.size(split_lines(F.col("text")))).first()[0]
    c = corpus.where("text is not null")
    if own:
        c = c.where(~((F.col("source") == own[0]) & (F.col("rel") == own[1])))
    if not n_terms:
        c = c.limit(0)
    tok = c.select("source", "rel", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    v = tok.join(terms.withColumn("hit", F.lit(1)), "token", "left").groupBy("source", "rel").agg(F.count("*").alias("n"), F.count("hit").alias("common"))
    ln = line_counts(c, ["source", "rel"]).join(lns, "line", "left").groupBy("source", "rel").agg(F.sum("n").alias("ln"), F.sum(F.least("n", F.coalesce("k", F.lit(0)))).alias("same"))
    j = v.join(ln, ["source", "rel"], "left")
    vocab = F.col("common") / (F.col("n") + n_terms - F.col("common"))
    cover = F.col("common") / F.lit(max(n_terms, 1))
    sim = F.coalesce(2.0 * F.coalesce("same", F.lit(0)) / (F.coalesce("ln", F.lit(0)) + n_lines), F.lit(0.0))
    return j.select("source", "rel", vocab.alias("vocabulary"), cover.alias("coverage"), sim.alias("lines"), (0.4 * vocab + 0.3 * cover + 0.3 * sim).alias("score")).orderBy(F.desc("score"), "source", "rel").limit(top)


def text_blocks(a, b):
    """(ratio, [(tag, a1, a2, b1, b2, lines)]) of two texts, line numbers from 1, equal blocks left out."""
    la, lb = (a or "").splitlines(), (b or "").splitlines()
    sm = difflib.SequenceMatcher(None, la, lb, autojunk=False)
    ratio = sm.ratio() if len(la) + len(lb) < EXACT_LINES else sm.quick_ratio()
    out, shown = [], 0
    for tag, i1, i2, j1, j2 in sm.get_opcodes():
        if tag == "equal":
            continue
        body = []
        if shown <= DIFF_LINES:
            body = [f"- {x}" for x in la[i1 : min(i2, i1 + BLOCK_LINES)]] + [f"+ {x}" for x in lb[j1 : min(j2, j1 + BLOCK_LINES)]]
            shown += len(body) + 1
        out.append((tag, i1 + 1, i2, j1 + 1, j2, body))
    return ratio, out


def text_diff(pairs, keys):
    """(keys, ratio, tag, a1, a2, b1, b2, lines) of pairs (keys, text_a, text_b): one row per changed block, one with a null tag for equal texts."""
    schema = ", ".join(f"{k} {dict(pairs.dtypes)[k]}" for k in keys) + ", ratio double, tag string, a1 int, a2 int, b1 int, b2 int, lines array<string>"

    def run(batches):
        for x in batches:
            rows = []
            for r in x.itertuples(index=False):
                ratio, blocks = text_blocks(r.text_a, r.text_b)
                head = [getattr(r, k) for k in keys]
                rows += [(*head, ratio, *blk) for blk in blocks] or [(*head, ratio, None, None, None, None, None, None)]
            yield pd.DataFrame(rows, columns=[*keys, "ratio", "tag", "a1", "a2", "b1", "b2", "lines"]).astype({c: "Int32" for c in ("a1", "a2", "b1", "b2")})

    return pairs.select(*keys, "text_a", "text_b").mapInPandas(run, schema)


def rank_changed(diff, limit=150):
    """The first changed files by similarity, for a report."""
    return diff.where("status = 'changed'").orderBy("similarity", "rel").limit(limit)


