"""Helpers of the text operators: spreading of work, role names, ordering of rows in groups of any size."""
import pandas as pd
from pyspark.sql import functions as F

#: Role spellings, trimmed and in lower case.
USER = ("user", "human")
ASSISTANT = ("assistant", "ai", "bot", "model")


def spread(df, *keys):
    """Hash-spread rows by `keys` when the scan has fewer partitions than the cluster has cores.

    Text work is CPU-bound, so a few large splits would leave cores idle; with enough splits nothing is shuffled."""
    want = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)


def per_text(df, schema, fn, *, keys, extra=()):
    """Rows of `fn(**row)` (an iterable of tuples) for each row of `df`, `keys` and `extra` being the columns it needs.

    The function sees one Arrow batch at a time; only its own output leaves the Python worker."""
    cols = [*keys, *extra]
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches):
        for b in batches:
            rows = [r for vals in zip(*(b[c].tolist() for c in cols), strict=True) for r in fn(*vals)]
            yield pd.DataFrame(rows, columns=names)

    return spread(df.select(*cols), *keys).mapInPandas(run, schema)


def of_kind(rows, sources, kind):
    """The `rows` (with columns source and kind) of sources of a kind; where a row's kind is null, its source's own holds.

    One left join and one filter, so the Python pass that made the rows runs once. The planner measures the list of names and
    broadcasts it only where it is small; rows, not texts, move otherwise."""
    own = sources.where((F.col("kind") == kind) & F.col("name").isNotNull()).select(F.col("name").alias("source")).distinct().withColumn("_own", F.lit(True))
    return rows.join(own, "source", "left").where((F.col("kind") == kind) | (F.col("kind").isNull() & F.col("_own"))).drop("_own")


def role_of(col):
    """'user', 'assistant', 'other' for rows of role system and tool, else null."""
    r = F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
    return F.when(r.isin(*USER), "user").when(r.isin(*ASSISTANT), "assistant").when(r.isin("system", "tool"), "other")


#: A character that is none of those without a visible form: white space of all scripts, controls, format characters, joiners, fillers and variation selectors.
VISIBLE = r"[^\s\p{Z}\p{C}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{FE00}-\x{FE0F}\x{034F}]"


def visible(col):
    """True where the text has a visible character; false for null."""
    return F.coalesce(col.rlike(VISIBLE), F.lit(False))


def number(col):
    """A double with NaN taken as null."""
    return F.when(F.isnan(col), None).otherwise(col)
