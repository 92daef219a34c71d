"""Keyword retrieval over text files: tokens, windows, BM25 with definition and path boosts, grep, reading and listing.

A corpus is a DataFrame (source, rel, text). Rows repeated whole should be dropped before; null texts give nothing."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import checkpoint, spread

# Window and stride in lines, BM25 parameters, boosts, caps of the reports.
WINDOW, STRIDE = 40, 30
K1, B = 1.4, 0.75
PATH_BOOST, DEFINITION_BOOST = 1.5, 3.0
TOP, PER_FILE, GREP_HITS, READ_LINES, LIST_FILES = 8, 2, 60, 400, 300
# Words that are never terms.
STOP = (
    "a an and are as at be by for from has have how i in is it its of on or that the this to was were what when where which who why will with does do did can not no yes you your we our they them there "
    "their then than if else into about all any each per via use used using code file files function functions repo document").split()
_WORD = r"[A-Za-z0-9_]+"
_PART = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+"
# What defines a name at the start of a line.
DEFINES = (
    r"(?m)^\s*(?i:(?:async\s+)?(?:def|class|function|func|fn|sub|procedure))\s+([A-Za-z_]\w*)",
    r"(?m)^\s*([A-Z][A-Z0-9_]{2,})\s*[:=]",
    r"(?m)^\s*(?i:create\s+(?:or\s+replace\s+)?(?:table|view|function|procedure))\s+([\w.]+)")


def tokens(text):
    """Array of terms of a text column: whole words in lower case, then their snake and camel parts, without stop words and single characters."""
    words = F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))
    stop = F.array(*(F.lit(w) for w in STOP))

    def of(w):
        # the parts of a word are found piece by piece between underscores; a word of one part is that part
        parts = F.filter(F.transform(F.flatten(F.transform(F.split(w, "_"), lambda p: F.regexp_extract_all(p, F.lit(f"({_PART})"), F.lit(1)))), F.lower), lambda p: p != "")
        return F.concat(F.array(F.lower(w)), F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>")))

    every = F.flatten(F.transform(words, of))
    return F.filter(every, lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A stop word or a single character as a whole word, in lower case; and a word that has one part only.
_STOPPED = r"(?<![a-z0-9_])(?:[a-z0-9_]|" + "|".join(STOP) + r")(?![a-z0-9_])"
_ONE_PART = r"(?<![A-Za-z0-9_])_*+(?:[A-Z]?[a-z]++|[A-Z]++|\d++)_*+(?![A-Za-z0-9_])"


def terms(text):
    """The terms of `tokens` in another order: all whole words, then the parts of the words that have several.

    Each step is one pass of a pattern over the text, where `tokens` works on word by word; only parts are filtered one by one."""
    stop = F.array(*(F.lit(w) for w in STOP))
    whole = F.regexp_extract_all(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _STOPPED, " "), F.lit("([a-z0-9_]+)"), F.lit(1))
    parts = F.regexp_extract_all(F.regexp_replace(text, _ONE_PART, " "), F.lit(f"({_PART})"), F.lit(1))
    return F.concat(whole, F.filter(F.transform(parts, F.lower), lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x)))


def split_lines(text):
    """Lines of a text column as Python's splitlines gives them: all line breaks count, and a final one opens no empty line."""
    brk = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, f"(?:{brk})\\z", ""), brk, -1))


def lines(corpus):
    """(source, rel, line_no, line), numbered from 1."""
    return corpus.where("text is not null").select("source", "rel", F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).select("source", "rel", (F.col("pos") + 1).alias("line_no"), "line")


def windows(corpus):
    """(source, rel, start, end, body): windows of 40 lines every 30, up to the one that reaches the end. `start` counts from 0."""
    x = corpus.where("text is not null").select("source", "rel", split_lines(F.col("text")).alias("ls"))
    n = F.size("ls")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), F.lit(STRIDE)), lambda s: (s == 0) | (s - STRIDE + WINDOW < n))
    x = x.withColumn("start", F.explode(starts))
    return x.select("source", "rel", "start", F.least(F.col("start") + WINDOW, n).alias("end"), F.array_join(F.slice("ls", F.col("start") + 1, F.lit(WINDOW)), "\n").alias("body"))


def postings(corpus):
    """(source, rel, start, token, tf, dl): the inverted index. One row per term of a window; grouped by window and term, so no term's list is gathered."""
    w = windows(corpus).select("source", "rel", "start", tokens(F.col("body")).alias("ts"))
    x = w.select("source", "rel", "start", F.greatest(F.size("ts"), F.lit(1)).alias("dl"), F.explode("ts").alias("token"))
    return x.groupBy("source", "rel", "start", "token", "dl").agg(F.count("*").alias("tf"))


def document_frequency(corpus):
    """(source, token, df, n, idf) over the windows of each source. Each window also counts under a null token, which gives n in the same pass."""
    ts = F.array_append(F.array_distinct(terms(F.col("body"))), F.lit(None).cast("string"))
    d = windows(corpus).select("source", F.explode(ts).alias("token")).groupBy("source", "token").agg(F.count("*").alias("df"))
    n = d.where("token is null").select("source", F.col("df").alias("n"))
    return d.where("token is not null").join(n, "source").withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def query_tokens(spark, text):
    """Distinct terms of a query, in the tokeniser's own terms."""
    return sorted(set(spark.createDataFrame([(text,)], "q string").select(tokens(F.col("q")).alias("t")).first()["t"]))


def _boost(q):
    """Path and definition boosts of a window for the query's terms."""
    path = F.size(F.array_intersect(F.array_distinct(tokens(F.col("rel"))), F.array(*(F.lit(t) for t in q)))) * PATH_BOOST
    names = F.flatten(F.array(*(F.regexp_extract_all("body", F.lit(p), F.lit(1)) for p in DEFINES)))
    return path + DEFINITION_BOOST * definition_score(names, q)


def _scored(corpus, q, boosted):
    """(source, rel, start, end, hits, bm25, boost) of every window that scores. What depends on a text is computed where it is scanned: only
    lengths, term counts and boosts move. Files repeated as rows count once; they meet on (source, rel, start), and their texts stay where
    they are. The slim rows are written, as both the sums of a source and the scores read them."""
    boost = _boost(q) if boosted else F.lit(0.0)
    w = windows(spread(corpus, "source", "rel")).select("source", "rel", "start", "end", boost.alias("boost"), terms(F.col("body")).alias("ts"))
    tf = [(F.size("ts") - F.size(F.array_remove("ts", t))).alias(f"tf{k}") for k, t in enumerate(q)]
    w = w.select("source", "rel", "start", "end", "boost", F.greatest(F.size("ts"), F.lit(1)).alias("dl"), *tf).dropDuplicates(["source", "rel", "start"])
    w = checkpoint(w)
    stats = w.groupBy("source").agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *(F.count(F.when(F.col(f"tf{k}") > 0, 1)).alias(f"df{k}") for k in range(len(q))))
    score = F.lit(0.0)
    for k in range(len(q)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        tf = F.col(f"tf{k}")
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg")))).otherwise(0.0)
    hits = sum((F.col(f"tf{k}") for k in range(len(q))), F.lit(0))
    live = w.where((hits > 0) | (F.col("boost") > 0))
    return live.join(stats, "source").select("source", "rel", "start", "end", hits.alias("hits"), score.alias("bm25"), "boost")


def bm25(corpus, query):
    """(source, rel, start, end, score) of windows that hold a query term."""
    q = query_tokens(corpus.sparkSession, query)
    return _scored(corpus, q, False).where("hits > 0").select("source", "rel", "start", "end", F.col("bm25").alias("score"))


def definition_score(names, terms):
    """Best agreement of defined names with the query terms. A name is what follows the last dot; its parts are its terms but for the
    whole name, which stands in where there are none. A name that is a term counts its parts + 1, others hits² / parts."""
    qs = F.array(*(F.lit(t) for t in terms))

    def one(name):
        raw = F.element_at(F.split(name, r"\."), -1)
        low = F.lower(raw)
        parts = F.filter(F.array_distinct(tokens(raw)), lambda p: p != low)
        parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(low))
        hits = F.size(F.array_intersect(parts, qs))
        return F.when(F.array_contains(qs, low), (F.size(parts) + 1).cast("double")).otherwise(hits * hits / F.size(parts).cast("double"))

    return F.coalesce(F.array_max(F.transform(names, one)), F.lit(0.0))


def search(corpus, query, top=TOP):
    """The best windows: BM25 plus path and definition boosts, at most 2·top per source and two per file.

    Of equal scores in a source the later file by name, then the later window comes first; sources come by name."""
    spark = corpus.sparkSession
    q = query_tokens(spark, query)
    if not q:
        return spark.createDataFrame([], "source string, rel string, start int, end int, score double")
    s = _scored(corpus, q, True).select("source", "rel", "start", "end", (F.col("bm25") + F.col("boost")).alias("score")).where("score > 0")
    order = [F.desc("score"), F.desc(F.lower("rel")), F.desc("rel"), F.desc("start")]
    # per source the best 2·top are found in two rounds, so that a large source is not ranked in one task
    s = s.withColumn("_b", F.pmod(F.xxhash64("rel", "start"), F.lit(64)))
    s = s.withColumn("_k", F.row_number().over(Window.partitionBy("source", "_b").orderBy(*order))).where(F.col("_k") <= 2 * top)
    s = s.withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("_k") <= 2 * top)
    s = s.withColumn("_f", F.row_number().over(Window.partitionBy("source", "rel").orderBy(*order))).where(F.col("_f") <= PER_FILE)
    return s.orderBy(F.desc("score"), F.asc("source"), *order[1:]).limit(top).drop("_k", "_f", "_b")


def glob_to_regex(pattern):
    """A shell pattern as a Java regular expression over the whole name."""
    out = ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]"
            i = j
        else:
            out += "\\" + c if not c.isalnum() and c not in "_/ " else c
        i += 1
    return f"(?s)\\A(?:{out})\\z"


def by_glob(df, pattern):
    """Rows whose path or file name fits a shell pattern."""
    if not pattern:
        return df
    rx = glob_to_regex(pattern)
    return df.where(F.col("rel").rlike(rx) | F.element_at(F.split("rel", "/"), -1).rlike(rx))


def grep(corpus, pattern, regex=False, ignore_case=True, glob=None, hits=GREP_HITS):
    """(source, rel, line_no, line) of matching lines, the first `hits` by file and line. A pattern that cannot be compiled is an error."""
    import re

    if regex:
        try:
            re.compile(pattern)
        except re.error as x:
            raise ValueError(f"Invalid regex: {x}") from None
    rx = ("(?i)" if ignore_case else "") + (pattern if regex else "".join("\\" + c if not c.isalnum() and ord(c) < 128 and not c.isspace() and c != "_" else c for c in pattern))
    found = lines(by_glob(corpus, glob)).where(F.col("line").rlike(rx))
    return found.orderBy("source", "rel", "line_no").limit(hits)


def grep_context(corpus, found, context=2):
    """Lines around hits, merged: each line once, with a mark on the hits. Hits are listed under each line they show, so it is an equality join."""
    near = found.select("source", "rel", F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("line_no"), F.col("line_no").alias("_at"))
    near = near.groupBy("source", "rel", "line_no").agg(F.max(F.col("line_no") == F.col("_at")).alias("hit"))
    return lines(corpus).join(near, ["source", "rel", "line_no"])


def read_file(corpus, source, rel, start=1, end=None):
    """Lines of a file, at most 400 from `start`."""
    last = min(end or start + READ_LINES - 1, start + READ_LINES - 1)
    return lines(corpus.where((F.col("source") == source) & (F.col("rel") == rel))).where(F.col("line_no").between(start, last))


def list_files(corpus, glob=None, limit=LIST_FILES):
    """(source, rel, n_lines) of the first files by name."""
    return by_glob(corpus, glob).where("text is not null").select("source", "rel", F.size(split_lines(F.col("text"))).alias("n_lines")).orderBy("source", "rel").limit(limit)


def overview(corpus):
    """(source, entry, files, n_lines): top-level entries of each source."""
    x = corpus.where("text is not null").select("source", F.split("rel", "/")[0].alias("entry"), F.size(split_lines(F.col("text"))).alias("k"))
    return x.groupBy("source", "entry").agg(F.count("*").alias("files"), F.sum("k").alias("n_lines"))


def readme_head(corpus, n=40):
    """First lines of the README of each source's top folder."""
    return lines(corpus.where(F.lower("rel").rlike(r"\Areadme(\.\w+)?\z"))).where(F.col("line_no") <= n)


def extensions(corpus, top=6):
    """(source, ext, files): the most frequent endings of each source."""
    e = F.lower(F.regexp_extract("rel", r"(\.[^./]+)\z", 1))
    g = corpus.groupBy("source", e.alias("ext")).agg(F.count("*").alias("files"))
    return g.withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("files"), "ext"))).where(F.col("_k") <= top).drop("_k")


def evidence(shown):
    """(source, rel, line) of shown line ranges (source, rel, start, end), each line once."""
    return shown.select("source", "rel", F.explode(F.sequence("start", "end")).alias("line")).distinct()


