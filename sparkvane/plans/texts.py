"""Queries of charts, comparison, retrieval, citations and the chat store."""
from pyspark.sql import functions as F

from ..operators import charts, citations, compare, retrieval
from ..operators.ordered import next_key
from ..session import table as t
from .registry import query

@query("chart_count", "SELECT event_type AS x, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, x LIMIT 30")
def chart_count(s, d):
    return charts.build(t(s, d, "events"), "count", x="Event Type").data


@query("chart_bar_sum", "SELECT p_brand AS x, round(sum(p_retailprice), 3) AS y FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, x LIMIT 50")
def chart_bar_sum(s, d):
    return charts.build(t(s, d, "part"), "bar", x="p_brand", y="p_retailprice").data.withColumn("y", F.round("y", 3))


@query("chart_line_mean", "SELECT p_size AS x, round(avg(p_retailprice), 4) AS y FROM part GROUP BY 1")
def chart_line_mean(s, d):
    return charts.build(t(s, d, "part"), "line", x="p_size", y="p_retailprice").data.withColumn("y", F.round("y", 4))


@query("chart_pie", "SELECT c_mktsegment AS x, count(*) AS value FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def chart_pie(s, d):
    return charts.build(t(s, d, "customer"), "donut", x="c_mktsegment").data


@query("chart_corr", "WITH x AS (SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q, l_extendedprice AS p FROM lineitem) SELECT x, y, round(r, 6) AS r FROM ("
       + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM x" for a in ("q", "p") for b in ("q", "p")) + ")")
def chart_corr(s, d):
    x = t(s, d, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("q"), F.col("l_extendedprice").alias("p"))
    return charts.build(x, "corr").data.withColumn("r", F.round("r", 6))


@query("chart_crosstab", "SELECT o_orderstatus AS x, o_orderpriority AS y, count(*) AS n FROM orders GROUP BY 1, 2")
def chart_crosstab(s, d):
    return charts.build(t(s, d, "orders"), "heatmap", x="o_orderstatus", y="o_orderpriority").data


@query("chart_hist", """WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events) SELECT 'value' AS "column", CAST(least(floor((value - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 2""")
def chart_hist(s, d):
    return charts.build(t(s, d, "events"), "histograms", x="value").data.select("column", "bin", "n")


@query("chart_box", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT e.event_type AS "group", round(a, 6) AS q1, round(m, 6) AS median, round(b, 6) AS q3, min(value) FILTER (WHERE value >= a - 1.5 * (b - a)) AS whisker_low, max(value) FILTER (WHERE value <= b + 1.5 * (b - a)) AS whisker_high,
count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS fliers FROM events e JOIN q USING (event_type) GROUP BY e.event_type, a, m, b""")
def chart_box(s, d):
    x = charts.build(t(s, d, "events"), "box", y="value", x="event_type").data
    return x.select("group", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3")), "whisker_low", "whisker_high", "fliers")


@query("chart_violin", """WITH e AS (SELECT event_type AS g, value AS v FROM events WHERE value IS NOT NULL), st AS (SELECT g, min(v) AS lo, max(v) AS hi, coalesce(stddev_samp(v), 0) AS sd, count(*) AS n FROM e GROUP BY g),
b AS (SELECT g, least(floor((v - lo) / greatest((hi - lo) / 512, 1e-300)), 511) AS bin, lo, hi, greatest(sd * pow(n, -0.2), 1e-9) AS h, n, count(*) AS k FROM e JOIN st USING (g) GROUP BY ALL),
p AS (SELECT *, lo + (hi - lo) * j / 63 AS x FROM b, range(64) r(j))
SELECT g AS "group", round(x, 6) AS "at", round(sum(k * exp(-pow((x - (lo + (bin + 0.5) * (hi - lo) / 512)) / h, 2) / 2)) / any_value(n * h * 2.5066282746310002), 9) AS density FROM p GROUP BY g, x""")
def chart_violin(s, d):
    return charts.build(t(s, d, "events"), "violin", y="value", x="event_type").data.select("group", F.round("at", 6).alias("at"), F.round("density", 9).alias("density"))


@query("chart_scatter", """SELECT l_quantity AS x, l_extendedprice AS y, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber)), l_orderkey, l_linenumber, l_quantity, l_extendedprice LIMIT 20000""")
def chart_scatter(s, d):
    return charts.scatter(t(s, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query("chart_scatter_trend", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def chart_scatter_trend(s, d):
    return charts.trend(t(s, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


# ---- comparison -----------------------------------------------------------------------------------------------------------------

def changed_orders(s, d):
    return t(s, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice") * 1.1).alias("o_totalprice"), "o_orderdate")


@query("cmp_schema", """SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'bigint', 'same'), ('o_custkey', 'bigint', 'bigint', 'same'), ('o_orderstatus', 'string', 'string', 'same'), ('o_totalprice', 'double', 'double', 'same'),
('o_orderpriority', 'string', NULL, 'only in A')) v("column", in_a, in_b, status)""")
def cmp_schema(s, d):
    return compare.schema_diff(t(s, d, "orders").drop("o_orderdate"), changed_orders(s, d).drop("o_orderdate"))


@query("cmp_column_stats", """SELECT 'o_totalprice' AS "column", round(avg(o_totalprice), 3) AS mean_a, round(avg(o_totalprice * 1.1), 3) AS mean_b, round(stddev_samp(o_totalprice), 3) AS std_a, min(o_totalprice) AS min_a, max(o_totalprice) AS max_a,
0.0::DOUBLE AS null_pct_a, 10.0::DOUBLE AS mean_delta_pct FROM orders""")
def cmp_column_stats(s, d):
    x = compare.column_stats(t(s, d, "orders").select("o_totalprice"), changed_orders(s, d).select("o_totalprice"))
    return x.select("column", F.round("mean_a", 3).alias("mean_a"), F.round("mean_b", 3).alias("mean_b"), F.round("std_a", 3).alias("std_a"), "min_a", "max_a", "null_pct_a", F.round("mean_delta_pct", 6).alias("mean_delta_pct"))


@query("cmp_category_diff", """WITH b AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders) SELECT 'o_orderstatus' AS "column", (SELECT count(DISTINCT o_orderstatus) FROM orders) AS n_a, (SELECT count(DISTINCT v) FROM b) AS n_b,
(SELECT count(*) FROM (SELECT o_orderstatus FROM orders EXCEPT SELECT v FROM b)) AS only_a, (SELECT count(*) FROM (SELECT v FROM b EXCEPT SELECT o_orderstatus FROM orders)) AS only_b, 'X' AS new_values""")
def cmp_category_diff(s, d):
    return compare.category_diff(t(s, d, "orders"), changed_orders(s, d), "o_orderstatus")


@query("cmp_cell_diff", """SELECT 'o_custkey' AS "column", 0::BIGINT AS changed UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderkey % 7 = 0 AND o_orderstatus <> 'X') FROM orders
UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE o_totalprice * 1.1 <> o_totalprice) FROM orders UNION ALL SELECT 'o_orderdate', 0""")
def cmp_cell_diff(s, d):
    return compare.cell_diff(t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"), changed_orders(s, d), ["o_orderkey"])


def file_rows(s, d):
    """The files of all sources as they are stored; rows may be repeated."""
    return t(s, d, "files").where("text is not null").select("source", "rel", "text")


def corpus(s, d):
    """The files of all sources, each once."""
    return file_rows(s, d).dropDuplicates(["source", "rel"])


_FILES = "f AS (SELECT source, rel, any_value(text) AS text FROM files WHERE text IS NOT NULL GROUP BY 1, 2)"
_LINES = r"l AS (SELECT source, rel, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END AS ls FROM f)"


def edited(s, d):
    """Two trees of one source set: B lacks some files, and has a line more in others."""
    f = corpus(s, d).select(F.concat_ws("/", "source", "rel").alias("rel"), "text")
    k = F.pmod(F.length("text"), F.lit(10))
    return f, f.where(k != 3).withColumn("text", F.when(k == 5, F.concat(F.lit("added line\n"), F.col("text"))).otherwise(F.col("text")))


@query("cmp_tree", rf"""WITH {_FILES}, {_LINES} SELECT concat_ws('/', f.source, f.rel) AS rel, CASE length(text) % 10 WHEN 3 THEN 'only in A' WHEN 5 THEN 'changed' ELSE 'identical' END AS status,
CASE WHEN length(text) % 10 = 5 THEN round(2.0 * len(ls) / (2 * len(ls) + 1), 9)::DOUBLE END AS similarity FROM f JOIN l USING (source, rel)""")
def cmp_tree(s, d):
    return compare.tree_diff(*edited(s, d)).withColumn("similarity", F.round("similarity", 9))


@query("cmp_quick_ratio", rf"""WITH {_FILES}, {_LINES}, u AS (SELECT source, rel, ls, lead(ls) OVER (PARTITION BY source ORDER BY rel) AS nx FROM l), a AS (SELECT source, rel, x, count(*) AS n FROM (SELECT source, rel, unnest(ls) AS x FROM u WHERE nx IS NOT NULL) GROUP BY ALL),
b AS (SELECT source, rel, x, count(*) AS n FROM (SELECT source, rel, unnest(nx) AS x FROM u WHERE nx IS NOT NULL) GROUP BY ALL), m AS (SELECT source, rel, sum(least(a.n, b.n)) AS m FROM a JOIN b USING (source, rel, x) GROUP BY 1, 2)
SELECT source, rel, CASE WHEN len(ls) + len(nx) = 0 THEN 1.0 ELSE round(2.0 * coalesce(m, 0) / (len(ls) + len(nx)), 9) END::DOUBLE AS ratio FROM u LEFT JOIN m USING (source, rel) WHERE nx IS NOT NULL""")
def cmp_quick_ratio(s, d):
    c = corpus(s, d)  # names are paired first, then joined with the texts
    p = next_key(file_rows(s, d), "source", "rel").join(c.withColumnRenamed("text", "text_a"), ["source", "rel"]).join(c.select("source", F.col("rel").alias("next"), F.col("text").alias("text_b")), ["source", "next"])
    return compare.quick_ratio(p, ["source", "rel"]).withColumn("ratio", F.round("ratio", 9))


def _sql_list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _sql_tokens(e):
    """The terms of a text as a DuckDB list. A blank is put where a capital begins a word after capitals; RE2 has no lookahead."""
    parts = r"list_transform(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p))"
    return f"list_filter(flatten(list_transform(regexp_extract_all({e}, '[A-Za-z0-9_]+'), lambda w: list_concat([lower(w)], CASE WHEN len({parts}) > 1 THEN {parts} ELSE [] END))), lambda x: length(x) > 1 AND NOT list_contains({_sql_list(retrieval.STOP)}, x))"


@query("cmp_file_to_corpus", rf"""WITH {_FILES}, {_LINES}, o AS (SELECT source, rel, ls, list_distinct({_sql_tokens('text')}) AS ts FROM f JOIN l USING (source, rel) WHERE rel LIKE '%.py' ORDER BY source, rel LIMIT 1),
k AS (SELECT f.source, f.rel, l.ls, list_distinct({_sql_tokens('text')}) AS ts FROM f JOIN l USING (source, rel) WHERE (f.source, f.rel) NOT IN (SELECT (source, rel) FROM o)),
a AS (SELECT x, count(*) AS n FROM (SELECT unnest(ls) AS x FROM o) GROUP BY x), b AS (SELECT source, rel, x, count(*) AS n FROM (SELECT source, rel, unnest(ls) AS x FROM k) GROUP BY ALL),
m AS (SELECT source, rel, sum(least(a.n, b.n)) AS m FROM a JOIN b USING (x) GROUP BY ALL),
r AS (SELECT k.source, k.rel, len(list_intersect(k.ts, o.ts)) / (len(k.ts) + len(o.ts) - len(list_intersect(k.ts, o.ts))) AS vocabulary, len(list_intersect(k.ts, o.ts)) / len(o.ts) AS coverage,
2.0 * coalesce(m.m, 0) / (len(k.ls) + len(o.ls)) AS lines FROM k CROSS JOIN o LEFT JOIN m ON m.source = k.source AND m.rel = k.rel WHERE len(k.ts) > 0 AND len(o.ts) > 0)
SELECT source, rel, round(vocabulary, 9) AS vocabulary, round(coverage, 9) AS coverage, round(lines, 9)::DOUBLE AS lines, round(0.4 * vocabulary + 0.3 * coverage + 0.3 * lines, 9)::DOUBLE AS score FROM r ORDER BY score DESC, source, rel LIMIT 8""")
def cmp_file_to_corpus(s, d):
    c = corpus(s, d)
    one = c.where(F.col("rel").endswith(".py")).orderBy("source", "rel").limit(1).first()
    return compare.file_to_corpus(one["text"], c, own=(one["source"], one["rel"])).select("source", "rel", *(F.round(x, 9).alias(x) for x in ("vocabulary", "coverage", "lines", "score")))


@query("cmp_text_diff", rf"""WITH {_FILES}, {_LINES} SELECT concat_ws('/', source, rel) AS rel, round(2.0 * len(ls) / (2 * len(ls) + 1), 9)::DOUBLE AS ratio, 'insert' AS tag, 1::INT AS a1, 0::INT AS a2, 1::INT AS b1, 1::INT AS b2, ['+ added line'] AS lines
FROM f JOIN l USING (source, rel) WHERE length(text) % 10 = 5""")
def cmp_text_diff(s, d):
    a, b = edited(s, d)
    p = a.withColumnRenamed("text", "text_a").join(b.withColumnRenamed("text", "text_b"), "rel").where("text_a <> text_b")
    return compare.text_diff(p, ["rel"]).withColumn("ratio", F.round("ratio", 9))


# ---- retrieval ------------------------------------------------------------------------------------------------------------------

@query("txt_tokens", rf"WITH {_FILES}, k AS (SELECT source, rel, {_sql_tokens('text')} AS ts FROM f) SELECT source, rel, len(ts)::INT AS n_tokens, len(list_distinct(ts))::INT AS n_terms FROM k")
def txt_tokens(s, d):
    return corpus(s, d).select("source", "rel", retrieval.tokens(F.col("text")).alias("tokens")).select("source", "rel", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_terms"))


_WIN = rf"""WITH {_FILES}, {_LINES}, w AS (SELECT source, rel, unnest(list_filter(range(0, greatest(len(ls), 1), 30), lambda s: s = 0 OR s - 30 + 40 < len(ls))) AS start, ls FROM l)"""


@query("txt_windows", f'{_WIN} SELECT source, rel, start::INT AS start, least(start + 40, len(ls))::INT AS "end" FROM w')
def txt_windows(s, d):
    return retrieval.windows(corpus(s, d)).select("source", "rel", "start", "end")


_BODIES = rf"""{_WIN}, b AS (SELECT source, rel, start::INT AS start, least(start + 40, len(ls))::INT AS "end", array_to_string(ls[start + 1 : start + 40], chr(10)) AS body FROM w), k AS (SELECT source, rel, start, "end", body, {_sql_tokens('body')} AS ts FROM b)"""


def _sql_bm25(q):
    """SQL of every window's score for the terms of a query, in table s with the number of hits."""
    tf = ", ".join(f"len(list_filter(ts, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(q))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(q)))
    one = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.4 / (tf{i} + 1.4 * (0.25 + 0.75 * dl / a)) ELSE 0 END" for i in range(len(q)))
    hits = " + ".join(f"tf{i}" for i in range(len(q)))
    return f"""{_BODIES}, c AS (SELECT source, rel, start, "end", body, greatest(len(ts), 1) AS dl, {tf} FROM k), st AS (SELECT source, count(*) AS n, avg(dl) AS a, {df} FROM c GROUP BY source),
s AS (SELECT source, rel, start, "end", body, {hits} AS hits, ({one})::DOUBLE AS score FROM c JOIN st USING (source))"""


@query("txt_idf", f"""{_BODIES}, n AS (SELECT source, count(*) AS n FROM k GROUP BY source), t AS (SELECT source, unnest(list_distinct(ts)) AS token FROM k), g AS (SELECT source, token, count(*) AS df FROM t GROUP BY ALL)
SELECT source, token, df, n, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9)::DOUBLE AS idf FROM g JOIN n USING (source)""")
def txt_idf(s, d):
    return retrieval.document_frequency(corpus(s, d)).select("source", "token", "df", "n", F.round("idf", 9).alias("idf"))


@query("txt_bm25", f"""{_sql_bm25(['arrears', 'schedule', 'segment'])} SELECT source, rel, start, "end", round(score, 9) AS score FROM s WHERE hits > 0""")
def txt_bm25(s, d):
    return retrieval.bm25(file_rows(s, d), "arrears schedule by segment").withColumn("score", F.round("score", 9))


_SEARCHED = ["computed", "flag", "flag_schedule", "schedule"]


@query("txt_search_ranked", rf"""{_sql_bm25(_SEARCHED)}, d AS (SELECT source, rel, start, unnest(list_concat(regexp_extract_all(body, '{retrieval.DEFINES[0]}', 1), regexp_extract_all(body, '{retrieval.DEFINES[1]}', 1), regexp_extract_all(body, '{retrieval.DEFINES[2]}', 1))) AS name FROM s),
e AS (SELECT source, rel, start, string_split(name, '.')[-1] AS raw FROM d), g AS (SELECT source, rel, start, lower(raw) AS low, list_filter(list_distinct({_sql_tokens('raw')}), lambda p: p <> lower(raw)) AS p0 FROM e),
h AS (SELECT source, rel, start, low, CASE WHEN len(p0) > 0 THEN p0 ELSE [low] END AS parts FROM g),
i AS (SELECT source, rel, start, max(CASE WHEN list_contains({_sql_list(_SEARCHED)}, low) THEN len(parts) + 1 ELSE len(list_intersect(parts, {_sql_list(_SEARCHED)})) * len(list_intersect(parts, {_sql_list(_SEARCHED)})) / len(parts) END)::DOUBLE AS def FROM h GROUP BY ALL),
j AS (SELECT source, rel, start, "end", score + 1.5 * len(list_intersect(list_distinct({_sql_tokens('rel')}), {_sql_list(_SEARCHED)})) + 3 * coalesce(def, 0) AS score FROM s LEFT JOIN i USING (source, rel, start)),
top AS (SELECT * FROM j WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, lower(rel) DESC, rel DESC, start DESC) <= 16),
two AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY source, rel ORDER BY score DESC, start DESC) <= 2)
SELECT source, rel, start, "end", round(score, 9) AS score FROM (SELECT * FROM two ORDER BY score DESC, source, lower(rel) DESC, rel DESC, start DESC LIMIT 8)""")
def txt_search_ranked(s, d):
    return retrieval.search(file_rows(s, d), "where is flag_schedule computed").withColumn("score", F.round("score", 9))


@query("txt_grep", rf"""WITH {_FILES}, {_LINES}, n AS (SELECT source, rel, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS line_no FROM l)
SELECT source, rel, line_no, line FROM n WHERE regexp_matches(line, '(?i)zerodivision(error)?') ORDER BY source, rel, line_no LIMIT 60""")
def txt_grep(s, d):
    return retrieval.grep(corpus(s, d), "zerodivision(error)?", regex=True)


@query("txt_grep_context", rf"""WITH {_FILES}, {_LINES}, n AS (SELECT source, rel, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS line_no FROM l),
h AS (SELECT source, rel, line_no FROM n WHERE contains(lower(line), 'zerodivisionerror') ORDER BY source, rel, line_no LIMIT 60),
k AS (SELECT source, rel, line_no + x AS line_no, max(x = 0) AS hit FROM h, (VALUES (-2), (-1), (0), (1), (2)) v(x) GROUP BY 1, 2, 3) SELECT source, rel, line_no, line, hit FROM n JOIN k USING (source, rel, line_no)""")
def txt_grep_context(s, d):
    c = corpus(s, d)
    return retrieval.grep_context(c, retrieval.grep(c, "ZeroDivisionError"))


@query("txt_read", rf"""WITH {_FILES}, {_LINES}, o AS (SELECT source, rel FROM f ORDER BY source, rel LIMIT 1), n AS (SELECT source, rel, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS line_no FROM l)
SELECT source, rel, line_no, line FROM n JOIN o USING (source, rel) WHERE line_no BETWEEN 1 AND 400""")
def txt_read(s, d):
    c = corpus(s, d)
    r = c.orderBy("source", "rel").select("source", "rel").first()
    return retrieval.read_file(c, r["source"], r["rel"])


@query("txt_list", rf"""WITH {_FILES}, {_LINES} SELECT source, rel, len(ls)::INT AS n_lines FROM l WHERE rel LIKE '%.py' ORDER BY source, rel LIMIT 300""")
def txt_list(s, d):
    return retrieval.list_files(corpus(s, d), "*.py")


@query("txt_overview", rf"""WITH {_FILES}, {_LINES} SELECT source, split_part(rel, '/', 1) AS entry, count(*) AS files, CAST(sum(len(ls)) AS BIGINT) AS n_lines FROM l GROUP BY 1, 2""")
def txt_overview(s, d):
    return retrieval.overview(corpus(s, d))


@query("txt_extensions", rf"""WITH {_FILES}, g AS (SELECT source, lower(regexp_extract(rel, '(\.[^./]+)$', 1)) AS ext, count(*) AS files FROM f GROUP BY 1, 2) SELECT source, ext, files FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY files DESC, ext) <= 6""")
def txt_extensions(s, d):
    return retrieval.extensions(corpus(s, d))


# ---- citations: answers are the assistant's messages, the lines shown are the first twenty of each file ---------------------------

def answers(s, d):
    m = t(s, d, "messages").where("content is not null").groupBy(F.col("id").alias("answer_id")).agg(F.min("content").alias("text"), F.min("role").alias("role"), F.min("artifacts").alias("artifacts"))
    return m.where(F.lower(F.trim("role")).isin("assistant", "ai", "bot", "model")).select("answer_id", "text", F.lit(True).alias("grounded"), F.coalesce(F.col("artifacts").rlike("plotly|image"), F.lit(False)).alias("has_visual"))


def cite_files(s, d):
    return corpus(s, d)


def shown(s, d):
    f = corpus(s, d).select("source", "rel", F.lit(1).alias("start"), F.least(F.lit(20), F.size(retrieval.split_lines(F.col("text")))).alias("end")).where("end >= 1")
    return retrieval.evidence(f)


_ANS = r"""a AS (SELECT id AS answer_id, min(content) AS text, min(role) AS role FROM messages WHERE content IS NOT NULL GROUP BY id), a1 AS (SELECT answer_id, text FROM a WHERE lower(trim(role)) IN ('assistant', 'ai', 'bot', 'model')),
c AS (SELECT answer_id, unnest(regexp_extract_all(text, '(\[[^\[\]\n]{1,300}?:L\d+(?:\s*[-–]\s*L?\d+)?(?:\s*,\s*L?\d+(?:\s*[-–]\s*L?\d+)?)*\])', 1)) AS raw FROM a1),
r AS (SELECT answer_id, raw, trim(regexp_extract(raw, '^\[(.*):L[^:]*\]$', 1)) AS ref, unnest(string_split(regexp_extract(raw, ':(L[^:]*)\]$', 1), ',')) AS part FROM c), n AS (SELECT answer_id, raw, ref, list_transform(regexp_extract_all(part, '\d+'), lambda x: x::BIGINT) AS ns FROM r)"""


@query("cite_extract", f'WITH {_ANS} SELECT answer_id, raw, ref, least(ns[1], ns[-1]) AS start, greatest(ns[1], ns[-1]) AS "end" FROM n')
def cite_extract(s, d):
    return citations.extract(answers(s, d))


_SHOWN = "e AS (SELECT source, rel, least(20, len(ls)) AS k FROM l)"
#: Citations of c with the file each means (rank 1 to 4, one file at the best rank), its lines and how many of the cited ones were shown.
_RESOLVED = r"""x AS (SELECT answer_id, raw, ref, least(ns[1], ns[-1]) AS start, greatest(ns[1], ns[-1]) AS "end" FROM n), y AS (SELECT DISTINCT ref, regexp_replace(ref, '::?', '/', 'g') AS plain FROM x),
k AS (SELECT ref, l.source, l.rel, len(ls) AS size, CASE WHEN ref = l.rel OR lower(plain) = lower(l.source || '/' || l.rel) THEN 1 WHEN lower(ref) = lower(l.rel) THEN 2
WHEN ends_with(lower(l.rel), '/' || lower(plain)) OR ends_with(lower(l.source || '/' || l.rel), '/' || lower(plain)) THEN 3 WHEN NOT contains(plain, '/') AND lower(string_split(l.rel, '/')[-1]) = lower(plain) THEN 4 END AS rank
FROM y JOIN l ON lower(string_split(l.rel, '/')[-1]) = lower(string_split(plain, '/')[-1])),
best AS (SELECT ref, any_value(source) AS source, any_value(rel) AS rel, any_value(size) AS size FROM (SELECT * FROM k WHERE rank IS NOT NULL QUALIFY rank = min(rank) OVER (PARTITION BY ref)) GROUP BY ref HAVING count(*) = 1),
chk AS (SELECT x.answer_id, x.raw, x.start, x."end", source, rel, CASE WHEN source IS NULL THEN 'unknown_file' WHEN x.start < 1 OR x."end" > size THEN 'bad_range' WHEN greatest(0, least(x."end", e.k) - x.start + 1) < greatest(1, (x."end" - x.start + 1) // 2) THEN 'not_read' ELSE 'ok' END AS status
FROM x LEFT JOIN best USING (ref) LEFT JOIN e USING (source, rel))"""


@query("cite_check", f'WITH {_FILES}, {_LINES}, {_SHOWN}, {_ANS}, {_RESOLVED} SELECT answer_id, raw, start, "end", status, source, rel FROM chk')
def cite_check(s, d):
    return citations.check(citations.extract(answers(s, d)), cite_files(s, d), shown(s, d)).select("answer_id", "raw", "start", "end", "status", "source", "rel")


def remarks(s, d):
    """Answers about every file: the first name in it and a name made from that one, with a citation, and for some a word on a chart."""
    w = F.regexp_extract("text", r"([A-Za-z_][A-Za-z0-9_]{3,40})", 1)
    k = F.length("text") % 4
    said = F.when(k == 0, "The chart is shown below.").when(k == 1, "See the figure.").when(k == 2, "A plot cannot be shown.").otherwise("")
    text = F.concat(F.lit("`"), w, F.lit("` calls `"), w, F.lit("_x()` ["), F.col("source"), F.lit("/"), F.col("rel"), F.lit(":L1].\n\n`"), w, F.lit("_y` stands alone.\n\n"), said)
    return corpus(s, d).select(F.concat_ws("/", "source", "rel").alias("answer_id"), text.alias("text"), F.lit(True).alias("grounded"), F.endswith("rel", F.lit(".md")).alias("has_visual"))


_REMARKS = r"""w AS (SELECT *, regexp_extract(text, '([A-Za-z_][A-Za-z0-9_]{3,40})', 1) AS w FROM f),
a1 AS (SELECT concat_ws('/', source, rel) AS answer_id, '`' || w || '` calls `' || w || '_x()` [' || source || '/' || rel || ':L1].' || chr(10) || chr(10) || '`' || w || '_y` stands alone.' || chr(10) || chr(10) AS text, length(text) % 4 AS k, rel LIKE '%.md' AS has_visual FROM w)"""


@query("cite_identifiers", rf"""WITH {_FILES}, {_LINES}, {_SHOWN}, {_REMARKS}, c AS (SELECT answer_id, unnest(regexp_extract_all(text, '(\[[^\[\]\n]{{1,300}}?:L1\])', 1)) AS raw FROM a1),
n AS (SELECT answer_id, raw, regexp_extract(raw, '^\[(.*):L1\]$', 1) AS ref, [1::BIGINT] AS ns FROM c), {_RESOLVED},
p AS (SELECT answer_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS para FROM a1), i AS (SELECT answer_id, para, trim(unnest(regexp_extract_all(para, '`([^`\n]{{3,80}})`', 1))) AS identifier FROM p),
j AS (SELECT DISTINCT answer_id, para, identifier, regexp_replace(identifier, '\(\)$', '') AS bare FROM i WHERE regexp_matches(identifier, '^[A-Za-z_][A-Za-z0-9_.]*(\(\))?$')
AND identifier NOT IN (SELECT rel FROM files UNION SELECT string_split(rel, '/')[-1] FROM files UNION SELECT source FROM files)),
g AS (SELECT j.*, string_split(bare, '.')[-1] AS tail FROM j WHERE EXISTS (SELECT 1 FROM chk WHERE chk.answer_id = j.answer_id AND chk.source IS NOT NULL AND contains(j.para, chk.raw))),
seen AS (SELECT DISTINCT t FROM (SELECT bare AS t FROM g UNION SELECT tail FROM g) WHERE EXISTS (SELECT 1 FROM f JOIN e USING (source, rel) WHERE e.k > 0 AND contains(f.text, t)))
SELECT DISTINCT answer_id, identifier FROM g WHERE bare NOT IN (FROM seen) AND tail NOT IN (FROM seen)""")
def cite_identifiers(s, d):
    a = remarks(s, d)
    c = citations.check(citations.extract(a), cite_files(s, d), shown(s, d))
    return citations.identifiers(a, c, cite_files(s, d), shown(s, d))


@query("cite_uncited", f"""WITH {_ANS} SELECT answer_id FROM a1 WHERE length(regexp_replace(text, '(?s)```.*?```', '', 'g')) > 200 AND NOT starts_with(lower(ltrim(text, '*_# ')), 'general knowledge') AND answer_id NOT IN (SELECT answer_id FROM c)""")
def cite_uncited(s, d):
    a = answers(s, d)
    return citations.uncited(a, citations.extract(a))


@query("cite_visual_claims", f"""WITH {_FILES}, {_REMARKS} SELECT answer_id, CASE k WHEN 0 THEN 'chart is shown below' ELSE 'See the figure' END AS claim FROM a1 WHERE k < 2 AND NOT has_visual""")
def cite_visual_claims(s, d):
    return citations.visual_claims(remarks(s, d))


@query("chat_recent", "SELECT id, title, updated FROM (SELECT id, min(title) AS title, max(updated) AS updated FROM chats WHERE id IS NOT NULL GROUP BY id) ORDER BY updated DESC NULLS LAST, id LIMIT 200")
def chat_recent(s, d):
    c = t(s, d, "chats").where("id is not null").groupBy("id").agg(F.min("title").alias("title"), F.max("updated").alias("updated"))
    return c.orderBy(F.desc_nulls_last("updated"), "id").limit(200)


@query("table_artifact", "SELECT * FROM part ORDER BY p_partkey LIMIT 2000")
def table_artifact(s, d):
    return t(s, d, "part").orderBy("p_partkey").limit(2000)
