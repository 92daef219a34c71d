"""Queries of sources, sinks and tools: tables are written into a shared folder, read again by the readers, and must come back whole."""
import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..session import table as t
from ..sources import readers, sinks
from ..tools import Engine
from .registry import query


def _folder(s):
    return f"{shared_folder(s)}/sources/{uuid.uuid4().hex}"


@query("src_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_csv(s, d):
    at = f"{_folder(s)}/customer.csv"
    t(s, d, "customer").write.option("header", True).csv(at)
    return readers.read_csv(s, at).select(F.col("c_custkey").cast("bigint"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("src_tsv", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def src_tsv(s, d):
    at = f"{_folder(s)}/part.tsv"
    t(s, d, "part").write.option("header", True).option("sep", "\t").csv(at)
    return readers.read_table(s, at)["part"].select(F.col("p_partkey").cast("bigint"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query("src_excel", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def src_excel(s, d):
    at = f"{_folder(s)}/nation.xlsx"
    sinks.save_bytes(s, at, sinks.workbook({"nation": t(s, d, "nation")}))
    return readers.read_table(s, at)["nation"]


@query("src_feather", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def src_feather(s, d):
    at = f"{_folder(s)}/supplier.feather"
    sinks.save_bytes(s, at, sinks.feather(t(s, d, "supplier")))
    return readers.read_table(s, at)["supplier"]


@query("src_folder", """SELECT r_name || '.md' AS rel, '# ' || r_name || chr(10) || chr(10) || 'Region ' || r_regionkey AS text, NULL::VARCHAR AS skipped FROM region
UNION ALL SELECT 'broken.ipynb', NULL, 'JSONDecodeError: Expecting value: line 1 column 1 (char 0)' UNION ALL SELECT 'raw.txt', NULL, 'binary file'""")
def src_folder(s, d):
    at = _folder(s)
    for r in t(s, d, "region").collect():  # five rows
        sinks.save_bytes(s, f"{at}/{r['r_name']}.md", f"# {r['r_name']}\r\n\r\nRegion {r['r_regionkey']}".encode())
    for n, b in (("broken.ipynb", b"no notebook"), ("raw.txt", b"a\0b"), ("node_modules/x.js", b"x"), (".cache/y.md", b"y")):
        sinks.save_bytes(s, f"{at}/{n}", b)
    return readers.read_folder(s, at)


@query("tool_query_data", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def tool_query_data(s, d):
    at = f"{_folder(s)}/customer.parquet"
    t(s, d, "customer").write.parquet(at)
    e = Engine(s)
    e.registry.add_table("customer", s.read.parquet(at))
    r = e.call("query_data", expression="df.groupBy('c_mktsegment').agg(F.count('*').alias('n'), F.round(F.sum('c_acctbal'), 2).alias('total'))")
    a = r.artifacts[0]
    return s.createDataFrame([tuple(x) for x in a["data"]["data"]], "c_mktsegment string, n bigint, total double")


@query("tool_evidence", """SELECT r_name || '.md' AS rel, i::INT AS line FROM region, range(1, 4) x(i)""")
def tool_evidence(s, d):
    at = _folder(s)
    for r in t(s, d, "region").collect():  # five rows
        sinks.save_bytes(s, f"{at}/regions/{r['r_name']}.md", f"# {r['r_name']}\n\nRegion {r['r_regionkey']}".encode())
    e = Engine(s)
    e.call("load_path", path=f"{at}/regions")
    e.call("grep", pattern="Region")
    return e.evidence().select("rel", "line")


@query("src_pickle", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def src_pickle(s, d):
    import pickle

    at = f"{_folder(s)}/nation.pkl"
    sinks.save_bytes(s, at, pickle.dumps(t(s, d, "nation").toPandas()))  # 25 rows
    x = readers.read_table(s, at, trusted=True)["nation"]
    return x.select(F.col("n_nationkey").cast("bigint"), "n_name", F.col("n_regionkey").cast("bigint"))


@query("src_notebook", """SELECT r_name || '.ipynb' AS rel, '# %% [cell 0] markdown' || chr(10) || r_name || chr(10) || '# %% [cell 1] code' || chr(10) || 'x = ' || r_regionkey || chr(10) || '# ' || r_regionkey AS text FROM region""")
def src_notebook(s, d):
    import json

    at = _folder(s)
    for r in t(s, d, "region").collect():  # five rows
        cells = [{"cell_type": "markdown", "source": r["r_name"]}, {"cell_type": "code", "source": [f"x = {r['r_regionkey']}"], "outputs": [{"text": [str(r["r_regionkey"])]}]}]
        sinks.save_bytes(s, f"{at}/{r['r_name']}.ipynb", json.dumps({"cells": cells}).encode())
    return readers.read_folder(s, at).select("rel", "text")


@query("src_kinds", "SELECT * FROM (VALUES ('a.csv b.parquet', 'data'), ('a.py b.md', 'repo'), ('a.md b.pdf', 'docs'), ('Dockerfile', 'repo'), ('a.yaml b.md c.md d.md e.md f.md g.md', 'docs'), ('a.csv b.py', 'repo'), ('a.tf b.txt c.txt', 'repo')) v(names, kind)")
def src_kinds(s, d):
    names = ["a.csv b.parquet", "a.py b.md", "a.md b.pdf", "Dockerfile", "a.yaml b.md c.md d.md e.md f.md g.md", "a.csv b.py", "a.tf b.txt c.txt"]
    return s.createDataFrame([(n, readers.kind_of_folder(n.split())) for n in names], "names string, kind string")


@query("src_projects", "SELECT r_name AS project FROM region UNION ALL SELECT 'group/' || n_name FROM nation")
def src_projects(s, d):
    at = _folder(s)
    for r in t(s, d, "region").collect():  # five rows
        sinks.save_bytes(s, f"{at}/{r['r_name']}/README.md", b"x")
    for r in t(s, d, "nation").collect():  # 25 rows
        sinks.save_bytes(s, f"{at}/group/{r['n_name']}/setup.py", b"x")
        sinks.save_bytes(s, f"{at}/group/{r['n_name']}/deep/setup.py", b"x")
    _, rels, marks = readers.listing(s, at)
    return s.createDataFrame([(p,) for p in readers.projects(rels, marks)], "project string")


@query("src_paths", """SELECT * FROM (VALUES ('load /x/a.csv please', '/x/a.csv', true, NULL), ('open "/x/my file.csv"', '/x/my file.csv', true, NULL), ('what is in /x/a.csv?', '/x/a.csv', false, NULL),
('load the repo ./src/app', './src/app', true, 'repo'), ('use sales.xlsx', 'sales.xlsx', true, NULL), ('how many rows are there', '', false, NULL)) v(message, paths, is_load, hint)""")
def src_paths(s, d):
    from ..sources import registry

    said = ["load /x/a.csv please", 'open "/x/my file.csv"', "what is in /x/a.csv?", "load the repo ./src/app", "use sales.xlsx", "how many rows are there"]
    no = lambda p: False
    return s.createDataFrame([(m, " ".join(registry.find_paths(m, no)), registry.is_load_command(m, no), registry.kind_hint(m)) for m in said], "message string, paths string, is_load boolean, hint string")


def _engine(s, **tables):
    e = Engine(s)
    for n, x in tables.items():
        e.registry.add_table(n, x)
    return e


def _rows(s, artifact, schema):
    return s.createDataFrame([tuple(r) for r in artifact["data"]["data"]], schema)


@query("tool_make_chart", "SELECT c_mktsegment AS x, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, x LIMIT 30")
def tool_make_chart(s, d):
    r = _engine(s, customer=t(s, d, "customer")).call("make_chart", kind="countplot", x="C MktSegment")
    return _rows(s, r.artifacts[0], "x string, n bigint")


@query("tool_chart_expression", "SELECT p_brand AS x, round(sum(y), 2) AS y FROM (SELECT p_brand, p_retailprice AS y FROM part WHERE p_size > 25) GROUP BY 1")
def tool_chart_expression(s, d):
    r = _engine(s, part=t(s, d, "part")).call("make_chart", kind="bar", expression="df.where(F.col('p_size') > 25).select('p_brand', 'p_retailprice')")
    return _rows(s, r.artifacts[0], "x string, y double").withColumn("y", F.round("y", 2))


@query("tool_data_quality", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(*) - count({c}) AS missing_count, 0.0::DOUBLE AS missing_pct FROM supplier" for c, k in (("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double"))))
def tool_data_quality(s, d):
    r = _engine(s, supplier=t(s, d, "supplier")).call("run_data_quality")
    return _rows(s, r.artifacts[0], "column string, dtype string, missing_count bigint, missing_pct double")


@query("tool_sql", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def tool_sql(s, d):
    e = _engine(s, customer=t(s, d, "customer"), nation=t(s, d, "nation"))
    return _rows(s, e.call("query_data", expression="SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1").artifacts[0], "n_name string, n bigint")


@query("tool_comprehension", "SELECT unnest(['c_acctbal', 'c_custkey', 'c_nationkey']) AS name")
def tool_comprehension(s, d):
    import ast

    r = _engine(s, customer=t(s, d, "customer")).call("query_data", expression="[c for c in sorted(df.columns) if not c.endswith(('name', 'segment'))]")
    return s.createDataFrame([(c,) for c in ast.literal_eval(r.text)], "name string")


@query("tool_compare_tables", "SELECT 'c_acctbal' AS \"column\", count(*) FILTER (WHERE c_acctbal <> 0) AS changed FROM customer")
def tool_compare_tables(s, d):
    import re

    c = t(s, d, "customer")
    text = _engine(s, a=c, b=c.withColumn("c_acctbal", F.col("c_acctbal") * 2)).call("compare", a="a", b="b").text
    m = re.search(r"by column: (\w+) (\d+)$", text)
    return s.createDataFrame([(m[1], int(m[2]))], "column string, changed bigint")


def _texts(s, d):
    """An engine with a folder of texts, one for each nation: a heading, a line of its number, a line of its region."""
    at = f"{_folder(s)}/nations"
    for r in t(s, d, "nation").collect():  # 25 rows
        sinks.save_bytes(s, f"{at}/{r['n_name']}.md", f"# {r['n_name']}\n\nnumber {r['n_nationkey']}\nregion {r['n_regionkey']}\n".encode())
    e = Engine(s)
    e.call("load_path", path=at)
    return e


@query("tool_list_files", "SELECT 'nations/' || n_name || '.md' AS file, 4::BIGINT AS n_lines FROM nation")
def tool_list_files(s, d):
    import re

    text = _texts(s, d).call("list_files", glob="*.md").text
    return s.createDataFrame([(m[1], int(m[2])) for m in re.finditer(r"(?m)^(.*) \((\d+) lines\)$", text)], "file string, n_lines bigint")


@query("tool_read_file", "SELECT k::BIGINT AS line_no, CASE k WHEN 3 THEN 'number ' || n_nationkey ELSE 'region ' || n_regionkey END AS line FROM (SELECT * FROM nation ORDER BY n_name LIMIT 1), (VALUES (3), (4)) v(k)")
def tool_read_file(s, d):
    import re

    first = t(s, d, "nation").orderBy("n_name").first()["n_name"]
    text = _texts(s, d).call("read_file", path=f"{first.lower()}.md", start=3).text
    return s.createDataFrame([(int(m[1]), m[2]) for m in re.finditer(r"(?m)^(\d+)\| (.*)$", text)], "line_no bigint, line string")


@query("tool_search", "SELECT 'nations' AS source, n_name || '.md' AS rel, 1::INT AS start, 4::INT AS \"end\" FROM (SELECT * FROM nation ORDER BY n_name LIMIT 1)")
def tool_search(s, d):
    e = _texts(s, d)
    e.call("search", query=t(s, d, "nation").orderBy("n_name").first()["n_name"])
    return s.createDataFrame(e.shown[:1], "source string, rel string, start int, end int")  # the best window


@query("tool_overview", "SELECT 'nations' AS source, 25::BIGINT AS files, 100::BIGINT AS n_lines FROM (SELECT count(*) FROM nation)")
def tool_overview(s, d):
    from ..operators import retrieval

    return retrieval.overview(_texts(s, d).registry.corpus()).groupBy("source").agg(F.sum("files").alias("files"), F.sum("n_lines").alias("n_lines"))


@query("tool_errors", "SELECT unnest(['Error: unknown tool', 'Error: no data source is loaded', 'Error: the query calls something that is not allowed', 'Error: unknown chart kind']) AS text")
def tool_errors(s, d):
    e = Engine(s)
    got = [e.call("nope").text, e.call("data_overview").text]
    e.registry.add_table("nation", t(s, d, "nation"))
    got += [e.call("query_data", expression="SELECT java_method('a', 'b')").text, e.call("make_chart", kind="x", x="n_name").text]
    heads = ("Error: unknown tool", "Error: no data source is loaded", "Error: the query calls something that is not allowed", "Error: unknown chart kind")
    return s.createDataFrame([(next((h for h in heads if x.startswith(h)), x),) for x in got], "text string")


@query("dq_summary_line", "SELECT count(*) || ' rows × 5 columns · 0 missing values · ' || count(*) || ' duplicate rows' AS line FROM customer")
def dq_summary_line(s, d):
    from ..operators import quality

    c = t(s, d, "customer")
    return s.createDataFrame([(quality.summary_line(c.union(c)).replace(f"{2 * c.count()} rows ×", f"{c.count()} rows ×"),)], "line string")


@query("gate_format", "SELECT count(*) - 60 AS more FROM part")
def gate_format(s, d):
    import re

    from . import gate

    return s.createDataFrame([(int(re.search(r"(\d+) more rows", gate.format_result(t(s, d, "part")))[1]),)], "more bigint")


@query("chart_aliases", "SELECT * FROM (VALUES ('hist', 'histogram'), ('corr', 'heatmap'), ('Donut', 'pie'), ('boxplots', 'box'), ('bar plot', 'bar'), ('lineplot', 'line'), ('violins', 'violin'), ('area', 'area')) v(name, kind)")
def chart_aliases(s, d):
    from ..operators import charts

    return s.createDataFrame([(n, charts.kind_of(n)) for n in ("hist", "corr", "Donut", "boxplots", "bar plot", "lineplot", "violins", "area")], "name string, kind string")


@query("chart_aggregates", "SELECT unnest(['mean', 'sum', 'count', 'median', 'min', 'max']) AS agg, unnest([round(avg(p_size), 6), sum(p_size), count(p_size), median(p_size), min(p_size), max(p_size)])::DOUBLE AS y FROM part")
def chart_aggregates(s, d):
    from ..operators import charts

    one = t(s, d, "part").withColumn("all", F.lit("x"))
    out = None
    for a in charts.AGGREGATES:
        x = charts.aggregate(one, "all", "p_size", a).select(F.lit(a).alias("agg"), F.round(F.col("y").cast("double"), 6).alias("y"))
        out = x if out is None else out.unionByName(x)
    return out


@query("smote_rows", "SELECT o_orderstatus AS class, max(count(*)) OVER () - count(*) AS made, true AS inside FROM orders GROUP BY 1 QUALIFY made > 0")
def smote_rows(s, d):
    from ..operators import metrics

    o = t(s, d, "orders")
    x = metrics.smote_rows(o, "o_orderstatus", ["o_totalprice"], "o_orderkey")
    span = o.groupBy(F.col("o_orderstatus").alias("class")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    v = F.col("features")[0]
    return x.join(span, "class").groupBy("class").agg(F.count("*").alias("made"), F.min((v >= F.col("lo") - 1e-6) & (v <= F.col("hi") + 1e-6)).alias("inside"))
