import io
import json
import zipfile

import pandas as pd
import pytest

from sparkvane.plans import gate
from sparkvane.sources import readers, registry, sinks
from sparkvane.tools import Engine


def docx(parts):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(parts)}</w:body></w:document>")
    return out.getvalue()


def para(text, style=None):
    s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{s}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_text_formats():
    cell = "<w:tc>{}</w:tc>"
    d = docx([para("Policy", "Heading1"), para("Scope", "Heading2"), para("All models."), para(""), "<w:tbl>" + "".join(f"<w:tr>{cell.format(para(a))}{cell.format(para(b))}</w:tr>" for a, b in (("a", "b"), ("c", "d"))) + "</w:tbl>"])
    assert readers.text_of("x.docx", d)[0].split("\n") == ["# Policy", "## Scope", "All models.", "| a | b |", "| c | d |"]
    nb = json.dumps({"cells": [{"cell_type": "code", "source": ["x = 1\n", "x"], "outputs": [{"text": ["1\n"]}]}, {"cell_type": "markdown", "source": "hi"}]}).encode()
    assert readers.text_of("n.ipynb", nb)[0].startswith("# %% [cell 0] code\nx = 1\nx\n# 1")
    assert readers.text_of("b.txt", b"a\0b") == (None, "binary file")
    assert readers.text_of("c.txt", "é\r\nx".encode("cp1252"))[0] == "é\nx"
    assert readers.text_of("bad.ipynb", b"{")[1].startswith("JSONDecodeError")


def test_tables_round_trip(spark, tmp_path):
    p = pd.DataFrame({"a": [1, 2, 3], "b": ["x", "y", None], "c": [1.5, None, 2.0]})
    p.to_csv(tmp_path / "t.csv", index=False)
    p.to_csv(tmp_path / "t.tsv", index=False, sep="\t")
    p.to_parquet(tmp_path / "t.parquet")
    p.to_feather(tmp_path / "t.feather")
    p.to_pickle(tmp_path / "t.pkl")
    (tmp_path / "t.xlsx").write_bytes(sinks.workbook({"first sheet": spark.createDataFrame(p), "empty": spark.createDataFrame([], "z int")}))
    for ext in ("csv", "tsv", "parquet", "feather", "xlsx"):
        got = readers.read_table(spark, str(tmp_path / f"t.{ext}"))
        assert len(got) == 1
        d = next(iter(got.values()))
        assert sorted((int(r["a"]), r["b"]) for r in d.collect() if r["b"]) == [(1, "x"), (2, "y")]
    with pytest.raises(readers.SourceError, match="run code"):
        readers.read_table(spark, str(tmp_path / "t.pkl"))
    assert next(iter(readers.read_table(spark, str(tmp_path / "t.pkl"), trusted=True).values())).count() == 3


def test_folder_and_registry(spark, tmp_path):
    (tmp_path / "proj/src").mkdir(parents=True)
    (tmp_path / "proj/.git").mkdir()
    (tmp_path / "proj/.git/config").write_text("x")
    (tmp_path / "proj/src/train.py").write_text("MIN_ACC = 1\ndef f():\n    return MIN_ACC\n")
    (tmp_path / "proj/README.md").write_text("# Proj\nhello\n")
    (tmp_path / "proj/raw.bin").write_bytes(b"\0\1")
    pd.DataFrame({"k": ["a", "b", "a"], "v": [1, 2, 3]}).to_csv(tmp_path / "sales.csv", index=False)
    e = Engine(spark)
    assert e.call("load_path", path=str(tmp_path / "proj")).text.startswith("Loaded proj (repo): 2 files; skipped 1")
    assert "sales: 3 rows × 2 columns" in e.call("load_path", path=str(tmp_path / "sales.csv")).text
    e.call("load_path", path=str(tmp_path / "sales.csv"))
    assert list(e.registry.sources) == ["proj", "sales.csv"] and e.registry.find("SALES").kind == "data"
    assert "train.py" in e.call("search", query="where is f defined MIN_ACC").text
    r = e.call("query_data", expression="df.groupBy('k').agg(F.sum('v').alias('s')).orderBy('k')")
    assert r.artifacts[0]["total_rows"] == 2
    assert "4" in e.call("query_data", expression="SELECT sum(v) AS s FROM sales WHERE k = 'a'").text
    assert e.call("nope").text.startswith("Error:") and e.call("read_file", path="zz.py").text.startswith("Error:")
    assert e.call("compare", a="proj", b="sales").text.startswith("Error:")
    assert e.message(f"please load {tmp_path}/sales.csv").text.startswith("Loaded") and e.message("what is in it?") is None
    assert e.call("unload_source", name="proj").text == "Unloaded proj"


def test_paths_in_messages():
    have = {"/data/my file.csv", "/data/a.csv"}.__contains__
    assert registry.find_paths('load "/data/my file.csv" and /data/a.csv.', have) == ["/data/my file.csv", "/data/a.csv"]
    assert registry.is_load_command("load /data/a.csv", have) and not registry.is_load_command("what is in /data/a.csv?", have)
    assert registry.kind_hint("the repository at x") == "repo"
    assert readers.kind_of_folder(["a.csv", "b.parquet"]) == "data" and readers.kind_of_folder(["a.py", "b.md"]) == "repo" and readers.kind_of_folder(["a.md"]) == "docs"
    assert readers.projects(["p1/README.md", "p2/setup.py", "x.txt"]) == ["p1", "p2"] and readers.projects(["p1/README.md"]) == []


BLOCKED = [
    "__import__('os')", "df.write.csv('x')", "df.rdd.map(lambda x: x)", "df.sparkSession.sql('select 1')", "df.toPandas().to_csv('x')", "F.udf(lambda x: x)", "open('x')", "df.foreach(print)", "df.createTempView('x')", "df.__class__",
    "(lambda: exec('1'))()", "df.mapInPandas(lambda x: x, 'a int')", "F.expr('java_method(1)')", "'{0.__class__}'.format(df)", "(x := 1)", "[x for x in ().__class__.__bases__]", "F.java_method('a')", "df.cache()", "import os", "df = 1", "eval('1')"]


@pytest.mark.parametrize("text", BLOCKED)
def test_gate_refuses(spark, text):
    with pytest.raises(gate.QueryError):
        gate.evaluate(text, spark.range(3), {})


@pytest.mark.parametrize("text", ["drop table x", "select reflect('java.lang.System', 'exit')", "select * from parquet.`/tmp/x`", "insert into x values (1)", "select 1; select 2", "set a=b", "create view v as select 1", "select java_method('a', 'b')"])
def test_sql_refuses(spark, text):
    with pytest.raises(gate.QueryError):
        gate.sql(spark, text)


def test_gate_allows(spark):
    df = spark.range(6).withColumnRenamed("id", "a")
    assert gate.evaluate("df.where(F.col('a') > 2).count()", df) == 3
    assert gate.evaluate("[c for c in df.columns if len(c) == 1]", df) == ["a"]
    assert gate.evaluate("```python\ndfs['x'].select('a').distinct()\n```", df, {"x": df}).count() == 6
    assert gate.sql(spark, "select 'drop; table' as t").first()[0] == "drop; table"
    assert gate.format_result(spark.range(100)).endswith("(40 more rows)")


def test_chat_store(spark):
    s = sinks.ChatStore()
    i = s.create("t")
    s.add(i, "user", "hi", meta={"kind": "x"})
    s.rename(i, "u")
    assert s.chats()[0]["title"] == "u" and s.messages(i)[0]["content"] == "hi" and s.frame(spark).count() == 1
    s.delete(i)
    assert s.chats() == [] and s.frame(spark).count() == 0


def test_kinds_projects_and_limits(spark, tmp_path):
    assert readers.kind_of_folder(["Dockerfile"]) == "repo" and readers.kind_of_folder(["a.yaml", "b.md", "c.md", "d.md"]) == "repo" and readers.kind_of_folder(["a.yaml", *(f"{k}.md" for k in range(9))]) == "docs"
    assert readers.projects(["g/a/pom.xml", "g/b/go.mod", "g/c/x.py"]) == ["g/a", "g/b"] and readers.projects(["a/x.py", "b/y.py"], marks=["a", "b"]) == ["a", "b"] and readers.projects(["a/setup.py", "b/setup.py"], marks=[""]) == []
    for k in range(21):
        (tmp_path / f"t{k}.csv").write_text("a\n1\n")
    e = Engine(spark)
    assert "holds 21 tables" in e.call("load_path", path=str(tmp_path)).text
    (tmp_path / "far/sub").mkdir(parents=True)
    (tmp_path / "far/sub/m.py").write_text("def grow():\n    return 1\n")
    (tmp_path / "far/.eggs").mkdir()
    (tmp_path / "far/.eggs/no.py").write_text("x")
    assert "Loaded far (repo): 1 files" in e.call("load_path", path=f"file://{tmp_path}/far").text


def test_evidence_and_output_folder(spark, tmp_path):
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj/a.py").write_text("def grow():\n    return 1\n")
    (tmp_path / "proj/b.py").write_text("def grow():\n    return 2\n")
    for n, v in (("x", 1), ("y", 5)):
        pd.DataFrame({"k": ["a", "b"], "v": [v, 2]}).to_csv(tmp_path / f"{n}.csv", index=False)
    e = Engine(spark, output_dir=str(tmp_path / "out"))
    for p in ("proj", "x.csv", "y.csv"):
        e.call("load_path", path=str(tmp_path / p))
    e.call("read_file", path="a.py")
    assert sorted(tuple(r) for r in e.evidence().collect()) == [("proj", "a.py", 1), ("proj", "a.py", 2)]
    r = e.check_answer("It grows in `grow` and `shrink` by `v` [a.py:L1-2]. See the chart below.")
    assert [c["status"] for c in r["citations"].collect()] == ["ok"] and [x["identifier"] for x in r["identifiers"].collect()] == ["shrink"] and r["visual_claims"].count() == 1
    e.new_turn()
    assert [c["status"] for c in e.check_answer("x [a.py:L1-2]")["citations"].collect()] == ["not_read"]
    t = e.call("compare", a="x.csv", b="y.csv").text
    assert "row-aligned cell differences: 1; by column: v 1" in t
    t = e.call("compare", a="proj", b="proj", file_a="a.py").text
    assert "closest: b.py" in t and "return 2" in t
    c = e.call("make_chart", kind="count", x="k", source="x.csv")
    assert json.loads(open(c.artifacts[0]["path"]).read())["type"] == "chart"
