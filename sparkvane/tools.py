"""The tools by name: JSON arguments in, text and artifacts out; every failure is an 'Error: …' text."""
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import battery, charts, citations, compare, quality, retrieval
from .plans import gate
from .sources.registry import SourceRegistry, find_paths, is_load_command, kind_hint
from .sources.sinks import save, table_artifact


@dataclass
class ToolResult:
    text: str
    artifacts: list = field(default_factory=list)
    shown: list = field(default_factory=list)  # (source, rel, start, end) lines that the text shows


class Engine:
    """A registry of sources and the tools over it."""

    NAMES = ("load_path", "unload_source", "search", "grep", "read_file", "overview", "list_files", "data_overview", "query_data", "make_chart", "run_data_quality", "list_tests", "run_tests", "compare")

    def __init__(self, spark, output_dir=None):
        """`output_dir`, one for a chat, takes what the tools make: a JSON file for each artifact."""
        self.spark, self.registry, self.output_dir = spark, SourceRegistry(spark), output_dir
        self.shown = []

    def new_turn(self):
        """Forget which lines were shown."""
        self.shown = []

    def evidence(self):
        """(source, rel, line) of the lines that tools have shown in this turn."""
        return retrieval.evidence(self.spark.createDataFrame(self.shown, "source string, rel string, start int, end int"))

    def check_answer(self, text, artifacts=()):
        """The report on an answer of this turn: citations with their status, unknown identifiers, uncited text, claims of charts."""
        a = self.spark.createDataFrame([(0, text, bool(self.shown), any(x.get("type") in ("chart", "image") for x in artifacts))], "answer_id int, text string, grounded boolean, has_visual boolean")
        files = self.registry.corpus()
        if files is None:
            files = self.spark.createDataFrame([], "source string, rel string, text string")
        cited = citations.extract(a)
        checked = citations.check(cited, files, self.evidence())
        columns = [c for s in self.registry.of_kind("data") for d in s.sheets.values() for c in d.columns]
        return {
            "citations": checked, "identifiers": citations.identifiers(a, checked, files, self.evidence(), allowed=columns + list(self.registry.sources)),
            "uncited": citations.uncited(a, cited), "visual_claims": citations.visual_claims(a)}

    def call(self, name, /, **args):
        """Run a tool; arguments that are None are dropped."""
        try:
            if name not in self.NAMES:
                raise KeyError(f"unknown tool {name!r}; one of {', '.join(self.NAMES)}")
            if isinstance(args.get("json"), str):
                args = json.loads(args["json"])
            out = getattr(self, name)(**{k: v for k, v in args.items() if v is not None})
            out = out if isinstance(out, ToolResult) else ToolResult(out)
            out.text = gate.truncate(out.text)
            self.shown += out.shown
            if self.output_dir:
                for a in out.artifacts:
                    a["path"] = save(self.output_dir, ".json", json.dumps(a, default=str))
            return out
        except Exception as x:  # the contract: an error is a text
            return ToolResult(f"Error: {x.args[0] if isinstance(x, KeyError) and x.args else x}")

    def message(self, text):
        """Load what a message names if it asks for nothing else; None otherwise."""
        if not is_load_command(text):
            return None
        return ToolResult("\n".join(self.call("load_path", path=p, kind=kind_hint(text)).text for p in find_paths(text)))

    def load_path(self, path, kind=None):
        s = self.registry.load(path, kind)
        if s.kind == "data":
            return f"Loaded {s.name} (data): " + "; ".join(f"{n}: {d.count()} rows × {len(d.columns)} columns" for n, d in s.sheets.items())
        return f"Loaded {s.name} ({s.kind}): {s.files.count()} files" + (f"; skipped {len(s.skipped)}" if s.skipped else "") + (f"; projects: {', '.join(s.projects)}" if s.projects else "")

    def unload_source(self, name):
        return f"Unloaded {self.registry.unload(name).name}"

    def _corpus(self, source=None):
        if source:
            s = self.registry.find(source)
            if s.files is None:
                raise KeyError(f"{s.name} holds tables, not text")
            return s.files
        c = self.registry.corpus()
        if c is None:
            raise KeyError("no text source is loaded")
        return c

    def _table(self, source=None, sheet=None):
        return self.registry.find(source, "data").table(sheet)

    @staticmethod
    def _lines(rows):
        return "\n".join(f"{r['line_no']}| {r['line']}" for r in rows)

    def search(self, query, source=None):
        c = self._corpus(source)
        hits = retrieval.search(c, query).collect()
        out, shown = [], []
        for h in hits:
            rows = retrieval.read_file(c, h["source"], h["rel"], h["start"] + 1, h["end"]).orderBy("line_no").collect()
            out.append(f"[{h['source']}/{h['rel']}:L{h['start'] + 1}-{h['end']}]\n{self._lines(rows)}")
            shown.append((h["source"], h["rel"], h["start"] + 1, h["end"]))
        return ToolResult("\n\n".join(out) or "No match.", shown=shown)

    def grep(self, pattern, regex=False, glob=None, source=None, context=2):
        c = self._corpus(source)
        hits = retrieval.grep(c, pattern, regex, glob=glob)
        rows = retrieval.grep_context(c, hits, context).orderBy("source", "rel", "line_no").collect()
        out, last = [], None
        for r in rows:
            if (r["source"], r["rel"]) != last:
                last = (r["source"], r["rel"])
                out.append(f"{r['source']}/{r['rel']}")
            out.append(f"{'>' if r['hit'] else ' '} {r['line_no']}| {r['line']}")
        return ToolResult("\n".join(out) or "No match.", shown=[(r["source"], r["rel"], r["line_no"], r["line_no"]) for r in rows])

    def read_file(self, path, start=1, end=None, source=None):
        from .operators.citations import resolve

        c = self._corpus(source)
        f = resolve(self.spark.createDataFrame([(path,)], "ref string"), c).first()
        if f is None:
            raise KeyError(f"no single file answers to {path!r}")
        rows = retrieval.read_file(c, f["source"], f["rel"], start, end).orderBy("line_no").collect()
        return ToolResult(f"{f['source']}/{f['rel']}\n{self._lines(rows)}", shown=[(f["source"], f["rel"], rows[0]["line_no"], rows[-1]["line_no"])] if rows else [])

    def overview(self, source=None):
        c = self._corpus(source)
        return gate.format_result(retrieval.overview(c).orderBy("source", "entry")) + "\n" + self._lines(retrieval.readme_head(c).orderBy("source", "rel", "line_no").limit(80).collect())

    def list_files(self, glob=None, source=None):
        return "\n".join(f"{r['source']}/{r['rel']} ({r['n_lines']} lines)" for r in retrieval.list_files(self._corpus(source), glob).collect())

    def data_overview(self, source=None, sheet=None):
        d = self._table(source, sheet)
        return f"{d.count()} rows × {len(d.columns)} columns\n" + gate.format_result(quality.overview(d)) + "\n" + gate.format_result(d.limit(5))

    def query_data(self, expression, source=None, sheet=None):
        s = self.registry.find(source, "data")
        dfs = {n: d for x in self.registry.of_kind("data") for n, d in x.sheets.items()}
        is_sql = gate.bare(expression).lower().startswith(("select", "with"))
        x = gate.sql(self.spark, expression) if is_sql else gate.evaluate(expression, s.table(sheet), dfs)
        return ToolResult(gate.format_result(x), [table_artifact(x)] if isinstance(x, DataFrame) else [])

    def make_chart(self, kind, x=None, y=None, agg=None, group=None, expression=None, source=None, sheet=None, title=None):
        d = self._table(source, sheet)
        if expression:
            d = charts.frame_from_result(gate.evaluate(expression, d, {}))
            x, y = x or d.columns[0], y or (d.columns[1] if len(d.columns) > 1 else None)
        c = charts.build(d, kind, x, y, agg, group, title=title)
        return ToolResult(f"{c.title}" + (f" ({'; '.join(c.notes)})" if c.notes else ""), [{"type": "chart", "spec": json.loads(c.to_json()), **{k: v for k, v in table_artifact(c.data).items() if k != "type"}}])

    def run_data_quality(self, source=None, sheet=None):
        d = self._table(source, sheet)
        tables = {"missing values": quality.missing(d), "descriptive statistics": quality.describe(d), "outliers": quality.outliers_iqr(d), "column validity": quality.column_validity(d), "validity checks": quality.validity_summary(d)}
        return ToolResult(quality.summary_line(d) + "\n" + "\n".join(f"{n}\n{gate.format_result(x)}" for n, x in tables.items()), [table_artifact(x) for x in tables.values()])

    def list_tests(self, model_type=None):
        return gate.format_result(battery.dictionary(self.spark, model_type))

    def run_tests(self, model_type, observed, predicted, split=None, tests=None, options=None, source=None, sheet=None, folder=None):
        if model_type == "vision":
            return battery.summary_text(battery.run_vision(self.spark, folder, tests, options)) or "No images."
        return battery.summary_text(battery.run(self._table(source, sheet), model_type, observed, predicted, split, tests, options=options))

    @staticmethod
    def _diff(a, b):
        ratio, blocks = compare.text_blocks(a, b)
        return f"line similarity: {ratio:.1%}\n" + ("\n".join(f"@@ {t}: A L{a1}-{a2} -> B L{b1}-{b2}\n" + "\n".join(body) for t, a1, a2, b1, b2, body in blocks) or "The two files are identical.")

    @staticmethod
    def _diff_shown(source_a, rel_a, source_b, rel_b, a, b):
        out = []
        for _, a1, a2, b1, b2, _ in compare.text_blocks(a, b)[1]:
            out += [(source_a, rel_a, a1, a2)] * (a2 >= a1) + [(source_b, rel_b, b1, b2)] * (b2 >= b1)
        return out

    def _compare_tables(self, a, b):
        out = [gate.format_result(compare.schema_diff(a, b)), gate.format_result(compare.column_stats(a, b))]
        kinds = dict(a.dtypes), dict(b.dtypes)
        words = [c for c in a.columns if c in b.columns and kinds[0][c] == kinds[1][c] == "string"]
        out += [gate.format_result(compare.category_diff(a, b, c)) for c in words]
        if a.columns == b.columns:  # rows in the order in which the files are read
            x, y = (d.withColumn("_read", F.monotonically_increasing_id()) for d in (a, b))
            cells = compare.aligned_cell_diff(x, y, ["_read"]).where("column <> '_read'").collect()
            if cells:
                out.append(f"row-aligned cell differences: {sum(r['changed'] for r in cells)}; by column: " + ", ".join(f"{r['column']} {r['changed']}" for r in cells if r["changed"]))
        return "\n".join(out)

    def compare(self, a, b, file_a=None, file_b=None):
        x, y = self.registry.find(a), self.registry.find(b)
        if (x.kind == "data") != (y.kind == "data"):
            raise ValueError("a table cannot be compared with text")
        if x.kind == "data":
            return self._compare_tables(x.df, y.df)
        if file_a and file_b:
            ta, tb = (s.files.where(F.col("rel") == r).select("text").first() for s, r in ((x, file_a), (y, file_b)))
            if ta is None or tb is None:
                raise KeyError("no such file")
            return ToolResult(self._diff(ta[0], tb[0]), shown=self._diff_shown(x.name, file_a, y.name, file_b, ta[0], tb[0]))
        if file_a:
            ta = x.files.where(F.col("rel") == file_a).select("text").first()
            if ta is None:
                raise KeyError(f"no file {file_a!r}")
            near = compare.file_to_corpus(ta[0], y.files, own=(x.name, file_a)).collect()
            if not near:
                return f"{y.name} has no text files to compare against."
            text = gate.format_result(self.spark.createDataFrame(near))
            if near[0]["lines"] < compare.NEAR_COPY:
                return f"{text}\nNo near copy: a line diff would say nothing."
            other = y.files.where(F.col("rel") == near[0]["rel"]).select("text").first()[0]
            return ToolResult(f"{text}\nclosest: {near[0]['rel']}\n{self._diff(ta[0], other)}", shown=self._diff_shown(x.name, file_a, y.name, near[0]["rel"], ta[0], other))
        return gate.format_result(compare.tree_diff(x.files, y.files).orderBy("status", "similarity", "rel"))
