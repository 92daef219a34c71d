"""The catalogue of loaded sources: names, lookup, file references, and paths mentioned in a message."""
import functools
import os
import re
from dataclasses import dataclass, field

from . import readers


@dataclass
class Source:
    """A loaded source: text kinds have `files` (source, rel, text), data kinds have tables by sheet."""

    name: str
    kind: str
    path: str
    files: object = None
    sheets: dict = field(default_factory=dict)
    skipped: list = field(default_factory=list)
    projects: list = field(default_factory=list)

    @property
    def df(self):
        return next(iter(self.sheets.values()), None)

    def table(self, sheet=None):
        """A sheet by name without regard to case; the first one without a name. Choosing never changes the source."""
        if sheet is None:
            return self.df
        for n, d in self.sheets.items():
            if n.lower() == str(sheet).lower():
                return d
        raise KeyError(f"{self.name} has no sheet {sheet!r}; it has {', '.join(self.sheets)}")


@functools.lru_cache(maxsize=256)
def _cached_text(path, mtime, size):
    """(text, reason) of a file; read again only when its time or size has changed."""
    with open(path, "rb") as f:
        return readers.text_of(path, f.read())


class SourceRegistry:
    """Sources by unique name; a path that is loaded again replaces its source, and the last one loaded answers where no name is given."""

    def __init__(self, spark):
        self.spark, self.sources = spark, {}

    def load(self, path, hint=None, name=None, **options):
        path = path.rstrip("/") or "/"
        for n, s in self.sources.items():
            if s.path == path:
                name = n
                del self.sources[n]
                break
        base = name or path.rsplit("/", 1)[-1]
        if base in self.sources:
            k = 2
            while f"{base} ({k})" in self.sources:
                k += 1
            base = f"{base} ({k})"
        self.sources[base] = s = self._read(base, path, hint, options)
        if s.kind == "data":
            for n, d in s.sheets.items():
                d.createOrReplaceTempView(re.sub(r"\W+", "_", n if len(s.sheets) > 1 else base.rsplit(".", 1)[0]))
        return s

    def _read(self, name, path, hint, options):
        from pyspark.sql import functions as F

        is_file, rels, marks = readers.listing(self.spark, path)
        if is_file:
            if readers.is_table(path) or path.lower().endswith(".json") and hint == "data":
                return Source(name, "data", path, sheets=readers.read_table(self.spark, path, **options))
            rel = path.rsplit("/", 1)[-1]
            if "://" in path:
                text, why = readers.text_of(rel, bytes(self.spark.read.format("binaryFile").load(path).select("content").first()[0]))
            else:
                st = os.stat(path)
                text, why = _cached_text(path, st.st_mtime_ns, st.st_size)
            if why:
                raise readers.SourceError(f"{path}: {why}")
            kind = hint or ("repo" if readers.is_code(rel) else "docs")
            return Source(name, kind, path, self.spark.createDataFrame([(name, rel, text)], "source string, rel string, text string"))
        kind = readers.kind_of_folder(rels, hint)
        if kind == "data":
            found = [r for r in rels if readers.is_table(r)]
            if not found:
                raise readers.SourceError(f"{path} holds no tables")
            if len(found) > readers.MAX_TABLES:
                raise readers.SourceError(f"{path} holds {len(found)} tables; load one of them")
            tables = {}
            for r in found:
                for n, x in readers.read_table(self.spark, f"{path}/{r}", **options).items():
                    tables[n if n not in tables else f"{r}:{n}"] = x
            return Source(name, "data", path, sheets=tables)
        x = readers.read_folder(self.spark, path)
        skipped = [f"{r['rel']}: {r['skipped']}" for r in x.where("skipped is not null").select("rel", "skipped").orderBy("rel").collect()]
        files = x.where("text is not null").select(F.lit(name).alias("source"), "rel", "text")
        return Source(name, kind, path, files, skipped=skipped, projects=readers.projects(rels, marks))

    def add_table(self, name, df):
        """A table that is already a DataFrame as a source."""
        self.sources[name] = s = Source(name, "data", name, sheets={name: df})
        df.createOrReplaceTempView(re.sub(r"\W+", "_", name))
        return s

    def unload(self, name):
        return self.sources.pop(self.find(name).name)

    def of_kind(self, *kinds):
        return [s for s in self.sources.values() if s.kind in kinds]

    def find(self, name=None, kind=None):
        """Exact name, else the only one that fits without case, in part or by its path's end; without a name the last one loaded."""
        pool = [s for s in self.sources.values() if kind is None or s.kind == kind]
        if not pool:
            raise KeyError("nothing is loaded" if kind is None else f"no {kind} source is loaded")
        if name is None:
            return pool[-1]
        for s in pool:
            if s.name == name:
                return s
        low = name.lower()
        hits = [s for s in pool if s.name.lower() == low] or [s for s in pool if low in s.name.lower() or s.path.lower().endswith("/" + low)]
        if len(hits) == 1:
            return hits[0]
        raise KeyError(f"{'several sources answer' if hits else 'no source answers'} to {name!r}; loaded: {', '.join(s.name for s in pool)}")

    def corpus(self):
        """The files of all text sources."""
        out = None
        for s in self.of_kind("repo", "docs"):
            out = s.files if out is None else out.unionByName(s.files)
        return out

    def summary(self):
        return "\n".join(f"{s.name} ({s.kind}): {s.path}" for s in self.sources.values()) or "nothing is loaded"


_QUOTED = re.compile(r"[\"'`“‘(<\[]\s*((?:[A-Za-z][\w+.-]*://|/|~/|\./|[A-Za-z]:\\)[^\"'`”’)>\]\n]+?)\s*[\"'`”’)>\]]")
_BARE = re.compile(r"(?<![\w/])((?:[A-Za-z][\w+.-]*://|/|~/|\./)[^\s\"'`<>|]+)")
_FILE = re.compile(r"(?<![\w/.-])([\w.-]+\.(?:csv|tsv|xlsx|parquet|feather|pkl|json|md|txt|pdf|docx|ipynb|py|sql))(?![\w/])")
_LOAD = re.compile(r"(?i)\b(?:load|open|read|add|import|attach|use|load up|lade|öffne|ouvre|charge|abre|carga)\b")


def find_paths(text, exists=os.path.exists):
    """Paths of a message, in order: quoted ones, bare ones up to their longest existing prefix, then file names alone."""
    out, left = [], text
    for rx in (_QUOTED, _BARE):
        for m in rx.finditer(left):
            p = m[1].rstrip(".,;:!?)")
            if rx is _BARE:
                tail = text[text.find(p) :]
                words, best = tail.split(" "), None
                for k in range(1, min(len(words), 8) + 1):
                    c = " ".join(words[:k]).rstrip(".,;:!?)\n")
                    if exists(os.path.expanduser(c)):
                        best = c
                p = best or p
            if p not in out and not any(q.startswith(p) for q in out):
                out.append(p)
        left = rx.sub(" ", left)
    for m in _FILE.finditer(left):
        if m[1] not in out:
            out.append(m[1])
    return out


def is_load_command(text, exists=os.path.exists):
    """True for a message that only asks to load: paths with a loading verb or alone, at most two words left, and no question."""
    if "?" in text:
        return False
    rest = text
    paths = find_paths(text, exists)
    for p in paths:
        rest = rest.replace(p, " ")
    words = re.findall(r"[^\W\d_]+", _LOAD.sub(" ", rest))
    return bool(paths) and len([w for w in words if w.lower() not in ("the", "this", "file", "folder", "please", "from", "repo", "data", "docs", "and")]) <= 2


def kind_hint(text):
    """The kind a message names, or None."""
    for kind, rx in (("repo", r"\b(?:repo|repository|code|project)\b"), ("docs", r"\b(?:docs?|documents?|documentation|papers?)\b"), ("data", r"\b(?:data|dataset|table|spreadsheet)\b")):
        if re.search(rx, text, re.I):
            return kind
    return None
