"""Source files not written by hand in their project (problem 5): generated, minified, third-party, or data written as code."""
import re
from typing import NamedTuple

from pyspark.sql import functions as F

from .common import of_kind, per_text
from .secrets import repo_rows

CODE = (".py", ".js", ".sql", ".sh")

#: Folders that hold copies of others' code.
FOREIGN = frozenset(
    "vendor vendored vendors _vendor _vendored third_party third-party thirdparty 3rdparty 3rd_party 3rd-party external externals extern deps node_modules bower_components "
    "site-packages dist-packages bundled oss-mirror jspm_packages pods gems".split())
FOREIGN_NAME = re.compile(r"(?i)(?:\.min\.|[.-]bundle\.|[.-]min\.|\.packed\.)(?:js|css|mjs)$|^(?:jquery|bootstrap|angular|react|vue|lodash|d3|moment)(?:[.-]\d[\d.]*)?(?:\.min|\.slim)*\.js$")

#: Statements of a tool in a file's header.
GENERATED = re.compile(
    r"""(?xi)\bcode\s+generated\s+(?:by|from|with)|\bauto-?\s?generated\b|@generated\b|<auto-?generated|\b(?:automatically|machine|programmatically)[\s-]+(?:generated|written|created|produced|made)\b
    |\bmachine\s+written\s+by|\bgenerated\s+(?:by|from|with|on|using|automatically|file|code)\b|\b(?:do\s+not|don['’]t)\s+(?:edit|modify|change)\b|\b(?:edits|changes)\s+(?:are|will\s+be)\s+(?:over\w+|lost)
    |g[ée]n[ée]r[ée]e?s?\s+(?:automatiquement|par)|ne\s+pas\s+(?:modifier|éditer)|\bwird\s+von\s+\S+\s+(?:erzeugt|generiert|erstellt)|automatisch\s+(?:erzeugt|generiert|erstellt)|nicht\s+(?:von\s+hand|manuell)\s+(?:ändern|bearbeiten)
    |generad[oa]\s+(?:autom[áa]ticamente|por)|no\s+(?:editar|modificar)\b|gerad[oa]\s+(?:automaticamente|por)|n[ãa]o\s+(?:editar|edite|modificar)|wygenerowan\w+|nie\s+(?:edytuj|edytować|modyfikować|zmieniać)
    |сгенерирован\w*|создан\w*\s+автоматически|не\s+(?:редактир\w+|изменя\w+|править)""")
BY_HAND = re.compile(r"(?i)\b(?:not|never|isn['’]t|nicht|pas|no)\s+(?:auto\w*[\s-]+|machine[\s-]+)?(?:generated|generiert|erzeugt|généré|generado)|\b(?:hand[\s-]?(?:written|made|kept)|written\s+by\s+hand)\b")
#: Statements in a docstring, where prose may speak of what a program generates: only those that are about the file.
GENERATED_FILE = re.compile(r"(?i)\bcode\s+generated\s+(?:by|from|with)|@generated\b|\bthis\s+(?:file|module)\s+(?:is|was|has\s+been)\s+(?:auto\w*[\s-]*|machine[\s-]+)?generated|\b(?:do\s+not|don['’]t)\s+(?:edit|modify)\s+(?:this\s+file|by\s+hand|manually|directly)")
#: Names that tools give to what they write.
GENERATED_NAME = re.compile(r"_pb2(?:_grpc)?\.pyi?$|^(?:parsetab|lextab|yacctab)\.py$")
#: Statements of another owner in a file's header.
FOREIGN_STATEMENT = re.compile(
    r"(?i)\bupstream\s*[:=]|\bcopyright\b.{0,40}\b(?:the\s+[\w .&-]+\s+(?:authors|contributors|developers|project|foundation)|[\w .&-]+\s+(?:authors|contributors|foundation))\b"
    r"|\b(?:vendored|bundled|copied)\s+(?:copy\s+)?(?:from|of)\s+\S+|\bthird[\s-]party\s+(?:copy|code|library)\s+(?:of|from)|\bthis\s+file\s+is\s+part\s+of\s+(?!this)")
#: Code that only tools write.
TABLES = re.compile(r"(?m)^_lr_(?:signature|action)|^_tabversion\s*=|AddSerializedFile\(|_descriptor_pool\.Default\(\)|^# source: \S+\.proto|__webpack_require__|^//# sourceMappingURL=|^System\.register\(|^webpackJsonp")

_COMMENT = {
    ".py": r"#[^\n]*", ".sh": r"(?:(?<=\s)|^)#[^\n]*", ".sql": r"--[^\n]*|/\*.*?\*/", ".js": r"//[^\n]*|/\*.*?\*/"}
_STRING = r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
_SCAN = {e: re.compile(rf"(?ms)(?P<s>{_STRING})|(?P<c>{c})") for e, c in _COMMENT.items()}
_LITERAL = re.compile(r"(?<![\w.])[-+]?(?:\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?|0x[0-9a-fA-F]+)\b|\b(?:NULL|None|null|true|false|True|False)\b")


_NOT_ALNUM = re.compile(r"[\W_]+")

#: A line of literals and signs only; possessive, so that a long line is read once.
_DATA_LINE = re.compile(
    r"(?i)\s*+(?:insert\s+into\s+[\w.\"`]+\s*(?:\([^()]*\))?\s*values\s*)?(?:[\s,;:()\[\]{}=>]|[-+]?[\d.][\w.+/=-]*+|-|\"(?:\\.|[^\"\\])*+\"|'(?:\\.|[^'\\])*+'|(?:null|none|true|false)\b|[A-Za-z0-9+/]{40,}+={0,2})++")


def header(text, ext):
    """The comment lines before the first code, with what belongs there: interpreter line, encoding, markers of a conflict, 'use strict'."""
    out, inside = [], False
    for line in text.split("\n"):
        s = line.strip()
        if inside:
            out.append(s)
            inside = "*/" not in s
            continue
        if not s or re.match(r"(?:<{7}|={7}|>{7}|\|{7})(?:\s|$)", s) or re.match(r"[\"']use strict[\"'];?$", s):
            continue
        if ext in (".js", ".sql") and s.startswith("/*"):
            out.append(s)
            inside = "*/" not in s[2:]
        elif s.startswith({".py": "#", ".sh": "#", ".js": "//", ".sql": "--"}[ext]):
            out.append(s)
        else:
            break
    return "\n".join(out)


_DOCSTRING = re.compile(r"(?:[ \t]*+(?:#[^\n]*)?+\n)*+[ \t]*+[rRuU]?(\"\"\"|''')")


def docstring(text):
    """The docstring of a Python file, if it begins with one after its comments."""
    m = _DOCSTRING.match(text)
    end = text.find(m[1], m.end()) if m else -1
    return text[m.end() : end] if end >= 0 else ""


def layout(text, ext):
    """Statistics of a file's layout without its comments and prose: longest and mean code line, white-space and alphanumeric share, share
    and volume of literals, density of numbers, long encoded runs, share of lines that only hold literals."""
    prose, lits = [], []

    def strip(m):
        if m["c"] is not None:
            return ""
        s = m["s"]
        body = s.strip("\"'`")
        if len(re.findall(r"[^\W\d_]{2,}\s", body)) >= 4:
            prose.append(len(s))
            return '""'
        return s

    code = _SCAN[ext].sub(strip, text)
    lines = [x for x in code.split("\n") if x.strip()]
    solid = len(re.sub(r"\s", "", code)) or 1
    for m in re.finditer(_STRING, code, re.S):
        lits.append(len(re.sub(r"\s", "", m[0])))
    bare = re.sub(_STRING, " ", code, flags=re.S)
    numbers = [len(m[0]) for m in _LITERAL.finditer(bare)]
    lits += numbers
    marks = len(re.findall(r"[,;:()\[\]{}]", bare))
    runs = sum(len(m) for m in re.findall(r"[A-Za-z0-9+/]{60,}={0,2}|(?:\\x[0-9a-fA-F]{2}){20,}", code))
    data = [x for x in lines if _DATA_LINE.fullmatch(x) and re.search(r"[\w\"']", x)]
    return {
        "longest": max(map(len, lines), default=0), "mean": sum(map(len, lines)) / max(1, len(lines)), "lines": len(lines), "solid": solid,
        "blank_share": 1 - len(re.sub(r"\s", "", code)) / max(1, len(code)), "literals": len(lits), "literal_share": (sum(lits) + min(marks, len(lits) * 2)) / solid,
        "numbers": len(numbers), "number_share": sum(numbers) / solid, "alnum_share": len(_NOT_ALNUM.sub("", code)) / solid,
        "runs": runs, "data_lines": len(data), "data_share": sum(map(len, data)) / max(1, sum(map(len, lines))), "data_chars": sum(map(len, data))}


class Limits(NamedTuple):
    """Thresholds of a language. Minified: the longest line, or the mean line of a file of some size, with so little white space. Data: so many
    lines or characters of literals, shares of literals, of numbers in solid text, and of letters and digits in it."""

    longest: int
    mean: int
    blank: float
    lines: int
    chars: int
    literal: float
    number: float
    alnum: float


LIMITS = {
    ".js": Limits(250, 90, 0.10, 40, 1200, 0.70, 0.50, 0.93), ".py": Limits(500, 110, 0.06, 40, 1200, 0.70, 0.50, 0.93),
    ".sql": Limits(1500, 400, 0.06, 40, 1200, 0.75, 0.55, 0.95), ".sh": Limits(800, 140, 0.05, 40, 1200, 0.75, 0.50, 0.95)}
#: Solid characters from which a mean line counts, and numbers from which their density does.
MEAN_FROM, NUMBERS_FROM = 300, 60


def kinds(rel, text, path=None):
    """All reasons why a file is not hand-written: generated, minified, third-party, data. Null and empty texts give none."""
    ext = next((e for e in CODE if rel and rel.lower().endswith(e)), None)
    if ext is None or not text or not text.strip():
        return []
    out = []
    parts = rel.lower().split("/")
    head = header(text, ext)
    places = [*parts[:-1], *((path or "").lower().split("/"))]
    if any(p in FOREIGN for p in places) or FOREIGN_NAME.search(parts[-1]) or FOREIGN_STATEMENT.search(head):
        out.append("third-party")
    said = [line for line in head.split("\n") if GENERATED.search(line) and not BY_HAND.search(line)]
    if ext == ".py" and not said:
        said = [line for line in docstring(text).split("\n") if GENERATED_FILE.search(line) and not BY_HAND.search(line)]
    if said or TABLES.search(text) or GENERATED_NAME.search(parts[-1]):
        out.append("generated")
    x, at = layout(text, ext), LIMITS[ext]
    long = x["longest"] > at.longest or x["mean"] > at.mean and x["solid"] >= MEAN_FROM
    if long and x["blank_share"] < at.blank and x["literal_share"] < 0.6:
        out.append("minified")
    much = x["solid"] >= at.chars
    rows = x["data_lines"] >= at.lines and x["data_share"] >= 0.8 and x["data_chars"] >= at.chars
    runs = x["runs"] >= at.chars and (x["runs"] >= 0.6 * x["solid"] or x["alnum_share"] >= at.alnum)
    packed = much and x["literals"] >= 100 and x["literal_share"] >= at.literal
    dense = much and x["numbers"] >= NUMBERS_FROM and x["number_share"] >= at.number
    if rows or runs or packed or dense:
        out.append("data")
    return out


def flagged(files, sources):
    """(source, rel, kind): every reason for every code file of repo sources; repeated rows count once.

    A source whose own place is foreign is third-party as a whole. Each text is read once; what joins the sources are slim rows,
    one for a code file that is not blank, with its reasons."""
    f = repo_rows(files).where(F.lower("rel").rlike(r"\.(py|js|sql|sh)$"))

    def rows(source, rel, text, kind):
        return [(source, rel, kinds(rel, text), kind)] if text and text.strip() else []

    own = per_text(f, "source string, rel string, reasons array<string>, kind string", rows, keys=("source", "rel"), extra=("text", "kind"))
    parts = F.split(F.lower("path"), "/")
    foreign = sources.where(F.arrays_overlap(parts, F.array(*(F.lit(x) for x in sorted(FOREIGN))))).select(F.col("name").alias("source")).distinct().withColumn("_foreign", F.lit(True))
    every = of_kind(own, sources, "repo").join(foreign, "source", "left")
    reasons = F.when(F.col("_foreign"), F.array_union("reasons", F.array(F.lit("third-party")))).otherwise(F.col("reasons"))
    return every.select("source", "rel", F.explode(reasons).alias("reason")).distinct()


def found(files, sources):
    """(source, rel) of the files that are not hand-written source."""
    return flagged(files, sources).select("source", "rel").distinct()
