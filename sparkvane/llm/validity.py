"""Source files that do not parse (problem 3): the first unrecoverable error per file, and rates per source and language."""
import ast
import io
import re
import sys
import tokenize
import tomllib
import warnings
import xml.parsers.expat

from pyspark.sql import functions as F

from .common import of_kind, per_text
from .secrets import repo_rows
from .syntax import chart, data, javascript, shell, sql, yaml

LANGUAGES = {
    ".py": "python", ".js": "javascript", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".xml": "xml", ".sql": "sql", ".sh": "shell"}


def _python(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except SyntaxError as x:
            raise chart.SyntaxIssue(x.msg or "invalid syntax", x.lineno or 1) from None
        except ValueError as x:
            raise chart.SyntaxIssue(str(x) or type(x).__name__, 1) from None
        except (RecursionError, MemoryError) as x:
            if isinstance(x, MemoryError) and "Parser stack" not in str(x):
                raise  # the worker is short of memory, which says nothing about the text
            _python_tokens(text)


def _python_tokens(text):
    """Texts nested deeper than the interpreter's parser goes are judged by their tokens and brackets."""
    opening, stack = {")": "(", "]": "[", "}": "{"}, []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.OP and t.string in "([{":
                stack.append(t.string)
            elif t.type == tokenize.OP and t.string in opening and (not stack or stack.pop() != opening[t.string]):
                raise chart.SyntaxIssue(f"unmatched {t.string!r}", t.start[0])
    except (tokenize.TokenError, SyntaxError) as x:
        raise chart.SyntaxIssue(str(x), 1) from None
    if stack:
        raise chart.SyntaxIssue(f"{stack[-1]!r} was never closed", text.count("\n") + 1)


def _confirmed(grammar, exact):
    """A check by a bundled grammar, followed by an exact reader: it clears what the grammar knows no form for, and adds what is no matter of
    form, such as a key given twice. The first error is the grammar's where both find one."""

    def check(text):
        issue = None
        try:
            grammar(text)
        except chart.SyntaxIssue as x:
            issue = x
        try:
            exact(text)
        except chart.SyntaxIssue as x:
            raise issue or x from None

    return check


def _toml(text):
    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError as x:
        m = re.search(r"line (\d+)", str(x))
        raise chart.SyntaxIssue(re.sub(r" \(at .*", "", str(x)), int(m[1]) if m else text.count("\n") + 1) from None
    except ValueError as x:
        raise chart.SyntaxIssue(str(x), 1) from None


def _xml(text):
    p = xml.parsers.expat.ParserCreate()
    try:
        p.Parse(re.sub(r"^(<\?xml[^>]*?)\s+encoding=[\"'][^\"']*[\"']", r"\1", text).encode("utf-8", "surrogatepass"), True)
    except xml.parsers.expat.ExpatError as x:
        raise chart.SyntaxIssue(xml.parsers.expat.ErrorString(x.code), x.lineno) from None


PARSERS = {
    "python": _python, "javascript": javascript.check, "json": data.json_text, "yaml": yaml.yaml, "toml": _confirmed(data.toml, _toml), "ini": data.ini, "xml": _confirmed(data.xml, _xml), "sql": sql.check, "shell": shell.check}


def language(rel):
    """The language a file's name claims, or None."""
    m = re.search(r"\.[A-Za-z]+$", rel or "")
    return LANGUAGES.get(m[0].lower()) if m else None


def first_error(text, lang):
    """(line, message) of the first unrecoverable error, or None for valid text. Null texts are not judged. A byte-order mark is skipped.

    An empty or blank text is valid where its language allows it: JSON and XML need a value."""
    if text is None:
        return None
    text = text.removeprefix("﻿")
    parse = PARSERS[lang]
    try:
        try:
            parse(text)
        except RecursionError:  # readers written in Python go as deep as memory allows
            old = sys.getrecursionlimit()
            sys.setrecursionlimit(max(old, 20 * len(text) + 1000))
            try:
                parse(text)
            finally:
                sys.setrecursionlimit(old)
    except chart.SyntaxIssue as x:
        return x.line, x.message
    return None


#: Recorded reasons that say the content is malformed, and those that only say it could not be read.
MALFORMED = r"(?i)\b(?:JSONDecodeError|NotJSONError|ParseError|ExpatError|XMLSyntaxError|SyntaxError|IndentationError|TabError|TOMLDecodeError|YAMLError|ScannerError|ParserError|TokenError|ParsingError|MissingSectionHeaderError|not well-formed|malformed|invalid (?:json|xml|syntax|yaml|toml)|does not appear to be (?:json|xml))\b"


def judged(files, sources):
    """(source, rel, language, valid, line, message, kind) of every read file of repo sources whose name claims a known language."""

    def rows(source, rel, text, kind):
        lang = language(rel)
        e = first_error(text, lang) if lang else None
        return [(source, rel, lang, e is None, e and e[0], e and e[1], kind)] if lang else []

    f = repo_rows(files).where(F.lower("rel").rlike(r"\.(py|js|json|ya?ml|toml|ini|cfg|xml|sql|sh)$"))
    return per_text(f, "source string, rel string, language string, valid boolean, line bigint, message string, kind string", rows, keys=("source", "rel"), extra=("text", "kind"))


def skipped(sources):
    """(source, rel, message) of skipped entries of repo sources whose recorded reason is malformed content. The reason begins at the last
    `: ` after which an error's name or sentence starts, so `rel` may hold blanks and colons; notes without a reason are left out."""
    e = sources.where("kind = 'repo' and name is not null").select(F.col("name").alias("source"), F.explode("skipped").alias("entry")).where("entry is not null")
    head = r"^(.+?): ((?:[A-Z]\w*(?:Error|Exception|Warning)\b|[A-Za-z]+(?: [\w-]+)* (?:json|xml|JSON|XML)\b).*)$"
    e = e.select("source", F.regexp_extract("entry", head, 1).alias("rel"), F.regexp_extract("entry", head, 2).alias("message"))
    return e.where((F.length("rel") > 0) & F.col("message").rlike(MALFORMED))


def found(files, sources):
    """(source, rel): files that are not valid in the language their name claims, and skipped ones with malformed content; once each."""
    bad = of_kind(judged(files, sources).where("not valid"), sources, "repo").select("source", "rel")
    return bad.unionByName(skipped(sources).select("source", "rel")).distinct()


def rates(files, sources):
    """(source, language, files, invalid, rate) of repo sources; repeated rows count once, skipped malformed files count by their ending."""
    one = of_kind(judged(files, sources), sources, "repo").select("source", "rel", "language", "valid").distinct()
    ext = F.lower(F.regexp_extract("rel", r"\.([A-Za-z]+)$", 1))
    lang = F.coalesce(F.create_map(*(F.lit(x) for k, v in LANGUAGES.items() for x in (k[1:], v)))[ext], F.when(ext == "ipynb", "json"), F.lit("other"))
    more = skipped(sources).select("source", "rel").distinct().withColumn("language", lang).withColumn("valid", F.lit(False))
    g = one.unionByName(more).groupBy("source", "language").agg(F.count("*").alias("files"), F.sum(F.when(F.col("valid"), 0).otherwise(1)).alias("invalid"))
    return g.withColumn("rate", F.col("invalid") / F.col("files"))
