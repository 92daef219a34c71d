"""Guarded ad-hoc queries: one SQL query over registered views, or one DataFrame expression, both by allow-lists."""
import ast
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

ROWS, CHARS, OUTPUT = 60, 8000, 24_000

#: Methods and attributes of frames, columns, groups and windows that an expression may use.
METHODS = frozenset(
    """select where filter withColumn withColumns withColumnRenamed drop dropna fillna replace distinct dropDuplicates orderBy sort limit offset groupBy agg count join crossJoin union unionByName unionAll intersect
    intersectAll exceptAll subtract pivot unpivot melt cube rollup groupingSets describe summary sample alias columns dtypes na fill avg mean sum min max median first last stat corr cov crosstab freqItems approxQuantile
    toDF transpose colRegex selectExpr_ over partitionBy rowsBetween rangeBetween unboundedPreceding unboundedFollowing currentRow cast try_cast astype asc desc asc_nulls_first asc_nulls_last desc_nulls_first desc_nulls_last between isin
    isNull isNotNull isNaN eqNullSafe like ilike rlike contains startswith endswith substr when otherwise getItem getField bitwiseAND bitwiseOR bitwiseXOR name isEmpty head take tail items keys values get lower upper strip""".split())
#: Functions that reach outside of the data are not among the functions of an expression.
BLOCKED_FUNCTIONS = frozenset("udf pandas_udf udtf arrow_udf arrow_udtf java_method reflect try_reflect call_function call_udf expr input_file_name input_file_block_start input_file_block_length broadcast raise_error assert_true current_user session_user user version".split())
BUILTINS = {"len": len, "min": min, "max": max, "sum": sum, "abs": abs, "round": round, "sorted": sorted, "list": list, "dict": dict, "set": set, "tuple": tuple, "str": str, "int": int, "float": float, "bool": bool, "range": range, "enumerate": enumerate, "zip": zip, "any": any, "all": all, "reversed": reversed}
_NODES = (
    ast.Expression, ast.Call, ast.Attribute, ast.Name, ast.Load, ast.Store, ast.Constant, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.Subscript, ast.Slice, ast.List, ast.Tuple, ast.Dict, ast.Set, ast.keyword, ast.IfExp,
    ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.comprehension, ast.Lambda, ast.arguments, ast.arg, ast.Starred, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)


class QueryError(ValueError):
    """The text is not an allowed query."""


def bare(text):
    m = re.match(r"\s*```(?:python|sql|py)?\s*\n([\s\S]*?)\n?```\s*$", text)
    return (m[1] if m else text).strip()


class _Functions:
    """The allowed functions, by attribute."""

    def __getattr__(self, name):
        if name.startswith("_") or name in BLOCKED_FUNCTIONS or not callable(getattr(F, name, None)):
            raise QueryError(f"F.{name} is not allowed")
        return getattr(F, name)


def check_expression(text):
    """The parsed expression; every node, name and attribute must be on a list."""
    try:
        tree = ast.parse(bare(text), mode="eval")
    except SyntaxError as x:
        raise QueryError(f"not one expression: {x.msg}") from None
    own = {n.arg for x in ast.walk(tree) if isinstance(x, ast.Lambda) for n in x.args.args}
    own |= {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    for n in ast.walk(tree):
        if not isinstance(n, _NODES):
            raise QueryError(f"{type(n).__name__} is not allowed")
        if isinstance(n, ast.Name) and n.id not in {"df", "dfs", "F", "Window", *BUILTINS, *own} or isinstance(n, ast.Name) and n.id.startswith("_"):
            raise QueryError(f"the name {n.id!r} is not allowed")
        if isinstance(n, ast.Attribute):
            on_f = isinstance(n.value, ast.Name) and n.value.id == "F"
            if n.attr.startswith("_") or not on_f and n.attr not in METHODS or on_f and n.attr in BLOCKED_FUNCTIONS:
                raise QueryError(f"the attribute {n.attr!r} is not allowed")
        if isinstance(n, ast.Lambda) and (n.args.kwonlyargs or n.args.vararg or n.args.kwarg or n.args.defaults):
            raise QueryError("lambdas take plain arguments only")
        if isinstance(n, ast.Constant) and isinstance(n.value, (bytes, complex)):
            raise QueryError("only plain constants are allowed")
    return tree


def evaluate(text, df=None, dfs=None):
    """The value of one expression over `df` and `dfs`. Frames are immutable, so loaded data cannot change."""
    tree = check_expression(text)
    return eval(compile(tree, "query", "eval"), {"__builtins__": {}, **BUILTINS, "df": df, "dfs": dict(dfs or {}), "F": _Functions(), "Window": Window})


_SQL_BLOCKED = re.compile(r"(?i)\b(?:java_method|reflect|try_reflect|input_file_name)\s*\(|\b(?:parquet|csv|json|orc|text|avro|delta|binaryfile|jdbc)\s*\.\s*`|\btransform\s*\(.*\busing\b")


def sql(spark, text):
    """One SQL query. Commands, functions that call out, and tables named by a file's path are refused; literals and comments do not count."""
    q = bare(text).rstrip(";").strip()
    plain = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*[\s\S]*?\*/", "''", q)
    if ";" in plain:
        raise QueryError("one query at a time")
    if _SQL_BLOCKED.search(plain):
        raise QueryError("the query calls something that is not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(q)
    except Exception as x:
        raise QueryError(str(x).split("\n")[0][:300]) from None
    first = re.match(r"\W*(\w+)", plain)
    if plan.getClass().getName().startswith("org.apache.spark.sql.execution.command") or "Command" in plan.getClass().getSimpleName() or not first or first[1].lower() not in ("select", "with", "values", "from", "table"):
        raise QueryError("only queries are allowed")
    return spark.sql(q)


def format_result(x):
    """A result as text: the first 60 rows of a table and how many more there are; other values cut at 8,000 characters."""
    if isinstance(x, DataFrame):
        rows = x.limit(ROWS + 1).toPandas()
        out = rows.head(ROWS).to_string(index=False)
        if len(rows) > ROWS:
            out += f"\n… ({x.count() - ROWS} more rows)"
        return out
    if isinstance(x, Column):
        raise QueryError("the expression is a column; select it from a table")
    return repr(x)[:CHARS]


def truncate(text, n=OUTPUT):
    return text if len(text) <= n else text[:n] + f"\n… ({len(text) - n} more characters)"
