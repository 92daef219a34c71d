"""Grammar of SQL statements, wide enough for the common dialects."""
import re

from .chart import Grammar, SyntaxIssue, Token, token

_TOKEN = re.compile(
    r"""(?sx)(?P<ws>[\s﻿]+|--[^\n]*|\#(?!>)[^\n]*(?=\n|$)|/\*.*?\*/)|(?P<STRING>(?:[NnEeBbXxRr]|[Uu]&)?'(?:[^'\\]|''|\\.)*')|(?P<dollar>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)
    |(?P<QUOTED>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[A-Za-z_][\w \-.]*\])|(?P<NUMBER>(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<PARAM>:[A-Za-z_]\w*|@@?[A-Za-z_]\w*|\$\d+|%\(\w+\)s|%s|\?(?![&|-])|\$\{[^{}\n]*\}|\{\{[^{}\n]*\}\}|\{%[^\n]*?%\})
    |(?P<NAME>[^\W\d][\w$\#]*)|(?P<OP>::|:=|->>|->|\#>>|\#>|<=>|<>|!=|<=|>=|==|\|\||!~\*|!~|~\*|=>|<@|@>|&&|\?\||\?&|[-+*/%=<>(),.;:\[\]{}|&^~!@?])""")
_RESERVED = frozenset(
    "select from where group having order limit union intersect except join on using inner left right full cross natural values set into case when then else end and or not in is between like ilike as by "
    "insert update delete create drop alter with returning window fetch offset for qualify lateral distinct all any exists cast interval desc asc".split())
#: Kinds of objects that are created, altered and dropped.
_OBJECT = frozenset(
    "table view index schema database catalog role user group function procedure aggregate sequence trigger type domain extension policy rule server operator cast collation language tablespace publication subscription "
    "statistics event partition package synonym macro secret warehouse stage pipe stream task share integration login certificate column constraint foreign materialized external temporary temp session system default "
    "unique or replace concurrently fulltext spatial bitmap clustered nonclustered columnstore body public privileges data wrapper mapping access method file format masking row network resource tag profile online offline virtual".split())
#: A statement cannot end with these.
_DANGLING = (
    "= , . + - * / < > <= >= <> != || := => :: set to as on with from where and or not by in then when using add column values into if between like join inner left right full cross having group select update insert "
    "else case is references check constraint rename returns identified table only owner begin")
_COMPARE = "= == <> != < > <= >= <=> ~ ~* !~ !~* @> <@ && ?| ?& :="
_BINARY = "+ - * / % || | & ^ << >> -> ->> #> #>> div mod"
_CALLS = "left right replace insert set values if any all exists cast window like in interval"
_TYPES = "precision varying with without time zone local unsigned signed"
_UNITS = "year years month months day days hour hours minute minutes second seconds week weeks quarter quarters millisecond milliseconds microsecond microseconds"
_OPERATORS = frozenset(f"( ) ; [ ] {{ }} from {_COMPARE} {_BINARY} {_CALLS} {_TYPES} {_UNITS}".split())
_CONFLICT = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?:[ \t\r].*)?$")


def tokens(text):
    out, i, line = [], 0, 1
    while i < len(text):
        if text[i] in "<=>|" and (not i or text[i - 1] == "\n") and _CONFLICT.match(text, i):
            raise SyntaxIssue("conflict marker", line)
        m = _TOKEN.match(text, i)
        if not m:
            c = text[i]
            raise SyntaxIssue("unterminated string" if c in "'\"`" else f"unexpected {c!r}", line)
        kind, s = m.lastgroup, m[0]
        i = m.end()
        if kind == "ws":
            line += s.count("\n")
            continue
        if kind == "OP":
            if s == "/" and text.startswith("/*", i - 1):
                raise SyntaxIssue("unterminated comment", line)
        elif kind == "NUMBER":
            if i < len(text) and (text[i].isalpha() or text[i] == "_"):
                raise SyntaxIssue(f"bad number {s!r}", line)
        elif kind in ("dollar", "tag"):
            kind = "STRING"
        out.append(token((kind, s, line, False)))
        if kind in ("STRING", "QUOTED", "PARAM"):
            line += s.count("\n")
    out.append(Token("END", "", line, False))
    return out


def _ident(t, i):
    return i + 1 if t[i].kind == "QUOTED" or t[i].kind == "PARAM" or t[i].kind == "NAME" and t[i].text.lower() not in _RESERVED else -1


def _word(t, i):
    return i + 1 if t[i].kind == "NAME" else -1


def _any(t, i):
    return i + 1 if t[i].kind != "END" and t[i].text not in ("(", ")", ";", "[", "]", "{", "}") else -1


def _object(t, i):
    return i + 1 if t[i].kind == "NAME" and t[i].text.lower() in _OBJECT else -1


def _op(names):
    s = frozenset(names.split())
    return lambda t, i: i + 1 if t[i].kind in ("OP", "NAME") and t[i].text.lower() in s else -1


GRAMMAR = Grammar(
    r"""
script = piece*
piece = ';' / statement &(';' / END)
statement = with? (query / insert / update / delete / merge) / create / alter / drop / explain / grant / setting / transaction / block / data / command
rest = (!(DANGLING (';' / END)) any)*
more = &any !(DANGLING (';' / END)) any rest
merge = 'merge' 'into'? name alias? 'using' table 'on' expr when+ returning?
when = 'when' 'not'? 'matched' ('by' ('target' / 'source'))? ('and' expr)? 'then' ('update' 'set' ('*' / sets) ('where' expr)? ('delete' 'where' expr)? / 'delete' / 'do' 'nothing' / 'insert' ('*' / columnlist? (values / 'default' 'values' / 'row')) ('where' expr)?)
alter = 'alter' ('table' ('if' 'exists')? 'only'? name '*'? action (',' action)* / !'table' OBJECT+ ('if' 'exists')? (name args?)? more)
action = 'add' 'column'? ('if' 'not' 'exists')? ('(' defs ')' / 'constraint' IDENT WORD more / ('primary' 'key' / 'foreign' 'key' / 'unique' / 'check' / 'index' / 'key' / 'partition' / 'fulltext') more / !'column' name type constraint* place?) / 'drop' ('constraint' / 'column' / 'index' / 'primary' 'key' / 'foreign' 'key' / 'partition' / 'not' 'null')? ('if' 'exists')? (name / '(' any* ')')? ('cascade' / 'restrict')? / 'rename' ('column' / 'constraint' / 'index')? (('to' / 'as') name / name 'to' name) / ('alter' / 'modify') 'column'? name change / 'change' 'column'? name name type constraint* place? / ('set' / 'owner' / 'enable' / 'disable' / 'attach' / 'detach' / 'inherit' / 'no' / 'validate' / 'cluster' / 'replica' / 'exchange' / 'switch' / 'convert' / 'force' / 'recover' / 'reset' / 'unset' / 'swap' / 'engine' / 'replace' / 'with' / 'auto_increment' / 'comment' / 'row' / 'order' / 'truncate' / 'merge' / 'split' / 'move') more
change = 'set' 'default' expr / 'drop' ('default' / 'not' 'null' / 'identity' / 'expression') ('if' 'exists')? / 'set' 'not' 'null' / ('set' 'data')? 'type' type ('collate' name)? ('using' expr)? / ('set' / 'reset' / 'add' / 'comment' / 'restart') more / type constraint* place?
place = 'first' / 'after' name
drop = ('drop' / 'undrop') OBJECT+ ('if' 'exists')? name args? (',' name args?)* ('on' name)? rest
explain = 'explain' ('analyze' / 'verbose' / 'extended' / 'formatted' / 'codegen' / 'cost' / 'logical' / 'ast' / 'query'? 'plan' 'for'? / '(' any* ')' / 'format' '=' WORD)* statement / ('describe' / 'desc') ('table' / 'extended' / 'formatted' / 'schema' / 'database' / 'function' / 'view' / 'query')* (statement / name rest)
grant = ('grant' / 'deny') (!('to' / ';') any)+ 'to' any rest / 'revoke' (!('from' / ';') any)+ 'from' any rest
setting = 'set' ('session' / 'local' / 'global' / 'persist')? (('transaction' / 'names' / 'role' / 'password' / 'constraints' / 'schema' / 'authorization' / 'characteristics' / 'time' 'zone' / 'character' 'set' / 'catalog') more / assign (',' assign)* / IDENT name? ('on' / 'off') / IDENT '.' name) / ('reset' / 'unset') name
assign = name ('=' / ':=' / 'to') ('default' / 'on' / 'off' / expr) (',' expr !'=')*
transaction = ('start' 'transaction' / 'begin' ('transaction' / 'tran' / 'work' / 'immediate' / 'deferred' / 'exclusive')) rest / ('commit' / 'rollback' / 'abort') ('transaction' / 'tran' / 'work' / 'prepared')? ('to' 'savepoint'? IDENT / 'and' 'no'? 'chain' / IDENT / STRING)? / ('savepoint' / 'release' 'savepoint'? / 'save' ('transaction' / 'tran')) IDENT / ('lock' / 'unlock') ('table' / 'tables') rest / 'checkpoint'
block = 'begin' ('try' / 'catch' / 'not'? 'atomic')? statement? / 'end' ('if' / 'loop' / 'while' / 'case' / 'try' / 'catch' / 'transaction' / 'work' / 'repeat' / 'for')? IDENT? / 'if' expr 'then'? statement / ('elseif' / 'elsif') expr 'then' statement / 'else' statement? / 'while' expr ('do' / 'loop')? statement / 'loop' statement / 'do' (STRING / 'language' IDENT STRING) ('language' IDENT)? / 'return' expr? / 'print' expr / ('raise' ('notice' / 'exception' / 'info' / 'warning' / 'log' / 'debug')? / 'signal' 'sqlstate') STRING rest / 'declare' (PARAM / IDENT) more / 'go' NUMBER? / ('leave' / 'iterate') IDENT / ('open' / 'close') IDENT / 'fetch' (!'into' any)+ 'into' more / 'deallocate' 'prepare'? name
data = 'truncate' 'table'? ('if' 'exists')? 'only'? name (',' name)* rest / 'comment' ('if' 'exists')? 'on' OBJECT+ (!'is' any)+ 'is' (STRING+ / 'null') / 'copy' 'into'? (name columnlist? / '(' any* ')' / STRING / PARAM any*) ('from' / 'to') more / 'load' ('data' / 'xml') more / 'unload' '(' any* ')' 'to' more / 'export' ('data' / 'database' / 'table') more / 'import' ('foreign' 'schema' / 'database' / 'table') more / 'attach' 'database'? (STRING / name) rest / 'detach' 'database'? ('if' 'exists')? name
command = 'call' name args? / ('exec' / 'execute') 'immediate'? (name / '(' exprs ')' / STRING) rest / 'prepare' name ('(' any* ')')? ('as' statement / 'from' more) / 'show' WORD rest / 'use' ('database' / 'schema' / 'warehouse' / 'role' / 'catalog')? name / 'pragma' name ('=' ('on' / 'off' / expr) / '(' any* ')')? / ('analyze' / 'vacuum' / 'reindex' / 'cluster') ('(' any* ')')? rest / ('optimize' / 'refresh' / 'repair' / 'cache' / 'uncache' / 'msck' / 'discard' / 'purge' / 'flush' / 'listen' / 'unlisten' / 'notify' / 'install' / 'load') (WORD / STRING) rest / 'kill' (NUMBER / WORD) rest / 'delimiter' any* / ('put' / 'get') (STRING / PARAM) more / ('list' / 'remove') PARAM rest / 'shutdown'
any = ANY / '(' any* ')' / '[' any* ']' / '{' any* '}'
with = 'with' 'recursive'? cte (',' cte)*
cte = IDENT columns? 'as' ('not'? 'materialized')? '(' (with? (query / insert / update / delete)) ')'
columns = '(' IDENT (',' IDENT)* ')'
query = term (('union' / 'intersect' / 'except' / 'minus') ('all' / 'distinct' / 'by' 'name')* term)* order? tail*
term = select / '(' with? query ')' / values / 'table' name / 'from' source select?
values = 'values' row (',' row)*
row = '(' (expr (',' expr)*)? ')' / expr
select = 'select' ('top' (NUMBER / '(' expr ')') 'percent'?)? ('distinct' ('on' '(' exprs ')')? / 'all')? items ('into' name)? (FROM from)? ('where' expr)? ('group' 'by' group)? ('having' expr)? ('window' windowdef (',' windowdef)*)? ('qualify' expr)?
items = item (',' item)*
item = name '.' '*' star? / '*' star? / expr ('as' (IDENT / STRING) / IDENT / STRING)?
star = ('except' / 'exclude' / 'replace') '(' any* ')'
from = source (',' source)*
source = table join*
join = 'natural'? ('inner' / ('left' / 'right' / 'full') ('outer' / 'semi' / 'anti')? / 'cross' / 'asof' / 'semi' / 'anti' / 'positional')? 'join' table ('on' expr / 'using' columns)? / 'lateral' 'view' 'outer'? expr IDENT? ('as' IDENT (',' IDENT)*)? / ('cross' / 'outer') 'apply' table
table = 'lateral'? ('(' with? query ')' / '(' source ')' / values / name args? / STRING) sample? pivot? alias?
sample = 'tablesample' any+
pivot = ('pivot' / 'unpivot') '(' any+ ')'
alias = ('as' (IDENT / STRING) / IDENT) ('(' any* ')')? / 'as' '(' any* ')'
args = '(' (arg (',' arg)*)? ')'
arg = IDENT ('=>' / ':=') expr / expr
group = 'all' / grouping (',' grouping)* ('with' ('rollup' / 'cube'))?
grouping = ('rollup' / 'cube') '(' any* ')' / 'grouping' 'sets' '(' any* ')' / '(' ')' / expr
windowdef = IDENT 'as' '(' over ')'
order = 'order' 'by' sort (',' sort)*
sort = expr ('asc' / 'desc')? ('nulls' ('first' / 'last'))? ('collate' IDENT)?
tail = 'limit' (expr (',' expr)? / 'all') / 'offset' expr ('rows' / 'row')? / 'fetch' ('first' / 'next') expr? ('rows' / 'row') ('only' / 'with' 'ties') / 'for' ('update' / 'share') any* / ('cluster' / 'distribute' / 'sort') 'by' sort (',' sort)* / 'option' '(' any* ')'
insert = ('insert' ('or' WORD / 'ignore' / 'overwrite' / 'into')* 'table'? / 'replace' 'into') name ('partition' '(' any* ')')? ('as' IDENT)? columnlist? ('overriding' WORD 'value')? (with? query / 'default' 'values' / 'set' sets) conflict? returning?
columnlist = '(' name (',' name)* ')'
conflict = 'on' ('conflict' / 'duplicate') any*
returning = 'returning' items
update = 'update' ('only')? name alias? join* 'set' sets ('from' from)? ('where' expr)? order? tail* returning?
sets = set (',' set)*
set = (name / '(' name (',' name)* ')') ('=' / ':=' / '+=') ('default' / expr)
delete = 'delete' 'from'? name alias? ('using' from)? ('where' expr)? order? tail* returning?
create = 'create' ('or' ('replace' / 'alter') / 'temp' / 'temporary' / 'unlogged' / 'external' / 'global' / 'local' / 'unique' / 'materialized' / 'recursive' / 'clustered' / 'nonclustered' / 'secure' / 'transient' / 'volatile')* (createtable / createview / createindex / !('table' / 'view' / 'index' / 'fulltext' / 'spatial' / 'bitmap' / 'columnstore') OBJECT+ ('if' 'not' 'exists')? name rest)
createindex = 'columnstore' 'index' IDENT 'on' name rest / ('fulltext' / 'spatial' / 'bitmap')? 'index' 'concurrently'? ('if' 'not' 'exists')? (!'on' name)? ('using' WORD)? 'on' ('only' / 'table')? name ('using' WORD)? '(' any+ ')' rest
createtable = 'table' ('if' 'not' 'exists')? name ('(' defs ')' options ('as' '('? with? query ')'?)? / options 'as' '('? with? query ')'? / 'like' name any* / 'clone' name any*)
defs = def (',' def)*
def = ('constraint' IDENT)? ('primary' 'key' / 'unique' / 'foreign' 'key' / 'check' / 'index' / 'key' / 'exclude' / 'like') any* / name type? constraint*
type = WORD ('(' any* ')')? ('<' any* ('>' / '>>'))? WORDTYPE* ('(' any* ')')? ('[' NUMBER? ']')*
constraint = 'not' 'null' / 'null' / 'primary' 'key' ('asc' / 'desc')? / 'unique' / 'default' expr / 'references' name columns? refs* / 'check' '(' expr ')' / 'collate' IDENT / 'generated' any+ / 'constraint' IDENT / 'comment' STRING / 'auto_increment' / 'autoincrement' / 'identity' ('(' any* ')')? / 'on' any+ / 'encode' IDENT / 'sortkey' / 'distkey' / 'unsigned' / 'as' '(' expr ')' any*
refs = 'on' ('delete' / 'update') ('cascade' / 'restrict' / 'set' ('null' / 'default') / 'no' 'action') / 'deferrable' / 'match' WORD
options = option*
option = !('as' / ';') any
createview = 'view' ('if' 'not' 'exists')? name ('(' any* ')')? option* 'as' '('? with? query ')'? ('with' any+)?
name = IDENT ('.' (IDENT / WORD / '*'))*
exprs = expr (',' expr)*
expr = and ('or' and)*
and = not ('and' not)*
not = 'not' not / compare
compare = value comparison*
comparison = COMPARE ('all' / 'any' / 'some')? value / 'is' 'not'? ('null' / 'true' / 'false' / 'unknown' / 'distinct' 'from' value / value) / 'isnull' / 'notnull' / 'not'? ('between' 'symmetric'? value 'and' value / 'in' ('(' (with? query / exprs)? ')' / value) / ('like' / 'ilike' / 'rlike' / 'regexp' / 'similar' 'to' / 'glob') ('any' / 'all')? value ('escape' value)?)
value = unary (BINARY unary)*
unary = ('+' / '-' / '~' / '!' / 'prior' / 'binary')* postfix
postfix = primary ('::' type / '[' any* ']' / '.' (IDENT / WORD / '*') / 'at' 'time' 'zone' primary / 'collate' IDENT / ':' IDENT)*
primary = 'case' expr? ('when' expr 'then' expr)+ ('else' expr)? 'end' / ('cast' / 'try_cast' / 'safe_cast') '(' expr 'as' type ')' / 'exists' '(' with? query ')' / 'interval' (STRING / NUMBER / '(' expr ')' / IDENT) (WORDUNIT ('to' WORD)?)? / ('date' / 'timestamp' / 'time' / 'timestamptz' / 'datetime' / 'json' / 'uuid') STRING / 'array' '[' any* ']' / 'extract' '(' WORD 'from' expr ')' / 'position' '(' value 'in' value ')' / 'trim' '(' any+ ')' / ('substring' / 'overlay') '(' any+ ')' / 'row' '(' exprs? ')' / call / '(' with? query ')' / '(' (lambda / exprs) ')' / '[' any* ']' / '{' any* '}' / NUMBER / STRING+ / 'null' / 'true' / 'false' / 'default' / 'all' / 'any' / lambda / name / '*'
lambda = (IDENT / '(' IDENT (',' IDENT)* ')') '->' expr
call = (name / CALLWORD) '(' ('distinct' / 'all')? ('*' / callarg (',' callarg)*)? order? tail* (('separator') STRING)? ')' ('within' 'group' '(' order ')')? ('filter' '(' 'where' expr ')')? (('ignore' / 'respect') 'nulls')? ('over' (IDENT / '(' over ')'))?
callarg = IDENT ('=>' / ':=') expr / with? query / lambda / expr ('as' (IDENT / type))?
over = (!('partition' / 'order' / 'rows' / 'range' / 'groups') IDENT)? ('partition' 'by' exprs)? order? (('rows' / 'range' / 'groups') frame)?
frame = 'between' bound 'and' bound / bound
bound = ('unbounded' / 'current') WORD / value ('preceding' / 'following')
""",
    "script", fold=True, words=_RESERVED | _OBJECT | _OPERATORS | frozenset(_DANGLING.split()),
    kinds={
        "IDENT": _ident, "WORD": _word, "ANY": _any, "OBJECT": _object, "DANGLING": _op(_DANGLING), "FROM": _op("from"), "COMPARE": _op(_COMPARE), "BINARY": _op(_BINARY),
        "CALLWORD": _op(_CALLS), "WORDTYPE": _op(_TYPES),
        "WORDUNIT": _op(_UNITS)})


def check(text):
    """Raise SyntaxIssue unless the text is a script of statements; a text of comments only is one too."""
    GRAMMAR.parse(tokens(text))
