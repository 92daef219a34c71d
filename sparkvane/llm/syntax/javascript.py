"""Grammar of JavaScript modules."""
import re

from .chart import Grammar, SyntaxIssue, Token, token

_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try "
    "typeof var void while with".split())
_OPS = sorted(
    "{ } ( ) [ ] . ... ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => @".split(), key=len, reverse=True)
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
_NAME = re.compile(r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|[‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_STRING = re.compile(r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_BLANK = re.compile(r"[ \t\v\f ﻿ -   　]+")

_OP = re.compile("|".join(map(re.escape, _OPS)))
#: What most tokens are: names, strings without line ends, and operators that need no look at what stands before.
_COMMON = re.compile(rf"(?P<NAME>{_NAME.pattern})|(?P<STRING>{_STRING.pattern})|(?P<OP>{'|'.join(re.escape(o) for o in _OPS if o[0] not in '/{}?.')})")


def tokens(text):
    """Tokens of a module; regular expressions are told from divisions by the token before."""
    out, i, n, line, fresh, braces = [], 0, len(text), 1, True, []
    if text.startswith("#!"):
        i = text.find("\n") if "\n" in text else n

    def add(kind, s):
        nonlocal fresh
        out.append(token((kind, s, line, fresh)))
        fresh = False

    def template(i, head):
        nonlocal line
        m = _TEXT.match(text, i)
        j = m.end()
        at = line
        if j >= n:
            raise SyntaxIssue("unterminated template", at)
        if text[j] == "`":
            add("TEMPLATE" if head else "TTAIL", text[i:j])
            line += text.count("\n", i, j)
            return j + 1
        add("THEAD" if head else "TMID", text[i:j])
        line += text.count("\n", i, j)
        braces.append("$")
        return j + 2

    while i < n:
        c = text[i]
        if c == "\n" or c in "\r  ":
            line += c == "\n"
            fresh = True
            i += 1
            continue
        if c == " " or c > "\x7f" or c in "\t\v\f":
            m = _BLANK.match(text, i)
            if m:
                i = m.end()
                continue
        m = _COMMON.match(text, i)
        if m:
            s = m[0]
            out.append(token((m.lastgroup, s, line, fresh)))
            fresh = False
            if m.lastgroup == "STRING" and "\n" in s:
                line += s.count("\n")
            i = m.end()
            continue
        if c == "/" and text.startswith("//", i):
            j = text.find("\n", i)
            i = n if j < 0 else j
            continue
        if c == "/" and text.startswith("/*", i):
            j = text.find("*/", i + 2)
            if j < 0:
                raise SyntaxIssue("unterminated comment", line)
            k = text.count("\n", i, j)
            line += k
            fresh |= k > 0
            i = j + 2
            continue
        if c == "`":
            i = template(i + 1, True)
            continue
        if c in "'\"":
            raise SyntaxIssue("unterminated string", line)
        if c.isdigit() or c == "." and i + 1 < n and text[i + 1].isdigit():
            m = _NUMBER.match(text, i)
            if _NAME.match(text, m.end()) or m[0].endswith("_") or re.match(r"0\d", m[0]):
                raise SyntaxIssue(f"bad number {m[0]!r}", line)
            add("NUMBER", m[0])
            i = m.end()
            continue
        if c == "#" and (m := _NAME.match(text, i + 1)):
            add("PRIVATE", "#" + m[0])
            i = m.end()
            continue
        if c == "/":
            last = out[-1] if out else None
            value = last and (last.kind in ("NUMBER", "STRING", "TEMPLATE", "TTAIL", "REGEX", "PRIVATE") or last.text in (")", "]", "}") and last.kind == "OP" or last.kind == "NAME" and (
                last.text not in _RESERVED or last.text in ("this", "super", "null", "true", "false") or len(out) > 1 and out[-2].text in (".", "?.")))
            if not value or (last.text == "}" and fresh and _REGEX.match(text, i)):
                m = _REGEX.match(text, i)
                if not m:
                    raise SyntaxIssue("unterminated regular expression", line)
                add("REGEX", m[0])
                i = m.end()
                continue
        m = _OP.match(text, i)
        op = m and m[0]
        if op == "?." and i + 2 < n and text[i + 2].isdigit():
            op = "?"
        if op is None:
            raise SyntaxIssue(f"unexpected {c!r}", line)
        if op == "{":
            braces.append("{")
        elif op == "}":
            if not braces:
                raise SyntaxIssue("unexpected '}'", line)
            if braces.pop() == "$":
                i = template(i + 1, False)
                continue
        add("OP", op)
        i += len(op)
    if "$" in braces:
        raise SyntaxIssue("unterminated template", line)
    out.append(Token("END", "", line, True))
    return out


def _ident(t, i):
    return i + 1 if t[i].kind == "NAME" and t[i].text not in _RESERVED else -1


def _line(t, i):
    return i if t[i].fresh else -1


def _same(t, i):
    return i if not t[i].fresh else -1


def _op(names):
    s = frozenset(names.split())
    return lambda t, i: i + 1 if t[i].kind in ("OP", "NAME") and t[i].text in s else -1


GRAMMAR = Grammar(
    r"""
program = item*
item = import / export / stmt
import = 'import' !('(' / '.') (STRING attrs? eos / clause 'from' STRING attrs? eos)
attrs = 'with' object
clause = IDENT (',' (star / named))? / star / named
star = '*' 'as' IDENT
named = '{' (spec (',' spec)* ','?)? '}'
spec = (NAME / STRING) ('as' (NAME / STRING))?
export = 'export' ('default' (function / class / assign eos) / '*' ('as' (NAME / STRING))? 'from' STRING attrs? eos / named ('from' STRING attrs?)? eos / var / function / class)
stmt = block / var / function / class / if / for / while / do / try / switch / return / break / continue / throw / 'debugger' eos / ';' / labelled / !('function' / 'class') expr eos
labelled = IDENT ':' stmt
block = '{' stmt* '}'
var = ('var' / 'let' &(IDENT / '[' / '{')) decl (',' decl)* eos / 'const' const (',' const)* eos
decl = (pattern '=' assign) / IDENT ('=' assign)?
const = binding '=' assign
binding = IDENT / pattern
pattern = '[' (',' / '...' binding / element)* ']' / '{' (field (',' field)* ','?)? '}'
element = binding ('=' assign)? (',' / &']')
field = '...' binding / key ':' binding ('=' assign)? / IDENT ('=' assign)?
key = NAME / STRING / NUMBER / PRIVATE / '[' assign ']'
if = 'if' '(' expr ')' stmt ('else' stmt)?
while = 'while' '(' expr ')' stmt
do = 'do' stmt 'while' '(' expr ')' ';'?
for = 'for' 'await'? '(' (('var' / 'let' / 'const') binding ('of' assign / 'in' expr) / lhs ('of' assign / 'in' expr) / forvar? ';' expr? ';' expr?) ')' stmt
forvar = ('var' / 'let' / 'const') decl (',' decl)* / expr
try = 'try' block ('catch' ('(' binding ')')? block ('finally' block)? / 'finally' block)
switch = 'switch' '(' expr ')' '{' (('case' expr / 'default') ':' stmt*)* '}'
return = 'return' (SAME !(';' / '}') expr)? eos
break = 'break' (SAME IDENT)? eos
continue = 'continue' (SAME IDENT)? eos
throw = 'throw' SAME expr eos
eos = ';' / &'}' / &END / LINE
function = ('async' SAME)? 'function' '*'? IDENT? params body
params = '(' (param (',' param)* ','?)? ')'
param = '...'? binding ('=' assign)?
body = '{' stmt* '}'
class = 'class' (!'extends' IDENT)? ('extends' lhs)? '{' member* '}'
member = ';' / 'static' block / ('static' !('(' / '=' / ';' / '}'))? (method / key ('=' assign)? eos)
method = (('get' / 'set') !('(' / '=' / ';' / '}' / ',' / ':') / 'async' SAME !('(' / '=' / ';' / '}' / ',' / ':') '*'? / '*')? key params body
expr = assign (',' assign)*
assign = arrow / yield / lhs ASSIGN assign / cond
arrow = ('async' SAME)? (IDENT / params) SAME '=>' (body / !'{' assign)
yield = 'yield' (SAME ('*' assign / assign))?
cond = binary ('?' assign ':' assign)?
binary = (PRIVATE 'in')? unary (BINARY unary)*
unary = UNARY* postfix
postfix = lhs (SAME ('++' / '--'))?
lhs = 'new'* primary suffix*
suffix = '.' (NAME / PRIVATE) / '?.' (NAME / PRIVATE / '[' expr ']' / args) / '[' expr ']' / args / template
args = '(' (arg (',' arg)* ','?)? ')'
arg = '...'? assign
primary = function / class / NUMBER / STRING / REGEX / template / array / object / '(' expr ')' / 'this' / 'super' / 'null' / 'true' / 'false' / 'import' ('(' assign (',' assign)? ')' / '.' 'meta') / 'new' '.' 'target' / IDENT
template = TEMPLATE / THEAD expr (TMID expr)* TTAIL
array = '[' (',' / arg (',' / &']'))* ']'
object = '{' (prop (',' prop)* ','?)? '}'
prop = '...' assign / method / key ':' assign / IDENT ('=' assign)?
""",
    "program", keep=("body", "return"), words=_RESERVED | frozenset(_OPS), places=("LINE", "SAME"),
    kinds={
        "IDENT": _ident, "LINE": _line, "SAME": _same, "ASSIGN": _op("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??="),
        "BINARY": _op("|| && ?? | ^ & == != === !== < > <= >= instanceof in << >> >>> + - * / % **"), "UNARY": _op("delete void typeof await ! ~ + - ++ --")})


def check(text):
    """Raise SyntaxIssue unless the text is a module. `return` must stand in a function."""
    t = tokens(text)
    run = GRAMMAR.parse(t)
    inside, last = sorted(run.spans.get("body", ())), -1
    outer = []  # bodies that lie in no other
    for i, j in inside:
        if i >= last:
            outer.append((i, j))
            last = j
    k = 0
    for i, _ in sorted(run.spans.get("return", ())):
        while k < len(outer) and outer[k][1] <= i:
            k += 1
        if k == len(outer) or not outer[k][0] < i:
            raise SyntaxIssue("return outside of a function", t[i].line)
