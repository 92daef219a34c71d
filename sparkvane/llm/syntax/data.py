"""Grammars of JSON, INI, TOML and XML."""
import re

from .chart import Grammar, SyntaxIssue, Token

_JSON_TOKEN = re.compile(r'[ \t\n\r]+|(?P<STRING>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUMBER>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(?P<OP>[\[\]{},:]|(?:true|false|null)(?![\w$]))')
JSON = Grammar(
    """
text = value
value = STRING / NUMBER / '{' (pair (',' pair)*)? '}' / '[' (value (',' value)*)? ']' / 'true' / 'false' / 'null'
pair = STRING ':' value
""",
    "text")


def json_text(text):
    """Raise SyntaxIssue unless the text is one JSON value."""
    out, i, line = [], 0, 1
    while i < len(text):
        m = _JSON_TOKEN.match(text, i)
        if not m:
            raise SyntaxIssue("bad string" if text[i] == '"' else f"unexpected {text[i]!r}", line)
        if m.lastgroup:
            out.append(Token(m.lastgroup, m[0], line, False))
        else:
            line += m[0].count("\n")
        i = m.end()
    JSON.parse([*out, Token("END", "", line, False)])


INI = Grammar(
    """
file = BLANK* section*
section = SECTION BLANK* option*
option = OPTION (MORE / BLANK)*
""",
    "file")


def _ini_line(line, k, option):
    s = line.strip()
    if not s or s[0] in "#;":
        return "BLANK"
    if re.match(r"(?:<{7}|={7}|>{7}|\|{7})(?:\s|$)", line):
        raise SyntaxIssue("conflict marker", k)
    if line[0] in " \t" and option:
        return "MORE"
    if re.match(r"\[[^\]]+\]\s*(?:[#;].*)?$", s):
        return "SECTION"
    return "OPTION" if re.match(r"[^=:\s\[][^=:]*?\s*[=:]", s) else "OTHER"


def ini(text):
    """Raise SyntaxIssue unless the text is sections of options with = or :, with continuations, comments and blank lines; each line is a token.

    A line that is indented goes on with an option only where one has begun; elsewhere it is read as if it were not."""
    out, option = [], False
    for k, line in enumerate(text.split("\n"), 1):
        kind = _ini_line(line, k, option)
        option = kind == "OPTION" or option and kind != "SECTION"
        out.append(Token(kind, line.strip(), k, True))
    INI.parse([*out, Token("END", "", len(out), True)])


_TOML_SKIP = re.compile(r"(?:[ \t]+|#[^\x00-\x08\x0a-\x1f\x7f]*)+")
_TOML_BARE = re.compile(r"[A-Za-z0-9_-]+")
_ESCAPE = r"\\(?:[btnfre\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_TOML_LONG = re.compile(rf'"""(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|{_ESCAPE}|\\[ \t]*\n|"{{1,2}}(?!"))*"{{3,5}}|\'\'\'(?:[^\'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\'{{1,2}}(?!\'))*\'{{3,5}}')
_TOML_STRING = re.compile(rf'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|{_ESCAPE})*"|\'[^\'\x00-\x08\x0a-\x1f\x7f]*\'')
_TIME = r"\d\d:\d\d:\d\d(?:\.\d+)?"
_TOML_SCALAR = re.compile(
    rf"(?:\d{{4}}-\d\d-\d\d(?:[Tt ]{_TIME}(?:[Zz]|[+-]\d\d:\d\d)?)?|{_TIME}|0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    r"|[+-]?(?:inf|nan|(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)|true|false)(?![\w.+:-])")
TOML = Grammar(
    """
file = line*
line = NL / statement (NL / &END)
statement = '[' ('[' key ']' ']' / key ']') / pair
key = part ('.' part)*
part = BARE / STRING
pair = key '=' value
value = STRING / LONG / SCALAR / array / table
array = '[' NL* (value NL* (',' NL* value NL*)* (',' NL*)?)? ']'
table = '{' (pair (',' pair)*)? '}'
""",
    "file", words="[ ] { } . = ,".split())


def toml(text):
    """Raise SyntaxIssue unless the text has the form of TOML. Whether a key is given twice is not a matter of form, and not judged here."""
    text = text.replace("\r\n", "\n")
    out, i, line, open_, value = [], 0, 1, [], False
    while i < len(text):
        c = text[i]
        m = _TOML_SKIP.match(text, i)
        if m:
            i = m.end()
            continue
        if c == "\n":
            out.append(Token("NL", "\n", line, False))
            line += 1
            i += 1
            value = bool(open_) and open_[-1] == "["
            continue
        if c in "[]{}.=,":
            if c in "[{" and value:
                open_.append(c)
                value = c == "["
            elif c in "]}" and open_:
                open_.pop()
                value = bool(open_) and open_[-1] == "["
            elif c == "=":
                value = True
            elif c == ",":
                value = bool(open_) and open_[-1] == "["
            out.append(Token("OP", c, line, False))
            i += 1
            continue
        kinds = (("LONG", _TOML_LONG), ("STRING", _TOML_STRING), ("SCALAR", _TOML_SCALAR)) if value else (("STRING", _TOML_STRING), ("BARE", _TOML_BARE))
        for kind, rx in kinds:
            m = rx.match(text, i)
            if m:
                break
        else:
            raise SyntaxIssue(f"unexpected {c!r}", line)
        out.append(Token(kind, m[0], line, False))
        line += m[0].count("\n")
        i = m.end()
    TOML.parse([*out, Token("END", "", line, False)])


_XML_NAME = r"[^\W\d][\w:.·-]*"
_REFERENCE = rf"&(?:{_XML_NAME}|\#\d+|\#x[0-9a-fA-F]+);"
_XML_TOKEN = re.compile(
    rf"""(?sx)(?P<COMMENT><!--(?:(?!--).)*-->)|(?P<CDATA><!\[CDATA\[.*?\]\]>)|(?P<DECLARATION><\?xml\s.*?\?>)|(?P<INSTRUCTION><\?{_XML_NAME}(?:\s.*?)?\?>)|(?P<DOCTYPE><!DOCTYPE\s(?:[^\[\]<>"']|"[^"]*"|'[^']*'|\[.*?\]\s*(?=>))*>)
    |(?P<CLOSE></{_XML_NAME}\s*>)|(?P<tag><{_XML_NAME}(?:\s+{_XML_NAME}\s*=\s*(?:"(?:[^<&"]|{_REFERENCE})*"|'(?:[^<&']|{_REFERENCE})*'))*\s*(?P<end>/?)>)|(?P<BLANK>\s+(?=<|\Z))|(?P<TEXT>(?:[^<&]++|{_REFERENCE})++)""")
XML = Grammar(
    """
document = DECLARATION? misc* (DOCTYPE misc*)? element misc*
misc = BLANK / COMMENT / INSTRUCTION
element = EMPTY / OPEN content* CLOSE
content = element / TEXT / BLANK / CDATA / COMMENT / INSTRUCTION
""",
    "document")


def xml(text):
    """Raise SyntaxIssue unless the text has the form of an XML document. Whether names of tags match is judged as elements close."""
    out, i, line, names = [], 0, 1, []
    while i < len(text):
        m = _XML_TOKEN.match(text, i)
        if not m:
            raise SyntaxIssue("not well-formed", line)
        kind = m.lastgroup if m.lastgroup not in ("tag", "end") else "EMPTY" if m["end"] else "OPEN"
        if kind == "OPEN":
            names.append(re.match(rf"<({_XML_NAME})", m[0])[1])
        elif kind == "CLOSE" and (not names or names.pop() != m[0][2:-1].rstrip()):
            raise SyntaxIssue("mismatched tag", line)
        elif kind == "TEXT" and "]]>" in m[0]:
            raise SyntaxIssue("not well-formed", line)
        out.append(Token(kind, m[0], line, False))
        line += m[0].count("\n")
        i = m.end()
    XML.parse([*out, Token("END", "", line, False)])
