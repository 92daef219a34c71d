"""Scanner and grammar of YAML. The scanner turns indentation and context into tokens: starts and ends of block collections, entries, keys,
values, scalars, flow brackets; the grammar puts them together."""
import re

from .chart import Grammar, SyntaxIssue, Token

GRAMMAR = Grammar(
    """
stream = (DOCUMENT / DOCUMENTEND)* block? explicit*
explicit = (DOCUMENT / DOCUMENTEND)+ block?
block = ALIAS / property+ content? / content
property = ANCHOR / TAG
content = SCALAR / SEQUENCE entry* STOP / MAPPING pair* STOP / list / dict
entry = ENTRY block?
pair = KEY item? (VALUE item?)? / VALUE item?
item = block / property* entry+
list = '[' (element (',' element)* ','?)? ']'
dict = '{' (member (',' member)* ','?)? '}'
element = KEY flow? (VALUE flow?)? / VALUE flow? / flow (VALUE flow?)?
member = KEY flow? (VALUE flow?)? / VALUE flow? / flow (VALUE flow?)?
flow = ALIAS / property+ flowcontent? / flowcontent
flowcontent = SCALAR / list / dict
""",
    "stream")

_BLANK = re.compile(r"[ ]*")
_MARK = re.compile(r"(?:---|\.\.\.)(?=[ \t\r\n]|$)")
_PLAIN_START = re.compile(r"[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=\S)")
_PLAIN_START_FLOW = re.compile(r"[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[\-?:](?=[^\s,\[\]{}?:\-]|[\-?:](?=[^\s,\[\]{}]))")
#: A stretch of a plain scalar on one line, outside of and within flow collections.
_PLAIN = re.compile(r"(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s:#]|:\S))+")
_PLAIN_FLOW = re.compile(r"(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?=[^\s:#,\[\]{}]|:[^\s,\[\]{}]))+")
_HEADER = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:(?<=[ \t])#[^\n]*)?(?=\n|\Z)")
_WORD, _TAG = re.compile(r"[^\s,\[\]{}]+"), re.compile(r"!<[^>\s]*>|![^\s,\[\]{}]*")
_GAP, _BLANKS = re.compile(r"[ \t]*\n(?:[ \t]*\n)*"), re.compile(r"[ \t]*")
_DOUBLE = re.compile(r'"((?:[^"\\]|\\[0abtnvfre "/\\N_LP\t\n]|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8})*)"')
_SINGLE = re.compile(r"'((?:[^']|'')*)'")


class _Scanner:
    def __init__(self, text):
        self.t, self.i, self.n, self.line, self.start = text, 0, len(text), 1, 0  # start: of the current line
        self.out, self.indents, self.indent, self.flow = [], [], -1, []
        self.keys = {}  # by depth of flow: (place in out, index, line, column, required) of what may turn out to be a key
        self.key_allowed, self.seen = True, 1

    def fail(self, what):
        raise SyntaxIssue(what, min(self.line, self.t.count("\n") + 1))

    def add(self, kind, text="", at=None):
        t = Token(kind, text, self.line, False)
        if at is None:
            self.out.append(t)
        else:
            self.out.insert(at, t)

    def column(self):
        return self.i - self.start

    def newline(self, i):
        self.line += 1
        self.start = i

    def unwind(self, column):
        if self.flow:
            return
        while self.indent > column:
            self.add("STOP")
            self.indent = self.indents.pop()

    def deepen(self, column):
        if self.indent < column:
            self.indents.append(self.indent)
            self.indent = column
            return True
        return False

    def save_key(self):
        """What begins here may be a key, if a ':' follows on its line."""
        required = not self.flow and self.indent == self.column()
        if self.key_allowed:
            self.drop_key()
            self.keys[len(self.flow)] = (len(self.out), self.i, self.line, self.column(), required)

    def drop_key(self):
        k = self.keys.pop(len(self.flow), None)
        if k and k[4]:
            self.fail("expected a key")

    def rest(self, i):
        """What is left of the line from i on."""
        j = self.t.find("\n", i)
        return self.t[i : self.n if j < 0 else j]

    def stale(self):
        """Forget what could have been a key on an earlier line."""
        if self.line == self.seen:
            return
        self.seen = self.line
        for depth, k in list(self.keys.items()):
            if k[2] != self.line:
                if k[4]:
                    self.line = k[2]
                    self.fail("expected a key")
                del self.keys[depth]

    def space(self):
        """Skip blanks, comments and line ends; a line end outside of flow collections allows a key. A tab may not indent a block."""
        while self.i < self.n:
            c = self.t[self.i]
            if c == " ":
                self.i += 1
            elif c == "\t":
                if not self.flow and self.key_allowed and not self.t[self.start : self.i].strip():
                    rest = self.rest(self.i).strip()
                    if rest and not rest.startswith("#"):
                        self.fail("tab in indentation")
                self.i += 1
            elif c == "#" and (self.i == self.start or self.t[self.i - 1] in " \t"):
                j = self.t.find("\n", self.i)
                self.i = self.n if j < 0 else j
            elif c == "\n":
                self.i += 1
                self.newline(self.i)
                if not self.flow:
                    self.key_allowed = True
            else:
                return

    def follows(self, chars=""):
        """True where the next character ends a sign: a blank, the end, or one of chars."""
        return self.i + 1 >= self.n or self.t[self.i + 1] in " \t\n" or self.t[self.i + 1] in chars

    def tokens(self):
        while True:
            self.space()
            self.stale()
            if self.i >= self.n:
                break
            self.unwind(self.column())
            self.token()
        self.unwind(-1)
        if self.flow:
            self.fail("unterminated flow collection")
        self.keys = {d: k for d, k in self.keys.items() if k[4]}
        if self.keys:
            self.line = min(k[2] for k in self.keys.values())
            self.fail("expected a key")
        self.add("END")
        return self.out

    def token(self):
        t, i = self.t, self.i
        c = t[i]
        if i == self.start:
            if c == "%" and not self.flow:
                self.unwind(-1)
                j = t.find("\n", i)
                self.i = self.n if j < 0 else j
                return
            m = _MARK.match(t, i)
            if m:
                if self.flow:
                    self.fail("unterminated flow collection")
                self.unwind(-1)
                self.drop_key()
                self.key_allowed = False
                self.add("DOCUMENT" if m[0] == "---" else "DOCUMENTEND")
                self.i = m.end()
                if m[0] == "..." and re.match(r"[ \t]*[^\s#]", self.rest(self.i)):
                    self.fail("unexpected content after the end of a document")
                return
        if c in "[{":
            self.save_key()
            self.add("OP", c)
            self.flow.append(c)
            self.key_allowed = True
            self.i += 1
        elif c in "]}":
            if not self.flow:
                self.fail(f"unexpected {c!r}")
            self.keys.pop(len(self.flow), None)
            self.flow.pop()
            self.key_allowed = False
            self.add("OP", c)
            self.i += 1
        elif c == ",":
            if not self.flow:
                self.fail("unexpected ','")
            self.keys.pop(len(self.flow), None)
            self.key_allowed = True
            self.add("OP", c)
            self.i += 1
        elif c == "-" and self.follows() and not self.flow:
            if not self.key_allowed:
                self.fail("sequence entries are not allowed here")
            if self.deepen(self.column()):
                self.add("SEQUENCE")
            self.drop_key()
            self.key_allowed = True
            self.add("ENTRY")
            self.i += 1
        elif c == "?" and self.follows():
            if not self.flow:
                if not self.key_allowed:
                    self.fail("mapping keys are not allowed here")
                if self.deepen(self.column()):
                    self.add("MAPPING")
            self.key_allowed = not self.flow
            self.drop_key()
            self.add("KEY")
            self.i += 1
        elif c == ":" and (self.follows(",[]{}" if self.flow else "") or self.flow and t[i - 1 : i] in ("\"", "'", "]", "}")):
            self.value()
        elif c == "*" or c == "&" or c == "!":
            self.save_key()
            self.key_allowed = False
            m = _TAG.match(t, i) if c == "!" else _WORD.match(t, i + 1)
            if not m:
                self.fail("bad alias" if c == "*" else "bad anchor")
            self.add({"*": "ALIAS", "&": "ANCHOR", "!": "TAG"}[c], c)
            self.i = m.end()
        elif c in "|>" and not self.flow:
            self.drop_key()
            self.key_allowed = True
            self.block_scalar()
        elif c in "\"'":
            self.save_key()
            self.key_allowed = False
            self.quoted(c)
        elif (_PLAIN_START_FLOW if self.flow else _PLAIN_START).match(t, i):
            self.save_key()
            self.key_allowed = False
            self.plain()
        else:
            self.fail(f"unexpected {c!r}")

    def value(self):
        k = self.keys.pop(len(self.flow), None)
        if k:
            self.out.insert(k[0], Token("KEY", "", k[2], False))
            if not self.flow and self.deepen(k[3]):
                self.out.insert(k[0], Token("MAPPING", "", k[2], False))
            self.key_allowed = False
        else:
            if not self.flow:
                if not self.key_allowed:
                    self.fail("mapping values are not allowed here")
                if self.deepen(self.column()):
                    self.add("MAPPING")
            self.key_allowed = not self.flow
        self.add("VALUE")
        self.i += 1

    def block_scalar(self):
        m = _HEADER.match(self.t, self.i)
        if not m:
            self.fail("bad block scalar header")
        self.add("SCALAR")
        self.i = m.end()
        least, given = self.indent + 1, re.search(r"[1-9]", m[0].split("#")[0])
        least = max(least, self.indent + int(given[0])) if given else max(0, least)
        while self.i < self.n:  # at a line end
            j = self.t.find("\n", self.i + 1)
            j = self.n if j < 0 else j
            line = self.t[self.i + 1 : j]
            if line.strip(" ") and len(line) - len(line.lstrip(" ")) < least:
                return
            if self.i + 1 <= self.n:
                self.newline(self.i + 1)
            self.i = j

    def quoted(self, q):
        m = (_DOUBLE if q == '"' else _SINGLE).match(self.t, self.i)
        if not m:
            self.fail("unterminated quoted scalar or bad escape")
        first = self.line
        for x in re.finditer(r"\n", m[0]):
            at = self.i + x.end()
            if _MARK.match(self.t, at):
                self.fail("unterminated quoted scalar")
            self.newline(at)
            rest = self.rest(at)
            if not self.flow and rest.strip() and len(rest) - len(rest.lstrip(" ")) <= self.indent:
                self.fail("unterminated quoted scalar")
        self.out.append(Token("SCALAR", "", first, False))
        self.i = m.end()

    def plain(self):
        rx, first = _PLAIN_FLOW if self.flow else _PLAIN, self.line
        self.i = rx.match(self.t, self.i).end()
        while True:  # it may go on in the next lines, deeper than its parent
            i, line, start = self.i, self.line, self.start
            m = _GAP.match(self.t, i)
            if not m:
                break
            line += m[0].count("\n")
            start = m.end()
            at = _BLANK.match(self.t, start).end()
            if at >= self.n or self.t[at] == "#" or _MARK.match(self.t, start) or not self.flow and at - start <= self.indent:
                break
            if self.t[at] == "\t":
                at = _BLANKS.match(self.t, at).end()
            more = rx.match(self.t, at)
            if not more:
                break
            self.i, self.line, self.start = more.end(), line, start
            self.key_allowed = False
        self.out.append(Token("SCALAR", "", first, False))
        if self.line != first and not self.flow:
            self.key_allowed = False


def yaml(text):
    """Raise SyntaxIssue unless the text is a stream of YAML documents."""
    if "\x00" in text:
        raise SyntaxIssue("control character", text.count("\n", 0, text.index("\x00")) + 1)
    GRAMMAR.parse(_Scanner(text.replace("\r\n", "\n").lstrip("﻿")).tokens())
