"""Grammar of shell scripts (POSIX with the common extensions)."""
import re

from .chart import Grammar, SyntaxIssue, Token

_OPS = sorted("\n ; & && || | |& ( ) ;; ;& ;;& < > >> << <<- <<< <& >& <> >| &> &>>".split(" "), key=len, reverse=True)
_RESERVED = frozenset("if then else elif fi do done case esac while until for in select function { } ! [[ ]] time".split())


class _Lexer:
    def __init__(self, text, line=1):
        self.t, self.i, self.n, self.line = text, 0, len(text), line
        self.out, self.heredocs = [], []

    def fail(self, what, line=None):
        raise SyntaxIssue(what, line or self.line)

    def add(self, kind, s, line=None):
        self.out.append(Token(kind, s, line or self.line, False))

    def tokens(self, closing=None):
        """Tokens up to the end, or up to the closing parenthesis of a substitution."""
        depth, case = 0, []
        while self.i < self.n:
            c = self.t[self.i]
            if c in " \t\r":
                self.i += 1
                continue
            if self.t.startswith("\\\n", self.i):
                self.i += 2
                self.line += 1
                continue
            if c == "#":
                j = self.t.find("\n", self.i)
                self.i = self.n if j < 0 else j
                continue
            if closing and c == ")" and depth == 0 and not case:
                self.i += 1
                self.add("END", "")
                return self.out
            if c == "\n":
                self.add("NL", "\n")
                self.i += 1
                self.line += 1
                for word, strip in self.heredocs:
                    self.heredoc(word, strip)
                self.heredocs = []
                continue
            if self.t.startswith("((", self.i) and (not self.out or self.out[-1].kind in ("NL", "OP") or self.out[-1].text in ("for", "do", "then", "if", "while", "until", "else", "&&", "||", "{", "!")):
                j = self.arith(self.i + 2)
                if j:
                    self.add("ARITH", self.t[self.i : j])
                    self.i = j
                    continue
            if c in "<>" and self.t[self.i + 1 : self.i + 2] == "(":
                at = self.line
                self.add("WORD", self.word(), at)
                continue
            op = next((o for o in _OPS if o != "\n" and self.t.startswith(o, self.i)), None)
            if op:
                if op == "(":
                    depth += 1
                elif op == ")":
                    if case and depth == 0:
                        pass
                    else:
                        depth -= 1
                self.add("OP", op)
                self.i += len(op)
                if op in ("<<", "<<-"):
                    self.mark(op == "<<-")
                continue
            if re.match(r"\d+(?=[<>])", self.t[self.i :]) and (not self.out or self.t[self.i - 1] in " \t;|&("):
                m = re.match(r"\d+", self.t[self.i :])
                self.add("IONUM", m[0])
                self.i += m.end()
                continue
            at = self.line
            s = self.word()
            if s == "case" and self.command():
                case.append(at)
            elif s == "esac" and case:
                case.pop()
            self.add("WORD", s, at)
        if self.heredocs:
            pass  # a script may end before the text of its last here-document: a warning only
        if closing:
            self.fail("unterminated substitution")
        self.add("END", "")
        return self.out

    def command(self):
        return not self.out or self.out[-1].kind == "NL" or self.out[-1].text in (";", "&", "&&", "||", "|", "(", ";;", "do", "then", "else", "{", "!", "if", "while", "until", "elif", ")")

    def mark(self, strip):
        while self.i < self.n and self.t[self.i] in " \t":
            self.i += 1
        at = self.line
        w = self.word()
        if not w:
            self.fail("here-document without a word")
        self.add("WORD", w, at)
        self.heredocs.append((re.sub(r"[\"'\\]", "", w), strip))

    def heredoc(self, word, strip):
        while self.i < self.n:
            j = self.t.find("\n", self.i)
            j = self.n if j < 0 else j
            s = self.t[self.i : j]
            self.i = min(j + 1, self.n)
            self.line += 1
            if (s.lstrip("\t") if strip else s) == word:
                return

    def arith(self, j):
        depth = 0
        while j < self.n:
            c = self.t[j]
            if c == "(":
                depth += 1
            elif c == ")":
                if depth == 0:
                    return j + 2 if self.t.startswith("))", j) else None
                depth -= 1
            elif c == "\n" and depth == 0 and False:
                return None
            j += 1
        return None

    def word(self):
        start = self.i
        while self.i < self.n:
            c = self.t[self.i]
            if c in " \t\r\n;&|()" or c in "<>" and self.t[self.i + 1 : self.i + 2] != "(":
                if c == "(" and self.i > start and (self.t[self.i - 1] in "@?+*!=" and re.match(r"[\w+]*[@?+*!=]$", self.t[start : self.i][-40:])):
                    self.group()
                    continue
                break
            if c in "<>":
                self.i += 2
                self.sub()
                continue
            if c == "\\":
                self.line += self.t[self.i + 1 : self.i + 2] == "\n"
                self.i += 2
                continue
            self.piece()
        return self.t[start : self.i]

    def group(self):
        """An extended pattern or an array literal: balanced parentheses of words."""
        at, depth = self.line, 0
        while self.i < self.n:
            c = self.t[self.i]
            if c == "(":
                depth += 1
                self.i += 1
            elif c == ")":
                depth -= 1
                self.i += 1
                if depth == 0:
                    return
            elif c == "\\":
                self.i += 2
            elif c == "#" and self.t[self.i - 1] in " \t\n":
                j = self.t.find("\n", self.i)
                self.i = self.n if j < 0 else j
            elif c in "'\"`$":
                self.piece()
            else:
                self.line += c == "\n"
                self.i += 1
        self.fail("unterminated (", at)

    def piece(self):
        c, at = self.t[self.i], self.line
        if c == "'":
            j = self.t.find("'", self.i + 1)
            if j < 0:
                self.fail("unterminated '", at)
            self.line += self.t.count("\n", self.i, j)
            self.i = j + 1
        elif c == '"':
            self.i += 1
            self.double(at)
        elif c == "`":
            j = self.i + 1
            while j < self.n and self.t[j] != "`":
                j += 2 if self.t[j] == "\\" else 1
            if j >= self.n:
                self.fail("unterminated `", at)
            inner = self.t[self.i + 1 : j].replace("\\`", "`")
            GRAMMAR.parse(_Lexer(inner, self.line).tokens())
            self.line += self.t.count("\n", self.i, j)
            self.i = j + 1
        elif c == "$":
            self.dollar()
        else:
            self.i += 1

    def double(self, at):
        while self.i < self.n:
            c = self.t[self.i]
            if c == '"':
                self.i += 1
                return
            if c == "\\":
                self.line += self.t[self.i + 1 : self.i + 2] == "\n"
                self.i += 2
            elif c in "$`":
                self.piece()
            else:
                self.line += c == "\n"
                self.i += 1
        self.fail('unterminated "', at)

    def dollar(self):
        at = self.line
        if self.t.startswith("$((", self.i):
            j = self.arith(self.i + 3)
            if j:
                self.line += self.t.count("\n", self.i, j)
                self.i = j
                return
        if self.t.startswith("$(", self.i):
            self.i += 2
            self.sub()
        elif self.t.startswith("${", self.i):
            self.i += 2
            depth = 1
            while self.i < self.n:
                c = self.t[self.i]
                if c == "}":
                    depth -= 1
                    self.i += 1
                    if not depth:
                        return
                elif c == "\\":
                    self.i += 2
                elif c in "\"`$" or c == "'" and self.t.find("'", self.i + 1) > 0:
                    self.piece()
                else:
                    self.line += c == "\n"
                    self.i += 1
            self.fail("unterminated ${", at)
        elif self.t.startswith("$'", self.i):
            j = self.i + 2
            while j < self.n and self.t[j] != "'":
                j += 2 if self.t[j] == "\\" else 1
            if j >= self.n:
                self.fail("unterminated $'", at)
            self.i = j + 1
        else:
            self.i += 1

    def sub(self):
        inner = _Lexer(self.t, self.line)
        inner.i = self.i
        t = inner.tokens(closing=True)
        GRAMMAR.parse(t)
        self.i, self.line = inner.i, inner.line


def _plain(t, i):
    return i + 1 if t[i].kind == "WORD" else -1


def _first(t, i):
    return i + 1 if t[i].kind == "WORD" and t[i].text not in _RESERVED else -1


def _key(word):
    return lambda t, i: i + 1 if t[i].kind == "WORD" and t[i].text == word else -1


_KEYS = {f"K_{w.upper()}": _key(w) for w in "if then else elif fi do done case esac while until for in select function time".split()}
GRAMMAR = Grammar(
    r"""
script = nl list? nl
nl = NL*
list = andor (sep andor)* sep?
sep = (';' / '&') nl / NL nl
andor = pipe (('&&' / '||') nl pipe)*
pipe = (K_TIME / BANG)* command (('|' / '|&') nl command)*
command = compound redir* / funcdef / test redir* / simple
simple = redir* FIRST (redir / PLAIN / funcless)* / redir+ (FIRST (redir / PLAIN)*)?
funcless = !')' '(' !')' PLAIN* ')'
funcdef = FIRST '(' ')' nl (compound / test) redir* / K_FUNCTION PLAIN ('(' ')')? nl (compound / test) redir*
compound = group / '(' nl list nl ')' / ARITH / if / case / for / while
group = LBRACE nl list nl RBRACE
if = K_IF nl list nl K_THEN nl list nl (K_ELIF nl list nl K_THEN nl list nl)* (K_ELSE nl list nl)? K_FI
case = K_CASE PLAIN nl K_IN nl clause* last? K_ESAC
clause = '('? pattern ')' nl (list nl)? (';;' / ';&' / ';;&') nl
last = !K_ESAC '('? pattern ')' nl (list nl)?
pattern = PLAIN ('|' PLAIN)*
for = (K_FOR / K_SELECT) (PLAIN nl (K_IN PLAIN* (';' / NL) nl / ';' nl)? nl / ARITH ';'? nl) (K_DO nl list nl K_DONE / group)
while = (K_WHILE / K_UNTIL) nl list nl K_DO nl list nl K_DONE
test = LTEST testpart+ RTEST
testpart = !RTEST (PLAIN / '(' / ')' / '&&' / '||' / '<' / '>' / '|' / NL / '&' / IONUM)
redir = IONUM? ('<' / '>' / '>>' / '<<' / '<<-' / '<<<' / '<&' / '>&' / '<>' / '>|' / '&>' / '&>>') PLAIN
""",
    "script", words=_RESERVED, kinds={"PLAIN": _plain, "FIRST": _first, "LBRACE": _key("{"), "RBRACE": _key("}"), "LTEST": _key("[["), "RTEST": _key("]]"), "BANG": _key("!"), **_KEYS})


def check(text):
    """Raise SyntaxIssue unless the text is a script."""
    GRAMMAR.parse(_Lexer(text).tokens())
