"""A table-driven chart parser for grammars written as text.

A grammar names rules with ordered alternatives over tokens: `name = a b / c`, with `?`, `*`, `+`, groups, `&x` and `!x` lookahead,
quoted literals, and token kinds in capitals. It is compiled into two tables: a program of a pushdown machine, and a prediction table
that tells for each choice and each class of tokens which alternatives can begin with it, from the sets of first tokens. The machine
keeps its own stack, so nesting is bounded by memory alone, and each rule's result at each position in a chart, so parsing takes time
linear in the tokens however alternatives overlap. The furthest position at which a token did not fit is the place of the first
unrecoverable error."""
import re
from functools import partial
from typing import NamedTuple


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    fresh: bool  # first on its line


#: A token of (kind, text, line, fresh), made without the checks of a call.
token = partial(tuple.__new__, Token)


class SyntaxIssue(ValueError):
    """The text is not valid: message and line (from 1)."""

    def __init__(self, message, line):
        super().__init__(f"{message} (line {line})")
        self.message, self.line = message, line


_PIECE = re.compile(r"\s*(?:(?P<lit>'(?:[^'\\]|\\.)+')|(?P<kind>[A-Z][A-Z_]+)|(?P<rule>[a-z]\w*)|(?P<op>[/()?*+&!]))")
#: Instructions of the machine.
TERM, CALL, PRED, COMMIT, LOOP, NEXT, LOOK, LOOKED, TEST, RET = range(10)


class Grammar:
    """A compiled grammar; `fold` makes literals match in any case.

    `kinds` may hold more tests on one token: {NAME: function(tokens, i) -> new i or -1}. A test sees the kind and text of a token, the
    text only if it is a literal of the grammar or in `words`; those in `places` also see whether a token is the first on its line, and
    consume nothing. The rules in `keep` have their spans recorded where the start is a list of items."""

    def __init__(self, text, start, fold=False, kinds=None, keep=(), words=(), places=()):
        self.fold, self.kinds, self.keep, self.places = fold, kinds or {}, keep, places
        self.sources = {}
        for rule in re.split(r"\n(?=[a-z]\w*\s*=)", re.sub(r"(?m)^\s*#.*$", "", text).strip()):
            name, body = rule.split("=", 1)
            self.sources[name.strip()] = body
        self.start = start
        self.names = {n: k for k, n in enumerate(self.sources)}
        self.terms, self.words, self.classes = {}, set(words), {}
        self.samples = []  # a token of each class
        self.trees = [self._parse(body, n) for n, body in self.sources.items()]
        self._firsts()
        self.code, self.entry = [], []
        for tree in self.trees:
            self.entry.append(len(self.code))
            self._emit(tree)
            self.code.append((RET, None, None))
        self.term_list = list(self.terms)
        self.fits = [{} for _ in self.terms]
        self.begins = [{} for _ in self.trees]

    def _parse(self, body, name):
        pieces, at = [], 0
        body = body.rstrip()
        while at < len(body):
            m = _PIECE.match(body, at)
            if not m:
                raise ValueError(f"rule {name}: {body[at:at + 30]!r}")
            pieces.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        tree, k = self._choice(pieces, 0)
        if k != len(pieces):
            raise ValueError(f"rule {name}: piece {k}")
        return tree

    def _choice(self, p, k):
        alts = []
        while True:
            seq = []
            while k < len(p) and p[k] not in (("op", "/"), ("op", ")")):
                item, k = self._item(p, k)
                seq.append(item)
            alts.append(seq[0] if len(seq) == 1 else ("seq", tuple(seq)))
            if k < len(p) and p[k] == ("op", "/"):
                k += 1
                continue
            return (alts[0] if len(alts) == 1 else ("alt", tuple(alts))), k

    def _item(self, p, k):
        what, text = p[k]
        if what == "op" and text in "&!":
            inner, k = self._item(p, k + 1)
            return (("and" if text == "&" else "not"), inner), k
        if what == "op" and text == "(":
            node, k = self._choice(p, k + 1)
            k += 1
        elif what == "lit":
            t = text[1:-1].replace("\\'", "'")
            t = t.lower() if self.fold else t
            self.words.add(t)
            node, k = ("term", self.terms.setdefault(("lit", t), len(self.terms))), k + 1
        elif what == "kind":
            if text in self.places:
                node = ("place", self.kinds[text])
            else:
                node = ("term", self.terms.setdefault(("test", self.kinds[text]) if text in self.kinds else ("kind", text), len(self.terms)))
            k += 1
        else:
            node, k = ("rule", self.names[text]), k + 1
        while k < len(p) and p[k][0] == "op" and p[k][1] in "?*+":
            node, k = (p[k][1], node), k + 1
        return node, k

    def _first(self, node):
        """(terminals a node can begin with, whether it can be empty)."""
        op, arg = node
        if op == "term":
            return {arg}, False
        if op == "rule":
            return self.first[arg]
        if op == "seq":
            out = set()
            for x in arg:
                f, empty = self._first(x)
                out |= f
                if not empty:
                    return out, False
            return out, True
        if op == "alt":
            all_ = [self._first(x) for x in arg]
            return set().union(*(f for f, _ in all_)), any(e for _, e in all_)
        if op in "?*":
            return self._first(arg)[0], True
        if op == "+":
            return self._first(arg)
        return set(), True  # lookahead and places consume nothing

    def _firsts(self):
        self.first = [(set(), False) for _ in self.trees]
        while True:
            new = [self._first(t) for t in self.trees]
            if new == self.first:
                return
            self.first = new

    def _emit(self, node):
        op, arg = node
        code = self.code
        if op == "term":
            code.append((TERM, arg, None))
        elif op == "rule":
            code.append((CALL, arg, self.first[arg]))
        elif op == "seq":
            for x in arg:
                self._emit(x)
        elif op == "alt":
            at = len(code)
            code.append(None)
            starts, ends = [], []
            for x in arg:
                starts.append((len(code), self._first(x)))
                self._emit(x)
                ends.append(len(code))
                code.append(None)
            code[at] = (PRED, {}, starts)
            for e in ends:
                code[e] = (COMMIT, len(code), None)
        elif op == "?":
            at = len(code)
            code.append(None)
            self._emit(arg)
            code.append((COMMIT, len(code) + 1, None))
            code[at] = (PRED, {}, [(at + 1, self._first(arg)), (len(code) - 1, (set(), True))])
        elif op in "*+":
            if op == "+":
                self._emit(arg)
            at = len(code)
            code.append(None)
            self._emit(arg)
            code.append((NEXT, at, len(code) + 1))
            code[at] = (LOOP, {}, (self._first(arg), len(code)))
        elif op in ("and", "not"):
            at = len(code)
            code.append(None)
            self._emit(arg)
            code.append((LOOKED, op == "and", len(code) + 1))
            code[at] = (LOOK, op == "and", len(code))
        else:
            code.append((TEST, arg, None))

    def _fit(self, term, c):
        """Whether a terminal fits the tokens of a class."""
        what, x = self.term_list[term]
        t = self.samples[c]
        if what == "lit":
            ok = t.text == x and t.kind in ("OP", "NAME")
        elif what == "kind":
            ok = t.kind == x
        else:
            ok = x([t], 0) == 1
        self.fits[term][c] = ok
        return ok

    def _can(self, first, c):
        terms, empty = first
        return empty or any(self._fit(t, c) for t in terms)

    def classify(self, tokens):
        """The class of each token: its kind, and its text where the grammar names it."""
        out, words, classes, fold = [], self.words, self.classes, self.fold
        for kind, text, _, _ in tokens:
            if fold:
                text = text.lower()
            key = (kind, text) if text in words else kind
            c = classes.get(key)
            if c is None:
                c = classes[key] = len(classes)
                self.samples.append(Token(kind, text if text in words else "\0", 0, False))
            out.append(c)
        return out

    def parse(self, tokens):
        """Raise SyntaxIssue unless the tokens, which end with an END token, are wholly a `start`. Returns the run, with the `spans` of the rules in `keep` where the start is a list of items."""
        run = _Run(self, tokens)
        top = self.trees[self.names[self.start]]
        if top[0] == "*" and top[1][0] == "rule":  # a list of items: what lies before a finished item is never read again
            end = 0
            while tokens[end].kind != "END" and (j := run.rule(top[1][1], end)) > end:
                end = j
                run.forget()
        else:
            end = run.rule(self.names[self.start], 0)
        if end < 0 or tokens[end].kind != "END":
            at = min(max(run.far, end), len(tokens) - 1)
            t = tokens[at]
            raise SyntaxIssue(f"unexpected {t.text!r}" if t.kind != "END" else "unexpected end", t.line)
        return run


class _Run:
    def __init__(self, grammar, tokens):
        self.g, self.tokens, self.far = grammar, tokens, 0
        self.classes = grammar.classify(tokens)
        self.chart = [{} for _ in grammar.trees]
        self.spans = {}

    def forget(self):
        """Empty the chart, but for the spans of the rules that the grammar keeps."""
        for name in self.g.keep:
            self.spans.setdefault(name, []).extend((i, j) for i, j in self.chart[self.g.names[name]].items() if j >= 0)
        for c in self.chart:
            c.clear()

    def rule(self, r, i):
        """The end of a rule that begins at token i, or -1. The stack holds where a rule returns to (pc, i, rule), what else a choice may try
        (pcs, i, None), where a loop ends (pc, i, None), and lookahead (pc, i, sign)."""
        g = self.g
        code, entry, fits, begins, classes, chart, tokens, far = g.code, g.entry, g.fits, g.begins, self.classes, self.chart, self.tokens, self.far
        stack = [(-1, i, r)]
        pc = entry[r]
        chart[r][i] = -1
        while True:
            op, a, b = code[pc]
            if op == TERM:
                c = classes[i]
                ok = fits[a].get(c)
                if ok or ok is None and g._fit(a, c):
                    i += 1
                    pc += 1
                    continue
                if i > far:
                    far = i
            elif op == CALL:
                j = chart[a].get(i)
                if j is None:
                    c = classes[i]
                    ok = begins[a].get(c)
                    if ok is None:
                        ok = begins[a][c] = g._can(b, c)
                    if ok:
                        chart[a][i] = -1  # a rule that begins with itself at the same place does not match
                        stack.append((pc + 1, i, a))
                        pc = entry[a]
                        continue
                    if i > far:
                        far = i
                elif j >= 0:
                    i = j
                    pc += 1
                    continue
            elif op == PRED:
                c = classes[i]
                go = a.get(c)
                if go is None:
                    go = tuple(p for p, first in b if g._can(first, c))
                    if len(go) == 1 and code[go[0]][0] == COMMIT:
                        go = code[go[0]][1]  # nothing optional begins here
                    a[c] = go
                if go.__class__ is int:
                    pc = go
                    continue
                if go:
                    stack.append((go[1:], i, None))
                    pc = go[0]
                    continue
                if i > far:
                    far = i
            elif op == COMMIT:
                stack.pop()
                pc = a
                continue
            elif op == RET:
                pc, at, rule = stack.pop()
                chart[rule][at] = i
                if pc < 0:
                    self.far = far
                    return i
                continue
            elif op == LOOP:
                c = classes[i]
                ok = a.get(c)
                if ok is None:
                    ok = a[c] = g._can(b[0], c)
                if ok:
                    stack.append((b[1], i, None))
                    pc += 1
                else:
                    if i > far:
                        far = i
                    pc = b[1]
                continue
            elif op == NEXT:
                _, at, _ = stack.pop()
                pc = a if i > at else b
                continue
            elif op == LOOK:
                stack.append((b, i, a))  # a: True for &, False for !
                pc += 1
                continue
            elif op == LOOKED:
                _, i, _ = stack.pop()
                if a:
                    pc = b
                    continue
            else:  # TEST of a place
                if a(tokens, i) >= 0:
                    pc += 1
                    continue
                if i > far:
                    far = i
            while True:  # what did not fit: back to the last choice that has more to try
                x, i, mark = stack.pop()
                if mark is None:
                    if x.__class__ is int:
                        pc = x
                        break
                    if x:
                        stack.append((x[1:], i, None))
                        pc = x[0]
                        break
                elif mark is False:
                    pc = x
                    break
                elif mark is not True and x < 0:
                    self.far = far
                    return -1
