"""Markup residue in text documents (problem 4): families of markup per document, and conversion to clean text.

Both rest on labelling by a minimum cut. The pieces of a text that look like markup are labelled markup or plain, its blocks content or
boilerplate. What a classifier (markup_model) gives as the cost of each label is the capacity of a node's terminal edges; neighbours in the
text and in the element tree share edges; the maximum flow gives the cheapest labelling. Pieces and blocks share no edge, so the two
cuts are components of one graph and are solved apart: the families need the first only."""
import html
import re
from collections import deque
from typing import NamedTuple

from .common import of_kind, per_text
from .markup_model import block_weights, costs, piece_weights

FAMILIES = ("html", "latex", "markdown", "wiki")

TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup data dd del details dfn "
    "dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map "
    "mark marquee menu meta nav noframes noscript object ol optgroup option p param picture pre q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg "
    "table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr o:p v:shape").split()
_ATTRS = r"(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+)|\s+(?:nowrap|disabled|checked|selected|noshade|compact|hidden|async|defer|open|reversed|controls|required|readonly|multiple))*"
_TAG = r"(?i:<(?:/\s*)?(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")" + _ATTRS + r"\s*/?>|<!doctype\s+html[^>]*>|<!--[\s\S]*?-->|<(?:a|font|img|div|span|table|td|th|p)\s+[a-z-]+\s*=\s*[^<>\s]+)"
_ENTITY = r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{2,7}|#[xX][0-9A-Fa-f]{2,6});"

#: Families' own ways to show text as it is: what stands inside belongs to no other family.
CODE_BLOCKS = {
    "markdown": re.compile(r"(?ms)^[ ]{0,3}(?P<f>`{3,}|~{3,})[^\n]*\n.*?(?:^[ ]{0,3}(?P=f)[`~]*[ \t]*$|\Z)"),
    "html": re.compile(r"(?is)<(?P<t>pre|code|script|style|textarea|xmp|samp|kbd)(?:\s[^<>]*)?>.*?(?:</(?P=t)\s*>|\Z)"),
    "wiki": re.compile(r"(?is)<(?P<t>nowiki|syntaxhighlight|source|math)(?:\s[^<>]*)?>.*?(?:</(?P=t)\s*>|\Z)"),
    "latex": re.compile(r"(?s)\\begin\{(?P<t>verbatim\*?|lstlisting|minted|alltt|Verbatim|comment)\}.*?(?:\\end\{(?P=t)\}|\Z)|\\verb\*?(?P<d>[^\w\s]).*?(?P=d)"),
}

LATEX = re.compile(
    r"""(?x)\\(?:documentclass|usepackage|begin|end|(?:sub)*section|chapter|paragraph|part|title|author|date|maketitle|textbf|textit|texttt|textsc|textsf|textrm|emph|underline|footnote|cite[pt]?|ref|eqref|pageref
      |label|item|caption|includegraphics|href|url|input|include|newcommand|renewcommand|def|frac|dfrac|sqrt|sum|int|prod|hat|bar|tilde|vec|mathbb|mathbf|mathrm|mathcal|left|right|alpha|beta|gamma|delta|epsilon
      |varepsilon|theta|lambda|mu|nu|pi|rho|sigma|tau|phi|varphi|chi|psi|omega|Gamma|Delta|Theta|Lambda|Sigma|Phi|Psi|Omega|leq?|geq?|neq|approx|times|cdot|pm|infty|partial|ldots|dots|quad|qquad|hline|toprule|midrule
      |bottomrule|noindent|newpage|clearpage|pagebreak|linebreak|newline|vspace|hspace|hfill|vfill|centering|tableofcontents|bibliography|bibitem|multicolumn|multirow|small|large|Large|huge|tiny|bfseries|itshape|em|bf|it|tt
      |par|medskip|bigskip|smallskip|phantom|text|operatorname|S|ss|ae|oe|LaTeX|TeX|today|thanks|appendix|index|marginpar|footnotemark)(?![A-Za-z])(?<!:\\temp)
    |\\[%&\#_{}$](?=[\s\w.,;:)\]\\]|$)|\\[`'^"~=.][A-Za-z{]|\\[()\[\]](?!\w:)|(?<=\S)[ ]\\\\[ ]*(?:\n|$|\\)|~\\\w+|\{\\\w+""")
#: Inside of a pair of dollars on one line that is a formula, and other formulas between dollars.
_FORMULA = re.compile(r"\\[A-Za-z]+|[_^]\{|[A-Za-z\d]\s*+[_^]\s*+\w|[a-zA-Z]\s*+=")
_DISPLAY = re.compile(r"\$\$(?=[^$])[^$]++\$\$")
WIKI = re.compile(
    r"""(?xm)^={2,6}[^=\n].*?={2,6}[ \t]*$|'''[^'\n]+?'''|(?<!')''(?!')[^'\n]+?''(?!')|\[\[[^\[\]\n]++\]\]|\{\{(?!\s*(?:secrets|\$))[^{}\n]++\}\}|^\{\|.*$|^\|\}[ \t]*$|^\|-+[ \t]*$
    |(?i:^\#redirect\b)|__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX|NEWSECTIONLINK|NOGALLERY|HIDDENCAT)__|\[https?://[^\s\]]+(?:\s[^\]\n]*)?\](?!\()|(?<=[^\n~])~{3,5}(?!~)[ \t]*$
    |(?i:<(?:/\s*)?(?:ref|nowiki|syntaxhighlight|references|gallery|noinclude|includeonly|onlyinclude|poem|math|hiero|score|timeline|templatestyles)(?:\s[^<>]*|\s*/)?>)|^;[^\n;:]+:[ ]""")
MARKDOWN = re.compile(
    r"""(?xm)^[ ]{0,3}\#{1,6}[ \t]+\S.*$|(?<![\w*\\])\*\*(?=[^\s*])(?:[^*\n]|\*(?!\*))+?(?<=[^\s*])\*\*(?![\w*])|(?<![\w_\\])__(?!(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX)__)(?=[^\s_])[^_\n]+?(?<=[^\s_])__(?![\w_])
    |(?<![\w*\\])\*\*\*(?=[^\s*])[^*\n]+?\*\*\*(?!\w)|(?<![\w*\\/])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*/])|(?<![\w_\\/])_(?=[^\s_])(?:[^_\n]|(?<=\w)_(?=\w))+?(?<=[^\s_])_(?![\w_/])|(?<![`\\])(?P<t>`{1,2})(?!`)(?=\S)[^`\n]+?(?P=t)(?!`)
    |!?\[[^\[\]\n]*\]\((?=[^)\s])[^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|(?<!\[)\[[^\[\]\n]+\]\[[^\[\]\n]*\]|^[ ]{0,3}\[\^?[^\[\]\n]+\]:[ \t]+\S|\[\^[\w-]+\]|^[ ]{0,3}>[ \t]?\S|(?<![~\\])~~(?=[^\s~])[^~\n]+?~~(?!~)
    |^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]|^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$|^[ ]{0,3}(?:`{3,}|~{3,})[\w+-]*[ \t]*$|<https?://[^<>\s]+>|(?<!\[)\[[^\[\]\n]+\]\[\]""")
#: What a text must hold before the patterns of a family are tried on it.
_WIKI_SIGNS = ("==", "''", "[[", "{{", "{|", "|}", "|-", "__", "[http", "~~~", "<", "#", "\n;")
_MARKDOWN_SIGN = re.compile(r"(?m)[#*`\[>~|]|(?<!\w)_|^[ \t]*[-+]|<http")
_UNDERLINE = re.compile(r"(?m)^(?:=+|-+)[ \t]*$")


def _setext(text):
    """(start, heading, underline) of the lines that are underlined, first lines of a paragraph only."""
    for m in _UNDERLINE.finditer(text):
        if m.start() < 2:
            continue
        a = text.rfind("\n", 0, m.start() - 1) + 1
        h = text[a : m.start() - 1]
        if (not a or text.endswith("\n\n", 0, a)) and re.search(r"\w", h):
            yield a, h.strip(), m[0].strip()


def _blank(text, spans):
    """The text with spans blanked out, line ends kept."""
    out, last = [], 0
    for a, b in sorted(spans):
        if a < last:
            a = last
        if b <= a:
            continue
        out += [text[last:a], re.sub(r"[^\n]", " ", text[a:b])]
        last = b
    return "".join([*out, text[last:]])


def code_regions(text):
    """(start, end, family) of the code blocks, outermost first: the block that begins first hides what begins inside it."""
    marks = sorted((m.start(), m.end(), f) for f, rx in CODE_BLOCKS.items() for m in rx.finditer(text) if m.end() > m.start())
    out, last = [], 0
    for a, b, f in marks:
        if a >= last:
            out.append((a, b, f))
            last = b
    return out


class Piece(NamedTuple):
    """A piece of text that looks like markup: its place, family and form, and marks of plain use."""

    start: int
    end: int
    family: str
    form: str
    marks: tuple
    text: str


#: Paths of files, whose separators look like commands.
_PATHS = re.compile(r"(?m)[A-Za-z]:(?:\\[\w .-]+)+|(?:(?<=\s)|^)\\\\[\w.-]+(?:\\[\w.-]+)*")
_WIKI_FORMS = {"==": "heading", "''": "emphasis", "[[": "link", "{{": "template", "{|": "table", "|}": "table", "|-": "table", "__": "directive", "~~": "signature"}
_MARKDOWN_FORMS = {"#": "heading", "[": "link", "!": "link", ">": "quote", "|": "table", ":": "table", "<": "link", "-": "rule", "+": "rule", "=": "rule", "~": "strike"}


def _blanked(m):
    return re.sub(r"[^\n]", " ", m[0])


def formulas(text):
    """(start, end) of the formulas between dollars. A pair of single dollars lies on one line; each dollar is looked at once."""
    out, free = [], 0
    display = [m.span() for m in _DISPLAY.finditer(text)] if "$$" in text else []
    for line in re.finditer(r"[^\n]*\$[^\n]*", text):
        at = [line.start() + m.start() for m in re.finditer(r"(?<!\\)\$", line[0])]
        for a, b in zip(at, at[1:], strict=False):
            if a < free or b == a + 1:
                continue
            body = text[a + 1 : b]
            before, after = text[a - 1 : a], text[b + 1 : b + 2]
            if body[0].isspace() or body[-1].isspace() or re.match(r"[$\w]", before) or after == "$" or after.isdigit():
                continue
            if _FORMULA.search(body) or len(body) == 1 and body.isascii() and body.isalpha():
                out.append((a, b + 1))
                free = b + 1
    inner = set(x for a, b in display for x in (a, b))
    return sorted(display + [x for x in out if not inner or not any(a <= x[0] < b for a, b in display)])


def candidates(text):
    """The pieces that look like markup of a family. Code blocks speak for their own family only. Null and empty texts have none."""
    if not text:
        return []
    out = []
    code = code_regions(text)
    for a, b, f in code:
        out.append(Piece(a, b, f, "code", (), text[a : min(b, a + 40)]))
    rest = _blank(text, [(a, b) for a, b, _ in code])
    wiki_doc = bool(re.search(r"(?m)^={2,6}[^=\n].*={2,6}[ \t]*$|^\{\||^'''", rest))
    if wiki_doc:  # lines after a blank are shown as they are
        pre = [(m.start(), m.end()) for m in re.finditer(r"(?m)^ [^\n|!*#:;]*\S[^\n]*$", rest) if not re.match(r" +[-*]\s", m[0])]
        rest = _blank(rest, pre)
    ticks = [(m.start(), m.end()) for m in re.finditer(r"(?<![`\\])(`{1,2})(?!`)[^`\n]+?\1(?!`)", rest)] if "`" in rest else ()
    bare = _blank(rest, ticks) if ticks else rest

    def add(m, family, form, *marks):
        out.append(Piece(m.start(), m.end(), family, form, marks, m[0]))

    for m in re.finditer(_TAG, bare) if "<" in bare else ():
        add(m, "html", "comment" if m[0].startswith("<!") else "tag")
    for m in re.finditer(_ENTITY, bare) if "&" in bare else ():
        add(m, "html", "entity", *(("unknown",) if html.unescape(m[0]) == m[0] else ()))
    tagged = re.sub(r"<!--[\s\S]*?-->", _blanked, bare) if "<!--" in bare else bare
    sums = formulas(tagged) if "$" in tagged else []
    if "\\" in tagged:
        paths = iter([x.span() for x in _PATHS.finditer(tagged)])
        path = next(paths, None)
        for m in LATEX.finditer(tagged):
            while path and path[1] <= m.start():
                path = next(paths, None)
            add(m, "latex", "break" if re.match(r"\\\\?$", m[0].strip()) else "command", *(("in a path",) if path and path[0] < m.start() and not tagged.startswith("{", m.end()) else ()))
    for a, b in sums:
        out.append(Piece(a, b, "latex", "formula", (), tagged[a:b]))
    if not any(p.family == "latex" and p.form != "break" and not p.marks for p in out):
        out = [p._replace(marks=(*p.marks, "alone")) if p.form == "break" else p for p in out]
    for m in WIKI.finditer(bare) if any(x in "\n" + bare for x in _WIKI_SIGNS) else ():
        add(m, "wiki", _WIKI_FORMS.get(m[0][:2], "other"))
    no_math = _blank(rest, sums) if sums else rest
    no_tags = re.sub(_TAG, _blanked, no_math) if "<" in no_math else no_math
    for m in MARKDOWN.finditer(no_tags) if _MARKDOWN_SIGN.search(no_tags) else ():
        s = m[0]
        t = s.lstrip()
        strong = t[0] in "*_" and t[:1] == t[1:2]
        marks = []
        if wiki_doc and re.match(r"\s{0,3}#{1,6}\s", s):
            marks.append("numbered")  # a list there
        if s.startswith("[http") and re.match(r"\[\^?[^\]]+\]", s):
            marks.append("bracketed address")
        if s[0] in "*_" and s[1] not in "*_" and re.search(r"\d\s*\*|\*\s*\d", s):
            marks.append("product")
        if not s.startswith(("#", "[", "!", "|", ">", "`")) and LATEX.search(s):
            marks.append("commands inside")
        add(m, "markdown", "strong" if strong else "emphasis" if t[0] in "*_" else "code" if t[0] == "`" else _MARKDOWN_FORMS.get(t[0], "other"), *marks)
    for a, h, u in _setext(no_tags):
        if len(u) >= 3 and not h.startswith(("|", "#", "<", "-", "*")):
            at = no_tags.index(u, a + len(h))
            out.append(Piece(at, at + len(u), "markdown", "underline", (), u))
    return out


def features(piece):
    """Names of what the classifier knows about a piece."""
    return ("any", piece.family, f"{piece.family} {piece.form}", *(f"mark {m}" for m in piece.marks), *(("marked",) if piece.marks else ()))


#: Weights of the edges between pieces: neighbours of a family in the text (by lines between them), the two tags of an element, and
#: neighbours under the same parent element.
NEAR, PAIR, SIBLINGS = 0.3, 1.0, 0.3
_scores = {}


def _score(piece):
    key = (piece.family, piece.form, piece.marks)
    got = _scores.get(key)
    if got is None:
        w = piece_weights()
        got = _scores[key] = sum(w.get(f, 0.0) for f in features(piece))
    return got


def marked(text):
    """The pieces labelled markup, by the minimum cut. Where the classifier gives all pieces the same label, no border can be cheaper."""
    found = candidates(text)
    scores = [_score(p) for p in found]
    if not scores or min(scores) > 0:
        return found
    if max(scores) <= 0:
        return []
    edges = {}

    def add(i, j, w):
        k = (min(i, j), max(i, j))
        edges[k] = edges.get(k, 0.0) + w

    order = sorted(range(len(found)), key=lambda k: (found[k].start, k))
    before, open_, last = {}, [], {}
    for i in order:
        p = found[i]
        if p.family in before:
            j = before[p.family]
            add(i, j, NEAR / (1 + text.count("\n", found[j].start, p.start)))
        before[p.family] = i
        if p.form == "tag":
            m = re.match(r"<\s*(/?)\s*([\w:]+)", p.text)
            parent = open_[-1][0] if open_ else -1
            if m and m[1]:
                k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][1] == m[2].lower()), None)
                if k is not None:
                    add(i, open_[k][0], PAIR)
                    del open_[k:]
            elif m:
                if parent in last:
                    add(i, last[parent], SIBLINGS)
                last[parent] = i
                if m[2].lower() not in ("br", "hr", "img", "input", "meta", "link", "col", "wbr") and not p.text.endswith("/>"):
                    open_.append((i, m[2].lower()))
    price = [costs(z) for z in scores]
    keep = min_cut([a for a, _ in price], [b for _, b in price], edges)
    return [p for p, yes in zip(found, keep, strict=True) if yes]


def evidence(text):
    """{family: pieces of its markup}."""
    found = {f: [] for f in FAMILIES}
    for p in marked(text):
        found[p.family].append(p.text)
    return found


def families(text):
    """The families of markup a text holds, in alphabetical order."""
    have = {p.family for p in marked(text)}
    return [f for f in FAMILIES if f in have]


# ---- conversion -----------------------------------------------------------------------------------------------------------------

#: Weights of the edges between blocks: neighbours in the text, less by each step between their elements, and neighbours under one parent
#: element or heading.
NEXT, SIBLING = 0.6, 0.5
_OUTSIDE = frozenset("nav footer aside menu form head script style noscript button select option iframe".split())
#: Elements that make the tree of a document besides the former.
_CONTAINERS = frozenset("body main article section header div blockquote ul ol dl table figure details fieldset".split())
_TAIL = re.compile(r"(?i)^©|^(?:copyright|all rights reserved|cookie|privacy|terms of use|imprint|impressum|back to top|skip to|share this|print this|log ?in|sign in)\b")


def min_cut(content, boiler, edges):
    """Labels (True: content) of least cost. `content[i]` is the cost of calling i content, `boiler[i]` of calling it boilerplate,
    `edges` {(i, j): weight} the cost of a border between i and j. Dinic's maximum flow on a graph of n + 2 nodes."""
    n = len(content)
    s, t = n, n + 1
    to, cap, adj = [], [], [[] for _ in range(n + 2)]

    def add(a, b, c, back=0.0):
        adj[a].append(len(to))
        to.append(b)
        cap.append(c)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        common = min(content[i], boiler[i])
        if boiler[i] > common:
            add(s, i, boiler[i] - common)
        if content[i] > common:
            add(i, t, content[i] - common)
    for (a, b), w in edges.items():
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        q = deque([s])
        while q:
            u = q.popleft()
            for e in adj[u]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    q.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        while True:  # one augmenting path of the level graph after the other, without recursion
            path, u = [], s
            while u != t:
                while at[u] < len(adj[u]):
                    e = adj[u][at[u]]
                    if cap[e] > 1e-12 and level[to[e]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] == len(adj[u]):
                    if not path:
                        break
                    e = path.pop()
                    u = to[e ^ 1]
                    at[u] += 1
                    continue
                path.append(adj[u][at[u]])
                u = to[adj[u][at[u]]]
            if u != t:
                break
            f = min(cap[e] for e in path)
            for e in path:
                cap[e] -= f
                cap[e ^ 1] += f


def _plain_html(text):
    text = re.sub(r"<!--[\s\S]*?-->", " ", text)
    text = re.sub(r"(?is)<(script|style|textarea|title|template)(?:\s[^<>]*)?>.*?</\1\s*>", "\n\n", text)
    text = re.sub(r"(?i)<!doctype[^>]*>", "", text)

    def tag(m):
        close, name = m[0][1:2] == "/", re.match(r"</?\s*([\w:]+)", m[0])
        name = name[1].lower() if name else ""
        if name in _OUTSIDE or name in _CONTAINERS:
            return f"\n\n\x03{'/' if close else ''}{name}\x04"
        if re.fullmatch(r"h[1-6]", name):
            return "\n\n" if close else f"\n\n\x01h{name[1]}\x02"
        if name == "li":
            return "" if close else "\n\x01l1\x02"
        if name in ("td", "th"):
            return " | " if close else ""
        if name == "tr":
            return "\n" if close else "\n\x01t1\x02"
        if name == "br":
            return "\n"
        if name in ("p", "dt", "dd", "hr", "html", "pre"):
            return "\n\n"
        return ""

    return html.unescape(re.sub(_TAG, tag, text))


def _plain_latex(text):
    text = re.sub(r"(?m)(?<!\\)%.*$", "", text)
    text = re.sub(r"\\(?:documentclass|usepackage|newcommand|renewcommand|bibliography|input|include|label|vspace|hspace)\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})*", "", text)
    text = re.sub(r"\\title\{([^{}]*)\}", "\n\n\x01h1\x02\\1\n\n", text)
    text = re.sub(r"\\chapter\*?\{([^{}]*)\}", "\n\n\x01h1\x02\\1\n\n", text)
    text = re.sub(r"\\(sub)*section\*?\{([^{}]*)\}", lambda m: f"\n\n\x01h{2 + m[0].count('sub')}\x02{m[2]}\n\n", text)
    text = re.sub(r"(?s)\\begin\{(equation|align|gather|displaymath|eqnarray)\*?\}(.*?)\\end\{\1\*?\}", lambda m: "\n\n\x01f1\x02" + " ".join(m[2].split()) + "\n\n", text)
    text = re.sub(r"(?s)\\\[(.*?)\\\]|\$\$(.*?)\$\$", lambda m: "\n\n\x01f1\x02" + " ".join((m[1] or m[2] or "").split()) + "\n\n", text)
    kept = []

    def keep(m):
        kept.append(m[0])
        return f"\x05{len(kept) - 1}\x06"

    text = re.sub(r"\x01f1\x02[^\n]*|\\\((.*?)\\\)|(?<![\\\w])\$(?=\S)[^$\n]+?(?<=\S)\$(?!\d)", keep, text)
    text = re.sub(r"(?s)\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)\\end\{tabular\}", lambda m: "\n\n" + "".join(f"\x01t1\x02{re.sub(r'(?<!\\)&', ' | ', r.strip())}\n" for r in re.split(r"\\\\", re.sub(r"\\(?:hline|toprule|midrule|bottomrule)", "", m[1])) if r.strip()) + "\n", text)
    text = re.sub(r"\\item(?:\[[^\]]*\])?\s*", "\n\x01l1\x02", text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\{[^{}]*\})?", "\n\n", text)
    text = re.sub(r"\\(?:maketitle|noindent|newpage|clearpage|centering|tableofcontents|hline|par|today|bigskip|medskip|smallskip)\b\s*", "", text)
    for _ in range(4):
        text = re.sub(r"\\(?:cite[pt]?|ref|eqref|pageref)\{([^{}]*)\}", r"[\1]", text)
        text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
        text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\\[A-Za-z]+\*?\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\{\\[A-Za-z]+\s+([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\([%&#_{}$])", r"\1", text)
    text = re.sub(r"\\\\[ \t]*", "\n", text).replace("~", " ")
    return re.sub(r"\x05(\d+)\x06", lambda m: kept[int(m[1])], text)


def _plain_wiki(text):
    for _ in range(4):
        text = re.sub(r"\{\{[^{}]*\}\}", "", text)
    text = re.sub(r"(?i)^\s*#redirect\s*", "", text, flags=re.M)
    text = re.sub(r"__[A-Z]+__", "", text)
    text = re.sub(r"(?is)<ref(?:\s[^<>]*)?/>|<ref(?:\s[^<>]*)?>.*?</ref>", "", text)
    text = re.sub(r"\[\[(?:File|Image|Category|Datei|Kategorie|Fichier|Catégorie|Archivo)\s*:[^\]]*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://[^\s\]]+\s+([^\]\n]*)\]", r"\1", text)
    text = re.sub(r"(?m)^(={1,6})\s*(.*?)\s*\1\s*$", lambda m: f"\n\n\x01h{len(m[1])}\x02{m[2]}\n\n", text)
    text = re.sub(r"'{2,5}", "", text)
    text = re.sub(r"(?s)^\{\|.*?^\|\}", lambda m: "\n\n" + "".join(
        f"\x01t1\x02{' | '.join(c for c in (x.strip() for x in re.split(r'(?m)^[|!]|\|\||!!', row)) if c)}\n" for row in re.split(r"(?m)^\|-.*$|^\{\|.*$|^\|\}", m[0]) if row.strip()) + "\n", text, flags=re.M)
    text = re.sub(r"(?m)^[*#]+\s+", "\n\x01l1\x02", text)
    text = re.sub(r"(?m)^;\s*([^:\n]+)\s:\s", r"\1: ", text)
    text = re.sub(r"(?m)^:+\s+", "\n\x01f1\x02", text)
    return re.sub(r"(?<=[^\n~])~{3,5}[ \t]*$", "", text, flags=re.M)


def _plain_markdown(text):
    for at, h, u in reversed([x for x in _setext(text) if "|" not in x[1] and "\x01" not in x[1] and len(x[2]) >= 3]):
        end = text.index(u, at + len(h)) + len(u)
        text = f"{text[:at]}\n\n\x01h{1 if u[0] == '=' else 2}\x02{h}\n\n{text[end:]}"
    text = re.sub(r"(?m)^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*$", lambda m: f"\n\n\x01h{len(m[1])}\x02{m[2]}\n\n", text)
    text = re.sub(r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$", "", text)
    text = re.sub(r"(?m)^[ \t]*\|(.*?)\|?[ \t]*$", lambda m: "\x01t1\x02" + " | ".join(x.strip() for x in m[1].split("|")), text)
    text = re.sub(r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+(?:\[[ xX]\][ \t]+)?", "\n\x01l1\x02", text)
    text = re.sub(r"(?m)^ {0,3}>[ \t]?", "", text)
    text = re.sub(r"(?m)^ {0,3}\[(\^?[^\[\]\n]+)\]:[ \t]+(\S.*)$", lambda m: m[2] if m[1][0] == "^" else "", text)
    text = re.sub(r"!\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1", text)
    text = re.sub(r"\[([^\[\]\n]*)\](?:\([^()\n]*\)|\[[^\[\]\n]*\])", r"\1", text)
    text = re.sub(r"\[\^[\w-]+\]", "", text)
    for rx in (r"\*{1,3}(?=\S)([^*\n]+?)(?<=\S)\*{1,3}", r"(?<!\w)_{1,3}(?=\S)([^\n]+?)(?<=\S)_{1,3}(?!\w)", r"~~(?=\S)([^~\n]+?)~~", r"`{1,2}([^`\n]+)`{1,2}"):
        text = re.sub(r"(?<![\w\\])" + rx if rx[0] == "\\" else rx, r"\1", text)
    return text


def blocks(text):
    """[(kind, level, text, place, path)] of a document: heading, paragraph, list, code, formula or table row; the outer element it stands in,
    and its path in the tree: the numbers of the open elements, or of the headings above it where a document has no elements."""
    if not text:
        return []
    text = re.sub(r"[\x01-\x08]", "", text)  # used as marks below
    ev = evidence(text)
    code, parts, last = code_regions(text), [], 0
    shown = []
    for a, b, f in code:
        raw = text[a:b]
        parts.append(text[last:a])
        last = b
        if f == "html" and re.match(r"(?i)<(?:script|style|textarea|xmp)", raw):
            continue
        body = re.sub(r"(?s)^[ ]{0,3}(?:`{3,}|~{3,})[^\n]*\n|\n?[ ]{0,3}(?:`{3,}|~{3,})[ \t]*$", "", raw) if f == "markdown" else re.sub(r"(?is)^(?:<(?:pre|code|syntaxhighlight|source|nowiki|math|samp|kbd)[^<>]*>\s*)+|(?:</(?:pre|code|syntaxhighlight|source|nowiki|math|samp|kbd)\s*>\s*)+$", "", raw) if f in ("html", "wiki") else re.sub(r"(?s)^\\begin\{[^{}]*\}\n?|\n?\\end\{[^{}]*\}$|^\\verb\*?.|.$(?<=\\verb)", "", raw)
        shown.append(html.unescape(body) if f == "html" else body)
        parts.append(f"\n\n\x01c{0}\x02\x05{len(shown) - 1}\x06\n\n")
    t = "".join([*parts, text[last:]])
    if ev["latex"]:
        t = t.replace("\x05", "\x07").replace("\x06", "\x08")
        t = _plain_latex(t).replace("\x07", "\x05").replace("\x08", "\x06") if re.search(r"\\(?:documentclass|begin|section|textbf|emph|item|[%_&]|noindent|newpage|footnote|cite|ref|em\b)|\{\\", t) else t
    if ev["wiki"]:
        t = _plain_wiki(t)
    if ev["html"]:
        t = _plain_html(t)
    if ev["markdown"]:
        t = _plain_markdown(t)
    out, open_, heads, n = [], [], [], 0
    for chunk in re.split(r"\n\s*\n|\n(?=\x01)", t):
        after = []
        body_seen = False
        for m in re.finditer(r"\x03([^\x04]*)\x04|[^\x03\s]", chunk):
            if m[1] is None:
                body_seen = True
            elif body_seen:
                after.append(m[1])  # what closes or opens behind the block's text
            else:
                n = _step(open_, m[1], n)
        chunk = re.sub(r"\x03[^\x04]*\x04", "", chunk).strip()
        m = re.match(r"\x01([hlcft])(\d)\x02", chunk)
        body = re.sub(r"\x01[hlcft]\d\x02", "", chunk)
        kind = {"h": "heading", "l": "list", "c": "code", "f": "formula", "t": "table"}[m[1]] if m else "paragraph"
        body = re.sub(r"\x05(\d+)\x06", lambda x: shown[int(x[1])], body)
        if kind != "code":
            body = "\n".join(" ".join(x.split()) for x in body.split("\n")).strip(" |\n")
        if re.search(r"\w", body):
            if kind == "heading":
                n += 1
                while heads and heads[-1][0] >= int(m[2]):
                    heads.pop()
                heads.append((int(m[2]), n))
            path = tuple(k for _, k in open_) or tuple(k for _, k in heads)
            place = next((x for x, _ in reversed(open_) if x in _OUTSIDE), "")
            out.append((kind, int(m[2]) if m else 0, body, place, path))
        for x in after:
            n = _step(open_, x, n)
    return out


def _step(open_, mark, n):
    """Follow a tag in the list of open elements (name, number); returns the last number given."""
    if not mark.startswith("/"):
        open_.append((mark, n + 1))
        return n + 1
    for k in range(len(open_) - 1, -1, -1):
        if open_[k][0] == mark[1:]:
            del open_[k:]
            break
    return n


def block_features(kind, place, body):
    """What the classifier knows about a block."""
    words = re.findall(r"\w+", body)
    links = len(re.findall(r"https?://|www\.|»|\s\|\s", body)) if kind != "table" else 0
    return [
        1.0, min(1.0, len(words) / 8), float(len(words) < 3 and kind == "paragraph"), min(3.0, links / max(1, len(words)) * 8), float(place in _OUTSIDE), float(bool(_TAIL.search(body))), float(kind in ("code", "formula", "table")), float(kind in ("heading", "list")),
        float(body[-1:] in ".!?:" and kind == "paragraph")]


def _distance(a, b):
    """Steps between two places of the tree."""
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    return len(a) + len(b) - 2 * k


def labelled(text):
    """Blocks with their label: [(kind, level, text, keep)], by the minimum cut over their costs.

    Neighbours in the text are tied by how near they are in the tree; so are neighbours under one parent, and under one grandparent,
    whatever stands between them."""
    b = blocks(text)
    if not b:
        return []
    w = block_weights()
    price = [costs(sum(x * y for x, y in zip(w, block_features(kind, place, body), strict=True))) for kind, _, body, place, _ in b]
    edges, last = {}, {}

    def add(i, j, v):
        edges[i, j] = edges.get((i, j), 0.0) + v

    for i, (kind, _, _, _, path) in enumerate(b):
        if i:
            add(i - 1, i, NEXT / (1 + _distance(b[i - 1][4], path)) + (SIBLING if b[i - 1][0] == kind and b[i - 1][4] == path else 0))
        for up, v in ((path, SIBLING), (path[:-1], SIBLING / 2)):
            j = last.get((len(path) - len(up), up))
            if j is not None and j < i - 1:
                add(j, i, v)
            last[len(path) - len(up), up] = i
    keep = min_cut([yes for yes, _ in price], [no for _, no in price], edges)
    return [(kind, level, body, k) for (kind, level, body, *_), k in zip(b, keep, strict=True)]


def clean(text):
    """Clean text: content blocks in order, headings on lines of their own, list items after '• ', code indented by four blanks, table cells
    set apart by ' | ', formulas as they were written. A text without markup stays as it is; null gives null."""
    if text is None or not any(evidence(text).values()):
        return text
    out, before = [], None
    for kind, _, body, keep in labelled(text):
        if not keep:
            continue
        if kind == "code":
            body = "\n".join("    " + x for x in body.strip("\n").split("\n"))
        elif kind == "list":
            body = "• " + body
        out.append(("" if before is None else "\n" if before == kind and kind in ("list", "table") else "\n\n") + body)
        before = kind
    return "".join(out)


def docs_rows(files):
    """Read rows that may be files of docs sources."""
    return files.where("text is not null and (kind = 'docs' or kind is null)")


def found(files, sources):
    """(source, rel, markup): one row per file of a docs source and family; repeated rows count once. Whole texts are read."""

    def rows(source, rel, text, kind):
        return [(source, rel, f, kind) for f in families(text)]

    x = per_text(docs_rows(files), "source string, rel string, markup string, kind string", rows, keys=("source", "rel"), extra=("text", "kind"))
    return of_kind(x, sources, "docs").select("source", "rel", "markup").distinct()


def cleaned(files, sources):
    """(source, rel, markup array, text): each docs file's clean text and the families found in it; repeated rows count once."""

    def rows(source, rel, text, kind):
        return [(source, rel, families(text), clean(text), kind)]

    x = per_text(docs_rows(files), "source string, rel string, markup array<string>, text string, kind string", rows, keys=("source", "rel"), extra=("text", "kind"))
    return of_kind(x, sources, "docs").drop("kind").dropDuplicates(["source", "rel"])
