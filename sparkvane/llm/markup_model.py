"""Classifiers of the minimum-cut labelling (problem 4): logistic regressions fitted on the labelled snippets bundled here.

One tells markup from characters used with their plain meaning, for pieces of text that look like markup; the other tells content from
boilerplate, for blocks. Both are fitted once in a worker, in milliseconds, by the same data everywhere. Their log-probabilities are the
capacities of the terminal edges."""
import functools
import math

import numpy as np

#: Snippets with the families of markup in them. What looks like markup of another family there is used plainly.
PIECES = [
    # html
    ("<p>One <b>two</b> three.</p>", "html"), ("<!DOCTYPE html><html><body>x</body></html>", "html"), ("a<br>b<br/>c", "html"), ("<!-- note --> text", "html"), ("AT&amp;T and &nbsp; more", "html"), ("5 &lt; 6 &#8212; seven", "html"),
    ("<div class=\"a\">x</div>", "html"), ("<a href='u'>link</a>", "html"), ("<table><tr><td>1</td></tr></table>", "html"), ("<pre>x = 1</pre>", "html"), ("<ul>\n<li>one\n<li>two\n</ul>", "html"), ("rows with &foo; in them", ""),
    ("a &xyzzy; b &q12; c", ""), ("R&D; and S&P; only", ""), ("x < y and y > z", ""), ("if a <b then c", ""), ("map<string, int> of keys", ""), ("H<sub>2</sub>O", "html"), ("<img src=\"x.png\" alt=\"y\"/>", "html"), ("write to <team@example.invalid> today", ""),
    # latex
    ("\\documentclass{article}\n\\begin{document}\nx\n\\end{document}", "latex"), ("\\section{One}\nText \\textbf{bold}.", "latex"), ("The rate $\\alpha_1$ is low.", "latex"), ("$$x = y^2$$", "latex"), ("\\[ a + b \\]", "latex"), ("5\\% of cases", "latex"),
    ("see \\cite{x} and \\ref{y}", "latex"), ("a \\\\\nb \\emph{c}", "latex"), ("\\begin{itemize}\n\\item a\n\\end{itemize}", "latex"), ("caf\\'e and na\\\"ive", "latex"), ("{\\bf bold} words", "latex"), ("Fig.~\\ref{a}", "latex"), ("\\begin{verbatim}\n# x\n\\end{verbatim}", "latex"),
    ("in C:\\data\\text\\alpha\\beta files", ""), ("D:\\item\\ref\\label\\part", ""), ("open C:\\tau\\phi now", ""), ("E:\\new\\times\\sum\\in", ""), ("on \\\\server\\input\\omega share", ""), ("\\\\files\\title\\date\\section here", ""), ("path F:\\par\\it\\em ends", ""),
    ("at G:\\text\\def\\input\\ref", ""), ("a value \\\\\nand the next", ""), ("end of row \\\\\nrow \\\\\n", ""), ("one \\\\\ntwo", ""), ("costs $5 and $6", ""), ("from $10 to $20 a day", ""), ("cost $x$ per unit $y_1$", "latex"), ("C:\\temp holds \\textit{it}", "latex"),
    # wiki
    ("== Heading ==\ntext", "wiki"), ("'''Bold''' start", "wiki"), ("''italic'' word", "wiki"), ("see [[Page|text]]", "wiki"), ("{{Infobox|a=1}}", "wiki"), ("{|\n|-\n| a\n|}", "wiki"), ("#REDIRECT [[X]]", "wiki"), ("__NOTOC__\ntext", "wiki"),
    ("[https://x.invalid label] here", "wiki"), ("<ref>Source</ref>", "wiki"), ("thanks ~~~~\n", "wiki"), ("<nowiki>x</nowiki>", "wiki"), ("; term : meaning", "wiki"), ("== A ==\n# one\n# two\n", "wiki"), ("== B ==\n# first step\n# next step\n# last step", "wiki"),
    ("'''C''' list\n# a b\n# c d", "wiki"), ("{|\n|-\n| x\n|}\n# item one\n# item two", "wiki"), ("== D ==\n# alpha\n## beta\n", "wiki"), ("a == b in code", ""), ("it's 'quoted' text", ""),
    # markdown
    ("# Title\n\ntext", "markdown"), ("## Part two\n- x", "markdown"), ("some **bold** text", "markdown"), ("an *emphasised* word", "markdown"), ("an _emphasised_ word", "markdown"), ("use `code` here", "markdown"), ("[a](https://x.invalid)", "markdown"), ("![i](i.png)", "markdown"),
    ("> quoted line", "markdown"), ("- [ ] task\n- [x] done", "markdown"), ("| a | b |\n|---|---|\n| 1 | 2 |", "markdown"), ("```py\nx = 1\n```", "markdown"), ("~~gone~~ now", "markdown"), ("<https://x.invalid/a>", "markdown"), ("[a][1]\n\n[1]: https://x.invalid", "markdown"), ("note[^1]\n\n[^1]: text", "markdown"),
    ("Title\n=====\n\ntext", "markdown"), ("Part\n----\n\ntext", "markdown"), ("__strong__ words", "markdown"), ("2 *3 and 4* 5", ""), ("5*x + y*6", ""), ("3 *7 of 9* 2", ""), ("the 2 *4 grid, 6* 8", ""), ("*1 of 2 * 3*", ""), ("a_b_c and x_y", ""), ("x * y * z", ""), ("1 *2 + 3* 4 = 9", ""),
    ("a *1*2* b", ""), ("- one\n- two", ""), ("C# and F# code", ""), ("[http://x.invalid]: n", "wiki"), ("[https://y.invalid a]: b", "wiki"), ("*\\alpha* holds", "latex"), ("_\\beta + x_ so", "latex"), ("*\\emph{a} b* c", "latex"), ("**\\textbf{q}** r", "latex"), ("~~\\ref{x}~~ y", "latex"),
]

#: Blocks: kind, place, text and whether it is content.
BLOCKS = [
    ("paragraph", "", "The model was fitted on the portfolio of the last year and checked against the reserve.", 1), ("paragraph", "", "Results were stable in all segments.", 1), ("paragraph", "", "We reviewed the limits of each desk and found no breach in the period under review.", 1),
    ("heading", "", "Introduction", 1), ("heading", "", "Scope and limits", 1), ("heading", "", "Results", 1), ("list", "", "first item of the list", 1), ("list", "", "one", 1), ("list", "", "Check the inputs before each run", 1), ("code", "", "x = fit(data)\nprint(x)", 1), ("code", "", "SELECT 1", 1), ("formula", "", "$x_1 + y$", 1),
    ("table", "", "a | b", 1), ("table", "", "1 | 2", 1), ("table", "", "Segment | Share | Loss", 1), ("paragraph", "", "Note the date.", 1), ("paragraph", "", "See the annex at https://x.invalid/annex for the full list of the records that were used.", 1), ("paragraph", "", "Approved by the committee on Monday.", 1),
    ("paragraph", "", "Change log of the main script", 1), ("paragraph", "", "Section: Scope", 1), ("paragraph", "", "Note on the retail model, 2021-03", 1), ("paragraph", "", "Formula: 2 * AUC - 1", 1), ("paragraph", "", "the broker book", 1), ("paragraph", "", "chart of rates", 1),
    ("paragraph", "", "Cohort", 1), ("paragraph", "", "Schedule", 1), ("paragraph", "", "auto", 1), ("paragraph", "", "Table 3", 1), ("paragraph", "", "To: all desks", 1), ("paragraph", "", "p = f(b0 + b1 x)", 1), ("paragraph", "", "Open points from the last meeting", 1),
    ("paragraph", "", "Next", 0), ("paragraph", "", "Next » Last »", 0), ("paragraph", "", "www.x.invalid | www.y.invalid", 0), ("paragraph", "", "Back to top", 0), ("paragraph", "", "Copyright 2020 by the owners. All rights reserved.", 0), ("paragraph", "", "© 2021 the authors", 0), ("paragraph", "", "All rights reserved", 0), ("paragraph", "", "Privacy policy | Terms of use", 0),
    ("paragraph", "", "Cookie settings", 0), ("paragraph", "", "Log in | Register | Help", 0), ("paragraph", "", "Home | About | Contact | Search", 0), ("paragraph", "", "Share this page", 0), ("paragraph", "", "Skip to content", 0), ("paragraph", "", "Imprint | Privacy", 0), ("paragraph", "", "Sign in to comment", 0), ("paragraph", "", "Print this page » Mail »", 0),
    ("paragraph", "nav", "home | about", 0), ("list", "nav", "Products", 0), ("list", "nav", "Contact us", 0), ("paragraph", "footer", "Made by the web team.", 0), ("paragraph", "footer", "Questions go to the owners of this page at any time.", 0), ("heading", "aside", "Related", 0), ("paragraph", "aside", "More pages about this subject are listed here.", 0), ("list", "aside", "Another page", 0),
    ("paragraph", "form", "Your name", 0), ("paragraph", "button", "Send", 0), ("list", "menu", "Open file", 0), ("list", "footer", "Terms", 0), ("paragraph", "script", "var x = 1;", 0), ("heading", "nav", "Menu", 0), ("heading", "footer", "About us", 0), ("table", "nav", "a | b", 0), ("paragraph", "select", "Germany", 0), ("paragraph", "nav", "Read all of the articles of the last year here.", 0),
]


def fit(rows, labels, ridge=0.02, steps=60):
    """Weights of a logistic regression with a small ridge penalty, by Newton's method. The result depends on the rows alone."""
    x, y = np.asarray(rows, float), np.asarray(labels, float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        d = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += d
        if np.abs(d).max() < 1e-9:
            break
    return w


def costs(score):
    """(cost of yes, cost of no) of a label with the given log-odds."""
    z = max(-30.0, min(30.0, score))
    return math.log1p(math.exp(-z)), math.log1p(math.exp(z))


@functools.lru_cache(maxsize=1)
def piece_weights():
    """Log-odds weights by feature name of a piece."""
    from .markup import candidates, features

    names, rows, labels = {}, [], []
    for text, families in PIECES:
        for p in candidates(text):
            row = {}
            for f in features(p):
                row[names.setdefault(f, len(names))] = 1.0
            rows.append(row)
            labels.append(p.family in families.split())
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for j, v in r.items():
            x[i, j] = v
    return dict(zip(names, fit(x, labels).tolist(), strict=True))


@functools.lru_cache(maxsize=1)
def block_weights():
    """Log-odds weights of a block's features."""
    from .markup import block_features

    return fit([block_features(k, p, t) for k, p, t, _ in BLOCKS], [y for *_, y in BLOCKS]).tolist()
