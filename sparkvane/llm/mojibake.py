"""Text garbled by a wrong decoding (problem 9): character n-gram models, candidate encode-decode chains, restoration."""
import functools
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import spread

#: How a text may have been read wrongly: (bytes were, were read as). To undo it, encode by the second, decode by the first.
CHAINS = [
    *(("utf-8", w) for w in ("cp1252", "latin-1", "cp437", "cp850", "cp866", "mac_roman", "cp1250", "cp1251", "iso8859_2", "iso8859_15", "cp852", "koi8_r", "cp1254", "mac_cyrillic", "cp1257")),
    *((a, w) for a in ("mac_roman", "cp850", "cp437") for w in ("cp1252", "latin-1", "cp1250", "cp1251")),
    *((a, w) for a in ("cp1252", "cp1250", "iso8859_2") for w in ("cp437", "cp850", "cp852", "mac_roman", "cp866", "cp1251", "koi8_r")),
    *((a, w) for a in ("cp866", "koi8_r", "cp1251", "iso8859_5", "mac_cyrillic") for w in ("cp1251", "cp866", "koi8_r", "cp1252", "latin-1", "cp437", "cp850", "mac_roman", "iso8859_5", "cp1250", "mac_cyrillic") if a != w),
    *(("cp1250", w) for w in ("cp1252", "latin-1")), *(("iso8859_2", w) for w in ("cp1252", "latin-1", "cp1250")), ("cp1252", "cp1250"), ("cp852", "cp1250"), ("cp852", "cp1252"), ("cp852", "latin-1"),
]
_SINGLE = [c for c in CHAINS if c[0] != "utf-8"]
#: Mean gain in log-likelihood for a changed character that a single-byte chain needs, and its least total over a text: the pair that is
#: tried first, and the grid that is searched where it does not hold on held-out records.
MARGIN, TOTAL = 1.5, 8.0
MARGINS, TOTALS = (0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0), (4.0, 6.0, 8.0, 10.0, 12.0, 16.0)
#: The pair holds if at most this share of held-out clean records, or one, would be changed, and at least that share of garbled ones found.
FALSE_AT_MOST, FOUND_AT_LEAST = 0.005, 0.9
#: Gain of a word by misread UTF-8, which is hardly ever valid by chance, and of any chain, from which a word counts as odd.
SURE, STRONG = 1.0, 2.0
#: Mean log-likelihood of a character that restored words reach in a language that a model knows. A language it does not know stays far below.
KNOWN = -2.5
#: Parts of the clean records by hash; the margins are validated on all records, each by a model of the other part.
FOLDS = 2

_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
_WEST = re.compile(r"[ÃÂâÄÅÐÑ][\u0080-¿Œ-˜–-™]|[\u0080-\u0084\u0086-\u009f]|�|[─-╿▀-▟]|[РС][\u0080-¿Ђ-Џђ-џ–-™]|√|‚[ÄÇ]|Γ[\u0080-ÿ]")


@functools.lru_cache(maxsize=None)
def _tables(codec):
    """(bytes of each character, character of each byte) of a single-byte codec; undefined bytes stand for the control of the same number."""
    to, back = {}, []
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        back.append(c)
        to.setdefault(c, b)
    if codec == "cp1252":  # what some readers make of the five undefined bytes
        for b in range(0x80, 0xA0):
            to.setdefault(chr(b), b)
    return to, back


def undo(text, was, read_as):
    """`text` with its bytes taken back and read as they were; None where a character has no byte or the bytes are no text."""
    to, _ = _tables(read_as)
    try:
        raw = bytes([to[c] for c in text])
    except KeyError:
        return None
    if was == "utf-8":
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    back = _tables(was)[1]
    return "".join(back[b] for b in raw)


class Model:
    """Trigram model of characters with counts backed off to bigrams and single characters; trained on clean texts."""

    def __init__(self, counts):
        self.n = [{}, {}, {}]
        self.ctx = [{}, {}]
        for g, k in counts.items():
            self.n[len(g) - 1][g] = k
        for g, k in self.n[2].items():
            self.ctx[1][g[:2]] = self.ctx[1].get(g[:2], 0) + k
        for g, k in self.n[1].items():
            self.ctx[0][g[0]] = self.ctx[0].get(g[0], 0) + k
        self.total = sum(self.n[0].values()) or 1
        self.cache, self.singles, self.logs = {}, {}, _Logs(self)

    def _p(self, c, a, b):
        p = (self.n[0].get(c, 0) + 0.02) / (self.total + 2000)
        k = self.ctx[0].get(b, 0)
        p = (self.n[1].get(b + c, 0) + 4 * p) / (k + 4)
        k = self.ctx[1].get(a + b, 0)
        return (self.n[2].get(a + b + c, 0) + 4 * p) / (k + 4)

    def score(self, word):
        """Log-likelihood of a word between blanks."""
        s = self.cache.get(word)
        if s is None:
            forms = (word, word.lower()) if word.isupper() else (word,)  # capitals are rarer than the words they spell
            s = max(self._score(f" {w} ") for w in forms)
            if len(self.cache) < 200_000:
                self.cache[word] = s
        return s

    def _score(self, t):
        t = " " + t
        return sum(map(self.logs.__getitem__, [t[i : i + 3] for i in range(len(t) - 2)]))


class _Logs(dict):
    """Log-likelihood of the last of three characters after the other two, by a model."""

    def __init__(self, model):
        self.p = model._p

    def __missing__(self, g):
        got = math.log(self.p(g[2], g[0], g[1]))
        if len(self) < 200_000:
            self[g] = got
        return got


def is_clean(text):
    """No sign of a wrong decoding: no lone controls, replacement characters, box drawings or byte pairs of misread UTF-8."""
    return text.isascii() or not _WEST.search(" ".join(_odd_words(text)))  # no sign holds a blank


def _odd_words(text):
    """The words of a text with characters beyond ASCII, as _WORD finds them."""
    return [w for w in text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if not w.isascii()]


def grams(texts):
    """Counts of the 1- to 3-grams of the words of texts, each word between blanks."""
    words = {}
    for t in texts:
        _add_words(t, words)
    return _grams(words)


def _add_words(text, words):
    for w in re.sub(r"\d", "0", unicodedata.normalize("NFC", text)).split():
        words[w] = words.get(w, 0) + 1


def _grams(words):
    out = {}
    for w, k in words.items():
        t = f" {w} "
        for i in range(1, len(t)):
            for g in (t[i], t[i - 1 : i + 1], (t[i - 2] if i > 1 else " ") + t[i - 1 : i + 1]):
                out[g] = out.get(g, 0) + k
    return out


#: Signs of a wrong decoding for which a record is not trained on.
_SIGNS = (
    r"[\x{80}-\x{84}\x{86}-\x{9f}\x{fffd}\x{2500}-\x{259f}√]|[ÃÂâÄÅÐÑ][\x{80}-\x{bf}\x{152}-\x{2dc}\x{2013}-\x{2122}]|[РС][\x{80}-\x{bf}\x{402}-\x{40f}\x{452}-\x{45f}\x{2013}-\x{2122}]")


def _records(documents):
    """(h, text) of the documents with a text; copies share a hash."""
    return documents.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), "text")


def sample(documents, rows=None):
    """(h, text): the distinct texts. `rows` bounds them to the clean ones of the `rows` texts with the smallest hashes; no query sets it."""
    if rows is None:
        return _records(documents.select("text").distinct())
    hashed = _records(documents)
    least = hashed.select("h").distinct().orderBy("h").limit(rows)
    few = hashed.join(F.broadcast(least), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))  # at most `rows` hashes
    return checkpoint(few).where(~F.col("text").rlike(_SIGNS))


def train(documents, rows=None):
    """Counts of n-grams over the clean records."""
    return _sum(_counts(sample(documents, rows)))


def _sum(folds):
    """Counts of several parts together."""
    out = {}
    for counts in folds:
        for g, k in counts.items():
            out[g] = out.get(g, 0) + k
    return out


def _counts(texts):
    """[counts of n-grams over the texts of each fold]; the counts of the partitions are added up in Spark. They are of the order of the
    alphabets' trigrams."""

    def frame(words):
        rows = [(f, g, k) for f, own in enumerate(words) for g, k in _grams(own).items()]
        return pd.DataFrame(rows, columns=["fold", "g", "k"])

    def count(batches):
        words = [{} for _ in range(FOLDS)]
        for b in batches:
            for h, t in zip(b["h"].tolist(), b["text"], strict=True):
                if is_clean(t):
                    _add_words(t, words[h % FOLDS])
            if sum(map(len, words)) > 200_000:
                yield frame(words)
                words = [{} for _ in range(FOLDS)]
        yield frame(words)

    out = [{} for _ in range(FOLDS)]
    for f, g, k in texts.select("h", "text").mapInPandas(count, "fold int, g string, k bigint").groupBy("fold", "g").agg(F.sum("k").alias("k")).collect():
        out[f][g] = k
    return out


@functools.lru_cache(maxsize=None)
def _misread(was, read_as):
    """{code of a character: what it is misread as} of a chain of single bytes."""
    back = _tables(read_as)[1]
    return {ord(c): back[b] for c, b in _tables(was)[0].items()}


def garble(text, was, read_as):
    """A text whose bytes in one encoding are read in another; None where a character has no byte in it or nothing changes."""
    if was == "utf-8":
        back = _tables(read_as)[1]
        new = "".join(back[b] for b in text.encode("utf-8"))
    else:
        as_read = _misread(was, read_as)
        if not as_read.keys() >= set(map(ord, set(text))):
            return None
        new = text.translate(as_read)
    return None if new == text else new


def trials(h, text, model, cache, utf8=True):
    """[(clean, misread UTF-8, mean gain, total gain, restored)] of a held-out record and of garbled copies of it, by chains that its hash picks:
    one by single bytes, whose gains are compared with margins, and, with `utf8`, one of misread UTF-8, which has none and is restored or not."""
    out = []
    if not text or text.isascii() or not is_clean(text):
        return out
    words = _odd_words(text)
    codes = set(map(ord, set("".join(words))))
    out.append((True, False, *_best_chain(words, model), False))
    for part in ([c for c in CHAINS if c[0] == "utf-8"] * utf8, _SINGLE):
        for k in range(len(part)):
            was, read_as = part[(h + k) % len(part)]
            if was == "utf-8":
                bad = garble(text, was, read_as)
                out.append((False, True, 0.0, 0.0, examine(bad, model, cache, 0.0, 0.0)[1] == text))
                break
            as_read = _misread(was, read_as)
            bad = [w.translate(as_read) for w in words] if as_read.keys() >= codes else words
            if bad != words:
                out.append((False, False, *_best_chain(bad, model), False))
                break
    return out


def _best_chain(words, model):
    """(mean gain for a changed character, total gain) of the single-byte chain with the largest total over words."""
    gains, chars = [0.0] * len(CHAINS), [0] * len(CHAINS)
    for w in words:
        n, chains, gain = _singles(w, model)
        for k, g in zip(chains, gain):
            gains[k] += g
            chars[k] += n
    total, n = max(zip(gains, chars))
    return total / max(1, n), total


@functools.lru_cache(maxsize=None)
def _restoring():
    """[(chain number, {code of a character beyond ASCII: what it was})] of the single-byte chains, but for what can't be printed."""
    out = []
    for k, (was, read_as) in enumerate(CHAINS):
        if was != "utf-8":
            back = _tables(was)[1]
            out.append((k, {ord(c): back[b] for c, b in _tables(read_as)[0].items() if c > "\x7f" and not _unprintable(back[b])}))
    return out


def _singles(word, model):
    """(characters beyond ASCII, single-byte chains that make a word likelier, their gains)."""
    got = model.singles.get(word)
    if got is None:
        codes, base, gains, found = {ord(c) for c in word if c > "\x7f"}, model.score(_DIGIT.sub("0", word)), {word: 0.0}, []
        for k, table in [] if _CONTROL.search(word) else _restoring():
            if table.keys() >= codes:
                new = word.translate(table)
                if new not in gains:  # chains agree in many words
                    gains[new] = model.score(_DIGIT.sub("0", new)) - base
                if gains[new] > 0:
                    found.append((k, gains[new]))
        got = sum(c > "\x7f" for c in word), tuple(k for k, _ in found), tuple(g for _, g in found)
        if len(model.singles) < 200_000:
            model.singles[word] = got
    return got


def choose(rows):
    """(margin, total, report) from trials, or from how often each occurs: MARGIN and TOTAL if they hold, else the pair of the grid that changes
    the fewest clean records and, of those, restores most garbled ones, the stricter one first. Without held-out records the first pair stands.

    The sample is clean of misread UTF-8 only. Records beyond the strictest pair of the grid are garbled ones that it took in; they are no
    evidence against a pair and are left out."""
    rows = Counter(rows)
    taken = {r: k for r, k in rows.items() if r[0] and r[2] >= MARGINS[-1] and r[3] >= TOTALS[-1]}
    clean = {r: k for r, k in rows.items() if r[0] and r not in taken}
    bad = {r: k for r, k in rows.items() if not r[0] and not r[1]}
    n_clean, n_bad = sum(clean.values()), sum(bad.values())

    def rates(m, t):
        return tuple(sum(k for r, k in part.items() if r[2] >= m and r[3] >= t) / max(1, n) for part, n in ((clean, n_clean), (bad, n_bad)))

    wrong, right = rates(MARGIN, TOTAL)
    m, t = MARGIN, TOTAL
    if clean and bad and (wrong * n_clean > max(1, FALSE_AT_MOST * n_clean) or right < FOUND_AT_LEAST):
        wrong, right, m, t = min(((*rates(m, t), m, t) for m in MARGINS for t in TOTALS), key=lambda x: (x[0] > FALSE_AT_MOST and x[0], -x[1], -x[2], -x[3]))
    utf = {r: k for r, k in rows.items() if not r[0] and r[1]}
    n_utf = sum(utf.values())
    return m, t, {"left out": sum(taken.values()), "clean": n_clean, "changed": wrong, "garbled": n_bad, "found": right, "utf8": n_utf, "utf8 restored": sum(k for r, k in utf.items() if r[4]) / max(1, n_utf)}


def _step(x, grid):
    """The largest number of a grid that `x` reaches, else 0; no pair of the grid tells the two apart."""
    k = bisect_right(grid, x)
    return grid[k - 1] if k else 0.0


def _tried(texts, counts, fn, schema):
    """Rows that `fn(h, text, model, cache)` yields for each text. `counts` are those of a model, or a list of the counts of each fold: then a
    text meets the model of the other folds."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches):
        own = shared.value
        rest = [_sum(own[:f] + own[f + 1 :]) for f in range(len(own))] if isinstance(own, list) else [own]
        models = [(Model(c), {}) for c in rest]
        for b in batches:
            rows = zip(b["h"].tolist(), b["text"], strict=True)
            yield pd.DataFrame([x for h, t in rows for x in fn(h, t, *models[h % len(models)])], columns=names)

    other = F.octet_length("text") != F.length("text")  # characters beyond ASCII
    return spread(texts.where(other).select("h", "text"), "h").mapInPandas(run, schema)


def _unlearned(text, model, cache):
    """True for a text without a sign that is garbled all the same. On a loose margin a whole text garbled like others before it is found too;
    that the restored words are in a language that the model knows keeps texts in rare languages."""
    bad, new, _, _ = examine(text, model, cache, MARGINS[0], TOTALS[-1])
    words = [w for w, old in zip(_BLANK.split(new), _BLANK.split(text)) if w != old] if bad else []
    return sum(model.score(_DIGIT.sub("0", w)) for w in words) > KNOWN * sum(len(w) + 1 for w in words)


def cleaned(texts, folds):
    """Counts of the folds without the texts that are garbled, though they have no sign of it, by the model of the other folds. Else these would
    pass for clean ones, the more of them the better."""

    def judge(h, text, model, cache):
        return [(h, text)] if is_clean(text) and _unlearned(text, model, cache) else []

    own = _counts(_tried(texts, folds, judge, "h bigint, text string").distinct())
    return [{g: k - out.get(g, 0) for g, k in counts.items() if k > out.get(g, 0)} for counts, out in zip(folds, own, strict=True)]


def validate(texts, counts, held_out=None, utf8=True):
    """(margin, total, report) by trials of all texts, copies once, or of the `held_out` ones with the smallest hashes. `counts` are those of a
    model that was trained without them, or a list of the counts of each fold."""

    def run(h, text, model, cache):
        return [(h, c, u, _step(mean, MARGINS), _step(total, TOTALS), r) for c, u, mean, total, r in trials(h, text, model, cache, utf8)]

    if held_out is not None:
        texts = texts.orderBy("h").limit(held_out)
    got = _tried(texts, counts, run, "h bigint, clean boolean, utf boolean, mean double, total double, restored boolean").distinct()
    got = got.groupBy("clean", "utf", "mean", "total", "restored").count().collect()  # bounded by the grid
    return choose(Counter({tuple(r)[:5]: r["count"] for r in got}))


_SPLIT = re.compile(r"([^\x00-\x7f]+)")
_undone = {}


def _unprintable(text):
    return any(unicodedata.category(c) in ("Cc", "Co", "Cn") for c in text)


def _undoings(run):
    """{chain number: characters} of the chains of misread UTF-8 that can take back a run of other characters; kept, as runs are few. They may
    give controls that a second round takes back."""
    got = _undone.get(run)
    if got is None:
        got = {}
        for k, (was, read_as) in enumerate(CHAINS):
            if was != "utf-8":
                continue
            new = undo(run, was, read_as)
            if new is None:
                new, n = _partly(run, read_as)
                new = new if n else None
            if new is not None:
                got[k] = new
        if len(_undone) < 200_000:
            _undone[run] = got
    return got


def _apply(parts, k):
    """A word's parts with a chain taken back in every run; None where it does not fit one or changes none."""
    new = [p if i % 2 == 0 else _undoings(p).get(k) for i, p in enumerate(parts)]
    if None in new or new == parts:
        return None
    return "".join(new)


_AGAIN = CHAINS.index(("utf-8", "cp1252"))
_DIGIT, _BLANK, _CONTROL = re.compile(r"\d"), re.compile(r"[ \t\r\n]"), re.compile(r"[\x00-\x1f\x7f]")


def _word_chains(word, model):
    """[(gain, sure, chain, restored)] of the chains that make a word likelier; `sure` where valid UTF-8 of several bytes comes out."""
    parts = _SPLIT.split(word)
    if _CONTROL.search(word):
        return []
    out, tables = [], dict(_restoring())
    for k, gain in zip(*_singles(word, model)[1:]):
        was, read_as = CHAINS[k]
        out.append((k, (gain, False, f"{was}<{read_as}", word.translate(tables[k]))))
    base = model.score(_DIGIT.sub("0", word))
    for k in set.intersection(*(set(_undoings(p)) for p in parts[1::2])):
        new = _apply(parts, k)
        if new is None:
            continue
        was, read_as = CHAINS[k]
        chain = f"{was}<{read_as}"
        for _ in range(3):  # it may have happened more than once
            more = _SPLIT.split(new)
            again = len(more) > 1 and (_apply(more, k) or _apply(more, _AGAIN))
            if not again or model.score(_DIGIT.sub("0", again)) <= model.score(_DIGIT.sub("0", new)):
                break
            new, chain = again, chain + "+utf-8"
        if _unprintable(new):
            continue
        gain = model.score(_DIGIT.sub("0", new)) - base
        if gain > 0:
            out.append((k, (gain, True, chain, new)))
    return [g for _, g in sorted(out, key=lambda x: (-x[1][0], x[0]))]  # ties stay in the order of CHAINS


def _chains_of(word, model, cache):
    got = cache.get(word)
    if got is None:
        got = _word_chains(word, model)
        if len(cache) < 300_000:
            cache[word] = got
    return got


@functools.lru_cache(maxsize=64)
def _utf8_runs(read_as):
    """Pattern of misread UTF-8 sequences in characters of a codec."""
    to, back = _tables(read_as)

    def cls(lo, hi):
        return "[" + "".join(re.escape(back[b]) for b in range(lo, hi + 1)) + "]"

    tail = cls(0x80, 0xBF)
    return re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE1, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})")


def _partly(part, read_as):
    """Undo the misread UTF-8 sequences inside a run that holds other characters too; (text, how many)."""
    n = 0

    def one(m):
        nonlocal n
        new = undo(m[0], "utf-8", read_as)
        if new is None:
            return m[0]
        n += 1
        return new

    return _utf8_runs(read_as).sub(one, part), n


_QUOTES = "\"'“”„‟«»‘’‚‹›`()[]「」"
_EXAMPLE = re.compile(r"(?i)\bexample|\be\.g\.|\bif you see\b|\bshow(?:s|ed|n)\b|\bwhere\b.*\bstored|\bturns?\b|\binto\b|\bdecoder|\bcharacter|\binstead of\b|\bsequence|\bbeispiel|\bfalsch gelesen|\bstatt\b|\bzeichen\b|\bexemple|\bau lieu|\bcaract[èe]re|\bejemplo|\ben lugar|\bcar[áa]cter|\bexemplo|\bem vez|\bprzykład|\bzamiast|\bznak|\bнапример|\bпример|\bвместо|\bсимвол")


_ORDER = {f"{was}<{read_as}": k for k, (was, read_as) in enumerate(CHAINS)}


def _quoted(sentence, words):
    """True where every odd word of a sentence is shown, not used: set alone in quotes, or standing alone in a sentence about such characters."""
    alone = True
    for w in words:
        core = w.strip(_QUOTES + ".,;:!?")
        inside = w[:1] in _QUOTES and len(w) > 2 and len(core) <= 6
        if not inside and (re.search(r"[A-Za-z\d]", core) or len(core) > 6):
            alone = False
    return alone and bool(_EXAMPLE.search(sentence))


_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?](?!\s|$)[^.!?\n]*)*[.!?]?[ \t]*\n?")


def _plain(text, model, cache, total):
    """True where nothing is lost, no word is misread UTF-8 and no chain reaches `total`, even with the words that are only shown."""
    if "�" in text:
        return False
    gains = {}
    for w in _odd_words(text):
        for gain, utf, chain, _ in _chains_of(w, model, cache):
            if utf and gain > SURE:
                return False
            gains[chain] = gains.get(chain, 0.0) + gain
    return max(gains.values(), default=0.0) < total


def examine(text, model, cache, margin=MARGIN, total=TOTAL):
    """(garbled, restored, chain, lossy) of a text. Null, blank and plain ASCII texts are never garbled.

    Words with other characters are judged one by one: misread UTF-8 counts where the undone word is likelier by SURE; a chain between
    single-byte encodings counts where its gain over all words it fits reaches `margin` a character and `total` in all. Replacement
    characters are lossy. Words that a sentence only shows as examples do not count."""
    if not text or text.isascii() or _plain(text, model, cache, total):
        return False, text, None, False
    found, lossy, single = [], False, {}
    for m in _SENTENCE.finditer(text):
        s = m[0]
        if not _RUN.search(s):
            continue
        odd, lost = [], []
        for w in _WORD.finditer(s):
            word = w[0]
            if not word.strip():
                continue
            if "�" in word:
                lost.append((w.span(), word))
                continue
            got = _chains_of(word, model, cache)
            if got:
                odd.append((m.start() + w.start(), m.start() + w.end(), word, got))
        sure = [o for o in odd if any(g[1] and g[0] > SURE for g in o[3])]
        strong = [o for o in odd if o[3][0][0] > STRONG]
        if (strong or sure or lost) and _quoted(s, [o[2] for o in [*sure, *strong]] + [x[1] for x in lost]):
            continue
        lossy |= bool(lost)
        for o in odd:
            for gain, utf, chain, new in o[3]:
                n = sum(ord(c) > 127 for c in o[2])
                if utf and gain > SURE:
                    found.append((o[0], o[1], new, chain, gain))
                    break
                if not utf:
                    e = single.setdefault(chain, [0.0, 0, []])
                    e[0] += gain
                    e[1] += n
                    e[2].append((o[0], o[1], new, chain, gain))
    best = max(single.items(), key=lambda kv: (round(kv[1][0], 6), -_ORDER[kv[0]]), default=None)
    if best and best[1][0] >= total and best[1][0] >= margin * best[1][1]:
        taken = {f[0] for f in found}
        if not found or sum(f[4] for f in found) < best[1][0]:
            here = {x[0] for x in best[1][2]}
            found = [f for f in found if f[0] not in here] + best[1][2]
        else:
            found += [x for x in best[1][2] if x[0] not in taken]
    if not found:
        return lossy, text, None, lossy
    found.sort()
    out, last = [], 0
    for a, b, new, _, _ in found:
        out += [text[last:a], new]
        last = b
    chains = {}
    for f in found:
        chains[f[3]] = chains.get(f[3], 0) + 1
    return True, "".join([*out, text[last:]]), max(sorted(chains), key=chains.get), lossy


def restored(documents, rows=None, held_out=None):
    """(doc_id, chain, lossy, text): each garbled document with its restored text; what was lost stays marked by replacement characters.

    The model is trained on all clean records, and the margins are validated on all of them, each by a model of the other folds. Every
    document is examined. `rows` and `held_out` bound the records for trials of one's own."""
    texts = sample(documents, rows)
    folds = _counts(texts)
    texts = _records(documents) if rows is None else texts  # hashes tell copies from here on
    folds = cleaned(texts, folds)
    margin, total, _ = validate(texts, folds, held_out, utf8=False)  # no margin depends on misread UTF-8
    shared = documents.sparkSession.sparkContext.broadcast(_sum(folds))

    def run(batches):
        model, cache = Model(shared.value), {}
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"].tolist(), b["text"], strict=True):
                bad, new, chain, lossy = examine(t, model, cache, margin, total)
                if bad:
                    out.append((i, chain, lossy, new))
            yield pd.DataFrame(out, columns=["doc_id", "chain", "lossy", "text"])

    other = F.octet_length("text") != F.length("text")  # characters beyond ASCII
    d = documents.where(F.col("doc_id").isNotNull() & other).select("doc_id", "text")
    return spread(d, "doc_id").mapInPandas(run, "doc_id bigint, chain string, lossy boolean, text string")


def found(documents):
    """(doc_id) of the documents that hold garbled text."""
    return restored(documents).select("doc_id").distinct()
