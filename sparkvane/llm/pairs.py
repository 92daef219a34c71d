"""Defective question and answer pairs (problem 6)."""
import re
import unicodedata
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .chats import distinct_rows
from .common import role_of, visible

#: Texts that stand in for an answer, without their punctuation, in lower case.
STAND_INS = frozenset(
    "na|n a|none|null|nil|nan|empty|blank|undefined|tbd|todo|no answer|no response|no reply|no content|no output|not available|not applicable|answer|response|reply|"
    "output|result|antwort|keine antwort|leer|entfällt|réponse|sans réponse|pas de réponse|vide|respuesta|sin respuesta|vacío|resposta|sem resposta|vazio|"
    "odpowiedź|brak|brak odpowiedzi|ответ|нет ответа|пусто|placeholder|lorem ipsum".split("|"))

#: The most words that a stand-in has.
STAND_IN_WORDS = max(len(x.split()) for x in STAND_INS)
_INVISIBLE = regex.compile(r"(?V1)[[\p{Cf}\p{Cc}\p{Cs}\p{Co}\p{Cn}]--[\n\t]]")
_SPACERS = re.compile(r"<br\s*/?>|</?p>|&nbsp;")
_PIECES = re.compile(r"[^\W_]+")

#: Phrases by which an assistant declines, by language; each is matched within one sentence.
REFUSAL = re.compile(
    r"""(?xi)
    \b(?:
    (?:i|we)\s?(?:['’](?:m|re)|\s+am|\s+are)?\s+(?:very\s+|so\s+|really\s+)?(?:sorry|afraid|unable|not\ able|not\ allowed|not\ permitted|not\ in\ a\ position|prohibited|forbidden)\b
    |(?:i|we)\s+(?:can\s?not|can['’]?t|could\ not|couldn['’]t|won['’]?t|will\ not|may\ not|must\ not|am\ not\ able\ to)\s+(?:be\ able\ to\s+)?(?:really\s+|possibly\s+)?
        (?:help|assist|answer|give|provide|discuss|do|comply|respond|share|support|fulfil|process|talk|comment|complete|continue|say|disclose|handle|offer|engage)
    |(?:i|we)\s+(?:have\ to|must|need\ to|will|am\ going\ to)\s+(?:respectfully\s+|politely\s+|unfortunately\s+)?(?:decline|refuse|pass|turn\s+\w+\s+down|leave\s+(?:\w+\s+){1,2}unanswered|say\s+no)\b
    |i['’]d\s+rather\s+not\b|i\s+would\s+rather\s+not\b|(?:i|we)\s+(?:decline|refuse)\b
    |must\s+(?:decline|refuse)\b|off[\s-]limits\s+(?:for|to)\s+(?:me|us)\b|not\s+allowed\s+to\s+(?:discuss|answer|share|help|say)
    |no\s+answer\s+can\s+be\s+(?:provided|given)|outside\s+(?:of\s+)?what\s+i(?:['’]m|\s+am|\s+may|\s+can)?\b
    |my\s+(?:instructions|guidelines|rules|policy|policies)\s+(?:do\ not|don['’]t|forbid|prevent|prohibit)|against\s+my\s+(?:instructions|guidelines|rules|policy)
    |(?:i|we)\s+(?:do\ not|don['’]t)\s+(?:answer|discuss|provide|comment)
    |nicht\s+(?:helfen|beantworten|weiterhelfen|behilflich)|ablehnen\b|tut\s+mir\s+leid\b
    |m['’]est\s+(?:impossible|interdit)|désolée?\b
    |lo\s+siento\b|no\s+(?:puedo|podemos|me\s+es\s+posible|me\s+está\s+permitido|se\s+me\s+permite|estoy\s+autorizad)|(?:debo|tengo\s+que)\s+(?:rechazar|declinar|negarme)
    |(?:lamento|desculpe?|sinto\s+muito)\b|não\s+(?:posso|podemos|me\s+é\s+(?:possível|permitido)|consigo\s+(?:ajudar|responder)|estou\s+autorizad)|(?:devo|tenho\s+(?:de|que))\s+(?:recusar|declinar)
    |przykro\s+mi\b|przepraszam\b|nie\s+(?:mogę|możemy|wolno\s+mi|jestem\s+w\s+stanie|będę\s+mógł)|(?:muszę|powinienem)\s+odmówić|odmawiam\b
    |не\s+(?:могу|можем|имею\s+права|вправе|в\s+состоянии|смогу)\b|(?:вынужден\w*|должен|должна)\s+отказ|отказываюсь\b|мне\s+не\s+разрешено|мне\s+запрещено|извините\b|простите\b
    |mi\s+dispiace\b|non\s+(?:posso|possiamo|mi\s+è\s+(?:possibile|permesso|consentito)|sono\s+in\s+grado|sono\s+autorizzat)|devo\s+(?:rifiutare|declinare)
    |het\s+spijt\s+m[ei]j?\b|kan\s+ik\s+(?:\w+\s+)?niet\b|ik\s+(?:kan|mag)\s+(?:\w+\s+)?niet\b|moet\s+ik\s+weigeren)
    |申し訳|お答えできま|お手伝いできま|できかねま|抱歉|对不起|對不起|(?:无法|無法|不能)(?:回答|提供|帮助|幫助|协助|協助)|죄송|할\s?수\s없|답변(?:해|드)\S*\s?수\s없|عذر|آسف|لا\s+(?:أستطيع|يمكنني)|λυπάμαι|δεν\s+μπορώ|מצטער""")
#: Declining words that follow others at any distance within a sentence.
DECLINES = tuple((re.compile(a, re.I), re.compile(b, re.I)) for a, b in (
    (r"\bich\b", r"\b(?:nicht|ablehnen|keine)\b"), (r"\b(?:muss|möchte|werde|darf|kann)\s+ich\b", r"\b(?:nicht|ablehnen|keine)"), (r"\bje\b", r"\b(?:ne peux|ne puis|dois décliner|dois refuser|refuse|décline|ne suis pas)"), (r"сожалению", r"не\s+(?:могу|можем)")))

#: Sentences that go with a refusal and tell nothing.
FILLER = re.compile(
    r"""(?xi)^(?:is\ there\ anything|can\ i\ help|please\ (?:contact|ask|try|consult|reach)|try\ |thanks?|thank\ you|hope|i\ hope|let\ me\ know|i\ understand|after\ looking|to\ be\ clear|hm|unfortunately|
    kann\ ich\ sonst|bitte|danke|vielen\ dank|merci|veuillez|puis-je|y\ a-t-il|gracias|por\ favor|hay\ algo|puedo\ ayudar|obrigad|posso\ ajudar|há\ mais|proszę|dziękuję|czy\ mogę|спасибо|пожалуйста|обратитесь|могу\ ли|я\ могу|
    ¿hay|¿puedo|if\ you|sorry|i['’]m\ sorry|as\ an\ (?:ai|assistant)|apologies)""")
#: After these words a refusing sentence goes on to tell something.
YET = re.compile(r"(?i)\bbut\s+(?:the|here|it|you|i\s+can\b(?!['’]t|\s?not))\b|\bso\s+i\s+(?!will\s+not|won['’]t|can|must|have\s+to|may)|\binstead\b|;\s|:\s+\S+\s+\S+\s+\S+\s+(?:is|=)\s|\baber\b|\bmais\s+(?:le|la|voici)|\bpero\s+(?:el|la)|\bale\b|\bоднако\b")

#: Frequent words of each language.
WORDS = {
    "en": "the of and to in is are was were for with that this not it on by at from be which how what why where did does my your can you has have had only but before after about",
    "de": "der die das und ist sind wurde wurden nicht ein eine einen im den dem des von mit für auf weil wie was warum wo welche hat haben auch durch bei nach keine sie ich zu aus steht",
    "fr": "le la les des et est sont une dans pour que qui ne pas par sur avec du au aux cette été plus ce où quelle quel pourquoi comment il elle ont après sans je nous vous car",
    "es": "el la los las y es son una un en para que por con del se no al más fue dónde qué cuál cómo cuándo como está sobre esta este sin pero hay tiene según lo han solo",
    "pt": "o os as e é são uma um em para que por com do da dos das não ao mais foi onde qual como porque está sobre sem mas há tem no na pelo pela antes após também",
    "it": "il lo gli è sono una uno di che per non con del della dei delle nel nella alla dal come dove quale quali quando perché più anche questo questa ma sul sulla ai cosa quanto stato stata",
    "nl": "de het een en van is zijn was niet met voor op dat die deze dit wordt werd ook als hoe wat waarom waar welke door naar bij uit heeft hebben geen maar nog over kan",
    "pl": "i w z na nie się jest są do dla że od po przez jak co który która które czy tylko oraz został została został były było ma nie o za pod ale więc gdzie kiedy jakie wynika",
}
VOCAB = {k: frozenset(v.split()) for k, v in WORDS.items()}
#: Letters that speak for a language.
MARKS = {"de": "äöüß", "fr": "àâæçèêëîïôœùû", "es": "ñ¿¡", "pt": "ãõ", "pl": "ąćęłńśźż", "it": "ìò", "nl": "ĳ"}
_LANGUAGES_OF = {w: [k for k, v in VOCAB.items() if w in v] for w in set().union(*VOCAB.values())}
_MARK_OF = {c: [k for k, v in MARKS.items() if c in v] for c in set("".join(MARKS.values()))}
#: Scripts that speak for a language on their own. Kana make Han characters Japanese.
SCRIPTS = {
    "ru": r"\p{Cyrillic}", "el": r"\p{Greek}", "ja": r"[\p{Hiragana}\p{Katakana}]", "zh": r"\p{Han}", "ko": r"\p{Hangul}", "ar": r"\p{Arabic}", "he": r"\p{Hebrew}", "hi": r"\p{Devanagari}", "th": r"\p{Thai}", "ka": r"\p{Georgian}", "hy": r"\p{Armenian}",
    "bn": r"\p{Bengali}", "ta": r"\p{Tamil}"}
_SCRIPT = regex.compile("|".join(f"(?P<{k}>{v})" for k, v in SCRIPTS.items()))
_OTHER_SCRIPT = re.compile(r"[\u0370-\u1fff\u2c00-\ud7ff\uf900-\ufdff\uff66-\uffdc\U00010000-\U0003ffff]")
#: How a language is called where an answer in it is asked for.
ASKED = {
    "en": r"english|englisch|anglais|ingl[ée]s|inglês|angielsk|англ", "de": r"german|deutsch|allemand|alem[áa]n|alemão|niemieck|немецк|по-немецки",
    "fr": r"french|französisch|français|franc[ée]s|francês|francusk|француз", "es": r"spanish|spanisch|espagnol|español|espanhol|hiszpańsk|испанск",
    "pt": r"portugu|португальск", "pl": r"polish|polnisch|polonais|polaco|polonês|polsk|польск", "ru": r"russian|russisch|russe|ruso|russo|rosyjsk|русск",
    "it": r"italian|italienisch|italien|włosk|итальянск", "nl": r"dutch|niederländisch|néerlandais|neerland|holand|holend|nederlands|голландск|нидерландск", "el": r"greek|griechisch|grec|griego|grego|greck|греческ|ελληνικ",
    "ja": r"japan|japon|япон|日本", "zh": r"chinese|mandarin|chinesisch|chinois|chino|chinês|chińsk|китайск|中文|汉语|漢語", "ko": r"korean|koreanisch|coréen|coreano|koreańsk|корейск|한국", "ar": r"arab|араб|عرب", "he": r"hebrew|hebräisch|hébreu|hebre|иврит|עברית",
    "hi": r"hindi|хинди|हिन्दी|हिंदी", "th": r"thai|tailand|тайск|ไทย", "ka": r"georgian|georgisch|грузинск", "hy": r"armenian|armenisch|армянск", "bn": r"bengal|бенгал|বাংলা", "ta": r"tamil|тамил|தமிழ்",
}


_WORD = re.compile(r"[^\W\d_]+")
_NOT_PROSE = re.compile(r"(?m)```[\s\S]*?(?:```|\Z)|`[^`\n]*`|\[[^\]]*\]|^[>|].*$")
_TOKEN = re.compile(r"[\w/]+")


def words(text):
    return _WORD.findall(text.lower())


def language(text):
    """(language, scores): the language with most frequent words and marking letters, and the scores of all; (None, {}) if none has any.

    A script other than Latin that holds more than half of the letters speaks for its language. Code, quoted lines, identifiers, paths and
    citations do not count."""
    t = _NOT_PROSE.sub(" ", text) if "`" in text or "[" in text or ">" in text or "|" in text else text
    tokens = _TOKEN.findall(t.lower())  # identifiers, numbers and paths are tokens of their own, and no words
    plain = t.isascii()
    if not plain and _OTHER_SCRIPT.search(t):
        n = {}
        for m in _SCRIPT.finditer(t):
            n[m.lastgroup] = n.get(m.lastgroup, 0) + 1
        if n.get("ja"):
            n["ja"] += n.pop("zh", 0)
        most = max(n, key=n.get, default=None)
        if most and n[most] * 2 > sum(len(w) for w in tokens if w.isalpha()):
            return most, {most: float(n[most])}
    said = [k for w in tokens if w in _LANGUAGES_OF for k in _LANGUAGES_OF[w]]
    score = {k: float(said.count(k)) for k in set(said)}
    if not plain:
        for w in tokens:
            if not w.isascii() and w.isalpha():
                for k in {k for c in w for k in _MARK_OF.get(c, ())}:
                    score[k] = score.get(k, 0.0) + 1.5
        if n := t.count("¿") + t.count("¡"):
            score["es"] = score.get("es", 0.0) + 1.5 * n
    if not score:
        return None, {}
    top = max(score.values())
    return next(k for k in VOCAB if score.get(k) == top), score


def _speaks(scores, own, other):
    """True where a text speaks more for its language than for another by a word or letter; by two where a third language has as many."""
    gap = scores[own] - scores.get(other, 0.0)
    return gap >= 2 or gap >= 1 and sum(v > scores[own] - 1 for v in scores.values()) == 1


def asks_for(question, lang):
    """True where a question names `lang` together with a word for answering."""
    q = question.lower()
    return bool(re.search(ASKED[lang], q) and re.search(r"answer|reply|respond|write|translat|antwort|schreib|übersetz|répon|écri|tradui|respond|contest|escrib|traduc|escrev|traduz|odpowiedz|napisz|przetłumacz|ответ|напиш|перевед|\bin\b|\bauf\b|\ben\b|\bem\b|\bpo\b|\bна\b", q))


_GAPS = re.compile(r"[\W_]+")


def bare(text):
    """Letters and digits of a text as lower-case words."""
    return _GAPS.sub(" ", text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()).strip()


def is_empty(answer):
    """Nothing, only punctuation, fences or labels, or a stand-in for an answer."""
    if answer is None:
        return True
    t = answer if answer.isascii() and answer.isprintable() else _INVISIBLE.sub("", answer)
    t = _SPACERS.sub(" ", t) if "<" in t or "&" in t else t
    if sum(1 for _ in islice(_PIECES.finditer(t), STAND_IN_WORDS + 1)) > STAND_IN_WORDS:
        return False  # more words than any stand-in has; what follows could not change that
    b = bare(t)
    if not b:
        return not any(unicodedata.category(c) in ("So", "Sm", "Sc") for c in t)
    return b in STAND_INS


_LAST = re.compile(r"[\W_]*+([^\W_]++)")


def is_copy(question, answer):
    """The answer's words are the question's, at most after a label such as 'you asked'."""
    if question.isascii() and answer.isascii():
        x, y = _LAST.match(question[::-1]), _LAST.match(answer[::-1])
        if not x or not y or x[1].lower() != y[1].lower():
            return False  # a copy ends with the question's last word
    q, a = bare(question), bare(answer)
    if not q or not a:
        return False
    if a == q:
        return True
    if len(q) >= 12 and a.endswith(q) and len(a) - len(q) <= 40 and re.search(r"ask|question|frage|demand|pregunt|pergunt|pyta|вопрос|said|wrote|repeat|prompt|user|^q$", a[: -len(q)]):
        return True
    return len(q) >= 12 and a in (f"{q} {q}", f"q {q}")


_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+")


def _sentences(text):
    t = re.sub(r"(?m)^>.*$", " ", text) if ">" in text else text
    at = 0
    for m in _SENTENCE_END.finditer(t):
        yield t[at : m.start()]
        at = m.end()
    yield t[at:]


_HEADS = re.compile(r"(?i)\b(?:ich|je|сожалению)|сожалению")


def declines(sentence):
    """True for a sentence that holds a refusing phrase. Each pattern reads the sentence once, whatever its length."""
    if REFUSAL.search(sentence):
        return True
    return bool(_HEADS.search(sentence)) and any((m := a.search(sentence)) and b.search(sentence, m.end()) for a, b in DECLINES)


def is_refusal(answer):
    """At least one declining sentence, and no sentence that tells anything."""
    found = False
    for s in _sentences(answer):
        s = s.strip()
        if not _PIECES.search(s):
            continue
        if declines(s) and not YET.search(s):
            found = True
        elif not (FILLER.search(s) and not re.search(r"\d|\w_\w", s)):
            return False
    return found


#: Characters that end a text, and that leave it open.
_ENDS, _OPEN_ENDS = frozenset(".!?…。！？」』）:;)]}\"'”’»*_`>|%$€"), frozenset(",([{–—/\\+=&-")
_FENCES = re.compile(r"(?m)^\s*```"), re.compile(r"(?m)^\s*~~~")


def is_truncated(answer, finish=None):
    """The text stops early: the model reported its length limit, a fence is open, a table row is short, or the last sentence has no end."""
    t = answer.rstrip().rstrip("\u200b").rstrip()
    if finish == "length":
        return True
    if "```" in t and len(_FENCES[0].findall(t)) % 2 or "~~~" in t and len(_FENCES[1].findall(t)) % 2:
        return True
    last = t[t.rfind("\n") + 1 :].strip()
    if last.startswith("|"):
        rows = [x.strip() for x in t.split("\n") if x.strip().startswith("|")]
        return not last.endswith("|") or len(last) < 2 or last.count("|") != rows[0].count("|") or (len(rows) == 1)
    if re.match(r"(?:[-*+]|\d+[.)])(?:\s|$)", last):
        return bool(re.search(r"[,:(\[{–—-]$", last)) or bool(re.fullmatch(r"[-*+]|\d+[.)]", last))
    if re.match(r"(?:```|~~~)", last):
        return False
    if last[-1:] in _ENDS:
        if last.endswith(":") or last.endswith(";"):
            return len(words(last)) >= 3
        return last.count("[") > last.count("]") or last.count("(") > last.count(")") and not re.search(r"[:;]-?\($", last)
    if last[-1:] in _OPEN_ENDS:
        return True
    if last.count("[") > last.count("]") or last.count("(") > last.count(")"):
        return True
    return len(re.findall(r"\w+", last)) >= 4 and not re.fullmatch(r"\S+", last)


def defects(question, answer, finish=None):
    """Every defect of a pair, in the order of the rules. An empty answer has no other."""
    if is_empty(answer):
        return ["empty"]
    out = []
    if is_copy(question, answer):
        out.append("copy")
    if is_refusal(answer):
        out.append("refusal")
    if is_truncated(answer, finish):
        out.append("truncated")
    al, have = language(answer)
    if al:
        ql, asked = language(question)
        if ql and ql != al and _speaks(have, al, ql) and _speaks(asked, ql, al) and not asks_for(question, al):
            out.append("language")
    return out


ROW = "edge int, chat_id string, created double, id bigint, role string, content string, meta string"
#: Stands for a null id where rows pass through Python.
NO_ID = -(2**63)


def _walk(batches, extra, pair):
    """For each answer whose question stands before it in its slice, the row that `pair(row, question)` makes of it, if any (edge 0). The
    first row of a partition may lack the row before it (edge 1), and the last one may be what the next partition lacks (edge 2): these two
    come back whole."""
    names = [*(x.split()[0] for x in ROW.split(", ")), extra]
    chat, before, first, row = None, None, True, None
    for b in batches:
        out = []
        for row in zip(*(b[k].tolist() for k in names[1:-1]), strict=True):
            c, _, _, role, content, _ = row
            if c != chat:
                chat, before = c, None
            if first:
                out.append((1, *row, None))
                first = False
            if role == "assistant" and before is not None and before[0] == "user" and (got := pair(row, before[1])):
                out.append((0, *got))
            before = (role, content)
        if out:
            yield pd.DataFrame(out, columns=names)
    if row:
        yield pd.DataFrame([(2, *row, None)], columns=names)


def _sliced(messages, extra, kind, pair):
    """(pairs, edges): rows of `pair` within slices, and the answers whose question is the last row of an earlier slice.

    Rows are reduced as in problem 2; rows without chat_id or created are left out, blank user rows too. Chats of any size are cut into
    slices of a range partitioning, which is sampled, so its result is written before it is read twice. Neighbours across a cut are found
    among the edge rows, two for a partition. Texts move twice: when rows sent twice meet, and into the order of their chats."""
    m = messages.where(F.col("chat_id").isNotNull() & F.col("created").isNotNull() & ~F.isnan("created"))
    m = m.withColumn("_r", role_of(F.col("role"))).where("_r in ('user', 'assistant')").where((F.col("_r") == "assistant") | visible(F.col("content")))
    m = distinct_rows(m, ("meta",)).withColumn("role", role_of(F.col("role"))).withColumn("id", F.coalesce("id", F.lit(NO_ID)))
    t = m.select("chat_id", "created", "id", "role", "content", "meta")
    t = t.repartitionByRange("chat_id", "created", "id").sortWithinPartitions("chat_id", "created", "id")
    t = checkpoint(t.mapInPandas(lambda batches: _walk(batches, extra, pair), f"{ROW}, {extra} {kind}"))
    w = Window.partitionBy("chat_id").orderBy("created", "id")
    edge = t.where("edge > 0").groupBy("chat_id", "created", "id", "role", "content", "meta").agg(F.min("edge").alias("edge"))
    edge = edge.withColumn("question", F.lag("content").over(w)).withColumn("_before", F.lag("role").over(w))
    return t.where("edge = 0"), edge.where("edge = 1 and role = 'assistant' and _before = 'user'")


def pairs(messages):
    """(message_id, chat_id, question, answer, meta): each answer with its question, texts and all."""
    inside, across = _sliced(messages, "question", "string", lambda row, question: (*row, question))
    cols = [F.when(F.col("id") != NO_ID, F.col("id")).alias("message_id"), "chat_id", "question", F.col("content").alias("answer"), "meta"]
    return inside.select(*cols).unionByName(across.select(*cols))


def _judge(i, question, answer, meta):
    kind, _, finish = meta.partition("|")
    if i == NO_ID or kind == "load":
        return []
    return defects(question or "", answer, finish)


def judged(messages):
    """(message_id, rank, defect): every triggered defect of each pair, by the id of the answer, in the order of the rules.

    Pairs that answer a load command are not judged. Pairs are judged where they stand, so only ids and defects are written."""

    def slim(row, question):
        _, _, i, _, content, meta = row
        found = _judge(i, question, content, meta)
        return (None, None, i, None, None, None, found) if found else None

    meta = F.coalesce("meta", F.lit(""))  # may be cut, so it is read by pattern; only what the rules need moves with a row
    parts = [F.regexp_extract(meta, rf'"{x}"\s*:\s*"(\w+)"', 1) for x in ("kind", "finish")]
    inside, across = _sliced(messages.withColumn("meta", F.concat_ws("|", *parts)), "defects", "array<string>", slim)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "defects": [_judge(*x) for x in zip(b["id"].tolist(), b["question"], b["content"], b["meta"], strict=True)]})

    more = across.select("id", "question", "content", "meta").mapInPandas(run, "id bigint, defects array<string>")
    every = inside.select("id", "defects").unionByName(more)
    return every.select(F.col("id").alias("message_id"), F.posexplode("defects").alias("rank", "defect"))


def found(messages):
    """One defect per pair: the first of empty, copy, refusal, truncated, language."""
    return judged(messages).where("rank = 0").select("message_id", "defect")
