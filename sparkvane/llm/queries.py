"""Queries of the text operators over the test tables, and the SQL of those that SQL can express."""
from pyspark.sql import functions as F

from ..session import table as _t
from . import chats, markup, mixing, mojibake, pairs, provenance, secrets, tokens, validity

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


#: Distinct turns of problem 2 in SQL; broken rows keep a null role or created.
_TURNS = r"""
m AS (SELECT min(id) AS id, chat_id, role, content, created FROM messages WHERE chat_id IS NOT NULL AND content IS NOT NULL
      AND length(regexp_replace(content, '[\s\p{Z}\p{C}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{FE00}-\x{FE0F}\x{034F}]', '', 'g')) > 0
      GROUP BY chat_id, role, content, created),
n AS (SELECT id, chat_id, content, created, CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant'
      WHEN r IN ('system', 'tool') THEN 'other' END AS role FROM (SELECT *, lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) AS r FROM m)),
t AS (SELECT * FROM n WHERE role IS DISTINCT FROM 'other'),
o AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY chat_id) AS total
      FROM t WINDOW w AS (PARTITION BY chat_id ORDER BY created, id)),
s AS (SELECT chat_id, count(*) AS turns, bool_and(role IS NOT NULL AND created IS NOT NULL AND coalesce(role <> before, true)
      AND (k > 1 OR role = 'user') AND (k < total OR role = 'assistant')) AS ok FROM o GROUP BY chat_id),
kept AS (SELECT chat_id FROM s WHERE ok AND chat_id IN (SELECT id FROM chats WHERE id IS NOT NULL))"""


@query("p2_found", f"""WITH {_TURNS}
SELECT chat_id FROM (SELECT id AS chat_id FROM chats UNION SELECT chat_id FROM messages) WHERE chat_id IS NOT NULL AND chat_id NOT IN (SELECT chat_id FROM kept)""")
def p2_found(spark, d):
    return chats.dropped(_t(spark, d, "messages"), _t(spark, d, "chats"))


@query("p2_turns", f"""WITH {_TURNS}
SELECT chat_id, k AS turn_no, role, content, created, id FROM o WHERE chat_id IN (SELECT chat_id FROM kept)""")
def p2_turns(spark, d):
    return chats.conversations(_t(spark, d, "messages"), _t(spark, d, "chats"))


@query("p6_found")
def p6_found(spark, d):
    return pairs.found(_t(spark, d, "messages"))


@query("p6_defects")
def p6_defects(spark, d):
    return pairs.judged(_t(spark, d, "messages")).select("message_id", "defect")


@query("p7_ids")
def p7_ids(spark, d):
    return tokens.ids_of(_t(spark, d, "documents"))


@query("p8_uses")
def p8_uses(spark, d):
    return mixing.plan(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[0].select("doc_id", "source", "n_tokens", "uses")


@query("p8_shares")
def p8_shares(spark, d):
    return mixing.plan(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[1]


def _raked(spark, d):
    """The mix with languages and topics at the square roots of their shares. A language is its first two letters, a topic the word that
    begins a document's file name; other forms are 'other'."""
    x = _t(spark, d, "documents")
    lang = F.regexp_extract(F.lower("lang"), "^([a-z]{2})(?:-|$)", 1)
    topic = F.regexp_extract("rel", r"([a-z]+)-[0-9]+\.[a-z]+$", 1)
    x = x.withColumn("language", F.coalesce(F.nullif(lang, F.lit("")), F.lit("other"))).withColumn("topic", F.coalesce(F.nullif(topic, F.lit("")), F.lit("other")))
    docs = mixing.sized(x, "language", "topic")
    goals = {m: mixing.tempered_shares(docs, m) for m in ("language", "topic")}
    uses, shares = mixing.plan(x, _t(spark, d, "mix_targets"), margins=("language", "topic"), margin_shares=goals, docs=docs)
    return uses, shares, goals


@query("p8_raked")
def p8_raked(spark, d):
    return _raked(spark, d)[0]


@query("p8_raked_shares")
def p8_raked_shares(spark, d):
    uses, shares, goals = _raked(spark, d)
    return mixing.margin_report(uses, goals).unionByName(shares.select(F.lit("source").alias("margin"), F.col("source").alias("value"), "target_share", "actual_share"))


@query("p1_found")
def p1_found(spark, d):
    return secrets.found(_t(spark, d, "files"), _t(spark, d, "sources"))


@query("p1_redacted")
def p1_redacted(spark, d):
    return secrets.redacted(_t(spark, d, "files"), _t(spark, d, "sources"))


@query("p5_found")
def p5_found(spark, d):
    return provenance.found(_t(spark, d, "files"), _t(spark, d, "sources"))


@query("p5_reasons")
def p5_reasons(spark, d):
    return provenance.flagged(_t(spark, d, "files"), _t(spark, d, "sources"))


@query("p9_found")
def p9_found(spark, d):
    return mojibake.found(_t(spark, d, "documents"))


@query("p9_restored")
def p9_restored(spark, d):
    return mojibake.restored(_t(spark, d, "documents"))


@query("p4_found")
def p4_found(spark, d):
    return markup.found(_t(spark, d, "files"), _t(spark, d, "sources"))


@query("p4_clean")
def p4_clean(spark, d):
    return markup.cleaned(_t(spark, d, "files"), _t(spark, d, "sources"))


@query("p3_found")
def p3_found(spark, d):
    return validity.found(_t(spark, d, "files"), _t(spark, d, "sources"))


@query("p3_rates")
def p3_rates(spark, d):
    return validity.rates(_t(spark, d, "files"), _t(spark, d, "sources"))
