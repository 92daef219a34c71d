import random

import pytest
from pyspark.sql import functions as F

from sparkvane.llm import chats, common, pairs

M = "id bigint, chat_id string, role string, content string, artifacts string, meta string, created double"


def rows(spark, data):
    return spark.createDataFrame([(i, c, r, t, None, None, at) for i, c, r, t, at in data], M)


def listed(spark, *ids):
    return spark.createDataFrame([(i, None) for i in ids], "id string, title string")


def test_kahn_orders_and_finds_cycles():
    order, left = chats.kahn([3, 1, 2, 9], {1: 3, 2: 1})
    assert order == [3, 1, 2, 9] and left == []
    order, left = chats.kahn([1, 2, 3, 4], {1: 2, 2: 1, 3: 2})
    assert order == [4] and left == [1, 2, 3]
    assert chats.kahn([5], {5: 5}) == ([], [5])
    assert chats.kahn([], {}) == ([], [])


CASES = {
    "good": [("user", "q", 1.0), ("assistant", "a", 2.0)],
    "roles": [(" Human", "q", 1.0), ("MODEL ", "a", 2.0), ("tool", "x", 2.5), ("system", "s", None)],
    "twice": [("user", "q", 1.0), ("user", "q", 1.0), ("bot", "a", 2.0)],
    "blank": [("user", "q", 1.0), ("user", "\u200b ", 1.5), ("ai", "a", 2.0)],
    "noreply": [("user", "q", 1.0)],
    "opens": [("assistant", "a", 1.0), ("user", "q", 2.0), ("assistant", "a", 3.0)],
    "same": [("user", "q", 1.0), ("user", "r", 2.0), ("assistant", "a", 3.0)],
    "odd": [("user", "q", 1.0), ("narrator", "x", 2.0), ("assistant", "a", 3.0)],
    "nulltime": [("user", "q", None), ("assistant", "a", 3.0)],
    "nan": [("user", "q", float("nan")), ("assistant", "a", 3.0)],
    "nullrole": [(None, "q", 1.0), ("assistant", "a", 3.0)],
    "empty": [("user", None, 1.0), ("tool", "x", 1.0)],
}
KEPT = {"good", "roles", "twice", "blank"}


@pytest.fixture(scope="module")
def cases(spark):
    data, i = [], 0
    for c, rs in CASES.items():
        for r, t, at in rs:
            i += 1
            data.append((i, c, r, t, at))
    data += [(900, None, "user", "q", 1.0), (901, "unlisted", "user", "q", 1.0), (902, "unlisted", "assistant", "a", 2.0)]
    return rows(spark, data).unionByName(rows(spark, data[:3])), listed(spark, *CASES, "silent", None)


def test_dropped_chats(cases):
    m, c = cases
    got = [r[0] for r in chats.dropped(m, c).collect()]
    assert sorted(got) == sorted((set(CASES) - KEPT) | {"unlisted", "silent"})


def test_turns(cases):
    m, c = cases
    t = chats.conversations(m, c).collect()
    assert {r["chat_id"] for r in t} == KEPT
    assert [(r["turn_no"], r["role"], r["content"]) for r in sorted((r for r in t if r["chat_id"] == "roles"), key=lambda r: r["turn_no"])] == [(1, "user", "q"), (2, "assistant", "a")]


def test_a_large_chat_is_cut_into_slices(spark):
    rnd = random.Random(1)
    data = [(k, "hot", "user" if k % 2 == 0 else "assistant", f"t{k}", float(k // 2)) for k in range(4000)]
    data += [(9000 + k, f"c{k % 97}", rnd.choice(["user", "assistant"]), f"x{k}", float(k)) for k in range(2000)]
    rnd.shuffle(data)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        m = rows(spark, data)
        ids = sorted({d[1] for d in data})
        state = {r["chat_id"]: r["kept"] for r in chats.chat_states(m, listed(spark, *ids)).collect()}
        for c in ids:
            own = [d[2] for d in sorted((d for d in data if d[1] == c), key=lambda d: (d[4], d[0]))]
            assert state[c] == (own[0] == "user" and own[-1] == "assistant" and all(a != b for a, b in zip(own, own[1:])))
        t = chats.conversations(m, listed(spark, *ids)).where("chat_id = 'hot'").orderBy("turn_no").collect()
        assert [r["content"] for r in t] == [f"t{k}" for k in range(4000)] and [r["turn_no"] for r in t] == list(range(1, 4001))
        got = {(r["message_id"], r["question"]) for r in pairs.pairs(m).collect()}
        want = set()
        for c in ids:
            own = sorted((d for d in data if d[1] == c), key=lambda d: (d[4], d[0]))
            want |= {(b[0], a[3]) for a, b in zip(own, own[1:]) if b[2] == "assistant" and a[2] == "user"}
        assert got == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_tables_and_extra_columns(spark):
    m, c = rows(spark, []), listed(spark)
    assert chats.dropped(m, c).count() == 0 and chats.conversations(m, c).count() == 0 and pairs.found(m).count() == 0
    m = rows(spark, [(1, "a", "user", "q", 1.0)]).withColumn("turns", F.lit(1)).withColumn("slice", F.lit("x")).withColumn("_h", F.lit(0))
    assert [r[0] for r in chats.dropped(m, c).collect()] == ["a"]


def test_visible(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\n",), ("\u00a0\u200b\ufeff",), ("x",), ("…",)], "t string")
    assert [r[0] for r in df.select(common.visible(F.col("t"))).collect()] == [False, False, False, False, True, True]


Q = "Where is audit_pct computed in the repository?"


@pytest.mark.parametrize(("answer", "want"), [
    (None, "empty"), ("", "empty"), ("\u200b", "empty"), ("n/a", "empty"), ("```\n```", "empty"), ("(no answer)", "empty"), ("**Answer:**", "empty"), ("...", "empty"),
    (Q, "copy"), (Q.upper(), "copy"), ("> " + Q, "copy"), ("Question: " + Q, "copy"), (Q + "\n" + Q, "copy"),
    ("I'm sorry, but I can't help with that.", "refusal"), ("I won't be able to assist with that. Please contact your administrator.", "refusal"), ("Hm, questions about cards are off limits for me.", "refusal"),
    ("That request falls outside what I may do, so I will not answer it.", "refusal"),
    ("The drift alarm fired in 2020-10, one month after the", "truncated"), ("See:\n\n| a | b |\n|---|---|\n| x |", "truncated"), ("Use this:\n\n```python\nx = 1", "truncated"), ("The rule holds [src/a.py:L7", "truncated"),
    ("Die Spalte enthält viele fehlende Werte, aber sie wird nicht benutzt.", "language"), ("Мы проверили все строки и не нашли расхождений.", "language"),
    ("It is computed in src/a.py. [src/a.py:L1-4]", None), ("0.58", None), ("No.", None), ("> " + Q + "\n\nIt is computed in one place.", None), ("The result is here:\n\n- a: 0.5\n- b: 0.7", None),
    ("I cannot confirm line 20, but the rest holds: the KS is 0.5.", None), ("Requests above 10 rows are refused by the loader, so I used a sample; the result is 3.", None), ("It is not possible to join the tables, since 12 keys repeat.", None),
    ("Sorry for the delay. The KS of cards is 0.4 on 20 rows.", None), ("Table:\n\n| a | b |\n|---|---|\n| x | 1 |", None),
])
def test_defects(answer, want):
    got = pairs.defects(Q, answer)
    assert (got[0] if got else None) == want


def test_asked_language_is_no_defect():
    de = "Die Prüfung läuft täglich, und das Ergebnis steht in der Tabelle."
    assert pairs.defects("Please answer in German: what does the policy say?", de) == []
    assert pairs.defects("What does the policy say about this?", de) == ["language"]
    assert pairs.defects("Responde en inglés, por favor. ¿Dónde se calcula?", "The value is computed in the nightly job.") == []


def test_found_pairs(spark):
    meta = '{"kind": "load", "to'
    m = spark.createDataFrame([
        (1, "a", "user", "/x/y", None, None, 1.0), (2, "a", "assistant", "/x/y", None, meta, 2.0), (3, "a", "user", Q, None, None, 3.0), (4, "a", "tool", "x", None, None, 3.5), (5, "a", "ai", " ", None, None, 4.0),
        (6, "a", "assistant", "late", None, None, 5.0), (7, "b", "user", Q, None, None, 1.0), (8, "b", "model", "The value is computed in one", None, '{"finish": "length"}', 2.0), (9, "b", "assistant", None, None, None, None),
        (10, None, "assistant", "", None, None, 1.0), (8, "b", "model", "The value is computed in one", None, '{"finish": "length"}', 2.0)], M)
    assert {tuple(r) for r in pairs.found(m).collect()} == {(5, "empty"), (8, "truncated")}


def test_every_triggered_defect():
    assert pairs.defects("Where is audit_pct computed and (if so) why, by which", "Where is audit_pct computed and (if so) why, by which") == ["copy", "truncated"]
    assert pairs.defects(Q, "Es tut mir leid, das kann ich Ihnen") == ["refusal", "truncated", "language"]


@pytest.mark.parametrize("n", [1, 10, 11, 12, 13, 60, 500])
def test_length_is_no_limit_of_emptiness(n):
    for t in ("&nbsp;" * n, "<br/>\n" * n, "<p></p>" * n, "​" * n, "- " * n):
        assert pairs.defects(Q, t) == ["empty"], t


@pytest.mark.parametrize("n", [0, 20, 30, 60, 2000])
def test_distance_is_no_limit_of_refusals(n):
    w = "wirklich " * n
    assert pairs.is_refusal(f"Ich kann {w}diese Frage nicht beantworten.") and pairs.is_refusal(f"Je {w}dois refuser.") and pairs.is_refusal(f"К сожалению, {w}не могу.")


@pytest.mark.parametrize(("answer", "want"), [
    ("Υπολογίζεται κάθε νύχτα από το πρόγραμμα.", "language"), ("この値は毎晩計算されます。", "language"), ("Il valore è calcolato ogni notte dal programma, non di giorno.", "language"), ("De waarde wordt elke nacht door het programma berekend.", "language"), ("该值每晚由程序计算。", "language"),
    ("يتم حسابه كل ليلة بواسطة البرنامج.", "language"), ("申し訳ありませんが、お答えできません。", "refusal"), ("Mi dispiace, ma non posso rispondere.", "refusal"), ("抱歉，我无法回答。", "refusal")])
def test_scripts_and_languages(answer, want):
    assert want in pairs.defects(Q, answer)
    assert "language" not in pairs.defects("Please answer in Greek, Japanese, Italian, Dutch, Chinese or Arabic: where is audit_pct computed?", answer)


def test_long_answers_are_judged_in_time():
    import time

    began = time.time()
    for t in ("ich " * 200_000, "je ne sais " * 100_000, "не " * 200_000, "i will " * 100_000, "a" * 1_000_000, "&nbsp;" * 100_000, "“" * 200_000, "[" * 100_000):
        pairs.defects(Q, t)
    assert time.time() - began < 20


def test_pairs_of_odd_rows(spark):
    m = rows(spark, [(1, "a", "user", Q, 1.0), (2, "a", "assistant", None, 2.0), (None, "a", "user", Q, 3.0), (None, "a", "assistant", "", 4.0), (5, None, "assistant", "", 5.0), (6, "a", "user", Q, 6.0), (7, "a", "assistant", Q, 7.0), (7, "a", "assistant", Q, 7.0), (8, "b", "assistant", "", 1.0), (9, "c", "user", Q, None)])
    m = m.withColumn("edge", F.lit(5)).withColumn("defects", F.lit("x")).withColumn("finish", F.lit(1)).withColumn("question", F.lit(0))
    assert sorted(tuple(r) for r in pairs.found(m).collect()) == [(2, "empty"), (7, "copy")]
    assert sorted(tuple(r) for r in pairs.judged(m).collect()) == [(2, 0, "empty"), (7, 0, "copy")]
    assert pairs.pairs(m).count() == 3 and pairs.judged(m.where("false")).count() == 0
