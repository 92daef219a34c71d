import random

import pytest
from pyspark.sql import functions as F

from sparkvane.llm import mixing, mojibake, queries, tokens
from tests import oracle


def test_ids_round_trip(spark):
    texts = [None, "", "a", "Grüße, мир 你好 <|endoftext|>", "  two  blanks\n\t", "́ x", "\U0001f6a7 x"]
    got = {r["doc_id"]: r["ids"] for r in tokens.ids_of(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))).collect()}
    assert got[0] == [] and got[1] == []
    for k, t in enumerate(texts[2:], 2):
        assert tokens.decode(got[k]) == t and 50256 not in got[k]


def test_ids_are_the_tokenizers(spark):
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for x in ("Hello  world's 12 tests", "déjà <|endoftext|> vu\n\n  x", "Überwachung der 3,5 %"):
        assert tokens.encode(x) == t.encode(x, add_special_tokens=False).ids


def test_cuts_of_long_texts_change_nothing(monkeypatch):
    rnd = random.Random(0)
    text = "".join(rnd.choice(["word ", "it's ", "12 ", "\n\n", "  ", "x, ", "é мир "]) for _ in range(4000))
    whole = tokens.encode(text)
    monkeypatch.setattr(tokens, "CHUNK", 97)
    assert [i for p in tokens.pieces(text, 97) for i in tokens.encoder().encode_ordinary(p)] == whole and "".join(tokens.pieces(text, 97)) == text
    assert list(tokens.pieces("x" * 500, 97)) == ["x" * 500]


def test_raking_meets_margins():
    cells = [{"s": a, "l": b, "size": k + 1} for k, (a, b) in enumerate((a, b) for a in "xyz" for b in "pq")]
    w = mixing.rake(cells, {"l": {"p": 0.3, "q": 0.7}, "s": {"x": 0.5, "y": 0.25, "z": 0.25}})
    for col, want in (("s", {"x": 0.5, "y": 0.25, "z": 0.25}), ("l", {"p": 0.3, "q": 0.7})):
        for v, share in want.items():
            assert sum(x for c, x in zip(cells, w, strict=True) if c[col] == v) == pytest.approx(share, abs=1e-6)
    assert mixing.rake([{"s": "x", "size": 1}], {"s": {"x": 0.5, "gone": 0.5}}) == [1.0]


def test_mix(spark):
    docs = [(k, f"word {k} " * (k % 9 + 1), "big" if k % 3 else "small") for k in range(600)] + [(1000, None, "big"), (1001, "", "small"), (1002, "x y", "unlisted"), (1003, "x y", None)]
    targets = [("big", 3.0, 1), ("small", 1.0, 2), ("gone", 1.0, 9), ("zero", 0.0, 1), ("big", 3.0, 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("uses", F.lit("x"))
    uses, shares = mixing.plan(d, spark.createDataFrame(targets, "source string, weight double, max_repeats int"))
    u = {r["doc_id"]: r for r in uses.collect()}
    assert len(u) == len(docs) and all(u[k]["uses"] == 0 for k in (1000, 1001, 1002, 1003)) and max(r["uses"] for r in u.values() if r["source"] == "big") == 1
    s = {r["source"]: r for r in shares.collect()}
    assert s["big"]["actual_share"] == pytest.approx(0.75, abs=0.01) and s["small"]["actual_share"] == pytest.approx(0.25, abs=0.01)
    assert s["gone"]["target_share"] == pytest.approx(0.2) and s["gone"]["actual_share"] == 0 and s["unlisted"]["target_share"] == 0
    # few documents in each bucket: the shares still hold
    _, small = mixing.plan(d, spark.createDataFrame(targets, "source string, weight double, max_repeats int"), per_bucket=40)
    assert {r["source"]: r["actual_share"] for r in small.collect()}["big"] == pytest.approx(0.75, abs=0.03)
    empty, none = mixing.plan(d.where("false"), spark.createDataFrame(targets, "source string, weight double, max_repeats int"))
    assert empty.count() == 0 and all(r["actual_share"] == 0 for r in none.collect())


CLEAN = [
    "Die Prüfung läuft täglich, das Ergebnis steht anschließend in der Übersicht für den März.", "Les données arrivées en retard ont été écartées du dernier contrôle, même après la revue.",
    "El tamaño de la muestra es pequeño y el año pasado cambió la campaña de otoño.", "Größere Abweichungen müssen begründet werden – siehe „Anhang“.", "The team’s dashboard rounds the value — the raw one is “ok”.",
    "Мы проверили строки таблицы и не нашли расхождений после обзора.", "Model działa stabilnie, lecz jakość danych pogarsza się z każdym miesiącem.", "A decisão depende da revisão e não há alteração na avaliação."]


@pytest.fixture(scope="module")
def model():
    return mojibake.Model(mojibake.grams(CLEAN * 30))


@pytest.mark.parametrize("text", CLEAN)
@pytest.mark.parametrize(("was", "read"), [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac_roman")])
def test_misread_utf8_is_restored(model, text, was, read):
    back = mojibake._tables(read)[1]
    bad = "".join(back[b] for b in text.encode(was))
    found, new, chain, lossy = mojibake.examine(bad, model, {})
    assert found and new == text and not lossy and chain.startswith("utf-8<")


def test_other_chains_and_mixtures(model):
    for k, was, read in ((0, "cp1252", "cp850"), (2, "cp1252", "cp437"), (5, "cp866", "cp1251"), (5, "koi8_r", "cp1251")):
        back = mojibake._tables(read)[1]
        bad = "".join(back[b] for b in CLEAN[k].encode(was, "replace"))
        found, new, _, _ = mojibake.examine(bad + "\n\n" + CLEAN[1], model, {})
        assert found and new.startswith(CLEAN[k][:20])
    twice = CLEAN[0].encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.examine(twice, model, {})[1] == CLEAN[0]
    assert mojibake.examine("relev\ufffds de compte", model, {})[::3] == (True, True)


@pytest.mark.parametrize("text", [*CLEAN, None, "", "plain", "The export showed “Ã¼” where “ü” was stored; the ticket is closed.", "Der Eintrag „Ã¤“ im Handbuch ist nur ein Beispiel für falsch gelesene Umlaute.", "NÃO ALTERAR SEM REVISÃO", "支店別の表", "✅ done ⚠️", "\ufeffx", "\u00a0"])
def test_clean_and_quoted_texts_stay(model, text):
    found, new, _, _ = mojibake.examine(text, model, {})
    assert not found and new == text


def test_copies_take_one_place_in_the_sample(spark):
    d = spark.createDataFrame([(t,) for t in CLEAN], "text string")
    copies = d.join(spark.range(20)).select("text")
    assert mojibake.train(copies, rows=8) == mojibake.train(d, rows=8) == mojibake.grams(CLEAN)
    assert mojibake.train(copies, rows=3) == mojibake.train(d, rows=3)


def test_found_documents(spark):
    bad = CLEAN[0].encode().decode("cp1252")
    rows = [(k, CLEAN[k % 8]) for k in range(80)] + [(100, bad), (101, None), (102, ""), (103, bad)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("chain", F.lit(1))
    assert sorted(r[0] for r in mojibake.found(d.unionByName(d.where("doc_id = 100"))).collect()) == [100, 103]
    assert {r["doc_id"]: r["text"] for r in mojibake.restored(d).collect()} == {100: CLEAN[0], 103: CLEAN[0]}
    assert mojibake.found(d.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, sf, name):
    oracle.same(queries.QUERIES[name](spark, sf), oracle.connect(sf), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, sf, name):
    queries.QUERIES[name](spark, sf).collect()


def test_margins_are_chosen_on_held_out_records():
    good = [(True, False, 0.4, 3.0, False)] * 99 + [(False, False, 3.0, 40.0, True)] * 99
    assert mojibake.choose(good)[:2] == (mojibake.MARGIN, mojibake.TOTAL) == mojibake.choose([])[:2]
    m, t, r = mojibake.choose([(True, False, 1.8, 9.0, False)] * 50 + [(False, False, 2.2, 11.0, True)] * 50)
    assert r["changed"] == 0 and r["found"] == 1 and (m > 1.8 or t > 9.0)
    m, t, r = mojibake.choose([(True, False, 0.3, 1.0, False)] * 50 + [(False, False, 0.9, 5.0, True)] * 50)
    assert m <= 0.9 and t <= 5.0 and r["found"] == 1 and r["changed"] == 0


def test_trials_of_a_record(model):
    rows = [r for h in range(20) for r in mojibake.trials(h, CLEAN[0], model, {})]
    assert {r[:2] for r in rows} == {(True, False), (False, True), (False, False)}
    assert all(r[4] for r in rows if r[1]) and all(r[3] < mojibake.TOTAL for r in rows if r[0])
    assert mojibake.trials(0, "plain", model, {}) == [] == mojibake.trials(0, None, model, {})
    assert mojibake.garble("é", "utf-8", "cp1252") == "Ã©" and mojibake.garble("я", "cp1252", "latin-1") is None and mojibake.garble("a", "utf-8", "cp1252") is None


def test_validated_restoration(spark):
    d = spark.createDataFrame([(k, f"{CLEAN[k % len(CLEAN)]} Nr. {k}") for k in range(160)] + [(900, CLEAN[0].encode().decode("cp1252", "replace"))], "doc_id bigint, text string")
    texts = mojibake.sample(d, rows=120)
    assert texts.count() in (119, 120)  # the garbled one is left out where its hash is among them
    m, t, r = mojibake.validate(texts, mojibake.train(d), 20)
    assert r["clean"] > 0 and r["changed"] == 0 and r["utf8 restored"] > 0.9
    assert [x[0] for x in mojibake.restored(d, rows=120, held_out=20).select("doc_id").collect()] == [900]


def test_every_record_counts_in_model_and_margins(spark):
    texts = [f"{CLEAN[k % len(CLEAN)]} Nr. {chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}" for k in range(6500)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = mojibake.train(d.unionByName(d.limit(50)))
    assert counts == mojibake.grams(texts)
    _, _, r = mojibake.validate(mojibake.sample(d), counts)
    assert r["clean"] + r["left out"] == r["garbled"] == r["utf8"] == 6500


def test_texts_garbled_without_a_sign_are_not_trained_on(spark, model):
    rows = [(k, f"{CLEAN[k % len(CLEAN)]} {'abcdefghij'[k // 80]}{'abcdefghij'[k // 8 % 10]}") for k in range(800)]
    bad = [(1000 + k, f"{CLEAN[5]} {'abcdefgh'[k]}".encode("cp1251").decode("cp1252")) for k in range(8)]
    d = spark.createDataFrame(rows + bad, "doc_id bigint, text string")
    assert mojibake.train(d) == mojibake.grams([t for _, t in rows + bad])
    assert mojibake._sum(mojibake.cleaned(mojibake.sample(d), mojibake._counts(mojibake.sample(d)))) == mojibake.grams([t for _, t in rows])
    assert sorted(r[0] for r in mojibake.found(d).collect()) == [k for k, _ in bad]
    assert mojibake._unlearned(bad[0][1], model, {})
    assert not any(mojibake._unlearned(t, model, {}) for t in ("Příliš žluťoučký kůň úpěl ďábelské ódy, a proto řekl víc, než měl říci.", "plain", *CLEAN))


def test_three_margins_are_raked(spark):
    rows = [(k, ("a", "b")[k % 2], "word " * (5 + k % 7), ("en", "de", "fr")[k % 3], ("x", "y", None)[k % 5 % 3]) for k in range(3000)]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string, language string, topic string")
    docs = mixing.sized(d, "language", "topic")
    goals = {"language": mixing.tempered_shares(docs, "language", 0.0), "topic": {"x": 0.6, "y": 0.4}}
    assert goals["language"] == pytest.approx({"de": 1 / 3, "en": 1 / 3, "fr": 1 / 3})
    t = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 3), ("gone", 1.0, 1)], "source string, weight double, max_repeats int")
    uses, shares = mixing.plan(d, t, margins=("language", "topic"), margin_shares=goals, docs=docs)
    assert uses.count() == 3000 and uses.where("topic is null").agg({"uses": "max"}).first()[0] == 0 and uses.agg({"uses": "max"}).first()[0] <= 3
    for r in mixing.margin_report(uses, goals).collect():
        assert abs(r["target_share"] - r["actual_share"]) < 0.01, r
    got = {r["source"]: r["actual_share"] for r in shares.collect()}
    assert abs(got["a"] - 0.7) < 0.01 and abs(got["b"] - 0.3) < 0.01 and got["gone"] == 0


def test_cuts_of_texts_without_blanks():
    rng = random.Random(7)
    enc = tokens.encoder()
    for alphabet in ("漢字，。かな", "0123456789abcdef", "it's we'll 12 don't  \n", "Ünï'code 'S 'll", "a1 b2\t\t c-d--e", "абв гд, 12"):
        for _ in range(40):
            t = "".join(rng.choice(alphabet) for _ in range(400))
            p = list(tokens.pieces(t, 20))
            assert "".join(p) == t and [i for x in p for i in enc.encode_ordinary(x)] == enc.encode_ordinary(t), t
    assert max(map(len, tokens.pieces("漢字，かな。" * 1000, 50))) < 60


def test_mixing_of_nothing_and_of_odd_rows(spark):
    d = spark.createDataFrame([(1, "a", None, None, "x"), (2, None, "word", "en", None), (3, "a", "", "en", "x"), (4, "b", "one two", None, None)], "doc_id bigint, source string, text string, language string, topic string").withColumn("rate", F.lit("clash")).withColumn("_s", F.lit(1)).withColumn("n_tokens", F.lit(7))
    t = spark.createDataFrame([("a", 1.0, 2), ("b", None, None), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    for x in (d, d.where("false")):
        docs = mixing.sized(x, "language", "topic")
        goals = {m: mixing.tempered_shares(docs, m) for m in ("language", "topic")}
        uses, shares = mixing.plan(x, t, margins=("language", "topic"), margin_shares=goals, docs=docs)
        assert uses.count() == x.count() and uses.where("uses > 0").count() == 0
        assert {r["source"] for r in shares.collect()} >= {"a", "b", None}
        mixing.margin_report(uses, goals).collect()
    uses, _ = mixing.plan(d, t)
    assert {r["doc_id"]: r["uses"] for r in uses.collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
