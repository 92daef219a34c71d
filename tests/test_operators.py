import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkvane.functions import types
from sparkvane.operators import battery, charts, citations, compare, metrics, ordered, quality, reshape, retrieval, surrogate, temporal, vision
from sparkvane.plans import models


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=997), 2)
    df = frame(spark, [(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    got = {r["prob"]: r["value"] for r in ordered.quantiles(df, ["x"], [0, 0.1, 0.25, 0.5, 0.9, 1]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(x, p), abs=1e-12)
    assert ordered.quantiles(frame(spark, [], "x double"), ["x"], [0.5]).first()["value"] is None


def test_cumulative_does_not_depend_on_splits(spark):
    df = frame(spark, [(i % 50 + i / 1000.0, i % 7) for i in range(300)], "k double, w int")
    a = {r["k"]: r["cum_w"] for r in ordered.cumulative(df, "k", ["w"]).collect()}
    b = {r["k"]: r["cum_w"] for r in ordered.cumulative(df, "k", ["w"], splits=[3.0, 3.1, 40.0]).collect()}
    assert a == b and max(a.values()) == sum(i % 7 for i in range(300))
    rows = sorted((r["k"], r["next_w"]) for r in ordered.following(df, "k", ["w"], splits=[3.0, 3.1, 40.0]).collect())
    w = dict(df.collect())
    assert all(n == w[rows[i - 1][0]] for i, (_, n) in enumerate(rows) if i) and rows[0][1] is None


def test_psi_known_answers(spark):
    df = frame(spark, [(float(i), "a") for i in range(100)] + [(float(i), "b") for i in range(10)], "v double, s string")
    assert metrics.psi(df, "v", "s", "a", "b").first()[0] == pytest.approx(8.2811)
    assert metrics.psi(df, "v", "s", "a", "c").first()[0] is None
    assert metrics.psi(df.withColumn("v", F.when(F.col("s") == "a", 1.0).otherwise(F.col("v"))), "v", "s", "a", "b").first()[0] == 0.0
    assert metrics.psi(df, "s", "s", "a", "b").first()[0] is None


@pytest.mark.parametrize(("scores", "gini"), [((1, 2, 3, 4), 1.0), ((4, 3, 2, 1), -1.0)])
def test_gini(spark, scores, gini):
    df = frame(spark, list(zip((0, 0, 1, 1), map(float, scores), strict=True)), "y int, s double")
    assert metrics.areas(df, "y", "s").first()["gini"] == gini
    one = metrics.areas(df.withColumn("y", F.lit(1)), "y", "s").first()
    assert one["roc_auc"] is None and one["pr_auc"] is None and one["gini"] is None
    assert metrics.roc_curve(df.withColumn("y", F.lit(1)), "y", "s").count() == 0


def test_auc_is_the_share_of_ordered_pairs(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    df = frame(spark, [(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    p, n = s[y == 1], s[y == 0]
    pairs = (p[:, None] > n[None, :]).sum() + 0.5 * (p[:, None] == n[None, :]).sum()
    assert metrics.areas(df, "y", "s").first()["roc_auc"] == pytest.approx(pairs / len(p) / len(n))


def test_perfect_regression(spark):
    r = metrics.regression(frame(spark, [(float(i), float(i)) for i in (1, 2, 3, 4)], "y double, p double"), "y", "p").first()
    assert (r["rmse"], r["mae"], r["r2"], r["mad"]) == (0, 0, 1, 1)


@pytest.mark.parametrize(("labels", "want"), [("aaaaaaaaaa", 1.0), ("aaaaabbbbb", 0.5), ("abcdabcdabcd", 0.25), ("aaaaaaaaab", 0.82)])
def test_hhi(spark, labels, want):
    assert metrics.hhi(frame(spark, [(c,) for c in labels] + [(None,)], "c string"), "c").first()[0] == pytest.approx(want)


def test_smote_counts(spark):
    df = frame(spark, [(0,)] * 200 + [(1,)] * 20, "y int")
    assert {tuple(r) for r in metrics.smote_counts(df, "y").collect()} == {(0, 200, 200), (1, 20, 200)}
    assert metrics.smote_counts(frame(spark, [(0,)] * 9 + [(1,)] * 3, "y int"), "y").count() == 0


def test_vif(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 400))
    c = a + b + rng.normal(size=400) * 0.01
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c}))
    r = metrics.vif(df, ["a", "b", "c"]).collect()
    assert r[0]["variable"] == "c" and r[0]["vif"] > 100
    assert all(x["vif"] < 1.1 for x in metrics.vif(df, ["a", "b"]).collect())
    assert metrics.vif(df.withColumn("a", F.when(F.col("a") > 0, F.col("a"))), ["a", "b"]).count() == 0


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 1, (30, 3)) for m in (0, 4)])
    lab = [0] * 30 + [1] * 29 + [2]
    df = frame(spark, [(v.tolist(), k) for v, k in zip(x, lab, strict=True)], "v array<double>, l int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(60):
        own = [j for j in range(60) if lab[j] == lab[i] and j != i]
        if not own:
            out.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, [j for j in range(60) if lab[j] == k]].mean() for k in set(lab) - {lab[i]})
        out.append((b - a) / max(a, b))
    assert metrics.silhouette(df, "v", "l", block=13).first()[0] == pytest.approx(np.mean(out))


def test_quality_of_a_dirty_table(spark):
    df = frame(spark, [(1.0, "x"), (1.0, "x"), (None, "y"), (4.0, None)], "a double, b string")
    assert quality.summary_line(df).endswith("1 duplicate row")
    assert {(r["column"], r["missing_count"], r["missing_pct"]) for r in quality.missing(df).collect()} == {("a", 1, 25.0), ("b", 1, 25.0)}
    nan = frame(spark, [(float("nan"),), (1.0,)], "a double")
    assert quality.missing(nan).first()["missing_count"] == 1
    empty = frame(spark, [], "a double, b string")
    assert [r["missing_pct"] for r in quality.missing(empty).collect()] == [0.0, 0.0]
    assert quality.outliers_iqr(df).count() == 0
    flat = quality.outliers_iqr(frame(spark, [(5.0,)] * 6, "a double")).first()
    assert flat["lower"] is None and flat["outliers"] == 0
    lists = frame(spark, [([1],), (None,)], "v array<int>")
    assert quality.column_validity(lists).first()["n_unique"] == 1


def test_variable_summary(spark):
    df = frame(spark, [(1.0, "a"), (None, "b"), (3.0, None), (4.0, None)], "n double, c string")
    assert {(r["variable"], r["missing_pct"], r["kind"]) for r in metrics.variable_summary(df).collect()} == {("n", 25.0, "numeric"), ("c", 50.0, "categorical")}


def test_columns_are_found_forgivingly():
    assert types.resolve_column("unit price", ["Unit_Price", "x"]) == "Unit_Price"
    with pytest.raises(types.ColumnError, match="revenue"):
        types.resolve_column("revenu", ["revenue", "x"])


def test_charts_caps_and_errors(spark):
    big = spark.range(30000).select("id", (F.col("id") * 2).alias("b"))
    assert charts.scatter(big, "id", "b", ["id"]).count() == 20000
    wide = spark.range(5).select(*(F.col("id").cast("double").alias(f"c{k}") for k in range(30)))
    assert charts.build(wide, "histograms").data.select("column").distinct().count() == 24
    with pytest.raises(charts.ChartError):
        charts.build(wide, "sunburst")
    with pytest.raises(charts.ChartError):
        charts.build(wide.where("false"), "bar", x="c0", y="c1")
    gone = frame(spark, [("a", None), ("a", None), (None, 1.0)], "k string, v double")
    assert {(r["x"], r["y"]) for r in charts.aggregate(gone, "k", "v").collect()} == {("a", 0.0), (None, 1.0)}


def test_asof_directions(spark):
    a = frame(spark, [(1, 5.0), (1, 1.0), (2, 5.0)], "g int, t double")
    b = frame(spark, [(1, 4.0, "x"), (1, 6.0, "y")], "g int, t double, v string")
    assert {(r["g"], r["t"], r["v"]) for r in temporal.asof_join(a, b, "t", ["g"]).collect()} == {(1, 5.0, "x"), (1, 1.0, None), (2, 5.0, None)}
    assert {(r["g"], r["t"], r["v"]) for r in temporal.asof_join(a, b, "t", ["g"], "forward").collect()} == {(1, 5.0, "y"), (1, 1.0, "x"), (2, 5.0, None)}


def test_range_join_two_ways(spark, monkeypatch):
    v = spark.range(200).select((F.col("id") / 2.0).alias("v"))
    r = frame(spark, [(k, float(k), float(k + 3)) for k in range(0, 90, 2)], "k int, lo double, hi double")
    a = {tuple(x) for x in temporal.range_join(v, r, "v", "lo", "hi").select("v", "k").collect()}
    monkeypatch.setattr(temporal, "RANGES_BROADCAST", 3)
    b = {tuple(x) for x in temporal.range_join(v, r, "v", "lo", "hi").select("v", "k").collect()}
    assert a == b and len(a) > 100


def test_ewm_and_moments(spark):
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"g": [1] * 20 + [2] * 20, "t": list(range(20)) * 2, "x": rng.normal(size=40)})
    p.loc[[3, 25], "x"] = np.nan
    got = temporal.ewm(spark.createDataFrame(p), "g", ["t"], "x", 0.3).toPandas().sort_values(["g", "t"])["ewm"].tolist()
    want = p.groupby("g").x.transform(lambda s: s.ewm(alpha=0.3).mean()).tolist()
    assert np.allclose(got, want)
    r = spark.createDataFrame(p[["x"]].dropna()).agg(reshape.skew("x").alias("s"), reshape.kurt("x").alias("k")).first()
    assert r["s"] == pytest.approx(p.x.skew()) and r["k"] == pytest.approx(p.x.kurt())


def test_quick_ratio_is_difflibs(spark):
    import difflib

    rng = np.random.default_rng(5)
    rows = [(i, "\n".join(rng.choice(list("abcd"), rng.integers(0, 9))), "\n".join(rng.choice(list("abcd"), rng.integers(0, 9)))) for i in range(30)]
    got = {r["i"]: r["ratio"] for r in compare.quick_ratio(frame(spark, rows, "i int, text_a string, text_b string"), ["i"]).collect()}
    for i, a, b in rows:
        assert got[i] == pytest.approx(difflib.SequenceMatcher(None, a.splitlines(), b.splitlines()).quick_ratio())


def test_text_blocks():
    a = "\n".join(f"line {k}" for k in range(20))
    ratio, blocks = compare.text_blocks(a, a.replace("line 6", "other"))
    assert len(blocks) == 1 and blocks[0][0] == "replace" and blocks[0][1] == 7 and ratio > 0.9
    assert compare.text_blocks(a, a)[1] == []


def test_tokens(spark):
    t = frame(spark, [("passes_quality_gate calculatePsi HTTPServer the x",)], "t string").select(retrieval.tokens(F.col("t"))).first()[0]
    assert t == ["passes_quality_gate", "passes", "quality", "gate", "calculatepsi", "calculate", "psi", "httpserver", "http", "server"]


def test_definition_outranks_mention(spark):
    c = frame(spark, [("r", "a.py", "def passes_gate(x):\n    return x"), ("r", "b.py", "passes_gate\n" * 6), ("r", "c.py", None), ("r", "d.py", "")], "source string, rel string, text string")
    top = retrieval.search(c, "passes_gate").collect()
    assert top[0]["rel"] == "a.py"
    with pytest.raises(ValueError, match="Invalid regex"):
        retrieval.grep(c, "(", regex=True)
    assert retrieval.grep(c, "RETURN X").first()["line_no"] == 2
    assert [r["start"] for r in retrieval.windows(frame(spark, [("s", "f", "x\n" * 75)], "source string, rel string, text string")).orderBy("start").collect()] == [0, 30, 60]


def test_citations(spark):
    files = frame(spark, [("repo", "src/a.py", "\n".join(f"x{k}" for k in range(14)))], "source string, rel string, text string")
    ev = retrieval.evidence(frame(spark, [("repo", "src/a.py", 1, 7)], "source string, rel string, start int, end int"))
    text = "see [src/a.py:L1-14] [a.py:L7-2] [src/a.py:L9-90] [b.py:L1] and [note] [src/a.py:12]"
    cit = citations.extract(frame(spark, [(1, text)], "answer_id bigint, text string"))
    got = {(r["ref"], r["start"], r["end"]): (r["status"], r["detail"]) for r in citations.check(cit, files, ev).collect()}
    assert got[("src/a.py", 1, 14)][0] == "ok" and got[("a.py", 2, 7)][0] == "ok"
    assert got[("src/a.py", 9, 90)] == ("bad_range", "src/a.py has 14 lines") and got[("b.py", 1, 1)][0] == "unknown_file" and len(got) == 4
    few = retrieval.evidence(frame(spark, [("repo", "src/a.py", 1, 1)], "source string, rel string, start int, end int"))
    r = citations.check(cit, files, few).where("start = 1 and end = 14").first()
    assert r["status"] == "not_read" and r["detail"].startswith("only 1 of 14")
    a = frame(spark, [(1, "uses `nothing_here` and `x3` [src/a.py:L1-2]")], "answer_id bigint, text string")
    assert [x["identifier"] for x in citations.identifiers(a, citations.check(citations.extract(a), files, ev), files, ev).collect()] == ["nothing_here"]


def test_identifiers_are_looked_for_in_all_shown_files(spark):
    rows = [("repo", f"f{k}.py", f"pass{k}") for k in range(1200)] + [("repo", "last.py", "def open_ledger(): q.ab7 " + "z" * 2500 + "far_away_name" + "y" * 500)]
    files = frame(spark, rows, "source string, rel string, text string")
    ev = retrieval.evidence(files.select("source", "rel", F.lit(1).alias("start"), F.lit(1).alias("end")))
    names = ["open_ledger()", "x.pen_led", "ab7", "far_away_name", "zzzzzzz", "pass0", "open_ledgers", "b77", "nowhere.at_all", "pass1200", "yyyzzzyyy"]
    a = frame(spark, [(1, " ".join(f"`{x}`" for x in names) + " [f0.py:L1]\n\n`uncited_here`")], "answer_id bigint, text string")
    got = citations.identifiers(a, citations.check(citations.extract(a), files, ev), files, ev)
    assert {r["identifier"] for r in got.collect()} == {"open_ledgers", "b77", "nowhere.at_all", "pass1200", "yyyzzzyyy"}
    few = ev.where("rel != 'last.py'")
    got = citations.identifiers(a, citations.check(citations.extract(a), files, few), files, few)
    assert {r["identifier"] for r in got.collect()} == {*names} - {"pass0"}


def test_shapley_values_add_up(spark):
    rng = np.random.default_rng(6)
    p = pd.DataFrame(rng.normal(size=(300, 3)), columns=["a", "b", "c"])
    p["y"] = (p.a + 0.5 * p.b > 0).astype(int)
    p["k"] = range(300)
    df = spark.createDataFrame(p)
    x = surrogate.prepare(df, "y", ["a", "b", "c"], ["k"])
    m = surrogate.forest(True, 3, 5).fit(x)
    s = surrogate.shap_values(m, x.drop("features"), ["a", "b", "c"], "k", True).toPandas().set_index("k")
    prob = {r["k"]: float(r["probability"][1]) for r in m.transform(x).collect()}
    for k in range(0, 300, 29):
        assert s.loc[k].sum() == pytest.approx(prob[k], abs=1e-9)
    imp = surrogate.feature_importance(df, "y", ["a", "b", "c"], "k", True, trees=10).collect()
    assert imp[-1]["feature"] == "a" and sum(r["importance"] for r in imp) == pytest.approx(1)
    rob = {r["test"]: r["score"] for r in surrogate.robustness(df, "y", ["a", "b", "c"], "k", True, trees=5).collect()}
    assert rob["degradation"] == pytest.approx(rob["baseline"] - rob["noisy"])


def test_model_queries_use_the_whole_forest(spark, sf, monkeypatch):
    class Stop(Exception):
        pass

    seen = []

    def stop(classification, depth=5, trees=surrogate.TREES):
        seen.append(trees)
        raise Stop

    monkeypatch.setattr(surrogate, "forest", stop)
    for f in (models.cv_score, models.learning_curve, models.feature_importance, models.shap_importance, models.robustness):
        with pytest.raises(Stop):
            f(spark, sf)
    assert seen == [100] * 5


def test_learning_curve_over_all_rows(spark, monkeypatch):
    df = spark.range(3600).select(F.col("id").alias("k"), (F.col("id") % 10).alias("a"), (F.col("id") % 10 * 2).alias("y"))
    monkeypatch.setattr(models, "parts", lambda s, d: df.select(F.col("k").alias("p_partkey"), F.col("y").alias("target"), *(F.col("a").alias(c) for c in models._X)))
    monkeypatch.setattr(surrogate, "forest", lambda classification, depth=5, trees=100, f=surrogate.forest: f(classification, depth, 1))
    got = models.learning_curve(spark, None).collect()
    assert [r["train_size"] for r in got] == [240, 780, 1320, 1860, 2400] and got[-1]["test_score"] > 0.8


def test_battery_isolates_failures(spark):
    df = frame(spark, [(i % 2, i / 50, "a" if i < 30 else "b", float(i)) for i in range(50)], "y int, p double, s string, f double")
    r = battery.run(df, "classification", "y", "p", "s", ["performance", "gini", "multicollinearity"])
    assert set(r) == {"variable_summary", "performance", "gini", "multicollinearity", "drift"} and all(x.error is None for x in r.values())
    assert set(r["performance"].tables) == {"roc_curve", "confusion_matrix"}
    bad = battery.run(df.withColumn("y", F.col("s")), "regression", "y", "p", None, ["performance"])
    assert bad["performance"].error
    with pytest.raises(ValueError, match="unknown tests"):
        battery.run(df, "clustering", "y", "p", tests=["gini"])
    with pytest.raises(ValueError, match="no column"):
        battery.run(df, "clustering", "zz", "p")


def test_images(spark, tmp_path):
    board = (np.indices((128, 128)).sum(0) // 8 % 2 * 255).astype(np.uint8)
    k = np.exp(-np.arange(-15, 16) ** 2 / 200.0)
    k /= k.sum()
    soft = np.apply_along_axis(lambda r: np.convolve(np.pad(r, 15, "reflect"), k, "valid"), 1, board.astype(float))
    soft = np.apply_along_axis(lambda r: np.convolve(np.pad(r, 15, "reflect"), k, "valid"), 0, soft).astype(np.uint8)
    for n, a in (("sharp", board), ("blurry", soft)):
        (tmp_path / f"{n}.png").write_bytes(vision.encode_png(np.repeat(a[:, :, None], 3, axis=2)))
    (tmp_path / "notes.txt").write_text("no image")
    q = {r["path"].rsplit("/", 1)[-1]: r for r in vision.quality(vision.images(spark, str(tmp_path))).collect()}
    assert set(q) == {"sharp.png", "blurry.png"} and q["sharp.png"]["verdict"] == "Sharp" and q["blurry.png"]["verdict"] == "Blurry"
    assert q["sharp.png"]["edge_density"] > q["blurry.png"]["edge_density"]
    a = {r["path"]: bytes(r["data"]) for r in vision.noisy(vision.images(spark, str(tmp_path))).collect()}
    assert a == {r["path"]: bytes(r["data"]) for r in vision.noisy(vision.images(spark, str(tmp_path))).collect()}
    assert battery.run_vision(spark, str(tmp_path / "gone")) == {}
    assert math.isfinite(q["sharp.png"]["laplacian_variance"])


def test_definition_scores(spark):
    from sparkvane.operators import retrieval

    rows = [("passes_quality_gate", ["quality", "gate"], 4 / 3), ("test_gate", ["quality", "gate"], 0.5), ("risk.my_tab", ["my_tab", "my", "tab"], 3.0), ("calculatePsi", ["calculatepsi"], 3.0), ("run", ["run"], 2.0), ("x", ["y"], 0.0)]
    for name, q, want in rows:
        got = spark.range(1).select(retrieval.definition_score(F.array(F.lit(name)), q)).first()[0]
        assert abs(got - want) < 1e-12, (name, got)


def test_quantiles_of_many_forms(spark):
    import numpy as np

    from sparkvane.operators.ordered import grouped_quantiles, quantiles

    rng = np.random.default_rng(5)
    n = 20_000
    cols = {"a": rng.normal(size=n), "b": rng.integers(0, 3, n).astype(float), "c": np.where(rng.random(n) < 0.9, 7.0, rng.random(n)), "d": rng.pareto(0.3, n), "e": np.full(n, np.nan), "f": np.where(rng.random(n) < 0.5, np.nan, rng.random(n))}
    df = spark.createDataFrame(list(zip(*(x.tolist() for x in cols.values()), strict=True)), "a double, b double, c double, d double, e double, f double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column"], r["prob"]): r["value"] for r in quantiles(df, list(cols), probs).collect()}
    for c, v in cols.items():
        v = v[~np.isnan(v)]
        for p in probs:
            want = float(np.quantile(v, p)) if len(v) else None
            assert got[c, p] is None if want is None else abs(got[c, p] - want) <= 1e-9 * max(1, abs(want)), (c, p)
    assert quantiles(df.limit(0), ["a"], [0.5]).first()["value"] is None and quantiles(df, [], [0.5]).count() == 0
    g = df.withColumn("g", F.when(F.col("b") == 0, None).otherwise(F.col("b").cast("int").cast("string")))
    got = {(r["group"], r["prob"]): r["value"] for r in grouped_quantiles(g, "g", "a", [0.5]).collect()}
    for k, b in ((None, 0), ("1", 1), ("2", 2)):
        assert abs(got[k, 0.5] - float(np.median(cols["a"][cols["b"] == b]))) < 1e-12


def test_ranks_places_and_next_keys(spark):
    from sparkvane.operators.ordered import next_key, places, ranks

    df = spark.createDataFrame([(k % 3, f"k{k:04d}") for k in range(500)] + [(0, "k0000"), (None, "z")], "g int, k string")
    got = {(r["g"], r["k"]): r["next"] for r in next_key(df, "g", "k").collect()}
    assert got == {(k % 3, f"k{k:04d}"): f"k{k + 3:04d}" for k in range(497)}
    assert [r["n"] for r in ranks(df, "k", "n").orderBy("k").collect()] == list(range(501))
    assert sorted(r["n"] for r in places(df, ["k", "g"], "n").collect()) == list(range(502))


def test_oversampled_rows(spark):
    import numpy as np

    from sparkvane.operators import metrics

    rows = [(0, k, float(k % 17), 0.0) for k in range(60)] + [(1, 100 + k, 10.0 * k, 5.0) for k in range(8)]
    df = spark.createDataFrame(rows, "y int, k int, a double, b double")
    out = metrics.smote_rows(df, "y", ["a", "b"], "k", neighbours=2, block=3).collect()
    assert len(out) == 52 and {r["class"] for r in out} == {1} and sorted(r["number"] for r in out) == list(range(52))
    for r in out:
        a, b = r["features"]
        assert b == 5.0 and 0 <= a <= 70 and np.isfinite(a)
    again = metrics.smote_rows(df.repartition(5), "y", ["a", "b"], "k", neighbours=2, block=5).collect()
    assert sorted((r["number"], *r["features"]) for r in again) == sorted((r["number"], *r["features"]) for r in out)
    assert metrics.smote_rows(df, "y", ["a"], "k", neighbours=8).count() == 0


def test_nearest_rows_over_many_ranges(spark):
    import numpy as np

    from sparkvane.operators.neighbours import nearest_rows

    rng = np.random.default_rng(5)
    for p, v in ((1, rng.normal(size=(900, 1))), (3, rng.integers(0, 5, (900, 3)).astype(float)), (2, np.r_[np.zeros((600, 2)), rng.normal(size=(300, 2))])):
        g, asks, keys = np.arange(900) % 2, rng.random(900) < 0.4, [f"k{k}" for k in rng.permutation(900)]
        rows = [(int(g[i]), keys[i], i if asks[i] else None, *map(float, v[i])) for i in range(900)]
        df = spark.createDataFrame(rows, "g int, key string, number bigint, " + ", ".join(f"f{i} double" for i in range(p)))
        got = {r["number"]: (r["g"], r["key"], [(n["d"], n["other"]) for n in r["near"]]) for r in nearest_rows(df, 900, p, 4, 60).collect()}
        assert set(got) == set(np.flatnonzero(asks))
        for i, found in got.items():
            d = ((v[i] - v) ** 2).sum(1)
            assert found == (g[i], keys[i], sorted((d[j], keys[j]) for j in range(900) if g[j] == g[i] and j != i)[:4])


def test_oversampling_of_large_classes_ends(spark):
    import time

    from pyspark.sql import functions as F

    from sparkvane.operators import metrics

    df = spark.range(240_000).select((F.col("id") >= 120_100).cast("int").alias("y"), "id", F.sin("id").alias("a"))
    began = time.time()
    out = metrics.smote_rows(df, "y", ["a"], "id").collect()
    assert sorted((r["class"], r["number"]) for r in out) == [(1, k) for k in range(200)]
    assert time.time() - began < 60  # all pairs of the smaller class take minutes


def test_a_file_is_not_its_own_match(spark):
    from sparkvane.operators import compare

    c = spark.createDataFrame([("s", "a.py", "alpha beta\nx = 1\n"), ("s", "b.py", "alpha beta\nx = 2\n"), ("s", "c.py", "")], "source string, rel string, text string")
    r = compare.file_to_corpus("alpha beta\nx = 1\n", c, own=("s", "a.py")).collect()
    assert [x["rel"] for x in r] == ["b.py"] and abs(r[0]["lines"] - 0.5) < 1e-12 and r[0]["coverage"] == 1.0
    assert compare.file_to_corpus("", c).count() == 0


def test_row_aligned_differences(spark):
    from sparkvane.operators import compare

    a = spark.createDataFrame([(k, f"v{k}", None) for k in range(50)], "k int, v string, z string")
    b = a.withColumn("v", F.when(F.col("k") < 5, "-1").otherwise(F.col("v")))
    assert {r["column"]: r["changed"] for r in compare.aligned_cell_diff(a, b, ["k"]).collect()} == {"k": 0, "v": 5, "z": 0}
    assert compare.aligned_cell_diff(a, b.limit(3), ["k"]).count() == 0


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_without_groups(spark, direction):
    import pandas as pd

    from sparkvane.operators import temporal

    a = pd.DataFrame({"t": [(k * 37) % 1000 for k in range(300)], "i": range(300)})
    b = pd.DataFrame({"t": list(range(100, 900, 53)), "v": range(16)})
    want = pd.merge_asof(a.sort_values("t"), b, on="t", direction=direction)
    got = temporal.asof_join(spark.createDataFrame(a), spark.createDataFrame(b), "t", direction=direction).collect()
    assert {r["i"]: r["v"] for r in got} == {int(i): None if v != v else int(v) for i, v in zip(want.i, want.v, strict=True)}


def test_weighted_means_of_a_large_group(spark):
    rng = np.random.default_rng(11)
    v = [None if k % 17 == 3 else float(x) for k, x in enumerate(rng.normal(size=3000))]
    df = spark.createDataFrame([("hot", k, x) for k, x in enumerate(v)] + [("cold", k, float(k)) for k in range(5)] + [(None, 0, 2.5)], "g string, k int, v double")
    got = {(r["g"], r["k"]): r["ewm"] for r in temporal.ewm(df.repartition(6), "g", ["k"], "v", 0.05).collect()}
    want = pd.Series(v, dtype="float64").ewm(alpha=0.05, ignore_na=False).mean()
    assert len(got) == 3006 and got[None, 0] == 2.5
    for k, w in enumerate(want):
        assert got["hot", k] is None if w != w else abs(got["hot", k] - w) < 1e-9
    assert abs(got["cold", 4] - pd.Series([0.0, 1, 2, 3, 4]).ewm(alpha=0.05).mean()[4]) < 1e-9
