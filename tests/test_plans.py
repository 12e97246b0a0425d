import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainloom.plans import bands, decide, learn, news

PRICE = 67.0
CASES = [
    # inventory, open orders, safety, quantity, monthly use, p10, p50, p90, unit -> action
    ((3000, 1000, 3500, 3000, 1200, 68, 72, 78, "cbot"), "Buy"),
    ((3000, 0, 3500, 3000, 1200, 60, 64, 68, "cbot"), "Buy"),
    ((5000, 0, 3500, 2000, 1200, 58, 63, 68, "cbot"), "Split"),
    ((4000, 0, 3500, 3000, 1200, 68, 72, 78, "cbot"), "Buy"),
    ((4000, 0, 3500, 3000, 1200, 68 * 22.0462, 72 * 22.0462, 78 * 22.0462, "usd_per_ton"), "Buy"),
    ((4000, 0, 3500, 5000, 1200, 68, 72, 78, "cbot"), "Buy"),
]


def requests(spark, cases):
    schema = "id int, current_inventory_ton double, open_po_ton double, safety_stock_ton double, quantity_ton double, monthly_consumption_ton double, p10 double, p50 double, p90 double, forecast_unit string"
    df = spark.createDataFrame([(i, *map(float, c[:8]), c[8]) for i, c in enumerate(cases)], schema)
    return df.withColumns({"current_price_cbot": F.lit(PRICE), "market_avg_cbot": F.lit(66.0), "decision_date": F.lit("2026-01-01").cast("date")})


def test_scenarios(spark):
    got, rejected = decide.evaluate_scenarios(requests(spark, [c for c, _ in CASES]))
    rows = {r["id"]: r for r in got.collect()}
    assert rejected.count() == 0
    assert [rows[i]["recommendation"] for i in range(len(CASES))] == [a for _, a in CASES]
    assert rows[0]["effective_inventory_ton"] == 4000
    wait = [v["reason"] for v in rows[2]["constraint_violations"] if v["action"] == "Wait"][0]
    assert rows[2]["inventory_at_due_ton"] == pytest.approx(3000) and "when due" in wait and not rows[2]["feasible"]
    assert rows[3]["p50_ton"] == pytest.approx(rows[4]["p50_ton"], abs=1e-9)
    assert rows[5]["constraint_warnings"] and rows[5]["feasible"]
    for key in ("price_summary", "forecast_summary", "price_direction", "recommendation", "reason", "inventory_status", "split_plan"):
        assert rows[0][key]
    assert '"recommendation":"Buy"' in decide.result_json(got).where("id = 0").first()["document"]


def test_rejected(spark):
    bad = [(4000, 0, 3500, 0, 1200, 68, 72, 78, "cbot"), (4000, 0, 3500, 3000, 1200, 80, 72, 78, "cbot"), (4000, 0, 3500, 3000, 1200, 68, 72, 78, "eur")]
    got, rejected = decide.evaluate_scenarios(requests(spark, bad))
    assert got.count() == 0
    assert {r["id"]: r["reasons"] for r in rejected.collect()} == {0: ["quantity"], 1: ["quantile order"], 2: ["unit"]}


def test_requests_without_a_context_are_rejected_and_others_take_their_own_date(spark):
    days = [(s, dt.date(2025, 1, n), c, 60.0 if n > 2 else None) for s, n, c in (("a", 2, 60.0), ("a", 5, 70.0), ("a", 9, None), ("b", 5, 67.0))]
    master = spark.createDataFrame(days, "series string, date date, price_close double, market_avg_price_30d double")
    asked = [("a", dt.date(2025, 1, 1)), ("a", dt.date(2025, 1, 4)), ("a", dt.date(2025, 1, 5)), ("a", dt.date(2025, 1, 9)), ("gone", dt.date(2025, 1, 9)), ("b", None), (None, dt.date(2025, 1, 9))]
    df = requests(spark, [CASES[0][0]] * len(asked)).drop("current_price_cbot", "market_avg_cbot", "decision_date")
    df = df.join(spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, series string, decision_date date"), "id")
    good, bad = decide.evaluate_scenarios(df, master)
    assert {r["id"]: (r["current_price_cbot"], r["market_avg_cbot"], r["as_of_date"].day, r["decision_date"].day) for r in good.collect()} == {1: (60.0, None, 2, 4), 2: (70.0, 60.0, 5, 5), 5: (67.0, 60.0, 5, 5)}
    assert {r["id"]: r["reasons"] for r in bad.collect()} == {0: ["context"], 3: ["context"], 4: ["context"], 6: ["context"]}
    unknown = decide.evaluate(requests(spark, [CASES[0][0]]).withColumn("current_price_cbot", F.lit(None).cast("double"))).first()
    assert unknown["recommendation"] is None and unknown["reason_code"] is None


def test_result_documents(spark):
    got = decide.evaluate_scenarios(requests(spark, [c for c, _ in CASES]))[0]
    doc = decide.result_document(got, ["id"]).where("id = 4").first()
    assert set(doc["human_readable"].asDict()) >= {"current_price_summary", "forecast_summary", "forecast_unit", "price_direction", "recommendation", "reason", "risk_note", "inventory_status", "constraint_warnings"}
    assert doc["options"]["Wait"]["reward_usd"] == -doc["options"]["Buy"]["reward_usd"] and doc["system_defaults"]["warehouse_cap_ton"] == 4800
    assert doc["forecast_unit_desc"] == "forecast given in USD/t" and doc["forecast"]["p50"] == doc["forecast_as_given"]["p50"]


def test_news(spark):
    df = spark.createDataFrame(
        [("Drought in Brazil", "Reuters"), ("Export ban hits USDA report", "blog"), ("Record harvest, weak demand", "FT.com"), ("Banking", "wsj"), (None, None)], "title string, source string"
    )
    got = {r["title"]: r for r in news.score_news(df).collect()}
    a = got["Drought in Brazil"]
    assert (a["category"], a["sentiment_score"], a["impact_score"], a["certainty_factor"], a["weight"]) == ("weather", 0.95, 3.0, 0.8, 1.0)
    assert got["Export ban hits USDA report"]["category"] == "policy" and got["Record harvest, weak demand"]["sentiment_score"] == -1.0
    assert got["Banking"]["sentiment_score"] == 0.85
    assert news.score_news(df, match="word").where("title = 'Banking'").first()["sentiment_score"] == 0.0


def forecasts(spark, n=200):
    rng = np.random.default_rng(4)
    actual = 100 + np.cumsum(rng.normal(0, 1, n))
    p50 = actual + rng.normal(0.5, 1, n)
    return spark.createDataFrame([("a", i, float(p - 1), float(p), float(p + 1), float(x)) for i, (p, x) in enumerate(zip(p50, actual))], "series string, time_idx long, p10 double, p50 double, p90 double, actual double"), p50, actual


def test_bands(spark):
    df, p50, actual = forecasts(spark)
    res = np.abs(actual - p50)
    q = [r["q"] for r in bands.rolling_conformal(df).orderBy("time_idx").collect()]
    assert q[:60] == [None] * 60 and q[60] == pytest.approx(np.quantile(res[:60], 0.85)) and q[150] == pytest.approx(np.quantile(res[90:150], 0.85))
    late = [r["q"] for r in bands.rolling_conformal(df, embargo=7).orderBy("time_idx").collect()]
    assert late[66] is None and late[67] == pytest.approx(np.quantile(res[:60], 0.85))
    cal, test = F.col("time_idx") < 100, F.col("time_idx") >= 100
    b = bands.bias(df, cal, ["series"])
    assert b.first()["bias"] == pytest.approx(np.mean((actual - p50)[:100]))
    none = bands.bias(df, F.lit(False), ["series"])
    assert none.first()["bias"] is None and bands.correct(df, none, ["series"]).orderBy("time_idx").first()["p50"] == pytest.approx(p50[0])
    a = bands.least_alpha(df, cal, test, ["series"]).first()
    need = np.sort(np.abs(actual - (p50 + np.mean((actual - p50)[:100])))[100:])[79]
    assert a["need"] == pytest.approx(need) and np.quantile(res[:100], a["alpha"]) == pytest.approx(need)
    grid = bands.alpha_grid(df)
    assert bands.best_alpha(grid).first()["alpha"] in bands.GRID
    assert bands.bias_with_fallback(df, [F.lit(False), cal], ["series"]).first()["bias"] == pytest.approx(b.first()["bias"])


def test_auc_and_folds(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(5)
    rows = [(i, float(round(rng.random(), 1)), int(rng.random() < 0.4), D(i)) for i in range(700)]
    df = spark.createDataFrame(rows, "i int, s double, y int, date date")
    got = learn.auc(df, "s", "y", []).first()["auc"]
    want = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(df)
    assert got == pytest.approx(want)
    assert learn.auc(df.where("y = 1"), "s", "y", []).first()["auc"] is None
    folds = learn.expanding_folds(learn.numbered(df)).where("fold IS NOT NULL").groupBy("fold").count().collect()
    assert sorted((r["fold"], r["count"]) for r in folds) == [(0, 60), (1, 60), (2, 60)]
    cv = {r["fold"]: r["count"] for r in learn.time_cv(learn.numbered(df)).groupBy("fold").count().collect()}
    assert cv == {0: 120, **{k: 116 for k in range(1, 6)}}


def D(i):
    return dt.date(2020, 1, 1) + dt.timedelta(i)


def test_models(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(200):
        a, b = rng.normal(), rng.normal()
        rows.append((D(i), float(a), float(b), int(a + 0.3 * rng.normal() > 0)))
    df = learn.numbered(spark.createDataFrame(rows, "date date, a double, b double, y int"))
    models = learn.fit_all(learn.ensemble(["a", "b"], "y", {"maxIter": 3}), df)
    scored = learn.probability(models, df, ["a", "b"])
    assert learn.auc(scored, "probability_up", "y", []).first()["auc"] > 0.9
    learn.save_ensemble(models, ["a", "b"], str(tmp_path))
    again, names = learn.load_ensemble(spark, str(tmp_path), ["a", "b"])
    assert learn.probability(again, df, names).agg(F.sum("probability_up")).first()[0] == pytest.approx(scored.agg(F.sum("probability_up")).first()[0])
    with pytest.raises(ValueError):
        learn.load_ensemble(spark, str(tmp_path), ["b", "a"])
    with pytest.raises(ValueError):
        learn.probability(models, df.drop("a"), ["a", "b"])
    score = lambda v: learn.probability(models, v, ["a", "b"])
    top = learn.importance(learn.contributions(df, ["a", "b"], score, ["date"])).orderBy("rank").collect()
    assert top[0]["feature"] == "a"
    table = learn.what_if(df.limit(3), ["a", "b"], score, ["date"])
    assert table.count() == 12
    walk = learn.walk_forward(df, ["a", "b"], "y", first=120, step=40, maxIter=2)
    assert learn.fold_summary(walk, "y").count() == 2
