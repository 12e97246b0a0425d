from threading import Barrier

import pytest
from pyspark.sql import functions as F

from grainloom import queries as library
from grainloom.plans import learn


@pytest.mark.parametrize("name, models", [("m4_boosted_trees", 1), ("m9_what_if", 3), ("m10_contributions", 3)])
def test_models_of_the_query(spark, monkeypatch, name, models):
    class Seen(Exception):
        pass

    def fit_all(pipelines, train):
        raise Seen(pipelines)

    monkeypatch.setattr(learn, "fit_all", fit_all)
    with pytest.raises(Seen) as seen:
        library.queries()[name](spark, "/root/testdata/sf0.001")
    made = seen.value.args[0]
    assert len(made) == models and made[0].getStages()[-1].getMaxIter() == learn.TREES["maxIter"]


def test_models_are_fitted_at_the_same_time():
    together = Barrier(3, timeout=10)

    class Slow:
        def __init__(self, n):
            self.n = n

        def fit(self, train):
            together.wait()
            return train, self.n

    assert learn.fit_all([Slow(n) for n in range(3)], "rows") == [("rows", n) for n in range(3)]


def test_parts_to_fit_on_depend_on_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(learn, "FIT_ROWS", 100)
    df = spark.range(350).select((F.col("id") % 5).alias("series"), (F.col("id") * 9 % 350).alias("date"), (F.col("id") * 0.5).alias("x"))
    parts = [learn.fit_table(df.repartition(n), ["series", "date"]).rdd.glom().collect() for n in (1, 3, 9)]
    assert parts[0] == parts[1] == parts[2] and len(parts[0]) == 4 and sum(map(len, parts[0])) == 350


def test_rows_are_dealt_before_they_are_multiplied_and_scored(spark):
    df = spark.range(9).select(F.col("id").alias("k"), (F.col("id") * 0.1).alias("a"), (F.col("id") * 0.2).alias("b"))
    out = learn.contributions(df, ["a", "b"], lambda x: x.withColumn("probability_up", F.col("a") + F.col("b")), ["k"], {"a": 0.4, "b": 0.8})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert {(r.k, r.feature): round(r.contribution, 9) for r in out.collect()} == {(k, f): round(k * x - 4 * x, 9) for k in range(9) for f, x in (("a", 0.1), ("b", 0.2))}
