"""Stored sequences, records of unknown shape, absent files, verdicts, exported weights and the order of feature sets."""

import os

import pytest
from pyspark.sql import functions as F

from grainloom import whole_plans
from grainloom.operators import rolling, sequences
from grainloom.plans import learn, versions
from grainloom.sources import readers


def daily(spark, n, name="a"):
    return spark.range(n).select(F.lit(name).alias("series"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") * 1.5).alias("x"))


@pytest.mark.parametrize("n", [0, 1, 4, 5, 16, 17, 19, 20, 21, 57])
def test_stored_sequences_are_the_windows_samples(spark, n):
    df = daily(spark, n).unionByName(daily(spark, 9, "b")).unionByName(daily(spark, 23).withColumn("series", F.lit(None).cast("string")))
    want = rolling.sequence_samples(df, ["x"], "series", past=6, least=3, future=4)
    store = sequences.sequence_store(df, ["x"], ["series"], past=6, future=4, rows=8)
    got = sequences.read_samples(store, ["series"], past=6, least=3, future=4, rows=8)
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert store.where(F.size("rows") > 8 + 5 + 4).count() == 0


def written(path):
    return sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))


def test_a_store_is_about_as_large_as_its_input(spark, tmp_path):
    df = daily(spark, 20000).withColumn("x", F.rand(7))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    store = sequences.sequence_store(spark.read.parquet(f"{tmp_path}/in"), ["x"], ["series"])
    store.coalesce(1).write.parquet(f"{tmp_path}/store")
    assert written(f"{tmp_path}/store") < 2 * written(f"{tmp_path}/in")
    assert sequences.read_samples(spark.read.parquet(f"{tmp_path}/store"), ["series"]).count() == 20000 - 55 - 28


def test_records_of_many_shapes(spark, tmp_path, rows):
    for i, text in enumerate(['[{"a": 1, "b": {"c": "2.5"}}, {"a": "7"}, 3, null]', '{"n": 0, "DATA": [{"a": 4, "b": 1.5}]}', '{"results": {"a": 9}}', "no json", ""]):
        (tmp_path / f"{i}.json").write_text(text)
    records = readers.read_records(spark, str(tmp_path))
    out = readers.record_fields(records, {"a": ("bigint", "$.a"), "b": ("double", "$.b", "$.b.c")})
    assert rows(out) == sorted([(1, 2.5), (7, None), (None, None), (None, None), (4, 1.5)], key=repr)
    objects = records.where(F.try_variant_get("record", "$.a", "bigint") < 5)
    assert readers.record_schema(objects) == "OBJECT<a: BIGINT, b: VARIANT>" and readers.record_schema(records) == "VARIANT"


def test_a_file_that_is_absent_gives_no_rows_and_a_warning(spark, tmp_path):
    with pytest.warns(UserWarning, match="no file"):
        out = readers.read_or_empty(lambda p: spark.read.csv(p), f"{tmp_path}/none.csv", "date date, v double", spark)
    assert out.count() == 0 and out.columns == ["date", "v"]


def test_verdicts(spark):
    def ranked(*names):
        return spark.createDataFrame([(n, 1.0 / (i + 1), i + 1) for i, n in enumerate(names)], "feature string, importance double, rank int")

    m = {"one": ranked("brl", "x", "y"), "two": ranked("dxy", "x", "new"), "far": ranked("x", "dxy", "new")}

    def verdicts(stronger, far):
        out = learn.version_verdicts(m, stronger, ("two", ["new", "gone"]), ("two", far), keep=3, top=2)
        return {(r["question"], r["subject"]): r["verdict"] for r in out.collect()}

    assert verdicts((("one", "x"), ("two", "dxy")), "far") == {("stronger", "dxy"): "confirmed", ("new", "new"): "keep", ("new", "gone"): "review", ("horizons", "2"): "differ"}
    assert verdicts((("one", "brl"), ("two", "dxy")), "two")[("stronger", "dxy")] == "not confirmed"
    assert verdicts((("one", "no"), ("two", "dxy")), "two")[("stronger", "dxy")] == "not confirmed"
    assert verdicts((("one", "x"), ("two", "dxy")), "two")[("horizons", "2")] == "equal"


def test_exported_weights_score_as_the_model(spark):
    df = spark.range(300).select((F.col("id") % 7).cast("double").alias("a"), F.rand(3).alias("b"), F.lit(2.0).alias("flat"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    names = ["a", "b", "flat"]
    model = learn.ensemble(names, "y", {"maxIter": 1})[2].fit(df)
    x = learn.weighted_probability(learn.probability([model], df, names, "p"), learn.exported_logistic(model, names), "q")
    assert x.where(F.abs(F.col("p") - F.col("q")) > 1e-9).count() == 0


def test_sets_have_their_columns_in_order():
    assert {v: len(versions.columns(v)) for v in versions.VERSIONS} == {
        "v1": 51, "v1_stationary": 37, "v2_interview": 53, "v2": 0, "v3": 0, "v3_enhanced": 69, "v3_clean": 66, "v3_minimal_thresh": 66, "v3_minimal": 25, "ensemble_v3_clean_t28": 66,
    }
    for v, names in versions.VERSIONS.items():
        assert len(set(names)) == len(names), v
    assert versions.columns("v1")[0] == "price_close" and versions.columns()[25:27] == ["month", "week_of_year"] and versions.columns()[-2] == "target_thresh_t28"


def test_of_equal_dates_the_last_line_of_the_last_file_counts(spark, tmp_path, rows):
    for name, v in (("b.csv", 3), ("a.csv", 1)):
        (tmp_path / name).write_text("".join(f"2001-01-0{i % 3 + 1},{v}{i}\n" for i in range(9)))
    got = rows(readers.read_two_column_csv(spark, str(tmp_path), "x"))
    assert [(str(d), x) for d, x in got] == [("2001-01-01", 36.0), ("2001-01-02", 37.0), ("2001-01-03", 38.0)]
    for name, v in (("b.csv", 3), ("a.csv", 1)):
        (tmp_path / name).write_text("day,Price\n" + "".join(f"2001M0{i % 3 + 1},{v}{i}\n" for i in range(9)))
    got = rows(readers.read_month_sheet(spark, str(tmp_path), "price", "x"))
    assert [(str(d), x) for d, x in got] == [("2001-01-01", 36.0), ("2001-02-01", 37.0), ("2001-03-01", 38.0)]


def test_search_ranks_seeded_draws(spark):
    df = spark.range(90).select(F.col("id").alias("row_no"), (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 5 > 2).cast("int").alias("y"))
    grid = {"maxDepth": [1, 2], "maxIter": [1]}
    found = learn.search_parameters(df, ["a"], "y", grid, draws=3, folds=2)
    assert found == learn.search_parameters(df, ["a"], "y", grid, draws=3, folds=2)
    assert [s for _, s in found] == sorted((s for _, s in found), reverse=True) and 1 <= len(found) <= 2
    assert all(p["maxDepth"] in (1, 2) and s == pytest.approx(1.0) for p, s in found)


@pytest.mark.parametrize("exact", [False, True])
def test_blocks_of_the_master_read_prices_that_are_written_once(spark, exact):
    files = whole_plans.full_master(spark, "/root/testdata/sf0.001", exact).inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_the_master_of_all_sets_reads_prices_that_are_written_once(spark, monkeypatch):
    class Seen(Exception):
        pass

    kept = whole_plans.chunks.kept

    def seen(df):
        if "target_updown_t28" in df.columns:
            raise Seen(df.inputFiles())
        return kept(df)

    monkeypatch.setattr(whole_plans.chunks, "kept", seen)
    with pytest.raises(Seen) as at:
        whole_plans.p3_sets(spark, "/root/testdata/sf0.001")
    assert at.value.args[0] and not any("lineitem" in f for f in at.value.args[0])
