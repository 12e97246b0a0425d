import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_the_columns(spark, tmp_path):
    rows = [(i, f"word{i % 4} the quick brown fox number {i % 4} runs over there and back again\nline {i}", "en", f"s{i % 2}", 80) for i in range(20)]
    rows += [(50, None, None, "s0", None), (51, "1234 !!", "en", "s1", 7), (52, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        kept[name] = docs.count()
    assert kept["language"] == 20 and kept["lines"] == 20 and 0 < kept["near_copies"] <= 20 and kept["batches"] == kept["mixture"]
    assert set(docs.columns) >= {"doc_id", "n_tokens", "bucket", "batch", "slot"}


def test_run(spark, tmp_path):
    rows = [(i, f"text {i} " * 8, "en", "s", 10) for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and out.where(F.col("padded_to") < F.col("n_tokens")).count() == 0


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "mixture", "batches"]


KIND = "doc_id long, text string, lang string, source string, n_chars long"

def through(spark, docs):
    """The documents after each stage."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        out[name] = docs = spark.createDataFrame(docs.collect(), docs.schema)
    return out


def test_columns_of_any_name_odd_rows_and_long_texts(spark):
    """Columns named like those that stages add keep their values; rows of one id, null ids and a very long text."""
    words = [f"word{i}" for i in range(3000)]
    texts = {i: " ".join(words[i * 40 : i * 40 + 30]) for i in range(20)}
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in texts.items()]
    rows += [(3, texts[3], "en", "s1", 1), (None, texts[4], "en", "s0", 1), (30, texts[5], "en", None, 1), (31, None, "en", "s0", None), (32, "12 !", None, "s1", 4)]
    rows += [(40, "\n".join(f"Line {i} of {i * 7919} a long text {i * 31}" for i in range(4000)), "en", "s1", 9)]
    own = ["lang_pred", "score", "n_lines", "n_removed", "mix_copy", "mix_key", "kept_0", "component_id", "a.b"]
    df = spark.createDataFrame([(*r, *[f"{c} of {i}" for c in own]) for i, r in enumerate(rows)], f"{KIND}, " + ", ".join(f"`{c}` string" for c in own))
    out = through(spark, df)
    for name in ("language", "lines", "near_copies", "mixture"):
        assert out[name].schema == df.schema
        for r in out[name].collect():
            i = int(r["score"].split()[-1])
            assert list(r[len(KIND.split(",")) :]) == [f"{c} of {i}" for c in own] and r["doc_id"] == rows[i][0] and r["source"] == rows[i][3]
    ids = {name: sorted((r["doc_id"] for r in x.collect()), key=repr) for name, x in out.items()}
    known = [r[0] for r in rows if r[0] not in (31, 32)]
    assert ids["language"] == ids["lines"] == sorted(known, key=repr)
    assert {r["doc_id"]: r["text"] for r in out["lines"].collect()}[30] == ""  # its line stands in 5
    assert {r["doc_id"]: r["n_chars"] for r in out["lines"].where("text <> ''").collect() if r["doc_id"] is not None} == {r["doc_id"]: len(r["text"]) for r in out["lines"].where("text <> ''").collect() if r["doc_id"] is not None}
    assert None in ids["near_copies"] and set(ids["near_copies"]) == set(known)
    assert set(ids["batches"]) <= set(known) and len(ids["batches"]) == len(ids["mixture"])


def test_empty_tables_pass(spark):
    df = spark.createDataFrame([], KIND)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, "").count() == 0, name
