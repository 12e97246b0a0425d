import duckdb
import pytest

from grainloom import queries as library

SF = "/root/testdata/sf0.01"


def expected(name):
    with duckdb.connect() as db:
        for t in ("lineitem", "orders", "documents"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        return sorted(db.execute(library.oracle_sql()[name]).fetchall(), key=repr)


@pytest.mark.parametrize("name, source", [("c10_busdays_all", "lineitem"), ("n6_score_news_all", "documents")])
def test_every_row(spark, rows, name, source):
    got = rows(library.queries()[name](spark, SF))
    assert got == expected(name) and len(got) == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_words_after_the_first_60_characters(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 70 + " ander", "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert library.queries()["n6_score_news_all"](spark, str(tmp_path)).first()["category"] == "policy"
