import datetime as dt

from pyspark.sql import functions as F

from grainloom.functions import calendar as cal
from grainloom.functions import clean


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


def test_prices(spark):
    for text, want in [('"1,234.50"', 1234.5), ("-", None), ("—", None), ("", None), (" 12 ", 12.0), ("nan", None), ("abc", None), (None, None), ("-3.5", -3.5)]:
        assert one(spark, text, clean.parse_price) == want, text


def test_volumes(spark):
    for text, want in [("1.5K", 1500.0), ("2.3m", 2300000.0), ("4B", 4e9), ("7", 7.0), ("-", None)]:
        assert one(spark, text, clean.parse_volume) == want, text


def test_numbers_of_odd_form_without_patterns(spark):
    """A pattern a value took most of the time of long exports."""
    for text, price, volume in [("1\t2\x0b3\r\n", 123.0, 123.0), ("'5' k\"", None, 5000.0), ("5KK", None, None), ("K", None, None), ("NaN", None, None), ("–", None, None), ("1e3M", None, 1e9), (",", None, None)]:
        assert (one(spark, text, clean.parse_price), one(spark, text, clean.parse_volume)) == (price, volume), text
    plan = spark.createDataFrame([("1",)], "x string").select(clean.parse_price(F.col("x")), clean.parse_volume(F.col("x")))
    assert "regexp" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()


def test_dates(spark):
    for text, want in [("03/04/2020", dt.date(2020, 3, 4)), ("25/12/2020", dt.date(2020, 12, 25)), ("2020-01-05", dt.date(2020, 1, 5)), ("x", None)]:
        assert one(spark, text, clean.parse_date_two_pass) == want, text
    for text, want in [("1960M01", dt.date(1960, 1, 1)), ("2001-05-17", dt.date(2001, 5, 1)), ("1960M13", None)]:
        assert one(spark, text, clean.parse_month_code) == want, text


def test_keys(spark):
    for text, want in [("2020", 2020.0), ("2020/21", 2020.0), ("20/21", 20.0), ("x", -1e9), (None, -1e9)]:
        assert one(spark, text, clean.marketing_year_key) == want, text
    for text, want in [("현물", "spot"), (" FWD ", "forward"), ("swap", "other")]:
        assert one(spark, text, clean.normalise_contract_type) == want, text


def test_zero_divisors_and_infinity(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("inf"), 2.0), (float("nan"), 2.0)], "a double, b double")
    assert [r[0] for r in df.limit(1).select(clean.ratio(F.col("a"), F.col("b"))).collect()] == [None]
    assert [r[0] for r in clean.clean_inf(df).collect()] == [1.0, None, None]


def test_half_even(spark):
    assert spark.range(1).select(clean.half_even(F.lit(2.5), 0)).first()[0] == 2.0


def test_date_columns(spark):
    df = spark.createDataFrame([("2020-01-01", "a", "2020-01-0%d" % i) for i in range(1, 6)], "release_date string, name string, when_ string")
    assert clean.detect_date_columns(df) == ["release_date", "when_"]
    assert clean.normalise_dates(spark.createDataFrame([("2020/01/02",), ("x",)], "d string"), ["d"]).collect()[0][0] == "2020-01-02"


def test_calendar_against_python(spark):
    start = dt.date(2019, 11, 1)
    days = [start + dt.timedelta(i) for i in range(900)]
    rows = spark.createDataFrame([(d,) for d in days], "date date").withColumns(cal.event_features(F.col("date")) | cal.season_features(F.col("date"))).collect()
    around = [start + dt.timedelta(i) for i in range(-70, 970)]
    tuesdays = [d for d in around if d.weekday() == 1 and 8 <= d.day <= 14]

    def between(a, b):
        return sum((a + dt.timedelta(i)).weekday() < 5 for i in range(1, (b - a).days + 1))

    for r in rows:
        d = r["date"]
        after, before = min(t for t in tuesdays if t >= d), max(t for t in tuesdays if t <= d)
        assert r["days_to_wasde"] == min(30, between(d, after)) and r["days_since_wasde"] == min(30, between(before, d))
        assert r["wasde_release_day"] == (d in tuesdays) and r["week_of_year"] == d.isocalendar()[1]
        assert r["is_wasde_week"] == any(t.isocalendar()[:2] == d.isocalendar()[:2] for t in tuesdays)
        assert r["days_to_cftc"] == (4 - d.weekday()) % 7


def test_calendar_expand(spark, rows):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 1, 4), 2.0)], "s string, date date, v double")
    out = rows(cal.calendar_expand(df, ["s"], "date", ["v"]).select("date", "v", "is_interpolated"))
    assert [(r[1], r[2]) for r in out] == [(1.0, 0), (1.0, 1), (1.0, 1), (2.0, 0)]
    gaps = spark.createDataFrame([("a", dt.date(2020, 1, 5)), ("a", dt.date(2020, 4, 5))], "s string, date date")
    assert len(rows(cal.month_gaps(gaps, ["s"], "date"))) == 2
