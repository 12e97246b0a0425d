"""Rule-based scores of news titles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords in order of priority, and scores, that make the results.
CATEGORIES = {
    "weather": ("drought", "flood", "rain", "la nina", "la niña", "el nino", "el niño", "frost", "clima", "chuva"),
    "policy": ("rvo", "biodiesel", "mandate", "epa", "export ban", "tariff", "subsidy", "subsidies"),
    "crop": ("harvest", "yield", "planting", "usda", "wasde", "production", "crop"),
    "export": ("export", "shipment", "port", "logistics", "cargo"),
}
BULLISH = {"drought": 0.95, "ban": 0.85, "export ban": 0.9, "cut": 0.65, "cuts": 0.65, "surge": 0.75, "shortage": 0.9, "shortages": 0.9, "soaring": 0.7, "spike": 0.7, "disruption": 0.65}
BEARISH_PHRASES = {"record harvest": -1.0, "weak demand": -0.85, "bumper crop": -1.0}
BEARISH_WORDS = {"surplus": -0.85, "bumper": -0.9}
BEARISH = BEARISH_PHRASES | BEARISH_WORDS
REGIONS = (("brazil", "argentina"), 2.0), (("indonesia", "malaysia"), 2.0), (("usda", "epa", "government"), 1.0)
SOURCES = (("reuters", "bloomberg", "usda"), 0.8), (("ft.com", "financial times"), 0.7), (("wsj", "wall street journal"), 0.7)


def _has(text: Column, word: str, match: str) -> Column:
    return text.contains(word) if match == "substring" else text.rlike(r"(?<![\p{L}\p{N}])\Q" + word + r"\E(?![\p{L}\p{N}])")


def _any(text: Column, words, match: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | _has(text, w, match)
    return out


def category(title: Column, categories: Mapping[str, tuple[str, ...]] = CATEGORIES, match: str = "substring") -> Column:
    text, out = F.lower(title), F.lit("other")
    for name, words in reversed(categories.items()):
        out = F.when(_any(text, words, match), name).otherwise(out)
    return out


def sentiment(title: Column, bullish: Mapping[str, float] = BULLISH, bearish: Mapping[str, float] = BEARISH, match: str = "substring") -> Column:
    """Strongest bullish plus strongest bearish score, within -1 and 1."""
    text = F.lower(title)
    zero = [F.lit(0.0), F.lit(0.0)]
    up = F.greatest(*zero, *[F.when(_has(text, w, match), s).otherwise(0.0) for w, s in bullish.items()])
    down = F.least(*zero, *[F.when(_has(text, w, match), s).otherwise(0.0) for w, s in bearish.items()])
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up + down))


def impact(title: Column, regions=REGIONS, match: str = "substring") -> Column:
    text = F.lower(title)
    total = sum((F.when(_any(text, words, match), s).otherwise(0.0) for words, s in regions), F.lit(1.0))
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), total))


def certainty(source: Column, sources=SOURCES) -> Column:
    text, out = F.lower(source), F.lit(0.4)
    for words, s in reversed(sources):
        out = F.when(_any(text, words, "substring"), s).otherwise(out)
    return out


def weight(category_: Column, title: Column, region: str = "brazil") -> Column:
    return F.when((category_ == "weather") & F.lower(title).contains(region), 1.0).when(category_ == "policy", 0.9).otherwise(0.5)


def score_news(df: DataFrame, title: str = "title", source: str = "source", match: str = "substring", categories=CATEGORIES, bullish=BULLISH, bearish=BEARISH, regions=REGIONS, region: str = "brazil") -> DataFrame:
    """df with category, sentiment_score, impact_score, certainty_factor, weight and their product, final_score."""
    t = F.col(title)
    out = df.withColumns({"category": category(t, categories, match), "sentiment_score": sentiment(t, bullish, bearish, match), "impact_score": impact(t, regions, match), "certainty_factor": certainty(F.col(source))})
    out = out.withColumn("weight", weight(F.col("category"), t, region))
    return out.withColumn("final_score", F.col("sentiment_score") * F.col("impact_score") * F.col("certainty_factor") * F.col("weight"))


def news_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("final_score").alias("mean_score"))


def strongest(scored: DataFrame, k: int = 5, key: str = "url") -> DataFrame:
    """The k articles with the largest absolute score."""
    return scored.orderBy(F.desc(F.abs("final_score")), key).limit(k)
