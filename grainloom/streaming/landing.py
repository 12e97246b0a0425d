"""Incremental landing and scoring with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.news import score_news
from ..sources.writers import append_first_wins


def land_stream(source: DataFrame, path: str, keys: list[str], checkpoint: str, seq: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Lands all files that are new since the last run; stored keys win, so a repeated batch changes nothing."""

    def land(batch: DataFrame, _: int) -> None:
        append_first_wins(prepare(batch) if prepare else batch, path, keys, seq)

    return source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored_stream(articles: DataFrame, delay: str = "30 days", time: str = "seen_at", **rules) -> DataFrame:
    """Scored articles, each URL once within the delay. articles: title, url, source and a timestamp."""
    return score_news(articles.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"]), **rules)


def land_news(articles: DataFrame, path: str, checkpoint: str, **rules) -> StreamingQuery:
    """Scores a stream of articles and lands it by URL."""
    scored = scored_stream(articles, **rules)
    return land_stream(scored, path, ["url"], checkpoint)


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window; late rows count until the watermark."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def windowed_counts_stream(events: DataFrame, path: str, checkpoint: str, time: str, key: str, value: str, width: str = "1 hour", delay: str = "2 hours") -> StreamingQuery:
    """Appends the counts of each window to a table once the watermark has passed its end, and never again.

    A run takes all files that are new since the last; sums of open windows and the watermark, the latest time of earlier
    batches less the delay, are kept by the state store between runs. A row whose window has ended by then is dropped.
    """
    counts = windowed_counts(events, time, key, value, width, delay)
    return counts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)
