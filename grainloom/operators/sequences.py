"""Training sequences of a series, stored once: chunks with a halo, from which samples are sliced on reading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import positions

#: Rows of a chunk without its halo.
ROWS = 2048


def sequence_store(df: DataFrame, cols: Sequence[str], series: Sequence[str], date: str = "date", past: int = 112, future: int = 28, rows: int = ROWS) -> DataFrame:
    """(series, chunk, own, first, rows): each series as arrays of (date, cols) in date order.

    A chunk has up to `rows` rows of its own, the first of them at place `own` of the series, and the past - 1 rows before
    and the future rows after them, so every sample of an own row lies inside it; `first` is the place of its first row.
    So a row is stored about 1 + (past + future) / rows times, not once per sample that holds it. No task holds more than
    a chunk. A null series is a series; rows that tie in date follow in any order; an empty table gives no chunk.
    """
    rows = max(rows, past, future)
    own, place = F.expr(f"_pos div {rows}"), F.col("_pos") % rows
    near = F.array(own, F.when(place > rows - past, own + 1), F.when((place < future) & (own > 0), own - 1))
    spread = positions(df.select(*series, date, *cols), series, [date]).withColumn("chunk", F.explode(F.array_compact(near)))
    packed = spread.groupBy(*series, "chunk").agg(F.array_sort(F.collect_list(F.struct("_pos", date, *cols))).alias("v"))
    packed = packed.select(*series, "chunk", (F.col("chunk") * rows).alias("own"), F.col("v")[0]["_pos"].alias("first"), F.transform("v", lambda x: F.struct(*[x[c].alias(c) for c in (date, *cols)])).alias("rows"))
    return packed.where(F.col("first") + F.size("rows") > F.col("own"))  # a series that ends before a chunk leaves only a halo in it


def sample_places(store: DataFrame, past: int = 112, least: int = 56, future: int = 28, rows: int = ROWS) -> Column:
    """The samples of a chunk as an array of (at, offset, length): place of the current row in the chunk, from 0, and where
    its past begins and how long it is, from arithmetic on the chunk's ends."""
    rows = max(rows, past, future)
    low = F.greatest(F.col("own"), F.lit(least - 1)) - F.col("first")
    high = F.least(F.col("own") + (rows - 1) - F.col("first"), F.size("rows") - 1 - future)

    def place(at: Column) -> Column:
        start = F.greatest(F.lit(0), at - (past - 1)).cast("int")
        return F.struct(at.cast("int").alias("at"), start.alias("offset"), (at - start + 1).cast("int").alias("length"))

    return F.transform(F.when(low <= high, F.sequence(low, high)), place)


def read_samples(store: DataFrame, series: Sequence[str], date: str = "date", past: int = 112, least: int = 56, future: int = 28, rows: int = ROWS) -> DataFrame:
    """(series, date, encoder, decoder) of a store: what rolling.sequence_samples gives, sliced out of the chunks without a
    shuffle. past, future and rows are those of the store (a shorter past or future will do)."""

    def cut(s: Column) -> Column:
        v = F.col("rows")
        return F.struct(F.get(v, s["at"])[date].alias(date), F.slice(v, s["offset"] + 1, s["length"]).alias("encoder"), F.slice(v, s["at"] + 2, F.lit(future)).alias("decoder"))

    return store.select(*series, F.explode(F.transform(sample_places(store, past, least, future, rows), cut)).alias("_s")).select(*series, "_s.*")
