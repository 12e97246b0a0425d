"""Series longer than a task: places in a series, ranges with a halo, and values carried from range to range.

The plain windows of rolling and align put a series in one task, which suits daily data. These give the same results with
any number of tasks for a series; they keep one sorted table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import work_folder
from .align import asof_events

#: Rows of a range, unless a frame reaches further.
ROWS = 100_000
#: Tables of a row for each part of a sorted table are broadcast up to so many rows.
BROADCAST_PARTS = 100_000


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and whole after a lost executor."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, series: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with _pos long: a row's place in its series, from 0. A null series is a series; rows that tie follow in any order.

    Rows are sorted over all tasks by series and order, so a series spans as many tasks as it needs; each part counts
    its rows of a series, and what comes before a part is added up from these counts.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *series, *order).sortWithinPartitions(*series, *order)
    placed = kept(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    each = placed.groupBy(*series, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*series).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    names = {c: f"_of_{i}" for i, c in enumerate(series)}
    each = kept(each.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("_part").alias("_of"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")))
    if each.count() <= BROADCAST_PARTS:
        each = F.broadcast(each)
    on = F.col("_part") == F.col("_of")
    for c, n in names.items():
        on &= F.col(c).eqNullSafe(F.col(n))
    return placed.join(each, on).withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift", "_of", *names.values())


def in_ranges(df: DataFrame, series: Sequence[str], order: Sequence[str], compute: Callable[[DataFrame, list[str], str], DataFrame], before: int = 0, after: int = 0, rows: int = ROWS) -> DataFrame:
    """What compute(df, by, order) gives for each series, computed apart for ranges of it.

    compute adds columns, a row for a row, by windows partitioned by `by` and ordered by `order` whose frames reach at most
    `before` rows back and `after` rows ahead. Each range also gets so many rows of its neighbours, which go afterwards.
    """
    rows = max(rows, before, after)
    own, place = F.expr(f"_pos div {rows}"), F.col("_pos") % rows
    near = F.array(own, F.when(place >= rows - before, own + 1), F.when((place < after) & (own > 0), own - 1))
    spread = positions(df, series, order).withColumn("_range", F.explode(F.array_compact(near)))
    return compute(spread, [*series, "_range"], "_pos").where(F.col("_range") == own).drop("_range", "_pos")


def windows_in_ranges(df: DataFrame, series: Sequence[str], order: Sequence[str], columns: Callable[..., dict[str, Column]], before: int = 0, after: int = 0, rows: int = ROWS) -> DataFrame:
    """df with the columns that columns(w) makes over a window w of a series in order, as in_ranges."""
    return in_ranges(df, series, order, lambda x, by, at: x.withColumns(columns(Window.partitionBy(*by).orderBy(at))), before, after, rows)


def _ranged(df: DataFrame, series: Sequence[str], order: Sequence[str], rows: int, ends: dict[str, Column], carried: dict[str, Callable]) -> tuple[DataFrame, Column]:
    """df in ranges with, for each name, what the ranges before a row's own carry to it; and the window of a range."""
    placed = positions(df, series, order).withColumn("_range", F.expr(f"_pos div {rows}"))
    each = placed.groupBy(*series, "_range").agg(*[c.alias(n) for n, c in ends.items()])
    earlier = Window.partitionBy(*series).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_of_{i}" for i, c in enumerate(series)}
    each = each.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("_range").alias("_of"), *[carried[n](F.col(n)).over(earlier).alias(n) for n in ends])
    on = F.col("_range") == F.col("_of")
    for c, n in names.items():
        on &= F.col(c).eqNullSafe(F.col(n))
    return placed.join(each, on).drop("_of", *names.values()), Window.partitionBy(*series, "_range").orderBy("_pos")


def carry_last(df: DataFrame, cols: Sequence[str], series: Sequence[str], order: Sequence[str], rows: int = ROWS) -> DataFrame:
    """df with each column's nulls filled by its last value before, in two passes: the last value of each range, then
    inside each range from that of the ranges before."""
    ends = {f"_last_{i}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))) for i, c in enumerate(cols)}
    placed, w = _ranged(df, series, order, rows, ends, {n: lambda c: F.last(c, ignorenulls=True) for n in ends})
    inside = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_last_{i}")) for i, c in enumerate(cols)}
    return placed.withColumns(filled).drop("_range", "_pos", *ends)


def mean_before(df: DataFrame, value: str, name: str, series: Sequence[str], order: Sequence[str], rows: int = ROWS) -> DataFrame:
    """df with the mean of all values of the series before each row: sum and count of each range, then inside each range.
    Sums of decimals are exact; those of doubles may differ in their last digits from another order."""
    ends = {"_sum": F.sum(value), "_count": F.count(value)}
    placed, w = _ranged(df, series, order, rows, ends, dict.fromkeys(ends, F.sum))
    inside, none = w.rowsBetween(Window.unboundedPreceding, -1), F.lit(0)
    total, n = F.coalesce("_sum", none) + F.coalesce(F.sum(value).over(inside), none), F.coalesce("_count", none) + F.coalesce(F.count(value).over(inside), none)
    return placed.withColumn(name, F.when(n > 0, total.cast("double") / n)).drop("_range", "_pos", *ends)


def align_asof_long(release: DataFrame, backbone: DataFrame, keys: Sequence[str], date: str = "date", rows: int = ROWS) -> DataFrame:
    """align_asof for keys with more rows than a task should hold: the carried values pass from range to range."""
    events, cols = asof_events(release, backbone, list(keys), date)
    return carry_last(events, cols, keys, [date, "_side"], rows).where("_side = 1").select(*backbone.columns, *cols)
