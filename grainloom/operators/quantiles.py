"""Exact quantiles of groups of any size: ranges of values are refined by counts until the wanted ranks lie in small ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import kept

#: Rows that a task sorts for a rank, at most (but for rows of one value, which need no sort).
MOST = 100_000
#: Cuts of a range.
CUTS = 31
#: Tables of ranges are broadcast up to so many rows (of under 400 bytes).
BROADCAST_RANGES = 10_000


def _within(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of each range (g, lo, hi, ...), with its columns."""
    ranges = ranges.withColumnRenamed("g", "of")
    if ranges.count() <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    return rows.join(ranges, (F.col("g") == F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi"))).drop("of")


def _refined(rows: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """state with the ranges of over `most` rows cut to those parts that hold the ranks.

    Cuts are approximate quantiles of the range; how many rows lie between them and on them is counted. So a part has
    about a 31st of the rows, or one value.
    """
    big = (F.col("n") > most) & (F.col("lo") < F.col("hi"))
    inside = _within(rows, kept(state.where(big).select("g", "lo", "hi").distinct()))
    levels = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    cuts = inside.groupBy("g", "lo", "hi").agg(F.array_distinct(F.percentile_approx("v", levels, 10_000)).alias("cuts"))
    placed = _within(rows, kept(cuts))
    part = F.size(F.filter("cuts", lambda x: x < F.col("v"))) + F.size(F.filter("cuts", lambda x: x <= F.col("v")))  # odd: on a cut
    each = placed.groupBy("g", "lo", "hi", part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("a"), F.max("v").alias("b"))
    below = F.coalesce(F.sum("rows").over(Window.partitionBy("g", "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select("g", "lo", "hi", below.alias("below"), "rows", "a", "b")
    first = F.col("before") + F.col("below")
    new = state.where(big).join(each, ["g", "lo", "hi"]).where((F.col("rank") >= first) & (F.col("rank") < first + F.col("rows")))
    return state.where(~big).unionByName(new.select("g", "rank", first.alias("before"), F.col("rows").alias("n"), F.col("a").alias("lo"), F.col("b").alias("hi")))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str], name: str = "q", most: int = MOST) -> DataFrame:
    """(keys, name): for each group the array of interpolated quantiles of its values, as percentile gives them.

    No task holds a group: it is counted in ranges of values, and only ranges of at most `most` rows are sorted. Nulls
    and NaN have no rank; groups without values have no row; a null key is a key.
    """
    rows = df.select(F.struct(*keys).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    rows = kept(rows)
    sizes = kept(rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")))
    at = F.array(*[F.lit(float(p)) * (F.col("size") - 1) for p in probs])
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda x: F.array(F.floor(x), F.ceil(x)))))
    infinite = F.lit(float("inf"))
    state = sizes.select("g", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("before"), F.col("size").alias("n"), (-infinite).alias("lo"), infinite.alias("hi"))
    state = kept(state)
    while not state.where((F.col("n") > most) & (F.col("lo") < F.col("hi"))).isEmpty():
        state = kept(_refined(rows, state, most))
    open_ = kept(state.where("lo < hi").select("g", "lo", "hi", "before").distinct())
    numbered = _within(rows, open_).withColumn("rank", F.col("before") - 1 + F.row_number().over(Window.partitionBy("g", "lo", "hi").orderBy("v")))
    found = numbered.join(state.where("lo < hi").select("g", "rank"), ["g", "rank"]).select("g", "rank", "v")
    found = found.union(state.where("lo = hi").select("g", "rank", F.col("lo").alias("v"))).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("values"))

    def between(x):
        low, high = F.col("values")[F.floor(x)], F.col("values")[F.ceil(x)]
        return F.when(low == high, low).otherwise(low + (high - low) * (x - F.floor(x)))

    out = sizes.join(found, "g")
    return out.select(*[F.col("g")[c].alias(c) for c in keys], F.transform(at, between).alias(name))
