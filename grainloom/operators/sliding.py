"""Order statistics of sliding windows: quantiles and ranks from one sorted window that moves along a series.

A row costs two binary searches and two moves inside the window, instead of a sort of its frame. Series are groups of
the cogrouped Arrow tables; long ones go in ranges (chunks.in_ranges).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import ROWS, in_ranges


def windows(values: Sequence[float | None], n: int, shift: int) -> Iterator[list[float]]:
    """For each row the sorted values of n rows, the last of which is `shift` rows before it; nulls are left out. The
    list changes as the iterator goes on."""
    window: list[float] = []
    for i in range(len(values)):
        new, old = i - shift, i - shift - n
        if old >= 0 and (v := values[old]) is not None:
            del window[bisect_left(window, v)]
        if new >= 0 and (v := values[new]) is not None:
            insort(window, v)
        yield window


def interpolated(window: list[float], q: float) -> float:
    """Quantile of sorted values, between neighbours."""
    at = q * (len(window) - 1)
    low = int(at)
    a = window[low]
    return a if at == low else a + (window[low + 1] - a) * (at - low)


def numbers(column: pa.ChunkedArray) -> list[float | None]:
    """Values as floats, NaN as null."""
    return [None if v is None or v != v else float(v) for v in column.to_pylist()]


def quantiles(values: Sequence[float | None], probs: Sequence[float], n: int, shift: int, least: int) -> list[list[float] | None]:
    """For each row the quantiles of its window, null with fewer than `least` values (one at least)."""
    return [[interpolated(w, q) for q in probs] if len(w) >= max(1, least) else None for w in windows(values, n, shift)]


def ranks(values: Sequence[float | None], n: int, least: int) -> list[float | None]:
    """For each row the average rank of its value among the last n rows, divided by the rows there are, nulls too."""
    out = []
    for i, (v, w) in enumerate(zip(values, windows(values, n, 0))):
        if v is None or len(w) < least:
            out.append(None)
        else:
            below = bisect_left(w, v)
            out.append((below + (bisect_right(w, v) - below + 1) / 2) / min(i + 1, n))
    return out


def _grouped(df: DataFrame, by: Sequence[str], order: str, name: str, kind: T.DataType, arrow: pa.DataType, column) -> DataFrame:
    """df with a column made from each group's rows in order."""
    df = df.drop(name)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        return table.append_column(name, pa.array(column(table), arrow))

    return df.groupBy(*by).applyInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def rolling_quantiles(df: DataFrame, value: str, probs: float | Sequence[float], n: int, series: Sequence[str], order: str, name: str, embargo: int = 0, current: bool = False, least: int | None = None) -> DataFrame:
    """df with the exact interpolated quantile (of a list: an array of them) of the n rows before each, or with `current` of
    the last n rows; null with fewer than `least` values, by default n. NaN counts as null.

    embargo: so many of the most recent rows are not yet known and left out.
    """
    single, shift = isinstance(probs, float), (0 if current else 1) + embargo
    levels, least = ([probs] if single else list(probs)), n if least is None else least

    def column(table: pa.Table) -> list:
        out = quantiles(numbers(table.column(value)), levels, n, shift, least)
        return [x and x[0] for x in out] if single else out

    kinds = (T.DoubleType(), pa.float64()) if single else (T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))
    return _grouped(df, series, order, name, *kinds, column)


def percentile_ranks(df: DataFrame, value: str, n: int, series: Sequence[str], order: str, name: str, least: int = 30) -> DataFrame:
    """df with the average rank of each value among those of the last n rows, divided by all rows in the frame, nulls too;
    null with fewer than `least` values. NaN counts as null."""
    return _grouped(df, series, order, name, T.DoubleType(), pa.float64(), lambda t: ranks(numbers(t.column(value)), n, least))


def rolling_quantiles_long(df: DataFrame, value: str, probs: float | Sequence[float], n: int, series: Sequence[str], order: Sequence[str], name: str, embargo: int = 0, rows: int = ROWS) -> DataFrame:
    """rolling_quantiles of series of any length, a range of rows to a task."""
    return in_ranges(df, series, order, lambda x, by, at: rolling_quantiles(x, value, probs, n, by, at, name, embargo), before=n + embargo, rows=rows)


def horizon_quantiles(df: DataFrame, value: str, horizons: Sequence[int], probs: Sequence[float], n: int, series: str, date: str) -> DataFrame:
    """(series, date, value, horizon, q array): for each horizon h the quantiles of the last n h-row returns known at each row,
    where there is one. All horizons come from one pass over a series."""
    df = df.select(series, date, value)
    fields = [*df.schema.fields, T.StructField("horizon", T.IntegerType()), T.StructField("q", T.ArrayType(T.DoubleType()))]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(date)
        x = np.array([np.nan if v is None else v for v in numbers(table.column(value))])
        out = []
        for h in horizons:
            past = np.full(len(x), np.nan)
            base = x[: max(0, len(x) - h)]
            past[h:] = np.divide(x[h:], base, out=np.full(len(base), np.nan), where=base != 0) - 1
            q = quantiles([None if v != v else v for v in past.tolist()], probs, n, 0, 1)
            have = pa.array([v is not None for v in q])
            rows = table.filter(have)
            rows = rows.append_column("horizon", pa.array([h] * rows.num_rows, pa.int32()))
            out.append(rows.append_column("q", pa.array([v for v in q if v is not None], pa.list_(pa.float64()))))
        return pa.concat_tables(out)

    return df.groupBy(series).applyInArrow(run, T.StructType(fields))
