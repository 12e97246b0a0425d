"""Packing into length buckets that waste the least padding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, Scratch

#: Documents that are numbered together inside a bucket.
SALT_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def least_before(base: np.ndarray, start: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j > 0 the least of base[i] - start[i] * x[j] over i < j, and the smallest such i. start and x ascend.

    The best i never falls as j grows, so the middle of a range of j parts the candidates of the rest: all middles of one
    depth are solved at once, n log n comparisons in all.
    """
    n = len(x)
    best, arg = np.zeros(n, base.dtype), np.full(n, -1)
    lo, hi = np.array([1]), np.array([n - 1])  # ranges of j, and of the i that they may choose
    first, last = np.array([0]), np.array([n - 2])
    while True:
        some = lo <= hi
        lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        if not len(lo):
            return best, arg
        mid = (lo + hi) // 2
        sizes = np.minimum(last, mid - 1) - first + 1
        ends = np.cumsum(sizes)
        i = np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)
        cost = base[i] - start[i] * np.repeat(x[mid], sizes)
        low = np.minimum.reduceat(cost, ends - sizes)
        hits = np.flatnonzero(cost == np.repeat(low, sizes))
        at = i[hits[np.searchsorted(hits, ends - sizes)]]
        best[mid], arg[mid] = low, at
        lo, hi, first, last = np.append(lo, mid + 1), np.append(mid - 1, hi), np.append(first, at), np.append(at, last)


def best_bounds(lengths: Sequence[int], counts: Sequence[int], n_buckets: int) -> list[int]:
    """Upper bounds of at most n_buckets buckets with the least padding.

    lengths: ascending; a bucket's bound is its largest length, and its padding count * bound - sum of lengths. As the
    sum of all lengths is fixed, dynamic programming minimises the sum of count * bound over all choices of cuts, in whole
    numbers. Of equally good choices one with fewer buckets, then with earlier cuts.
    """
    x = np.asarray(lengths, np.int64)
    n = len(x)
    if not n:
        return []
    c = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    if int(c[-1]) * int(x[-1]) >= 1 << 62:
        x, c = x.astype(np.longdouble), c.astype(np.longdouble)
    cost = c[1:] * x  # one bucket up to each length
    cuts = []
    for _ in range(min(n_buckets, n) - 1):
        low, arg = least_before(cost, c[1:], x)
        new = c[1:] * x + low
        better = (arg >= 0) & (new < cost)
        cuts.append(np.where(better, arg, -1))
        cost = np.where(better, new, cost)
    bounds, j = [int(x[-1])], n - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            j = int(cut[j])
            bounds.append(int(x[j]))
    return bounds[::-1]


def pack(
    docs: DataFrame, n_buckets: int = 16, token_budget: int = 65_536, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Batches of documents of similar length, each of at most token_budget tokens, padding included.

    length: tokens of a row; by default the words of text_col. Bucket bounds minimise the padding over the histogram
    of all rows, which the driver receives: a pair of numbers for each length that occurs, at most the root of twice the
    tokens of the corpus (6 million for 2 * 10^13 tokens). A
    batch holds floor(token_budget / bound) rows of one bucket, at least one: a document above the budget is a batch
    of its own. Null and empty texts have length 0 and lie in the first bucket; rows with equal ids, and null ids, all
    stay. An empty table gives an empty result. A carried column named like one of the result's gives way to it; columns that
    are not carried play no part.

    Returns one row per row of docs: id_col, carry's columns, n_tokens long, bucket int (from 0), padded_to long (the
    bucket's bound), batch long and slot long (both from 0, batch within the bucket).
    """
    if n_buckets < 1 or token_budget < 1:
        raise ValueError("n_buckets and token_budget must be positive")
    spark = docs.sparkSession
    carry = tuple(c for c in carry if c not in (id_col, "n_tokens", "bucket", "padded_to", "batch", "slot"))
    tokens = F.coalesce((word_count(F.col(text_col)) if length is None else length).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col(id_col).alias("pk_id"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("pk_row") if carry else F.lit(None).cast("int").alias("pk_row"), tokens.alias("n_tokens"))
    if not carry:
        rows = Scratch(spark).keep(rows)  # ids and lengths only
    hist = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toArrow()
    lengths, counts = (hist.column(c).to_numpy() for c in ("n_tokens", "n"))
    bounds = best_bounds(lengths, counts, n_buckets)
    total = int(counts.sum())
    salts = 1 << max(0, (total // SALT_ROWS).bit_length() + 3)

    bucket = sum((F.when(F.col("n_tokens") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    bound = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds or [0]]), F.col("bucket") + 1)
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("padded_to", bound)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("pk_id", "n_tokens"), F.lit(salts)).cast("int"))
    sizes = rows.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("bucket", "salt", before.alias("offset"))
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("pk_id", "n_tokens")))
    at = F.col("offset") + F.col("rank") - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("padded_to"), F.lit(1)))).cast("long")
    return numbered.join(offsets, ["bucket", "salt"]).select(
        F.col("pk_id").alias(id_col), *[F.col(f"pk_row.`{c}`") for c in carry], "n_tokens", "bucket", "padded_to", F.floor(at / each).cast("long").alias("batch"), (at % each).cast("long").alias("slot")
    )
