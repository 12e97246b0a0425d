"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, parts

#: A Poisson count of a larger mean is the sum of independent counts of means up to this, so tables stay short.
LAMBDA_STEP = 256.0
#: Source tables up to so many rows (each of under 1,000 numbers) are broadcast; larger ones are joined by salted key.
BROADCAST_SOURCES = 1000
SALTS = 32


def _digest(n: int, *values: Column | str) -> Column:
    """The first n hexadecimal digits of an MD5, as a number."""
    cols = [F.lit(v) if isinstance(v, str) else v.cast("string") for v in values]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, n), 16, 10).cast("long")


def poisson_cdf(lam: Column) -> Column:
    """Array of P(X <= k), k = 0, 1, ..., far beyond the mean."""
    last = F.ceil(lam + 12 * F.sqrt(lam) + 30).cast("int")
    first = F.exp(-lam)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * lam / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.concat(a["all"], F.array(a["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["all"]


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, total: int | None, source_col: str) -> DataFrame:
    """(mix_source, rate): the mean number of copies of each of a source's documents."""
    counts = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.lit(1.0))
    elif not weights:
        raise ValueError("weights must name at least one source")
    else:
        if any(not w >= 0 or w == float("inf") for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        counts = counts.withColumn("w", F.coalesce(F.try_element_at(table, F.col("mix_source")), F.lit(0.0)))
    sums = counts.agg(F.sum("w").alias("all_w"), (F.lit(float(total)) if total is not None else F.sum("n").cast("double")).alias("all_n")).first()
    share = F.try_divide(F.col("w"), F.lit(sums["all_w"] or 0.0))
    return counts.select("mix_source", F.coalesce(F.lit(sums["all_n"] or 0.0) * share / F.col("n"), F.lit(0.0)).alias("rate"))


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float] | None = None, total: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """Every document repeated a Poisson number of times, so that each source reaches its share of the output.

    A source's documents have the mean repetition rate share * total / (its documents). weights: share by source, of
    any sum; sources that it lacks, and null, get none; None: equal shares for all sources, null being one. total:
    expected rows of the output, the input's number if None. A document's count inverts the Poisson distribution at a
    number in (0, 1) hashed from the seed and its id, so it does not depend on the partitions; rows with equal ids have equal
    counts (a null id counts as an id). Null and empty texts are rows like any other; an empty table stays empty.

    Returns the columns of docs, then mix_copy int (from 1) and mix_key long, dealt out and sorted by mix_key within
    partitions: a hashed global shuffle. Columns of these two names in docs are replaced;
    others pass, whatever their names.
    """
    docs = docs.drop("mix_copy", "mix_key")
    spark = docs.sparkSession
    rates = source_rates(docs, weights, total, source_col)
    rates = rates.withColumn("rounds", F.greatest(F.lit(1), F.ceil(F.col("rate") / LAMBDA_STEP)).cast("int"))
    rates = rates.select("mix_source", "rounds", poisson_cdf(F.col("rate") / F.col("rounds")).alias("cdf"))
    rates = Scratch(spark).keep(rates)
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name clashes
    key, source = (F.col(f"d.c{names.index(c)}") for c in (id_col, source_col))
    on = source.eqNullSafe(F.col("r.mix_source"))
    if rates.count() <= BROADCAST_SOURCES:
        joined = docs.alias("d").join(F.broadcast(rates).alias("r"), on)
    else:
        salt = F.pmod(F.xxhash64(key), F.lit(SALTS))
        salted = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = docs.alias("d").join(salted.alias("r"), on & (salt == F.col("r.mix_salt")))
    ident = F.coalesce(key.cast("string"), F.lit("null"))

    def drawn(i: Column) -> Column:
        u = (_digest(13, str(seed), ident, i).cast("double") + 0.5) / float(1 << 52)
        return F.size(F.filter(F.col("r.cdf"), lambda c: c < u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("r.rounds")), F.lit(0), lambda a, i: a + drawn(i))
    out = joined.select("d.*", ident.alias("mix_id"), copies.alias("mix_n")).where("mix_n > 0")
    out = out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_n"))))
    out = out.withColumn("mix_key", _digest(15, str(seed), "order", F.col("mix_id"), F.col("mix_copy")))
    out = out.drop("mix_id", "mix_n").repartition(parts(spark), "mix_key").sortWithinPartitions("mix_key")
    return out.toDF(*names, "mix_copy", "mix_key")
