"""Landing tables whose appends read only the buckets they touch, whose reloads never leave half a table, and whose rows
are checked in the scan that writes them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .writers import new_rows

#: Buckets of a table by the hash of its key; fixed when the table is made.
BUCKETS = 64
BUCKET = "_bucket"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


# ---- bucketed tables


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched(spark: SparkSession, path: str, like: DataFrame, numbers: list[int]) -> DataFrame:
    """The stored rows of some buckets; Spark opens no file of the others."""
    if not exists(spark, path):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path).where(F.col(BUCKET).isin(numbers))


def append_bucketed(df: DataFrame, path: str, keys: list[str], seq: str | None = None, policy: str = "first", buckets: int = BUCKETS) -> list[int]:
    """Appends rows with new keys to a table laid out by the hash of its key, and returns the buckets that it read.

    policy: which row of a key in df wins, as new_rows. Stored rows never change. A bucket's new rows are one file.
    """
    spark = df.sparkSession
    rows = df.withColumn(BUCKET, bucket_of(keys, buckets))
    numbers = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # as many as there are buckets, at most
    stored = touched(spark, path, rows.drop(seq) if seq else rows, numbers)
    new = new_rows(rows, stored, [*keys, BUCKET], seq, policy)
    new = new.drop(seq) if seq else new
    new.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)
    return numbers


# ---- versioned tables


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished versions, oldest first."""
    files, where = _files(spark, f"{path}/_versions")
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def reload_version(df: DataFrame, path: str) -> str:
    """Writes df as the table's next version. Readers see the version before until all rows are written, as the last step makes
    an empty file that names the new one; a reload that fails leaves the table as it was."""
    spark = df.sparkSession
    name = f"{len(versions(spark, path)):010}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    files, where = _files(spark, f"{path}/_versions/{name}")
    if not files.createNewFile(where):
        raise FileExistsError(name)
    return name


def current(spark: SparkSession, path: str, version: int = -1) -> DataFrame:
    """The table's last version, or another by its place."""
    return spark.read.parquet(f"{path}/{versions(spark, path)[version]}")


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes all but the last versions, their names first."""
    for name in versions(spark, path)[:-keep]:
        for part in (f"{path}/_versions/{name}", f"{path}/{name}"):
            files, where = _files(spark, part)
            files.delete(where, True)


# ---- checked writes


def write_checked(df: DataFrame, path: str, rules: dict[str, Column], mode: str = "append") -> dict[str, int]:
    """Writes good and bad rows in one scan, as partitions good=true and good=false, and returns how many rows broke each rule,
    counted on the way (and rows: all of them). rules: what is wrong with a row; null is not wrong."""
    seen = Observation(f"checked-{uuid.uuid4().hex}")
    wrong = {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    counts = [F.count(F.when(c, 1)).alias(n) for n, c in wrong.items()]
    good = F.lit(True)
    for c in wrong.values():
        good = good & ~c
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).withColumn("good", good).write.mode(mode).partitionBy("good").parquet(path)
    return dict(seen.get)


def checked_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a checked table; where("good") or its opposite reads only those files."""
    return spark.read.parquet(path).withColumn("good", F.col("good").cast("boolean"))
