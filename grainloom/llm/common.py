"""What several corpus operators share: tables in the shared folder, document blocks, components, membership filters."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words everywhere in this package.
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. Only a local master, whose executors
    share one machine, may do without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="grainloom-"))
    return sc.getCheckpointDir()


class Scratch:
    """Tables written once to the shared folder and read again; they cut the lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.count, self.kept = 0, {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes kept tables that nothing reads any more."""
        for df in tables:
            _, path = self.kept.pop(id(df))
            path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def only(self, *tables: DataFrame) -> None:
        """Removes all kept tables but these, which a result still reads."""
        stay = {id(df) for df in tables}
        self.drop(*[df for df, _ in self.kept.values() if id(df) not in stay])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, *keep: Column) -> tuple[DataFrame, int]:
    """(id, text, block) dealt out by block, and the number of blocks.

    A block is a function of the row alone, so a recomputed task sees the same blocks. Their number follows the
    bytes of text; a block's size follows block_bytes, beyond which only a single longer document goes.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long") + 64)).first()[0] or 0
    n = max(math.ceil(total / block_bytes), parts(spark))
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), block.alias("block"), *keep).repartition(n, "block"), n


def pieces(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes of a text column, so that what a task derives from them stays small."""
    size = pc.cumulative_sum(pc.add(pc.fill_null(pc.binary_length(batch.column(column)), 0), 64).cast(pa.int64())).to_numpy()
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right"))
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    out = h >> np.uint64(33)
    out ^= h
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        out *= np.uint64(factor)
        out ^= out >> np.uint64(33)
    return out


def binary(values: list) -> pa.Array:
    return pa.array(values, type=pa.binary())


def components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of an undirected graph; root is the smallest node of its component.

    Alternating large-star and small-star steps on tables in the shared folder until nothing moves; each step is a
    pre-aggregated minimum per node, kept as a table, and a join with it, so that Spark can split a node with very many
    edges over several tasks.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    now = scratch.keep(now)
    state = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.keep(large)
        scratch.drop(low)
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        nxt = scratch.keep(small)
        scratch.drop(now, large, low)
        now = nxt
        seen = now.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v")), F.countDistinct("u")).first()
        if seen[0] == seen[2] and tuple(seen) == state or seen[0] == 0:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = tuple(seen)


#: Bits of a membership filter: 16 for each key, but 4 MB at least and 32 MB at most. A full filter only lets more rows
#: through to the exact join behind it.
LEAST_BITS, MOST_BITS = 1 << 25, 1 << 28


def filter_bits(keys: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys - 1).bit_length()))


def low_bits(c: Column, bits: int) -> Column:
    return c.bitwiseAND(F.lit(bits - 1))


def membership(keys: DataFrame, at: Column) -> DataFrame:
    """(bucket, bits): which positions (from 0) occur, 32768 to a row of 4 KB."""
    rows = keys.select((at + 1).alias("at"))  # bucket b holds 32768 * (b - 1) + 1 to 32768 * b
    return rows.groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))


def filter_array(keys: DataFrame, key: str, count: int) -> np.ndarray:
    """A membership filter of `count` 64-bit keys as bytes, for use in Python tasks."""
    bits = filter_bits(count)
    out = np.zeros(bits // 8, np.uint8)
    for b, row in membership(keys, low_bits(F.col(key), bits)).collect():  # 32 MB at most
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(row), np.uint8)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the low bits of 64-bit keys are in the filter."""
    at = (keys & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, name: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key may be in the column `name` of keys, and those whose key is not; nulls are not.

    A filter of keys is broadcast, so that the others need no shuffle.
    """
    bits = filter_bits(keys.count())
    rows = scratch.keep(membership(keys, low_bits(F.xxhash64(name), bits)).toDF("maybe_bucket", "maybe_bits"))
    at = low_bits(F.xxhash64(key), bits)
    byte = F.conv(F.hex(F.expr("substring(maybe_bits, cast(maybe_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = df.withColumn("maybe_bit", at.bitwiseAND(F.lit(32767))).join(F.broadcast(rows), F.shiftright(at, 15) + 1 == F.col("maybe_bucket"), "left")
    found = found.withColumn("maybe_hit", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(maybe_bit % 8 as int))")) != 0, F.lit(False)) & key.isNotNull())
    return tuple(found.where(c).drop("maybe_bit", "maybe_bucket", "maybe_bits", "maybe_hit") for c in (F.col("maybe_hit"), ~F.col("maybe_hit")))


def packed_rows(key: np.ndarray, n: int, *values: np.ndarray) -> list[tuple]:
    """(shard, key bytes, bytes of each value) of 64-bit keys, which must ascend; a shard has an equal range of keys."""
    shard = ((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    used, first = np.unique(shard, return_index=True)
    cuts = [*first.tolist(), len(key)]
    return [(int(s), *(x[a:b].tobytes() for x in (key, *values))) for s, a, b in zip(used, cuts, cuts[1:])]


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
