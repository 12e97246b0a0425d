"""Exact top-k inner products with a bit-sliced index."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import matrix, usable

#: Rows of one bitmap, and queries that are held against it in one task.
ROW_BLOCK, QUERY_BLOCK = 16384, 1024
#: Slices of an attribute that are added; lower ones only widen the margin of rows that are then resolved exactly.
SLICES = 6
#: Vectors with a component of this size or more are kept beside the slices, as their products may not fit a long.
LARGEST = 1 << 15
LONG = 1 << 63


def packed(bits: np.ndarray) -> np.ndarray:
    """Bitmap words of a boolean array."""
    return np.frombuffer(np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little").tobytes(), np.uint64)


def add_shifted(total: list[np.ndarray], slices: list[np.ndarray], shift: int) -> None:
    """total += slices << shift, both numbers per row given as bitmaps from the least significant up."""
    carry = None
    i = shift
    for s in slices:
        while len(total) <= i:
            total.append(np.zeros_like(s))
        a = total[i]
        if carry is None:
            total[i], carry = a ^ s, a & s
        else:
            x = a ^ s
            total[i], carry = x ^ carry, (a & s) | (carry & x)
        i += 1
    while carry is not None and carry.any():
        if len(total) <= i:
            total.append(carry)
            return
        a = total[i]
        total[i], carry = a ^ carry, a & carry
        i += 1


def kth_largest(total: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest number among the rows of a bitmap, from the most significant slice downward."""
    tied, above, value = rows, 0, 0
    for s in reversed(total):
        top = tied & s
        n = int(np.bitwise_count(top).sum())
        value <<= 1
        if above + n >= k:
            tied, value = top, value | 1
        else:
            above, tied = above + n, tied & ~s
    return value


def at_least(total: list[np.ndarray], rows: np.ndarray, least: int) -> np.ndarray:
    """Bitmap of the rows whose number is `least` or more."""
    if least <= 0:
        return rows
    if least >> len(total):
        return np.zeros_like(rows)
    above, tied = np.zeros_like(rows), rows
    for i in range(len(total) - 1, -1, -1):
        if least >> i & 1:
            tied = tied & total[i]
        else:
            above, tied = above | (tied & total[i]), tied & ~total[i]
    return above | tied


class SlicedBlock:
    """The slices of each attribute, counted up from its least and down from its greatest value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.low, self.high = values.min(0), values.max(0)
        self.spread = self.high - self.low
        self.drop = max(0, int(self.spread.max()).bit_length() - SLICES)
        self.rows = packed(np.ones(len(ids), bool))
        self.up = [self._slices(values[:, d] - self.low[d]) for d in range(values.shape[1])]
        self.down = [self._slices(self.high[d] - values[:, d]) for d in range(values.shape[1])]

    def _slices(self, x: np.ndarray) -> list[np.ndarray]:
        x = x >> self.drop
        return [packed((x >> i & 1).astype(bool)) for i in range(int(x.max()).bit_length())]

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k highest inner products, but for the row `own`; ties to the smaller id."""
        total: list[np.ndarray] = [np.zeros_like(self.rows)]
        for d, q in enumerate(query.tolist()):
            slices, q = (self.up[d], q) if q > 0 else (self.down[d], -q)
            while q and slices:
                bit = (q & -q).bit_length() - 1
                add_shifted(total, slices, bit)
                q &= q - 1
        rows = self.rows.copy()
        same = np.flatnonzero(self.ids == own)
        for i in same.tolist():
            rows[i >> 6] &= ~np.uint64(1 << (i & 63))
        if len(self.ids) - len(same) > k:
            # what the dropped low bits can add to a row
            margin = int(np.abs(query).sum()) * ((1 << self.drop) - 1)
            rows = at_least(total, rows, kth_largest(total, rows, k) - (-(-margin >> self.drop)))
        at = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little", count=len(self.ids)))
        score = self.values[at] @ query
        best = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at[best]], score[best]


def exact(x: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of finite doubles of any size."""
    return [math.floor(v * scale) if abs(v) < 2.0**53 else int(v) * scale for v in x.tolist()]


class Block:
    """Bit-sliced rows, and the few large ones as they are."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, scale: int):
        self.scale, self.ids, self.x = scale, ids, x
        usual = (np.abs(x) < LARGEST).all(axis=1)
        self.sliced = SlicedBlock(ids[usual], np.floor(x[usual] * scale).astype(np.int64)) if usual.any() else None
        self.large = np.flatnonzero(~usual)

    def dump(self) -> bytes:
        return pickle.dumps(vars(self) | {"sliced": self.sliced and vars(self.sliced)})

    @staticmethod
    def load(state: bytes) -> Block:
        block, sliced = Block.__new__(Block), SlicedBlock.__new__(SlicedBlock)
        vars(block).update(pickle.loads(state))
        if block.sliced:
            vars(sliced).update(block.sliced)
            block.sliced = sliced
        return block

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[list[int], list[int]]:
        """Ids and scores of at least the k best rows."""
        ids, scores = [], []
        rest = self.large if (np.abs(query) < LARGEST).all() else np.arange(len(self.ids))
        if self.sliced and len(rest) < len(self.ids):
            i, s = self.sliced.top(np.floor(query * self.scale).astype(np.int64), own, k)
            ids, scores = i.tolist(), s.tolist()
        z = exact(query, self.scale) if len(rest) else []
        for at in rest.tolist():
            if self.ids[at] != own:
                ids.append(int(self.ids[at]))
                scores.append(max(-LONG, min(LONG - 1, sum(a * b for a, b in zip(z, exact(self.x[at], self.scale))))))
        return ids, scores


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest inner products of floor(scale * x) vectors for each query: query_id, rank int, vec_id, score long.

    queries: condition on vec_id; a query's own row is no candidate; equal scores go to the smaller id. Vectors fall
    into blocks whose attributes are bit-sliced once and kept; a task adds the slices that a query's bits select, finds
    the k-th sum from the most significant slice downward, and computes the rows within the margin of the dropped low
    bits exactly. Every pair of a query block and a vector block is one task's work, of bounded size; the best k of each
    meet in a rank by query. Vectors with a component of 2^15 or more in size are multiplied as whole numbers of any
    size; a score beyond a long counts as its end. Null and non-finite vectors, null ids, and lengths other than the
    commonest take no part; of equal ids the smallest vector counts; an empty table gives no rows. Fewer than k
    candidates: all of them. Other columns play no part.
    """
    rows, dim, total = usable(vectors, id_col, vector_col)
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.keep(rows.select("vec_id", F.col("v").cast("array<double>").alias("v")))
    asked = rows.where(queries)
    n_rows, n_asked = -(-total // ROW_BLOCK), max(1, -(-asked.count() // QUERY_BLOCK))
    hashed = F.xxhash64("vec_id")

    def build(r: tuple, block: pa.Table) -> pa.Table:
        sliced = Block(block.column("vec_id").to_numpy(), matrix(block.column("v"), dim), scale)
        return pa.table({"r": pa.array([r[0].as_py()], pa.int32()), "sliced": pa.array([sliced.dump()], pa.binary())})

    index = rows.withColumn("r", F.pmod(hashed, F.lit(n_rows)).cast("int")).groupBy("r").applyInArrow(build, "r int, sliced binary")
    left = scratch.keep(index).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    right = asked.withColumn("b", F.pmod(hashed, F.lit(n_asked)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))

    def compare(block: pa.Table, wanted: pa.Table) -> pa.Table:
        cols: list[list[int]] = [[], [], []]
        if block.num_rows and wanted.num_rows:
            sliced = Block.load(block.column("sliced")[0].as_py())
            for own, query in zip(wanted.column("vec_id").to_pylist(), matrix(wanted.column("v"), dim)):
                ids, scores = sliced.top(query, own, k)
                for col, x in zip(cols, ([own] * len(ids), ids, scores)):
                    col += x
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(c, pa.int64()) for c in cols))))

    found = left.groupBy("r", "b").cogroup(right.groupBy("r", "b")).applyInArrow(compare, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
