"""Approximate nearest neighbours: inverted lists of product-quantised residuals, reranked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import matrix, usable

#: The index is fitted on so many vectors at most (the ones whose ids hash lowest), fewer if they are long; all are indexed.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 4_000_000
#: Codes of a group of lists, and queries, that a task compares at a time.
LIST_BLOCK, QUERY_BLOCK = 8192, 2048


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    d = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    if n == 1:
        return d.argmin(1)[:, None]
    part = np.argpartition(d, min(n, d.shape[1]) - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1, kind="stable"), 1)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    pool = np.unique(x, axis=0)
    centres = pool[rng.choice(len(pool), min(k, len(pool)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)[:, 0]
        order = at.argsort(kind="stable")
        own, first, n = np.unique(at[order], return_index=True, return_counts=True)
        centres[own] = np.add.reduceat(x[order], first) / n[:, None]
    return centres


class Index:
    """Coarse centres, and codebooks of the residuals' parts."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, seed: int = 7):
        self.dim = sample.shape[1]
        self.width = -(-self.dim // parts)
        self.parts = -(-self.dim // self.width)
        self.centres = k_means(sample, lists, 12, seed)
        rest = self._split(sample - self.centres[nearest(sample, self.centres)[:, 0]])
        self.books = [k_means(np.ascontiguousarray(rest[:, p]), 256, 8, seed + 1 + p) for p in range(self.parts)]

    def _split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.parts * self.width - self.dim))).reshape(len(x), self.parts, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest(x, self.centres)[:, 0]
        rest = self._split(x - self.centres[at])
        return at, np.stack([nearest(rest[:, p], b)[:, 0] for p, b in enumerate(self.books)], 1).astype(np.uint8)

    def probes(self, sample: np.ndarray, k: int, target: float, queries: int = 256) -> int:
        """How many of the nearest lists hold the share `target` of the k nearest neighbours within the sample."""
        asked = sample[:queries]
        d = (sample**2).sum(1)[None, :] - 2 * asked @ sample.T
        d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
        if len(sample) <= k:
            return len(self.centres)
        true = np.argpartition(d, k - 1, axis=1)[:, :k]
        of = nearest(sample, self.centres)[:, 0]
        order = nearest(asked, self.centres, len(self.centres))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
        return int(np.quantile(np.take_along_axis(place, of[true], 1), target, method="higher")) + 1

    def distances(self, query: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Approximate squared distances of a query to the coded vectors of one list, from a table of its parts."""
        rest = self._split((query - self.centres[at])[None])[0]
        out = np.zeros(len(codes))
        for p, b in enumerate(self.books):
            out += ((b - rest[p]) ** 2).sum(1)[codes[:, p]]
        return out


def search(
    vectors: DataFrame, queries: Column, k: int = 10, lists: int | None = None, target: float = 0.97, parts: int | None = None, rerank: int = 200, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k nearest neighbours of each query vector by Euclidean distance: query_id, rank int, vec_id, score double.

    queries: condition on vec_id; a query's own row is no candidate. Each vector lies in the inverted list of its
    nearest coarse centre (lists: the square root of their number by default, 4096 at most), as codes of a part of its
    residual each (parts: one for four components). A query looks through as many of its nearest lists as hold the
    share `target` of true neighbours within the fitting sample, ranks their codes by its distance tables, ties to the smaller id, and reranks the best `rerank` by exact distance in double precision.
    Codes travel only to the blocks of queries that probe their list. Null, zero and non-finite vectors and null ids take no part; of equal ids the smallest vector counts; equal
    vectors all stay candidates. Only vectors of the commonest length take part. With fewer than k candidates found,
    there are fewer rows; an empty table gives none. Other columns play no part.
    """
    if k > rerank:
        raise ValueError("rerank must be k at least")
    spark = vectors.sparkSession
    rows, dim, total = usable(vectors, id_col, vector_col, F.exists(F.col("v"), lambda x: x != 0))
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], result)
    scratch = Scratch(spark)
    rows = scratch.keep(rows.select("vec_id", F.col("v").cast("array<double>").alias("v")))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE_ROWS, max(256, SAMPLE_VALUES // dim))).select("v").collect()
    sample = np.array([r[0] for r in some])
    index = Index(sample, lists or int(min(4096, max(1, round(total**0.5)))), parts or max(1, -(-dim // 4)))
    n_lists = len(index.centres)
    n_probe = index.probes(sample, k, target)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, codes = index.encode(matrix(b.column(1), dim)) if b.num_rows else (np.zeros(0, np.int64), np.zeros((0, 1), np.uint8))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "list", "code"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = nearest(matrix(b.column(1), dim), index.centres, n_probe) if b.num_rows else np.zeros((0, n_probe), np.int64)
            i = pa.array(np.repeat(np.arange(b.num_rows), n_probe))
            yield pa.RecordBatch.from_arrays([b.column(0).take(i), b.column(1).take(i), pa.array(at.ravel(), pa.int32())], names=["query_id", "q", "list"])

    coded = scratch.keep(rows.mapInArrow(encode, "vec_id long, list int, code binary"))
    asked = scratch.keep(rows.where(queries).mapInArrow(probes, "query_id long, q array<double>, list int"))
    # lists form groups of bounded size, a large list one of its own in several blocks; queries come in blocks too, and
    # every group block meets every query block that probes it once
    sizes = coded.groupBy("list").count().collect()  # a row for each list, 4096 at most
    groups: list[tuple[int, int, int]] = []
    group, room = -1, 0
    for at, n in sorted((r["list"], r["count"]) for r in sizes):
        if n > room:
            group, room = group + 1, LIST_BLOCK
        room -= n
        groups.append((at, group, max(1, -(-n // LIST_BLOCK))))
    lefts, rights = (F.broadcast(spark.createDataFrame(groups, "list int, g int, rb int")) for _ in range(2))
    qb = max(1, -(-rows.where(queries).count() // QUERY_BLOCK))
    blocks = asked.select("list", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int").alias("b")).distinct()  # which query blocks probe a list
    left = coded.join(lefts, "list").withColumn("r", F.pmod(F.xxhash64("vec_id"), F.col("rb")).cast("int")).join(blocks, "list")
    right = asked.join(rights, "list").withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)))

    def compare(codes: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if codes.num_rows and wanted.num_rows:
            ids, lists_ = codes.column("vec_id").to_numpy(), codes.column("list").to_numpy()
            order = np.lexsort((ids, lists_))
            ids, lists_ = ids[order], lists_[order]
            raw = codes.column("code").to_pylist()
            table = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)[order]
            asking, probed, v = wanted.column("query_id").to_numpy(), wanted.column("list").to_numpy(), matrix(wanted.column("q"), dim)
            turn = np.lexsort((probed, asking))
            for own in np.split(turn, np.flatnonzero(np.diff(asking[turn])) + 1):
                q, near, who = int(asking[own[0]]), [], []
                for i in own.tolist():
                    a, z = np.searchsorted(lists_, probed[i]), np.searchsorted(lists_, probed[i], side="right")
                    if a < z:
                        near.append(index.distances(v[i], int(probed[i]), table[a:z]))
                        who.append(ids[a:z])
                if near:
                    d, who_ = np.concatenate(near), np.concatenate(who)
                    d[who_ == q] = np.inf
                    best = np.lexsort((who_, d))[:rerank]
                    best = best[np.isfinite(d[best])]
                    out.append((np.full(len(best), q), who_[best], d[best]))
        q, i, d = (np.concatenate(x) if x else np.zeros(0) for x in (zip(*out) if out else ((), (), ())))
        return pa.table({"query_id": pa.array(q.astype(np.int64)), "vec_id": pa.array(i.astype(np.int64)), "near": pa.array(d.astype(np.float64))})

    key = ["g", "r", "b"]
    found = left.select(*key, "vec_id", "list", "code").groupBy(*key).cogroup(right.select(*key, "query_id", "q", "list").groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, near double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("near", "vec_id"))).where(F.col("n") <= rerank).select("query_id", "vec_id")
    exact = best.join(rows, "vec_id").join(rows.where(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    apart = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    scored = exact.select("query_id", "vec_id", apart.alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
