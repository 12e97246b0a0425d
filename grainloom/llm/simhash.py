"""SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, parts

BITS = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of a text's word shingles (A-Z lower-cased, words between ASCII white space, XXH64 seed 42)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed number."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 15):  # bounded memory for very long texts
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per document, null texts included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _mask(lo: int, hi: int) -> int:
    m = ((1 << hi) - 1) ^ ((1 << lo) - 1)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def ring(max_diff: int) -> list[tuple[int, int]]:
    """max_diff + 1 consecutive segments (lo, hi) of the 64 bits."""
    m = max_diff + 1
    cuts = [round(BITS * i / m) for i in range(m + 1)]
    return list(zip(cuts, cuts[1:]))


def ring_keys(fp: Column, max_diff: int) -> Column:
    """Array of keys; two fingerprints within max_diff bits share at least one.

    Of max_diff + 1 segments on a ring, some start has a chain whose first segment does not differ and whose first two
    differ in at most one bit together; so the first is equal, and one half of the second is. A key is
    (start, half, bits of the first segment and of that half).
    """
    segs, keys = ring(max_diff), []
    for i, (lo, hi) in enumerate(segs):
        if len(segs) == 1:
            return F.array(fp)
        a, b = segs[(i + 1) % len(segs)]
        mid = (a + b) // 2
        for half, (c, d) in enumerate(((a, mid), (mid, b))):
            first = F.shiftrightunsigned(fp.bitwiseAND(F.lit(_mask(lo, hi))), lo)
            second = F.shiftrightunsigned(fp.bitwiseAND(F.lit(_mask(c, d))), c)
            keys.append((first * (1 << (d - c)) + second) * (2 * len(segs)) + (2 * i + half))  # 50 bits at most
    return F.array(*keys)


def chain_within(x: np.ndarray, start: int, max_diff: int) -> np.ndarray:
    """Whether the chains that start at that segment stay within their proportional budgets: l segments differ in at most
    l * max_diff / (max_diff + 1) bits, for every l. x: the differing bits, unsigned."""
    segs = ring(max_diff)
    m, ok, mask = len(segs), np.ones(len(x), bool), 0
    for n in range(1, m):
        lo, hi = segs[(start + n - 1) % m]
        mask |= (1 << hi) - (1 << lo)
        ok &= np.bitwise_count(x & np.uint64(mask)) <= n * max_diff // m
    return ok


#: Fingerprints with one key that are compared as one block; of a larger key, every pair of blocks is compared.
BLOCK = 4096


def forest(fp: np.ndarray, key: int, max_diff: int, block: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that connect all of a key's fingerprints (unsigned) that can be connected by pairs within max_diff bits whose
    chain stays within its budgets; one less than there are fingerprints at most. With block, pairs of one block don't count.
    """
    start = (key % (2 * (max_diff + 1)) // 2) if max_diff else 0
    free, out = np.ones(len(fp), bool), []
    for i in range(len(fp)):
        if not free[i]:
            continue
        todo, free[i] = [i], False
        while todo:  # all that this fingerprint reaches
            at = todo.pop()
            rest = np.flatnonzero(free if block is None else free & (block != block[at]))
            x = fp[rest] ^ fp[at]
            near = np.bitwise_count(x) <= max_diff
            rest, x = rest[near], x[near]
            rest = rest[chain_within(x, start, max_diff)] if max_diff else rest
            free[rest] = False
            todo += rest.tolist()
            out += [(at, j) for j in rest.tolist()]
    return out


def links(distinct: DataFrame, max_diff: int) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within max_diff bits, enough to connect all that can be.

    The fingerprints of a key meet in blocks of bounded size, and in every pair of blocks if there are several; each
    gives fewer links than it has fingerprints.
    """
    keyed = distinct.select("fp", F.explode(ring_keys(F.col("fp"), max_diff)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("n"))
    placed = keyed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    cells = placed.withColumn("other", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "block")
    rows = cells.repartition(parts(distinct.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def linked(b: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
            """Links of whole cells."""
            key, i, j, fp, block = (np.asarray(c) for c in b.columns)
            u, pairs = fp.view(np.uint64), []
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(key) else key
            for a, z in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
                if z - a == 2 and (i[a] == j[a] or block[a] != block[a + 1]):
                    if int(u[a] ^ u[a + 1]).bit_count() <= max_diff:
                        pairs.append((a, a + 1))
                elif z - a > 2:
                    pairs += [(a + p, a + q) for p, q in forest(u[a:z], int(key[a]), max_diff, block[a:z] if i[a] != j[a] else None)]
            return pa.RecordBatch.from_arrays([pa.array(fp[[p[k] for p in pairs]] if pairs else np.zeros(0, np.int64)) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            held.append(b)
            whole = pa.Table.from_batches(held).combine_chunks()
            cell = [whole.column(k)[-1].as_py() for k in range(3)] if whole.num_rows else None
            if cell is None:
                continue
            # the last cell may go on in the next batch
            own = np.ones(whole.num_rows, bool)
            for k in range(3):
                own &= whole.column(k).to_numpy() == cell[k]
            cut = int(np.flatnonzero(own)[0])
            yield linked(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
        if held:
            yield linked(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_diff: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id) of every document.

    Documents with equal fingerprints are one node; nodes link at max_diff or fewer differing bits; component_id is the
    smallest id of a component. Texts without words (null, empty, white space) have fingerprint zero and link like any
    other. Rows whose id is null keep a row and get their component's smallest id; repeated ids keep their rows.
    Other columns of docs are not looked at, so their names don't matter. Texts of any length are read whole. An empty
    table gives an empty result.
    """
    if not 0 <= max_diff < 32:
        raise ValueError("max_diff must lie between 0 and 31")
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(fingerprints(docs, id_col, text_col, shingle))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(nodes.select("fp"), max_diff), "a", "b", scratch)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.keep(rooted)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
