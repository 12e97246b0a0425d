"""Near copies of whole documents: SimHash fingerprints of 5-word shingles, MinHash bands for what those miss, exact Jaccard.

Two documents at a Jaccard similarity of 0.8 differ in about 10 of 64 bits, and 1 % of such pairs in over 16; no
pigeonring filter prunes at such budgets. So fingerprints find what differs in a few bits, and bands find the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, filter_array, mix, passes, pieces
from .line_dedup import BANDS, CHUNK, MULTIPLY, ROWS, SCRAMBLE, classes, one_of_each
from .simhash import links, majority

#: Words of a shingle. Bands are those of the lines: documents at similarity 0.8 share none with probability 0.4 %.
WORDS = 5


def normalised(text: str | None) -> bytes:
    """What two documents are compared by: A-Z lower-cased, words between ASCII white space, one space between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingles(text: bytes) -> np.ndarray:
    """64-bit hashes of the runs of WORDS words of a normalised text; a shorter text is its own shingle."""
    words = text.split(b" ")
    if len(words) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(text)], np.uint64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = np.zeros(len(word) - WORDS + 1, np.uint64)
    for j in range(WORDS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word[j : j + len(h)])
    return h


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct shingles of each normalised text, sorted; one text at a time, as texts may be long."""
    return (np.unique(shingles(t.encode("utf-8", "surrogatepass"))) for t in texts)


def band_keys(h: np.ndarray) -> np.ndarray:
    """The BANDS keys of a MinHash signature of shingles."""
    low, out = (h >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    step = CHUNK // 32
    for i in range(0, len(low), step):
        out = np.minimum(out, ((low[None, i : i + step] ^ SCRAMBLE[:, None]) * MULTIPLY[:, None]).min(1))
    keys = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + out[r::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64))
    return keys


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, fp, keys) of every document; equal normalised texts have the same node, fingerprint and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole, 1)):
            texts = [normalised(t.as_py()) for t in b.column(1)]
            node = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)
            found = [(majority(h), band_keys(h).view(np.int64)) for h in map(shingles, texts)]
            cols = [b.column(0), pa.array(node), pa.array([x for x, _ in found], pa.int64()), pa.array([k for _, k in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "node", "fp", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, node long, fp long, keys array<long>")


def node_texts(docs: DataFrame, text_col: str, wanted: DataFrame, count: int) -> DataFrame:
    """(line, text): the normalised text of each wanted node; only texts that pass a filter of their keys are shuffled."""
    bits = filter_array(wanted, "line", count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole, 0)):
            found = {xxhash.xxh64_intdigest(t): t for t in map(normalised, b.column(0).to_pylist())}
            keys = np.fromiter(found, np.uint64, len(found))
            ok = passes(bits, keys)
            text = [t.decode("utf-8", "surrogatepass") for t, x in zip(found.values(), ok.tolist()) if x]
            yield pa.RecordBatch.from_arrays([pa.array(keys[ok].view(np.int64)), pa.array(text, pa.string())], names=["line", "text"])

    texts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "line long, text string")
    return texts.groupBy("line").agg(F.min("text").alias("text")).join(wanted, "line", "left_semi")


def near_copies(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", max_diff: int = 4) -> DataFrame:
    """(id_col, component_id) of every document.

    Documents link if the Jaccard similarity of their 5-word shingles is threshold or more, as compared exactly;
    candidates are connected by SimHash fingerprints within max_diff bits (pigeonring filter), or share a MinHash band (a
    pair at 0.8 shares none with 0.4 %, unless others link it). component_id is the smallest id of a component. Texts of
    up to 5 words link only if equal; texts without words (null, empty, white space) are equal. Rows whose id is null
    keep a row; repeated ids keep their rows. Texts of any length are read whole; other columns play no part. An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(signatures(docs, id_col, text_col))
    nodes = scratch.keep(prints.groupBy("node").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    close = components(links(nodes.select("fp").distinct(), max_diff), "a", "b", scratch).select(F.col("node").alias("fp"), "root")
    groups = nodes.select("node", "fp").join(close, "fp", "left").select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"), F.col("node").alias("line"))
    banded = nodes.select(F.explode("keys").alias("key"), F.col("node").alias("line"))
    members = scratch.keep(one_of_each(scratch.keep(groups.unionByName(banded))))
    texts = scratch.keep(node_texts(docs, text_col, members.select("line").distinct(), members.count()))
    roots = classes(members, texts, threshold, shingle_sets, scratch).select(F.col("line").alias("node"), "root")
    placed = scratch.keep(nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    scratch.only(prints, placed)
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return prints.join(named, "node").select(F.col("id").alias(id_col), "component_id")
