"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
GAP = 32
CHUNK = 1 << 17


def letters(text: str | None) -> np.ndarray:
    """Lower-case code points, every run of other characters (and either end) one gap; empty if there is no letter."""
    if not text:
        return np.zeros(0, np.uint32)
    low = text.lower()
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.flatnonzero(np.bincount(code)) if code.max(initial=0) < 1 << 16 else np.unique(code)
    other = np.array([c for c in used.tolist() if not chr(c).isalpha()], np.uint32)
    if len(other) == len(used):
        return np.zeros(0, np.uint32)
    table = np.zeros(int(used[-1]) + 1, bool)
    table[other] = True
    gap = table[code]
    out = np.concatenate([[GAP], np.where(gap, GAP, code), [GAP]]).astype(np.uint32)
    gap = out == GAP
    return out[~(gap & np.concatenate([[False], gap[:-1]]))]


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The 1-, 2- and 3-grams of a whole text within padded words, and their counts; a key packs the code points."""
    s = letters(text)
    found = []
    for i in range(0, len(s), CHUNK):  # bounded memory for very long texts
        x = s[i : i + CHUNK + 2].astype(np.uint64)
        own = x[:CHUNK]
        two = (x[:-1] << np.uint64(21)) | x[1:]
        three = ((two[:-1] << np.uint64(21)) | x[2:])[x[1:-1] != GAP]
        last = i + CHUNK + 2 > len(s)
        if not last:  # the next chunk has what starts there
            two = two[:CHUNK]
        found.append(np.unique(np.concatenate([own[own != GAP], two, three]), return_counts=True))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else merged([k for k, _ in found], [c for _, c in found])


def top(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, ties to the smaller key."""
    if len(counts) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:size]


class Profiles:
    """Ranked n-grams of each language; distance() gives a text's out-of-place distance to each."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(ranked), size
        self.vocabulary = np.unique(np.array([g for x in ranked.values() for g in x], np.uint64))
        self.rank = np.full((len(self.langs), len(self.vocabulary)), -1, np.int32)
        for row, lang in zip(self.rank, self.langs):
            row[np.searchsorted(self.vocabulary, np.array(ranked[lang], np.uint64))] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        g = top(*grams(text), self.size)
        if not len(g) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == g
        rank = self.rank[:, at]
        out = np.where(known & (rank >= 0), np.abs(rank - np.arange(len(g), dtype=np.int32)), self.size).sum(axis=1)
        best = int(np.argmin(out))
        return self.langs[best], 1.0 - float(out[best]) / (self.size * len(g))


#: Languages whose profiles a task holds at once.
LANGS = 1000


def learn_profiles(labelled: DataFrame, text_col: str, lang_col: str, size: int = 400) -> list[Profiles]:
    """Counts the n-grams of all labelled texts by language and ranks each language's most frequent ones.

    Null languages are not learned; null and empty texts add nothing, and texts of any length count whole. Repeated rows
    count each time; ids play no part. Ties in a profile go to the smaller n-gram. An empty table gives no profiles. The
    driver receives `size` n-grams of each language; languages come in groups of LANGS, in order of their names.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def out(lang: str) -> pa.RecordBatch:
            k, c = held.pop(lang)[0]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                lang = lang.as_py()
                held.setdefault(lang, []).append(grams(text.as_py()))
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1][0])
                if sizes[lang] > 1 << 18:
                    held[lang] = [merged(*map(list, zip(*held[lang])))]
                    sizes[lang] = len(held[lang][0][0])
                    if sizes[lang] > 1 << 17:
                        yield out(lang)
                        sizes[lang] = 0
        for lang in list(held):
            held[lang] = [merged(*map(list, zip(*held[lang])))]
            yield out(lang)

    counted = labelled.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).where(F.col(lang_col).isNotNull()).mapInArrow(count, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = summed.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    ranked: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "r").toLocalIterator():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    names = sorted(ranked)
    return [Profiles({x: ranked[x] for x in names[i : i + LANGS]}, size) for i in range(0, len(names), LANGS)]


def identify(docs: DataFrame, profiles: list[Profiles], text_col: str = "text") -> DataFrame:
    """docs with lang_pred string and score double (1: the profile itself, 0: nothing in common).

    Every n-gram of the whole text counts. Null texts and texts without a letter get 'und' and 0, and so does every
    text if no language was learned. Ties go to the first language by name. Each row is judged by its text alone, so
    repeated rows and null ids are like any other; an empty table stays empty. Columns of these two names are replaced,
    others pass, whatever their names. Each group of profiles is a pass over the texts of its own.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at, n = names.index(text_col), len(names)

    def better(group: Profiles) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [group.predict(t.as_py()) for t in b.column(at)]
                found = [x if x[1] > y or x[0] != UNKNOWN and z == UNKNOWN else (z, y) for x, z, y in zip(found, b.column(n).to_pylist(), b.column(n + 1).to_pylist())]
                more = [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *more], names=[f"c{i}" for i in range(n + 2)])

        return run

    kinds = ", ".join(f"c{i} {k}" for i, k in enumerate([*(f.dataType.simpleString() for f in docs.schema), "string", "double"]))
    out = docs.toDF(*[f"c{i}" for i in range(n)]).withColumns({f"c{n}": F.lit(UNKNOWN), f"c{n + 1}": F.lit(0.0)})
    for group in profiles:
        out = out.mapInArrow(better(group), kinds)
    return out.toDF(*names, "lang_pred", "score")


def held_out(id_col: str, parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves that rest; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == rest, F.lit(False))
