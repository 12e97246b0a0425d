"""Fuzzy line deduplication: MinHash bands, exact Jaccard similarity, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary, components, filter_array, maybe_in, mix, packed_rows, parts, passes, pieces, runs

#: Characters of a shingle; bands, and rows of a band. Lines at similarity 0.8 share no band with probability 0.4 %.
SHINGLE, BANDS, ROWS = 6, 14, 5
CHUNK = 1 << 17
#: Shingles that are hashed side by side, small enough for a processor's cache.
CELL = 1 << 16
_random = np.random.default_rng(20)
MULTIPLY = _random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SCRAMBLE = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def normalised(line: str) -> str:
    """What two lines are compared by: lower case, white space runs as one space; empty for a blank line."""
    line = line.lower()
    if line.isprintable() and "  " not in line:  # then its only white space is single spaces
        return line.strip(" ")
    return " ".join(line.split())


def line_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def rolled(code: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of SHINGLE code points."""
    h = code[: len(code) - SHINGLE + 1].copy()
    for j in range(1, SHINGLE):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += code[j : j + len(h)]
    return mix(h)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes; a shorter text is its own shingle."""
    out: list[np.ndarray] = []
    padded = [t.ljust(SHINGLE, "\0") for t in texts]
    at = 0
    while at < len(padded):
        end, size = at, 0
        while end < len(padded) and (end == at or size + len(padded[end]) <= CHUNK):
            size += len(padded[end])
            end += 1
        h = rolled(code_points("".join(padded[at:end])))
        start = 0
        for t in padded[at:end]:
            own = np.sort(h[start : start + len(t) - SHINGLE + 1])
            start += len(t)
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        at = end
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    c = np.concatenate([a, b])
    c.sort()
    return int(np.count_nonzero(c[1:] == c[:-1]))


def least_hashes(texts: list[str]) -> np.ndarray:
    """(texts, BANDS * ROWS) MinHashes of the shingles of each text; none may be shorter than a shingle."""
    out = np.empty((BANDS * ROWS, len(texts)), np.uint32)
    sizes = np.array([len(t) for t in texts])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at : at + CELL]), CELL, side="right")) + at)
        ends = np.cumsum(sizes[at:end])
        h = (rolled(code_points("".join(texts[at:end]))) >> np.uint64(32)).astype(np.uint32)
        # of the shingles that run into the next text, none counts
        keep = np.ones(len(h), bool)
        keep[(ends[:-1, None] - np.arange(1, SHINGLE)).ravel()] = False
        h = h[keep]
        starts = ends - sizes[at:end] - np.arange(end - at) * (SHINGLE - 1)
        room = np.empty_like(h)
        for k in range(BANDS * ROWS):
            np.bitwise_xor(h, SCRAMBLE[k], out=room)
            np.multiply(room, MULTIPLY[k], out=room)
            np.minimum.reduceat(room, starts, out=out[k, at:end])
        at = end
    return out.T


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys; the MinHash signature of a line's character shingles, hashed by band."""
    if not lines:
        return np.zeros((0, BANDS), np.uint64)
    parts_, first = [], []
    for line in lines:
        first.append(len(parts_))
        line = line.ljust(SHINGLE, "\0")
        parts_ += [line[a : a + CHUNK + SHINGLE - 1] for a in range(0, len(line) - SHINGLE + 1, CHUNK)]  # a long line in overlapping pieces
    least = least_hashes(parts_)
    least = np.minimum.reduceat(least, first, axis=0) if len(parts_) > len(lines) else least
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + least[:, r::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64))
    return keys


#: Lines that a task remembers as seen; a line that comes again later is only a repeated row.
SEEN = 100_000


def distinct_lines(texts: pa.Array, seen: set[int]) -> dict[str, int]:
    """Lines that are not blank, once each, with their keys."""
    found: dict[str, int] = {}
    if len(seen) > SEEN:
        seen.clear()
    for t in texts:
        for line in (t.as_py() or "").split("\n"):
            line = normalised(line)
            if line and line not in found:
                key = line_key(line)
                if key not in seen:
                    found[line] = key
    seen.update(found.values())
    return found


#: Band keys that a task gathers before it sends them, and lines from which on it calls a band among them hot.
SENT, HOT = 1 << 20, 64


def shared_bands(docs: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """(key, n, a, line): the lines of every band that several distinct lines share, once for each set of lines; n is
    their number and a the smallest.

    A task sends its band keys as packed arrays to shards of the key range, one a shuffle partition. Of a hot band it
    sends one line there, and all its lines as known members to any shard; so what a shard reads of one band is
    bounded by the number of tasks, however many lines share it.
    """
    n = parts(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            key, line = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(key)
            key, line = key[order], line[order]
            first = runs(key)
            size = np.diff(np.append(first, len(key)))
            hot = np.repeat(size >= HOT, size)
            known = np.stack([key[hot], line[hot]], 1)
            stay = ~hot
            stay[first] = True
            rows = packed_rows(key[stay], n, line[stay], hot[stay])
            share = np.linspace(0, len(known), len(rows) + 1).astype(np.int64)
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *map(binary, cols[1:]), binary([known[a:b].tobytes() for a, b in zip(share, share[1:])])], names=["shard", "keys", "lines", "hot", "known"])

        for b in (p for whole in batches for p in pieces(whole, 0)):
            found = distinct_lines(b.column(0), seen)
            if found:
                held.append((band_keys(list(found)).ravel(), np.repeat(np.fromiter(found.values(), np.uint64, len(found)), BANDS)))
            if sum(len(k) for k, _ in held) >= SENT:
                yield packed()
        if held:
            yield packed()

    def bands(key: np.ndarray, line: np.ndarray, hot: bool) -> pa.RecordBatch:
        """Runs of equal keys, lines ascending within them."""
        first = runs(key)
        size = np.diff(np.append(first, len(key)))
        x = np.bitwise_xor.reduceat(mix(line.view(np.uint64)), first) if len(first) else key
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(line))
        cols = [pa.array(key[first].view(np.int64)), pa.array(size, pa.int64()), pa.array(line[first]), pa.array(x.view(np.int64)), lists, pa.array(np.full(len(first), hot))]
        return pa.RecordBatch.from_arrays(cols, names=["key", "n", "a", "x", "lines", "hot"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lines, hots = [], [], []
        for b in batches:
            keys += [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            lines += [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            hots += [np.frombuffer(x, bool) for x in b.column(3).to_pylist()]
            known = np.frombuffer(b"".join(b.column(4).to_pylist()), np.int64).reshape(-1, 2)
            yield bands(known[:, 0].copy(), known[:, 1].copy(), True)
        if keys:
            key, line, hot = (np.concatenate(x) for x in (keys, lines, hots))
            order = np.argsort(key)
            key, line, hot = key[order], line[order], hot[order]
            first = runs(key)
            size = np.diff(np.append(first, len(key)))
            own = np.repeat(size > 1, size)
            hot = np.repeat(np.logical_or.reduceat(hot, first), size)
            yield bands(key[hot], line[hot], True)
            key, line = key[own & ~hot], line[own & ~hot]
            order = np.lexsort((line, key))
            key, line = key[order], line[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])])[: len(key)]
            key, line = key[new], line[new]
            size = np.diff(np.append(runs(key), len(key)))
            several = np.repeat(size > 1, size)
            yield bands(key[several], line[several], False)

    sent = docs.select(F.col(text_col).cast("string")).mapInArrow(send, "shard int, keys binary, lines binary, hot binary, known binary")
    found = scratch.keep(sent.repartitionById(n, "shard").mapInArrow(meet, "key long, n long, a long, x long, lines array<long>, hot boolean"))
    # most bands have two lines; these need no lists, so that equal ones meet in a hash table instead of a sort
    two = found.where("NOT hot AND n = 2").groupBy("n", "a", F.col("lines")[1].alias("z")).agg(F.min("key").alias("key"))
    two = two.select("key", "n", "a", F.explode(F.array("a", "z")).alias("line"))
    usual = found.where("NOT hot AND n > 2").dropDuplicates(["n", "a", "x"]).select("key", "n", "a", F.explode("lines").alias("line"))
    hot = one_of_each(found.where("hot").select("key", F.explode("lines").alias("line")).distinct())
    return two.unionByName(usual).unionByName(hot)


def one_of_each(members: DataFrame) -> DataFrame:
    """(key, n, a, line) of the bands of (key, line), without bands of one line; of bands with the same lines, one."""
    size = [F.count(F.lit(1)).alias("n"), F.min("line").alias("a"), F.max("line").alias("z"), F.bit_xor(F.xxhash64("line")).alias("x")]
    bands = members.groupBy("key").agg(*size).where("a < z").groupBy("n", "a", "z", "x").agg(F.min("key").alias("key"))
    return members.join(bands.select("key", "n", "a"), "key").select("key", "n", "a", "line")


def places(docs: DataFrame, id_col: str, text_col: str, bits: np.ndarray) -> DataFrame:
    """(line, id, line_no, text) of every line that is not blank; text, normalised, once a task of lines that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in (p for whole in batches for p in pieces(whole, 1)):
            line, doc, no, text = [], [], [], []
            for d, t in enumerate(b.column(1)):
                for i, x in enumerate((t.as_py() or "").split("\n")):
                    x = normalised(x)
                    if x:
                        line.append(line_key(x))
                        doc.append(d)
                        no.append(i)
                        text.append(x)
            keys = np.array(line, np.uint64)
            for i in np.flatnonzero(~passes(bits, keys)).tolist():
                text[i] = None
            if len(seen) > SEEN:
                seen.clear()
            for i in np.flatnonzero(passes(bits, keys)).tolist():
                if line[i] in seen:
                    text[i] = None
                else:
                    seen.add(line[i])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(0).take(pa.array(doc, pa.int64())), pa.array(no, pa.int32()), pa.array(text, pa.string())], names=["line", "id", "line_no", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"line long, id {kind}, line_no int, text string")


#: Lines of a band that are compared as one block; of a larger band, every pair of blocks is compared.
BLOCK = 512
#: Bits of the shingle bitmaps that bound a pair's similarity from above.
BITMAP = 2048


def linked(sets: list[np.ndarray], roots: list[int], blocks: list[int] | None, threshold: float) -> list[tuple[int, int]]:
    """Pairs of positions that join lines of different roots at the threshold or more; enough to connect all that can be.

    With blocks, only pairs of different blocks count. A pair whose ends are connected already is not looked at.
    """
    parent = {r: r for r in roots}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    def joins(i: int, j: int) -> bool:
        if find(roots[i]) == find(roots[j]):
            return False
        both = shared(sets[i], sets[j])
        if both < threshold * (len(sets[i]) + len(sets[j]) - both):
            return False
        parent[find(roots[i])] = find(roots[j])
        return True

    n = len(sets)
    if n == 2:
        return [(0, 1)] if (blocks is None or blocks[0] != blocks[1]) and joins(0, 1) else []
    size = np.array([len(x) for x in sets])
    bits = np.zeros((n, BITMAP), np.uint8)
    for row, x in zip(bits, sets):
        row[(x % np.uint64(BITMAP)).astype(np.int64)] = 1
    words = np.packbits(bits, axis=1).view(np.uint64)
    spare = size - np.bitwise_count(words).sum(1)  # shingles that share a bit with another one
    out = []
    label = np.array(blocks) if blocks is not None else None
    for i in range(1, n):
        most = np.bitwise_count(words[:i] & words[i]).sum(1) + np.minimum(spare[:i], spare[i])
        most = np.minimum(most, np.minimum(size[:i], size[i]))
        able = most >= threshold * (size[:i] + size[i] - most)
        if label is not None:
            able &= label[:i] != label[i]
        at = np.flatnonzero(able)
        for j in at[np.argsort(-most[at], kind="stable")].tolist():
            if joins(i, j):
                out.append((i, j))
    return out


Sets = Callable[[list[str]], Iterable[np.ndarray]]


def alike(pairs: DataFrame, texts: DataFrame, threshold: float, sets: Sets) -> DataFrame:
    """The (a, b) of pairs of lines whose texts have the threshold's similarity or more."""
    left, right = texts.select(F.col("line").alias("a"), F.col("text").alias("s")), texts.select(F.col("line").alias("b"), F.col("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (q for whole in batches for p in pieces(whole, 2) for q in pieces(p, 3)):
            # a line comes with all its partners in turn
            turn = b.column(0).to_numpy()
            first = runs(turn)
            ones = list(sets(b.column(2).take(pa.array(first)).to_pylist()))
            at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(turn))))
            ok = []
            for i, other in zip(at.tolist(), sets(b.column(3).to_pylist())):
                both = shared(ones[i], other)
                ok.append(both >= threshold * (len(ones[i]) + len(other) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def linked_bands(members: DataFrame, texts: DataFrame, threshold: float, sets: Sets) -> DataFrame:
    """(a, b): links between the roots of lines that share a band and are alike; enough to connect all such lines.

    members: (key, n, line, root). A band's lines come together in blocks of bounded size.
    """
    bands = members.groupBy("key").agg(F.first("n").alias("n"), F.min("root").alias("r"), F.max("root").alias("s")).where("r < s")
    placed = members.join(bands.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = placed.withColumn("other", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "line", "root", "block")
    rows = cells.join(texts, "line").repartition(parts(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def links(rows: list[tuple]) -> list[tuple[int, int]]:
            if len({r[3] for r in rows}) < 2:
                return []
            found = linked([r[5] for r in rows], [r[3] for r in rows], [r[4] for r in rows] if cell[1] != cell[2] else None, threshold)
            return [(rows[i][3], rows[j][3]) for i, j in found]

        def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in (p for whole in batches for p in pieces(whole, 5)):
            found = []
            for row in zip(*(c.to_pylist() for c in b.columns[:5]), sets(b.column(5).to_pylist())):
                if row[:3] != cell:
                    found += links(held)
                    cell, held = row[:3], []
                held.append(row)
            yield batch(found)
        yield batch(links(held))

    return rows.select("key", "i", "j", "root", "block", "text").mapInArrow(run, "a long, b long")


def classes(members: DataFrame, texts: DataFrame, threshold: float, sets: Sets, scratch: Scratch) -> DataFrame:
    """(line, root) of every line that is connected to another one by links between lines that share a band and are alike.

    members: (key, n, a, line), see shared_bands. First each band's lines are held against its smallest one, a pair for
    each line whatever the size of the band; this settles bands of two and connects most of what is alike. Then the
    larger bands whose lines still lie in several components are compared whole, but for pairs that are connected.
    """
    pairs = members.where("line > a").select("a", F.col("line").alias("b")).distinct()
    roots = components(scratch.keep(alike(pairs, texts, threshold, sets)), "a", "b", scratch)
    roots = scratch.keep(roots.select(F.col("node").alias("line"), "root"))
    rooted = scratch.keep(members.where("n > 2").join(roots, "line", "left").select("key", "n", "line", F.coalesce("root", "line").alias("root")))
    more = components(scratch.keep(linked_bands(rooted, texts, threshold, sets)), "a", "b", scratch)  # between roots
    more = scratch.keep(more.select(F.col("node").alias("root"), F.col("root").alias("last")))
    joined = roots.join(more, "root", "left").select("line", F.coalesce("last", "root").alias("root"))
    return joined.union(more.join(roots.select(F.col("line").alias("root")), "root", "left_anti").select(F.col("root").alias("line"), F.col("last").alias("root")))


def removals(docs: DataFrame, threshold: float, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(id, gone): the numbers of the lines that go, of each document that loses any."""
    members = scratch.keep(shared_bands(docs, text_col, scratch))
    lines = members.select("line").distinct()
    found = scratch.keep(places(docs, id_col, text_col, filter_array(lines, "line", members.count())))
    texts = scratch.keep(found.where("text IS NOT NULL").join(lines, "line", "left_semi").groupBy("line").agg(F.min("text").alias("text")))
    roots = scratch.keep(classes(members, texts, threshold, shingle_sets, scratch))
    placed = found.where("id IS NOT NULL").select("line", "id", "line_no").join(roots, "line", "left").select(F.coalesce("root", "line").alias("root"), "id", "line_no")
    placed = scratch.keep(placed)
    first = scratch.keep(placed.groupBy("root").agg(F.min(F.struct("id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    late = placed.join(first, "root")  # of two tables, so that a large class is split over tasks
    late = late.where(F.struct("id", "line_no") != F.col("first"))
    cut = scratch.keep(late.groupBy("id").agg(F.collect_set("line_no").alias("gone")))
    scratch.only(cut)
    return cut


def dedup_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without lines that occur elsewhere, with n_lines and n_removed (long).

    Lines end at line feeds and are compared in lower case with white space runs as one space. Two lines are alike if
    the Jaccard similarity of their 6-character shingles is threshold or more (a shorter line is its own shingle);
    classes of alike lines are connected components, found through MinHash bands (14 of 5 hashes: a pair at 0.8 is
    missed with 0.4 % unless others link it). Of each class the occurrence with the smallest (id, line number) stays.
    Blank lines stay. Null and empty texts stay as they are; they have 0 and 1 lines. Rows with a null id stay as
    they are and own no line; rows with equal ids count as one document, whose equal lines at an equal place stay
    together. Texts and lines of any length are read whole. An empty table gives an empty result. Columns named n_lines and
    n_removed are replaced; other columns pass, whatever their names.
    """
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    key, body = names.index(id_col), names.index(text_col)
    scratch = Scratch(docs.sparkSession)
    cut = removals(docs, threshold, id_col, text_col, scratch)
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    maybe, others = maybe_in(rows, F.col(f"c{key}"), cut, "id", scratch)
    joined = maybe.join(cut, F.col(f"c{key}") == F.col("id"), "left").drop("id")
    text, gone = F.col(f"c{body}"), F.array_sort(F.coalesce("gone", F.array().cast("array<int>")))
    lines = F.split(text, "\n", -1)
    # a flag for each line, from the gaps between the numbers that go; array_join skips nulls
    flags = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(lines))), lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a - 1), F.array(F.lit(False))))
    kept = F.zip_with(lines, F.flatten(flags), lambda line, stays: F.when(stays, line))
    short = F.when(F.size(gone) == 0, text).otherwise(F.array_join(kept, "\n"))
    count = F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    out = joined.select(*[short.alias(f"c{i}") if i == body else F.col(f"c{i}") for i in range(len(names))], count.alias("n_lines"), F.size(gone).cast("long").alias("n_removed"))
    # a text that keeps all its lines is not split, its line feeds are counted
    size = F.octet_length(text.cast("string"))
    whole = F.when(text.isNull(), F.lit(0)).otherwise(size - F.octet_length(F.replace(text.cast("string"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = out.unionByName(others.select(*rows.columns, whole.alias("n_lines"), F.lit(0).cast("long").alias("n_removed")))
    return out.toDF(*names, "n_lines", "n_removed")
