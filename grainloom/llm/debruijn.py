"""Removal of long repeated word sequences with a De Bruijn graph of word k-mers.

The edges are the k-word windows that occur in more than one document. Sampled seeds first tell which windows can be
such edges, so only those travel; a join by edge then gives each its owner (the smallest document) and whether all its
occurrences go on alike. Edges with one owner and no branch between them compact into spans. A span travels to the
block of its owner, where its words must stand at a place where its first edge starts; only then is it removed. If they
do not, each of its windows asks for itself.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, mix, text_blocks

BLOCK_BYTES = 10 << 20
#: Words of a seed: of a window's seeds, the one with the least hash speaks for the window.
SEED_WORDS = 5
#: Bits of the hash of the word after a window, by which branches are told.
NEXT_BITS = 31
MANY = np.iinfo(np.int64).min
BRANCH = np.uint32(0xFFFFFFFF)
CODE, CHECK = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
REQUEST = "shard int, block int, keys binary, checks binary, docs binary, nexts binary"
REPLY = "block int, shard int, owners binary, homes binary, plain binary"
#: A kind of span (words that follow an edge of an owner) and its places in the texts of a block.
SPANS = "block int, home int, owner long, code long, words long, digest binary, places binary"
SPAN_TYPES = {"block": pa.int32(), "home": pa.int32(), "owner": pa.int64(), "code": pa.int64(), "words": pa.int64(), "digest": pa.binary(), "places": pa.binary()}


def rolled(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of so many values; as many as there are runs."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(base) + h[j : j + n]
    return mix(out)


def grouped(keys: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal (key, check) together, and where each group begins in it."""
    order = np.argsort(keys, kind="stable") if checks is None else np.lexsort((checks, keys))
    k = keys[order]
    new = k[1:] != k[:-1]
    if checks is not None:
        c = checks[order]
        new |= c[1:] != c[:-1]
    return order, np.flatnonzero(np.concatenate([[True], new])) if len(k) else np.zeros(0, np.int64)


def one_value(values: np.ndarray, order: np.ndarray, first: np.ndarray, mark) -> np.ndarray:
    """The value of each group, or mark if it has several."""
    v = values[order]
    low, high = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
    return np.where(low == high, low, mark)


def split(text: pa.StringScalar) -> list[bytes]:
    return (text.as_py() or "").encode().split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def text_keys(docs: pa.Table) -> list[int]:
    """Tells apart the texts of a block that have one id (the others have key 0); the order of rows may differ from pass to pass."""
    ids = docs.column("id").to_pylist()
    count = Counter(ids)
    return [xxhash.xxh3_64_intdigest((t.as_py() or "").encode()) >> 1 if count[i] > 1 else 0 for i, t in zip(ids, docs.column("text"))]


def planes(x: np.ndarray) -> bytes:
    """Numbers as bytes, the same byte of all numbers together, so that the high bytes of small numbers compress away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(sent: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(sent, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


class Block:
    """Windows of a block of documents: seed and document of each, in order of the texts."""

    def __init__(self, docs: pa.Table, width: int, shards: int, next_bits: int = NEXT_BITS):
        self.width, self.shards, self.next_bits = width, shards, next_bits
        self.block = docs.column("block")[0].as_py()
        self.words = [split(t) for t in docs.column("text")]
        hashes = [hashed(w) for w in self.words]
        ids = docs.column("id").to_pylist()
        lengths = np.array([len(h) for h in hashes])
        self.starts = np.cumsum(lengths) - lengths
        self.h = np.concatenate(hashes) if len(hashes) else np.zeros(0, np.uint64)
        n = max(0, len(self.h) - width + 1)
        seeds = rolled(self.h, min(SEED_WORDS, width), 0x9E3779B97F4A7C15)
        seed = seeds[:n].copy()
        for j in range(1, width - min(SEED_WORDS, width) + 1):
            np.minimum(seed, seeds[j : j + n], out=seed)
        doc = np.repeat(np.arange(len(ids)), lengths)
        inside = (doc[:n] == doc[width - 1 :]) if n else np.zeros(0, bool)
        has_id = np.array([i is not None for i in ids])
        self.at = np.flatnonzero(inside & has_id[doc[:n]]) if n else np.zeros(0, np.int64)
        self.doc = doc
        self.ids = np.array([MANY if i is None else i for i in ids], np.int64)
        self.seed = seed[self.at]

    def _rows(self, keys, checks, docs, nexts) -> pa.Table:
        shard = ((keys >> np.uint64(20)) % np.uint64(self.shards)).astype(np.int64)
        self.sent = np.argsort(shard, kind="stable")
        self.cut = np.searchsorted(shard[self.sent], np.arange(self.shards + 1))
        used = np.flatnonzero(np.diff(self.cut))
        cols = [x[self.sent] if x is not None else None for x in (keys, checks, docs, nexts)]
        part = [[(planes(c[self.cut[s] : self.cut[s + 1]]) if c is not None else b"") for s in used] for c in cols]
        return pa.table({"shard": pa.array(used, pa.int32()), "block": pa.array([self.block] * len(used), pa.int32())} | {k: binary(x) for k, x in zip(("keys", "checks", "docs", "nexts"), part)})

    def seeds(self) -> pa.Table:
        order, first = grouped(self.seed)
        self.keys = self.seed[order[first]]
        docs = one_value(self.ids[self.doc[self.at]], order, first, MANY) if len(first) else np.zeros(0, np.int64)
        return self._rows(self.keys, None, docs, None)

    def received(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owners, homes, plain = np.zeros(len(self.sent), np.int64), np.zeros(len(self.sent), np.int32), np.zeros(len(self.sent), bool)
        for r in replies.to_pylist():
            i = self.sent[self.cut[r["shard"]] : self.cut[r["shard"] + 1]]
            plain[i] = np.unpackbits(np.frombuffer(r["plain"], np.uint8), count=len(i)).astype(bool)
            if r["owners"]:
                owners[i] = from_planes(r["owners"], "<i8")
                homes[i] = from_planes(r["homes"], "<i4")
        return owners, homes, plain

    def edges(self, replies: pa.Table) -> pa.Table:
        """Windows whose seed is in several documents."""
        self.seeds()
        *_, repeated = self.received(replies)
        self.at = self.at[repeated[np.searchsorted(self.keys, self.seed)]] if len(self.at) else self.at
        code, check = (rolled(self.h, self.width, b)[self.at] for b in (CODE, CHECK))
        self.code = code
        follow = np.append(self.h, [np.uint64(0)])[np.minimum(self.at + self.width, len(self.h))]
        same = np.append(self.doc, [-1])[np.minimum(self.at + self.width, len(self.h))] == self.doc[self.at] if len(self.at) else np.zeros(0, bool)
        follow = np.where(same, (follow >> np.uint64(33)).astype(np.uint32) & np.uint32((1 << self.next_bits) - 1), np.uint32(0))
        order, first = grouped(code, check)
        if not len(first):
            self.edge = np.zeros(0, np.int64)
            return self._rows(code, check, np.zeros(0, np.int64), follow)
        self.edge = np.empty(len(order), np.int64)
        self.edge[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        owners = np.minimum.reduceat(self.ids[self.doc[self.at]][order], first)
        return self._rows(code[order[first]], check[order[first]], owners, one_value(follow, order, first, BRANCH))

    def spans(self, replies: pa.Table) -> tuple[np.ndarray, ...]:
        """(document in the block, first word, words, owner, its block, first edge) of the compacted paths of owned edges."""
        owners, homes, plain = self.received(replies)
        owner = owners[self.edge]
        hit = owner < self.ids[self.doc[self.at]]
        at, owner, code, edge = self.at[hit], owner[hit], self.code[hit], self.edge[hit]
        doc, home, go_on = self.doc[at], homes[edge], plain[edge]
        joined = (at[1:] == at[:-1] + 1) & (doc[1:] == doc[:-1]) & (owner[1:] == owner[:-1]) & (home[1:] == home[:-1]) & go_on[:-1]
        first = np.flatnonzero(np.concatenate([[True], ~joined])) if len(at) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        return doc[first], at[first] - self.starts[doc[first]], at[last] - at[first] + self.width, owner[first], home[first], code[first].view(np.int64)

    def proposed(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        """The kinds of spans of the block, each with its places: id and key of the text, and first word."""
        kinds: dict[tuple, list[int]] = {}
        keys = text_keys(docs)
        for d, at, words, owner, home, code in zip(*(x.tolist() for x in self.spans(replies))):
            kinds.setdefault((home, owner, code, words, digest(self.words[d][at : at + words])), []).extend((int(self.ids[d]), keys[d], at))
        rows = [(self.block, *kind, np.array(places, "<i8").tobytes()) for kind, places in kinds.items()]
        return span_table(rows)


def span_table(rows: list[tuple]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(SPAN_TYPES.items())})


def without_places(asked: pa.Table) -> pa.Table:
    return asked.set_column(asked.schema.get_field_index("places"), "places", binary([b""] * asked.num_rows))


def refuted(docs: pa.Table, asked: pa.Table, width: int) -> pa.Table:
    """The kinds of spans whose words stand in no text of their owner, at a place where their first edge starts."""
    want: dict[int, dict[tuple, list[int]]] = {}
    for i, r in enumerate(asked.select(["owner", "code", "words", "digest"]).to_pylist()):
        want.setdefault(r["owner"], {}).setdefault((r["code"], r["words"], r["digest"]), []).append(i)
    for d in np.flatnonzero(pc.fill_null(pc.is_in(docs.column("id"), pa.array(list(want), pa.int64())), False).to_numpy()).tolist():
        words, kinds = split(docs.column("text")[d]), want[docs.column("id")[d].as_py()]
        codes = rolled(hashed(words), width, CODE).view(np.int64)
        order = np.argsort(codes, kind="stable")
        places = codes[order]
        for code, m, told in list(kinds):
            a, b = np.searchsorted(places, code, "left"), np.searchsorted(places, code, "right")
            if any(digest(words[p : p + m]) == told for p in order[a:b].tolist()):
                del kinds[code, m, told]
    left = sorted(i for kinds in want.values() for rows in kinds.values() for i in rows)
    return asked.take(pa.array(left, pa.int64())).select(list(SPAN_TYPES))


def single_windows(docs: pa.Table, wrong: pa.Table, width: int) -> pa.Table:
    """The windows of the refuted spans of a block as spans of their own, wherever they stand in its texts; a span of one
    window has been asked already."""
    want: dict[int, list[tuple]] = {}
    for r in wrong.select(["home", "owner", "code", "words", "digest"]).to_pylist():
        if r["words"] > width:
            want.setdefault(r["code"], []).append((r["home"], r["owner"], r["words"], r["digest"]))
    kinds: dict[tuple, set[tuple]] = {}
    for i, key, text in zip(docs.column("id").to_pylist(), text_keys(docs), docs.column("text")) if want else ():
        words = split(text) if i is not None else []
        codes = rolled(hashed(words), width, CODE).view(np.int64)
        for p in np.flatnonzero(np.isin(codes, list(want))).tolist():
            for home, owner, m, told in want[int(codes[p])]:
                if owner < i and digest(words[p : p + m]) == told:
                    for q in range(p, p + m - width + 1):
                        kinds.setdefault((home, owner, int(codes[q]), width, digest(words[q : q + width])), set()).add((i, key, q))
    block = docs.column("block")[0].as_py() if docs.num_rows else None
    return span_table([(block, *k, np.array(sorted(places), "<i8").tobytes()) for k, places in kinds.items()])


def seed_answer(table: pa.Table) -> pa.Table:
    """Which seeds are in several documents."""
    rows = table.to_pylist()
    keys = [from_planes(r["keys"], "<u8") for r in rows]
    ends = np.cumsum([len(k) for k in keys])
    key = np.concatenate(keys)
    order, first = grouped(key)
    docs = np.concatenate([from_planes(r["docs"], "<i8") for r in rows])
    many = np.empty(len(key), bool)
    many[order] = np.repeat(one_value(docs, order, first, MANY) == MANY, np.diff(np.append(first, len(key))))
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "owners": binary([b""] * len(rows)), "homes": binary([b""] * len(rows)), "plain": binary([np.packbits(x).tobytes() for x in np.split(many, ends[:-1])])})


def edge_answer(table: pa.Table) -> pa.Table:
    """The owner of each edge, the block it lies in, and whether the edge has one next word everywhere."""
    rows = table.to_pylist()
    key, check, docs, nexts = (np.concatenate([from_planes(r[c], k) for r in rows]) for c, k in (("keys", "<u8"), ("checks", "<u8"), ("docs", "<i8"), ("nexts", "<u4")))
    ends = np.cumsum([len(r["keys"]) // 8 for r in rows])
    order, first = grouped(key, check)
    size = np.diff(np.append(first, len(key)))
    owners, homes, plain = np.empty(len(key), np.int64), np.empty(len(key), np.int32), np.empty(len(key), bool)
    owners[order] = np.repeat(np.minimum.reduceat(docs[order], first), size)
    asking = np.repeat(table.column("block").to_numpy(), np.diff(ends, prepend=0)).astype(np.int32)
    at_home = np.where(docs == owners, asking, np.iinfo(np.int32).max)
    homes[order] = np.repeat(np.minimum.reduceat(at_home[order], first), size)
    plain[order] = np.repeat(one_value(nexts, order, first, BRANCH) != BRANCH, size)
    return pa.table({"block": table.column("block"), "shard": table.column("shard"), "owners": binary([planes(x) for x in np.split(owners, ends[:-1])]), "homes": binary([planes(x) for x in np.split(homes, ends[:-1])]), "plain": binary([np.packbits(x).tobytes() for x in np.split(plain, ends[:-1])])})


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", next_bits: int = NEXT_BITS) -> DataFrame:
    """Every document without the words that a repeated window covers.

    A window is width consecutive words (runs of anything but ASCII white space, unchanged) of one document. It is
    repeated if the same words also start in a document with a smaller id, judged on the input. Windows are found
    by 128 bits of hash; the words of the spans they form are then compared, by a BLAKE2 digest of 128 bits, with those
    of the owner; of a span that is not there each window is compared by itself, and those that are not there either stay.
    next_bits: of the hash of the next word, by which a span ends where its owner goes on otherwise; fewer only mean more
    spans that are not there. Ids are whole numbers. Null texts have no words; documents with fewer than width words stay whole; so do rows
    with a null id, which own nothing either. Rows with equal ids do not remove each other's words. An empty table
    gives an empty result; other columns play no part.

    Returns id_col, n_words long, n_removed long, spans array of (first long, words long, owner long) (overlapping where
    the path branches or the owner changes), and kept string (the kept words joined by one space).
    """
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    blocks, n = text_blocks(docs, id_col, text_col, BLOCK_BYTES)

    def ask_seeds(table: pa.Table) -> pa.Table:
        return Block(table, width, n).seeds()

    def ask_edges(left: pa.Table, right: pa.Table) -> pa.Table:
        return Block(left, width, n, next_bits).edges(right)

    def propose(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left, width, n, next_bits)
        is_seed = pc.equal(right.column("stage"), 1)
        b.edges(right.filter(is_seed))
        return b.proposed(left, right.filter(pc.invert(is_seed)))

    def refute(left: pa.Table, right: pa.Table) -> pa.Table:
        return refuted(left, right, width)

    def again(left: pa.Table, right: pa.Table) -> pa.Table:
        return single_windows(left, right, width)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = ["home", "owner", "code", "words", "digest"]
        wrong = {tuple(r.values()) for r in right.filter(pc.equal(pc.binary_length(right.column("places")), 0)).select(kind).to_pylist()}
        own: dict[tuple, set] = {}
        for r in right.select([*kind, "places"]).to_pylist():
            places = r.pop("places")
            if tuple(r.values()) not in wrong:
                for d, key, at in np.frombuffer(places, "<i8").reshape(-1, 3).tolist():
                    own.setdefault((d, key), set()).add((at, r["words"], r["owner"]))
        removed, kept, spans = [], [], []
        n_words = []
        for i, key, text in zip(left.column("id").to_pylist(), text_keys(left), left.column("text")):
            w = split(text)
            found = sorted(own.get((i, key), ()))
            spans.append([{"first": a, "words": m, "owner": o} for a, m, o in found])
            n_words.append(len(w))
            if found:
                gone = np.zeros(len(w) + 1, np.int64)
                for a, m, _ in found:
                    gone[a] += 1
                    gone[a + m] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                w = [x for x, s in zip(w, stay.tolist()) if s]
            removed.append(n_words[-1] - len(w))
            kept.append(b" ".join(w).decode())
        span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("owner", pa.int64())]))
        return pa.table({"id": left.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.string())})

    seeds = blocks.groupBy("block").applyInArrow(ask_seeds, REQUEST).groupBy("shard").applyInArrow(seed_answer, REPLY)
    edges = blocks.groupBy("block").cogroup(seeds.groupBy("block")).applyInArrow(ask_edges, REQUEST).groupBy("shard").applyInArrow(edge_answer, REPLY)
    replies = seeds.withColumn("stage", F.lit(1)).unionByName(edges.withColumn("stage", F.lit(2)))
    # the same exchange of all columns serves both the blocks' own spans and the questions to the owners' blocks
    asked = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(propose, SPANS).repartition(n, "block")
    questions = asked.groupBy("block").applyInArrow(without_places, SPANS)
    wrong = blocks.groupBy("block").cogroup(questions.groupBy("home")).applyInArrow(refute, SPANS)
    windows = blocks.groupBy("block").cogroup(wrong.groupBy("block")).applyInArrow(again, SPANS).repartition(n, "block")
    absent = blocks.groupBy("block").cogroup(windows.groupBy("block").applyInArrow(without_places, SPANS).groupBy("home")).applyInArrow(refute, SPANS)
    out = blocks.groupBy("block").cogroup(asked.unionByName(wrong).unionByName(windows).unionByName(absent).groupBy("block")).applyInArrow(cut, "id long, n_words long, n_removed long, spans array<struct<first: long, words: long, owner: long>>, kept string")
    return out.withColumnRenamed("id", id_col)
