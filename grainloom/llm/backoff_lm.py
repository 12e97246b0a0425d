"""Language-model scores from a weighted backoff automaton that is sharded over the cluster.

States are the words seen in training, and the start of a text; an arc leaves a state for every word seen after it. Each
state's failure arc leads to the root, which knows every word. The automaton grows with the corpus, so no task holds
it whole: a block of documents asks each shard for the states and arcs of its own texts, and walks those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, mix, parts, text_blocks
from .langid import held_out

#: No word holds a space.
START, END = xxhash.xxh64_intdigest(b" start"), xxhash.xxh64_intdigest(b" end")
ADD = 0.1
BLOCK_BYTES = 8 << 20
REQUEST = "shard int, block int, word binary, seen binary, fan binary, arc binary, arc_seen binary"
REPLY = "block int, shard int, seen binary, kinds binary, arc_seen binary, n long, v long, once long, twice long"


def _counts_out(x: np.ndarray) -> bytes:
    """Counts as bytes; those of 255 and more follow in full."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes()


def _counts_in(sent: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(sent, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(sent, "<i8", offset=n)
    return out


def _shard(keys: np.ndarray, n) -> np.ndarray:
    return keys % np.asarray(n, np.uint64)


def _hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Block:
    """The distinct words and word pairs of a block of texts, and where they lie in the texts."""

    def __init__(self, docs: pa.Table, shards: int, hot: dict[int, int]):
        seqs, train = [], []
        for text, held in zip(docs.column("text"), docs.column("held_out")):
            words = (text.as_py() or "").encode().lower().split()
            seqs.append(np.concatenate([np.array([START], np.uint64), _hash(words), np.array([END], np.uint64)]))
            train.append(not held.as_py())
        lengths = np.array([len(s) for s in seqs])
        self.starts = np.cumsum(lengths) - lengths
        self.n_tokens = lengths - 1
        word, at = np.unique(np.concatenate(seqs), return_inverse=True)
        first = np.zeros(len(at), bool)
        first[self.starts] = True
        self.now = np.flatnonzero(~first)
        self.cur, self.hist = at[self.now], at[self.now - 1]
        trained = np.repeat(np.array(train), self.n_tokens)
        seen = np.bincount(self.cur[trained], minlength=len(word))
        pair, where, self.pair_at = np.unique(mix(word[self.hist] * np.uint64(0x9E3779B97F4A7C15) + word[self.cur]), return_index=True, return_inverse=True)
        pair_seen = np.bincount(self.pair_at[trained], minlength=len(pair))
        pair_hist = self.hist[where]
        # a word lives in one shard with the arcs that leave it; the arcs of a very frequent one are dealt over some
        # shards from there on, and each of these is asked for its part
        home = _shard(word, shards)
        reach = np.array([min(shards, hot.get(w, 1)) for w in word.tolist()], np.uint64)
        shard = (home[pair_hist] + _shard(pair, reach[pair_hist])) % np.uint64(shards)
        n = np.uint64(len(word))
        index = np.repeat(np.arange(len(word), dtype=np.uint64), reach.astype(np.int64))
        step = np.arange(len(index), dtype=np.uint64) - np.repeat(np.cumsum(reach) - reach, reach.astype(np.int64))
        places = np.sort((home[index.astype(np.int64)] + step) % np.uint64(shards) * n + index)
        of_pair = shard * n + pair_hist.astype(np.uint64)
        self.place_word = (places % n).astype(np.int64)
        place_shard = (places // n).astype(np.int64)
        own = home[self.place_word].astype(np.int64) == place_shard
        self.order = np.argsort(of_pair, kind="stable")
        fan = np.bincount(np.searchsorted(places, of_pair), minlength=len(places))
        self.word, self.n_pairs = word, len(pair)
        self.word_cut = np.searchsorted(place_shard, np.arange(shards + 1))
        self.pair_cut = np.searchsorted(shard[self.order].astype(np.int64), np.arange(shards + 1))
        self.payload = word[self.place_word], np.where(own, seen[self.place_word], 0), fan, pair[self.order], pair_seen[self.order]

    def requests(self, block: int) -> pa.Table:
        word, seen, fan, arc, arc_seen = self.payload
        rows = [(s, a, b, c, d) for s, (a, b, c, d) in enumerate(zip(self.word_cut, self.word_cut[1:], self.pair_cut, self.pair_cut[1:]))]
        return pa.table({
            "shard": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
            "word": binary([word[a:b].tobytes() for _, a, b, _, _ in rows]), "seen": binary([_counts_out(seen[a:b]) for _, a, b, _, _ in rows]), "fan": binary([_counts_out(fan[a:b]) for _, a, b, _, _ in rows]),
            "arc": binary([arc[c:d].tobytes() for _, _, _, c, d in rows]), "arc_seen": binary([_counts_out(arc_seen[c:d]) for _, _, _, c, d in rows]),
        })

    def scores(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        seen, kinds, arc_seen = np.zeros(len(self.word)), np.zeros(len(self.word)), np.zeros(self.n_pairs)
        totals = dict.fromkeys(("n", "v", "once", "twice"), 0)
        for r in replies.to_pylist():
            a, b = self.word_cut[r["shard"]], self.word_cut[r["shard"] + 1]
            c, d = self.pair_cut[r["shard"]], self.pair_cut[r["shard"] + 1]
            seen[self.place_word[a:b]] += _counts_in(r["seen"], b - a)
            kinds[self.place_word[a:b]] += _counts_in(r["kinds"], b - a)
            arc_seen[self.order[c:d]] = _counts_in(r["arc_seen"], d - c)
            for k in totals:
                totals[k] += r[k]
        n, v = totals["n"], totals["v"]
        known = seen[self.cur]
        root = np.log10((known + ADD) / (n + ADD * (v + 1)))
        discount = totals["once"] / max(1, totals["once"] + 2 * totals["twice"]) or 0.5
        left = seen.copy()  # how often a state was left in training
        left[self.word == np.uint64(START)] = seen[self.word == np.uint64(END)]
        # weights of the arcs, and of the failure arc of each state; a state that was never left has only that, for free
        with np.errstate(divide="ignore", invalid="ignore"):
            fail = np.where(left > 0, np.log10(discount * kinds / left), 0.0)
            state, taken = self.hist, arc_seen[self.pair_at]
            arc = np.log10((taken - discount) / left[state] + 10.0 ** (fail[state] + root))
        step = np.where(taken > 0, arc, fail[state] + root)
        cuts = self.starts - np.arange(len(self.starts))
        sums = [np.add.reduceat(x, cuts) for x in (root, step, (known > 0).astype(np.int64))]
        return pa.table({
            "id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(self.n_tokens, pa.int64()), "n_known": pa.array(sums[2], pa.int64()),
            "train_tokens": pa.array([n] * docs.num_rows, pa.int64()), "base_score": pa.array(sums[0]), "score": pa.array(sums[1]),
        })


def answer(table: pa.Table) -> pa.Table:
    """What one shard knows of the words and arcs that the blocks ask for."""
    rows = table.to_pylist()

    def joined(keys: str, *counts: str) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
        own = [np.frombuffer(r[keys], "<u8") for r in rows]
        return np.concatenate(own), np.cumsum([len(x) for x in own]).tolist(), [np.concatenate([_counts_in(r[c], len(x)) for r, x in zip(rows, own)]) for c in counts]

    word, word_ends, (seen, fan) = joined("word", "seen", "fan")
    arc, arc_ends, (arc_seen,) = joined("arc", "arc_seen")
    words, at = np.unique(word, return_inverse=True)
    count = np.bincount(at, seen, len(words)).astype(np.int64)
    arcs, first, arc_at = np.unique(arc, return_index=True, return_inverse=True)
    arc_count = np.bincount(arc_at, arc_seen, len(arcs)).astype(np.int64)
    leaves = np.repeat(at, fan)[first]
    kinds = np.bincount(leaves[arc_count > 0], minlength=len(words)).astype(np.uint32)

    def back(values: np.ndarray, ends: list[int]) -> list[bytes]:
        return [_counts_out(values[a:b]) for a, b in zip([0, *ends], ends)]

    def all_rows(n: int) -> pa.Array:
        return pa.array([int(n)] * len(rows), pa.int64())

    return pa.table({
        "block": table.column("block"), "shard": table.column("shard"), "seen": binary(back(count[at], word_ends)), "kinds": binary(back(kinds[at], word_ends)), "arc_seen": binary(back(arc_count[arc_at], arc_ends)),
        "n": all_rows(count.sum()), "v": all_rows((count > 0).sum()), "once": all_rows((arc_count == 1).sum()), "twice": all_rows((arc_count == 2).sum()),
    })


def hot_words(docs: DataFrame, text_col: str, rows: int, shards: int, sample: int = 4000) -> dict[int, int]:
    """Words with over a quarter of a shard's share of a sample of some thousand rows (4 * shards at most), and over how
    many shards their arcs are dealt, so that each part is about that size.

    They only balance the shards; the results are the same for any choice.
    """
    some = docs.select(F.col(text_col).cast("string").alias("t")).sample(min(1.0, sample / max(1, rows)), 5)
    words = some.select(F.explode(F.split(F.translate(F.lower("t"), "\t\n\r\x0b\x0c", "     "), " ")).alias("w")).where("w != ''")
    counts = words.groupBy("w").count()
    total, texts = counts.agg(F.sum("count")).first()[0] or 1, some.count()
    found = counts.where(F.col("count") > total / (4.0 * shards)).limit(4 * shards).collect()
    parts = {w: -(-4 * shards * c // total) for w, c in zip(_hash([r["w"].encode() for r in found]).tolist(), (r["count"] for r in found))}
    return parts | {START: max(1, -(-4 * shards * texts // total))}


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (10, 0)) -> DataFrame:
    """Log10 probabilities of every whole text under a bigram backoff model and under its unigram base.

    Learns from the rows whose crc32(id as text) mod fold[0] is not fold[1] (a null id's row too); the others are
    held_out. Tokens: the words between ASCII white space, A-Z lower-cased, then one end; a null or empty text is the
    end alone. Root: p(w) = (c + 0.1) / (N + 0.1 * (V + 1)). A state h gives
    p(w|h) = max(c(hw) - d, 0) / c(h) + d * kinds(h) / c(h) * p(w) with d = n1 / (n1 + 2 * n2), the shares of word pairs
    seen once and twice; words unseen as history leave everything to the root. One left-to-right walk carries the
    state. Nothing is pruned; words and pairs are told apart by 64 bits of hash. Texts of any length are scored whole. An empty table gives an empty result; equal rows are scored alike; other columns play no part.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    blocks, _ = text_blocks(docs, id_col, text_col, BLOCK_BYTES, held_out(id_col, *fold).alias("held_out"))
    shards = parts(docs.sparkSession)  # each block sends to each shard, as in any shuffle
    hot = hot_words(docs, text_col, docs.count(), shards)
    kind = docs.schema[id_col].dataType.simpleString()

    def ask(table: pa.Table) -> pa.Table:
        return Block(table, shards, hot).requests(table.column("block")[0].as_py())

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        return Block(left, shards, hot).scores(left, right)

    replies = blocks.groupBy("block").applyInArrow(ask, REQUEST).groupBy("shard").applyInArrow(answer, REPLY)
    result = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(walk, result).withColumnRenamed("id", id_col)
