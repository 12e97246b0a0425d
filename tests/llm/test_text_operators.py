import collections
import functools
import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from grainloom.llm import backoff_lm, langid, mixing, simhash
from grainloom.llm.backoff_lm import lm_scores
from grainloom.llm.debruijn import CODE, digest, from_planes, hashed, planes, refuted, remove_repeats, rolled, span_table
from grainloom.llm.langid import held_out, identify, learn_profiles
from grainloom.llm.line_dedup import dedup_lines, normalised
from grainloom.llm.mixing import mix_sources
from grainloom.llm.packing import best_bounds, pack
from grainloom.llm.simhash import chain_within, fingerprint, near_duplicates, ring_keys

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts, ids=None, langs=None, sources=None):
    n = len(texts)
    rows = [(i if ids is None else ids[i], t, langs[i] if langs else None, sources[i] if sources else "s", None) for i, t in zip(range(n), texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, words=WORDS):
    rng = np.random.default_rng(seed)
    return " ".join(words[i] for i in rng.integers(0, len(words), n))


def union_find(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    for a, b in pairs:
        p[find(a)] = find(b)
    return [find(i) for i in range(n)]


def groups(n, pairs):
    found = collections.defaultdict(set)
    for i, r in enumerate(union_find(n, pairs)):
        found[r].add(i)
    return sorted(map(sorted, found.values()))


ODD = [None, "", "   \n\t", "a", "É 漢字", "x" * 300_000, "a b c d e f g h i j k l m n o p"]


# ---- SimHash


def test_fingerprint_by_definition():
    text = "The quick\tBROWN fox É jumps  over"
    words = [w for w in "the quick brown fox É jumps over".encode().split()]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint(text) % 2**64 == want
    assert fingerprint(None) == fingerprint(" \n") == 0
    assert fingerprint("a B") % 2**64 == xxhash.xxh64_intdigest(b"a b", 42)


def test_ring_filter_finds_every_pair_within_the_budget(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    pairs = []
    for b in base.tolist():
        for k in range(0, 8):
            x = b
            for bit in rng.choice(64, k, replace=False).tolist():
                x ^= 1 << bit
            pairs.append((b - 2**64 if b >> 63 else b, x - 2**64 if x >> 63 else x, k))
    df = spark.createDataFrame(pairs, "a long, b long, k int")
    keyed = df.withColumn("ka", ring_keys(F.col("a"), 4)).withColumn("kb", ring_keys(F.col("b"), 4))
    shared = keyed.withColumn("s", F.array_intersect("ka", "kb")).select("k", "a", "b", "s").collect()
    for r in shared:
        x = np.array([(r["a"] ^ r["b"]) % 2**64], np.uint64)
        assert r["k"] > 4 or any(chain_within(x, key % 10 // 2, 4)[0] for key in r["s"])


def test_links_of_large_keys(spark, monkeypatch):
    """Clusters larger than a block connect as brute force says, with few links."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(2)
    prints = set()
    for b in rng.integers(0, 2**63, 6, dtype=np.uint64).tolist():
        for _ in range(80):
            prints.add(b ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 4), replace=False)))
    prints = sorted(p - 2**64 if p >> 63 else p for p in prints)
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 4).collect()}
    pairs = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if ((prints[i] ^ prints[j]) % 2**64).bit_count() <= 4]
    at = {p: i for i, p in enumerate(prints)}
    assert groups(len(prints), pairs) == groups(len(prints), [(at[a], at[b]) for a, b in got])
    assert all(((a ^ b) % 2**64).bit_count() <= 4 for a, b in got)
    assert fingerprint("a b a", 1) % 2**64 == fingerprint("a a b", 1) % 2**64 != 0


def test_simhash_against_brute_force(spark):
    texts = []
    for s in range(25):
        t = prose(s, 120).split()
        texts.append(" ".join(t))
        for j in range(3):
            u = list(t)
            u[(s + 7 * j) % 120] = "changed"
            texts.append(" ".join(u))
    texts += ODD + [texts[0]]
    ids = [3 * i + 5 for i in range(len(texts))][::-1]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(docs(spark, texts, ids)).collect()}
    prints = [fingerprint(t) % 2**64 for t in texts]
    roots = union_find(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 4])
    least = {r: min(i for i, x in zip(ids, roots) if x == r) for r in roots}
    assert got == {i: (f"{p:016x}", least[r]) for i, p, r in zip(ids, prints, roots)}


def test_simhash_odd_tables(spark):
    empty = near_duplicates(docs(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]
    rows = near_duplicates(docs(spark, ["a b", "a b", "a b", None], [None, 7, 7, None])).collect()
    # a null id takes its component's smallest id, if any
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in rows) == {(None, 7): 1, (7, 7): 2, (None, None): 1}


# ---- line dedup


def shingles(line, k=6):
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def brute_lines(texts, ids, threshold=0.8):
    occ = [(i, k, normalised(x)) for i, t in zip(ids, texts) if i is not None for k, x in enumerate((t or "").split("\n")) if normalised(x)]
    lines = sorted({x for *_, x in occ})
    sets = [shingles(x) for x in lines]
    roots = union_find(len(lines), [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])])
    root = dict(zip(lines, roots))
    first = {}
    for i, k, x in sorted(occ):
        first.setdefault(root[x], (i, k))
    gone = {(i, k) for i, k, x in occ if first[root[x]] != (i, k)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in zip(ids, texts)}


def test_lines_against_brute_force(spark):
    base = [prose(s, 30) for s in range(12)]
    near = [b.replace(b.split()[3], "zz", 1) for b in base]
    texts = ["\n".join([base[i], near[(i * 5) % 12], prose(100 + i, 20), "", base[(i + 1) % 12].upper()]) for i in range(12)] + ODD + ["a\na", "\n\n"]
    ids = list(range(len(texts)))[::-1]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs(spark, texts, ids)).collect()}
    assert got == brute_lines(texts, ids)


def test_lines_columns_nulls_and_counts(spark):
    df = docs(spark, ["x y\nx y\nz", None, "", "x y"], [1, 2, 3, None]).withColumn("n_lines", F.lit("old"))
    got = {r["doc_id"]: r for r in dedup_lines(df).collect()}
    assert (got[1]["text"], got[1]["n_lines"], got[1]["n_removed"]) == ("x y\nz", 3, 1)
    assert (got[2]["text"], got[2]["n_lines"]) == (None, 0) and (got[3]["text"], got[3]["n_lines"]) == ("", 1)
    assert got[None]["text"] == "x y" and got[None]["n_removed"] == 0
    assert dedup_lines(docs(spark, [])).count() == 0


def test_lines_pass_columns_of_any_name(spark):
    names = ["id", "gone", "_hit", "filter_bit", "maybe_bit", "c0", "text"]
    df = docs(spark, ["x y\nx y", "q"]).withColumnsRenamed({"doc_id": "id"}).select("id", *[F.lit(n).alias(n) for n in names[1:-1]], "text")
    got = {r["id"]: r for r in dedup_lines(df, id_col="id").collect()}
    assert got[0]["text"] == "x y" and got[1]["text"] == "q" and all(got[0][n] == n for n in names[1:-1])


def test_long_lines_and_many_equal_lines(spark):
    long = prose(1, 40_000)
    texts = [long, long.replace(long.split()[5], "zz", 1), "\n".join(["same"] * 3000), prose(2, 30)]
    ids = [3, 2, 1, 0]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs(spark, texts, ids)).collect()}
    assert got == brute_lines(texts, ids)


def test_large_group_of_alike_lines(spark):
    base = prose(5, 60).split()
    texts = []
    for i in range(700):
        u = list(base)
        u[i % 60] = f"e{i}"
        texts.append(" ".join(u))
    assert dedup_lines(docs(spark, texts)).agg(F.sum("n_removed")).first()[0] == 699


# ---- substring dedup


def brute_windows(rows, width=13):
    words = {k: (i, (t or "").encode().split()) for k, (i, t) in enumerate(rows)}
    least = {}
    for i, w in words.values():
        for a in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[a : a + width])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words.values():
        gone = set()
        for a in range(len(w) - width + 1):
            if i is not None and least[tuple(w[a : a + width])] < i:
                gone |= set(range(a, a + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_windows_against_brute_force(spark):
    passages = [prose(900 + i, n) for i, n in enumerate((13, 14, 30, 80, 12))]
    texts = []
    for i in range(40):
        parts = [prose(i, 25), passages[i % 5], prose(200 + i, 9), passages[(i * 3) % 5] if i % 2 else "", prose(300 + i, 5)]
        texts.append("\t ".join(parts))
    texts += ["a " * 60, "a " * 40, texts[3], texts[3]] + ODD
    rows = list(zip([None if i == 5 else 100 - i for i in range(len(texts))], texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["sha"]) for r in remove_repeats(df).withColumn("sha", F.sha2("kept", 256)).collect()], key=repr)
    assert got == brute_windows(rows)


def test_windows_spans_and_empty(spark):
    passage = prose(1, 50)
    df = docs(spark, [passage, "x y " + passage + " z"])
    got = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    assert [(s["first"], s["words"], s["owner"]) for s in got[1]["spans"]] == [(2, 50, 0)] and got[1]["kept"] == "x y z"
    assert remove_repeats(docs(spark, [])).count() == 0


def test_spans_must_stand_in_a_text_of_their_owner():
    words = [f"w{i}".encode() for i in range(40)]
    code = int(rolled(hashed(words), 13, CODE).view(np.int64)[5])
    held = pa.table({"id": pa.array([7, 7, 8, None], pa.int64()), "text": ["other words", b" ".join(words).decode(), b" ".join(words).decode(), None], "block": pa.array([0] * 4, pa.int32())})
    there = (3, 0, 7, code, 20, digest(words[5:25]), b"")
    other_words, beyond_end, other_owner, other_edge = [(4, 0, o, c, n, d, b"") for o, c, n, d in ((7, code, 20, digest(words[6:26])), (7, code, 36, digest([*words[5:], b"x"])), (9, code, 20, there[5]), (7, code + 1, 20, there[5]))]
    wrong = [other_words, beyond_end, other_owner, other_edge]
    assert refuted(held, span_table([wrong[0], there, *wrong[1:], there]), 13).to_pylist() == span_table(wrong).to_pylist()
    assert refuted(held, span_table([]), 13).num_rows == 0
    for x in (np.array([-5, 1 << 40, 3]), np.array([], np.int64)):
        assert from_planes(planes(x), "<i8").tolist() == x.tolist()


def test_refuted_spans_lose_their_repeated_windows(spark):
    """All next words have one hash, so that spans run over branches, where their owner goes on otherwise."""
    w, x = prose(40, 30).split(), prose(41, 20)
    cut = lambda a, b: " ".join(w[a:b])
    texts = [f"{cut(0, 13)} {x} {cut(1, 16)} q {cut(3, 30)}", f"s {cut(0, 16)} t", f"{cut(0, 30)} {x} u", f"v {cut(0, 14)}"]
    rows = [(10 + i, t) for i, t in enumerate(texts)]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), next_bits=0).withColumn("sha", F.sha2("kept", 256)).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["sha"]) for r in found], key=repr) == brute_windows(rows)
    assert any(s["words"] == 13 for r in found for s in r["spans"])


def test_windows_of_many_copies_and_equal_ids(spark):
    """Copies over many blocks, two texts of one id that share a passage, and an owner that repeats the passage."""
    passage, other = prose(2, 30), prose(3, 25)
    texts = [passage + " a " + other + " b " + passage, other + " " + passage] + [f"t{i} {passage} u{i} {other}" for i in range(40)] + [passage + " " + passage, passage + " " + passage]
    rows = list(zip([5, 5, *range(6, 46), 50, 50], texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["sha"]) for r in remove_repeats(df).withColumn("sha", F.sha2("kept", 256)).collect()], key=repr)
    assert got == brute_windows(rows)


# ---- language model


def test_language_model_against_brute_force(spark):
    texts = [prose(i % 30, 40 + i) for i in range(60)] + ODD
    got = {r["doc_id"]: r for r in lm_scores(docs(spark, texts)).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), "END"] for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    uni, pair, kinds, left = collections.Counter(), collections.Counter(), collections.defaultdict(set), collections.Counter()
    for i in train:
        uni.update(tokens[i])
        for h, w in zip(["START", *tokens[i]], tokens[i]):
            pair[h, w] += 1
            kinds[h].add(w)
            left[h] += 1
    n, v = sum(uni.values()), len(uni)
    one, two = (sum(c == k for c in pair.values()) for k in (1, 2))
    d = one / (one + 2 * two)
    for i, ws in tokens.items():
        base = score = 0.0
        for h, w in zip(["START", *ws], ws):
            p = (uni[w] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            score += math.log10(max(pair[h, w] - d, 0) / left[h] + d * len(kinds[h]) / left[h] * p if left[h] else p)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(ws), sum(uni[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_language_model_sums_to_one_and_odd_tables(spark):
    known, words = ["a b", "a c", "a b", "b a", "a a b"], ["a", "b", "c", "u"]
    probes = ["", *words, *(f"{w} {v}" for w in words for v in words)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10][: len(known)] + [i for i in range(900) if zlib.crc32(str(i).encode()) % 10 == 0][: len(probes)]
    rows = {r["doc_id"]: r for r in lm_scores(docs(spark, known + probes, ids)).collect()}
    s, root = ({t: rows[i][c] for t, i in zip(probes, ids[len(known) :])} for c in ("score", "base_score"))
    # u was never seen, so what follows it has the root's probability; that gives the end of each word's state
    end = {v: s[f"u {v}"] - s["u"] + root[""] - (root[v] - root[""]) for v in words}
    for w in words:
        after = [10 ** (s[f"{w} {v}"] - (s[w] - end[w]) - end[v]) for v in words]
        assert sum(after) + 10 ** end[w] == pytest.approx(1)
    rows = lm_scores(docs(spark, [], [])).collect()
    assert rows == []
    assert lm_scores(docs(spark, ["a", None], [None, None])).count() == 2


def test_language_model_with_frequent_words(spark, monkeypatch):
    """The result does not depend on how the arcs of a word are dealt over shards, nor do counts above a byte matter."""
    texts = ["w1 w2 " * 200 + prose(i, 30) for i in range(25)]
    scores = lambda: {r["doc_id"]: (r["n_known"], r["train_tokens"], pytest.approx(r["score"])) for r in lm_scores(docs(spark, texts)).collect()}
    monkeypatch.setattr(backoff_lm, "hot_words", lambda *_: {})
    cold = scores()
    hot = {xxhash.xxh64_intdigest(w): 3 for w in (b"w1", b"w2", b" start", b"w7")}
    monkeypatch.setattr(backoff_lm, "hot_words", lambda *_: hot)
    assert scores() == cold


# ---- language ID


def test_languages(spark):
    vocab = {"xx": ["thath", "ingth", "ander", "tion"], "yy": ["ñoqué", "losca", "porla", "ción"]}
    texts, langs = [], []
    for i in range(80):
        lang = "xx" if i % 2 else "yy"
        texts.append(prose(i, 12, vocab[lang]) + " 123!")
        langs.append(lang if i % 7 else None)
    texts += [None, "", "1234 ...", "漢字", "X" * 200_000, "tion"]
    langs += ["xx", "xx", "yy", None, None, None]
    df = docs(spark, texts, langs=langs).withColumn("score", F.lit("clash"))
    held = held_out("doc_id", 4, 2)
    got = {r["doc_id"]: r for r in identify(df, learn_profiles(df.where(~held), "text", "lang")).withColumn("held", held).collect()}
    assert all(got[i]["lang_pred"] == ("xx" if i % 2 else "yy") for i in range(80))
    assert [got[i]["lang_pred"] for i in (80, 81, 82)] == ["und"] * 3 and got[85]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[4]["held"] == (zlib.crc32(b"4") % 4 == 2)
    none = identify(df, learn_profiles(df.limit(0), "text", "lang"))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def brute_grams(text):
    """Counts of 1- to 3-grams by definition: lower case, every run of what is no letter (and each end) one gap."""
    low = (text or "").lower()
    if not any(c.isalpha() for c in low):
        return collections.Counter()
    padded = "".join(c if c.isalpha() else " " for c in low)
    padded = f" {' '.join(padded.split())} "
    found = collections.Counter(c for c in padded if c != " ")
    found.update(padded[i : i + 2] for i in range(len(padded) - 1))
    found.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return found


def brute_ranks(counts, size):
    order = lambda g: functools.reduce(lambda a, c: a << 21 | ord(c), g, 0)
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], order(g)))[:size])}


def test_languages_against_brute_force(spark, monkeypatch):
    vocab = {f"l{k}": [f"{chr(97 + (k * 3 + a) % 26)}{chr(97 + (k + b) % 26)}é{chr(97 + a)}" for a in range(4) for b in range(3)] for k in range(5)}
    texts, langs = [], []
    for i in range(60):
        lang = f"l{i % 5}"
        texts.append(prose(i, 15, vocab[lang]).replace(" ", [" ", " - ", "\n7"][i % 3]))
        langs.append(lang)
    texts += ODD[:6] + [texts[0], "zzz qqq"]
    langs += [None] * (len(texts) - len(langs))
    df = docs(spark, texts, langs=langs)
    size = 40
    profiles = {x: brute_ranks(sum((brute_grams(t) for t, y in zip(texts, langs) if y == x), collections.Counter()), size) for x in vocab}
    want = {}
    for i, t in enumerate(texts):
        own = brute_ranks(brute_grams(t), size)
        far = {x: sum(abs(p[g] - r) if g in p else size for g, r in own.items()) for x, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want[i] = (best, 1 - far[best] / (size * len(own))) if own else ("und", 0.0)
    for group in (1000, 2):  # all languages at once, and in several groups
        monkeypatch.setattr(langid, "LANGS", group)
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(df, learn_profiles(df, "text", "lang", size)).collect()}
        assert got == {i: (x, pytest.approx(y)) for i, (x, y) in want.items()}


# ---- mixing


def test_mixture(spark):
    n = 3000
    df = docs(spark, ["t"] * n, sources=["hot" if i % 3 else f"s{i % 5}" for i in range(n)])
    out = mix_sources(df)
    share = {r["source"]: r["count"] / n for r in out.groupBy("source").count().collect()}
    assert len(share) == 6 and all(abs(v - 1 / 6) < 0.03 for v in share.values())
    copies = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("mix_copy").alias("m"))
    assert copies.where("n <> m").count() == 0
    again = mix_sources(df.repartition(3))
    assert out.exceptAll(again).count() == 0
    only = mix_sources(df, {"s0": 3.0, "hot": 1.0, "absent": 0.0}, total=400)
    got = {r["source"]: r["count"] for r in only.groupBy("source").count().collect()}
    assert set(got) == {"s0", "hot"} and abs(got["s0"] - 300) < 80 and abs(got["hot"] - 100) < 50


def test_mixture_inverts_poisson(spark):
    df = docs(spark, ["t"] * 4000)
    counts = collections.Counter(r["n"] for r in mix_sources(df, total=9200).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect())
    counts[0] = 4000 - sum(counts.values())
    lam = 2.3
    for k in range(6):
        p = math.exp(-lam) * lam**k / math.factorial(k)
        assert abs(counts[k] / 4000 - p) < 4 * math.sqrt(p * (1 - p) / 4000)
    many = mix_sources(docs(spark, ["t", "u"]), total=4000).groupBy("doc_id").count().collect()
    assert all(abs(r["count"] - 2000) < 250 for r in many)


def test_mixture_odd_rows(spark):
    df = docs(spark, [None, "", "a", "a"], [None, 1, 2, 2], sources=[None, "a", "b", "b"]).withColumn("mix_key", F.lit("clash"))
    out = mix_sources(df, total=40)
    assert out.columns[-2:] == ["mix_copy", "mix_key"] and {r["source"] for r in out.collect()} == {None, "a", "b"}
    assert mix_sources(docs(spark, [])).count() == 0
    named = docs(spark, ["a"] * 50).withColumns({c: F.lit(c) for c in ("mix_id", "mix_n", "c0", "rounds", "mix_source")})
    assert {r["mix_id"] + r["mix_n"] + r["mix_source"] for r in mix_sources(named).collect()} == {"mix_idmix_nmix_source"}
    with pytest.raises(ValueError):
        mix_sources(df, {"a": -1.0})


def test_mixture_of_many_sources(spark, monkeypatch):
    """Beyond the broadcast limit, sources are joined by salted key with the same result."""
    df = docs(spark, ["t"] * 400, sources=[f"s{i % 40}" if i % 3 else None for i in range(400)])
    few = mix_sources(df)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    assert few.exceptAll(mix_sources(df)).count() == 0 and mix_sources(df).count() == few.count()


# ---- packing


def padding(lengths, counts, bounds):
    return sum(c * min(b for b in bounds if b >= x) for x, c in zip(lengths, counts))


def test_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for trial in range(40):
        n = int(rng.integers(1, 9))
        lengths = sorted(rng.choice(50, n, replace=False).tolist())
        counts = rng.integers(1, 9, n).tolist()
        for k in (1, 2, 3, 4):
            got = best_bounds(lengths, counts, k)
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(0, min(k, n)) for c in itertools.combinations(lengths[:-1], m))
            assert got[-1] == lengths[-1] and len(got) <= k and padding(lengths, counts, got) == best
    assert best_bounds([], [], 3) == []
    assert best_bounds([2049, 2050, 2051, 2052], [1] * 4, 16) == [2049, 2050, 2051, 2052]
    for trial in range(3):  # long lengths, against a table over all cuts
        lengths, counts = sorted(rng.choice(10**6, 90, replace=False).tolist()), rng.integers(1, 50, 90).tolist()
        least = {(0, -1): 0}
        for k in range(1, 8):
            for j in range(90):
                least[k, j] = min(least[m, i] + sum(counts[i + 1 : j + 1]) * lengths[j] for m in (0, k - 1) for i in range(-1, j) if (m, i) in least)
        assert padding(lengths, counts, best_bounds(lengths, counts, 7)) == least[7, 89]


def test_batches(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 400, 500)] + ODD
    rows = pack(docs(spark, texts, [None] + list(range(1, len(texts)))), n_buckets=5, token_budget=1000, carry=("text",)).collect()
    assert len(rows) == len(texts) and sorted(r["text"] or "" for r in rows) == sorted(t or "" for t in texts)
    groups = collections.defaultdict(list)
    for r in rows:
        assert r["n_tokens"] == len((r["text"] or "").encode().split()) <= r["padded_to"]
        groups[r["bucket"], r["batch"]].append(r)
    buckets = collections.defaultdict(list)
    for (b, k), g in groups.items():
        assert sorted(r["slot"] for r in g) == list(range(len(g))) and (len(g) == 1 or len(g) * g[0]["padded_to"] <= 1000)
        buckets[b].append(k)
    assert all(sorted(ks) == list(range(len(ks))) for ks in buckets.values()) and len(buckets) == 5
    lengths = sorted({r["n_tokens"] for r in rows})
    counts = [sum(r["n_tokens"] == x for r in rows) for x in lengths]
    assert sum(r["padded_to"] for r in rows) == padding(lengths, counts, best_bounds(lengths, counts, 5))
    assert pack(docs(spark, [])).count() == 0
