"""Fill-in-the-middle, Merkle manifest and URL filter against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainloom.llm import queries, url_filter
from grainloom.llm.fim import ADDED, BLOCK, Fenwick, fill_in_middle, restored
from grainloom.llm.merkle import ascii_lower, merkle_manifest
from grainloom.llm.queries import URL_RULES, op11_fim, op12_merkle, op13_url_filter
from grainloom.llm.url_filter import best_rule, best_threshold, filter_urls, url_parts

ODD = [None, "", "\n", "a", "\n\n\nx", "É 漢字\n😀 b\n\n", "x" * 300_000, "ab\n" * 50_000 + "end", "has <P> in it\nsecond", "<", "a<P\n<S\nM>b", "\r\nq\r\n"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill in the middle


def plain_fim(doc_id, text, seed=7, fim=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(lines), sha(f"{seed}:{'null' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("fim,spm", [(100, 50), (60, 20), (0, 50)])
def test_fim_equals_the_plain_version(spark, fim, spm):
    rng = np.random.default_rng(3)
    texts = ODD + ["".join(rng.choice(["word ", "é", "\n", "漢", "<", "😀"], int(k))) for k in rng.integers(0, 5000, 60)]
    rows = [(None if i == 5 else i // 2 * 2, t) for i, t in enumerate(texts)]
    out = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), fim_percent=fim, spm_percent=spm)
    found = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    expected = sorted(((i, t or "", *plain_fim(i, t, fim=fim, spm=spm)) for i, t in rows), key=repr)
    assert sorted((tuple(r)[:-1] for r in found), key=repr) == expected
    assert all(r["back"] == r["text"] for r in found)
    if fim == 100:
        assert {"psm", "spm", "plain"} == {r["form"] for r in found}


def test_fenwick_cuts_every_line_of_texts_over_many_blocks():
    rng = np.random.default_rng(1)
    for block in (1, 3, 8, BLOCK):
        for text in ("", "a", "a\n", "\n\n", "".join(rng.choice(["é", "\n", "x", "漢"], 150))):
            lines, data = re.findall(r"[^\n]*\n|[^\n]+", text), text.encode()
            tree = Fenwick(np.frombuffer(data, np.uint8), block)
            assert tree.n == len(lines)
            for k in range(len(lines) + 1):
                upto = "".join(lines[:k])
                assert tree.cut(k) == (len(upto.encode()), len(upto))


def test_fim_of_clashing_columns_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb\n", "mine", "x", 5)], "doc_id long, text string, form string, `a.b` string, c0 int")
    out = fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "a.b", "c0", *ADDED] and out.first()["c0"] == 5
    assert fill_in_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(df, text_col="output")
    spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op11_fim(spark, str(tmp_path)).collect():
        n, form, p, m, text = plain_fim(r["doc_id"], ODD[r["doc_id"]])
        assert tuple(r)[1:] == (n, form, p, m, sha(text), sha(ODD[r["doc_id"]] or ""))


# Merkle manifest


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root, and for each node its siblings level by level, with its place among them."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for way, (i, k) in zip(ways, enumerate(at)):
            way.append((runs[k // 8], k % 8))
            at[i] = k // 8
        nodes = ["".join(r) for r in runs]
        nodes = [sha(x) for x in nodes]
    return nodes[0], ways


def plain_manifest(rows, lower):
    """(doc_id, leaf, subroot, root, proof hash, folded root, verified) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (_, _, leaf, r), way in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            node = plain_leaf([*r[:4], lower(r[4])]) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf
            proof = ""
            for run, at in [*way, *top]:
                proof += "".join(run[:at] + run[at + 1 :])
                node = sha("".join(run[:at] + [node] + run[at + 1 :]))
            out.append((r[0], leaf, trees[g][0], root, sha(proof), node, node == root))
    return sorted(out, key=repr)


def ascii_lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_equals_the_plain_version(spark, tmp_path, monkeypatch, levels):
    """Groups of 1, 8, 9, 64, 65 and 700 rows; superblocks of 8, 64 and 4,096 leaves."""
    monkeypatch.setattr(queries, "merkle_manifest", lambda *a, **b: merkle_manifest(*a, **b, levels=levels))
    rng = np.random.default_rng(levels)
    langs = [None] * 9 + ["en"] * 700 + ["a"] + ["ö"] * 8 + ["z"] * 64 + [""] * 65 + ["Z"]
    rows = [(int(i), rng.choice(["s", None, "Ü"]), g, int(i) * 3 if i % 4 else None, [None, "", "Upper ÀÉ", "lower", "İX 漢 Q" * int(rng.integers(1, 9))][int(rng.integers(0, 5))]) for i, g in zip(rng.permutation(len(langs)), langs)]
    rows += [(5, "s", "en", 1, "B"), (5, "s", "en", 1, "A"), (7, "s", "en", 1, "B"), (7, "s", "en", 1, "B"), (None, None, "en", None, "Ab")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = op12_merkle(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted((tuple(r) for r in out.collect()), key=repr)
    assert found == plain_manifest(rows, ascii_lowered)
    assert {r[-1] for r in found} == {True, False}


def test_manifest_of_one_row_none_and_many_groups(spark):
    kind = "doc_id string, source string, lang string, n_chars long, text string, root string, pos long, `a.b` int"
    one = merkle_manifest(spark.createDataFrame([("x", None, None, None, None, "mine", 1, 2)], kind)).collect()
    leaf = sha("1:x----")
    assert [tuple(r) for r in one] == [("x", leaf, leaf, leaf, "", leaf, True, None, 0)]
    assert merkle_manifest(spark.createDataFrame([], kind)).count() == 0
    many = spark.createDataFrame([(str(i), "s", f"g{i:03}", i, "t", "", 0, 0) for i in range(100)], kind)
    assert {r["root"] for r in merkle_manifest(many).collect()} == {plain_tree([plain_leaf((str(i), "s", f"g{i:03}", i, "t")) for i in range(100)])[0]}


def test_ascii_lower(spark):
    texts = ["ABC xyz", "ÀÉÎ İK ABC", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(ascii_lower(F.col("t"))).collect()
    assert [r[0] for r in got] == ["abc xyz", "ÀÉÎ İk abc", "", None]


# URL filter


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return ascii_lowered(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(url):
    host, path = plain_parts(url)
    fit = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


def plain_filter(urls, order=url_filter.ORDER):
    """(url, host, path, rule, verdict, score) of each URL, from dictionaries of counts."""
    read = lambda u: re.sub("[0-9]", "0", ascii_lowered(u.split("://", 1)[1] if "://" in u else u))
    held = lambda u: int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % 5 == 0
    cut = lambda text: [text[i : i + order + 1] for i in range(len(text) - order)]
    grams = lambda u: cut("\x02" * order + read(u) + "\x03")
    counts = {"allow": Counter(), "block": Counter()}
    for u in (u or "" for u in urls):
        side = plain_rule(u)[1]
        if side and not held(u):
            counts[side].update(g[j:] for g in grams(u) for j in range(order + 1))
    after = {side: {} for side in counts}
    for side, c in counts.items():
        for g, n in c.items():
            seen = after[side].setdefault((len(g), g[:-1]), [0, 0])
            seen[0] += n
            seen[1] += 1

    def p(side, gram):
        q = 1 / 128
        for j in range(order, -1, -1):
            n, t = after[side].get((len(gram) - j, gram[j:-1]), (0, 0))
            if n:
                q = (counts[side][gram[j:]] + t * q) / (n + t)
        return q

    def score(u):
        g = grams(u)
        return sum(math.floor((math.log(p("allow", x)) - math.log(p("block", x))) * 1e6 + 0.5) for x in g) / (len(g) * 1_000_000)

    bins = lambda u: max(-1000, min(1000, math.floor(score(u) * 100)))
    sides = [(bins(u), plain_rule(u)[1]) for u in (u or "" for u in urls) if plain_rule(u)[1] and held(u)]
    a, r = ([b for b, s in sides if s == x] for x in ("allow", "block"))
    least = min(range(-1000, max((b for b, _ in sides), default=0) + 1), key=lambda t: (-(sum(b >= t for b in a) * len(r) + sum(b < t for b in r) * len(a)), abs(t), t)) if a and r else 0
    out = []
    for u in urls:
        rule, side = plain_rule(u)
        out.append((u, *plain_parts(u), rule, side or ("allow" if bins(u or "") >= least else "block"), None if side else round(score(u or ""), 9)))
    return sorted(out, key=repr)


ODD_URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM", "http://Example.com/en/x", "http://www.example.com/en/", "http://xexample.com/en/", "http://net/es/1", "ftp://a.net/fr", "http://a.NET/fr/?q=/en/", "http://a.net?x=/es/", "http://a.com:80/", "x://y://z.net/es/", "http://é漢😀.org/" + "ü" * 50, "http://long.org/" + "a1b2" * 30_000, "http://q.com/\n/en/"]


def test_urls_equal_the_plain_version(spark, tmp_path, monkeypatch):
    """By broadcast, and the query by shuffled joins."""
    rng = np.random.default_rng(5)
    urls = [f"http://{rng.choice(['www.', 'm.', ''])}{rng.choice(['alpha', 'win-bets', 'beta9'])}.{rng.choice(['com', 'net', 'org', 'example.com'])}/{rng.choice(['en', 'es', 'fr'])}/{rng.integers(1, 9999)}{rng.choice(['', '?a=1', '#top'])}" for _ in range(300)]
    urls += [urls[0]] * 40 + ODD_URLS
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("mine")).write.parquet(str(tmp_path / "pages.parquet"))
    expected = plain_filter(urls)
    out = filter_urls(spark.read.parquet(str(tmp_path / "pages.parquet")), URL_RULES)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "url_score"]
    rounded = lambda x: None if x is None else round(x, 9)
    assert sorted(((*tuple(r)[1:6], rounded(r["url_score"])) for r in out.collect()), key=repr) == expected
    monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", 0)
    thin = op13_url_filter(spark, str(tmp_path))
    assert thin.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(((urls[r["page_id"]], *tuple(r)[1:5], rounded(r["url_score"])) for r in thin.collect()), key=repr) == expected


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(u, i, "v") for i, u in enumerate(ODD_URLS)], "url string, c0 int, verdict string")
    none = filter_urls(pages, []).collect()
    assert {r["verdict"] for r in none} == {"allow"} and {r["url_score"] for r in none} == {0.0} and sorted(r["c0"] for r in none) == list(range(len(ODD_URLS)))
    assert filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_models_tell_urls_apart(spark):
    """What the rules allow and block differs in its names; hosts without a rule follow the names."""
    known = [(f"http://{w}{i % 7}.{d}/{'en' if d == 'com' else 'es'}/{i}",) for i in range(200) for w, d in (("garden", "com"), ("casino", "net"))]
    fresh = [(f"http://{w}{i}.org/{i}",) for i in range(20) for w in ("garden", "casino")]
    out = filter_urls(spark.createDataFrame(known + fresh, "url string"), URL_RULES).where("rule IS NULL").collect()
    assert len(out) == 40 and all(r["verdict"] == ("allow" if "garden" in r["url"] else "block") for r in out)


def test_rules(spark):
    urls = spark.createDataFrame([(u,) for u in ODD_URLS if u is not None], "u string")
    host, path = url_parts(F.col("u"))
    for r in urls.select("u", host.alias("h"), path.alias("p"), best_rule(host, path, URL_RULES).alias("b")).collect():
        assert (r["h"], r["p"]) == plain_parts(r["u"]) and (tuple(r["b"]) if r["b"] else (None, None)) == plain_rule(r["u"])
    both = spark.range(1).select(best_rule(F.lit("a.b"), F.lit("/x"), [("allow", "a.b", "/"), ("block", "b", "/x"), ("allow", "b", "/")]).alias("b")).first()["b"]
    assert tuple(both) == ("a.b/", "allow")  # both have four characters


def test_threshold(spark):
    bins = spark.createDataFrame([(-5, 0, 9), (1, 1, 0), (3, 8, 1), (7, 9, 0)], "bin int, a long, r long")
    assert best_threshold(bins) == 0  # as good as 1
    assert best_threshold(bins.where("r = 0")) == 0
    assert best_threshold(bins.withColumn("bin", F.col("bin") + 50)) == 46
    assert best_threshold(bins.withColumn("bin", F.col("bin") - 50)) == -49
