import math
import time
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from grainloom.llm import html_extract
from grainloom.llm.bitslice import add_shifted, at_least, kth_largest, packed, top_k
from grainloom.llm.html_extract import CONTENT, IS_BODY, IS_CONTAINER, IS_HOME, IS_INSIDE, IS_MARKED, SELF, STYLE, Page, extract_main_text, judged_branches, tree_rows
from grainloom.llm.ivfpq import search

VEC = "vec_id long, embedding array<float>, label int"


def vectors(spark, x, ids=None, odd=True):
    rows = [(int(i), [float(v) for v in r], 0) for i, r in zip(ids if ids is not None else range(len(x)), x)]
    if odd:
        rows += [(100_000, None, 0), (200_000, [1.0, None] + [0.0] * (x.shape[1] - 2), 0), (300_000, [float("nan")] * x.shape[1], 0), (400_000, [float("inf")] * x.shape[1], 0), (500_000, [1.0, 2.0], 0), (None, [1.0] * x.shape[1], 0)]
    return spark.createDataFrame(rows, VEC)


def test_bitmaps():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 60, 150), rng.integers(0, 9, 150)
    total = []
    for v, shift in ((x, 0), (y, 2), (x, 1)):
        add_shifted(total, [packed((v >> i & 1).astype(bool)) for i in range(int(v.max()).bit_length())], shift)
    sums = x + 4 * y + 2 * x
    got = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:150].astype(int) << i) for i, s in enumerate(total))
    assert (got == sums).all()
    every = packed(np.ones(150, bool))
    for k in (1, 7, 150):
        assert kth_largest(total, every, k) == sorted(sums)[-k]
    for least in (0, 17, int(sums.max()), 10**6):
        rows = np.unpackbits(at_least(total, every, least).view(np.uint8), bitorder="little")[:150]
        assert (rows.astype(bool) == (sums >= least)).all()


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (400, 16)).astype(np.float32)
    x[50:90] = x[7]  # ties
    x[120] = 0
    got = {}
    for r in top_k(vectors(spark, x), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    z = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    assert set(got) == set(range(0, 400, 20))
    for q, rows in got.items():
        s = z @ z[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:10]
        assert sorted(rows) == [(n + 1, i, s[i]) for n, i in enumerate(best)]


def test_top_k_small_and_empty(spark):
    x = np.array([[1, 2], [3, 4], [-5, 6]], np.float32)
    assert top_k(vectors(spark, x, odd=False), F.col("vec_id") == 0).count() == 2
    assert top_k(spark.createDataFrame([], VEC), F.col("vec_id") == 0).count() == 0
    twice = vectors(spark, x, [1, 1, 2], odd=False)
    assert [r["vec_id"] for r in top_k(twice, F.col("vec_id") == 1).collect()] == [2]


def test_top_k_of_large_components(spark):
    x = [[1.0, 2.0], [40000.0, 1.0], [3.0, 1.0], [-1e300, 5.0], [1e308, -1e308]]
    df = spark.createDataFrame([(100 * i, v, "s") for i, v in enumerate(x)], "vec_id long, embedding array<double>, sliced string")
    z = [[int(v) * 1024 for v in r] for r in x]
    got = {}
    for r in top_k(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect():
        got.setdefault(r["query_id"] // 100, []).append((r["vec_id"] // 100, r["score"]))
    for q, rows in got.items():
        s = [max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(z[q], r)))) for r in z]
        assert rows == [(i, s[i]) for i in sorted((i for i in range(5) if i != q), key=lambda i: (-s[i], i))]


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (20, 24))
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(0, 0.3, (3000, 24))).astype(np.float32)
    x[1000:1050] = x[11]
    x[5] = 0
    rows = search(vectors(spark, x), F.col("vec_id") % 50 == 0).collect()
    y, hits, total = x.astype(np.float64), 0, 0
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 3000, 50):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(3000), d)).tolist() if i not in (q, 5)][:10]
        found = sorted(by[q])
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(s - d[i]) < 1e-9 for _, i, s in found)
        assert found == sorted(found, key=lambda f: (f[2], f[1]))
        hits += len(set(best) & {f[1] for f in found})
        total += 10
    assert hits / total > 0.9
    assert sorted(i for _, i, _ in by[1000]) == sorted([11, *range(1001, 1010)])


def test_search_small_and_empty(spark):
    x = np.array([[1, 2], [3, 4], [5, 6]], np.float32)
    assert [r["vec_id"] for r in search(vectors(spark, x, odd=False), F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]
    assert search(spark.createDataFrame([], VEC), F.col("vec_id") == 0).count() == 0
    assert search(vectors(spark, np.zeros((3, 2), np.float32), odd=False), F.col("vec_id") == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article class="post"><h1>Title &amp; more</h1><p><b>First
 &nbsp; para.<br><p>Second&#33; <i>in</i>line</p><div class="ad">Buy</div><ul><li>One<li>Two</ul><form>Mail <input></form>
<section id="comments"><article class="comment"><p>Nice</p></article></section></article>
<aside>Side</aside><footer>&copy; X</footer></body></html>"""


def test_page():
    assert Page(PAGE).main_text({}) == "Title & more\nFirst para.\nSecond! inline\nOne\nTwo"
    assert Page(None).main_text({}) == Page("").main_text({}) == ""
    assert Page("<article><p>cut off &amp").main_text({}) == "cut off &"
    assert Page("plain text").main_text({}) == "plain text"
    assert Page("<article><p>a</p><!-- x --><p hidden>b</p></article><p>c").main_text({}) == "a"
    assert len(Page("<article>" + "<div><p>x" * 3000).main_text({}).split("\n")) == 3000


def test_pages_that_are_not_well_formed():
    text = lambda x: Page(x).main_text({})
    assert text('<article><p>A<div class="share-price">9.50</div><div class="share-buttons">Tweet</div></article>') == "A\n9.50"
    assert text('<div class="review form-guide"><p>Long text</p></div>') == "Long text"
    assert text('<p>A<a title="x>y text</p>') == "Ay text"
    assert text("<p>A<!-->B<!-- x --!>C<!--->D</p>") == "ABCD"
    assert text("<body><form id=f><nav>N</nav><h1>T</h1><p>x</form>") == "T\nx" and text("<form><p>mail</form>") == ""
    assert text("<ul><li>a<p>b<li>c</ul><table><tr><td>d<td>e<tr><td>f</table>") == "a\nb\nc\nd\ne\nf"
    began = time.time()
    assert len(text("<b>x<p>" * 20_000).split("\n")) == 20_000
    assert len(text("<div>x" * 20_000 + "</i>" * 20_000).split("\n")) == 20_000
    assert sum(1 for _ in Page("<div>x" * 20_000).tree()) < 5_000 and text('<a "' * 20_000) == ""
    assert time.time() - began < 20


def brute_judged(pages, threshold, share, min_pages):
    """The branches of one host's pages and whether they are low, by the definition in judged_branches."""
    trees = [list(Page(p).tree()) for p in pages]
    on, flags, styles, texts, ups, parent = Counter(), {}, defaultdict(Counter), defaultdict(Counter), defaultdict(set), {}
    words = {}
    for rows in trees:
        for kind, key, value, number in rows:
            if kind == SELF:
                on[key] += 1
                flags[key] = number
            elif kind == STYLE:
                styles[key][value] += 1
            elif kind == CONTENT:
                texts[key][value] += 1
                words[value] = number
            else:
                ups[key].add(value)
                if number:
                    parent[key] = value
    direct = {k: sum(c * words[v] * (1 - (math.log(c) / math.log(on[k]) if on[k] > 1 else 0)) for v, c in texts[k].items()) for k in on}
    said = {k: sum(c * words[v] for v, c in texts[k].items()) for k in on}
    weight = {k: sum(direct[x] for x in on if x == k or k in ups[x]) for k in on}
    all_said = {k: sum(said[x] for x in on if x == k or k in ups[x]) for k in on}
    out = {}
    for k, up in parent.items():
        if on[k] < min_pages:
            continue
        entropy = -sum(c / on[k] * math.log(c / on[k]) for c in styles[k].values()) / math.log(on[k])
        part = 0.9 ** len(styles[k])
        importance = (1 - part) * entropy + part * (weight[k] / all_said[k] if all_said[k] else 0)
        largest = max((weight[x] for x, u in parent.items() if u == up and flags[x] & IS_CONTAINER), default=0)
        varied = max(largest, direct[up] if largest else 0) >= 0.25 * all_said[k]
        again = importance < threshold and varied and (not flags[k] & IS_INSIDE or flags[k] & IS_MARKED)
        little = varied and flags[k] & IS_CONTAINER and not flags[k] & IS_INSIDE and weight[k] < share * largest and largest > direct[up]
        other = flags[k] & IS_MARKED and weight[k] < 0.5 * max(largest, direct[up] if largest else 0)
        out[k] = bool((again or little or other) and not flags[k] & (IS_HOME | IS_BODY))
    return out


def test_style_tree_against_brute_force(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    pages = []
    for i in range(40):
        menu = "".join(f"<li>{word(1)}" for _ in range(rng.integers(3, 7)))
        related = f"<div class=rel><p>{word(3)}</div>" if i % 3 else ""
        pages.append(f"<body><nav><ul>{menu}</ul></nav><div id=x><div class=text><h1>{word(4)}</h1><p>{word(60)}<p>{word(40)}<blockquote>{word(2)}</blockquote></div>{related}<aside>{word(9)}</aside></div><section><p>Same words</section><div class=one{i}>{word(2)}</div>")
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(3)
    got = {r["key"] % 2**64: r["low"] for r in judged_branches(tree_rows(df, "host", "html"), 0.3, 0.1, 5).collect()}
    want = brute_judged(pages, 0.3, 0.1, 5)
    assert got == want and 4 < sum(want.values()) < len(want)


def test_tree_decides_without_marks(spark, monkeypatch):
    """Menus and notices go by their importance, although their words vary; also if branches are joined, not broadcast."""
    rng = np.random.default_rng(9)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    rows = []
    for i in range(30):
        own = word(50)
        rows.append((i, f"http://h.example/{i}", f"<body><div id=a><ul><li>{word(1)}<li>{word(1)}</ul></div><div id=b><p>{own}</p></div><div id=c>{word(3)}</div>", own))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    for limit in (100_000, 0):
        monkeypatch.setattr(html_extract, "BROADCAST_BRANCHES", limit)
        assert {r["page_id"]: r["text"] for r in extract_main_text(df).collect()} == {r[0]: r[3] for r in rows}


def test_style_tree_finds_what_a_host_repeats(spark):
    rows = []
    for i in range(30):
        own = " ".join(f"word{i}x{j}" for j in range(20))
        rows.append((i, f"https://User@Example.com:80/{i}", f"<body><div id=top>Welcome to us</div><div id=text><p>{own}</p><p>{own} end</p></div><div id=links><p>More of us</p></div></body>"))
    rows += [(100, None, "<body><p>alone</p></body>"), (101, "not a url", None), (102, "https://example.com/e", ""), (0, "https://example.com/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in extract_main_text(df).collect()}
    for i in range(30):
        own = " ".join(f"word{i}x{j}" for j in range(20))
        assert got[i]["text"] == f"{own}\n{own} end" and got[i]["n_chars"] == 2 * len(own) + 5
    assert got[100]["text"] == "alone" and got[101]["text"] == "" and got[102]["n_chars"] == 0
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_equal_articles_of_a_host_stay(spark):
    page = "<body><nav>x</nav><article><h1>A</h1><p>Same text</p></article></body>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page) for i in range(12)], "page_id long, url string, html string")
    assert {r["text"] for r in extract_main_text(df).collect()} == {"A\nSame text"}


def site(rows):
    return "page_id long, url string, html string", [(i, f"http://h{host}.example/{i}", page) for i, (host, page) in enumerate(rows)]


def test_no_article_of_equal_or_partly_equal_pages_is_lost(spark):
    """Hosts of 4, 5, 6 and 60 equal pages, with and without an article element; and what an author repeats in articles."""
    story = "<{0}><h1>T</h1><div class='entry'><p>story of some words</p></div></{0}>"
    rows, want = [], []
    for host, n in enumerate((4, 5, 6, 60)):
        for tag in ("article", "div"):
            rows += [(f"{tag}{host}", f"<body><nav><a>Home</a></nav>{story.format(tag)}<footer>end</footer></body>")] * n
            want += ["T\nstory of some words"] * n
    for i in range(8):
        own = " ".join(f"own{i}x{j}" for j in range(15))
        rows.append(("stand", f"<body><article><h1>T{i}</h1><p class='standfirst'>From our town</p><p>{own}</p><div class='share-buttons'>Share this now</div></article></body>"))
        want.append(f"T{i}\nFrom our town\n{own}")
        rows.append(("mirror", f"<body><div id=a><p>one story at many places with all its words kept by all of them</p></div><div id=c>Word{i}</div></body>"))
        want.append(f"one story at many places with all its words kept by all of them\nWord{i}")
    kind, rows = site(rows)
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, kind)).collect()}
    assert [got[i] for i in range(len(want))] == want


def test_tree_marks_and_tags_differ(spark, monkeypatch):
    """Without article elements: what a host repeats goes by the tree, a marked branch by its mark too, all else stays."""
    rows = []
    for i in range(12):
        own = " ".join(f"own{i}x{j}" for j in range(20))
        rows.append(("t", f"<body><div id=ka>Read us every day</div><div class=sidebar>side{i} bar</div><div id=kb><p>{own}</p></div></body>"))
    kind, rows = site(rows)
    df = spark.createDataFrame(rows, kind)
    text = lambda **x: {r["text"] for r in extract_main_text(df, **x).collect()}
    bodies = {" ".join(f"own{i}x{j}" for j in range(20)) for i in range(12)}
    assert text() == bodies
    assert text(min_pages=1000) == {f"Read us every day\n{b}" for b in bodies}


def test_pages_nested_over_the_told_levels(spark):
    deep = lambda x: "<div class=a>" * 90 + x + "</div>" * 90
    kind, rows = site([("d", f"<body>{deep(f'deep words of page {i}')}<p>beside {i}</p></body>") for i in range(7)])
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, kind)).collect()}
    assert got == {i: f"deep words of page {i}\nbeside {i}" for i in range(7)}


def test_search_reranks_200(spark, rows):
    x = np.random.default_rng(6).normal(0, 1, (1500, 24)).astype(np.float32)  # a single coarse code: true neighbours lie deep in its order
    asked, df = F.col("vec_id") % 100 == 0, vectors(spark, x, odd=False)
    deep = rows(search(df, asked, lists=1, parts=1, rerank=200))
    assert rows(search(df, asked, lists=1, parts=1)) == deep != rows(search(df, asked, lists=1, parts=1, rerank=150))
