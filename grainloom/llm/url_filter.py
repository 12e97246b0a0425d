"""URL filter: allow and block rules, and for the rest the likelihood ratio of two character models learned from what the
rules decide. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts

#: Characters that predict the next one, at most.
ORDER = 4
#: Characters that a model reckons with where it has seen nothing: each has 1 / ALPHABET.
ALPHABET = 128
#: Likelihood ratios are whole millionths, so that their sums do not depend on the order; thresholds are hundredths
#: between -THRESHOLDS and THRESHOLDS.
UNIT, STEP, THRESHOLDS = 1_000_000, 100, 1_000
#: Tables of ratios up to so many rows (of under 40 bytes) are broadcast; larger ones are joined by shuffles.
BROADCAST_GRAMS = 400_000
#: Of each so many decided URLs (by a hash of the URL), one is kept from learning and used to calibrate the threshold.
FOLDS = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
Rule = tuple[str, str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and where there is no ://."""
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.char_length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule string, verdict string) of the longest rule (verdict, host, path start) that fits, else null; of equally long
    ones the first."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # later ones overrule
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def model_text(url: Column) -> Column:
    """What the models read: the URL after ://, or all of it, with A-Z in lower case and every digit as 0."""
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(url)
    return F.translate(after, UPPER + "123456789", UPPER.lower() + "0" * 9)


def windows(text: Column, order: int) -> Column:
    """Each character of the text and the end mark, with the `order` characters before it (start marks, at the start)."""
    chars = F.split(F.concat(F.lit("\x02" * order), text, F.lit("\x03")), "")
    # the array of one makes the characters a variable, so that they are split once a text
    cut = F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - order), lambda i: F.concat(*[F.get(c, i + (j - 1)) for j in range(order + 1)])))
    return cut[0]


def ratios(grams: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(gram, ratio long): ln of the accepted model's probability of a gram's last character after the others, less that of
    the rejected model, for each gram of (gram, a, r), the grams of order + 1 characters with their counts in both.

    Models of variable order: a context that was seen n times with t different characters after it gives a character seen c
    times there (c + t * q) / (n + t), q being its probability after the context without its first character; a context never
    seen gives q. So each probability rests on the longest contexts that a model knows. A context and an ending have at most
    as many grams as there are characters, so neither windows nor joins meet large groups.
    """
    out = None
    for k in range(order + 1):
        level = grams.groupBy(F.substr("gram", F.lit(order - k + 1)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        seen = Window.partitionBy(F.substr("gram", F.lit(1), F.lit(k)))
        for x in "ar":
            level = level.withColumns({f"n{x}": F.sum(x).over(seen), f"t{x}": F.count(F.when(F.col(x) > 0, 1)).over(seen)})
        if out is None:
            level = level.withColumns({f"q{x}": F.lit(1.0 / ALPHABET) for x in "ar"})
        else:
            lower = out.select(F.col("gram").alias("ending"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            level = level.join(lower, F.substr("gram", F.lit(2)) == F.col("ending"))
        p = {f"p{x}": F.when(F.col(f"n{x}") == 0, F.col(f"q{x}")).otherwise((F.col(x) + F.col(f"t{x}") * F.col(f"q{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))) for x in "ar"}
        out = scratch.keep(level.select("gram", *[c.alias(n) for n, c in p.items()]))
    return out.select("gram", F.floor((F.ln("pa") - F.ln("pr")) * UNIT + 0.5).cast("long").alias("ratio"))


def best_threshold(scored: DataFrame) -> int:
    """Of (bin int, a long, r long), held-out URLs by score, the least bin to accept: of all whole numbers one with the best mean
    of the shares of accepted URLs at or above it and of rejected ones below; of equally good ones that nearest 0, then the lower.
    0 if one side is empty."""
    bins = scored.groupBy("bin").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))  # 2 * THRESHOLDS + 1 rows at most
    everything, by_bin = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("bin")
    upto = by_bin.rowsBetween(Window.unboundedPreceding, -1)
    # every number above the bin before and up to a bin accepts the same URLs
    least = F.greatest(F.coalesce(F.lag("bin").over(by_bin) + 1, F.lit(-THRESHOLDS)), F.least("bin", F.lit(0))).alias("least")
    bins = bins.select(least, *[F.coalesce(F.sum(x).over(upto), F.lit(0)).cast("double").alias(f"under_{x}") for x in "ar"], *[F.sum(x).over(everything).cast("double").alias(f"all_{x}") for x in "ar"])
    good = (F.col("all_a") - F.col("under_a")) * F.col("all_r") + F.col("under_r") * F.col("all_a")
    best = bins.where("all_a > 0 AND all_r > 0").orderBy(good.desc(), F.abs("least"), "least").first()
    return best["least"] if best else 0


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", order: int = ORDER) -> DataFrame:
    """pages with host, path, rule (host and path of the longest rule that fits, else null), verdict (allow or block) and
    url_score double (null where a rule decides).

    rules: (allow or block, host in lower case, start of the path); a rule fits its host and all subdomains. Some hundreds at
    most, as each row is held against each. URLs that no rule fits get the models' verdict: the mean over their characters, the
    end included, of the log-likelihood ratio of what the rules allow to what they block, at or above a threshold. The
    threshold is calibrated on a fifth of the decided URLs, which the models do not learn from. Every row counts in counts and calibration,
    repeated ones each time; equal URLs are scored once. Without URLs of either kind ratios are what the other model gives,
    and the threshold is 0. Null URLs are like empty ones: host and path are empty, and only the end mark is scored. URLs of
    any length count whole. An empty table stays empty. Columns of the five names in pages are replaced; others pass,
    whatever their names.
    """
    scratch = Scratch(pages.sparkSession)
    added = ("host", "path", "rule", "verdict", "url_score")
    names = [c for c in pages.columns if c not in added]
    if url_col in added:
        raise ValueError(f"the column of URLs can't be called {url_col}")
    rows = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("key"))
    urls = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    fold = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 8), 16, 10).cast("long") % FOLDS
    # a table of as many files as there are partitions, as each URL becomes many rows
    urls = urls.repartition(parts(pages.sparkSession), "key")
    urls = scratch.keep(urls.select(F.monotonically_increasing_id().alias("uid"), "key", "n", best_rule(*url_parts(F.col("key")), rules)["verdict"].alias("side"), (fold == 0).alias("held")))
    learned = {x: F.when((F.col("side") == side) & ~F.col("held"), F.col("n")).otherwise(0).cast("long").alias(x) for x, side in (("a", "allow"), ("r", "block"))}
    grams = urls.select(F.explode(windows(model_text(F.col("key")), order)).alias("gram"), *learned.values())
    table = scratch.keep(ratios(scratch.keep(grams.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))), order, scratch))
    if table.count() <= BROADCAST_GRAMS:
        table = F.broadcast(table)
    each = urls.where("held OR side IS NULL").select("uid", F.explode(windows(model_text(F.col("key")), order)).alias("gram"))
    summed = each.join(table, "gram").groupBy("uid").agg(F.sum("ratio").alias("ratio"), F.count(F.lit(1)).alias("length"))
    score = F.col("ratio") / (F.col("length") * UNIT)
    scored = scratch.keep(summed.select("uid", score.alias("score"), F.greatest(F.lit(-THRESHOLDS), F.least(F.lit(THRESHOLDS), F.floor(score * STEP))).cast("int").alias("bin")))
    sides = [F.when(F.col("side") == side, F.col("n")).otherwise(0).alias(x) for x, side in (("a", "allow"), ("r", "block"))]
    threshold = best_threshold(urls.where("held AND side IS NOT NULL").join(scored, "uid").select("bin", *sides))
    judged = urls.where("side IS NULL").select("uid", "key").join(scored, "uid").select("key", "score", F.when(F.col("bin") >= threshold, "allow").otherwise("block").alias("by_model"))
    host, path = url_parts(F.col("key"))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    out = rows.join(judged, "key", "left")
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "host", "path",
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "by_model").alias("verdict"), F.when(F.col("best").isNull(), F.col("score")).alias("url_score"),
    )
