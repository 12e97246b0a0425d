"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff_lm import lm_scores
from .bitslice import top_k
from .debruijn import remove_repeats
from .fim import fill_in_middle, restored
from .html_extract import extract_main_text
from .ivfpq import search
from .langid import held_out, identify, learn_profiles
from .line_dedup import dedup_lines
from .merkle import ascii_lower, merkle_manifest
from .mixing import mix_sources
from .packing import pack
from .simhash import near_duplicates
from .url_filter import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), n_buckets=16, token_budget=65_536)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    profiles = learn_profiles(docs.where("NOT held_out"), "text", "lang")
    return identify(docs.select("doc_id", "held_out", "text"), profiles).drop("text")


def op7_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, text = (F.sha2(c.cast("binary"), 256) for c in (F.col("output"), restored(F.col("output"), F.col("form"))))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output_sha256"), text.alias("restored_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    changed = F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    out = merkle_manifest(table(spark, sf_dir, "documents"), tampered={"text": changed})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


#: Which hosts and paths are taken (verdict, host, start of the path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS z FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(v.z) + 1), lambda i: q.z[i] * v.z[i]))::BIGINT AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
o AS (SELECT win, min(doc_id) AS owner FROM p GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT p.doc_id, unnest(range(i, i + 13)) AS pos FROM p JOIN o USING (win) WHERE owner < p.doc_id),
each AS (SELECT doc_id, pos, words[pos] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c)::DOUBLE * (1.0::DOUBLE / (SELECT count(*) FROM c)) / n AS lam FROM c),
cdf AS (SELECT source, sum(CASE WHEN k = 0 THEN exp(-lam) ELSE exp(-lam + k * ln(lam) - lgamma(k + 1)) END) OVER (PARTITION BY source ORDER BY k) AS p
        FROM r, (SELECT unnest(range(0, 200))::DOUBLE AS k)),
d AS (SELECT *, (('0x' || substr(md5('17:' || doc_id || ':1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(cdf.p)::INTEGER AS copies FROM d JOIN cdf ON cdf.source = d.source AND cdf.p < d.u GROUP BY ALL),
x AS (SELECT *, unnest(range(1, copies + 1))::INTEGER AS mix_copy FROM n)
SELECT doc_id, text, lang, source, n_chars, mix_copy, ('0x' || substr(md5('17:order:' || doc_id || ':' || mix_copy), 1, 15))::BIGINT AS mix_key FROM x
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || doc_id) AS h FROM documents),
k AS (SELECT *, len(l)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

OP12_SQL = """
WITH RECURSIVE crc AS (SELECT doc_id, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, x: list_reduce(range(8), lambda y, _: xor(y >> 1, 3988292384 * (y & 1)), xor(c, x)), 4294967295::BIGINT) AS c FROM documents),
raw AS (SELECT doc_id, lang, text, 'x' AS x, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
        CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS pre FROM documents),
leaves AS (SELECT raw.doc_id, coalesce('+' || lang, '') AS grp, sha256(pre || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        sha256(pre || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || CASE WHEN xor(c, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END END) AS other
        FROM raw JOIN crc USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS width FROM leaves),
up AS (SELECT 0 AS level, grp, pos, width, leaf AS node FROM placed
       UNION ALL SELECT any_value(level) + 1, grp, pos // 8, (any_value(width) + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE width > 1 GROUP BY grp, pos // 8),
tops AS (SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS width FROM up WHERE width = 1),
roots AS (SELECT 0 AS level, pos, width, node FROM tops
       UNION ALL SELECT any_value(level) + 1, pos // 8, (any_value(width) + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM roots WHERE width > 1 GROUP BY pos // 8),
runs AS (SELECT level, grp, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM up WHERE width > 1 GROUP BY ALL
       UNION ALL SELECT level + 1000, grp, r.run, nodes FROM tops t, (SELECT level, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM roots WHERE width > 1 GROUP BY ALL) r WHERE t.pos // (8 ** (r.level + 1))::BIGINT = r.run),
walk AS (SELECT doc_id, placed.grp, leaf, 0 AS level, placed.pos AS spot, other AS node, '' AS proof FROM placed
       UNION ALL SELECT doc_id, walk.grp, leaf, CASE WHEN runs.nodes IS NOT NULL THEN level + 1 ELSE 1000 END, CASE WHEN runs.nodes IS NOT NULL THEN spot // 8 ELSE tops.pos END,
                CASE WHEN runs.nodes IS NOT NULL THEN sha256(array_to_string(nodes[1:spot % 8], '') || walk.node || array_to_string(nodes[spot % 8 + 2:], '')) ELSE walk.node END,
                CASE WHEN runs.nodes IS NOT NULL THEN proof || array_to_string(nodes[1:spot % 8], '') || array_to_string(nodes[spot % 8 + 2:], '') ELSE proof END
       FROM walk JOIN tops ON tops.grp = walk.grp LEFT JOIN (SELECT level AS rlevel, grp AS rgrp, run, nodes FROM runs) runs ON rlevel = level AND rgrp = walk.grp AND run = spot // 8 WHERE runs.nodes IS NOT NULL OR level < 1000),
ends AS (SELECT doc_id, leaf, grp, arg_max(node, level) AS folded_root, arg_max(proof, level) AS proof FROM walk GROUP BY ALL)
SELECT ends.doc_id, leaf, tops.node AS subroot, r.node AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = r.node AS verified
FROM ends JOIN tops USING (grp), (SELECT node FROM roots WHERE width = 1) r
"""

OP13_SQL = r"""
WITH RECURSIVE a AS (SELECT page_id, coalesce(url, '') AS key, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h0 FROM a),
c AS (SELECT page_id, key, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM b),
rules(side, site, path_start) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
d AS (SELECT c.*, (SELECT arg_max([site || path_start, side], length(site || path_start)) FROM rules WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, path_start)) AS best FROM c),
u AS (SELECT key, count(*) AS n, any_value(best[2]) AS side, ('0x' || substr(md5(key), 1, 8))::BIGINT % 5 = 0 AS held,
      translate(CASE WHEN contains(key, '://') THEN substr(key, strpos(key, '://') + 3) ELSE key END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS t FROM d GROUP BY key),
g AS (SELECT key, side, held, CASE WHEN side = 'allow' AND NOT held THEN n ELSE 0 END AS a, CASE WHEN side = 'block' AND NOT held THEN n ELSE 0 END AS r,
      substr(repeat(chr(2), 4) || t || chr(3), unnest(range(1, length(t) + 2)), 5) AS gram FROM u),
full_grams AS (SELECT gram, sum(a) AS a, sum(r) AS r FROM g GROUP BY gram),
levels AS (SELECT k, substr(gram, 5 - k) AS gram, sum(a) AS a, sum(r) AS r FROM full_grams, range(5) x(k) GROUP BY ALL),
stats AS (SELECT *, sum(a) OVER w AS na, sum(r) OVER w AS nr, count(CASE WHEN a > 0 THEN 1 END) OVER w AS ta, count(CASE WHEN r > 0 THEN 1 END) OVER w AS tr
          FROM levels WINDOW w AS (PARTITION BY k, substr(gram, 1, k))),
p AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS gram, 1.0::DOUBLE / 128 AS pa, 1.0::DOUBLE / 128 AS pr
      UNION ALL SELECT p.k + 1, s.gram, CASE WHEN na = 0 THEN pa ELSE (a + ta * pa) / (na + ta) END, CASE WHEN nr = 0 THEN pr ELSE (r + tr * pr) / (nr + tr) END
      FROM p JOIN (SELECT k, gram, a::DOUBLE AS a, r::DOUBLE AS r, na::DOUBLE AS na, nr::DOUBLE AS nr, ta::DOUBLE AS ta, tr::DOUBLE AS tr FROM stats) s ON s.k = p.k AND substr(s.gram, 2) = p.gram),
ratio AS (SELECT gram, floor((ln(pa) - ln(pr)) * 1000000 + 0.5)::BIGINT AS ratio FROM p WHERE k = 5),
score AS (SELECT key, sum(ratio)::DOUBLE / (count(*) * 1000000) AS score FROM g JOIN ratio USING (gram) WHERE held OR side IS NULL GROUP BY key),
bins AS (SELECT *, greatest(-1000, least(1000, floor(score * 100)))::INTEGER AS bin FROM score),
h AS (SELECT bin, sum(CASE WHEN side = 'allow' THEN n ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN side = 'block' THEN n ELSE 0 END)::DOUBLE AS r FROM u JOIN bins USING (key) WHERE held AND side IS NOT NULL GROUP BY bin),
s AS (SELECT greatest(coalesce(lag(bin) OVER (ORDER BY bin) + 1, -1000), least(bin, 0)) AS bin, coalesce(sum(a) OVER w, 0) AS ua, coalesce(sum(r) OVER w, 0) AS ur, sum(a) OVER () AS aa, sum(r) OVER () AS ar FROM h WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT coalesce((SELECT bin FROM s WHERE aa > 0 AND ar > 0 ORDER BY (aa - ua) * ar + ur * aa DESC, abs(bin), bin LIMIT 1), 0) AS least_bin)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], CASE WHEN bin >= least_bin THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN best IS NULL THEN score END AS url_score
FROM d LEFT JOIN bins USING (key), t
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_bitslice": OP4_SQL, "op7_debruijn": OP7_SQL, "op8_mixing": OP8_SQL, "op11_fim": OP11_SQL, "op12_merkle": OP12_SQL, "op13_url_filter": OP13_SQL}
