"""The numbered operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellzonal.llm.decontamination import contaminated, find_passages
from cellzonal.llm.jaccard_join import jaccard_groups
from cellzonal.llm.license_scan import scan_licenses
from cellzonal.llm.lm import score_texts
from cellzonal.llm.mixing import queue
from cellzonal.llm.pieces import decode_ids, encode_texts, read_model
from cellzonal.llm.prefix_trie import prefix_trie
from cellzonal.llm.quality_classifier import score_quality
from cellzonal.llm.quality_rules import quality_rules
from cellzonal.llm.secrets import KINDS, find_secrets
from cellzonal.llm.toxicity import score_toxicity
from cellzonal.llm.url_filter import judge_urls
from cellzonal.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]

# The rules that pages are judged by.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    found = jaccard_groups(table(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf, "pages").select("page_id", "url")
    found = judge_urls(pages, rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    found = queue(table(spark, sf, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op5_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(table(spark, sf, "documents"), order=3).drop("perplexity")


def op6_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = find_secrets(table(spark, sf, "documents").select("doc_id", "text"))

    def spelled(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    def count(kind):
        own = F.filter("secrets", lambda s: s["kind"] == kind)
        return F.size(own).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "random")
    counts = [count(kind) for kind in KINDS[:3]]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("secrets")).alias("spans"),
    )


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = find_passages(docs, table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op8_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        "base_labels",
        "labels",
        "score",
        F.array_join("expressions", "; ").alias("expressions"),
        "grants",
    )


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    found = quality_rules(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie(table(spark, sf, "conversations"))


def op12_sentencepiece(spark: SparkSession, sf: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decode_ids(encode_texts(docs, read_model(model)), read_model(model))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("ids_agree") & F.col("decoded_agree")).alias("library_agrees"),
    )


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    found = whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    parts = F.arrays_zip("whitened", "explained")
    return found.select(
        "vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error",
        F.posexplode(parts).alias("nth", "part"),
    ).select(
        "vec_id",
        (F.col("nth") + 1).alias("component"),
        "n",
        "deviation",
        F.col("part.whitened").alias("whitened"),
        F.col("part.explained").alias("explained"),
        "identity_error",
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_jaccard_join,
        op2_url_filter,
        op3_toxicity,
        op4_mixing,
        op5_lm_scoring,
        op6_secret_scan,
        op7_decontamination,
        op8_quality_classifier,
        op9_license_scan,
        op10_quality_rules,
        op11_prefix_trie,
        op12_sentencepiece,
        op13_whitening,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_lower('text')}, '{_WORD}') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, r.c AS component_id
FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = s.doc_id
"""

_HOST = (
    "CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), "
    f"'^[^/?#]*'), '{_UPPER}', '{_LOWER}') ELSE '' END"
)
_PATH = (
    "CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), "
    "'^[^/?#]*([^?#]*)', 1) ELSE '' END"
)
URL_SQL = f"""
WITH p AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
r(rule_host, rule_path, v) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
f AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, v FROM p LEFT JOIN r
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule,
  coalesce(arg_max(v, length(rule)), 'allow') AS verdict
FROM f GROUP BY page_id, host, path
"""

MIXING_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source),
w AS (
  SELECT source, s, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM t),
q AS (
  SELECT *, 2 * s / w AS dry, (SELECT 1.5e0 * sum(s) FROM t) - coalesce(sum(2 * s) OVER
    (ORDER BY 2 * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(w) OVER (ORDER BY 2 * s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w WHERE s > 0),
h AS (SELECT coalesce((SELECT lft / rest FROM q WHERE dry * rest >= lft ORDER BY dry, source LIMIT 1), 'inf') AS until),
g AS (SELECT source, s, CASE WHEN s = 0 THEN 0e0 ELSE least(w * until, 2e0 * s) END AS target FROM w, h),
b AS (
  SELECT d.*, g.s, g.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, s AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(greatest(0, least(size, round(target) - before)) + greatest(0, least(size, round(target) - before - s)) AS BIGINT) AS taken
FROM b
"""

PASSAGE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '{_TERM}') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_lower('text')}, '{_TERM}') AS ws FROM benchmark),
q AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(ws[j:j + least(13, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS j FROM i WHERE len(ws) > 0) x),
p AS (
  SELECT doc_id, k, j, array_to_string(ws[j:j + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS j
        FROM d, (SELECT DISTINCT k FROM q) ks WHERE len(ws) >= k) x),
m AS (SELECT doc_id, item_id, p.j, p.k FROM p JOIN q ON p.k = q.k AND p.g = q.g),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(j, j + k)) AS pos FROM m) x GROUP BY doc_id),
own AS (
  SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM m) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(own.n, 0) AS BIGINT) AS n_items, sha256(coalesce(own.items, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN own ON own.doc_id = d.doc_id
"""

TRIE_SQL = f"""
WITH step AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n::BIGINT, list_transform(range(8), lambda x: 0::BIGINT)),
      lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) AS v
    FROM (SELECT range AS n FROM range(256)) r) q),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, c - c % 5 AS b, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
      lambda a, x: xor(a // 256, t[xor(a, x) % 256 + 1])), 4294967295::BIGINT) % 9 AS h
  FROM ids, step),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      strlen(coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
used AS (
  SELECT c, p, role, text FROM h JOIN turns ON conv_id = b WHERE p <= h
  UNION ALL SELECT c, p, role, text FROM h JOIN turns ON conv_id = c WHERE p > h),
path AS (
  SELECT c, coalesce(w, []) AS w FROM ids LEFT JOIN (
    SELECT c, list({{'role': role, 'text': text}} ORDER BY p) AS w FROM used GROUP BY c) u USING (c)),
thru AS (SELECT c, w, d, w[:d] AS k FROM path, LATERAL (SELECT unnest(range(0, len(w) + 1)) AS d) x),
node AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n,
    string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(w) = d) AS ends
  FROM thru GROUP BY d, k),
own AS (
  SELECT *, (n - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(k[d].text) END AS saved,
    (SELECT count(*) FROM node x WHERE x.d = node.d + 1 AND x.k[:node.d] = node.k) AS children
  FROM node),
sums AS (
  SELECT len(a) AS d, a AS k, sum(saved) AS saved, count(*) FILTER (WHERE children = 0) AS leaves
  FROM (SELECT saved, children, k[:e] AS a FROM own, LATERAL (SELECT unnest(range(0, d + 1)) AS e) x) y GROUP BY a)
SELECT own.conv_id, CAST(own.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, own.n AS n_convs,
  own.children AS n_children, sums.leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN sums ON sums.k = own.k LEFT JOIN own up ON own.d > 0 AND up.d = own.d - 1 AND up.k = own.k[:own.d - 1]
"""

ORACLES: dict[str, str] = {
    "op1_jaccard_join": JACCARD_SQL,
    "op2_url_filter": URL_SQL,
    "op4_mixing": MIXING_SQL,
    "op7_decontamination": PASSAGE_SQL,
    "op11_prefix_trie": TRIE_SQL,
}
