"""The registered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsumugi.llm import decontaminate, hnsw, jaccard, lattice, lexicon, quality, suffixes, token_counts, urls, warc
from tsumugi.llm.common import public_tokenizer, scratch, table

RULES = [urls.Rule("org", "/", "allow"), urls.Rule("example.org", "/es/", "block"), urls.Rule("example.org", "/en/1", "block"), urls.Rule("com", "/fr/", "allow"), urls.Rule("com", "/de/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), RULES).drop("component")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.search(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_items") >= 2).alias("contaminated"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json")
    return lexicon.encoded(docs, vocabulary, lexicon.build_lexicon(docs, vocabulary), keys=["doc_id"])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality.scored(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", quality.is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of this run's own, so that every run encodes its misses
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), cache=scratch(spark, "token-counts"))


def op10_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scores(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_nearest_neighbours, op3_suffix_dedup, op4_decontamination, op5_bpe, op6_warc, op7_quality, op8_ngram_jaccard, op9_token_counts, op10_lattice_scores, pipeline)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NODE = "CASE WHEN contains({0}, '://') THEN " + _LOWER.format("regexp_extract({0}, '(?s)^(.*?://[^/?#]*)', 1)") + " || regexp_extract({0}, '(?s)^.*?://[^/?#]*([^#]*)', 1) ELSE {0} END"
_CANONICAL, _REFRESH = (f"regexp_extract(html, '(?is)<{tag}[^>]*>')" for tag in (r"link\b[^>]*\brel\s*=\s*[\"'']?canonical\b", r"meta\b[^>]*\bhttp-equiv\s*=\s*[\"'']?refresh\b"))

ORACLES = {
    "op1_url_filters": rf"""
WITH RECURSIVE t AS (SELECT url, {_CANONICAL} AS c, {_REFRESH} AS f, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS origin,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
g AS (SELECT url, origin, path, CASE WHEN regexp_extract(c, '(?is)\bhref\s*=\s*"([^"]*)"', 1) <> '' THEN regexp_extract(c, '(?is)\bhref\s*=\s*"([^"]*)"', 1)
    ELSE regexp_extract(c, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) END AS x FROM t
    UNION ALL SELECT url, origin, path, regexp_extract(f, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM t),
w AS (SELECT url, CASE WHEN contains(x, '://') THEN x WHEN starts_with(x, '//') THEN regexp_extract(origin, '^([^:]*:)', 1) || x WHEN origin = '' THEN NULL
    WHEN starts_with(x, '/') THEN origin || x WHEN starts_with(x, '?') THEN origin || path || x
    ELSE origin || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || x END AS target FROM g WHERE x <> '' AND NOT starts_with(x, '#')),
e AS (SELECT {_NODE.format("url")} AS src, {_NODE.format("target")} AS dst FROM w WHERE target IS NOT NULL),
links AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
reach(n, m) AS (SELECT src, src FROM links UNION SELECT reach.n, links.dst FROM reach JOIN links ON reach.m = links.src),
every AS (SELECT DISTINCT url FROM pages UNION SELECT src FROM links),
u AS (SELECT url, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM every),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT u.*, (SELECT max(struct_pack(n := length(h || p), r := h || p, v := v)) FROM r
    WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)) AS best FROM u),
blocked AS (SELECT DISTINCT reach.n FROM reach JOIN m ON m.url = reach.m WHERE m.best.v = 'block')
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, CASE WHEN blocked.n IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM pages JOIN m ON pages.url IS NOT DISTINCT FROM m.url LEFT JOIN blocked ON blocked.n = {_NODE.format("pages.url")}""",
    "op4_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS m, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS g
    FROM b, unnest(generate_series(1, len(w) - least(8, len(w)) + 1)) AS s(i) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT k, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM d, ms, unnest(generate_series(1, len(w) - m + 1)) AS s(i) WHERE len(w) >= m),
h AS (SELECT dw.k, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
c AS (SELECT k, count(DISTINCT i + o) AS n_hit FROM h, unnest(generate_series(0, m - 1)) AS s(o) GROUP BY k),
n AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN n USING (k)""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
w AS (SELECT body, max(page_id) AS winner FROM p WHERE n >= 1000 GROUP BY body)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
    CASE WHEN winner IS NULL OR winner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM p LEFT JOIN w ON p.body = w.body AND p.n >= 1000""",
}
