"""The numbered queries over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctuo.llm import (
    collocations, exact_dedup, jaccard, mixing, packing, repeats, secrets, sharding, top_k, toxicity, url_filter, warc,
    whitening,
)
from punctuo.llm.common import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), model)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    grown = F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", grown)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no time of capture: it is page_id seconds, up to 10^9, after the start of 2024."""
    second = F.coalesce(F.pmod(F.col("page_id"), F.lit(1_000_000_000)), F.lit(0))
    captured = F.timestamp_seconds(F.lit(1_704_067_200) + second)
    found = warc.archive(table(spark, sf_dir, "pages"), captured)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_topk, op2_mixing, op3_repeats, op4_secrets, op5_jaccard, op6_exact, op7_packing, op8_urls, op9_sharding,
        op10_toxicity, op11_warc, op12_collocations, op13_whitening,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
WHERE rank <= 20""",
    "op3_repeats": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN f USING (k) WHERE first < doc_id),
r AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(
    CASE WHEN js IS NULL THEN w ELSE [x FOR x, j IN w IF NOT list_contains(js, j)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)""",
    "op5_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (
      SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
  least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id)""",
    "op6_exact": f"""
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept,
  sha256(k) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS k FROM documents) WINDOW t AS (PARTITION BY k)""",
    "op11_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT *, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first, strpos(url, '://') AS cut FROM p),
k AS (SELECT *, substr(url, cut + 3) AS rest, regexp_extract(substr(url, cut + 3), '^[^/?#]*') AS host FROM d),
u AS (
  SELECT *, CASE WHEN cut IS NULL OR cut = 0 THEN coalesce(url, '') ELSE
    array_to_string(list_reverse(string_split(regexp_replace(translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www[.]', ''), '.')), ',')
    || ')' || coalesce(nullif(split_part(substr(rest, length(host) + 1), '#', 1), ''), '/') END AS url_key FROM k)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) // (32768 >> CAST(5 * (i % 4) AS INTEGER))) % 32 AS INTEGER) + 1, 1)
    FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  row_number() OVER (ORDER BY url_key , page_id % 1000000000, page_id) - 1 AS position
FROM u""",
    "op12_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM s, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT DISTINCT c.lang, c.g FROM c JOIN c d ON d.lang = c.lang AND d.k > c.k AND d.a >= c.a AND contains(' ' || d.g || ' ', ' ' || c.g || ' ')),
z AS (SELECT c.*, j FROM c ANTI JOIN x USING (lang, g), range(1, 5) t(j) WHERE j < c.k),
y AS (
  SELECT z.lang, z.g, a, j, l.f AS l, r.f AS r, n, (1000 * CAST(a AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM z JOIN n USING (lang) JOIN f l ON l.lang = z.lang AND l.g = array_to_string(z.w[:j], ' ')
  JOIN f r ON r.lang = z.lang AND r.g = array_to_string(z.w[j + 1:], ' ')),
m AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT lang, row_number() OVER o AS rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM m
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, g) QUALIFY row_number() OVER o <= 2000""",
}
