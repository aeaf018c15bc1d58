"""One query per operator over its whole table, and SQL for those that it can express."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bellwether.llm import centroids, chat, decontamination, divergence, impact, langid, lengths, mixing, packing, quality, sharding, simhash, urlfilter
from bellwether.llm.common import crc_of, table

SHARDS = [f"shard-{k:03d}" for k in range(64)]
#: Context limits that the length table answers besides all lengths that occur.
LIMITS = (512, 1024, 2048, 4096, 8192, 16_384, 32_768, 65_536, 131_072)
#: (verdict, host, path)
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TRICKY = r"\### Assistant: </turn> ok"


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_of("doc_id", 4) == 2)
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lengths.suffix_sums(lengths.histogram(docs, lengths.encoded_length(spark)(F.col("text"))), LIMITS)


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    record = F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"})
    extra = json.dumps({"messages": [{"role": "user", "content": TRICKY}, {"role": "assistant", "content": TRICKY}]})
    records = rows.select("conv_id", record.alias("record")).unionByName(spark.createDataFrame([(-7, extra)], "conv_id bigint, record string"))
    return chat.digests(chat.format_turns(chat.canonical_turns(records, "conv_id")))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = mixing.sized_rows(docs)
    planned = mixing.plan(mixing.source_table(sized, "source"), max_repeats=2.0)
    return mixing.mix(sized.withColumnRenamed("_tokens", "tokens"), sized, planned)


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", (crc_of("doc_id", 5) == 0).alias("held_out"), "text")
    return quality.classify(rows, model).select("doc_id", "held_out", "score", "predicted")


def shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "source"), SHARDS)


def near_duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": language_id,
    "op2_token_counts": token_counts,
    "op3_chat_formatting": chat_formatting,
    "op4_source_mixing": source_mixing,
    "op5_benchmark_decontamination": benchmark_decontamination,
    "op6_exact_top_k": exact_top_k,
    "op7_url_filter": url_filter,
    "op8_quality_classifier": quality_classifier,
    "op9_sharding": shard_placement,
    "op10_simhash_near_dedup": near_duplicate_components,
    "op11_source_divergence": source_divergence,
    "op12_centroid_clusters": centroid_clusters,
    "op13_best_fit_packing": best_fit_packing,
}

_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '###', '\#\#\#'), '</turn>', '\</turn>')"
_TRICKY = TRICKY.replace("'", "''")

SQL = {
    "op3_chat_formatting": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{_TRICKY}'
), f AS (
  SELECT *, '### ' || replace({_ESCAPED.format('role')}, ':', '\\:') || ': ' || {_ESCAPED.format('text')} || '</turn>' || chr(10) AS piece FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""",
    "op6_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op7_url_filter": """
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), rules(verdict, h, s) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT page_id, max_by(rules.h || rules.s, length(rules.h || rules.s)) AS rule, max_by(verdict, length(rules.h || rules.s)) AS verdict
  FROM h JOIN rules ON (host = rules.h OR ends_with(host, '.' || rules.h)) AND starts_with(path, rules.s)
  GROUP BY page_id
)
SELECT h.page_id, host, path, rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (SELECT row, lang, source, unnest(words) AS term FROM d),
t AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY lang),
n AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN t USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT lang, source, term, coalesce(n.n, 0) AS n, 1 + (1000000000 * (coalesce(n.n, 0) + 5)) // (s.total + 5 * v.v) AS p,
    1 + (1000000000 * (t.n + 5)) // (v.total + 5 * v.v) AS q
  FROM s JOIN t USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)
), pair AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) x
    ON x.lang = g.lang AND x.source = g.source AND x.item = o.source
), r AS (
  SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 50
""",
    "op12_centroid_clusters": """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT 16)
), a0 AS (
  SELECT vec_id, v, cluster FROM (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, cluster) AS k FROM (
      SELECT row, vec_id, v.v AS v, cluster, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM v, c0 c)) WHERE k = 1
), m0 AS (
  SELECT cluster, list(x ORDER BY place) AS v FROM (
    SELECT cluster, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM (SELECT cluster, unnest(range(64)) AS place, unnest(v) AS x FROM a0) GROUP BY cluster, place) GROUP BY cluster
), c1 AS (
  SELECT cluster, coalesce(m0.v, c0.v) AS v FROM c0 LEFT JOIN m0 USING (cluster)
), a1 AS (
  SELECT vec_id, v, cluster FROM (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, cluster) AS k FROM (
      SELECT row, vec_id, v.v AS v, cluster, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM v, c1 c)) WHERE k = 1
), m1 AS (
  SELECT cluster, list(x ORDER BY place) AS v FROM (
    SELECT cluster, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM (SELECT cluster, unnest(range(64)) AS place, unnest(v) AS x FROM a1) GROUP BY cluster, place) GROUP BY cluster
), c2 AS (
  SELECT cluster, coalesce(m1.v, c1.v) AS v FROM c1 LEFT JOIN m1 USING (cluster)
), a2 AS (
  SELECT vec_id, v, cluster FROM (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, cluster) AS k FROM (
      SELECT row, vec_id, v.v AS v, cluster, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM v, c2 c)) WHERE k = 1
), m2 AS (
  SELECT cluster, list(x ORDER BY place) AS v FROM (
    SELECT cluster, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM (SELECT cluster, unnest(range(64)) AS place, unnest(v) AS x FROM a2) GROUP BY cluster, place) GROUP BY cluster
), c3 AS (
  SELECT cluster, coalesce(m2.v, c2.v) AS v FROM c2 LEFT JOIN m2 USING (cluster)
), a AS (
  SELECT vec_id, cluster, distance, v FROM (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, cluster) AS k FROM (
      SELECT row, vec_id, c.v AS v, cluster, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM v, c3 c)) WHERE k = 1
)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(v, ',')) AS centroid_sha256
FROM a
""",
}
