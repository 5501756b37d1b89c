"""Thin queries over the test tables, one for each operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, embed, langid, mpeg, packing, resample, secrets, simhash, suffix, topk, urls, warc

#: The tokenizer's vocabulary file, by its name in the public_tokenizers package.
VOCABULARY = "byte_bpe_50k.json"

#: (verdict, host, path) of the URL rules.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents"), digest=True)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE whole AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM whole a JOIN whole b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id
), roots AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, r.component_id, r.component_id = e.vec_id AS kept
FROM embeddings e JOIN roots r USING (vec_id) LEFT JOIN counts c USING (vec_id)
"""


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    dictionaries = langid.fit(docs.where(~F.coalesce(held_out, F.lit(False))))
    return langid.predict(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), dictionaries, keep=("held_out",))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP9_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), hosts AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM hosts JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM hosts h LEFT JOIN fits f ON h.page_id = f.page_id AND f.k = 1
"""


def op10_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.digests(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op11_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds as one common table expression each; r tells rows apart, and distance * k + cluster orders by both."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c0 AS MATERIALIZED (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept) WHERE c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * {k} + c.c) AS m FROM kept x CROSS JOIN c{i} c GROUP BY r
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(moved.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY dim) AS v FROM (
      SELECT m % {k} AS c, dim, sum(x) AS s, count(*) AS n
      FROM (SELECT m, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM a{i} JOIN kept USING (r)) GROUP BY 1, 2
    ) GROUP BY c
  ) moved ON moved.c = c{i}.c
)""")
    return f"""WITH {", ".join(parts)}, told AS (SELECT r, CAST(m % {k} AS INTEGER) AS cluster, CAST(m // {k} AS BIGINT) AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM told JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.c = cluster"""


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS score
  FROM whole q JOIN whole c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST) AS k, vec_id, score FROM scores
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE k <= 10
"""


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS MATERIALIZED (
  SELECT r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM docs
), aims AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), each AS MATERIALIZED (
  SELECT word, hex(encode(word)) AS digits FROM (SELECT word FROM words UNION SELECT word FROM aims)
), hashed AS MATERIALIZED (
  -- the CRC's register takes a byte, then eight shifts by its polynomial
  SELECT word, xor(4294967295, list_reduce(
    list_transform(range(1, len(digits), 2), lambda i: CAST('0x' || substr(digits, i, 2) AS BIGINT)),
    lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)),
    4294967295)) % 10000 AS bucket FROM each
), raw AS (SELECT bucket, count(*) AS s FROM words JOIN hashed USING (word) GROUP BY 1),
target AS (SELECT bucket, count(*) AS t FROM aims JOIN hashed USING (word) GROUP BY 1),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM raw) AS s_all, (SELECT coalesce(sum(t), 0) FROM target) AS t_all),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM raw LEFT JOIN target USING (bucket) CROSS JOIN totals
), weights AS (
  SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS g FROM words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY 1
), scored AS (
  SELECT r, doc_id, coalesce(n_features, 0) AS n_features,
         coalesce((g - (g % n_features + n_features) % n_features) // n_features, 0) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM docs LEFT JOIN weights USING (r)
), placed AS (
  SELECT *, weight + noise AS score, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id, n_features) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_suffix, op3_packing, op4_embeddings, op5_langid, op6_warc, op7_simhash, op8_secrets, op9_urls, op10_mpeg, op11_centroids, op12_topk, op13_resample)}


def oracle_sql() -> dict[str, str]:
    return {"op4_embeddings": OP4_SQL, "op9_urls": OP9_SQL, "op11_centroids": op11_sql(), "op12_topk": OP12_SQL, "op13_resample": OP13_SQL}
