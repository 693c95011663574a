"""Queries that apply the corpus operators to their whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanlens.llm.common import fresh_dir, table

#: Fixed value: the rules that judge ``pages``.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbanlens.llm.url_filters import url_filter

    return url_filter(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbanlens.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbanlens.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbanlens.llm.line_dedup import line_digests

    return line_digests(table(spark, sf_dir, "documents"), least=10)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the corpus as token files in the shared folder and returns what reading them back gives."""
    from urbanlens.llm.token_files import read_token_files, write_token_files

    path = fresh_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path, digests=True)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbanlens.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbanlens.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbanlens.llm.mixing import copies

    return copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbanlens.llm.fingerprints import edited_neighbours

    return edited_neighbours(table(spark, sf_dir, "documents"))


def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hashlib import sha256

    from urbanlens.llm.word_bpe import word_bpe

    return word_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), {
        "n_tokens": ("long", lambda ids, _: len(ids) // 4),
        "ids_sha256": ("string", lambda ids, _: sha256(ids).hexdigest()),
        "decoded_sha256": ("string", lambda _, text: sha256(text.encode()).hexdigest()),
    })


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbanlens.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbanlens.llm.centroids import clusters_of

    return clusters_of(table(spark, sf_dir, "embeddings"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from urbanlens.llm.set_join import joined_documents

    return joined_documents(table(spark, sf_dir, "documents"), words=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filters, op2_token_counts, op3_toxicity, op4_line_dedup, op5_token_files, op6_neighbours, op7_near_dedup, op8_source_mixing, op9_fingerprints, op10_word_bpe, op11_filter_audit, op12_centroid_clusters, op13_ngram_join)}

_PARTS = r"""
parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _links_sql(words: int, percent: int) -> str:
    """Sets of shingles, links by shared ones, and the smallest id that links reach."""
    shingle = f"array_to_string(w[i:least(i + {words - 1}, len(w))], ' ')"
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {words - 2}, 2)), lambda i: {shingle})) END AS s FROM words),
rows_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM rows_ a JOIN rows_ b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= {percent} * (n + m - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON r.other = e.a),
named AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(other) FROM reached r WHERE r.doc_id = sets.doc_id), doc_id)) AS component_id FROM sets)
SELECT doc_id, n_shingles, component_id"""


def _clusters_sql(rounds: int = 3) -> str:
    """Rounds of assignment and exact floored means over unnested components; ids name rows."""
    steps = [r"""
whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, v AS c FROM whole QUALIFY cluster < 16)"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS (SELECT vec_id, any_value(v) AS v, min({{'distance': d, 'cluster': cluster}}) AS near FROM
  (SELECT vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM whole CROSS JOIN c{n}) GROUP BY vec_id)""")
        if n < rounds:
            steps.append(f"""
s{n} AS (SELECT cluster, i, CAST(floor_of AS BIGINT) AS x FROM (SELECT near.cluster AS cluster, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_of
  FROM a{n}, range(1, 65) AS r(i) GROUP BY 1, 2)),
c{n + 1} AS (SELECT c{n}.cluster, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS c FROM s{n} GROUP BY cluster) m ON c{n}.cluster = m.cluster)""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, CAST(near.cluster AS INTEGER) AS cluster, near.distance AS distance,
  CAST(sum(near.distance) OVER (PARTITION BY near.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(near.distance) OVER () AS BIGINT) AS inertia,
  sha256(list_aggregate(list_transform(c, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON near.cluster = c{rounds}.cluster"""


SQL = {
    "op4_line_dedup": rf"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM texts),
keyed AS (SELECT *, {_LOWER.format("regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS k FROM lines),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
judged AS (SELECT doc_id, line, p, k IN (SELECT k FROM common) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op7_near_dedup": _links_sql(3, 85) + ", doc_id = component_id AS kept FROM named",
    "op13_ngram_join": _links_sql(4, 85) + " FROM named",
    "op12_centroid_clusters": _clusters_sql(),
    "op11_filter_audit": r"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failing AS (SELECT doc_id, part,
  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
   doc_id > min(doc_id) OVER (PARTITION BY t)] AS f FROM words),
docs AS (SELECT part, f, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM failing LEFT JOIN labels USING (doc_id) GROUP BY doc_id, part, f),
orders(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || c FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS l(c) WHERE NOT contains(filter_order, c)),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, ascii(substr(filter_order, s, 1)) - 64 AS own, list_transform(range(1, s), lambda i: ascii(substr(filter_order, i, 1)) - 64) AS earlier
  FROM orders, range(1, 6) AS r(s) WHERE length(filter_order) = 5),
groups AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM docs GROUP BY part, f),
judged AS (SELECT part, filter_order, step, own, n, good, bad, f[own] AS fails, len(list_filter(f, lambda x: x)) = 1 AS alone, len(list_filter(earlier, lambda i: f[i])) > 0 AS gone FROM groups, steps),
found AS (SELECT part, filter_order, step, own,
  CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails AND alone), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM found""",
    "op1_url_filters": rf"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),{_PARTS},
fits AS (SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
  row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS place
  FROM split LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1""",
    "op8_source_mixing": r"""
WITH RECURSIVE sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source),
-- shares grow while sources reach their bound; a round's least ratio of share to weight decides who stands at it
rounds(n, ratio) AS (
  SELECT 0, 1.5 * (SELECT sum(source_size) FROM sources) / (SELECT sum(weight) FROM sources)::DOUBLE
  UNION ALL
  SELECT n + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(2 * source_size) FILTER (weight * ratio > 2 * source_size), 0)) / greatest(sum(weight) FILTER (weight * ratio <= 2 * source_size), 1)::DOUBLE FROM sources)
  FROM rounds WHERE n < 60),
final AS (SELECT max(ratio) AS ratio FROM rounds),
targets AS (SELECT source, source_size, CASE WHEN weight * ratio > 2 * source_size THEN 2.0::DOUBLE * source_size ELSE
  (SELECT 1.5 * sum(s.source_size) - coalesce(sum(2 * s.source_size) FILTER (s.weight * ratio > 2 * s.source_size), 0) FROM sources s)::DOUBLE * weight
  / (SELECT greatest(sum(s.weight) FILTER (s.weight * ratio <= 2 * s.source_size), 1) FROM sources s)::DOUBLE END AS target FROM sources, final),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM rated""",
}
