"""The corpus operators as queries over the tables of a folder, with SQL that checks them where there is any."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequent.llm import codes, idplanes, jaccard, lm, maintext, mixing, neardup, negatives, packing, pii, quality, topk, urlfilter
from sequent.llm.tokens import word_vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as byte planes and read back."""
    return idplanes.id_planes(table(spark, sf_dir, "documents"), word_vocabulary())


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and links of all documents: five words, a similarity of 0.8."""
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), word_vocabulary())


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digest(table(spark, sf_dir, "documents"))


#: (verdict, rule)
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{v}', '{r}')" for v, r in URL_RULES) + " AS t(verdict, rule)")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "metadata_score", "quality_score", "accepted")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9."""
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every twentieth embedding among all."""
    codes = topk.codes_of(table(spark, sf_dir, "embeddings"))
    return topk.top_k(codes, codes.where(F.col("id") % 20 == 0))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and interpolated bigram scores of all documents."""
    return lm.scores(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings: 8 parts, 16 entries, 6 rounds."""
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding among all, a seventh of the labels moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(rows, rows.where(F.col("vec_id") % 50 == 0))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages, and how many of its lines the page with the nearest URL shows too."""
    return maintext.main_text(table(spark, sf_dir, "pages"), shared=True)


def queries() -> dict:
    return {
        "op1_id_planes": op1_id_planes,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_source_mix": op4_source_mix,
        "op5_pii": op5_pii,
        "op6_url_rules": op6_url_rules,
        "op7_quality": op7_quality,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_exact_top_k": op9_exact_top_k,
        "op10_lm_scores": op10_lm_scores,
        "op11_vector_codes": op11_vector_codes,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_main_text": op13_main_text,
        "pipeline": corpus_pipeline.run,
    }


ORACLE: dict[str, str] = {}

ORACLE["op8_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

ORACLE["op9_exact_top_k"] = """
WITH c AS (
  SELECT vec_id AS id, list_transform(embedding[1:64], lambda x: x > 0) AS bits FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.id AS query_id, o.id AS neighbor_id,
    CAST(len(list_filter(list_zip(q.bits, o.bits), lambda z: z[1] <> z[2])) AS INTEGER) AS distance
  FROM c q JOIN c o ON q.id <> o.id WHERE q.id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""

ORACLE["op4_source_mix"] = """
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
num AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number,
    CAST(coalesce(sum(source_size) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM src),
w AS (SELECT *, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS full_size FROM num),
f AS (
  SELECT *, row_number() OVER o AS fill,
    (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(full_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY CAST(full_size AS DOUBLE) / weight, number)),
g AS (SELECT *, full_size <= level * weight AS stopped FROM f),
t AS (
  SELECT g.*, CASE WHEN stopped THEN CAST(full_size AS DOUBLE)
    ELSE weight * (SELECT x.level FROM g x WHERE NOT x.stopped ORDER BY x.fill LIMIT 1) END AS target FROM g),
b AS (SELECT *, CAST(ceil(source_size / 64.0) AS BIGINT) AS blocks FROM t),
h AS (SELECT *, CAST(floor(sum(target) OVER () / 64 + 0.5) AS BIGINT) AS seats FROM b),
q AS (
  SELECT h.number, count(k.k) AS quota FROM h LEFT JOIN (
    SELECT number, k, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, number) AS r
    FROM (SELECT number, target, unnest(range(1, 2 * blocks + 1)) AS k FROM h WHERE target > 0)) k
  ON k.number = h.number AND k.r <= h.seats GROUP BY h.number),
sh AS (
  SELECT h.number, j.shard, q.quota, least(16384, h.blocks - j.shard * 16384) AS own
  FROM h JOIN q USING (number), (SELECT unnest(range(0, (SELECT max(blocks) FROM h) // 16384 + 1)) AS shard) j WHERE j.shard * 16384 < h.blocks),
sq AS (
  SELECT sh.number, sh.shard, any_value(sh.own) AS own, count(k.k) AS quota FROM sh LEFT JOIN (
    SELECT number, shard, row_number() OVER (PARTITION BY number ORDER BY CAST(own AS DOUBLE) / (2 * k - 1) DESC, shard) AS r, k
    FROM (SELECT number, shard, own, unnest(range(1, 2 * own + 1)) AS k FROM sh)) k
  ON k.number = sh.number AND k.shard = sh.shard AND k.r <= sh.quota GROUP BY sh.number, sh.shard),
runs AS (
  SELECT number, shard, own, quota // own AS times, quota % own AS extra,
    CAST('0x' || substr(md5('0:' || number || ':' || shard), 1, 8) AS BIGINT) % own AS first FROM sq),
p AS (
  SELECT s.doc_id, s.size, h.source_size, h.target, h.number,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY h.number ORDER BY s.ord, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
    row_number() OVER () AS row FROM s JOIN h ON s.source IS NOT DISTINCT FROM h.source),
x AS (
  SELECT p.row, times, greatest(p.start, shard * 1048576) AS lo, least(p.start + p.size, (shard + 1) * 1048576) AS hi,
    shard * 1048576 + first * 64 AS a1, shard * 1048576 + least(own, first + extra) * 64 AS b1,
    shard * 1048576 AS a2, shard * 1048576 + greatest(0, first + extra - own) * 64 AS b2
  FROM p JOIN runs USING (number) WHERE p.start < (shard + 1) * 1048576 AND p.start + p.size > shard * 1048576),
y AS (
  SELECT row, CAST(sum(times * (hi - lo) + greatest(0, least(hi, b1) - greatest(lo, a1)) + greatest(0, least(hi, b2) - greatest(lo, a2))) AS BIGINT) AS taken FROM x GROUP BY row)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(y.taken, 0) AS taken FROM p LEFT JOIN y USING (row)
"""


ORACLE["op6_url_rules"] = """
WITH r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '(?s)^([^/?#]*)', 1) AS raw FROM u),
x AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '(?s)^([^?#]*)', 1) AS path, row_number() OVER () AS row FROM h),
m AS (
  SELECT x.row, max({'n': length(r.h), 'k': length(r.p), 'rule': r.h || r.p, 'verdict': r.verdict}) AS best
  FROM x JOIN r ON (x.host = r.h OR ends_with(x.host, '.' || r.h)) AND starts_with(x.path, r.p) GROUP BY x.row)
SELECT x.page_id, x.host, x.path, m.best.rule AS rule, coalesce(m.best.verdict, 'allow') AS verdict FROM x LEFT JOIN m USING (row)
"""


#: Rows whose vector has no null and no non-finite component.
FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

#: Rounds of Lloyd over components in long form: a_k has the entry of each part, c_k each codebook's components.
ORACLE["op11_vector_codes"] = f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, label, embedding, len(embedding) // 8 AS w FROM embeddings WHERE {FINITE}),
x AS MATERIALIZED (
  SELECT row, i // w AS p, i % w AS i, CAST(floor(4096 * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT row, embedding, w, unnest(range(0, 8 * w)) AS i FROM v)),
seed AS (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS e FROM v QUALIFY e < 16),
c0 AS MATERIALIZED (SELECT p, e, i, x AS c FROM x JOIN seed USING (row)),
""" + ",\n".join(f"""d{k} AS (SELECT row, p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{k} USING (p, i) GROUP BY row, p, e),
a{k} AS MATERIALIZED (SELECT row, p, e, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY row, p ORDER BY d, e) = 1)""" + (f""",
m{k} AS (SELECT p, e, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM x JOIN a{k} USING (row, p) GROUP BY p, e, i),
c{k + 1} AS MATERIALIZED (SELECT p, e, i, coalesce(m, c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e, i))""" if k < 6 else "") for k in range(7)) + """,
f AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY row),
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN f USING (row), h
"""

ORACLE["op12_hard_negatives"] = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND {FINITE}),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike AND other <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
  s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
