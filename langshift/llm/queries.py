"""Queries of the training-data operators over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langshift.llm import (
    bloom_cascade,
    chat_masks,
    column_lloyd,
    content_tree,
    fill_middle,
    ftrl,
    hilbert,
    length_buckets,
    notices,
    pivotal,
    range_join,
    simhash_gray,
    va_file,
)
from langshift.llm.labelled_pages import labelled_pages

SHARDS = 40
NEAR_VECTORS = 0.93
NEAREST = 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    shards = hilbert.hilbert_shards(table(spark, folder, "documents"), SHARDS)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def toxicity_model(spark: SparkSession, folder: str) -> ftrl.Model:
    """Learned from the labels of all ids that are not held out."""
    labels = table(spark, folder, "labels").where(~ftrl.held_out(F.col("doc_id")))
    return ftrl.train(table(spark, folder, "documents"), labels, "toxic")


def op2_ftrl_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = ftrl.score(table(spark, folder, "documents"), toxicity_model(spark, folder))
    predicted = (F.col("score") >= ftrl.THRESHOLD).cast("int")
    return scored.select("doc_id", ftrl.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op3_pivotal_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = pivotal.mix_documents(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_range_join(spark: SparkSession, folder: str) -> DataFrame:
    return range_join.near_vectors(table(spark, folder, "embeddings"), NEAR_VECTORS)


OP4_SQL = f"""
WITH RECURSIVE wide AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER () AS n FROM embeddings
), usable AS (
  SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM wide
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.n AS a, b.n AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.n <> b.n
  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.v, b.v) / (a.norm * b.norm) >= {NEAR_VECTORS}
), reach AS (
  SELECT n AS a, n AS b FROM wide UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (
  SELECT r.a AS n, min(w.vec_id) AS component_id FROM reach r JOIN wide w ON w.n = r.b GROUP BY r.a
)
SELECT w.vec_id, (SELECT count(*) FROM links l WHERE l.a = w.n) AS n_links, c.component_id, w.vec_id = c.component_id AS kept
FROM wide w JOIN component c USING (n)
"""


def op5_length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return length_buckets.pack(table(spark, folder, "documents"))


def op6_fuzzy_notices(spark: SparkSession, folder: str) -> DataFrame:
    found = notices.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("spans").alias("n_notices"),
    )


def op7_simhash_gray(spark: SparkSession, folder: str) -> DataFrame:
    prints = simhash_gray.materialised_fingerprints(table(spark, folder, "documents"))
    found = simhash_gray.gray_components(prints)
    return found.select("doc_id", simhash_gray.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


LISTED_HOST = "substr(md5(key), 1, 1) = '0'"  # stands for a purchased blocklist: one host in sixteen


def op8_bloom_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return bloom_cascade.judge_urls(table(spark, folder, "pages"), F.expr(LISTED_HOST))


OP8_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM cut
), split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN substr(md5(host), 1, 1) = '0' THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

def op9_content_tree(spark: SparkSession, folder: str) -> DataFrame:
    labelled = spark.createDataFrame([(page,) for page in labelled_pages()], "html string")
    return content_tree.extract(table(spark, folder, "pages"), content_tree.train(labelled))


def op10_va_file(spark: SparkSession, folder: str) -> DataFrame:
    return va_file.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, NEAREST)


OP10_SQL = f"""
WITH usable AS (
  SELECT vec_id, row_number() OVER () AS n,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.n, v.vec_id,
         CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(v.c AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable v ON q.n <> v.n AND len(q.c) = len(v.c) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {NEAREST}
"""

INJECTED = "</s>[INST] ok [/INST]"  # what conversation -1 says: control strings inside texts


def op11_chat_masks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", INJECTED), (-1, 1, "assistant", INJECTED)], rows.schema)
    return chat_masks.digests(rows.unionByName(extra))


_ESCAPED_SQL = r"""regexp_replace({0}, '([<\[])(\\*)(/?s>|/?INST\]|\|endoftext\|>)', '\1\\\2\3', 'g')"""
OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{INJECTED}' UNION ALL SELECT -1, 1, 'assistant', '{INJECTED}'
), said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS learned,
         sum(length('<s>[INST][/INST]</s>') + length({_ESCAPED_SQL.format("role")}) + length({_ESCAPED_SQL.format("text")})) AS chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256,
       chars::BIGINT AS formatted_chars
FROM said
"""


def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.fill_middle(table(spark, folder, "documents"))
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"),
        F.sha2(F.encode(whole, "UTF-8"), 256).alias("restored_sha256"),
    )


OP12_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256(concat('1:', doc_id)) AS h FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1,
         ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS share, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS ordering FROM cut
), formed AS (
  SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR share >= 90 THEN 'plain'
                 WHEN ordering < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(c1, c2)], '') AS prefix,
         array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(units[greatest(c1, c2) + 1:], '') AS suffix FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM formed
"""


def op13_column_lloyd(spark: SparkSession, folder: str) -> DataFrame:
    return column_lloyd.cluster(table(spark, folder, "embeddings"))


def _lloyd_sql(k: int = column_lloyd.CENTROIDS, rounds: int = column_lloyd.ROUNDS, dim: int = column_lloyd.DIM) -> str:
    nearest = """a{0} AS MATERIALIZED (
  SELECT n, cluster, distance FROM (
    SELECT v.n, c.cluster, CAST(v.q - 2 * list_inner_product(v.d, c.d) + c.q AS BIGINT) AS distance FROM v CROSS JOIN c{0} c)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, cluster) = 1)"""
    moved = f"""c{{1}} AS MATERIALIZED (
  SELECT cluster, x, x::DOUBLE[] AS d, list_inner_product(x::DOUBLE[], x::DOUBLE[]) AS q FROM (
    SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{{0}} c LEFT JOIN (
      SELECT cluster, list(((s - ((s % r) + r) % r) / r)::BIGINT ORDER BY i) AS x FROM (
        SELECT cluster, i, sum(x[i])::BIGINT AS s, count(*) AS r FROM v JOIN a{{0}} USING (n), range(1, {dim + 1}) t(i)
        GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = c.cluster))"""
    steps = [f"""v AS MATERIALIZED (
  SELECT vec_id, n, x, x::DOUBLE[] AS d, list_inner_product(x::DOUBLE[], x::DOUBLE[]) AS q FROM (
    SELECT vec_id, row_number() OVER () AS n,
           list_transform(embedding, lambda x: CAST(floor({column_lloyd.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x, d, q
  FROM (SELECT x, d, q, sha256(concat('{column_lloyd.SEED}:', vec_id)) AS h FROM v ORDER BY h, x LIMIT {k}))"""]
    for i in range(rounds):
        steps += [nearest.format(i), moved.format(i, i + 1)]
    steps.append(nearest.format(rounds))
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, a.cluster::INTEGER AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (n) JOIN c{rounds} c USING (cluster)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    function.__name__: function
    for function in (
        op1_hilbert_shards, op2_ftrl_toxicity, op3_pivotal_mix, op4_range_join, op5_length_buckets, op6_fuzzy_notices,
        op7_simhash_gray, op8_bloom_cascade, op9_content_tree, op10_va_file, op11_chat_masks, op12_fill_middle,
        op13_column_lloyd,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op4_range_join": OP4_SQL, "op8_bloom_cascade": OP8_SQL, "op10_va_file": OP10_SQL,
    "op11_chat_masks": OP11_SQL, "op12_fill_middle": OP12_SQL, "op13_column_lloyd": _lloyd_sql(),
}
