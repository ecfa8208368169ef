"""Queries on chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.operators import chunking as K
from casemesh.operators import semantic as E
from casemesh.plans.graph_queries import PRE, tables, thin
from casemesh.plans.registry import Registry
from casemesh.sources.tables import load

REGISTRY = Registry()
q = REGISTRY.query

_OK = "embedding IS NOT NULL AND len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0"
_Q = f"(SELECT arg_min(CAST(embedding AS DOUBLE[]), id) FROM k WHERE {_OK})"
_NEAR = f""", n AS (SELECT k.id, k.decision_id, k.target_id, k.target_authority_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) AS similarity FROM k WHERE {_OK}),
t AS (SELECT * FROM n ORDER BY round(similarity, 6) DESC, id LIMIT 50)
"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thin(spark, sf_dir, "chunks", "decision_id", "target_id", "target_authority_id", "embedding")


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    """One vector: the first chunk's that can be used."""
    ok = load(spark, sf_dir, "chunks").where("size(embedding) = 64 and exists(embedding, x -> x <> 0)")
    return list(ok.agg(F.min_by("embedding", "id")).first()[0])


@q("knn_topk", PRE + _NEAR + "SELECT id, decision_id, round(similarity, 4) AS similarity FROM t")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = E.nearest_chunks(_chunks(spark, sf_dir), _query(spark, sf_dir))
    return near.select("id", "decision_id", F.round("similarity", 4).alias("similarity"))


_BY = """, b AS (SELECT decision_id, max(similarity) AS score, count(*) AS n_chunks, (array_agg(id ORDER BY round(similarity, 6) DESC, id))[1] AS chunk_id,
string_agg(DISTINCT CASE WHEN target_id IS NOT NULL THEN 'decision:' || target_id ELSE 'authority:' || target_authority_id END, ',' ORDER BY CASE WHEN target_id IS NOT NULL THEN 'decision:' || target_id ELSE 'authority:' || target_authority_id END) AS targets
FROM t GROUP BY 1 ORDER BY round(max(similarity), 6) DESC, decision_id LIMIT 10)
"""


def _by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_decision(E.nearest_chunks(_chunks(spark, sf_dir), _query(spark, sf_dir)))


@q("knn_by_decision", PRE + _NEAR + _BY + "SELECT decision_id, round(score, 4) AS score, chunk_id, n_chunks, targets FROM b")
def knn_by_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by(spark, sf_dir).select("decision_id", F.round("score", 4).alias("score"), "chunk_id", "n_chunks", F.array_join("targets", ",").alias("targets"))


@q(
    "knn_targets",
    PRE + _NEAR + _BY + """, u AS (SELECT DISTINCT unnest(string_split(targets, ',')) AS target FROM b) SELECT target, display_title FROM u JOIN (SELECT 'decision:' || id AS target, display_title FROM d UNION ALL SELECT 'authority:' || id, coalesce(display, ref_key) FROM authorities) USING (target)""",
)
def knn_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _by(spark, sf_dir).select(F.explode("targets").alias("target")).distinct()
    d = thin(spark, sf_dir, "decisions", "display_title").select(F.concat(F.lit("decision:"), F.col("id").cast("string")).alias("target"), "display_title")
    a = load(spark, sf_dir, "authorities").select(F.concat(F.lit("authority:"), F.col("id").cast("string")).alias("target"), F.coalesce("display", "ref_key").alias("display_title"))
    return d.unionByName(a).join(F.broadcast(t), "target")  # at most the targets of fifty chunks


_NEAR_ALL = f""", v AS (SELECT id, decision_id, target_id, target_authority_id, CAST(embedding AS DOUBLE[]) AS e FROM k WHERE {_OK}),
n AS (SELECT a.id AS query_id, b.id, b.decision_id, b.target_id, b.target_authority_id, list_cosine_similarity(a.e, b.e) AS similarity FROM v a, v b WHERE a.id % 20 = 0),
t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 6) DESC, id) <= 50)
"""
_BY_ALL = """, g AS (SELECT query_id, decision_id, max(similarity) AS score, count(*) AS n_chunks, (array_agg(id ORDER BY round(similarity, 6) DESC, id))[1] AS chunk_id,
string_agg(DISTINCT CASE WHEN target_id IS NOT NULL THEN 'decision:' || target_id ELSE 'authority:' || target_authority_id END, ',' ORDER BY CASE WHEN target_id IS NOT NULL THEN 'decision:' || target_id ELSE 'authority:' || target_authority_id END) AS targets
FROM t GROUP BY 1, 2), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, decision_id) <= 10)
"""


def _near_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id divisible by 20 against all chunks, its own among them as in knn_topk."""
    k = _chunks(spark, sf_dir)
    near = E.nearest_of_queries(k, k.where("id % 20 = 0"))
    return near.join(k.drop("embedding"), "id")


@q("knn_topk_all", PRE + _NEAR_ALL + "SELECT query_id, id, decision_id, round(similarity, 4) AS similarity FROM t")
def knn_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_all(spark, sf_dir).select("query_id", "id", "decision_id", F.round("similarity", 4).alias("similarity"))


@q("knn_by_decision_all", PRE + _NEAR_ALL + _BY_ALL + "SELECT query_id, decision_id, round(score, 4) AS score, chunk_id, n_chunks, targets FROM b")
def knn_by_decision_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = E.by_decision_of_queries(_near_all(spark, sf_dir))
    return by.select("query_id", "decision_id", F.round("score", 4).alias("score"), "chunk_id", "n_chunks", F.array_join("targets", ",").alias("targets"))


@q(
    "knn_targets_all",
    PRE + _NEAR_ALL + _BY_ALL + """, u AS (SELECT DISTINCT query_id, unnest(string_split(targets, ',')) AS target FROM b) SELECT query_id, target, display_title FROM u JOIN (SELECT 'decision:' || id AS target, display_title FROM d UNION ALL SELECT 'authority:' || id, coalesce(display, ref_key) FROM authorities) USING (target)""",
)
def knn_targets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.by_decision_of_queries(_near_all(spark, sf_dir)).select("query_id", F.explode("targets").alias("target")).distinct()
    d = thin(spark, sf_dir, "decisions", "display_title").select(F.concat(F.lit("decision:"), F.col("id").cast("string")).alias("target"), "display_title")
    a = load(spark, sf_dir, "authorities").select(F.concat(F.lit("authority:"), F.col("id").cast("string")).alias("target"), F.coalesce("display", "ref_key").alias("display_title"))
    return d.unionByName(a).join(t, "target")


_UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END)"


@q("l2_normalize", f"SELECT vec_id, round(v[1], 4) AS first, round(v[64], 4) AS last FROM (SELECT vec_id, {_UNIT} AS v FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings))")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").select("vec_id", E.unit(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 4).alias("first"), F.round(F.col("v")[63], 4).alias("last"))


@q("truncate_dim", f"SELECT vec_id, len(v) AS size, round(v[1], 4) AS first FROM (SELECT vec_id, {_UNIT} AS v FROM (SELECT vec_id, embedding[1:16] AS embedding, sqrt(list_sum(list_transform(CAST(embedding[1:16] AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings))")
def truncate_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").select("vec_id", E.truncated(F.col("embedding"), 16).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("size"), F.round(F.col("v")[0], 4).alias("first"))


@q("embed_pending", PRE + "SELECT md5(chunk_text) AS text_hash, count(*) AS n_chunks, min(id) AS first_id FROM k WHERE embedding IS NULL AND chunk_text IS NOT NULL GROUP BY 1")
def embed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pending(thin(spark, sf_dir, "chunks", "chunk_text", "embedding"))


@q(
    "embed_writeback",
    PRE + "SELECT p.id, round(CAST(v.embedding[1] AS DOUBLE), 4) AS first FROM k p JOIN (SELECT md5(chunk_text) AS h, arg_min(embedding, id) AS embedding FROM k WHERE embedding IS NOT NULL GROUP BY 1) v ON md5(p.chunk_text) = v.h WHERE p.embedding IS NULL",
)
def embed_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that have no vector, from all that have one."""
    k = thin(spark, sf_dir, "chunks", "chunk_text", "embedding")
    return E.written_back(k, E.known_vectors(k)).select("id", F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))


@q("chunk_rollup", PRE + "SELECT decision_id, md5(chunk_text) AS text_hash, count(citation_id) AS n_citations, coalesce(array_to_string(list_sort(array_agg(DISTINCT target_id) FILTER (target_id IS NOT NULL)), ','), '') AS targets FROM k GROUP BY 1, 2")
def chunk_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.rollup(thin(spark, sf_dir, "chunks", "decision_id", "chunk_text", "citation_id", "target_id"))
    return out.withColumn("targets", F.array_join(F.transform("targets", lambda x: x.cast("string")), ","))


def _measures(spark: SparkSession, sf_dir: str, queries: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return E.label_measures(e, e.where(queries))


_SIM = "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label = b.label AS related, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)\n"


@q("embed_gap", _SIM + "SELECT query_id, round(avg(similarity) FILTER (related) - avg(similarity) FILTER (NOT related), 4) AS gap FROM s GROUP BY 1")
def embed_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id divisible by 20 against all rows."""
    return _measures(spark, sf_dir, "id % 20 = 0").select("query_id", F.round("gap", 4).alias("gap"))


@q("recall_at_5", _SIM + "SELECT query_id, round(CAST(count(*) FILTER (related AND rn <= 5) AS DOUBLE) / count(*) FILTER (related), 4) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 6) DESC, id) AS rn FROM s) GROUP BY 1")
def recall_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id divisible by 20 against all rows."""
    return _measures(spark, sf_dir, "id % 20 = 0").select("query_id", F.round("recall", 4).alias("recall"))


_RUNS = PRE + """, i AS (SELECT decision_id AS owner, id, start_offset AS a, end_offset AS b FROM k WHERE start_offset IS NOT NULL AND end_offset IS NOT NULL),
f AS (SELECT *, max(b) OVER (PARTITION BY owner ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
r AS (SELECT *, sum(CASE WHEN a >= before THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY a, b, id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT owner AS decision_id, id, CAST(run AS BIGINT) AS run, CAST(min(a) OVER (PARTITION BY owner, run) AS BIGINT) AS run_start, CAST(max(b) OVER (PARTITION BY owner, run) AS BIGINT) AS run_end FROM r"""


@q("merge_intervals", _RUNS)
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = thin(spark, sf_dir, "chunks", "decision_id", "start_offset", "end_offset").where("start_offset is not null and end_offset is not null")
    runs = K.merged_intervals(k.withColumnsRenamed({"start_offset": "start", "end_offset": "end"}), "decision_id")
    return runs.select("decision_id", "id", "run", "run_start", "run_end")


@q(
    "chunk_quality",
    PRE + """SELECT count(*) AS n_chunks, count(*) FILTER (start_offset <= match_start AND match_end <= end_offset) AS n_citation_inside, count(*) FILTER (contains(chunk_text, left(snippet, 80))) AS n_snippet_inside,
min(length(chunk_text)) AS min_chars, max(length(chunk_text)) AS max_chars, round(avg(length(chunk_text)), 4) AS avg_chars FROM k JOIN c ON k.citation_id = c.id""",
)
def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = tables(spark, sf_dir, "chunks", "citations")
    return K.chunk_quality(k, c)


@q("chunk_rows")
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = tables(spark, sf_dir, "decisions", "citations")
    return K.chunk_rows(d.select("id", "clean_text"), c.select("id", "source_id", "match_start", "match_end", "snippet"))


@q("chunk_bounds")
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = tables(spark, sf_dir, "decisions", "citations")
    return K.chunk_bounds(d.select("id", "clean_text"), c.select("id", "source_id", "match_start", "match_end", "snippet"))
