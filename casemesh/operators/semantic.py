"""Vectors of chunks: exact search for one query, sharing of vectors, and measures of an embedding."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP, BEST = 50, 5
#: Queries that are compared at once with a batch of rows.
QUERY_BLOCK = 128


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector with length one; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def truncated(v: Column, size: int) -> Column:
    """Its first numbers, with length one."""
    return unit(F.slice(v, 1, size))


def cosines(queries: np.ndarray):
    """A column function: the cosines of a vector with each of few query vectors; null for unusable vectors. Arrow batches in and out."""
    q = np.asarray(queries, dtype=np.float64).reshape(-1, np.shape(queries)[-1])
    q = q / np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None]

    def f(v: pa.Array) -> pa.Array:
        x, ok = _usable(v, q.shape[1])
        offsets = np.concatenate([[0], np.cumsum(np.where(ok, len(q), 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((x[ok] @ q.T).ravel()), mask=pa.array(~ok))

    f.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(f, "array<double>")


def nearest_chunks(chunks: DataFrame, query: list[float], top: int = TOP) -> DataFrame:
    """The chunks most similar to a vector, with similarity; ties, to six digits, by id."""
    s = chunks.withColumn("similarity", F.element_at(cosines(np.asarray([query]))(F.col("embedding")), 1)).where("similarity is not null")
    return s.orderBy(F.desc(F.round("similarity", 6)), "id").limit(top)


def nearest_of_queries(chunks: DataFrame, queries: DataFrame, top: int = TOP, dim: int = 64) -> DataFrame:
    """(query_id, id, similarity): what nearest_chunks finds, for every query (id, embedding) that can be used.

    The queries lie in memory as arrays, of any number, and are compared in blocks; a task keeps its first rows by query.
    """
    t = queries.where("id is not null").select(F.col("id").cast("long").alias("id"), "embedding").dropDuplicates(["id"]).toArrow().combine_chunks()
    one = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns]
    q, q_ok = _usable(one[1], dim)
    q_id, q = one[0].to_numpy(zero_copy_only=False)[q_ok], q[q_ok]

    def parts(batches):
        none = (np.empty(0), np.empty(0), np.empty(0, dtype=np.int64))
        kept = [none] * len(q_id)
        for batch in batches:
            x, ok = _usable(batch.column(1), dim)
            ids, x = batch.column(0).to_numpy(zero_copy_only=False)[ok], x[ok]
            for s in range(0, len(q_id) if len(ids) else 0, QUERY_BLOCK):
                sims = q[s : s + QUERY_BLOCK] @ x.T
                fars = -np.round(sims, 6)
                last = np.partition(fars, top - 1, axis=1)[:, top - 1] if top < len(ids) else np.full(len(fars), np.inf)
                for i, (sim, far) in enumerate(zip(sims, fars, strict=True)):
                    before = kept[s + i]
                    at = np.flatnonzero(far <= (min(last[i], before[0][-1]) if len(before[0]) == top else last[i]))
                    all_of = [np.concatenate(c) for c in zip(before, (far[at], sim[at], ids[at]), strict=True)]
                    order = np.lexsort((all_of[2], all_of[0]))[:top]
                    kept[s + i] = tuple(c[order] for c in all_of)
        for s in range(0, len(q_id), QUERY_BLOCK):
            block = kept[s : s + QUERY_BLOCK]
            names = np.repeat(q_id[s : s + QUERY_BLOCK], [len(b[0]) for b in block])
            yield pa.RecordBatch.from_pydict({"query_id": names, "id": np.concatenate([b[2] for b in block]), "similarity": np.concatenate([b[1] for b in block])})

    rows = chunks.where("id is not null and embedding is not null").select(F.col("id").cast("long").alias("id"), "embedding")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 6)), "id")
    found = rows.mapInArrow(parts, "query_id long, id long, similarity double")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).drop("k")


def by_decision(near: DataFrame, best: int = 10) -> DataFrame:
    """(decision_id, score, chunk_id, n_chunks, targets) of the rulings with the best chunks.

    targets: what their chunks cite, rulings as 'decision:', authorities as 'authority:', in order.
    """
    return _decisions(near).orderBy(F.desc(F.round("score", 6)), "decision_id").limit(best)


def by_decision_of_queries(near: DataFrame, best: int = 10) -> DataFrame:
    """The same for each query_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "decision_id")
    return _decisions(near, "query_id").withColumn("k", F.row_number().over(order)).where(F.col("k") <= best).drop("k")


def _decisions(near: DataFrame, *by: str) -> DataFrame:
    target = F.when(F.col("target_id").isNotNull(), F.concat(F.lit("decision:"), F.col("target_id").cast("string"))).when(
        F.col("target_authority_id").isNotNull(), F.concat(F.lit("authority:"), F.col("target_authority_id").cast("string"))
    )
    order = F.struct(F.round("similarity", 6).alias("s"), (-F.col("id")).alias("i"))
    return (
        near.withColumn("target", target)
        .groupBy(*by, "decision_id")
        .agg(F.max("similarity").alias("score"), F.max_by("id", order).alias("chunk_id"), F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_set("target")).alias("targets"))
    )


def pending(chunks: DataFrame) -> DataFrame:
    """(text_hash, n_chunks, first_id) of the distinct texts that have no vector yet."""
    return chunks.where("embedding is null and chunk_text is not null").groupBy(F.md5("chunk_text").alias("text_hash")).agg(F.count(F.lit(1)).alias("n_chunks"), F.min("id").alias("first_id"))


def written_back(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, embedding) of the chunks without vector whose text (text_hash, embedding) now has one."""
    return chunks.where("embedding is null").select("id", F.md5("chunk_text").alias("text_hash")).join(vectors, "text_hash").select("id", "embedding")


def known_vectors(chunks: DataFrame) -> DataFrame:
    """(text_hash, embedding) of the texts that have a vector, of several the one with the smallest id."""
    return chunks.where("embedding is not null").groupBy(F.md5("chunk_text").alias("text_hash")).agg(F.min_by("embedding", "id").alias("embedding"))


def embedded(texts: DataFrame, embed, batch: int = 64) -> DataFrame:
    """(text_hash, embedding) of (text_hash, text) by a function from a list of texts to vectors, with length one."""

    def rows(parts):
        for pdf in parts:
            vectors = [v for s in range(0, len(pdf), batch) for v in embed(pdf["text"].iloc[s : s + batch].tolist())]
            x = np.asarray(vectors, dtype=np.float64).reshape(len(pdf), -1)
            n = np.linalg.norm(x, axis=1)
            yield pd.DataFrame({"text_hash": pdf["text_hash"], "embedding": list(x / np.where(n == 0, 1, n)[:, None])})

    return texts.select("text_hash", "text").mapInPandas(rows, "text_hash string, embedding array<double>")


def embed_missing(chunks: DataFrame, embed, path: str, model: str, batch: int = 64) -> DataFrame:
    """Vectors (text_hash, embedding) of all texts by a model, those that are missing under path made and added.

    A run that was broken off goes on where it ended: what has been written isn't made again. Files are by model.
    """
    spark = chunks.sparkSession
    at = f"{path}/model={model}"
    texts = chunks.where("chunk_text is not null").select(F.md5("chunk_text").alias("text_hash"), F.col("chunk_text").alias("text")).dropDuplicates(["text_hash"])
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        texts = texts.join(spark.read.schema("text_hash string, embedding array<double>").parquet(at).select("text_hash"), "text_hash", "left_anti")
    embedded(texts, embed, batch).sortWithinPartitions("text_hash").write.mode("append").parquet(at)
    return spark.read.schema("text_hash string, embedding array<double>").parquet(at)


def pending_after(chunks: DataFrame, last_hash: str | None, number: int) -> DataFrame:
    """The next texts without vector in the order of their hashes, after the last one that was done: (text_hash, n_chunks, first_id)."""
    p = pending(chunks)
    return (p if last_hash is None else p.where(F.col("text_hash") > last_hash)).orderBy("text_hash").limit(number)


def rollup(chunks: DataFrame) -> DataFrame:
    """(decision_id, text_hash, n_citations, targets): chunks that share a text as one, with the rulings that they cite."""
    return chunks.groupBy("decision_id", F.md5("chunk_text").alias("text_hash")).agg(
        F.count("citation_id").alias("n_citations"), F.array_sort(F.collect_set("target_id")).alias("targets")
    )


def _usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which of them come from a vector of dim numbers that isn't zero."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False).astype(bool)
    x = np.zeros((len(column), dim))
    x[ok] = np.asarray(column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    n = np.linalg.norm(x, axis=1)
    ok &= np.isfinite(n) & (n > 0)
    return np.where(ok[:, None], x, 0) / np.where(ok, n, 1)[:, None], ok


def _labels(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def label_measures(vectors: DataFrame, queries: DataFrame, dim: int = 64, k: int = BEST) -> DataFrame:
    """(query_id, gap, recall) of queries against all rows but themselves, both (id, label, embedding).

    gap: mean cosine of the rows with the query's label minus that of the others. recall: rows with its label among the first k
    (ties, to six digits, by id), of all such rows. The queries lie in memory as arrays, of any number, and are compared in blocks;
    a task keeps sums and its first k rows by query.
    """
    t = queries.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding").dropDuplicates(["id"]).toArrow().combine_chunks()
    one = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns]
    q_id = one[0].to_numpy(zero_copy_only=False)
    (q_label, q_known), (q, q_ok) = _labels(one[1]), _usable(one[2], dim)

    def parts(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            (label, known), (x, ok) = _labels(batch.column(1)), _usable(batch.column(2), dim)
            for s in range(0, len(q_id) if len(ids) else 0, QUERY_BLOCK):
                b = slice(s, s + QUERY_BLOCK)
                sim = q[b] @ x.T
                other = q_id[b][:, None] != ids
                same = q_label[b][:, None] == label
                judged = other & q_known[b][:, None] & known
                use = other & q_ok[b][:, None] & ok
                far = np.where(use, -np.round(sim, 6), np.inf)
                last = np.partition(far, k - 1, axis=1)[:, k - 1] if k < len(ids) else np.full(len(far), np.inf)
                top = []
                for i in range(len(far)):
                    at = np.flatnonzero(use[i] & (far[i] <= last[i]))
                    at = at[np.lexsort((ids[at], far[i, at]))[:k]]
                    top.append([{"far": float(far[i, j]), "id": int(ids[j]), "related": bool(judged[i, j] and same[i, j])} for j in at])
                near, rest = judged & same, judged & ~same
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": q_id[b],
                        "related": near.sum(1),
                        "n_near": (near & use).sum(1),
                        "near": np.where(near & use, sim, 0).sum(1),
                        "n_rest": (rest & use).sum(1),
                        "rest": np.where(rest & use, sim, 0).sum(1),
                        "top": pa.array(top, pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64()), ("related", pa.bool_())]))),
                    }
                )

    kind = "query_id long, related long, n_near long, near double, n_rest long, rest double, top array<struct<far:double,id:long,related:boolean>>"
    rows = vectors.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding")
    sums = [F.sum(c).alias(c) for c in ("related", "n_near", "near", "n_rest", "rest")]
    of = rows.mapInArrow(parts, kind).groupBy("query_id").agg(*sums, F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    hits = F.size(F.filter("top", lambda r: r["related"]))
    return of.select(
        "query_id", (F.try_divide("near", "n_near") - F.try_divide("rest", "n_rest")).alias("gap"), F.try_divide(hits, F.col("related")).alias("recall")
    )
