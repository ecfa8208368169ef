"""Stage two of a search: the targets that the recalled sources cite, by how much of the search their snippets meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemesh.functions.text import court_level
from casemesh.operators.durable import cut
from casemesh.operators.recall import SearchSpec, statute_match

#: Targets after which lower levels of agreement aren't looked at; sources that a target's preview shows.
ENOUGH, PREVIEWS = 200, 5


def match_count(spec: SearchSpec) -> Column:
    """The number of a spec's keywords and statutes that a pair meets."""
    parts = [F.col("window_text").contains(k).cast("int") for k in spec.keywords]
    parts += [statute_match(F.col("statutes"), s).cast("int") for s in spec.statutes]
    return reduce(lambda a, b: a + b, parts)


def matched_pairs(windows: DataFrame, sources: DataFrame, spec: SearchSpec) -> DataFrame:
    """(source_id, target_uid, match_count) of the recalled sources' pairs."""
    return windows.join(sources.select("source_id"), "source_id", "left_semi").select("source_id", "target_uid", match_count(spec).alias("match_count"))


def step_down(pairs: DataFrame, spec: SearchSpec, enough: int = ENOUGH, previews: int = PREVIEWS) -> DataFrame:
    """(target_uid, reached, preview_source_ids): the targets down to the level at which there are enough.

    reached is the best match_count of a target's pairs. The level is the highest one that at least so many targets reach,
    else 0; it needs one aggregate and a histogram of as many rows as the spec has conditions. Previews are the pairs from
    that level on, best first, then by source.
    """
    levels = len(spec.keywords) + len(spec.statutes)
    pairs = cut(pairs)
    best = pairs.groupBy("target_uid").agg(F.max("match_count").alias("reached"))
    histogram = {r["reached"]: r["n"] for r in best.groupBy("reached").agg(F.count(F.lit(1)).alias("n")).collect()}
    level, total = 0, 0
    for m in range(levels, -1, -1):
        total += histogram.get(m, 0)
        if total >= enough:
            level = m
            break
    kept = pairs.where(F.col("match_count") >= level)
    order = Window.partitionBy("target_uid").orderBy(F.desc("match_count"), "source_id")
    top = kept.withColumn("k", F.row_number().over(order)).where(F.col("k") <= previews)
    lists = top.groupBy("target_uid").agg(F.array_sort(F.collect_list(F.struct("k", "source_id"))).alias("x"))
    lists = lists.select("target_uid", F.transform("x", lambda s: s["source_id"]).alias("preview_source_ids"))
    return best.where(F.col("reached") >= level).join(lists, "target_uid")


def matched_counts(citations: DataFrame, sources: DataFrame, key: str = "target_canonical_id") -> DataFrame:
    """(target, matched): distinct recalled sources by the target that they cite. Pairs are made distinct first."""
    target = F.coalesce("target_canonical_id", "target_id") if key == "target_canonical_id" else F.col(key)
    pairs = citations.join(sources.select("source_id"), "source_id", "left_semi").select(target.alias("target"), "source_id").where("target is not null").distinct()
    return pairs.groupBy("target").agg(F.count(F.lit(1)).alias("matched"))


def ranked_targets(steps: DataFrame, with_uid: DataFrame, sources: DataFrame, decisions: DataFrame, authorities: DataFrame) -> DataFrame:
    """Adds to the targets their record: (target_uid, target_type, target_id, doc_type, display_title, court_level, matched, total, reached, preview_source_ids)."""
    pairs = with_uid.join(sources.select("source_id"), "source_id", "left_semi").select("target_uid", "source_id").distinct()
    matched = pairs.groupBy("target_uid").agg(F.count(F.lit(1)).alias("matched"))
    ruling = decisions.select(
        F.concat(F.lit("decision:"), F.col("id").cast("string")).alias("target_uid"), F.lit("decision").alias("target_type"), F.col("id").alias("target_id"),
        F.coalesce("canonical_doc_type", "doc_type").alias("doc_type"), "display_title", court_level(F.col("root_norm")).alias("court_level"), F.coalesce("total_citation_count", F.lit(0)).alias("total"),
    )
    authority = authorities.select(
        F.concat(F.lit("authority:"), F.col("id").cast("string")).alias("target_uid"), F.lit("authority").alias("target_type"), F.col("id").alias("target_id"),
        "doc_type", F.coalesce("display", "ref_key").alias("display_title"), court_level(F.col("root_norm")).alias("court_level"), F.coalesce("total_citation_count", F.lit(0)).alias("total"),
    )
    return steps.join(ruling.unionByName(authority), "target_uid").join(matched, "target_uid", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))


#: Orders of a result; the uid makes each of them total.
ORDERS = {
    "relevance": ("desc reached", "desc matched", "desc total", "level", "target_uid"),
    "total": ("desc total", "desc matched", "level", "target_uid"),
}


def order_by(name: str) -> list[Column]:
    level = F.coalesce("court_level", F.lit(99))
    return [F.desc(x.removeprefix("desc ")) if x.startswith("desc ") else level.asc() if x == "level" else F.asc(x) for x in ORDERS[name]]


def filtered(rows: DataFrame, doc_types: tuple[str, ...] = (), court_levels: tuple[int, ...] = ()) -> DataFrame:
    if doc_types:
        rows = rows.where(F.col("doc_type").isin(*doc_types))
    if court_levels:
        rows = rows.where(F.col("court_level").isin(*court_levels))
    return rows


def page(rows: DataFrame, order: str = "relevance", number: int = 1, size: int = 20) -> DataFrame:
    """One page of a result, from 1."""
    if number < 1 or size < 1:
        raise ValueError("pages are numbered from 1 and have at least one row")
    return rows.orderBy(*order_by(order)).offset((number - 1) * size).limit(size)


#: Weights of BM25: how soon more occurrences count less, and how much a long window counts less.
K1, B = 1.2, 0.75


def source_scores(windows: DataFrame, sources: DataFrame, spec: SearchSpec) -> DataFrame:
    """(target_uid, source_id, score): BM25 of a pair's window for the keywords, over the recalled sources' pairs."""
    used = cut(windows.join(sources.select("source_id"), "source_id", "left_semi").select("source_id", "target_uid", "window_text"))
    has = [F.sum(F.col("window_text").contains(k).cast("int")).alias(f"k{i}") for i, k in enumerate(spec.keywords)]
    counts = used.agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("window_text")).alias("size"), *has).first()
    size = max(float(counts["size"] or 0), 1.0)
    score = F.lit(0.0)
    for i, k in enumerate(spec.keywords):
        times = (F.length("window_text") - F.length(F.replace(F.col("window_text"), F.lit(k), F.lit("")))) / len(k)
        there = float(counts[f"k{i}"] or 0)
        rare = F.ln(F.lit(1.0) + (F.lit(float(counts["n"])) - there + 0.5) / (there + 0.5))
        score = score + times * (K1 + 1) / (times + K1 * (1 - B + B * F.length("window_text") / F.lit(size))) * rare
    return used.select("target_uid", "source_id", score.alias("score"))


def target_scores(scores: DataFrame, best: int = 5) -> DataFrame:
    """(target_uid, score_sum, score_avg) over the best scores of a target's sources."""
    order = Window.partitionBy("target_uid").orderBy(F.desc("score"), "source_id")
    top = scores.withColumn("k", F.row_number().over(order)).where(F.col("k") <= best)
    return top.groupBy("target_uid").agg(F.sum("score").alias("score_sum"), F.avg("score").alias("score_avg"))
