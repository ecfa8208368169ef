"""What sources say about one target: the best citation of each source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemesh.functions.text import simple_court
from casemesh.operators.recall import SearchSpec, statute_condition
from casemesh.operators.windows import statute_key

SHOWN = 5


def of_target(citations: DataFrame, target_id: int, authority: bool = False) -> DataFrame:
    """The citations of a ruling (by its canonical id) or of an authority."""
    key = F.col("target_authority_id") if authority else F.coalesce("target_canonical_id", "target_id")
    return citations.where(key == target_id)


def scored(citations: DataFrame, statutes: DataFrame, spec: SearchSpec) -> DataFrame:
    """Adds score: the keywords in the snippet, whatever their case, and the statutes that the snippet names exactly."""
    low = F.lower(F.coalesce("snippet", F.lit("")))
    score: Column = reduce(lambda a, b: a + b, [low.contains(k.lower()).cast("int") for k in spec.keywords], F.lit(0))
    out = citations
    if spec.statutes:
        met = [F.max(statute_condition(f, True).cast("int")).alias(f"s{i}") for i, f in enumerate(spec.statutes)]
        by = statutes.groupBy(F.col("citation_id").alias("id")).agg(*met)
        out = citations.join(by, "id", "left")
        score = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"s{i}"), F.lit(0)) for i in range(len(spec.statutes))], score)
    return out.select(*citations.columns, score.alias("score"))


def counts(of_one: DataFrame, sources: DataFrame, total: int) -> DataFrame:
    """One row (matched, others): distinct sources in the set, and the rest of the target's total."""
    inside = of_one.join(sources.select("source_id"), "source_id", "left_semi").select("source_id").distinct()
    return inside.agg(F.count(F.lit(1)).alias("matched")).select("matched", F.greatest(F.lit(total).cast("long") - F.col("matched"), F.lit(0).cast("long")).alias("others"))


def best_of_source(scored_rows: DataFrame) -> DataFrame:
    """Each source's citation with the highest score, the smallest id among equals."""
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "id")
    return scored_rows.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def matched(scored_rows: DataFrame, source_ids: tuple[int, ...], limit: int = SHOWN) -> DataFrame:
    """The best citations of some sources, best first, then by id."""
    few = scored_rows.where(F.col("source_id").isin(*source_ids[:SHOWN])) if source_ids else scored_rows.limit(0)
    return best_of_source(few).orderBy(F.desc("score"), "id").limit(limit)


def others(of_one: DataFrame, sources: DataFrame, limit: int = SHOWN) -> DataFrame:
    """(id, source_id): the first citation of sources outside the set, by id."""
    outside = of_one.join(sources.select("source_id"), "source_id", "left_anti")
    return outside.groupBy("source_id").agg(F.min("id").alias("id")).orderBy("id").limit(limit).select("id", "source_id")


def more(scored_rows: DataFrame, sources: DataFrame, loaded: tuple[int, ...], limit: int) -> DataFrame:
    """The best citations of sources in the set that aren't loaded: chosen by score and source, shown by id."""
    rest = scored_rows.join(sources.select("source_id"), "source_id", "left_semi")
    if loaded:
        rest = rest.where(~F.col("source_id").isin(*loaded))
    return best_of_source(rest).orderBy(F.desc("score"), "source_id").limit(limit).orderBy("id")


def statutes_json(chosen: DataFrame, statutes: DataFrame) -> DataFrame:
    """(id, statutes): a JSON array of the citation's statutes in order, [] if there are none."""
    s = statutes.select(F.col("citation_id").alias("id"), statute_key().alias("statute")).distinct()
    lists = chosen.select("id").join(s, "id").groupBy("id").agg(F.array_sort(F.collect_set("statute")).alias("x"))
    return chosen.select("id").join(lists, "id", "left").select("id", F.coalesce(F.to_json("x", {"ignoreNullFields": "false"}), F.lit("[]")).alias("statutes"))


def hydrated(chosen: DataFrame, decisions: DataFrame, courts: DataFrame, statutes: DataFrame) -> DataFrame:
    """Joins to few chosen citations their source's record, its court and their statutes; wide columns are read last."""
    source = decisions.select(F.col("id").alias("source_id"), "unit_norm", "display_title", "decision_date", "doc_type", "court_unit_id")
    court = F.broadcast(courts.select(F.col("id").alias("court_unit_id"), F.col("level").alias("court_level")))  # a fixed list of courts
    return (
        chosen.join(source, "source_id")
        .join(court, "court_unit_id", "left")
        .join(statutes_json(chosen, statutes), "id", "left")
        .withColumn("court", simple_court(F.col("unit_norm")))
        .drop("court_unit_id")
    )
