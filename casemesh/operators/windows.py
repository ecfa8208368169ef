"""Pairs of source and target with what the source says about the target: the table that ranking reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemesh.functions.plain import stripped

#: Distinct snippets that a pair keeps.
SNIPPETS = 8


def with_target_uid(citations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds target_uid: 'decision:<canonical id>' or 'authority:<id>'; edges without any target are left out."""
    # most rulings are their own canonical ruling and need no join; so the joined side is small, and a target that very many
    # edges have in common is either not in it or spread by adaptive execution, which reads the edges by their splits
    moved = decisions.where("canonical_id is not null and canonical_id <> id").select(F.col("id").alias("target_id"), F.col("canonical_id").alias("to_canonical"))
    joined = citations.join(moved, "target_id", "left")
    ruling = F.coalesce("to_canonical", "target_id")
    uid = F.when(ruling.isNotNull(), F.concat(F.lit("decision:"), ruling.cast("string"))).when(
        F.col("target_authority_id").isNotNull(), F.concat(F.lit("authority:"), F.col("target_authority_id").cast("string"))
    )
    return joined.withColumn("target_uid", uid).where("target_uid is not null").drop("to_canonical")


def statute_key():
    """A statute as one struct; an empty sub_ref is none."""
    return F.struct(stripped(F.col("law")).alias("law"), "article_raw", F.when(F.col("sub_ref") != "", F.col("sub_ref")).alias("sub_ref"))


def pair_statutes(with_uid: DataFrame, statutes: DataFrame) -> DataFrame:
    """(source_id, target_uid, statutes): the distinct statutes of a pair's citations, in order."""
    s = statutes.select("citation_id", statute_key().alias("statute")).distinct()
    pairs = with_uid.select(F.col("id").alias("citation_id"), "source_id", "target_uid").join(s, "citation_id")
    return pairs.groupBy("source_id", "target_uid").agg(F.array_sort(F.collect_set("statute")).alias("statutes"))


def pair_windows(with_uid: DataFrame) -> DataFrame:
    """(source_id, target_uid, merged_citation_count, window_text).

    window_text: the first SNIPPETS distinct snippets in the order of their citations, trimmed, joined by line ends;
    null and blank snippets say nothing.
    """
    count = with_uid.groupBy("source_id", "target_uid").agg(F.count(F.lit(1)).alias("merged_citation_count"))
    said = with_uid.select("source_id", "target_uid", "id", stripped(F.col("snippet")).alias("said")).where("said <> ''")
    first = said.groupBy("source_id", "target_uid", "said").agg(F.min("id").alias("id"))
    order = Window.partitionBy("source_id", "target_uid").orderBy("id", "said")
    few = first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SNIPPETS)
    text = few.groupBy("source_id", "target_uid").agg(F.array_sort(F.collect_list(F.struct("k", "said"))).alias("x"))
    text = text.select("source_id", "target_uid", F.array_join(F.transform("x", lambda s: s["said"]), "\n").alias("window_text"))
    return count.join(text, ["source_id", "target_uid"], "left").select("source_id", "target_uid", "merged_citation_count", F.coalesce("window_text", F.lit("")).alias("window_text"))


def windows(citations: DataFrame, decisions: DataFrame, statutes: DataFrame) -> DataFrame:
    """The pair table with statutes (an empty array where there are none)."""
    uid = with_target_uid(citations, decisions)
    sets = pair_statutes(uid, statutes)
    none = F.array().cast("array<struct<law:string,article_raw:string,sub_ref:string>>")
    return pair_windows(uid).join(sets, ["source_id", "target_uid"], "left").withColumn("statutes", F.coalesce("statutes", none))


def source_statutes(citations: DataFrame, statutes: DataFrame) -> DataFrame:
    """(source_id, statutes): the distinct statutes that a source mentions in what it cites."""
    s = statutes.select("citation_id", statute_key().alias("statute")).distinct()
    pairs = citations.select(F.col("id").alias("citation_id"), "source_id").join(s, "citation_id")
    return pairs.groupBy("source_id").agg(F.array_sort(F.collect_set("statute")).alias("statutes"))
