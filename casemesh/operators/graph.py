"""Building the citation graph and its derived columns.

All functions take records (one row per id, see records()) and return new DataFrames; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh.functions.text import case_word, graph_court


def records(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per id. Rows are delivered more than once as exact copies; rows without id are no records."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def docket_key(with_type: bool = True) -> Column:
    """A docket as one string, nulls included, so that dockets with missing parts compare null-safely."""
    parts = [graph_court(F.col("unit_norm")), F.col("jyear").cast("string"), case_word(F.col("jcase_norm")), F.col("jno").cast("string")]
    if with_type:
        parts.append(F.col("case_type"))
    return F.concat_ws("|", *[F.coalesce(p, F.lit("\x00")) for p in parts])


def canonical_ids(decisions: DataFrame) -> DataFrame:
    """(id, canonical_id): rulings of one docket and case type share the smallest id among them."""
    keyed = decisions.select("id", docket_key().alias("docket"))
    return keyed.join(keyed.groupBy("docket").agg(F.min("id").alias("canonical_id")), "docket").select("id", "canonical_id")


def edge_canonical(citations: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, target_canonical_id) of the citations of rulings; null where the ruling isn't there."""
    to = decisions.select(F.col("id").alias("target_id"), F.coalesce("canonical_id", "id").alias("canonical"))
    return citations.where("target_id is not null").select("id", "target_id").join(to, "target_id", "left").select(
        "id", F.col("canonical").alias("target_canonical_id")
    )


def citation_counts(decisions: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, total_citation_count): distinct sources that cite any ruling of the group, the same for each of its members.

    Pairs are made distinct before the join, so that a ruling that is cited very often isn't one task's work.
    """
    groups = decisions.select("id", F.coalesce("canonical_id", "id").alias("grp"))
    pairs = citations.where("target_id is not null").select(F.col("target_id").alias("id"), "source_id").distinct()
    counts = pairs.join(groups, "id").select("grp", "source_id").distinct().where("source_id is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return groups.join(counts, "grp", "left").select("id", F.coalesce("n", F.lit(0)).alias("total_citation_count"))


def authority_counts(authorities: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, total_citation_count) of all authorities, those without citations with what they had (or 0)."""
    pairs = citations.where("target_authority_id is not null and source_id is not null").select(F.col("target_authority_id").alias("id"), "source_id").distinct()
    counts = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return authorities.select("id", F.col("total_citation_count").alias("old")).join(counts, "id", "left").select(
        "id", F.coalesce("n", F.col("old").cast("long"), F.lit(0)).alias("total_citation_count")
    )


def canonical_doc_types(decisions: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, canonical_doc_type): the one type that a group's rulings and the edges to them agree on, else 裁判.

    Of the edges only 判例 says something about the ruling's type.
    """
    groups = decisions.select("id", F.coalesce("canonical_id", "id").alias("grp"), "doc_type")
    own = groups.where("doc_type is not null").select("grp", "doc_type")
    said = citations.where("target_doc_type = '判例' and target_id is not null").select(F.col("target_id").alias("id"), F.col("target_doc_type").alias("said")).distinct()
    edges = said.join(groups.select("id", "grp"), "id").select("grp", F.col("said").alias("doc_type"))
    kinds = own.unionByName(edges).groupBy("grp").agg(F.min("doc_type").alias("low"), F.max("doc_type").alias("high"))
    one = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("裁判")
    return groups.select("id", "grp").join(kinds, "grp", "left").select("id", one.alias("canonical_doc_type"))


def changed(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """(id, old value, new value) where the new value differs, nulls being a value."""
    both = old.select("id", F.col(column).alias("old_value")).join(new.select("id", F.col(column).alias("new_value")), "id")
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def edge_violations(citations: DataFrame) -> DataFrame:
    """(id, violation) of edges that don't have exactly one target, or lack an offset."""
    targets = F.col("target_id").isNotNull().cast("int") + F.col("target_authority_id").isNotNull().cast("int")
    bad = F.when(targets == 0, "no_target").when(targets == 2, "two_targets").when(F.col("match_start").isNull() | F.col("match_end").isNull(), "no_offset")
    return citations.select("id", bad.alias("violation")).where("violation is not null")


def target_states(citations: DataFrame, decisions: DataFrame, types: tuple[str, ...] = ("判決", "裁定", "憲判字")) -> DataFrame:
    """Resolves cited dockets (unit_norm, jyear, jcase_norm, jno, doc_type, case_type) to records: adds target_id and how.

    Where the type is one that a ruling itself can have: the full ruling of that type, else the placeholder of that type,
    else a new placeholder. Else only a placeholder without type, or a new one. Case words over 50 signs are dropped.
    """
    cited = citations.where(F.length("jcase_norm") <= 50).withColumn("docket", docket_key()).withColumn("own_type", F.col("doc_type").isin(*types))
    there = decisions.withColumn("docket", docket_key())
    full = there.where("jid is not null").groupBy("docket", "doc_type").agg(F.min("id").alias("full_id"))
    kept = there.where("jid is null").groupBy("docket", F.coalesce("doc_type", F.lit("")).alias("kind")).agg(F.min("id").alias("kept_id"))
    found = cited.join(full.withColumnRenamed("doc_type", "full_type"), (cited.docket == full.docket) & F.col("own_type") & (cited.doc_type == F.col("full_type")), "left").drop(full.docket)
    kind = F.when(F.col("own_type"), F.col("doc_type")).otherwise("")
    found = found.withColumn("kind", F.coalesce(kind, F.lit(""))).join(kept, ["docket", "kind"], "left")
    how = F.when(F.col("full_id").isNotNull(), "full").when(F.col("kept_id").isNotNull(), "placeholder").otherwise("new")
    return found.withColumns({"target_id": F.coalesce("full_id", "kept_id"), "resolution": how}).drop("docket", "own_type", "full_type", "full_id", "kept_id", "kind")


def new_placeholders(resolved: DataFrame, types: tuple[str, ...] = ("判決", "裁定", "憲判字")) -> DataFrame:
    """The placeholders that resolution asks for, one per docket, case type and type; ids are a hash of the natural key."""
    kind = F.when(F.col("doc_type").isin(*types), F.col("doc_type"))
    made = resolved.where("resolution = 'new'").select("unit_norm", "jyear", "jcase_norm", "jno", "case_type", kind.alias("doc_type")).distinct()
    key = F.concat_ws("|", docket_key(), F.coalesce("doc_type", F.lit("\x00")))
    return made.withColumn("id", F.xxhash64(key))


def upserted(decisions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Adds full rulings: (id, jid, state) of the incoming, state being 'known', 'filled' (a placeholder's id) or 'new'.

    A jid that is there is known. A placeholder of the same docket, case type and type becomes the ruling and keeps its id;
    of several rulings for one placeholder the smallest jid gets it. Incoming copies of a jid are one.
    """
    key = F.concat_ws("|", docket_key(), F.coalesce("doc_type", F.lit("\x00")))
    fresh = incoming.where("jid is not null").dropDuplicates(["jid"]).withColumn("full_key", key)
    known = decisions.where("jid is not null").groupBy("jid").agg(F.min("id").alias("known_id"))
    open_places = decisions.where("jid is null").withColumn("full_key", key).groupBy("full_key").agg(F.min("id").alias("place_id"))
    marked = fresh.select("jid", "full_key").join(known, "jid", "left")
    first = marked.where("known_id is null").groupBy("full_key").agg(F.min("jid").alias("first_jid"))
    filled = marked.join(first.join(open_places, "full_key"), "full_key", "left")
    takes = F.col("known_id").isNull() & (F.col("first_jid") == F.col("jid"))
    state = F.when(F.col("known_id").isNotNull(), "known").when(takes, "filled").otherwise("new")
    return filled.select(F.coalesce("known_id", F.when(takes, F.col("place_id")), F.xxhash64("jid")).alias("id"), "jid", state.alias("state"))


def edge_key() -> Column:
    """What makes an edge the same: its source, its target and where it begins."""
    parts = [F.col(c).cast("string") for c in ("source_id", "target_id", "target_authority_id", "match_start")]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def replaced_by_source(old: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations after a batch: those of the batch's sources are the new ones, the others stay.

    An edge that was there keeps its id and time, as chunks and statutes point at it; new edges get a hash of their key as id.
    Copies of an edge are one, the last by match_end.
    """
    of_batch = sources.select("source_id").distinct()
    since = F.col("created_at") if "created_at" in old.columns else F.lit(None).cast("timestamp_ntz")
    known = old.join(of_batch, "source_id", "left_semi").groupBy(edge_key().alias("key")).agg(F.min(F.struct("id", since.alias("since"))).alias("was"))
    rest = [c for c in new.columns if c not in ("id", "match_end")]
    made = new.groupBy(edge_key().alias("key")).agg(F.max(F.struct(*[c for c in ("match_end",) if c in new.columns], *rest)).alias("e")).join(known, "key", "left")
    columns = {c: F.col(f"e.{c}") for c in new.columns if c != "id"} | {"id": F.coalesce("was.id", F.xxhash64("key"))}
    if "created_at" in old.columns:
        columns["created_at"] = F.coalesce("was.since", columns.get("created_at", F.lit(None)))
    shown = [columns.get(c, F.lit(None).cast(old.schema[c].dataType)).alias(c) for c in old.columns]
    return old.join(of_batch, "source_id", "left_anti").select(*old.columns).unionByName(made.select(*shown))


def upserted_authorities(old: DataFrame, incoming: DataFrame) -> DataFrame:
    """(doc_type, ref_key, display) after incoming (doc_type, ref_key, display, seq): the last non-null display wins."""
    both = old.select("doc_type", "ref_key", "display", F.lit(-1).cast("long").alias("seq")).unionByName(incoming.select("doc_type", "ref_key", "display", F.col("seq").cast("long").alias("seq")))
    shown = F.max_by("display", F.when(F.col("display").isNotNull(), F.col("seq")))
    return both.groupBy("doc_type", "ref_key").agg(shown.alias("display"))
