"""References to records that are missing, removed or later than the reference.

Method: a skew-aware split. References are first added up per key and month. Groups that hold much of a field's rows are
few by their definition, so they are checked and joined as a broadcast; the rest is shuffled by key, where no key is heavy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.functions.plain import ascii_width, month_of, stripped
from casemesh.operators.durable import cut

#: A group with at least this part of a field's references is heavy. At most so many groups can be: the broadcast's bound.
HEAVY_PART = 200


def orphans(refs: DataFrame, targets: DataFrame, removed: DataFrame, total: int) -> DataFrame:
    """(field, row_id, ref_state, ref_month) of the references in refs that are no good.

    refs: (field, row_id, key, created_at); targets: (key, since); removed: (key). total: the number of rows of refs, or more.
    'removed': the key is missing and in removed; 'absent': missing and not there; 'late': present, but every record of
    that key is later than the reference. Null keys are no references. Without created_at a reference can't be late and
    has a null month; a target without time counts as there from the start. Copies of a row give one row.
    """
    refs = refs.where("key is not null").withColumn("month", month_of(F.col("created_at")))
    groups = cut(refs.groupBy("field", "key", "month").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first")))
    heavy = F.col("n") * HEAVY_PART >= F.lit(max(total, 1))
    since = F.min(F.coalesce(F.col("since"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))).alias("since")
    gone = removed.select("key").where("key is not null").distinct().withColumn("gone", F.lit(True))

    def judged(part: DataFrame, there: DataFrame) -> DataFrame:
        """Groups with something wrong, and when their key appears, if ever."""
        found = part.join(there.groupBy("key").agg(since), "key", "left")
        wrong = found.where("since is null or since > first").join(gone, "key", "left")
        state = F.when(F.col("since").isNotNull(), "late").when(F.col("gone"), "removed").otherwise("absent")
        return wrong.select("field", "key", "month", state.alias("state"), "since")

    heavy_groups, light_groups = groups.where(heavy), groups.where(~heavy)
    heavy_keys = F.broadcast(heavy_groups.select("key").distinct())
    heavy_bad = F.broadcast(judged(heavy_groups, targets.join(heavy_keys, "key", "left_semi")))
    light_bad = judged(light_groups, targets)
    names = {c: f"bad_{c}" for c in ("field", "key", "month")}
    same = lambda: (F.col("field") == F.col("bad_field")) & (F.col("key") == F.col("bad_key")) & F.col("month").eqNullSafe(F.col("bad_month"))

    def rows(part: DataFrame, bad: DataFrame) -> DataFrame:
        hit = part.join(bad.withColumnsRenamed(names), same())
        return hit.where("since is null or since > created_at").select("field", "row_id", F.col("state").alias("ref_state"), F.col("month").alias("ref_month"))

    of_heavy = F.broadcast(heavy_groups.select(*names).withColumnsRenamed(names))
    light_rows = refs.join(of_heavy, same(), "left_anti")
    return rows(refs, heavy_bad).unionByName(rows(light_rows, light_bad)).distinct()


def clean_jid(c):
    """A jid as it is compared: trimmed, full-width signs as ASCII."""
    return stripped(ascii_width(c))


def reference_orphans(citations: DataFrame, decisions: DataFrame, raw_records: DataFrame, removed_records: DataFrame) -> DataFrame:
    """(ref_field, row_id, ref_state, ref_month) of citations.target_id, citations.target_canonical_id and decisions.jid.

    The two fields of citations are read and judged together.
    """
    ids = decisions.where("id is not null").select(F.col("id").alias("key"), F.col("created_at").alias("since"))
    jids = raw_records.where("jid is not null").select(clean_jid(F.col("jid")).alias("key"), F.col("received_at").alias("since"))
    gone = lambda table: removed_records.where(F.col("record_table") == table)
    gone_ids = gone("decisions").select(F.expr("try_cast(record_key as bigint)").alias("key"))
    gone_jids = gone("raw_records").select(clean_jid(F.col("record_key")).alias("key"))
    both = F.explode(F.array(*[F.struct(F.lit(f"citations.{c}").alias("field"), F.col(c).alias("key")) for c in ("target_id", "target_canonical_id")]))
    cites = citations.select(F.col("id").alias("row_id"), "created_at", both.alias("r")).select("r.field", "row_id", "r.key", "created_at")
    rulings = decisions.select(F.lit("decisions.jid").alias("field"), F.col("id").alias("row_id"), clean_jid(F.col("jid")).alias("key"), "created_at")
    found = orphans(cites, ids, gone_ids, 2 * citations.count()).unionByName(orphans(rulings, jids, gone_jids, decisions.count()))
    return found.withColumnRenamed("field", "ref_field")


def orphan_counts(found: DataFrame) -> DataFrame:
    """The report: records without a good reference per field, state and month."""
    return found.groupBy("ref_field", "ref_state", "ref_month").agg(F.count(F.lit(1)).alias("n_records"))
