"""An index of all pairs of neighbouring signs, for keywords as substrings.

A ruling has a keyword only if it has all the pairs in it, so postings of pairs give few candidates, and the keyword itself is
looked for only in their texts. The index is two tables: postings, in folders by a hash of the pair and sorted by it, so that
a search reads some row groups of some folders; and the texts, sorted by id, so that few candidates are few pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.operators.recall import SearchSpec, keyword_hits

#: Folders of postings; candidates up to which ids are written into the scan's filter.
FOLDERS, LISTED = 64, 5000
#: Row groups are small, since a search needs few of them.
ROW_GROUP = 8 << 20


def pairs_of(term: str) -> list[str]:
    """The distinct pairs of neighbouring signs of a term; a single sign has none."""
    return sorted({term[i : i + 2] for i in range(len(term) - 1)})


def folder_of(pair: str) -> int:
    return crc32(pair.encode("utf-8", "surrogatepass")) % FOLDERS


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to the ids by pair, a batch of texts at a time."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        found: dict[str, list[int]] = {}
        for i, t in zip(ids, batch.column(1).to_pylist(), strict=True):
            for pair in {t[k : k + 2] for k in range(len(t) - 1)}:
                found.setdefault(pair, []).append(i)
        sizes = np.cumsum([0, *map(len, found.values())]).astype(np.int32)
        flat = pa.array([i for x in found.values() for i in x], type=pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([folder_of(p) for p in found], type=pa.int32()), pa.array(list(found), type=pa.string()), pa.ListArray.from_arrays(pa.array(sizes), flat)], names=["folder", "pair", "ids"]
        )


def build(decisions: DataFrame, path: str) -> None:
    """Writes the index of all rulings with text. Copies of a ruling are one; rulings without id aren't found."""
    texts = decisions.where("id is not null and length(clean_text) > 0").select("id", "case_type", "clean_text").dropDuplicates(["id"])
    texts.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/texts")
    rows = decisions.sparkSession.read.parquet(f"{path}/texts").select("id", "clean_text").mapInArrow(_postings, "folder int, pair string, ids array<long>")
    rows.repartition("folder").sortWithinPartitions("folder", "pair").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("folder").parquet(f"{path}/postings")


def candidates(spark: SparkSession, path: str, terms: tuple[str, ...]) -> DataFrame | None:
    """(id) of the rulings that have all pairs of all terms; None if no term has a pair."""
    wanted = sorted({p for t in terms for p in pairs_of(t)})
    if not wanted:
        return None
    read = spark.read.schema("pair string, ids array<long>, folder int").parquet(f"{path}/postings").where(F.col("folder").isin(*sorted({folder_of(p) for p in wanted})) & F.col("pair").isin(*wanted))
    each = read.select("pair", F.explode("ids").alias("id"))
    return each.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("id")


def hits(spark: SparkSession, path: str, spec: SearchSpec) -> DataFrame:
    """What recall.keyword_hits gives on the indexed rulings."""
    texts = spark.read.parquet(f"{path}/texts")
    some = candidates(spark, path, spec.keywords)
    if some is not None:
        few = some.limit(LISTED + 1).collect()
        if len(few) <= LISTED:
            ids = [r[0] for r in few]
            texts = texts.where(F.col("id").isin(*ids)) if ids else texts.limit(0)
        else:
            texts = texts.join(some, "id", "left_semi")
    return keyword_hits(texts, spec)


def indexed(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/postings/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
