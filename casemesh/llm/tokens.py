"""Sizes of texts in tokens of a public tokenizer, and ranks within groups of any size."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Buckets into which a group is split to be ranked; they bound a task's part of a group of any size.
BUCKETS = 256


def default_vocabulary() -> str:
    """The installed byte-level vocabulary for many languages."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = _encoding(path).encode_ordinary
    for batch in batches:
        n = np.fromiter((len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()), dtype=np.int64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["doc_id", "n_tokens"])


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every page. A null or empty text has no tokens; pages without id are left out, copies are one."""
    path = path or default_vocabulary()
    sized = documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(lambda b: _count(b, path), "doc_id long, n_tokens long")
    return sized.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def ranked(df: DataFrame, keys: list[str], order: Column, *ties: str) -> DataFrame:
    """Adds r, the rank from 0 within the keys' group by a hash (order) and ties.

    A group is ranked bucket by bucket, a bucket being a range of the hash, so that no task holds a whole large group.
    """
    b = df.withColumn("o", order).withColumn("bucket", F.shiftrightunsigned("o", 64 - (BUCKETS - 1).bit_length()))
    sizes = b.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = b.withColumn("k", F.row_number().over(W.partitionBy(*keys, "bucket").orderBy(F.shiftrightunsigned("o", 1), "o", *ties)) - 1)
    return inside.join(offsets, [*keys, "bucket"]).withColumn("r", (F.col("k") + F.col("offset")).cast("long")).drop("o", "bucket", "k", "offset")
