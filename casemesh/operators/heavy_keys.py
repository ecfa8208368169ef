"""Per-key counts when a handful of keys hold most of the rows.

Method: dense accumulator arrays. No row is ever sent to its key. Every input split, all of equal size, encodes its keys
with a dictionary, adds its rows up with numpy.bincount and gives off one array block per range of keys; the blocks are
then added up, first by salt, then for good. A key that holds a third of all rows is one number in each split's block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.operators.durable import cut

#: Keys whose higher bits agree share a block, so a block has at most 256 keys.
BLOCK_BITS = 8
#: Rows that a split adds up at a time.
SPLIT_ROWS = 1_000_000
SALTS = 32

_FIELDS = ("target_id", "target_authority_id")
_MEASURES = ("n_rows", "n_edges", "n_sources")
_BLOCK = "field int, block long, salt int, keys array<long>, n_rows array<long>, n_edges array<long>, n_sources array<long>"


def _blocks(field: np.ndarray, key: np.ndarray, sums: list[np.ndarray], salt: int) -> pa.RecordBatch:
    """Adds rows up by (field, key) and cuts the sorted dictionary into blocks."""
    order = np.lexsort((key, field))
    f, k = field[order], key[order]
    new = np.empty(len(k), dtype=bool)
    if len(k):
        new[0] = True
        new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
    code = np.cumsum(new) - 1
    f, k = f[new], k[new]
    totals = [np.bincount(code, weights=s[order], minlength=len(k)).astype(np.int64) for s in sums]
    block = k >> BLOCK_BITS
    first = np.ones(len(k), dtype=bool)
    first[1:] = (block[1:] != block[:-1]) | (f[1:] != f[:-1])
    starts = np.flatnonzero(first)
    offsets = pa.array(np.append(starts, len(k)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (k, *totals)]
    return pa.RecordBatch.from_arrays(
        [pa.array(f[starts].astype(np.int32)), pa.array(block[starts]), pa.array(np.full(len(starts), salt, dtype=np.int32)), *lists],
        names=["field", "block", "salt", "keys", *_MEASURES],
    )


def _split_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (field, key, n_rows, n_edges, n_sources) of one split to its array blocks."""
    from pyspark import TaskContext

    context = TaskContext.get()
    salt = (context.partitionId() if context else 0) % SALTS
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
        n += batch.num_rows
        if n >= SPLIT_ROWS:
            c = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield _blocks(c[0], c[1], c[2:], salt)
            held, n = [], 0
    if n:
        c = [np.concatenate(x) for x in zip(*held, strict=True)]
        yield _blocks(c[0], c[1], c[2:], salt)


def _add_blocks(batches: Iterator[pa.RecordBatch], salted: bool) -> Iterator[pa.RecordBatch]:
    """Adds up blocks that come sorted by (field, block); the last block of a batch may go on in the next."""
    held: list[np.ndarray] | None = None

    def flat(batch: pa.RecordBatch) -> list[np.ndarray]:
        lists = [batch.column(i) for i in range(3, 7)]
        sizes = np.diff(lists[0].offsets.to_numpy())
        return [np.repeat(batch.column(0).to_numpy(), sizes), *[x.flatten().to_numpy(zero_copy_only=False) for x in lists]]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = flat(batch)
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = (cols[0] == cols[0][-1]) & ((cols[1] >> BLOCK_BITS) == (cols[1][-1] >> BLOCK_BITS))
        done = ~last
        if done.any():
            yield _blocks(cols[0][done], cols[1][done], [c[done] for c in cols[2:]], 0)
        tail = _blocks(cols[0][last], cols[1][last], [c[last] for c in cols[2:]], 0)
        held = flat(tail)
    if held is not None:
        yield _blocks(held[0], held[1], held[2:], 0)


def _reduce(blocks: DataFrame, *by: str) -> DataFrame:
    return blocks.repartition(*by).sortWithinPartitions("field", "block").mapInArrow(lambda b: _add_blocks(b, True), _BLOCK)


def _keys(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each of the two fields that has a key."""
    fields = F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).alias("key")) for i, c in enumerate(_FIELDS)])
    return rows.select(*columns, F.explode(fields).alias("k")).where("k.key is not null")


def _totals(blocks: DataFrame, *measures: str) -> DataFrame:
    """Blocks of splits to one row per key."""
    total = _reduce(_reduce(blocks, "field", "block", "salt"), "field", "block")
    each = total.select("field", F.explode(F.arrays_zip(F.col("keys").alias("k"), *[F.col(m) for m in measures])).alias("x"))
    name = F.when(F.col("field") == 0, _FIELDS[0]).otherwise(_FIELDS[1])
    return each.select(name.alias("key_field"), F.col("x.k").alias("key_value"), *[F.col(f"x.{m}").alias(m) for m in measures])


def row_counts(citations: DataFrame) -> DataFrame:
    """(key_field, key_value, n_rows): delivered rows by key. Nothing but array blocks is shuffled."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = _keys(citations).select("k.field", "k.key", one.alias("n_rows"), zero.alias("n_edges"), zero.alias("n_sources"))
    return _totals(rows.mapInArrow(_split_sums, _BLOCK), "n_rows")


def key_counts(citations: DataFrame) -> DataFrame:
    """(key_field, key_value, n_rows, n_edges, n_sources) of every cited ruling and authority.

    n_rows counts delivered rows, n_edges records (a record is an id with its contents, delivered once or more),
    n_sources distinct non-null sources. Null keys are no keys; rows with null ids count as the records that their other
    columns make them. An empty table gives no rows.
    """
    records = cut(citations.groupBy("id", "source_id", *_FIELDS).agg(F.count(F.lit(1)).alias("n_rows")))
    keys = _keys(records, "source_id", "n_rows")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    edges = keys.select("k.field", "k.key", "n_rows", one.alias("n_edges"), zero.alias("n_sources"))
    # a pair of key and source is no hot key: copies of it are dropped before the shuffle
    pairs = keys.where("source_id is not null").select("k.field", "k.key", "source_id").distinct()
    sources = pairs.select("field", "key", zero.alias("n_rows"), zero.alias("n_edges"), one.alias("n_sources"))
    return _totals(edges.mapInArrow(_split_sums, _BLOCK).unionByName(sources.mapInArrow(_split_sums, _BLOCK)), *_MEASURES)


def heavy_keys(citations: DataFrame, share: float = 0.02) -> DataFrame:
    """The keys (key_field, key_value, n_rows) that hold at least a share of all delivered rows, rows without that key included. None in an empty table."""
    total = citations.count()
    return row_counts(citations).where(F.col("n_rows") >= F.lit(share) * F.lit(total))
