"""The k most similar vectors of every vector.

Method: cross-polytope hashing. A table's hash is a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) followed by the nearest signed axis. Every vector stands in the best few cells of each table (multiprobe), members
of a cell are compared by dot products, and the best of all tables are kept. Vectors that are equal number for number are one
class and are hashed once.

A cell with many members is divided by further rotations of what is left of its vectors without the cell's mean, into the more
parts the more members it has; so the number of cells grows with the collection, and most where it is dense. Cells that stay
large are compared block by block. Vectors that find fewer than k others are compared with all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from casemesh.operators.durable import cut

#: Tables for a collection of up to GROWS vectors, and cells of each table that a vector stands in. Measured recall: see the README.
TABLES, PROBES, GROWS = 10, 2, 1 << 20
#: Vectors per cell of the first rotation, at least: smaller collections have fewer cells, the smallest a single one.
LEAST = 256
#: Members from which a cell is divided: a cell has the next power of two of members / DIVIDED parts.
DIVIDED = 1 << 18
#: Members that are compared at once; larger cells are compared block by block.
BLOCK = 1 << 15
#: Cells of more than one block that are listed at most; blocks are larger if there were more.
LISTED = 1 << 20
#: Vectors travel as whole numbers of 16 bits; a cosine is off by less than this.
SCALE, OFF = 32767, 1e-4


def tables_of(n: int) -> int:
    """Tables for n vectors: they grow with the fourth root of n."""
    return math.ceil(TABLES * max(1.0, n / GROWS) ** 0.25)


def sides_of(n: int, dim: int) -> int:
    """Cells of the first rotation: two for every axis, fewer if there aren't enough vectors."""
    return min(2 << max(0, dim - 1).bit_length(), 1 << max(1, n // LEAST).bit_length() - 1)


def parts_probed(parts: int) -> int:
    """Of the parts of a divided cell, those that a member stands in."""
    return max(1, round(parts**0.4))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.float32(np.sqrt(d))


def _rotated(x: np.ndarray, seed: int) -> np.ndarray:
    signs = np.random.default_rng(seed)
    for _ in range(3):
        x = _hadamard(x * signs.choice(np.array([-1, 1], dtype=np.float32), x.shape[1]))
    return x


def _padded(x: np.ndarray) -> np.ndarray:
    """With zeros up to the next power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    return x if x.shape[1] == width else np.concatenate([x, np.zeros((len(x), width - x.shape[1]), dtype=x.dtype)], axis=1)


def _axes(x: np.ndarray, seed: int, sides: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest signed axes of rotated vectors, best first, among the first sides, and the coordinates along them."""
    y = _rotated(x, seed)[:, : max(1, sides // 2)]
    y = np.concatenate([y, -y], axis=1)
    best = np.argsort(-y, axis=1, kind="stable")[:, :most]
    return best, np.take_along_axis(y, best, 1)


def first_cells(x: np.ndarray, table: int, sides: int) -> np.ndarray:
    """The first rotation's cells of padded unit vectors in a table, best first."""
    return _axes(x, 3 * table, sides, PROBES)[0] if sides > 1 else np.zeros((len(x), 1), dtype=np.int64)


def parts_of(x: np.ndarray, table: int, parts: int) -> np.ndarray:
    """The parts, best first, that vectors without their cell's mean stand in, one row per vector."""
    wide, p = 2 * x.shape[1], parts_probed(parts)
    if parts <= wide:
        return _axes(x, 3 * table + 1, parts, p)[0]
    code, score = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
    turn = 0
    while parts > 1:  # one rotation after another, until there are as many parts
        sides = min(parts, wide)
        axis, along = _axes(x, 3 * (table + 1000 * turn) + 2, sides, min(p, sides))
        score = (score[:, :, None] + along[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * sides + axis[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(-score, axis=1, kind="stable")[:, :p]
        score, code = np.take_along_axis(score, keep, 1), np.take_along_axis(code, keep, 1)
        parts //= sides
        turn += 1
    return code


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _first_sums(batches: Iterator[pa.RecordBatch], dim: int, tables: int, sides: int) -> Iterator[pa.RecordBatch]:
    """(rep, embedding) to the members and the sums of vectors by the first rotation's cell, added up over a split."""
    n = np.zeros(sides * tables, dtype=np.int64)
    sums = np.zeros((sides * tables, dim))
    for batch in batches:
        if batch.num_rows:
            x = _unit(batch.column(1), dim).astype(np.float32)
            wide = _padded(x)
            for t in range(tables):
                for c in first_cells(wide, t, sides).T:
                    at = c + sides * t
                    n += np.bincount(at, minlength=len(n))
                    order = np.argsort(at, kind="stable")
                    first = np.flatnonzero(np.diff(at[order], prepend=-1))
                    sums[at[order][first]] += np.add.reduceat(x[order], first, axis=0, dtype=np.float64)
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(sums[used]), type=pa.list_(pa.float64()))], names=["cell", "n", "sums"])


class Cells:
    """Which cells vectors stand in: for each of the first rotation's cells, the number of its parts and its mean."""

    def __init__(self, tables: int, sides: int, members: dict[int, int], sums: dict[int, np.ndarray], divided: int) -> None:
        self.tables, self.sides = tables, sides
        self.parts = {c: 1 << max(0, (n - 1) // divided).bit_length() for c, n in members.items()}
        self.means = {c: (s / members[c]).astype(np.float32) for c, s in sums.items() if self.parts[c] > 1}

    def of(self, x: np.ndarray, divided_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of unit vectors; a vector stands in a cell once."""
        wide = _padded(x)
        rows, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        divided = np.array(sorted(self.means), dtype=np.int64)
        for t in range(self.tables):
            for c in first_cells(wide, t, self.sides).T:
                at = c + self.sides * t
                split = np.isin(at, divided)
                for cell in np.unique(at[split]).tolist():
                    r = np.flatnonzero(at == cell)
                    p = parts_of(_padded(x[r] - self.means[cell]), t, self.parts[cell])
                    rows.append(np.repeat(r, p.shape[1]))
                    cells.append((cell << 32) + p.ravel().astype(np.int64))
                if not divided_only:
                    rows.append(np.flatnonzero(~split))
                    cells.append(at[~split].astype(np.int64) << 32)
        return np.concatenate(rows), np.concatenate(cells)


def _counts(batches: Iterator[pa.RecordBatch], dim: int, cells: Cells) -> Iterator[pa.RecordBatch]:
    """Members of the parts of divided cells."""
    for batch in batches:
        if batch.num_rows:
            used, n = np.unique(cells.of(_unit(batch.column(1), dim).astype(np.float32), True)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n)], names=["cell", "n"])


_MEMBER = "cell long, i int, j int, own int, rep long, vector binary"


def _packed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * SCALE).astype(np.int16)


def _members(cell: np.ndarray, blocks: np.ndarray, own: np.ndarray, rep: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    """A row per block that a member is compared with; a pair of blocks has the smaller one first."""
    each = np.repeat(np.arange(len(cell)), blocks)
    other = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = own[each]
    data = np.ascontiguousarray(vectors[row[each]])
    size = data.shape[1] * data.itemsize
    return pa.RecordBatch.from_arrays(
        [
            pa.array(cell[each]), pa.array(np.minimum(own, other).astype(np.int32)), pa.array(np.maximum(own, other).astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(rep[row[each]]),
            pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(each), [None, pa.py_buffer(data)]).cast(pa.binary()),
        ],
        names=["cell", "i", "j", "own", "rep", "vector"],
    )


def _place(batches: Iterator[pa.RecordBatch], dim: int, cells: Cells, large: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """(rep, embedding) to a row per cell and block. large: the blocks of cells that have more than one."""
    sizes = np.array(sorted(large), dtype=np.int64)
    count = np.array([large[c] for c in sizes.tolist()], dtype=np.int64)
    for batch in batches:
        for s in range(0, batch.num_rows, 2000):
            some = batch.slice(s, 2000)
            x = _unit(some.column(1), dim).astype(np.float32)
            rep = some.column(0).to_numpy()
            row, cell = cells.of(x)
            blocks = np.ones(len(cell), dtype=np.int64)
            if len(sizes):
                at = np.minimum(np.searchsorted(sizes, cell), len(sizes) - 1)
                blocks = np.where(sizes[at] == cell, count[at], 1)
            yield _members(cell, blocks, spread(rep)[row] % blocks, rep, _packed(x), row)


def spread(rep: np.ndarray) -> np.ndarray:
    """Ids as numbers that are spread evenly."""
    return ((rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def top_members(q: np.ndarray, x: np.ndarray, keep: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, dot product) of the best members for every query; own: each query's place among the members, itself left out.

    Members are looked at in blocks of growing size; after the first, only those above a query's worst so far.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for s in range(0, len(q), 1024):
        part = q[s : s + 1024]
        rows = np.arange(len(part))
        row, col, best = (np.empty(0, t) for t in (np.int64, np.int64, np.float32))
        worst = np.full(len(part), -np.inf, dtype=np.float32)
        a, width = 0, 1024
        while a < len(x):
            sim = part @ x[a : a + width].T
            if own is not None:
                mine = own[s : s + 1024] - a
                ok = (mine >= 0) & (mine < sim.shape[1])
                sim[rows[ok], mine[ok]] = -np.inf
            if a == 0 and sim.shape[1] > keep:
                c = np.argpartition(-sim, keep - 1, axis=1)[:, :keep].ravel()
                r = np.repeat(rows, keep)
            else:
                r, c = np.nonzero(sim > worst[:, None])
            row, col, best = np.concatenate([row, r]), np.concatenate([col, c + a]), np.concatenate([best, sim[r, c]])
            order = np.lexsort((-best, row))
            row, col, best = row[order], col[order], best[order]
            place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            row, col, best = row[place < keep], col[place < keep], best[place < keep]
            full = place[place < keep] == keep - 1
            worst[row[full]] = best[full]
            a += width
            width = min(2 * width, 1 << 14)
        real = np.isfinite(best)
        out.append((row[real] + s, col[real], best[real]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))


def _compare(rows: pa.Table, dim: int, keep: int) -> pa.Table:
    """The best members of the other block for each member of either; within one block, the best others."""
    rep, own = rows.column("rep").to_numpy(), rows.column("own").to_numpy()
    x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), dtype=np.int16).reshape(-1, dim).astype(np.float32) / SCALE
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
    turns = [(a, a, np.arange(len(a)))] if i == j else [(a, b, None), (b, a, None)]
    found = []
    for p, q, mine in turns:
        if len(p) and len(q):
            r, c, cosine = top_members(x[p], x[q], keep, mine)
            found.append((rep[p][r], rep[q][c], cosine))
    flat = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 3
    return pa.table({"rep": flat[0].astype(np.int64), "other": flat[1].astype(np.int64), "cosine": flat[2].astype(np.float32)})


def _best(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """(rep, other, cosine), sorted by rep, to the best distinct others of each rep."""

    def done(c: list[np.ndarray]) -> pa.RecordBatch:
        rep, other, cosine = c
        order = np.lexsort((-cosine, other, rep))
        rep, other, cosine = rep[order], other[order], cosine[order]
        new = np.ones(len(rep), dtype=bool)
        new[1:] = (rep[1:] != rep[:-1]) | (other[1:] != other[:-1])
        rep, other, cosine = rep[new], other[new], cosine[new]
        order = np.lexsort((other, -cosine, rep))
        rep, other, cosine = rep[order], other[order], cosine[order]
        top = np.arange(len(rep)) - np.searchsorted(rep, rep, side="left") < keep
        return pa.RecordBatch.from_arrays([pa.array(rep[top]), pa.array(other[top]), pa.array(cosine[top])], names=["rep", "other", "cosine"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if batch.num_rows:
            c = [batch.column(k).to_numpy() for k in range(3)]
            c = c if held is None else [np.concatenate(p) for p in zip(held, c, strict=True)]
            last = c[0] == c[0][-1]
            if not last.all():
                yield done([p[~last] for p in c])
            held = [p[last] for p in c]
    if held is not None:
        yield done(held)


def _best_of(found: DataFrame, keep: int) -> DataFrame:
    return found.repartition("rep").sortWithinPartitions("rep").mapInArrow(lambda b: _best(b, keep), "rep long, other long, cosine float")


def _pairs(placed: DataFrame, dim: int, keep: int) -> DataFrame:
    return placed.groupBy("cell", "i", "j").applyInArrow(lambda rows: _compare(rows, dim, keep), "rep long, other long, cosine float")


def candidates(vectors: DataFrame, n: int, keep: int, dim: int) -> DataFrame:
    """(rep, other, cosine): the best others that share a cell with each of n distinct vectors (rep, embedding)."""
    sides, divided, block = sides_of(n, dim), DIVIDED, BLOCK
    tables = tables_of(n) if sides > PROBES else 1  # else all tables have the same members
    first = vectors.mapInArrow(lambda b: _first_sums(b, dim, tables, sides), "cell long, n long, sums array<double>")
    adding = [F.sum(F.element_at("sums", k + 1)).alias(f"s{k}") for k in range(dim)]
    # one row per cell of the first rotation: at most 128 * tables of them at 64 numbers
    rows = first.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*adding).alias("sums")).collect()
    cells = Cells(tables, sides, {r["cell"]: r["n"] for r in rows}, {r["cell"]: np.array(r["sums"]) for r in rows}, divided)
    block = max(block, sum(r["n"] * parts_probed(cells.parts[r["cell"]]) for r in rows) // LISTED)
    large = {r["cell"] << 32: -(-r["n"] // block) for r in rows if cells.parts[r["cell"]] == 1 and r["n"] > block}
    if cells.means:
        # the parts' members are counted by themselves: writing the placed vectors to count them would cost more than placing them twice
        counted = vectors.mapInArrow(lambda b: _counts(b, dim, cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        large |= {r["cell"]: -(-r["n"] // block) for r in counted.where(F.col("n") > block).collect()}  # at most LISTED
    return _best_of(_pairs(vectors.mapInArrow(lambda b: _place(b, dim, cells, large), _MEMBER), dim, keep), keep)


def compared_with_all(some: DataFrame, n_some: int, vectors: DataFrame, n: int, keep: int, dim: int) -> DataFrame:
    """(rep, other, cosine): the best others among all n vectors for some of them (rep, embedding), block by block."""
    block = BLOCK
    of_some, of_all = -(-n_some // block), -(-n // block)

    def rows(batches: Iterator[pa.RecordBatch], asked: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                rep = part.column(0).to_numpy()
                own = spread(rep) % (of_some if asked else of_all)
                copies = of_all if asked else of_some
                each = np.repeat(np.arange(len(rep)), copies)
                other = np.tile(np.arange(copies), len(rep))
                data = np.ascontiguousarray(_packed(_unit(part.column(1), dim).astype(np.float32))[each])
                i, j = (own[each], other) if asked else (other, own[each])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(each), np.int64)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(each), int(asked), np.int32)), pa.array(rep[each]),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * dim), len(each), [None, pa.py_buffer(data)]).cast(pa.binary())],
                    names=["cell", "i", "j", "own", "rep", "vector"],
                )

    def compare(group: pa.Table) -> pa.Table:
        rep, asked = group.column("rep").to_numpy(), group.column("own").to_numpy() == 1
        x = np.frombuffer(b"".join(group.column("vector").to_pylist()), dtype=np.int16).reshape(-1, dim).astype(np.float32) / SCALE
        q, m = np.flatnonzero(asked), np.flatnonzero(~asked)
        r, c, cosine = top_members(x[q], x[m], keep + 1) if len(q) and len(m) else (np.empty(0, np.int64),) * 3
        a, b = rep[q][r], rep[m][c]
        return pa.table({"rep": a[a != b], "other": b[a != b], "cosine": np.asarray(cosine, np.float32)[a != b]})

    both = some.mapInArrow(lambda b: rows(b, True), _MEMBER).unionByName(vectors.mapInArrow(lambda b: rows(b, False), _MEMBER))
    return _best_of(both.groupBy("cell", "i", "j").applyInArrow(compare, "rep long, other long, cosine float"), keep)


def vector_classes(chunks: DataFrame, dim: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every vector that takes part, and (rep, embedding, ids) with the keep smallest ids of each class."""
    ok = (F.size("embedding") == dim) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v)) & F.exists("embedding", lambda v: v != 0)
    plain = chunks.where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & ok).select(
        "id", F.col("embedding").cast("array<double>").alias("embedding")
    )
    keyed = cut(plain.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64("embedding", F.lit(1))}).dropDuplicates(["id"]))
    # the smallest ids in two steps, so that a class of very many copies isn't sorted by one task
    part = W.partitionBy("h1", "h2", F.pmod("id", F.lit(64))).orderBy("id")
    few = keyed.withColumn("k", F.row_number().over(part)).where(F.col("k") <= keep)
    reps = few.groupBy("h1", "h2").agg(
        F.min_by("embedding", "id").alias("embedding"), F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids")
    )
    reps = cut(reps.withColumn("rep", F.col("ids")[0]))
    # a class of very many copies is spread over salts
    salted = reps.select("h1", "h2", "rep", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    members = keyed.select("id", "h1", "h2", F.pmod("id", F.lit(16)).cast("int").alias("salt")).join(salted, ["h1", "h2", "salt"])
    return members.select("id", "rep"), reps.select("rep", "embedding", "ids")


def nearest(chunks: DataFrame, k: int = 5, dim: int = 64) -> DataFrame:
    """(id, rank, other, cosine): the k chunks most similar to each chunk, ties by the smaller id.

    Chunks without id, and vectors that are null, all zero, of another length or hold a null or NaN take no part. Copies
    of a row are one chunk. Fewer than k rows come out only where there are no more chunks. Cosines are off by less than OFF.
    """
    members, reps = vector_classes(chunks, dim, k + 1)
    n = reps.count()
    vectors = reps.select("rep", "embedding")
    best = cut(candidates(vectors, n, k + 1, dim))
    enough = min(k, n - 1)
    short = vectors.join(best.groupBy("rep").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= enough), "rep", "left_anti")
    n_short = short.count() if enough > 0 else 0
    if n_short:
        short = cut(short)
        best = best.join(short.select("rep"), "rep", "left_anti").unionByName(compared_with_all(short, n_short, vectors, n, k + 1, dim))
    best = best.withColumn("cosine", F.col("cosine").cast("double"))
    ids = reps.select(F.col("rep").alias("other"), "ids")
    own = reps.select("rep", F.lit(1.0).alias("cosine"), "ids")
    listed = best.join(ids, "other").select("rep", "cosine", "ids").unionByName(own)
    flat = listed.select("rep", (-F.col("cosine")).alias("far"), F.explode("ids").alias("other"))
    # of each class, one chunk more than needed, since a chunk is no neighbour of its own
    top = flat.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "other"))), 1, k + 1).alias("top"))
    top = top.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    lists = members.withColumn("salt", F.pmod("id", F.lit(16)).cast("int")).join(top, ["rep", "salt"])
    others = F.slice(F.filter("top", lambda t: t["other"] != F.col("id")), 1, k)
    return lists.select("id", F.posexplode(others).alias("p", "t")).select(
        "id", (F.col("p") + 1).alias("rank"), F.col("t.other").alias("other"), (-F.col("t.far")).alias("cosine")
    )


def mutual_pairs(neighbours: DataFrame, chunks: DataFrame, least: float = 0.9) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b, each among the other's neighbours, with at least that cosine.

    The cosine of pairs that are as near to the limit as rounding is computed from the vectors themselves.
    """
    near = neighbours.where(F.col("cosine") >= F.lit(least - OFF))
    a, b = F.least("id", "other"), F.greatest("id", "other")
    both = near.groupBy(a.alias("chunk_id_a"), b.alias("chunk_id_b")).agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("cosine")).where("n = 2")
    clear, close = F.col("cosine") >= F.lit(least + OFF), F.col("cosine") < F.lit(least + OFF)
    rows = both.where(close).select("chunk_id_a", "chunk_id_b")
    for c in ("a", "b"):
        v = chunks.where("id is not null").select(F.col("id").alias(f"chunk_id_{c}"), F.col("embedding").alias(f"v{c}"))
        rows = rows.join(v, f"chunk_id_{c}").dropDuplicates(["chunk_id_a", "chunk_id_b"])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    exact = dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))
    checked = rows.where(exact >= F.lit(least - 1e-6)).select("chunk_id_a", "chunk_id_b")
    return both.where(clear).select("chunk_id_a", "chunk_id_b").unionByName(checked)


def exact_nearest(pdf: pd.DataFrame, k: int = 5, dim: int = 64) -> dict[int, list[int]]:
    """Brute force over (id, embedding), for tests and for measuring recall."""
    pdf = pdf.drop_duplicates("id")
    good = pdf[[e is not None and len(e) == dim and bool(np.any(np.asarray(e, dtype=float))) for e in pdf["embedding"]]]
    x = np.stack([np.asarray(e, dtype=np.float64) for e in good["embedding"]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = good["id"].to_numpy()
    out = {}
    for i in range(len(ids)):
        s = x @ x[i]
        s[i] = -np.inf
        order = np.lexsort((ids, -np.round(s, 9)))[:k]
        out[int(ids[i])] = [int(j) for j in ids[order] if j != ids[i]]
    return out
