"""Chunks around citations, and joining intervals that overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemesh.parse import chunks as K


def merged_intervals(items: DataFrame, *owner: str) -> DataFrame:
    """From (owner..., id, start, end) adds run, run_start, run_end: overlapping intervals of an owner make one run.

    Intervals that only touch stay apart. Runs are numbered from 0 by start.
    """
    order = Window.partitionBy(*owner).orderBy("start", "end", "id")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = items.withColumn("new", F.when(before.isNull(), 0).when(F.col("start") >= before, 1).otherwise(0))
    runs = flagged.withColumn("run", F.sum("new").over(order)).drop("new")
    whole = Window.partitionBy(*owner, "run")
    return runs.withColumns({"run_start": F.min("start").over(whole), "run_end": F.max("end").over(whole)})


_BOUND = "decision_id long, id long, start long, end long"
_CHUNK = "decision_id long, citation_id long, chunk_index long, start_offset long, end_offset long, chunk_text string"


def _bounds(batch: pa.RecordBatch) -> Iterator[tuple[int, str, list[int], list[tuple[int, int]]]]:
    """(decision_id, clean_text, cites) to each ruling's id and text, its citations' ids and the bounds of their chunks."""
    owners, texts, cites = (batch.column(i) for i in range(3))
    flat = cites.flatten()
    fields = {flat.type.field(i).name: flat.field(i).to_pylist() for i in range(flat.type.num_fields)}
    spans = list(zip(*(fields[k] for k in ("match_start", "match_end", "head", "length")), strict=True))
    edges = [0, *np.cumsum(np.diff(cites.offsets.to_numpy())).tolist()]
    for owner, text, a, b in zip(owners.to_pylist(), texts.to_pylist(), edges[:-1], edges[1:], strict=True):
        cuts = K.Cuts(text)
        yield owner, text, fields["id"][a:b], [cuts.bound(*cuts.span(*s)) for s in spans[a:b]]


def _bound_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bounds of every citation's chunk."""
    for batch in batches:
        rows = [(owner, i, *bound) for owner, _, ids, found in _bounds(batch) for i, bound in zip(ids, found, strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["decision_id", "id", "start", "end"])


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunk of every citation, a ruling at a time."""
    for batch in batches:
        for owner, text, ids, found in _bounds(batch):
            run, first, last = K.runs(*np.array(found, dtype=np.int64).reshape(-1, 2).T)
            parts = {(s, e): text[s:e] for s, e in zip(first.tolist(), last.tolist(), strict=True)}
            columns = [np.repeat(owner, len(ids)), np.array(ids, dtype=np.int64), run, first, last]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array([parts[k] for k in zip(first.tolist(), last.tolist(), strict=True)], type=pa.string())],
                names=["decision_id", "citation_id", "chunk_index", "start_offset", "end_offset", "chunk_text"],
            )


_PLACED = "match_start is not null and match_end is not null"


def _cite() -> Column:
    """A citation (id, match_start, match_end, snippet) as it travels: of a snippet only the head and the length."""
    return F.struct("id", "match_start", "match_end", F.substring("snippet", 1, K.HEAD_SIGNS).alias("head"), F.coalesce(F.length("snippet"), F.lit(0)).alias("length"))


def _cited(decisions: DataFrame, citations: DataFrame) -> DataFrame:
    """Rulings (decision_id, clean_text) with their cites. Citations without offsets and rulings without text give no chunks."""
    cites = citations.where(f"{_PLACED} and source_id is not null").groupBy(F.col("source_id").alias("decision_id")).agg(F.collect_list(_cite()).alias("cites"))
    texts = decisions.where("clean_text is not null").select(F.col("id").alias("decision_id"), "clean_text")
    return texts.join(cites, "decision_id").select("decision_id", "clean_text", "cites")


def chunk_bounds(decisions: DataFrame, citations: DataFrame) -> DataFrame:
    """(decision_id, id, start, end): a chunk's bounds around each citation (id) of a ruling with text."""
    return _cited(decisions, citations).mapInArrow(_bound_rows, _BOUND)


def bounds_of_cited(texts: DataFrame) -> DataFrame:
    """(id, start, end): the same of texts with one citation each, in rows of (id, clean_text, match_start, match_end, snippet).

    Row by row: no text travels to its citation, and rows may share an id.
    """
    rows = texts.where(f"clean_text is not null and {_PLACED}").select(F.col("id").alias("decision_id"), "clean_text", F.array(_cite()).alias("cites"))
    return rows.mapInArrow(_bound_rows, _BOUND).select("id", "start", "end")


def chunk_rows(decisions: DataFrame, citations: DataFrame) -> DataFrame:
    """One row per citation (decision_id, citation_id, chunk_index, start_offset, end_offset, chunk_text); overlapping chunks are one."""
    return _cited(decisions, citations).mapInArrow(_chunk_rows, _CHUNK)


def rebuilt(chunks: DataFrame, decisions: DataFrame, citations: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """Chunks after a rebuild of all rulings or of those of a month (by decision_date); the others' chunks stay.

    New chunks have the columns of chunk_rows, and a null embedding and id where the old ones have them.
    """
    part = decisions
    if year is not None and month is not None:
        first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
        part = decisions.where((F.col("decision_date") >= first) & (F.col("decision_date") < F.add_months(first, 1)))
    made = chunk_rows(part.select("id", "clean_text"), citations.select("id", "source_id", "match_start", "match_end", "snippet"))
    targets = citations.select(F.col("id").alias("citation_id"), "target_id", "target_authority_id") if "target_id" in citations.columns else None
    made = made.join(targets, "citation_id", "left") if targets is not None else made
    kept = chunks.join(part.select(F.col("id").alias("decision_id")), "decision_id", "left_anti") if part is not decisions else chunks.limit(0)
    shown = [F.col(c).cast(f.dataType).alias(c) if c in made.columns else F.lit(None).cast(f.dataType).alias(c) for c, f in ((f.name, f) for f in chunks.schema)]
    return kept.select(*chunks.columns).unionByName(made.select(*shown))


def chunk_quality(chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: chunks, those with their citation inside, those with the snippet's first 80 signs inside, and lengths."""
    c = citations.select(F.col("id").alias("citation_id"), "match_start", "match_end", "snippet")
    j = chunks.join(c, "citation_id")
    inside = (F.col("start_offset") <= F.col("match_start")) & (F.col("match_end") <= F.col("end_offset"))
    said = F.col("chunk_text").contains(F.substring("snippet", 1, 80))
    size = F.length("chunk_text")
    return j.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_if(inside).alias("n_citation_inside"), F.count_if(said).alias("n_snippet_inside"),
        F.min(size).cast("long").alias("min_chars"), F.max(size).cast("long").alias("max_chars"), F.round(F.avg(size), 4).alias("avg_chars"),
    )
