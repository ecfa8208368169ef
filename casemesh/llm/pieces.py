"""Cutting oversized texts into pieces under a limit, at natural boundaries, with an overlap.

Method: pointer doubling. Every boundary of every text (and the forced cuts between boundaries that are too far apart) is
joined to its farthest legal successor: the last boundary that a piece can reach which begins with the overlap before it.
The successor tables of a whole batch are then squared: a table of 2**k steps, applied to all cuts known so far, gives
twice as many, so that all greedy cuts of all texts come out in a logarithmic number of array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece at most, and of the overlap of consecutive pieces.
LIMIT, OVERLAP = 2000, 200
#: Signs after which a text may be cut: line ends and sentence ends.
ENDS = "\r\n。！？；"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a cut is natural, after a sign (none within a CRLF), and which characters are signs."""
    sign = np.isin(codes, _codes(ENDS))
    after = np.flatnonzero(sign) + 1
    inner = after[after < len(codes)]
    inner = inner[~((codes[inner - 1] == 13) & (codes[inner] == 10))]
    return inner, sign


def cuts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, ...]:
    """(row, piece_no, start, end, natural) of the pieces of every text; a text within the limit is one piece.

    A forced cut that comes to lie right before a sign, which then begins the next piece, counts as natural: a line or
    sentence ends there as well.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    reach = limit - overlap
    node_pos: list[np.ndarray] = []
    node_nat: list[np.ndarray] = []
    node_next: list[np.ndarray] = []
    sizes = []
    base = 0
    for text in texts:
        codes = _codes(text)
        n = len(codes)
        natural, sign = boundaries(codes)
        stops = np.concatenate([[0], natural, [n]]) if n else np.array([0, 0])
        # forced cuts: where the next boundary is out of reach, a piece ends as late as it can
        gaps = np.diff(stops)
        first = np.where(stops[:-1] == 0, limit, reach)
        extra = np.where(gaps > first, (gaps - first - 1) // reach + 1, 0)
        which = np.repeat(np.arange(len(gaps)), extra)
        step = np.arange(len(which)) - np.repeat(np.cumsum(extra) - extra, extra)
        forced = stops[which] + first[which] + step * reach
        pos = np.concatenate([stops, forced])
        nat = np.concatenate([np.ones(len(stops), bool), np.zeros(len(forced), bool)])
        good = np.concatenate([nat[: len(stops)], sign[forced]])
        order = np.argsort(pos, kind="stable")
        pos, nat, good = pos[order], nat[order], good[order]
        # the farthest natural successor in reach, else the next forced cut
        nat_at = np.flatnonzero(nat)
        far = pos + np.where(pos == 0, limit, reach)
        best = nat_at[np.searchsorted(pos[nat_at], far, side="right") - 1]
        here = np.arange(len(pos))
        nxt = np.where(pos[best] > pos, best, np.minimum(here + 1, len(pos) - 1))
        nxt[-1] = len(pos) - 1
        node_pos.append(pos)
        node_nat.append(good)
        node_next.append(nxt + base)
        sizes.append(len(pos))
        base += len(pos)
    if not texts:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    pos, nat, table = np.concatenate(node_pos), np.concatenate(node_nat), np.concatenate(node_next)
    size = np.array(sizes)
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(texts)), size)
    used = np.zeros(base, dtype=bool)
    used[begin] = True
    while True:
        before = int(used.sum())
        used[table[used]] = True
        if int(used.sum()) == before:
            break
        table = table[table]
    at = np.flatnonzero(used)
    end = at[~np.isin(at, begin) | (size[row[at]] == 1)]
    last = begin + size - 1
    same = pos[last] == pos[begin]  # empty texts have no piece
    end = end[~same[row[end]]]
    which = row[end]
    number = np.arange(len(end)) - np.searchsorted(which, which, side="left")
    starts = np.where(number == 0, 0, np.concatenate([[0], pos[end][:-1]]) - overlap)
    return which, number + 1, np.maximum(starts, 0), pos[end], nat[end]


def _cut_rows(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """(item_table, item_id, text) to pieces with their texts."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for s in range(0, len(texts), 256):
            part = texts[s : s + 256]
            which, number, start, end, natural = cuts(part, limit, overlap)
            at = pa.array(which + s)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array(number.astype(np.int32)),
                    pa.array(start.astype(np.int32)),
                    pa.array(end.astype(np.int32)),
                    pa.array(natural),
                    pa.array([part[w][a:b] for w, a, b in zip(which, start, end, strict=True)], type=pa.string()),
                ],
                names=["item_table", "item_id", "piece_no", "start_pos", "end_pos", "natural", "piece_text"],
            )


def oversized(decisions: DataFrame, chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(item_table, item_id, text) of the items over the limit, each once. Null ids and null texts are none."""
    d = decisions.where(F.col("id").isNotNull() & (F.length("clean_text") > limit))
    c = chunks.where(F.col("id").isNotNull() & (F.length("chunk_text") > limit))
    both = d.select(F.lit("decisions").alias("item_table"), F.col("id").alias("item_id"), F.col("clean_text").alias("text")).unionByName(
        c.select(F.lit("chunks").alias("item_table"), F.col("id").alias("item_id"), F.col("chunk_text").alias("text"))
    )
    return both.dropDuplicates(["item_table", "item_id"])


def pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_table, item_id, piece_no, start_pos, end_pos, natural, piece_text).

    Pieces are numbered from 1, have at most limit characters and begin overlap characters before the end of the one
    before. natural: the piece ends with a line or sentence or with the text. An item within the limit is one piece, an
    empty text none.
    """
    return items.select("item_table", "item_id", "text").mapInArrow(
        lambda b: _cut_rows(b, limit, overlap), "item_table string, item_id long, piece_no int, start_pos int, end_pos int, natural boolean, piece_text string"
    )


def _kind_rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        forced = np.zeros(len(texts), dtype=bool)
        for s in range(0, len(texts), 256):
            which, _, _, _, natural = cuts(texts[s : s + 256], limit, 0)
            forced[s + which[~natural]] = True
        kinds = pa.array(np.where(forced, "forced", "natural"), type=pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kinds], names=["item_table", "item_id", "cut_kind"])


def cut_kinds(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(item_table, item_id, cut_kind): 'forced' for items in which even pieces without overlap can't all end with a line or sentence."""
    return items.select("item_table", "item_id", "text").mapInArrow(lambda b: _kind_rows(b, limit), "item_table string, item_id long, cut_kind string")


def with_citations(cut_pieces: DataFrame, chunks: DataFrame, citations: DataFrame, stretch: int = LIMIT) -> DataFrame:
    """Adds n_citations and citation_ids (ascending): the citations whose match_start lies inside the piece.

    Joined by ruling and stretch of text (best about as long as the pieces), so that a ruling with very many citations meets each of its pieces with few.
    """
    place = chunks.where(F.col("id").isNotNull() & (F.length("chunk_text") > 0)).select(
        F.lit("chunks").alias("item_table"), F.col("id").alias("item_id"), "decision_id", F.coalesce("start_offset", F.lit(0)).alias("offset")
    ).dropDuplicates(["item_table", "item_id"])
    placed = cut_pieces.join(place, ["item_table", "item_id"], "left").withColumns(
        {"ruling": F.when(F.col("item_table") == "decisions", F.col("item_id")).otherwise(F.col("decision_id")), "offset": F.coalesce("offset", F.lit(0))}
    )
    low, high = F.col("start_pos") + F.col("offset"), F.col("end_pos") + F.col("offset")
    spread = placed.select(
        "item_table", "item_id", "piece_no", "ruling", low.alias("low"), high.alias("high"),
        F.explode(F.sequence(F.floor(low / stretch), F.floor((high - 1) / stretch))).alias("stretch"),
    )
    cites = citations.where(F.col("id").isNotNull() & F.col("match_start").isNotNull()).select(
        F.col("source_id").alias("ruling"), F.floor(F.col("match_start") / stretch).alias("stretch"), "match_start", "id"
    )
    inside = spread.join(cites, ["ruling", "stretch"]).where("match_start >= low and match_start < high")
    listed = inside.groupBy("item_table", "item_id", "piece_no").agg(F.sort_array(F.collect_set("id")).alias("citation_ids"))
    return cut_pieces.join(listed, ["item_table", "item_id", "piece_no"], "left").select(
        *cut_pieces.columns,
        F.coalesce(F.size("citation_ids"), F.lit(0)).alias("n_citations"),
        F.coalesce("citation_ids", F.array().cast("array<bigint>")).alias("citation_ids"),
    )
