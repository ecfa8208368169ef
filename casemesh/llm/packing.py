"""Filling containers of fixed capacity with items, none divided unless it exceeds the capacity.

Method: large-item matching. Items above a third of the capacity stand at most twice in a container: each is matched, from
the largest on, with the largest other that still fits. Smaller items then go, from the largest on, into the tightest gap.
The plan is made for numbers of items by size, of which there are no more than the capacity, not for single items: a line of
the plan says which ranks of a size go to which containers. It is therefore as small for any number of items.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.llm.tokens import ranked, token_counts
from casemesh.operators.durable import cut

CAPACITY = 4096


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Lines (size, first rank, last rank + 1, first container, items of that size in a container) and the number of containers.

    Its time grows with the number of sizes (times a logarithm), not with that of items.
    """
    lines: list[tuple[int, int, int, int, int]] = []
    left = {s: n for s, n in counts.items() if 0 < s <= capacity and n > 0}
    done = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def put(size: int, n: int, first: int, each: int) -> None:
        lines.append((size, done[size], done[size] + n, first, each))
        done[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    below = list(range(-1, len(large)))  # below[i + 1]: the place of the next size up to large[i] that isn't used up

    def partner_of(bound: int) -> int | None:
        """The largest size up to bound of which items are left."""
        i = bisect_right(large, bound)
        path = []
        while i and not left[large[i - 1]]:
            path.append(i)
            i = below[i] if below[i] < i - 1 else i - 1
        for j in path:
            below[j] = i
        return large[i - 1] if i else None

    for s in reversed(large):
        while left[s]:
            left[s] -= 1  # the item itself is no partner of its own
            partner = partner_of(min(s, capacity - s))
            left[s] += 1
            if partner is None:
                n, gap = left[s], capacity - s
                put(s, n, bins, 1)
            elif partner == s:
                n, gap = left[s] // 2, capacity - 2 * s
                put(s, 2 * n, bins, 2)
            else:
                n, gap = min(left[s], left[partner]), capacity - s - partner
                put(s, n, bins, 1)
                put(partner, n, bins, 1)
            gaps.setdefault(gap, []).append((bins, n))
            bins += n
    # gaps that an item of the present size fits in, tightest first, and those that are still too tight, widest first
    fitting: list[int] = []
    tight = [-g for g in gaps if g]
    heapq.heapify(tight)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):

        def keep(gap: int, first: int, n: int, s: int = s) -> None:
            if gap and n:
                if not gaps.get(gap):
                    heapq.heappush(fitting, gap) if gap >= s else heapq.heappush(tight, -gap)
                gaps.setdefault(gap, []).append((first, n))

        while tight and -tight[0] >= s:
            heapq.heappush(fitting, -heapq.heappop(tight))
        while left[s]:
            while fitting and not gaps.get(fitting[0]):
                heapq.heappop(fitting)
            if not fitting:
                need = -(-left[s] // (capacity // s))
                keep(capacity, bins, need)
                bins += need
            gap = fitting[0]
            first, n = gaps[gap].pop()
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                put(s, full * each, first, each)
                keep(gap - each * s, first, full)
            rest = left[s]
            if full < n and 0 < rest < each:
                put(s, rest, first + full, rest)
                keep(gap - rest * s, first + full, 1)
                full += 1
            if full < n:
                if not gaps[gap]:
                    heapq.heappush(fitting, gap)
                gaps[gap].append((first + full, n - full))
    return lines, bins


def _assign(batches: Iterator[pa.RecordBatch], lines: np.ndarray, before: np.ndarray, bins: int) -> Iterator[pa.RecordBatch]:
    """Looks up each item's line by its place among all items, ordered by size and rank.

    lines: sorted by size and first rank; before: the number of items of smaller sizes, by line. Places are at most as many
    as there are items, whatever the capacity.
    """
    places = before + lines[:, 1]
    sizes, at_size = np.unique(lines[:, 0], return_index=True)
    for batch in batches:
        size, r = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n_tokens", "r"))
        out = r % max(bins, 1)  # items without size take no space, anywhere
        real = size > 0
        if real.any():
            own = before[at_size[np.searchsorted(sizes, size[real])]] + r[real]
            line = lines[np.searchsorted(places, own, side="right") - 1]
            out[real] = line[:, 3] + (r[real] - line[:, 1]) // line[:, 4]
        keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece_no", "token_start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out + 1)], names=["doc_id", "piece_no", "token_start", "n_tokens", "bin_id"])


def filled(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece_no, token_start, n_tokens, bin_id): every page in a container of at most capacity tokens.

    A page over the capacity is divided into full containers and a rest. Pages without tokens take no space and are spread
    over the containers; pages without id are left out. Copies of a row are one page. Containers are numbered from 1.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    sized = token_counts(documents, path)
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int")
    items = sized.select("doc_id", F.col("n_tokens").alias("all"), F.explode(F.sequence(F.lit(0), last)).alias("p")).select(
        "doc_id",
        (F.col("p") + 1).alias("piece_no"),
        (F.col("p").cast("long") * capacity).alias("token_start"),
        F.least(F.lit(capacity).cast("long"), F.col("all") - F.col("p").cast("long") * capacity).alias("n_tokens"),
    )
    items = cut(items)
    # at most one row per size up to the capacity
    counts = {int(r[0]): int(r[1]) for r in items.groupBy("n_tokens").agg(F.count(F.lit(1))).collect()}
    made, bins = plan(counts, capacity)
    lines = np.array(sorted(made), dtype=np.int64).reshape(-1, 5)
    smaller = {s: n for s, n in zip(sorted(counts), np.cumsum([0, *(counts[s] for s in sorted(counts))]), strict=False)}
    before = np.array([smaller[s] for s in lines[:, 0].tolist()], dtype=np.int64)
    order = ranked(items, ["n_tokens"], F.xxhash64("doc_id", "piece_no"), "doc_id", "piece_no")
    return order.select("doc_id", "piece_no", "token_start", "n_tokens", "r").mapInArrow(
        lambda b: _assign(b, lines, before, bins), "doc_id long, piece_no int, token_start long, n_tokens long, bin_id long"
    )


def fill_report(bins: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, tokens, the least number of containers that could hold them, and the part that is used."""
    each = bins.groupBy("bin_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return each.agg(
        F.sum("items").alias("n_items"),
        F.count(F.lit(1)).alias("n_bins"),
        F.sum("used").alias("n_tokens"),
        F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / capacity).cast("long").alias("least_bins"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("fill"),
    )
