"""Joining rows with marks of their keys, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which marks are broadcast, at MARK_BYTES a row. Above, only keys with at least 1/HEAVY of the rows are: at most so many.
BROADCAST_BYTES, MARK_BYTES, HEAVY = 16 << 20, 80, 200


def marked(rows: DataFrame, marks: DataFrame, keys: list[str], n_marks: int, total: int) -> DataFrame:
    """Inner join of rows with the marks of their keys, each key once, with the number of its rows as n_rows (which is dropped).

    total: the number of rows, or more. No key that is shuffled has more than 1/HEAVY of the rows.
    """
    if n_marks * MARK_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(marks.drop("n_rows")), keys)
    is_heavy = F.col("n_rows") * HEAVY >= F.lit(max(total, 1))
    heavy, light = marks.where(is_heavy).drop("n_rows"), marks.where(~is_heavy).drop("n_rows")
    few = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return few.unionByName(rest)
