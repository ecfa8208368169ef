"""Lines that recur among the documents of one unit (a court, a web site) and are no part of their text.

Method: the lines of a unit are the nodes of a graph, the weight of a node is the number of documents that have the line.
Nodes with high support are kept; two kept lines that follow one another in a document, whatever else stands between them,
are an edge, kept if its own support is high. The connected components are the boilerplate blocks. A block's occurrences in
a document are runs of its lines, and what is removed are the lines of these occurrences.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from casemesh.functions.plain import squeezed, stripped
from casemesh.llm.joins import marked
from casemesh.operators.durable import cut

#: A line is boilerplate from so many characters, documents and share of its unit's documents.
MIN_CHARS, MIN_DOCUMENTS, MIN_SHARE = 8, 5, 0.04


def unit_of(c: Column) -> Column:
    """A unit's name as it is compared."""
    return F.translate(stripped(c), "台", "臺")


def _lines(documents: DataFrame) -> DataFrame:
    """(id, unit, line_no, h1, h2) of the lines that are long enough. h1 and h2 are hashes of the unit and the line's signs."""
    each = documents.where(F.col("id").isNotNull() & (F.length("text") > 0) & F.col("unit").isNotNull()).select(
        "id", unit_of(F.col("unit")).alias("unit"), F.posexplode(F.split("text", "\r?\n")).alias("p", "line")
    )
    signs = each.select("id", "unit", (F.col("p") + 1).cast("long").alias("line_no"), squeezed(F.col("line")).alias("signs"))
    return signs.where(F.length("signs") >= MIN_CHARS).select(
        "id", "unit", "line_no", F.xxhash64("unit", "signs").alias("h1"), F.xxhash64("signs", F.lit(7), "unit").alias("h2")
    )


def _support(lines: DataFrame, *key: str) -> DataFrame:
    """Documents by key. Grouping by key and document first keeps a line of very many documents from one task."""
    return lines.groupBy(*key, "id").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


def _blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """(unit, h1, h2, n, edge, n1, n2): a unit's nodes and edges, to nodes with the block's smallest node.

    A unit has at most (mean lines of its documents / MIN_SHARE) nodes and edges, so this never is much.
    """
    at = {}
    nodes = pdf[~pdf["edge"]]
    keys = list(zip(nodes["h1"], nodes["h2"], strict=True))
    for i, k in enumerate(keys):
        at[k] = i
    parent = list(range(len(keys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = pdf[pdf["edge"]]
    for a1, a2, b1, b2 in zip(edges["h1"], edges["h2"], edges["n1"], edges["n2"], strict=True):
        a, b = at.get((a1, a2)), at.get((b1, b2))
        if a is not None and b is not None:
            parent[root(a)] = root(b)
    smallest: dict[int, int] = {}
    for i, k in enumerate(keys):
        smallest[root(i)] = min(k[0], smallest.get(root(i), k[0]))
    return pd.DataFrame(
        {"unit": nodes["unit"].to_numpy(), "h1": nodes["h1"].to_numpy(), "h2": nodes["h2"].to_numpy(), "n": nodes["n"].to_numpy(), "block": [smallest[root(i)] for i in range(len(keys))]}
    )


def block_occurrences(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (id, unit, text): occurrences (id, unit, block, run, line_nos) of boilerplate blocks, and their lines (unit, h1, h2, n, block).

    Each document counts once for a line and for its unit, however often it was delivered. Documents without id, unit or
    text take no part and keep their lines; an empty table gives no rows. Lines are split and hashed once.
    """
    lines = cut(_lines(documents))
    sizes = (
        documents.where(F.col("id").isNotNull() & (F.length("text") > 0) & F.col("unit").isNotNull())
        .select("id", unit_of(F.col("unit")).alias("unit"))
        .distinct()
        .groupBy("unit")
        .agg(F.count(F.lit(1)).alias("documents"))
    )
    enough = _support(lines, "unit", "h1", "h2").where(F.col("n") >= MIN_DOCUMENTS)
    strong = F.col("n") >= F.lit(MIN_SHARE) * F.col("documents")
    nodes = cut(enough.join(sizes, "unit").where(strong).select("unit", "h1", "h2", "n", "documents"))
    n, total = nodes.count(), lines.count()
    hits = cut(marked(lines, nodes.select("h1", "h2", F.col("n").alias("n_rows")), ["h1", "h2"], n, total).select("id", "unit", "line_no", "h1", "h2").distinct())
    within = W.partitionBy("id", "unit").orderBy("line_no")
    follow = hits.withColumns({"n1": F.lead("h1").over(within), "n2": F.lead("h2").over(within)}).where("n1 is not null and n2 is not null")
    edges = _support(follow, "unit", "h1", "h2", "n1", "n2").join(sizes, "unit").where(strong & (F.col("n") >= MIN_DOCUMENTS))
    zero = F.lit(0).cast("long")
    graph = nodes.select("unit", "h1", "h2", "n", F.lit(False).alias("edge"), zero.alias("n1"), zero.alias("n2")).unionByName(
        edges.select("unit", "h1", "h2", "n", F.lit(True).alias("edge"), "n1", "n2")
    )
    blocks = cut(graph.groupBy("unit").applyInPandas(_blocks, "unit string, h1 long, h2 long, n long, block long"))
    of_block = marked(hits, blocks.select("h1", "h2", "block", F.col("n").alias("n_rows")), ["h1", "h2"], n, total)
    new = F.coalesce(F.lag("block").over(within) != F.col("block"), F.lit(True)).cast("int")
    runs = of_block.withColumn("new", new).withColumn("run", F.sum("new").over(within))
    # a run has no more lines than its document
    return runs.groupBy("id", "unit", "block", "run").agg(F.array_sort(F.collect_list("line_no")).alias("line_nos")), blocks


def repeated_lines(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines (id, unit, line_no, block) of all occurrences of boilerplate blocks, and the blocks' lines; see block_occurrences."""
    found, blocks = block_occurrences(documents)
    return found.select("id", "unit", F.explode("line_nos").alias("line_no"), "block"), blocks


def without_lines(documents: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(id, text, removed_lines): every document without its boilerplate lines, the line ends of the others unchanged.

    Documents of which nothing is removed come out as they are, those without text with a null text; copies of a row once.
    """
    drop = occurrences.groupBy("id").agg(F.sort_array(F.collect_set("line_no")).alias("drop"))
    kept = documents.select("id", "text").dropDuplicates(["id"]).join(drop, "id", "left")
    parts = F.split("text", "(?<=\n)")
    keep = F.filter(parts, lambda x, i: ~F.array_contains("drop", (i + 1).cast("long")))
    return kept.select(
        "id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(keep, "")).alias("text"), F.coalesce(F.size("drop"), F.lit(0)).alias("removed_lines")
    )
