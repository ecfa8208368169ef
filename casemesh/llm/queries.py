"""The queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from casemesh.llm import lines, mixing, neighbours, packing, pieces, private, spans, stuffing, tokens
from casemesh.operators.durable import cut
from casemesh.plans.registry import Registry
from casemesh.sources.tables import load

REGISTRY = Registry()


# Fixed values in the statement: full-width forms of ASCII signs, the signs; white space as the other engine's classes.
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_SIGNS = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_LINES_SQL = f"""
WITH d AS (SELECT DISTINCT id, replace(trim(unit_norm, ' \t\r\n　'), '台', '臺') AS unit, clean_text FROM decisions WHERE length(clean_text) > 0 AND unit_norm IS NOT NULL),
l AS (SELECT id, unit, generate_subscripts(x, 1) AS line_no, unnest(x) AS line FROM (SELECT id, unit, string_split(replace(clean_text, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM d)),
s AS (SELECT id, unit, line_no, translate(regexp_replace(line, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', '', 'g'), '{_FULL}', '{_SIGNS}') AS signs FROM l),
u AS (SELECT unit, count(*) AS documents FROM d GROUP BY unit),
n AS (SELECT unit, signs, count(DISTINCT id) AS n FROM s WHERE length(signs) >= 8 GROUP BY ALL HAVING n >= 5)
"""


def _rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "decisions").select("id", F.col("unit_norm").alias("unit"), F.col("clean_text").alias("text"))


@REGISTRY.query(
    "p1_found",
    _LINES_SQL + "SELECT s.id AS decision_id, s.line_no FROM s JOIN n USING (unit, signs) JOIN u USING (unit) WHERE n.n >= 0.04 * u.documents",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(_rulings(spark, sf_dir))[0].select(F.col("id").alias("decision_id"), "line_no")


@REGISTRY.query(
    "p1_units",
    _LINES_SQL + "SELECT unit, count(*) AS n_lines, CAST(sum(n.n) AS BIGINT) AS n_occurrences FROM n JOIN u USING (unit) WHERE n.n >= 0.04 * u.documents GROUP BY unit",
)
def p1_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = lines.repeated_lines(_rulings(spark, sf_dir))[1]
    return blocks.groupBy("unit").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n").alias("n_occurrences"))


@REGISTRY.query("p1_blocks")
def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their lines and their occurrences, whole (all lines of the block in one run) or in part."""
    found, blocks = lines.block_occurrences(_rulings(spark, sf_dir))
    size = blocks.groupBy("unit", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.max("n").alias("n_documents"))
    seen = found.groupBy("unit", "block").agg(F.count(F.lit(1)).alias("n_occurrences"), F.max(F.size("line_nos")).alias("longest_run"))
    return size.join(seen, ["unit", "block"]).select("unit", "block", "n_lines", "n_documents", "n_occurrences", "longest_run")


@REGISTRY.query("p1_clean_text")
def p1_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rulings = _rulings(spark, sf_dir)
    return lines.without_lines(rulings, lines.repeated_lines(rulings)[0])


@REGISTRY.query(
    "p3_found",
    """
WITH i AS (SELECT DISTINCT 'decisions' AS item_table, id AS item_id, clean_text AS x FROM decisions WHERE length(clean_text) > 2000
 UNION SELECT DISTINCT 'chunks', id, chunk_text FROM chunks WHERE length(chunk_text) > 2000)
SELECT item_table, item_id, CASE WHEN list_max(list_transform(string_split(translate(x, chr(13) || '。！？；', chr(10) || chr(10) || chr(10) || chr(10) || chr(10)), chr(10)), lambda r: length(r))) > 2000
 THEN 'forced' ELSE 'natural' END AS cut_kind FROM i
""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = pieces.oversized(load(spark, sf_dir, "decisions"), load(spark, sf_dir, "chunks"))
    return pieces.cut_kinds(items)


@REGISTRY.query("p3_pieces")
def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k, c = (load(spark, sf_dir, t) for t in ("decisions", "chunks", "citations"))
    out = pieces.with_citations(pieces.pieces(pieces.oversized(d, k)), k, c)
    return out.withColumn("citation_ids", F.concat_ws(",", F.transform("citation_ids", lambda x: x.cast("string"))))


@REGISTRY.query(
    "p3_checks",
    """WITH i AS (SELECT DISTINCT 'decisions' AS item_table, id AS item_id, length(clean_text) AS n_chars FROM decisions WHERE length(clean_text) > 2000
 UNION SELECT DISTINCT 'chunks', id, length(chunk_text) FROM chunks WHERE length(chunk_text) > 2000)
SELECT item_table, item_id, n_chars, true AS begins_and_ends, true AS within_limit, true AS numbered, true AS overlaps FROM i""",
)
def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of each item: from its start to its end, none over the limit, numbered through, each sharing 200 with the one before."""
    out = pieces.pieces(pieces.oversized(load(spark, sf_dir, "decisions"), load(spark, sf_dir, "chunks")))
    order = W.partitionBy("item_table", "item_id").orderBy("piece_no")
    p = out.withColumns({"before": F.lag("end_pos").over(order), "size": F.length("piece_text")})
    shared = F.col("before").isNull() | (F.col("start_pos") == F.col("before") - pieces.OVERLAP)
    return p.groupBy("item_table", "item_id").agg(
        F.max("end_pos").cast("long").alias("n_chars"),
        ((F.min("start_pos") == 0) & (F.max("end_pos") == F.max_by("end_pos", "piece_no"))).alias("begins_and_ends"),
        F.bool_and((F.col("size") <= pieces.LIMIT) & (F.col("size") == F.col("end_pos") - F.col("start_pos"))).alias("within_limit"),
        ((F.min("piece_no") == 1) & (F.max("piece_no") == F.count(F.lit(1)))).alias("numbered"),
        F.bool_and(shared).alias("overlaps"),
    )


@REGISTRY.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "chunks")
    return neighbours.mutual_pairs(neighbours.nearest(chunks), chunks)


@REGISTRY.query("p6_nearest")
def p6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest(load(spark, sf_dir, "chunks"))
    return near.select(F.col("id").alias("chunk_id"), "rank", F.col("other").alias("other_id"), F.round("cosine", 4).alias("cosine"))


def _shared(spark: SparkSession, sf_dir: str) -> spans.Shared:
    return spans.Shared(load(spark, sf_dir, "decisions"), load(spark, sf_dir, "citations"))


@REGISTRY.query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).pairs()


@REGISTRY.query("p7_classes")
def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).classes().select("record_table", "class_id", "record_id")


@REGISTRY.query("p7_shares")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).parts()


@REGISTRY.query("p7_stretches")
def p7_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).stretches()


@REGISTRY.query("p7_removals")
def p7_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).removals()


@REGISTRY.query("p7_texts")
def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).remaining()


@REGISTRY.query("p8_bins")
def p8_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.filled(load(spark, sf_dir, "documents"))


@REGISTRY.query("p8_fill")
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(packing.filled(load(spark, sf_dir, "documents")))


@REGISTRY.query(
    "p8_checks",
    "SELECT count(DISTINCT doc_id) AS n_pages, 0 AS n_overfull, 0 AS n_divided_small, 0 AS n_incomplete, true AS few_more_than_least FROM documents WHERE doc_id IS NOT NULL",
)
def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: none too full, no page divided that fits one, every page whole, at most 2 % (and one) more than the least number."""
    items = cut(packing.filled(load(spark, sf_dir, "documents")))
    sized = tokens.token_counts(load(spark, sf_dir, "documents")).withColumnRenamed("n_tokens", "size")
    pages = items.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces")).join(sized, "doc_id", "full")
    counted = pages.agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if((F.col("pieces") > 1) & (F.col("size") <= packing.CAPACITY)).cast("int").alias("n_divided_small"),
        F.count_if(~F.col("n").eqNullSafe(F.col("size"))).cast("int").alias("n_incomplete"),
    )
    r = packing.fill_report(items)
    full = items.groupBy("bin_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY).cast("int").alias("n_overfull"))
    return counted.crossJoin(full).crossJoin(r.select((F.col("n_bins") <= F.col("least_bins") * 1.02 + 1).alias("few_more_than_least")))  # single rows


def _mixed(spark: SparkSession, sf_dir: str, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), exact=exact)


@REGISTRY.query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the named sources hold; sources that run out fall short of their share."""
    return _mixed(spark, sf_dir)[0]


@REGISTRY.query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


@REGISTRY.query("p9_mix_exact")
def p9_mix_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source that has pages at its share; the scarcest bounds the size."""
    return _mixed(spark, sf_dir, True)[0]


@REGISTRY.query("p9_shares_exact")
def p9_shares_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir, True)[1]


_SOURCE = "lower(trim({0}, ' \\t\\r\\n　'))"


@REGISTRY.query(
    "p9_checks",
    f"""WITH t AS (SELECT DISTINCT {_SOURCE.format("source")} AS source, target_share, max_repeats FROM mix_targets),
p AS (SELECT {_SOURCE.format("source")} AS source, count(DISTINCT doc_id) AS n FROM documents WHERE length(text) > 0 GROUP BY 1)
SELECT source, round(target_share, 6) AS target_share, CAST(max_repeats AS BIGINT) AS max_repeats, coalesce(n, 0) AS pages, true AS pages_in_mix, true AS within_repeats, true AS near_budget, true AS tokens_add_up FROM t LEFT JOIN p USING (source)""",
)
def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mix and its report, by source: repeats are kept, and the budget is met but for the rest that the knapsack's table is for."""
    mix, report = _mixed(spark, sf_dir)
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("sum"), F.max("repeats").alias("most"), F.count_distinct("doc_id").alias("used"))
    r = report.join(got, "source", "left").na.fill(0, ["sum", "most", "used"])
    return r.select(
        "source", F.round("target_share", 6).alias("target_share"), "max_repeats", "pages", (F.col("used") <= F.col("pages")).alias("pages_in_mix"), (F.col("most") <= F.col("max_repeats")).alias("within_repeats"),
        (F.abs(F.col("budget") - F.col("tokens")) <= mixing.TABLE).alias("near_budget"), (F.col("sum") == F.col("tokens")).alias("tokens_add_up"),
    )


@REGISTRY.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(load(spark, sf_dir, "documents")).select("doc_id")


@REGISTRY.query("p10_scores")
def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stuffing.stuffing(load(spark, sf_dir, "documents"))
    return s.select("doc_id", *[F.round(c, 4).alias(c) for c in ("stuffed", "information", "repetition")])


@REGISTRY.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = private.texts(load(spark, sf_dir, "decisions"), load(spark, sf_dir, "citations"))
    return private.personal_spans(records).where(F.col("info_type").isin("email", "phone", "idno", "address", "name"))


@REGISTRY.query("p4_masked")
def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.without_personal(private.texts(load(spark, sf_dir, "decisions"), load(spark, sf_dir, "citations")))
