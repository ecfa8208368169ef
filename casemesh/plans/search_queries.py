"""Queries on recall, pair windows, ranking and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.functions.plain import stripped
from casemesh.operators import extract as E
from casemesh.operators import preview as V
from casemesh.operators import ranking as R
from casemesh.operators import recall as P
from casemesh.operators import windows as Wd
from casemesh.operators.durable import cut
from casemesh.operators.recall import SearchSpec, StatuteFilter
from casemesh.plans.graph_queries import PRE, tables, thin
from casemesh.plans.registry import Registry
from casemesh.sources.tables import load

REGISTRY = Registry()
q = REGISTRY.query

BROAD = SearchSpec(("過失比例",))
SPEC = SearchSpec(("過失比例", "舉證責任"), (StatuteFilter("民法"),))
WITHOUT = SearchSpec(("過失比例",), (), ("保險契約",), (StatuteFilter("刑法"),), ("民事", "刑事"))
#: A ruling and an authority that are cited in every data set.
RULING, AUTHORITY = 1, 1

_LAW = "trim(law, ' \\t　')"
_ST = f"(SELECT DISTINCT citation_id, {_LAW} AS law, article_raw, nullif(sub_ref, '') AS sub_ref FROM s)"
_UID = """, e AS (SELECT c.*, CASE WHEN c.target_id IS NOT NULL THEN 'decision:' || coalesce(t.canonical_id, c.target_id) WHEN c.target_authority_id IS NOT NULL THEN 'authority:' || c.target_authority_id END AS target_uid
FROM c LEFT JOIN d t ON c.target_id = t.id WHERE c.target_id IS NOT NULL OR c.target_authority_id IS NOT NULL)"""
_WIN = f"""{_UID}, f AS (SELECT source_id, target_uid, trim(snippet, ' \\t\\r\\n　') AS said, min(id) AS id FROM e WHERE trim(snippet, ' \\t\\r\\n　') <> '' GROUP BY ALL),
f8 AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_uid ORDER BY id, said) AS rn FROM f),
wt AS (SELECT source_id, target_uid, string_agg(said, chr(10) ORDER BY rn) AS window_text FROM f8 WHERE rn <= 8 GROUP BY ALL),
ps AS (SELECT DISTINCT source_id, target_uid, x.law, x.article_raw, x.sub_ref FROM e JOIN {_ST} x ON x.citation_id = e.id),
w AS (SELECT g.*, coalesce(window_text, '') AS window_text FROM (SELECT source_id, target_uid, count(*) AS merged_citation_count FROM e GROUP BY ALL) g LEFT JOIN wt USING (source_id, target_uid))"""


def _has(spec: SearchSpec, column: str = "clean_text") -> str:
    parts = [f"contains({column}, '{k}')" for k in spec.keywords] + [f"NOT contains({column}, '{k}')" for k in spec.exclude_keywords]
    if spec.case_types:
        parts.append("case_type IN (" + ", ".join(f"'{t}'" for t in spec.case_types) + ")")
    return " AND ".join(parts)


def _met(f: StatuteFilter, alias: str, exact: bool) -> str:
    out = f"{alias}.law = '{f.law}'"
    if f.article:
        out += f" AND {alias}.article_raw = '{f.article}'"
    if f.sub_ref:
        out += f" AND {alias}.sub_ref = '{f.sub_ref}'" if exact else f" AND starts_with({alias}.sub_ref, '{f.sub_ref}')"
    return out


def _recall(spec: SearchSpec, name: str = "r", exact: bool = False) -> str:
    sql = f", {name} AS (SELECT id AS source_id FROM d WHERE {_has(spec)}"
    for filters, how in ((spec.statutes, "IN"), (spec.exclude_statutes, "NOT IN")):
        for f in filters:
            sql += f" AND id {how} (SELECT c.source_id FROM c JOIN {_ST} x ON x.citation_id = c.id WHERE {_met(f, 'x', exact)} AND c.source_id IS NOT NULL)"
    return sql + ")"


def _count(spec: SearchSpec) -> str:
    parts = [f"CAST(contains(w.window_text, '{k}') AS INT)" for k in spec.keywords]
    parts += [f"CAST(EXISTS (SELECT 1 FROM ps WHERE ps.source_id = w.source_id AND ps.target_uid = w.target_uid AND {_met(f, 'ps', False)}) AS INT)" for f in spec.statutes]
    return " + ".join(parts)


def _steps(spec: SearchSpec, recall: SearchSpec, enough: int = R.ENOUGH) -> str:
    levels = len(spec.keywords) + len(spec.statutes)
    return (
        _WIN + _recall(recall) + f""", m AS (SELECT w.source_id, w.target_uid, {_count(spec)} AS match_count FROM w WHERE w.source_id IN (SELECT source_id FROM r)),
b AS (SELECT target_uid, max(match_count) AS reached FROM m GROUP BY 1),
lv AS (SELECT coalesce(max(l), 0) AS cut FROM range(0, {levels + 1}) x(l) WHERE (SELECT count(*) FROM b WHERE reached >= l) >= {enough}),
o AS (SELECT m.*, row_number() OVER (PARTITION BY target_uid ORDER BY match_count DESC, source_id) AS rn FROM m WHERE match_count >= (SELECT cut FROM lv)),
st AS (SELECT b.target_uid, b.reached, string_agg(CAST(o.source_id AS VARCHAR), ',' ORDER BY rn) AS previews FROM b JOIN o USING (target_uid) WHERE b.reached >= (SELECT cut FROM lv) AND rn <= 5 GROUP BY ALL)"""
    )


_RANKED = """, lvl(name, n) AS (VALUES ('憲法法庭', 0), ('最高法院', 1), ('最高行政法院', 1), ('高等法院', 2), ('高等行政法院', 2), ('智慧財產法院', 2), ('高等行政法院地方庭', 3), ('地方法院', 3), ('少年及家事法院', 3), ('簡易庭', 4)),
rec AS (SELECT 'decision:' || id AS target_uid, coalesce(canonical_doc_type, doc_type) AS doc_type, display_title, root_norm, coalesce(total_citation_count, 0) AS total FROM d
UNION ALL SELECT 'authority:' || id, doc_type, coalesce(display, ref_key), root_norm, coalesce(total_citation_count, 0) FROM authorities),
mt AS (SELECT target_uid, count(DISTINCT source_id) AS matched FROM e WHERE source_id IN (SELECT source_id FROM r) GROUP BY 1),
rk AS (SELECT st.target_uid, rec.doc_type, rec.display_title, lvl.n AS court_level, coalesce(mt.matched, 0) AS matched, rec.total, st.reached, st.previews FROM st JOIN rec USING (target_uid) LEFT JOIN lvl ON lvl.name = rec.root_norm LEFT JOIN mt USING (target_uid))
"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Citations without texts of their own but the snippet, rulings without texts, and statutes."""
    c = thin(spark, sf_dir, "citations", "source_id", "target_id", "target_canonical_id", "target_authority_id", "snippet")
    d = thin(spark, sf_dir, "decisions", "canonical_id", "canonical_doc_type", "doc_type", "display_title", "root_norm", "total_citation_count")
    return c, d, tables(spark, sf_dir, "citation_snippet_statutes")[0]


def _sources(spark: SparkSession, sf_dir: str, spec: SearchSpec, exact: bool = False, any_case: bool = False) -> DataFrame:
    c = load(spark, sf_dir, "citations").select("id", "source_id").distinct()
    return P.recalled(load(spark, sf_dir, "decisions"), c, tables(spark, sf_dir, "citation_snippet_statutes")[0], spec, exact, any_case=any_case)


# --- recall ----------------------------------------------------------------------------------------------------------

for _name, _spec in (
    ("kw_contains", BROAD),
    ("recall_and", SearchSpec(("過失比例", "舉證責任"))),
    ("recall_exclude", WITHOUT),
    ("recall_case_type", SearchSpec(("過失比例",), case_types=("行政",))),
    ("recall_statute", SearchSpec(("損害賠償",), (StatuteFilter("民法"), StatuteFilter("刑法")))),
    ("recall_statute_prefix", SearchSpec(("法院",), (StatuteFilter("民法", None, "第1項"),))),
    ("recall_sources", SPEC),
):
    q(_name, PRE + _recall(_spec) + "SELECT source_id FROM r")(lambda spark, sf_dir, spec=_spec: _sources(spark, sf_dir, spec))

_BASE = SearchSpec(("過失比例",), (StatuteFilter("公司法", None, "第1項"),), ("股份憑證",))
_BASE_SQL = _recall(_BASE, exact=True).replace("contains(clean_text, '過失比例')", "clean_text ILIKE '%過失比例%'").replace("NOT contains(clean_text, '股份憑證')", "clean_text NOT ILIKE '%股份憑證%'")


@q("recall_baseline", PRE + _BASE_SQL + "SELECT source_id FROM r WHERE source_id IN (SELECT source_id FROM c)")
def recall_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline: keywords whatever their case, exact parts, and only rulings that cite something."""
    return _sources(spark, sf_dir, _BASE, True, True).join(load(spark, sf_dir, "citations").select("source_id").distinct(), "source_id", "left_semi")


@q("recall_any_case", PRE + "SELECT DISTINCT id AS source_id FROM d WHERE clean_text ILIKE '%rd.%' AND clean_text NOT ILIKE '%no. 3%'")
def recall_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keyword_hits(load(spark, sf_dir, "decisions"), SearchSpec(("RD.",), (), ("NO. 3",)), True).select("source_id")


@q("recall_own_statutes")
def recall_own_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes of the rulings' own texts instead of those that they cite."""
    d = load(spark, sf_dir, "decisions")
    own = E.ruling_statutes(d)
    return P.recalled(d, load(spark, sf_dir, "citations"), tables(spark, sf_dir, "citation_snippet_statutes")[0], P.checked(SPEC), own=own)


@q("norm_filters", "SELECT * FROM (VALUES (0, '民事訴訟法', '447', NULL), (1, '民法', NULL, NULL), (2, '勞動基準法', '14', '第1項')) t(position, law, article, sub_ref)")
def norm_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.normal_filters([StatuteFilter("民訴法", "447"), StatuteFilter(" 民法"), StatuteFilter("民事訴訟法", "447"), StatuteFilter("勞基法", "14", "第1項")])
    return spark.createDataFrame([(i, x.law, x.article, x.sub_ref) for i, x in enumerate(f)], "position int, law string, article string, sub_ref string")


@q("norm_terms", "SELECT * FROM (VALUES (0, '過失比例'), (1, '舉證責任')) t(position, term)")
def norm_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(P.normal_terms([" 過失比例", "", "舉證責任 ", "過失比例", "  "]))), "position int, term string")


@q("snippet_pool", PRE + "SELECT id, length(snippet) AS n_chars FROM c WHERE snippet IS NOT NULL AND length(snippet) > 50")
def snippet_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "citations").where("id is not null and length(snippet) > 50").select("id", F.length("snippet").cast("long").alias("n_chars")).distinct()


# --- pair windows ----------------------------------------------------------------------------------------------------


@q("target_uid", PRE + _UID + "SELECT id, source_id, target_uid FROM e")
def target_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, d, _ = _graph(spark, sf_dir)
    return Wd.with_target_uid(c.drop("snippet"), d).select("id", "source_id", "target_uid")


@q("pair_windows", PRE + _WIN + "SELECT * FROM w")
def pair_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, d, _ = _graph(spark, sf_dir)
    return Wd.pair_windows(Wd.with_target_uid(c, d))


_FLAT = "law || '§' || article_raw || '§' || coalesce(sub_ref, '')"


def _flat(statutes: str = "statutes"):
    return F.array_join(F.array_sort(F.transform(statutes, lambda s: F.concat_ws("§", s["law"], s["article_raw"], F.coalesce(s["sub_ref"], F.lit(""))))), "|")


@q("pair_statutes", PRE + _WIN + f"SELECT source_id, target_uid, string_agg({_FLAT}, '|' ORDER BY {_FLAT} COLLATE \"binary\") AS statutes FROM ps GROUP BY ALL".replace(' COLLATE "binary"', ""))
def pair_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, d, s = _graph(spark, sf_dir)
    return Wd.pair_statutes(Wd.with_target_uid(c.drop("snippet"), d), s).withColumn("statutes", _flat())


@q("source_statutes", PRE + f"SELECT source_id, string_agg({_FLAT}, '|' ORDER BY {_FLAT}) AS statutes FROM (SELECT DISTINCT c.source_id, x.law, x.article_raw, x.sub_ref FROM c JOIN {_ST} x ON x.citation_id = c.id) GROUP BY source_id")
def source_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, s = _graph(spark, sf_dir)
    return Wd.source_statutes(c, s).withColumn("statutes", _flat())


# --- ranking ---------------------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str, spec: SearchSpec, recall: SearchSpec) -> tuple[DataFrame, ...]:
    c, d, s = _graph(spark, sf_dir)
    sources = cut(_sources(spark, sf_dir, recall))  # read several times, and much smaller than what it is found in
    c = c.join(sources, "source_id", "left_semi")  # only these sources' edges are made into windows
    return R.matched_pairs(Wd.windows(c, d, s), sources, spec), sources, c, d, s


@q("pair_match_count", PRE + _WIN + _recall(BROAD) + f"SELECT w.source_id, w.target_uid, {_count(SPEC)} AS match_count FROM w WHERE w.source_id IN (SELECT source_id FROM r)")
def pair_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, SPEC, BROAD)[0]


def _previews(steps: DataFrame) -> DataFrame:
    return steps.withColumn("previews", F.array_join("preview_source_ids", ",")).drop("preview_source_ids")


@q("step_down", PRE + _steps(SPEC, BROAD) + "SELECT target_uid, reached, previews FROM st")
def step_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _previews(R.step_down(_pairs(spark, sf_dir, SPEC, BROAD)[0], SPEC))


@q("preview_sources", PRE + _steps(SPEC, BROAD, 20) + "SELECT target_uid, CAST(unnest(string_split(previews, ',')) AS BIGINT) AS source_id FROM st")
def preview_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.step_down(_pairs(spark, sf_dir, SPEC, BROAD)[0], SPEC, 20).select("target_uid", F.explode("preview_source_ids").alias("source_id"))


@q("matched_count", PRE + _recall(SPEC) + "SELECT coalesce(target_canonical_id, target_id) AS target, count(DISTINCT source_id) AS matched FROM c WHERE source_id IN (SELECT source_id FROM r) AND target_id IS NOT NULL GROUP BY 1")
def matched_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _graph(spark, sf_dir)[0].drop("snippet")
    return R.matched_counts(c.where("target_id is not null"), _sources(spark, sf_dir, SPEC))


@q("matched_count_auth", PRE + _recall(SPEC) + "SELECT target_authority_id AS target, count(DISTINCT source_id) AS matched FROM c WHERE source_id IN (SELECT source_id FROM r) AND target_authority_id IS NOT NULL GROUP BY 1")
def matched_count_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.matched_counts(_graph(spark, sf_dir)[0].drop("snippet"), _sources(spark, sf_dir, SPEC), "target_authority_id")


def _ranked(spark: SparkSession, sf_dir: str, spec: SearchSpec = SPEC, recall: SearchSpec = BROAD) -> DataFrame:
    pairs, sources, c, d, _ = _pairs(spark, sf_dir, spec, recall)
    uid = Wd.with_target_uid(c.drop("snippet"), d)
    rows = R.ranked_targets(R.step_down(pairs, spec), uid, sources, d, tables(spark, sf_dir, "authorities")[0])
    return _previews(rows).drop("target_type", "target_id")


_SHOWN = "target_uid, doc_type, display_title, court_level, matched, total, reached, previews"
_BY_RELEVANCE = "reached DESC, matched DESC, total DESC, coalesce(court_level, 99), target_uid"
_BY_TOTAL = "total DESC, matched DESC, coalesce(court_level, 99), target_uid"


@q("rank_targets", PRE + _steps(SPEC, BROAD) + _RANKED + f"SELECT {_SHOWN}, row_number() OVER (ORDER BY {_BY_RELEVANCE}) AS position FROM rk")
def rank_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positions, numbered by ranges: sorted, then counted per partition, so that no task holds all rows."""
    rows = _ranked(spark, sf_dir).orderBy(*R.order_by("relevance"))
    return numbered(rows)


def numbered(rows: DataFrame) -> DataFrame:
    """Adds position to sorted rows: the counts of the partitions before, of which there are few, plus the place inside."""
    part = cut(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    from pyspark.sql import Window

    sizes = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = part.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("at")))
    return inside.join(F.broadcast(before), "part").withColumn("position", F.col("before") + F.col("k")).drop("part", "at", "k", "before")


@q("rank_by_total", PRE + _steps(SPEC, BROAD) + _RANKED + f"SELECT {_SHOWN} FROM rk ORDER BY {_BY_TOTAL} LIMIT 50")
def rank_by_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(_ranked(spark, sf_dir), "total", 1, 50)


@q("rerank_filter", PRE + _steps(SPEC, BROAD) + _RANKED + f"SELECT {_SHOWN} FROM rk WHERE doc_type IN ('判決', '裁判') AND court_level IN (1, 2)")
def rerank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filtered(_ranked(spark, sf_dir), ("判決", "裁判"), (1, 2))


@q("rank_page", PRE + _steps(SPEC, BROAD) + _RANKED + f"SELECT {_SHOWN} FROM rk ORDER BY {_BY_RELEVANCE} LIMIT 20 OFFSET 20")
def rank_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(_ranked(spark, sf_dir), "relevance", 2, 20)


@q("search_totals", PRE + _steps(SPEC, BROAD) + _RANKED + "SELECT (SELECT count(*) FROM rk) AS total, (SELECT count(*) FROM r) AS source_count")
def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _ranked(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("source_count", F.lit(_sources(spark, sf_dir, BROAD).count()))


@q("search", PRE + _steps(SPEC, SPEC) + _RANKED + f"SELECT {_SHOWN} FROM rk ORDER BY {_BY_RELEVANCE} LIMIT 20")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: recall, pair windows, the ladder, ranking and previews."""
    return R.page(_ranked(spark, sf_dir, SPEC, SPEC))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, d, s = _graph(spark, sf_dir)
    return R.target_scores(R.source_scores(Wd.windows(c, d, s), _sources(spark, sf_dir, BROAD), SPEC))


_SCORES = (
    _WIN + _recall(BROAD) + ", u AS (SELECT source_id, target_uid, window_text FROM w WHERE source_id IN (SELECT source_id FROM r)), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, greatest(coalesce(avg(length(window_text)), 0), 1.0) AS size, "
    + ", ".join(f"CAST(sum(CAST(contains(window_text, '{k}') AS INT)) AS DOUBLE) AS k{i}" for i, k in enumerate(SPEC.keywords)) + " FROM u), sc AS (SELECT target_uid, source_id, "
    + " + ".join(f"(SELECT t * 2.2 / (t + 1.2 * (0.25 + 0.75 * length(window_text) / n.size)) * ln(1.0 + (n.n - n.k{i} + 0.5) / (n.k{i} + 0.5)) FROM (SELECT (length(window_text) - length(replace(window_text, '{k}', ''))) / {len(k)}.0::DOUBLE AS t))" for i, k in enumerate(SPEC.keywords))
    + " AS score FROM u, n), tp AS (SELECT *, row_number() OVER (PARTITION BY target_uid ORDER BY score DESC, source_id) AS rn FROM sc), ts AS (SELECT target_uid, sum(score) AS score_sum, avg(score) AS score_avg FROM tp WHERE rn <= 5 GROUP BY 1)"
)


@q("score_top5", PRE + _SCORES + "SELECT target_uid, round(score_sum, 4) AS score_sum, round(score_avg, 4) AS score_avg FROM ts")
def score_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("target_uid", F.round("score_sum", 4).alias("score_sum"), F.round("score_avg", 4).alias("score_avg"))


@q(
    "rank_overlap",
    PRE + _SCORES + """, a AS (SELECT target_uid FROM ts ORDER BY round(score_sum, 6) DESC, target_uid LIMIT 20), b AS (SELECT target_uid FROM ts ORDER BY round(score_avg, 6) DESC, target_uid LIMIT 20)
SELECT 'sum_avg' AS variants, count(*) AS n_common FROM a JOIN b USING (target_uid)""",
)
def rank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the first twenty targets two ways of scoring have in common (a top-k report)."""
    scores = _scores(spark, sf_dir)
    first = lambda c: scores.orderBy(F.desc(F.round(c, 6)), "target_uid").limit(20).select("target_uid")
    return first("score_sum").intersect(first("score_avg")).agg(F.count(F.lit(1)).alias("n_common")).select(F.lit("sum_avg").alias("variants"), "n_common")


# --- previews --------------------------------------------------------------------------------------------------------


def _preview_sql(authority: bool, spec: SearchSpec = SPEC) -> str:
    key = f"target_authority_id = {AUTHORITY}" if authority else f"coalesce(target_canonical_id, target_id) = {RULING}"
    score = " + ".join(
        [f"CAST(contains(lower(coalesce(snippet, '')), '{k}') AS INT)" for k in spec.keywords]
        + [f"CAST(EXISTS (SELECT 1 FROM {_ST} x WHERE x.citation_id = c.id AND {_met(f, 'x', True)}) AS INT)" for f in spec.statutes]
    )
    return _recall(BROAD) + f""", p AS (SELECT c.id, c.source_id, {score} AS score FROM c WHERE {key}), bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, id) AS rn FROM p) WHERE rn = 1)"""


def _total_sql(authority: bool) -> str:
    return f"(SELECT coalesce(max(total_citation_count), 0) FROM {'authorities' if authority else 'd'} WHERE id = {AUTHORITY if authority else RULING})"


def _target(spark: SparkSession, sf_dir: str, authority: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = V.of_target(load(spark, sf_dir, "citations"), AUTHORITY if authority else RULING, authority).select("id", "source_id", "snippet").where("id is not null").distinct()
    s = tables(spark, sf_dir, "citation_snippet_statutes")[0]
    return c, s, _sources(spark, sf_dir, BROAD)


def _register_previews(authority: bool) -> None:
    tail = "_auth" if authority else ""
    sql = PRE + _preview_sql(authority)

    @q("preview_score" + tail, sql + "SELECT id, source_id, score FROM p")
    def preview_score(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, s, _ = _target(spark, sf_dir, authority)
        return V.scored(c, s, SPEC).select("id", "source_id", "score")

    @q("preview_counts" + tail, sql + f"SELECT count(DISTINCT source_id) AS matched, greatest({_total_sql(authority)} - count(DISTINCT source_id), 0) AS others FROM p WHERE source_id IN (SELECT source_id FROM r)")
    def preview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, _, sources = _target(spark, sf_dir, authority)
        table, key = ("authorities", AUTHORITY) if authority else ("decisions", RULING)
        row = load(spark, sf_dir, table).where(F.col("id") == key).agg(F.max("total_citation_count")).first()  # one row
        return V.counts(c, sources, row[0] or 0)

    @q("preview_matched" + tail, sql + ", five AS (SELECT DISTINCT source_id FROM p WHERE source_id IN (SELECT source_id FROM r) ORDER BY source_id LIMIT 5) SELECT id, source_id, score FROM bs WHERE source_id IN (SELECT source_id FROM five) ORDER BY score DESC, id LIMIT 5")
    def preview_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, s, sources = _target(spark, sf_dir, authority)
        five = c.select("source_id").distinct().join(sources, "source_id", "left_semi").orderBy("source_id").limit(5)
        return V.matched(V.scored(c, s, SPEC), tuple(r[0] for r in five.collect())).select("id", "source_id", "score")

    @q("preview_others" + tail, sql + "SELECT min(id) AS id, source_id FROM p WHERE source_id NOT IN (SELECT source_id FROM r) GROUP BY source_id ORDER BY 1 LIMIT 5")
    def preview_others(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, _, sources = _target(spark, sf_dir, authority)
        return V.others(c, sources)

    @q("preview_more" + tail, sql + ", five AS (SELECT DISTINCT source_id FROM p WHERE source_id IN (SELECT source_id FROM r) ORDER BY source_id LIMIT 5) SELECT id, source_id, score FROM bs WHERE source_id IN (SELECT source_id FROM r) AND source_id NOT IN (SELECT source_id FROM five) ORDER BY score DESC, source_id LIMIT 10")
    def preview_more(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Of all recalled sources but those that preview_matched shows."""
        c, s, sources = _target(spark, sf_dir, authority)
        loaded = tuple(r[0] for r in preview_matched(spark, sf_dir).select("source_id").collect())  # at most five
        return V.more(V.scored(c, s, SPEC), sources, loaded, 10).select("id", "source_id", "score")

    @q(
        "preview_statutes" + tail,
        sql + f""", j AS (SELECT citation_id, string_agg('{{"law":"' || law || '","article_raw":"' || article_raw || '","sub_ref":' || coalesce('"' || sub_ref || '"', 'null') || '}}', ',' ORDER BY law, article_raw, sub_ref NULLS FIRST) AS a FROM {_ST} GROUP BY 1)
SELECT p.id, '[' || coalesce(a, '') || ']' AS statutes FROM p LEFT JOIN j ON j.citation_id = p.id""",
    )
    def preview_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, s, _ = _target(spark, sf_dir, authority)
        return V.statutes_json(c, s)


_register_previews(False)
_register_previews(True)


@q(
    "preview_hydrated",
    PRE + _preview_sql(False) + """SELECT bs.id, bs.source_id, bs.score, d.display_title, d.decision_date, CAST(u.level AS INT) AS court_level,
CASE WHEN d.unit_norm LIKE '%簡易庭' AND instr(d.unit_norm, '法院') > 0 THEN left(d.unit_norm, instr(d.unit_norm, '法院') + 1) ELSE d.unit_norm END AS court
FROM bs JOIN d ON d.id = bs.source_id LEFT JOIN court_units u ON u.id = d.court_unit_id WHERE bs.source_id IN (SELECT source_id FROM r) ORDER BY score DESC, bs.id LIMIT 10""",
)
def preview_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, sources = _target(spark, sf_dir, False)
    inside = V.scored(c, s, SPEC).join(sources, "source_id", "left_semi")
    few = V.best_of_source(inside).orderBy(F.desc("score"), "id").limit(10)
    d = thin(spark, sf_dir, "decisions", "unit_norm", "display_title", "decision_date", "doc_type", "court_unit_id")
    out = V.hydrated(few, d, load(spark, sf_dir, "court_units"), s)
    return out.select("id", "source_id", "score", "display_title", "decision_date", F.col("court_level").cast("int").alias("court_level"), "court")


@q("prompt_blocks", PRE + f"""SELECT c.source_id, string_agg('【' || CAST(rn AS VARCHAR) || '】' || coalesce(snippet, ''), chr(10) ORDER BY rn) AS block FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS rn FROM c WHERE coalesce(target_canonical_id, target_id) = {RULING}) c GROUP BY c.source_id""")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c, _, _ = _target(spark, sf_dir, False)
    k = c.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy("id")))
    line = F.concat(F.lit("【"), F.col("k").cast("string"), F.lit("】"), F.coalesce("snippet", F.lit("")))
    x = k.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("x"))
    return x.select("source_id", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("block"))
