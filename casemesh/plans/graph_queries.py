"""Queries on the citation graph: records, edges, derived columns and incremental loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.functions import text as T
from casemesh.functions.plain import stripped
from casemesh.operators import graph as G
from casemesh.operators.recall import CASE_TYPES  # noqa: F401 - re-exported for callers of the plans
from casemesh.plans.registry import Registry
from casemesh.sources.tables import load

REGISTRY = Registry()
q = REGISTRY.query

#: Records of the tables, one row per id.
PRE = """WITH d AS (SELECT DISTINCT ON (id) * FROM decisions WHERE id IS NOT NULL), c AS (SELECT DISTINCT ON (id) * FROM citations WHERE id IS NOT NULL),
k AS (SELECT DISTINCT ON (id) * FROM chunks WHERE id IS NOT NULL), s AS (SELECT DISTINCT * FROM citation_snippet_statutes)
"""
_COURT = "replace(regexp_replace(unit_norm, '\\s|　', '', 'g'), '台', '臺')"
_CASE = "replace(replace(jcase_norm, ' ', ''), '臺', '台')"
_DOCKET = f"concat_ws('|', coalesce({_COURT}, '?'), coalesce(CAST(jyear AS VARCHAR), '?'), coalesce({_CASE}, '?'), coalesce(CAST(jno AS VARCHAR), '?'), coalesce(case_type, '?'))"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Tables as records where they have ids."""
    out = []
    for n in names:
        df = load(spark, sf_dir, n)
        out.append(G.records(df) if n in ("decisions", "citations", "chunks", "authorities", "court_units") else df.distinct() if n == "citation_snippet_statutes" else df)
    return out


def thin(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Records with only some columns, so that copies are dropped without moving texts."""
    return load(spark, sf_dir, name).select("id", *columns).where("id is not null").distinct()


_DOCKET_COLUMNS = ("unit_norm", "jyear", "jcase_norm", "jno", "case_type")


@q("canonical_id", PRE + f"SELECT id, min(id) OVER (PARTITION BY {_DOCKET}) AS canonical_id FROM d")
def canonical_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.canonical_ids(thin(spark, sf_dir, "decisions", *_DOCKET_COLUMNS))


@q("edge_canonical", PRE + "SELECT c.id, coalesce(d.canonical_id, d.id) AS target_canonical_id FROM c LEFT JOIN d ON c.target_id = d.id WHERE c.target_id IS NOT NULL")
def edge_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edge_canonical(thin(spark, sf_dir, "citations", "target_id"), thin(spark, sf_dir, "decisions", "canonical_id"))


_COUNTS = """, g AS (SELECT id, coalesce(canonical_id, id) AS grp FROM d), n AS (SELECT grp, count(DISTINCT source_id) AS n FROM c JOIN g ON c.target_id = g.id GROUP BY grp)
"""


@q("citation_counts", PRE + _COUNTS + "SELECT id, coalesce(n, 0) AS total_citation_count FROM g LEFT JOIN n USING (grp)")
def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.citation_counts(thin(spark, sf_dir, "decisions", "canonical_id"), thin(spark, sf_dir, "citations", "target_id", "source_id"))


@q(
    "authority_counts",
    PRE + "SELECT a.id, coalesce(n, CAST(a.total_citation_count AS BIGINT), 0) AS total_citation_count FROM authorities a LEFT JOIN (SELECT target_authority_id AS id, count(DISTINCT source_id) AS n FROM c WHERE target_authority_id IS NOT NULL GROUP BY 1) USING (id)",
)
def authority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.authority_counts(tables(spark, sf_dir, "authorities")[0], thin(spark, sf_dir, "citations", "target_authority_id", "source_id"))


_DOC_TYPES = """, g AS (SELECT id, coalesce(canonical_id, id) AS grp, doc_type FROM d),
t AS (SELECT grp, doc_type FROM g WHERE doc_type IS NOT NULL UNION SELECT grp, '判例' FROM c JOIN g ON c.target_id = g.id WHERE target_doc_type = '判例'),
x AS (SELECT grp, CASE WHEN count(DISTINCT doc_type) = 1 THEN max(doc_type) ELSE '裁判' END AS canonical_doc_type FROM t GROUP BY grp)
"""


@q("canonical_doc_type", PRE + _DOC_TYPES + "SELECT id, coalesce(canonical_doc_type, '裁判') AS canonical_doc_type FROM g LEFT JOIN x USING (grp)")
def canonical_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.canonical_doc_types(thin(spark, sf_dir, "decisions", "canonical_id", "doc_type"), thin(spark, sf_dir, "citations", "target_id", "target_doc_type"))


@q(
    "changed_rows",
    PRE + _COUNTS + "SELECT d.id, CAST(d.total_citation_count AS BIGINT) AS old_value, coalesce(n, 0) AS new_value FROM d JOIN g USING (id) LEFT JOIN n USING (grp) WHERE d.total_citation_count IS DISTINCT FROM coalesce(n, 0)",
)
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = thin(spark, sf_dir, "decisions", "canonical_id", "total_citation_count").withColumn("total_citation_count", F.col("total_citation_count").cast("long"))
    return G.changed(d, G.citation_counts(d, thin(spark, sf_dir, "citations", "target_id", "source_id")), "total_citation_count")


@q(
    "edge_violations",
    """SELECT DISTINCT id, v AS violation FROM (SELECT id, CASE WHEN target_id IS NULL AND target_authority_id IS NULL THEN 'no_target' WHEN target_id IS NOT NULL AND target_authority_id IS NOT NULL THEN 'two_targets'
WHEN match_start IS NULL OR match_end IS NULL THEN 'no_offset' END AS v FROM (SELECT id, target_id, target_authority_id, match_start, match_end FROM citations UNION ALL
SELECT -id, target_id, coalesce(target_authority_id, 1), CASE WHEN id % 3 = 0 THEN NULL ELSE match_start END, match_end FROM citations WHERE id % 2 = 0)) WHERE v IS NOT NULL""",
)
def edge_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the table and on a copy of it that is broken on purpose."""
    c = thin(spark, sf_dir, "citations", "target_id", "target_authority_id", "match_start", "match_end")
    broken = c.where("id % 2 = 0").select(
        (-F.col("id")).alias("id"), "target_id", F.coalesce("target_authority_id", F.lit(1)).alias("target_authority_id"),
        F.when(F.col("id") % 3 != 0, F.col("match_start")).alias("match_start"), "match_end",
    )
    return G.edge_violations(c.unionByName(broken))


@q(
    "decision_detail",
    PRE + "SELECT d.id, d.display_title, d.doc_type, d.decision_date, u.unit_norm AS court_unit, CAST(u.level AS INT) AS court_level FROM d LEFT JOIN court_units u ON d.court_unit_id = u.id WHERE d.jid IS NOT NULL",
)
def decision_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = thin(spark, sf_dir, "decisions", "display_title", "doc_type", "decision_date", "court_unit_id", "jid").where("jid is not null")
    u = F.broadcast(load(spark, sf_dir, "court_units").select(F.col("id").alias("court_unit_id"), F.col("unit_norm").alias("court_unit"), F.col("level").cast("int").alias("court_level")))
    return d.join(u, "court_unit_id", "left").select("id", "display_title", "doc_type", "decision_date", "court_unit", "court_level")


@q(
    "decision_statutes",
    PRE + "SELECT c.source_id AS decision_id, trim(law, ' \t　') AS law, article_raw, coalesce(sub_ref, '') AS sub_ref, count(*) AS n FROM s JOIN c ON s.citation_id = c.id GROUP BY ALL",
)
def decision_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir, "citation_snippet_statutes")[0]
    edges = thin(spark, sf_dir, "citations", "source_id").withColumnRenamed("id", "citation_id")
    return s.drop("id").join(edges, "citation_id").groupBy(F.col("source_id").alias("decision_id"), stripped(F.col("law")).alias("law"), "article_raw", F.coalesce("sub_ref", F.lit("")).alias("sub_ref")).agg(F.count(F.lit(1)).alias("n"))


@q(
    "source_export",
    PRE + "SELECT id, case_type, decision_date, length(clean_text) AS n_chars FROM d WHERE clean_text IS NOT NULL AND decision_date >= DATE '2023-01-01' AND decision_date < DATE '2024-01-01' AND id IN (SELECT source_id FROM c)",
)
def source_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "decisions").where("clean_text is not null and decision_date >= date'2023-01-01' and decision_date < date'2024-01-01'")
    rows = d.select("id", "case_type", "decision_date", F.length("clean_text").cast("long").alias("n_chars")).distinct()
    return rows.join(load(spark, sf_dir, "citations").select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")


@q(
    "window_source_ids",
    PRE + "SELECT DISTINCT source_id FROM c WHERE (target_id IS NOT NULL OR target_authority_id IS NOT NULL) AND created_at >= TIMESTAMP '2023-06-01' AND created_at < TIMESTAMP '2024-06-01'",
)
def window_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "citations").where("(target_id is not null or target_authority_id is not null) and created_at >= timestamp_ntz'2023-06-01' and created_at < timestamp_ntz'2024-06-01'")
    return c.select("source_id").distinct()


@q("resume_missing", PRE + "SELECT id FROM d WHERE clean_text IS NOT NULL AND id IN (SELECT source_id FROM c) AND id NOT IN (SELECT decision_id FROM k WHERE decision_id IS NOT NULL)")
def resume_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "decisions").where("clean_text is not null").select("id").distinct()
    cited = load(spark, sf_dir, "citations").select(F.col("source_id").alias("id")).distinct()
    done = load(spark, sf_dir, "chunks").select(F.col("decision_id").alias("id")).distinct()
    return d.join(cited, "id", "left_semi").join(done, "id", "left_anti")


@q("month_slice", PRE + "SELECT k.id, k.decision_id FROM k JOIN d ON k.decision_id = d.id WHERE d.decision_date >= DATE '2023-03-01' AND d.decision_date < DATE '2023-04-01'")
def month_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "decisions").where("decision_date >= date'2023-03-01' and decision_date < date'2023-04-01'").select(F.col("id").alias("decision_id")).distinct()
    return thin(spark, sf_dir, "chunks", "decision_id").join(d, "decision_id", "left_semi").select("id", "decision_id")


@q(
    "stratified_sample",
    PRE + """, n AS (SELECT source_id, count(*) AS n FROM c GROUP BY 1 HAVING count(*) BETWEEN 3 AND 8), r AS (SELECT d.id, d.case_type, n.n, row_number() OVER (PARTITION BY d.case_type ORDER BY md5(CAST(d.id AS VARCHAR)), d.id) AS rn
FROM d JOIN n ON d.id = n.source_id WHERE d.case_type IS NOT NULL) SELECT id, case_type, n FROM r WHERE rn <= 10""",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: ten rulings with three to eight citations of each case type, by hash."""
    from pyspark.sql import Window

    n = thin(spark, sf_dir, "citations", "source_id").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n between 3 and 8")
    d = thin(spark, sf_dir, "decisions", "case_type").where("case_type is not null").join(n, "id")
    order = Window.partitionBy("case_type").orderBy(F.md5(F.col("id").cast("string")), "id")
    return d.withColumn("k", F.row_number().over(order)).where("k <= 10").select("id", "case_type", "n")


@q(
    "eval_targets",
    PRE + """, g AS (SELECT target_id, count(*) FILTER (snippet IS NOT NULL AND length(snippet) > 50) AS good, count(*) AS n FROM c WHERE target_id IS NOT NULL GROUP BY 1)
SELECT g.target_id, d.case_type, good, n FROM g JOIN d ON d.id = g.target_id WHERE good BETWEEN 3 AND 8""",
)
def eval_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "citations").where("id is not null and target_id is not null").select("id", "target_id", F.coalesce(F.length("snippet") > 50, F.lit(False)).alias("is_good")).distinct()
    g = c.groupBy("target_id").agg(F.count_if("is_good").alias("good"), F.count(F.lit(1)).alias("n")).where("good between 3 and 8")
    return g.join(thin(spark, sf_dir, "decisions", "case_type").withColumnRenamed("id", "target_id"), "target_id").select("target_id", "case_type", "good", "n")


_CITED = """, p AS (SELECT DISTINCT d.unit_norm, d.jyear, d.jcase_norm, d.jno, d.case_type, c.target_doc_type AS doc_type FROM c JOIN d ON c.target_id = d.id UNION SELECT unit_norm, jyear, jcase_norm, jno + 1000000, case_type, doc_type FROM d WHERE jid IS NOT NULL),
""" + f"""r AS (SELECT {_DOCKET} AS docket, * FROM p WHERE length(jcase_norm) <= 50), t AS (SELECT {_DOCKET} AS docket, * FROM d),
f AS (SELECT docket, doc_type, min(id) AS full_id FROM t WHERE jid IS NOT NULL GROUP BY ALL), l AS (SELECT docket, coalesce(doc_type, '') AS kind, min(id) AS kept_id FROM t WHERE jid IS NULL GROUP BY ALL),
z AS (SELECT r.*, f.full_id, l.kept_id FROM r LEFT JOIN f ON r.docket = f.docket AND r.doc_type = f.doc_type AND r.doc_type IN ('判決', '裁定', '憲判字')
LEFT JOIN l ON r.docket = l.docket AND l.kind = CASE WHEN r.doc_type IN ('判決', '裁定', '憲判字') THEN r.doc_type ELSE '' END)
"""


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Dockets as citations name them, some of which no record has, and the records."""
    d = thin(spark, sf_dir, "decisions", *_DOCKET_COLUMNS, "doc_type", "jid")
    c = thin(spark, sf_dir, "citations", "target_id", "target_doc_type")
    named = c.select(F.col("target_id").alias("id"), "target_doc_type").join(d, "id").select(*_DOCKET_COLUMNS, F.col("target_doc_type").alias("doc_type"))
    unseen = d.where("jid is not null").select(*[c for c in _DOCKET_COLUMNS if c != "jno"], (F.col("jno") + 1000000).alias("jno"), "doc_type")
    return named.unionByName(unseen).distinct(), d


@q("resolve_targets", PRE + _CITED + "SELECT unit_norm, jyear, jcase_norm, jno, case_type, doc_type, coalesce(full_id, kept_id) AS target_id, CASE WHEN full_id IS NOT NULL THEN 'full' WHEN kept_id IS NOT NULL THEN 'placeholder' ELSE 'new' END AS resolution FROM z")
def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.target_states(*_cited(spark, sf_dir))


@q(
    "placeholders",
    PRE + _CITED + "SELECT DISTINCT unit_norm, jyear, jcase_norm, jno, case_type, CASE WHEN doc_type IN ('判決', '裁定', '憲判字') THEN doc_type END AS doc_type FROM z WHERE full_id IS NULL AND kept_id IS NULL",
)
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.new_placeholders(G.target_states(*_cited(spark, sf_dir))).drop("id")


_INCOMING = f"""SELECT jid, unit_norm, jyear, jcase_norm, jno, case_type, doc_type FROM d WHERE jid IS NOT NULL UNION ALL
SELECT 'new-' || CAST(id AS VARCHAR), unit_norm, jyear, jcase_norm, jno, case_type, doc_type FROM d WHERE jid IS NULL AND id % 2 = 0 UNION ALL SELECT 'more-' || CAST(id AS VARCHAR), unit_norm, jyear, jcase_norm, jno, case_type, doc_type FROM d WHERE id % 3 = 0"""


@q(
    "upsert_decisions",
    PRE + f""", i AS (SELECT jid, {_DOCKET} || coalesce(doc_type, '?') AS fk FROM ({_INCOMING})), kn AS (SELECT jid, min(id) AS known FROM d WHERE jid IS NOT NULL GROUP BY 1),
p AS (SELECT {_DOCKET} || coalesce(doc_type, '?') AS fk, min(id) AS place FROM d WHERE jid IS NULL GROUP BY 1), m AS (SELECT i.jid, i.fk, kn.known FROM i LEFT JOIN kn USING (jid)),
f AS (SELECT fk, min(jid) AS fj FROM m WHERE known IS NULL GROUP BY 1)
SELECT coalesce(known, CASE WHEN f.fj = m.jid THEN p.place END) AS id, m.jid, CASE WHEN known IS NOT NULL THEN 'known' WHEN f.fj = m.jid AND p.place IS NOT NULL THEN 'filled' ELSE 'new' END AS state
FROM m LEFT JOIN f USING (fk) LEFT JOIN p USING (fk)""",
)
def upsert_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rulings again, new ones for placeholders, and further ones of the same dockets; ids of new records are left null here."""
    d = thin(spark, sf_dir, "decisions", *_DOCKET_COLUMNS, "doc_type", "jid")
    columns = [*_DOCKET_COLUMNS, "doc_type"]
    again = d.where("jid is not null").select("jid", *columns)
    fill = d.where("jid is null and id % 2 = 0").select(F.concat(F.lit("new-"), F.col("id").cast("string")).alias("jid"), *columns)
    further = d.where("id % 3 = 0").select(F.concat(F.lit("more-"), F.col("id").cast("string")).alias("jid"), *columns)
    out = G.upserted(d, again.unionByName(fill).unionByName(further))
    return out.withColumn("id", F.when(F.col("state") != "new", F.col("id")))


@q(
    "citations_replace",
    PRE + """SELECT id, source_id, target_id, match_start FROM c WHERE source_id % 5 <> 0 OR source_id IS NULL
UNION ALL SELECT min(id), source_id, target_id, match_start FROM c WHERE source_id % 5 = 0 AND match_start % 2 = 0 GROUP BY source_id, target_id, target_authority_id, match_start
UNION ALL SELECT DISTINCT NULL, source_id, target_id, m FROM (SELECT source_id, target_id, target_authority_id, match_start + 1000000 AS m FROM c WHERE source_id % 5 = 0 AND match_start % 4 = 0 GROUP BY ALL)""",
)
def citations_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that brings every fifth source again, with half of its edges as they were and some new ones, whose ids aren't shown."""
    c = thin(spark, sf_dir, "citations", "source_id", "target_id", "target_authority_id", "match_start", "match_end", "created_at")
    batch = c.where("source_id % 5 = 0")
    same, fresh = batch.where("match_start % 2 = 0"), batch.where("match_start % 4 = 0").withColumn("match_start", F.col("match_start") + 1000000)
    out = G.replaced_by_source(c, same.unionByName(fresh).withColumn("id", F.lit(-1).cast("long")), batch.select("source_id"))
    made = (F.col("source_id") % 5 == 0) & (F.col("match_start") >= 1000000)
    return out.select(F.when(~F.coalesce(made, F.lit(False)), F.col("id")).alias("id"), "source_id", "target_id", "match_start").distinct()


@q(
    "authorities_upsert",
    """WITH i AS (SELECT doc_type, ref_key, display, CAST(-1 AS BIGINT) AS seq FROM authorities UNION ALL SELECT doc_type, ref_key || CASE WHEN id % 7 = 0 THEN '+' ELSE '' END, CASE WHEN id % 2 = 0 THEN 'shown ' || ref_key END, id FROM authorities)
SELECT doc_type, ref_key, arg_max(display, seq) FILTER (display IS NOT NULL) AS display FROM i GROUP BY ALL""",
)
def authorities_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "authorities")
    new = a.select("doc_type", F.concat("ref_key", F.when(F.col("id") % 7 == 0, "+").otherwise("")).alias("ref_key"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("shown "), F.col("ref_key"))).alias("display"), F.col("id").alias("seq"))
    return G.upserted_authorities(a, new)


@q("display_title", PRE + f"SELECT id, coalesce(CAST(jyear AS VARCHAR) || '年度' || {_CASE} || '字第' || CAST(jno AS VARCHAR) || '號', '') AS display_title FROM d")
def display_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thin(spark, sf_dir, "decisions", "jyear", "jcase_norm", "jno").select("id", T.display_title(F.col("jyear"), T.case_word(F.col("jcase_norm")), F.col("jno")).alias("display_title"))


@q("ref_key", PRE + f"SELECT id, concat_ws('|', {_COURT}, jyear, {_CASE}, jno) AS ref_key FROM d")
def ref_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = thin(spark, sf_dir, "decisions", "unit_norm", "jyear", "jcase_norm", "jno")
    return d.select("id", T.ref_key(T.graph_court(F.col("unit_norm")), F.col("jyear"), T.case_word(F.col("jcase_norm")), F.col("jno")).alias("ref_key"))


@q("authority_root", "SELECT id, doc_type, CASE WHEN doc_type IN ('決議') THEN '最高法院' WHEN doc_type = '法律座談會' AND ref_key LIKE '高等行政法院%' THEN '高等行政法院' WHEN doc_type = '法律座談會' AND ref_key LIKE '高等法院%' THEN '高等法院' ELSE '司法院' END AS root FROM authorities")
def authority_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "authorities").select("id", "doc_type", T.authority_root(F.col("doc_type"), F.col("ref_key")).alias("root"))
