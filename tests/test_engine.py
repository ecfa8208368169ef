"""The engine's methods, with and without written tables, on the smallest data."""

import os

import pytest
from pyspark.sql import functions as F

from casemesh.api import NOT_GIVEN, CitationEngine, NotThere, ids_of
from casemesh.cache import SearchCache
from casemesh.operators import extract, ingest, phrase_index, windows
from casemesh.operators.recall import SearchSpec, StatuteFilter
from casemesh.plans.search_queries import AUTHORITY, RULING

SPEC = SearchSpec(("過失比例", "舉證責任"), (StatuteFilter("民法"),))
BROAD = SearchSpec(("過失比例",))


@pytest.fixture(scope="module")
def engine(spark, data):
    return CitationEngine(spark, data)


@pytest.fixture(scope="module")
def written(spark, data, tmp_path_factory):
    """An engine that reads the pair table, the index and the rulings' own statutes."""
    at = str(tmp_path_factory.mktemp("written"))
    plain = CitationEngine(spark, data)
    ingest.write_windows(windows.windows(plain._edges, plain._records, plain._statutes), f"{at}/windows")
    d = spark.read.parquet(f"{data}/decisions.parquet")
    phrase_index.build(d, f"{at}/index")
    extract.ruling_statutes(d).write.parquet(f"{at}/statutes")
    return CitationEngine(spark, data, f"{at}/windows", index_path=f"{at}/index"), CitationEngine(spark, data, f"{at}/windows", index_path=f"{at}/index", statutes_path=f"{at}/statutes")


def test_search_pages_orders_and_filters(engine):
    first = engine.search(BROAD, size=7)
    assert len(first.rows) == 7 and first.total > 7 and first.source_count > 0
    second = engine.search(BROAD, page=2, size=7)
    assert second.cache_key == first.cache_key and not {r["target_uid"] for r in first.rows} & {r["target_uid"] for r in second.rows}
    key = lambda r: (-r["reached"], -r["matched"], -r["total"], 99 if r["court_level"] is None else r["court_level"], r["target_uid"])
    every = engine.search(BROAD, size=first.total).rows
    assert every == sorted(every, key=key) and len(every) == first.total
    by_total = engine.rerank(BROAD, order="total", size=first.total).rows
    assert by_total == sorted(every, key=lambda r: key(r)[2:3] + key(r)[1:2] + key(r)[3:])
    few = engine.rerank(BROAD, doc_types=("判決",), court_levels=(1,))
    assert few.total == len([r for r in every if r["doc_type"] == "判決" and r["court_level"] == 1])
    entry = engine.cache.get(first.cache_key)
    assert set(entry.orders) == {"relevance", "total"} and len(entry.totals) >= 3
    with pytest.raises(ValueError, match="keyword"):
        engine.search(SearchSpec(()))


def test_written_tables_change_nothing(engine, written):
    for spec in (BROAD, SPEC, SearchSpec(("民訴",), (StatuteFilter("民訴法"),)), SearchSpec(("無此字串",))):
        assert engine.search(spec, size=500).rows == written[0].search(spec, size=500).rows


def test_own_statutes_are_wider_than_cited_ones(spark, data, written):
    own = written[1].search(SearchSpec(("法院",), (StatuteFilter("民法"),)), size=1)
    d = spark.read.parquet(f"{data}/decisions.parquet")
    ids = extract.ruling_statutes(d).where("law = '民法'").select("decision_id").distinct()
    want = d.where(F.col("clean_text").contains("法院")).select("id").distinct().join(ids, F.col("id") == F.col("decision_id"), "left_semi").count()
    assert own.source_count == want > 0


@pytest.mark.parametrize(("target", "authority"), [(RULING, False), (AUTHORITY, True)])
def test_citations_of_a_target(spark, data, engine, target, authority):
    first = engine.citations(BROAD, target, "", authority)
    assert first["matched_rows"] == [] and len(first["other_rows"]) <= 5
    more = engine.citations_more(BROAD, target, "", 50, authority)
    sources = sorted({r["source_id"] for r in more})
    assert first["matched"] >= len(sources) > 0 and [r["id"] for r in more] == sorted(r["id"] for r in more)
    some = ",".join(map(str, sources[:3]))
    again = engine.citations(BROAD, target, some, authority)
    assert {r["source_id"] for r in again["matched_rows"]} == set(sources[:3])
    rest = engine.citations_more(BROAD, target, some, 50, authority)
    assert not {r["source_id"] for r in rest} & set(sources[:3])
    assert not {r["source_id"] for r in again["other_rows"]} & set(sources)
    with pytest.raises(NotThere):
        engine.citations(BROAD, -5, "", authority)
    with pytest.raises(ValueError, match="invalid"):
        engine.citations_more(BROAD, target, "1,x", 5, authority)


def test_records_and_laws(spark, data, engine):
    i = spark.read.parquet(f"{data}/decisions.parquet").where("clean_text is not null").agg(F.min("id")).first()[0]
    assert engine.decision(i)["id"] == i and engine.decision(i)["clean_text"]
    with pytest.raises(NotThere):
        engine.decision(-1)
    assert engine.laws("民事")[0] == "民事訴訟法" and len(engine.laws()) <= 50 and engine.laws("民訴") == ["民事訴訟法"]
    assert ids_of("3, 1,3") == (3, 1) and ids_of("1,2,3,4,5,6,7", 5) == (1, 2, 3, 4, 5) and ids_of(None) == ()


def test_passages_and_answers(spark, data, engine):
    v = spark.read.parquet(f"{data}/chunks.parquet").where("embedding is not null and size(embedding) = 64").orderBy("id").first()
    embed = lambda texts: [[10 * x for x in v["embedding"]]]
    found = engine.passages("甲", embed, 3)
    assert len(found) == 3 and found[0]["score"] >= found[1]["score"] and found[0]["score"] == pytest.approx(1, abs=1e-4)
    assert all({"root_norm", "display_title", "chunk_text"} <= set(r) for r in found)
    asked = []
    out = engine.rag("案例", embed, lambda prompt: asked.append(prompt) or '<h3>爭點 1：甲</h3><cite type="source" id="3">乙</cite>', 3, ("甲",), ({"law": "民法", "article": "184"},))
    assert [t[0] for t in out["tags"]] == ["heading", "cite"] and "- 甲" in asked[0] and "- 民法 第184條" in asked[0] and asked[0].count("### ") == 3
    assert engine.prompt("案例", []).count(NOT_GIVEN) == 2


def test_analysis(engine):
    answer = '{"issues": ["甲", "", 3], "statutes": [{"law": "民訴法", "article": 447}, {"article": "1"}, "x"]}'
    assert engine.analyze("案例", lambda t: answer) == {"issues": ["甲"], "statutes": [{"law": "民事訴訟法", "article": "447"}]}
    with pytest.raises(ValueError, match="JSON"):
        engine.analyze("案例", lambda t: "[]")


def test_kept_searches_end(spark, data):
    now = [0.0]
    e = CitationEngine(spark, data, cache=SearchCache(10, 1, lambda: now[0]))
    a = e.search(BROAD, size=3)
    paths = [p.removeprefix("file://") for p in e.cache.get(a.cache_key).on_drop[0].__self__.paths]
    assert len(paths) == 2 and all(map(os.path.exists, paths))
    now[0] = 11
    b = e.search(BROAD, size=3)
    assert a.rows == b.rows
    assert not any(map(os.path.exists, paths))
