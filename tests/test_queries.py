"""Every query with SQL against it, on the smallest data; the others run."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from casemesh import fixtures as X
from casemesh.operators import extract

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 4))
    return str(v)[:19] if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    rows = sorted(tuple(canon(r[c]) for c in names) for r in df.collect())
    if name in ORACLES:
        r = duck.execute(ORACLES[name])
        columns = [d[0] for d in r.description]
        assert sorted(columns) == names
        at = [columns.index(c) for c in names]
        assert rows == sorted(tuple(canon(x[i]) for i in at) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "target_uid"


def test_nothing_imports_the_llm_package():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/casemesh/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path) as f:
                assert "casemesh.llm" not in f.read(), path


def test_all_marks_are_shown(spark, data):
    text = {r.id: r.snippet for r in spark.read.parquet(f"{data}/citations.parquet").select("id", "snippet").collect() if r.snippet}
    got = [(r.id, r.start_pos, r.end_pos, r.kind) for r in QUERIES["highlight"](spark, data).collect()]
    want = []
    for i, t in text.items():
        for term, kind in (("過失比例", "keyword"), ("民法第184條", "keyword"), ("民法", "statute")):
            at = t.find(term)
            while at >= 0:
                if kind == "keyword" or not t.startswith("民法第184條", at):
                    want.append((i, at, at + len(term), kind))
                at = t.find(term, at + len(term))
    assert sorted(got) == sorted(want) and len({i for i, _, e, _ in got if e}) < len(got) and {k for *_, k in got} == {"keyword", "statute"}


@pytest.mark.parametrize("tail", ["", "_auth"])
def test_more_is_without_the_loaded(spark, data, tail):
    of = lambda name: {r.source_id for r in QUERIES[name + tail](spark, data).collect()}
    assert of("preview_matched") and not of("preview_more") & of("preview_matched")


def repeated_lines(spark, data, folder, copies):
    """lineitem of an order's lines under so many orders."""
    few = spark.read.parquet(f"{data}/lineitem.parquet").where("l_orderkey < 40")
    many = few.crossJoin(spark.range(copies).withColumnRenamed("id", "copy")).withColumn("l_orderkey", F.col("l_orderkey") + F.col("copy") * 6000).drop("copy")
    many.coalesce(2).write.parquet(f"{folder}/lineitem.parquet")
    return few.count()


def test_equal_texts_are_parsed_once_and_all_rows_told(spark, data, tmp_path, monkeypatch):
    few, parsed, real = repeated_lines(spark, data, tmp_path, 50), [], extract.judged
    monkeypatch.setattr(extract, "judged", lambda t, *a, **k: parsed.append(t.count()) or real(t, *a, **k))
    got = sorted(map(tuple, QUERIES["authority_scan"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(c.execute(ORACLES["authority_scan"]).fetchall()) and len(got) == 50 * 5 * few
    assert len(parsed) == 1 and parsed[0] <= few


@pytest.mark.parametrize("kind", sorted(X.TEXTS))
def test_different_texts_are_those_of_the_rows(spark, data, kind):
    every, once = X.texts(spark, data, kind), X.different(spark, data, kind)
    assert sorted(r.text for r in once.collect()) == sorted(r.text for r in every.select(*X.parts(kind), "text").distinct().collect())


def test_bounds_of_texts_without_a_join_and_of_rows_that_share_an_id(spark, data, tmp_path):
    """An order more with 60 000 000 / 2000 * 10 parts less has the same id."""
    line = spark.read.parquet(f"{data}/lineitem.parquet").limit(1)
    twin = line.withColumns({"l_orderkey": F.col("l_orderkey") + 1, "l_partkey": F.col("l_partkey") - 300_000})
    line.unionByName(twin).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["chunk_bounds_of_texts"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(map(tuple, df.collect()))
    assert len({r[0] for r in got}) == 1 and len(got) == 2 and got == sorted(c.execute(ORACLES["chunk_bounds_of_texts"]).fetchall())
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
