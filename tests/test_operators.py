"""Operators on small tables: nulls, ties, copies, empty tables, clashing names."""

import itertools
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from casemesh.cache import SearchCache, signature
from casemesh.functions import text as T
from casemesh.operators import chunking, extract, graph, ingest, preview, ranking, recall, semantic, windows
from casemesh.operators.recall import SearchSpec, StatuteFilter


def test_step_down_equals_the_loop(spark):
    rng = random.Random(4)
    spec = SearchSpec(("a", "b", "c"))
    for _ in range(4):
        rows = [(s, f"t{rng.randrange(12)}", rng.randrange(4)) for s in range(60)]
        rows = [(s, t, m) for (s, t), m in {(s, t): m for s, t, m in rows}.items()]
        enough = rng.choice([1, 3, 8, 50])
        got = {r.target_uid: (r.reached, list(r.preview_source_ids)) for r in ranking.step_down(spark.createDataFrame(rows, "source_id long, target_uid string, match_count int"), spec, enough).collect()}
        want: dict = {}
        for level in range(3, -1, -1):
            by = {}
            for s, t, m in rows:
                if m >= level:
                    by.setdefault(t, []).append((-m, s))
            for t, x in by.items():
                best = max(-m for m, _ in x)
                want[t] = (want[t][0] if t in want else best, [s for _, s in sorted(x)][:5])
            if len(by) >= enough:
                break
        assert got == want


def test_merge_equals_the_loop(spark):
    rng = random.Random(5)
    rows = [(i % 3, i, a, a + rng.randrange(1, 9)) for i, a in enumerate(rng.randrange(60) for _ in range(60))]
    got = {(r.owner, r.id): (r.run_start, r.run_end) for r in chunking.merged_intervals(spark.createDataFrame(rows, "owner int, id int, start int, end int"), "owner").collect()}
    for owner, group in itertools.groupby(sorted(rows), lambda r: r[0]):
        runs: list = []
        for _, i, a, b in sorted(group, key=lambda r: (r[2], r[3])):
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
                runs[-1][2].append(i)
            else:
                runs.append([a, b, [i]])
        for a, b, ids in runs:
            assert all(got[owner, i] == (a, b) for i in ids)


def judged(spark, text, own=("台灣台北地方法院", 99, "訴", 1)):
    df = spark.createDataFrame([(1, text, own[0], own[0], own[1], own[2], own[3])], "id long, text string, court string, own_court string, own_jyear int, own_jcase string, own_jno int")
    return [r.reject_reason for r in extract.judged(df).orderBy("match_start").collect()]


HEAD = "主文\r\n被告應給付。\r\n理由\r\n一、"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (HEAD + "最高法院100年度台上字第5號判決意旨參照。", [None]),
        ("最高法院100年度台上字第5號判決意旨參照。\r\n理由\r\n一、甲。", ["R006_before_reason"]),
        (HEAD + "甲。\r\n以上正本證明與原本無異\r\n最高法院100年度台上字第5號判決參照。", ["R007_after_zhengben"]),
        (HEAD + "本院99年度訴字第1號判決意旨參照。", ["R001_self_citation"]),
        (HEAD + "經最高法院100年度台上字第5號判決上訴駁回確定。", ["R003_prior_case"]),
        (HEAD + "有最高法院100年度台上字第5號判決書在卷可稽。", ["R011_evidence_cite"]),
        (HEAD + "本院98年度訴字第2號判決。", ["R002_ben_yuan_missing_intent"]),
        (HEAD + "台灣新北地方法院98年度訴字第2號判決。", ["R009_district_court_missing_intent"]),
        (HEAD + "台灣新北地方法院98年度訴字第2號判決同此見解。", [None]),
        (HEAD + "原告主張依最高法院100年度台上字第5號判決云云。", ["R005a_party_context"]),
        (HEAD + "原告主張甲，惟最高法院100年度台上字第5號判決意旨參照。", [None]),
        (HEAD + "司法院釋字第400號解釋。", ["R010_authority_missing_intent"]),
        (HEAD + "司法院釋字第400號解釋參照。", [None]),
        (None, []),
        ("", []),
    ],
)
def test_conditions(spark, text, want):
    assert judged(spark, text) == want


D = "id long, unit_norm string, jyear int, jcase_norm string, jno int, case_type string, doc_type string, jid string, canonical_id long, note string"


def test_resolution_table(spark):
    d = spark.createDataFrame(
        [(1, "台甲", 1, "訴", 1, "民事", "判決", "j1", 1, ""), (2, "臺甲", 1, "訴", 1, "民事", "裁定", None, 2, ""), (3, "臺甲", 1, "訴", 1, "民事", None, None, 3, ""), (4, "臺甲", 1, "訴", 1, None, "判決", "j4", 4, "")], D
    )
    cited = [("臺甲", 1, "訴", 1, "民事", k) for k in ("判決", "裁定", "判例", None, "憲判字")] + [("臺甲", 1, "訴", 1, None, "判決"), ("臺甲", 1, "長" * 51, 1, None, "判決")]
    got = {(r.case_type, r.doc_type): (r.target_id, r.resolution) for r in graph.target_states(spark.createDataFrame(cited, "unit_norm string, jyear int, jcase_norm string, jno int, case_type string, doc_type string"), d).collect()}
    assert got == {
        ("民事", "判決"): (1, "full"), ("民事", "裁定"): (2, "placeholder"), ("民事", "判例"): (3, "placeholder"), ("民事", None): (3, "placeholder"), ("民事", "憲判字"): (None, "new"), (None, "判決"): (4, "full"),
    }


def test_canonical_ids_are_null_safe(spark):
    d = spark.createDataFrame([(5, "臺甲", 1, "訴", 1, None, None, None, None, ""), (4, " 台甲", 1, "訴", 1, None, None, None, None, ""), (6, "臺甲", 1, "訴", 1, "民事", None, None, None, ""), (7, None, None, None, None, None, None, None, None, "")], D)
    assert {tuple(r) for r in graph.canonical_ids(d).collect()} == {(4, 4), (5, 4), (6, 6), (7, 7)}
    assert graph.canonical_ids(d.limit(0)).collect() == []


def test_counts_over_groups(spark):
    d = spark.createDataFrame([(1, None, None, None, None, None, None, None, 1, ""), (2, None, None, None, None, None, None, None, 1, ""), (3, None, None, None, None, None, None, None, None, "")], D)
    c = spark.createDataFrame([(1, 10, 1), (2, 10, 2), (3, 11, 2), (3, 11, 2), (4, None, 1), (5, 12, 99), (6, 12, None)], "id long, source_id long, target_id long")
    assert {tuple(r) for r in graph.citation_counts(d, c).collect()} == {(1, 2), (2, 2), (3, 0)}


def test_pair_windows_order_limit_and_blanks(spark):
    rows = [(i, 1, "t", f" s{i % 12} ") for i in range(30, 0, -1)] + [(40, 2, "t", None), (41, 2, "t", "　 ")]
    got = {r.source_id: (r.merged_citation_count, r.window_text) for r in windows.pair_windows(spark.createDataFrame(rows, "id long, source_id long, target_uid string, snippet string")).collect()}
    assert got == {1: (30, "\n".join(f"s{i}" for i in range(1, 9))), 2: (2, "")}


def test_recall_and_specs(spark):
    d = spark.createDataFrame([(1, "民事", "甲乙"), (2, "刑事", "甲丙"), (3, None, None), (None, "民事", "甲乙"), (1, "民事", "甲乙")], "id long, case_type string, clean_text string")
    c = spark.createDataFrame([(1, 1), (2, 2)], "id long, source_id long")
    s = spark.createDataFrame([(1, " 民法 ", "1", "第1項前段"), (2, "民法", "2", None)], "citation_id long, law string, article_raw string, sub_ref string")
    run = lambda *a, **k: {r[0] for r in recall.recalled(d, c, s, SearchSpec(*a, **k)).collect()}
    assert run(("甲",)) == {1, 2}
    assert run(("甲",), exclude_keywords=("丙",)) == {1}
    assert run(("甲",), statutes=(StatuteFilter("民法", None, "第1項"),)) == {1}
    assert run(("甲",), exclude_statutes=(StatuteFilter("民法", "1"),)) == {2}
    assert run(("甲",), case_types=("刑事",)) == {2}
    with pytest.raises(ValueError, match="keyword"):
        recall.checked(SearchSpec((" ",)))
    with pytest.raises(ValueError, match="unknown"):
        recall.normal_case_types("民事,商事")


def test_previews(spark):
    c = spark.createDataFrame([(1, 10, "AB"), (2, 10, "ab cd"), (3, 11, None), (4, 12, "cd")], "id long, source_id long, snippet string")
    s = spark.createDataFrame([(4, "民法", "1", "")], "citation_id long, law string, article_raw string, sub_ref string")
    spec = SearchSpec(("ab", "CD"), (StatuteFilter("民法"),))
    rows = preview.scored(c, s, spec)
    assert {r.id: r.score for r in rows.collect()} == {1: 1, 2: 2, 3: 0, 4: 2}
    assert [r.id for r in preview.matched(rows, (10, 11, 12)).collect()] == [2, 4, 3]
    assert preview.matched(rows, ()).collect() == []
    inside = spark.createDataFrame([(10,)], "source_id long")
    assert [tuple(r) for r in preview.others(c, inside).collect()] == [(3, 11), (4, 12)]
    assert tuple(preview.counts(c, inside, 0).first()) == (1, 0)
    assert [r.id for r in preview.more(rows, spark.createDataFrame([(10,), (11,), (12,)], "source_id long"), (12,), 5).collect()] == [2, 3]


def test_page_numbers(spark):
    rows = spark.createDataFrame([("a", 1, 1, 1, None)], "target_uid string, reached int, matched int, total int, court_level int")
    assert ranking.page(rows).count() == 1
    with pytest.raises(ValueError, match="page"):
        ranking.page(rows, number=0)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert [(r.id, round(r.similarity, 3)) for r in semantic.nearest_chunks(df, [1.0, 0.0]).collect()] == [(1, 1.0), (5, 0.6)]
    assert [list(r[0]) for r in df.where("id in (2, 5)").orderBy("id").select(semantic.unit(F.col("embedding"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    t = spark.createDataFrame([("h", "x")], "text_hash string, text string")
    assert list(semantic.embedded(t, lambda ts: [[3.0, 4.0]] * len(ts)).first().embedding) == [0.6, 0.8]


@pytest.mark.parametrize("block", [2, 128])
def test_label_measures(spark, monkeypatch, block):
    monkeypatch.setattr(semantic, "QUERY_BLOCK", block)
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 1, 2, None]) if i % 20 else i // 20 % 3, [round(rng.gauss(0, 1), 2) for _ in range(4)]) for i in range(130)]
    rows += [(130, 0, None), (131, 0, [0.0] * 4), (132, 1, [1.0]), (133, 2, rows[41][2])]
    df = spark.createDataFrame(rows, "id long, label int, embedding array<double>").repartition(3)
    got = {r.query_id: (r.gap, r.recall) for r in semantic.label_measures(df, df.where("id % 20 = 0"), 4).collect()}
    length = lambda v: sum(x * x for x in v) ** 0.5
    want = {}
    for i, label, v in rows[:121:20]:
        sims = [(sum(a * b for a, b in zip(v, w, strict=True)) / length(v) / length(w), j, m) for j, m, w in rows if j != i and w and len(w) == 4 and any(w)]
        mean = lambda x: sum(x) / len(x)
        gap = mean([s for s, _, m in sims if m == label]) - mean([s for s, _, m in sims if m is not None and m != label])
        top = sorted(sims, key=lambda s: (-round(s[0], 6), s[1]))[:5]
        want[i] = (pytest.approx(gap), pytest.approx(sum(m == label for _, _, m in top) / sum(m == label for j, m, _ in rows if j != i)))
    assert got == want and len(got) == 7


@pytest.mark.parametrize("block", [2, 128])
def test_nearest_of_queries(spark, monkeypatch, block):
    monkeypatch.setattr(semantic, "QUERY_BLOCK", block)
    rng = random.Random(8)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(1, 120)] + [(120, None), (121, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    found = semantic.nearest_of_queries(df, df.where("id % 20 = 0"), 7, 3).collect()
    queries = [(i, v) for i, v in rows if i % 20 == 0 and v and any(v)]
    for i, v in queries:
        want = [(r.id, round(r.similarity, 6)) for r in semantic.nearest_chunks(df, v, 7).collect()]
        assert sorted((r.id, round(r.similarity, 6)) for r in found if r.query_id == i) == sorted(want)
    assert {r.query_id for r in found} == {i for i, _ in queries} and len(queries) >= 4


def test_writeback_of_pending(spark, tmp_path):
    from casemesh.plans.vector_queries import embed_writeback

    rows = [(1, "a", [0.5]), (2, "a", None), (3, "b", [0.25]), (4, "b", [0.75]), (5, "b", None), (6, "c", None), (7, "d", [1.0])]
    spark.createDataFrame(rows, "id long, chunk_text string, embedding array<float>").write.parquet(f"{tmp_path}/chunks.parquet")
    assert {tuple(r) for r in embed_writeback(spark, str(tmp_path)).collect()} == {(2, 0.5), (5, 0.25)}


def test_vectors_that_were_made_are_kept(spark, tmp_path):
    made = []
    at = str(tmp_path)
    k = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None), (4, None, None), (5, "c", [1.0])], "id long, chunk_text string, embedding array<float>")

    def embed(texts):
        with open(f"{at}/asked", "a") as f:
            f.write("".join(texts))
        return [[3.0, 4.0] for _ in texts]

    assert semantic.embed_missing(k.where("id < 3"), embed, at, "m").count() == 1
    assert sorted(open(f"{at}/asked").read()) == ["a"] and made == []
    v = semantic.embed_missing(k, embed, at, "m")
    assert v.count() == 3 and sorted(open(f"{at}/asked").read()) == ["a", "b", "c"] and list(v.first().embedding) == [0.6, 0.8]
    first = semantic.pending_after(k, None, 1).first()
    rest = semantic.pending_after(k, first.text_hash, 5).collect()
    assert len(rest) == 1 and rest[0].text_hash > first.text_hash and first.n_chunks + rest[0].n_chunks == 3


def test_rebuild_of_a_month(spark):
    d = spark.createDataFrame([(1, "理由\n一、甲乙丙。", date(2024, 1, 31)), (2, "理由\n一、丁戊己。", date(2024, 2, 1)), (3, None, date(2024, 1, 5))], "id long, clean_text string, decision_date date")
    c = spark.createDataFrame([(10, 1, 5, 6, None, 7, None), (20, 2, 5, 6, None, None, 8)], "id long, source_id long, match_start int, match_end int, snippet string, target_id long, target_authority_id long")
    k = spark.createDataFrame([(100, 1, 10, "old", [1.0]), (200, 2, 20, "stays", [2.0])], "id long, decision_id long, citation_id long, chunk_text string, embedding array<float>")
    out = {r.decision_id: (r.id, r.chunk_text) for r in chunking.rebuilt(k, d, c, 2024, 1).collect()}
    assert out == {1: (None, "一、甲乙丙。"), 2: (200, "stays")}
    assert {r.decision_id: r.id for r in chunking.rebuilt(k, d, c).collect()} == {1: None, 2: None}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("一、原告主張略以：依X", True), ("一、原告主張：甲。\n二、本院之判斷：依X", False), ("一、原告主張：甲。\n二、按依X", False), ("二、本院之判斷：\n㈠上訴意旨略以：依X", True), ("依X", False), ("𠮷一、被告則以依X", True),
    ],
)
def test_older_conditions(spark, text, want):
    from casemesh.operators import guards

    df = spark.createDataFrame([(text, text.index("X"))], "text string, at int")
    assert df.select(guards.in_party_section(F.col("text"), F.col("at"))).first()[0] == want


def test_claims_and_intent(spark):
    from casemesh.operators import guards

    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(guards.claim_snippet(F.lit("依A號判決云云。"), F.lit("A號"))) and not one(guards.claim_snippet(F.lit("主張云云，惟A號判決參照。"), F.lit("A號")))
    assert one(guards.claim_snippet(F.lit("依A號判決云云，並非可採。"), F.lit("A號"))) and not one(guards.claim_snippet(F.lit(None).cast("string"), F.lit("A號")))
    assert not one(guards.lacks_intent(F.lit("A號判決意旨參照"), F.lit(2))) and one(guards.lacks_intent(F.lit("A號判決在一二三四五六七八九十參照"), F.lit(2)))


def test_text_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.date_of(F.lit("20240230"))) is None and one(T.date_of(F.lit("20240229"))) == date(2024, 2, 29) and one(T.date_of(F.lit("2024"))) is None
    assert one(T.doc_type(F.lit("臺灣甲院　宣 示 判 決"))) == "宣判筆錄"
    assert one(T.simple_court(F.lit("臺灣甲地方法院乙簡易庭"))) == "臺灣甲地方法院"
    assert one(T.display_title(F.lit(None).cast("int"), F.lit("訴"), F.lit(1))) == ""
    assert one(T.squeezed_han(F.lit("甲 乙　1\r\n2 a b"))) == "甲乙1\r\n2 a b"
    s = one(T.sections(F.lit("院判決\r\n主　文\r\n駁回。\r\n事實\r\n甲。\r\n理由\r\n乙。")))
    assert tuple(s) == ("院判決", "駁回。", "甲。", "乙。")


def test_cache_times_and_sizes(spark):
    now = [0.0]
    cache = SearchCache(10, 2, lambda: now[0])
    df = spark.range(1)
    for k in "abc":
        cache.put(k, df)
    assert len(cache) == 2 and cache.get("a") is None
    now[0] = 5
    cache.update("b", df)
    now[0] = 11
    assert cache.get("c") is None and cache.get("b") is not None
    assert signature(SearchSpec(("a",))) == signature(SearchSpec(("a",))) != signature(SearchSpec(("b",)))


def test_cache_keeps_orders_until_the_rankings_change(spark):
    dropped = []
    cache = SearchCache(10, 1)
    cache.put("a", spark.range(3), spark.range(5), lambda: dropped.append("a"))
    made = []
    make = lambda df: made.append(1) or df.orderBy(F.desc("id"))
    assert [r.id for r in cache.order("a", "down", make).collect()] == [4, 3, 2, 1, 0]
    assert cache.order("a", "down", make) is cache.order("a", "down", make) and made == [1]
    cache.update("a", spark.range(2))
    assert [r.id for r in cache.order("a", "down", make).collect()] == [1, 0] and made == [1, 1]
    assert cache.order("missing", "down", make) is None
    cache.put("b", spark.range(1))
    assert dropped == ["a"]


def test_tables_are_removed_with_their_context(spark):
    import os

    from casemesh.operators.durable import Tables, cut

    kept = Tables()
    with Tables() as some:
        inside = cut(spark.range(4))
        out = kept.cut(inside.where("id > 1"))
        (path,) = some.paths
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://")) and [r.id for r in out.orderBy("id").collect()] == [2, 3]
    kept.release()


def test_requests():
    spec = recall.spec_of({"keywords": [" a ", "a"], "statutes": [{"law": "民訴法", "article": "1"}, ["民事訴訟法", "1"]], "case_types": "民事, 刑事"})
    assert spec == SearchSpec(("a",), (StatuteFilter("民事訴訟法", "1"),), case_types=("民事", "刑事"))
    with pytest.raises(ValueError, match="unknown fields"):
        recall.spec_of({"keywords": ["a"], "page": 2})
    with pytest.raises(ValueError, match="keyword"):
        recall.spec_of({})


def test_edges_keep_their_ids(spark):
    columns = "id long, source_id long, target_id long, target_authority_id long, match_start int, match_end int, snippet string, created_at timestamp_ntz"
    old = spark.createDataFrame([(1, 10, 5, None, 0, 9, "a", None), (2, 10, 6, None, 20, 29, "b", None), (3, 11, 5, None, 0, 9, "c", None), (4, 12, None, 7, 3, 9, "d", None)], columns)
    new = spark.createDataFrame([(-1, 10, 5, None, 0, 8, "old", None), (-1, 10, 5, None, 0, 9, "new", None), (-1, 10, 6, None, 21, 30, "moved", None), (-1, 12, None, 7, 3, 9, "d", None)], columns)
    out = {(r.source_id, r.match_start): (r.id, r.snippet) for r in graph.replaced_by_source(old, new, spark.createDataFrame([(10,), (12,), (13,)], "source_id long")).collect()}
    assert out[10, 0] == (1, "new") and out[11, 0] == (3, "c") and out[12, 3] == (4, "d") and out[10, 21][0] not in (1, 2, -1) and len(out) == 4
    again = graph.replaced_by_source(old, new, spark.createDataFrame([(10,)], "source_id long"))
    assert {r.id for r in again.where("match_start = 21").collect()} == {out[10, 21][0]}
    assert graph.replaced_by_source(old.limit(0), new.limit(0), spark.createDataFrame([], "source_id long")).collect() == []


def test_phrase_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    from casemesh.operators import phrase_index as I

    rng = random.Random(12)
    rows = [(i, rng.choice(["民事", "刑事", None]), "".join(rng.choice("甲乙丙𠮷a ") for _ in range(rng.randrange(40))), "x") for i in range(300)]
    rows += rows[:20] + [(900, "民事", None, ""), (901, "民事", "", ""), (None, "民事", "甲乙丙", "")]
    d = spark.createDataFrame(rows, "id long, case_type string, clean_text string, note string")
    I.build(d, str(tmp_path / "index"))
    assert I.indexed(spark, str(tmp_path / "index")) and not I.indexed(spark, str(tmp_path / "none"))
    for listed in (5000, 3):
        monkeypatch.setattr(I, "LISTED", listed)
        for spec in (SearchSpec(("甲乙",)), SearchSpec(("甲乙丙𠮷",)), SearchSpec(("乙甲", "a ")), SearchSpec(("甲",)), SearchSpec(("甲乙",), (), ("丙丙",), (), ("民事",)), SearchSpec(("無此",))):
            want = {tuple(r) for r in recall.keyword_hits(d, spec).collect()}
            assert {tuple(r) for r in I.hits(spark, str(tmp_path / "index"), spec).collect()} == want, spec
    I.build(d.limit(0), str(tmp_path / "empty"))
    assert I.hits(spark, str(tmp_path / "empty"), SearchSpec(("甲乙",))).collect() == []


def test_batch_and_stream(spark, tmp_path):
    import json

    folder = tmp_path / "202401" / "臺灣高等法院民事"
    folder.mkdir(parents=True)
    text = "臺灣高等法院民事判決\r\n上列當事人間事件，本院判決如下：\r\n主文\r\n駁回。\r\n理由\r\n一、按民法第1條規定，最高法院100年度台上字第5號判決意旨參照。"
    base = {"JID": "A,1", "JYEAR": "113", "JCASE": "臺上", "JNO": "7", "JDATE": "20240105", "JTITLE": "t", "JFULL": text, "JPDF": ""}
    for i, change in enumerate(({}, {"JID": "A,2", "JDATE": "20240231"}, {"JID": "A,3", "JNO": "x"})):
        (folder / f"{i}.json").write_text(json.dumps(base | change, ensure_ascii=False))
    (folder / "9.json").write_text("{bad")
    courts = spark.createDataFrame([(1, "臺灣高等法院")], "id long, unit_norm string")
    d = spark.createDataFrame([], D)
    out = ingest.batch(spark, str(tmp_path / "202401"), courts, d)
    assert sorted((r.file_name, r.kind) for r in out["errors"].collect()) == [("1.json", "source_decision"), ("2.json", "source_decision"), ("9.json", "json_read")]
    r = out["rulings"].first()
    assert (r.jid, r.jcase_norm, r.doc_type, r.case_type, r.state) == ("A,1", "台上", "判決", "民事", "new")
    assert [(c.court, c.jno) for c in out["citations"].collect()] == [("最高法院", 5)]
    assert [s.law for s in out["snippet_statutes"].collect()] == ["民法"]
    assert ingest.batch(spark, str(tmp_path / "202401"), courts, d, word="刑事")["rulings"].count() == 0
    assert [(s.law, s.article_raw) for s in out["statutes"].collect()] == [("民法", "1")]

    from casemesh.streaming.ingest import run

    places = spark.createDataFrame([(77, "臺灣高等法院", 113, "台上", 7, "民事", "判決", None, 77, "")], D)
    query = run(spark, str(tmp_path / "202401"), courts, places, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert [(r.id, r.state) for r in read("rulings").collect()] == [(77, "filled")]
    assert [r.source_id for r in read("citations").collect()] == [77] and [r.decision_id for r in read("statutes").collect()] == [77]
    assert read("errors").count() == 3 and read("snippet_statutes").count() == 1
    (folder / "4.json").write_text(json.dumps(base, ensure_ascii=False))  # the same ruling again, and another
    (folder / "5.json").write_text(json.dumps(base | {"JID": "A,9", "JNO": "8"}, ensure_ascii=False))
    run(spark, str(tmp_path / "202401"), courts, places, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    later = {r.jid: (r.id, r.state) for r in read("rulings").where("batch > 0").collect()}
    assert later["A,1"] == (77, "known") and later["A,9"][1] == "new"

    ledger = ingest.months(spark, [str(tmp_path / "202401")], courts, places, str(tmp_path / "months"), ("甲乙法",))
    assert [(r.folder_name, r.n_files, r.n_errors) for r in ledger.collect()] == [("202401", 2, 3)]
    assert spark.read.parquet(str(tmp_path / "months/statutes")).where("law = '民法'").count() == 2


def test_no_citation_is_proposed_that_isnt_one(spark, data):
    """On the rulings' own texts every proposal is an edge of the table."""
    from casemesh.plans.text_queries import _own_courts, _rulings

    found = {(r.id, r.match_start) for r in extract.proposals(_rulings(spark, data), _own_courts(spark, data)).select("id", "match_start").collect()}
    edges = {(r.source_id, r.match_start) for r in spark.read.parquet(f"{data}/citations.parquet").collect()}
    assert found and found <= edges
