"""Parsers on hand-written texts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casemesh.parse import chunks as K
from casemesh.parse import citations as C
from casemesh.parse import cleaner, marks, reasonings, statutes

HEAD = "主文\r\n被告應給付。\r\n理由\r\n"
OWN = "台灣台北地方法院"


def found(text):
    return [(p.court, p.jyear, p.jcase_norm, p.jno, p.doc_type) for p in C.rulings(text, OWN)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("最高法院100年度台上字第5號判決參照。", [("最高法院", 100, "台上", 5, "判決")]),
        ("最高法院 99 年 度 臺上 字第 7 號裁判參照", [("最高法院", 99, "台上", 7, None)]),
        ("最高法院100年度台上字第5號、101年台抗字第6號裁定", [("最高法院", 100, "台上", 5, "裁定"), ("最高法院", 101, "台抗", 6, "裁定")]),
        ("最高法院100年度台上字第5號。最高法院101年台抗字第6號裁定", [("最高法院", 100, "台上", 5, None), ("最高法院", 101, "台抗", 6, "裁定")]),
        ("最高法院100年度台上字第5號，最高行政法院101年判字第6號判決", [("最高法院", 100, "台上", 5, None), ("最高行政法院", 101, "判", 6, "判決")]),
        ("本院100年度訴字第5號判決", [(OWN, 100, "訴", 5, "判決")]),
        ("原審本院100年度訴字第5號判決", []),
        ("臺灣甲地方法院100年度訴字第5號判決、101年度訴字第6號判決", []),
        ("北高行100年度訴字第5號判例", [("台北高等行政法院", 100, "訴", 5, "判例")]),
        ("憲法法庭111年憲判字第2號、第3號判決", [("憲法法庭", 111, "憲判", 2, "憲判字"), ("憲法法庭", 111, "憲判", 3, "憲判字")]),
        ("最高法院刑事大法庭108年度台上大字第3594號裁定", [("最高法院", 108, "台上大", 3594, "裁定")]),
    ],
)
def test_rulings(text, want):
    assert found(text) == want


def test_quick_scan_finds_what_the_pattern_finds():
    parts = ["最高法院", "臺灣高等法院", "甲", "（乙）", "100年度台上字第5號", "、", "101年訴字第6號", " ", "本院", "1", "判決", "臺北高等行政法院", "原審"]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(parts), max_size=12).map("".join))
    def same(text):
        a, b = C._full(text, 0), C.FULL.search(text, 0)
        assert (a and a.span()) == (b and b.span())

    same()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("最高法院77年度第9次民事庭會議決議", [("resolution", "民事庭|77|9")]),
        ("最高行政法院103年8月份第1次庭長法官聯席會議決議", [("admin_resolution", "最高行政法院|103|8|1")]),
        ("司法院釋字第400號、第402號解釋", [("grand_interp", "釋字|400"), ("grand_interp", "釋字|402")]),
        ("臺灣高等法院暨所屬法院95年法律座談會民事類提案第二十一號", [("conference", "高等法院|95|21")]),
        ("高等行政法院96年法律座談會", [("conference", "高等行政法院|96")]),
        ("民國100年1月司法院第3號研審小組意見", [("agency_opinion", "研審小組|100|3")]),
    ],
)
def test_authorities(text, want):
    assert [(p.auth_type, p.auth_key) for p in C.proposals(text, OWN) if p.citation_type == "authority"] == want


def test_windows_and_snippets():
    text = HEAD + "一、原告主張甲，乙丙丁，參照最高法院100年度台上字第5號判決意旨，可知戊。己。"
    p = C.rulings(text, OWN)[0]
    w = C.surroundings(text, p)
    assert w["clause"] == "乙丙丁，參照最高法院100年度台上字第5號判決意旨，可知戊"
    assert w["post_sentence"] == "意旨，可知戊。"
    assert w["snippet"].startswith("一、原告") and w["snippet"].endswith("可知戊。")
    quoted = "前文。按甲（最高法院100年度台上字第5號判決參照）乙。"
    q = C.rulings(quoted, OWN)[0]
    assert quoted[C.snippet_start(quoted, q.match_start) : C.snippet_end(quoted, q.match_start, q.match_end)] == "按甲（最高法院100年度台上字第5號判決參照）"
    assert C.surroundings("最高法院100年度台上字第5號", C.rulings("最高法院100年度台上字第5號", OWN)[0])["snippet"] == "最高法院100年度台上字第5號"


@pytest.mark.parametrize(("s", "n"), [("十", 10), ("二十一", 21), ("百零三", 103), ("三百二十", 320), ("七", 7), ("12", 12)])
def test_number(s, n):
    assert C.number_of(s) == n


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("民法第184條第1項前段、第2項", [("民法", "184", "第1項前段"), ("民法", "184", "第2項")]),
        ("臺灣之民訴法第4條之1", [("民事訴訟法", "4之1", "")]),
        ("民法第1條第1、2項", [("民法", "1", "第1項"), ("民法", "1", "第2項")]),
        ("同法第3條", []),
        ("民法第1條及同法第3條", [("民法", "1", ""), ("民法", "3", "")]),
        ("消費者保護法（下稱消保新法）第7條，消保新法第8條", [("消費者保護法", "7", ""), ("消費者保護法", "8", "")]),
        ("民法第1條、第1條", [("民法", "1", "")]),
        ("無名法第1條", []),
        ("", []),
        (None, []),
    ],
)
def test_statutes(text, want):
    assert [s[:3] for s in statutes.statutes(text)] == want


def test_added_names():
    assert statutes.statutes("甲乙法第2條", ("甲乙法",))[0][:2] == ("甲乙法", "2")


def test_cleaner_joins_wrapped_lines_and_cuts_after_the_clerk():
    raw = "臺 灣 甲 地方法院民事判決\r\n原　告　某\r\n上列當事人間事件，本院判決如下：\r\n　　主　文\r\n被告應給\r\n付。\r\n　　理　由\r\n一、甲乙\r\n丙丁。\r\n\r\n㈠戊。\r\n中　華　民　國　113　年　1　月　2　日\r\n如不服本\r\n判決\r\n書記官　某\r\n附錄"
    assert cleaner.clean(raw).split("\r\n") == [
        "臺灣甲地方法院民事判決", "原　告　某", "上列當事人間事件，本院判決如下：", "　主文", "被告應給付。", "　理由", "一、甲乙丙丁。", "㈠戊。",
        "中　華　民　國　113　年　1　月　2　日", "如不服本判決", "書記官　某",
    ]
    assert cleaner.clean(None) is None and cleaner.clean("") == ""
    assert cleaner.clean("甲\r\n乙\r\n") == "甲\r\n乙\r\n"


def test_chunk_bounds_hold_the_citation():
    body = "理由\n" + "".join(f"\n{n}、" + "甲乙丙。" * 60 for n in "一二三四五六七八九十")
    cuts = K.Cuts(body)
    signs = cuts.items.tolist()
    assert [body[i] for i in signs] == list("一二三四五六七八九十")
    one = lambda start, end, limit=K.LIMIT: tuple(int(x[0]) for x in cuts.bounds(np.array([start]), np.array([end]), limit))
    assert one(signs[3] + 20, signs[3] + 30) == (signs[3], signs[4])

    @settings(max_examples=200, deadline=None)
    @given(st.integers(0, len(body) - 10), st.integers(1, 300), st.integers(20, 400))
    def holds(start, size, limit):
        end = min(len(body), start + size)
        low, high = one(start, end, limit)
        assert 0 <= low <= start and end <= high <= len(body)
        assert high - low <= max(limit, end - start + K.LEAST_BEFORE)

    holds()


def test_chunks_of_many_citations_at_once():
    body = "主文\n駁回。\n理由\n" + "".join(f"\n{n}、" + "甲乙丙。" * 200 for n in "一二三") + "\n中　華　民　國"
    cuts = K.Cuts(body)
    start = np.arange(20, len(body) - 40, 37)
    low, high = cuts.bounds(*cuts.spans(start, start + 9, [body[max(0, s - 60) : s + 20][:80] for s in start.tolist()], np.full(len(start), 80)))
    for i, s in enumerate(start.tolist()):
        a, b = cuts.bounds(*cuts.spans(start[i : i + 1], start[i : i + 1] + 9, [body[max(0, s - 60) : s + 20][:80]], np.array([80])))
        assert (low[i], high[i]) == (a[0], b[0])
    assert high.max() == body.index("中　華") and low.min() >= 0
    run, first, last = K.runs(low, high)
    assert (first <= low).all() and (last >= high).all() and run.min() == 0
    none = np.empty(0, dtype=np.int64)
    assert [len(x) for x in K.runs(none, none)] == [0, 0, 0]


def test_parties_before_reasons():
    head = "某法院裁定\n原　告　甲\n　　　　乙\n被　告　丙\n　　　　丁\n" + "本件駁回。" * 10
    assert K.reasons_floor(head) == head.index("本件")
    assert K.reasons_floor("無標題") == 0 and K.reasons_floor("") == 0


@pytest.mark.parametrize(
    ("text", "laws"),
    [
        ("依水土保持法第8條、政府資訊公開法第18條第1項", [("水土保持法", "8"), ("政府資訊公開法", "18")]),
        ("按都市危險及老舊建築物加速重建條例第5條", [("都市危險及老舊建築物加速重建條例", "5")]),
        ("依勞工保險條例施行細則第9條及道路交通事故處理辦法第12條", [("勞工保險條例施行細則", "9"), ("道路交通事故處理辦法", "12")]),
        ("違反再生能源發展條例第3條", [("再生能源發展條例", "3")]), ("民法與水土保持法第3條", [("水土保持法", "3")]),
        ("上開方法第2條", []), ("依本辦法第3條", []), ("同法第3條", []), ("不法第3條", []), ("民法第3條", []), (None, []), ("", []),
    ],
)
def test_laws_by_rule(text, laws):
    names = tuple(statutes.likely_names(text))
    assert names == tuple(law for law, _ in laws)
    found = [s[:2] for s in statutes.statutes(text, names)]
    assert [f for f in found if f[0] != "民法"] == laws


def test_number_chains_need_a_listing_sign():
    keys = lambda t: [p.auth_key for p in C.proposals(t, "")]
    assert keys("司法院釋字第400號、第425號及第500號解釋") == ["釋字|400", "釋字|425", "釋字|500"]
    assert keys("司法院釋字第400號，第425號解釋") == ["釋字|400"]
    assert [p.jno for p in C.proposals("憲法法庭111年憲判字第1號，第2號", "")] == [1]


def test_marks():
    assert marks.highlights("ABC民法abc", ["abc"], ["民法"]) == [(0, 3, "keyword"), (3, 5, "statute"), (5, 8, "keyword")]
    assert marks.highlights(None, ["a"], []) == [] and marks.highlights("a", [], []) == []
    assert marks.answer_tags('x<cite type="source" id="3">y</cite>') == [("cite", "source", "3", "y")]


def test_reasonings():
    head = "主文\n駁回。\n理由\n" + "前" * 300 + "\n經查，" + "甲乙。" * 10
    items = "".join(f"\n{n}、" + "丙丁戊。" * 350 for n in "一二三")
    text = head + items + "\n中　華　民　國"
    parts = reasonings.reasoning_chunks(text)
    assert text[parts[0][1] :].startswith("經查") and text[parts[-1][2] :].strip().startswith("中")
    assert all(150 <= b - a <= 2000 for _, a, b in parts)
    assert [x[1:] for x in parts][1:] == [(b, d) for (_, _, b), (_, _, d) in zip(parts, parts[1:], strict=False)]
    assert reasonings.reasoning_chunks("短") == [] and reasonings.reasoning_chunks(None) == []
    long = "經查" + "字" * 6000
    assert [b - a for _, a, b in reasonings.reasoning_chunks(long)] == [2000, 2000, 2000] and len(long) == 6002
