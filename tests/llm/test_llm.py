"""Operators for training data against brute force and on awkward tables."""

import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casemesh.llm import joins, lines, mixing, neighbours, packing, pieces, private, spans, stuffing, tokens

# --- lines -----------------------------------------------------------------------------------------------------------

DOC = "id long, unit string, text string, note string"


def brute_lines(rows):
    docs = {}
    for i, unit, text, _ in rows:
        if i is not None and unit is not None and text:
            docs[i] = (re.sub(r"^\s+|\s+$", "", unit).replace("台", "臺"), text)
    sizes, seen = defaultdict(int), defaultdict(set)
    signs = lambda s: "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in s if not c.isspace())
    for i, (u, t) in docs.items():
        sizes[u] += 1
        for x in re.split("\r?\n", t):
            if len(signs(x)) >= 8:
                seen[u, signs(x)].add(i)
    hot = {k for k, v in seen.items() if len(v) >= 5 and len(v) >= 0.04 * sizes[k[0]]}
    return {(i, n) for i, (u, t) in docs.items() for n, x in enumerate(re.split("\r?\n", t), 1) if (u, signs(x)) in hot}


@pytest.mark.parametrize("limit", [0, 16 << 20])
def test_repeated_lines(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    rng = random.Random(1)
    notice = ["本網頁內容僅供參考用", "分享本裁判：電子郵件", "短句", "服務電話：(02)1234", "服　務電話：（０２）１２３４"]
    rows = []
    for i in range(160):
        body = [f"第{i}件的獨有內容一二三{k}" for k in range(rng.randrange(4))]
        body += [x for x in notice if rng.random() < 0.3] + ([] if i % 40 else ["罕見但重複的一行文字"])
        rng.shuffle(body)
        rows.append((i, ["甲院", " 台乙院 ", "臺乙院"][min(i % 5, 2)], rng.choice(["\n", "\r\n"]).join(body), "x"))
    rows += rows[:20] + [(None, "甲院", "本網頁內容僅供參考用", ""), (900, None, "本網頁內容僅供參考用", ""), (901, "甲院", None, ""), (902, "甲院", "", ""), (903, "甲院", "長" * 50_000, "")]
    df = spark.createDataFrame(rows, DOC)
    found, blocks = lines.repeated_lines(df)
    want = brute_lines(rows)
    assert want and {(r.id, r.line_no) for r in found.collect()} == want
    assert found.count() == len(want)
    out = {r.id: r.text for r in lines.without_lines(df, found).collect() if r.id is not None}
    for i, _, text, _ in rows:
        if i is not None and text:
            kept = [x for n, x in enumerate(re.findall(r"[^\n]*\n|[^\n]+", text), 1) if (i, n) not in want]
            assert out[i] == "".join(kept)
    assert out[901] is None and out[902] == ""


def test_blocks_are_components(spark):
    a, b, c = "第一行的通知文字", "第二行的通知文字", "另一處的通知文字"
    rows = [(i, "u", "\n".join([a, b, f"內容內容內容內容{i}", c]), "") for i in range(30)]
    _, blocks = lines.repeated_lines(spark.createDataFrame(rows, DOC))
    sizes = sorted(r["count"] for r in blocks.groupBy("block").count().collect())
    assert sizes == [3]  # kept lines follow one another over a line that isn't kept
    rows = [(i, "u", "\n".join([a, b] if i % 2 else [c, f"內容內容內容內容{i}"]), "") for i in range(30)]
    found, blocks = lines.block_occurrences(spark.createDataFrame(rows, DOC))
    assert sorted(r["count"] for r in blocks.groupBy("block").count().collect()) == [1, 2]
    assert sorted((r.id, tuple(r.line_nos)) for r in found.collect()) == [(i, (1, 2) if i % 2 else (1,)) for i in range(30)]


def test_no_lines(spark):
    found, blocks = lines.repeated_lines(spark.createDataFrame([], DOC))
    assert found.collect() == [] and blocks.collect() == []


# --- pieces ----------------------------------------------------------------------------------------------------------


def brute_cuts(text, limit, overlap):
    after = {p + 1 for p, c in enumerate(text) if c in pieces.ENDS and text[p : p + 2] != "\r\n"} | {len(text)}
    natural = after | {p for p, c in enumerate(text) if c in pieces.ENDS}
    out, start, prev = [], 0, 0
    while text:
        high = min(len(text), start + limit)
        ends = [p for p in range(prev + 1, high + 1) if p in after]
        end = max(ends, default=high)
        out.append((max(start, 0), end, end in natural))
        if end >= len(text):
            break
        prev, start = end, end - overlap
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab。\n\r；cd𠮷", max_size=90), min_size=1, max_size=5), st.integers(2, 25), st.integers(0, 24))
def test_cuts(texts, limit, overlap):
    overlap = min(overlap, limit - 1)
    which, number, start, end, natural = pieces.cuts(texts, limit, overlap)
    for i, t in enumerate(texts):
        at = which == i
        assert list(zip(start[at].tolist(), end[at].tolist(), natural[at].tolist(), strict=True)) == brute_cuts(t, limit, overlap)
        assert number[at].tolist() == list(range(1, at.sum() + 1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab。\n\r；c", max_size=60), min_size=1, max_size=4), st.integers(1, 12))
def test_forced_means_a_run_over_the_limit(texts, limit):
    which, _, _, _, natural = pieces.cuts(texts, limit, 0)
    for i, t in enumerate(texts):
        longest = max(map(len, re.split("[\r\n。！？；]", t)))
        assert (not natural[which == i].all()) == (longest > limit)


def test_pieces_and_their_citations(spark):
    text = "甲乙丙丁。" * 1000
    d = spark.createDataFrame([(1, text), (1, text), (2, "短"), (3, None), (None, text), (4, "x" * 2001)], "id long, clean_text string")
    k = spark.createDataFrame([(7, 1, 100, text[100:3000]), (8, None, None, "𠮷" * 2500)], "id long, decision_id long, start_offset int, chunk_text string")
    c = spark.createDataFrame([(i, 1, i * 50) for i in range(100)] * 2 + [(999, 1, None), (None, 1, 5)], "id long, source_id long, match_start int")
    items = pieces.oversized(d, k)
    out = pieces.with_citations(pieces.pieces(items), k, c).collect()
    assert {(r.item_table, r.item_id) for r in out} == {("decisions", 1), ("decisions", 4), ("chunks", 7), ("chunks", 8)}
    for r in out:
        assert len(r.piece_text) == r.end_pos - r.start_pos <= 2000
        if (r.item_table, r.item_id) in (("decisions", 1), ("chunks", 7)):
            shift = 100 if r.item_table == "chunks" else 0
            assert list(r.citation_ids) == [i for i in range(100) if r.start_pos <= i * 50 - shift < r.end_pos]
    kinds = {(r.item_table, r.item_id): r.cut_kind for r in pieces.cut_kinds(items).collect()}
    assert kinds == {("decisions", 1): "natural", ("chunks", 7): "natural", ("decisions", 4): "forced", ("chunks", 8): "forced"}
    assert pieces.pieces(items.limit(0)).collect() == []


# --- personal information --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("原　告　王小明　身分證統一編號：A123456789", [("name", "王小明"), ("idno", "A123456789")]),
        ("電話：0912-345-678　電子信箱：a.b-c+1@mx.b.test", [("phone", "0912-345-678"), ("email", "a.b-c+1@mx.b.test")]),
        ("有王小明自ab (at) c.example寄出之信件", [("name", "王小明"), ("email", "ab (at) c.example")]),
        ("信箱ab[at]c[dot]test亦收到", [("email", "ab[at]c[dot]test")]),
        ("聯絡電話（０２）１２３４－５６７８，", [("phone", "（０２）１２３４－５６７８")]),
        ("電話：+886-912-345-678", [("phone", "+886-912-345-678")]),
        ("服　務　電　話：(02)0631-3772，受理", []),
        ("院址：甲乙市丙丁區戊己路1號，", []),
        ("住甲乙市丙丁區戊己路１２巷3弄4號5樓", [("address", "甲乙市丙丁區戊己路１２巷3弄4號5樓")]),
        ("送達處所戊己路三段三巷十九號，", [("address", "戊己路三段三巷十九號")]),
        ("證人Ann Lee證稱其住No. 4, Ln. 67, Jiyue Rd., Wangyu City，", [("name", "Ann Lee"), ("address", "No. 4, Ln. 67, Jiyue Rd., Wangyu City")]),
        ("法　官　王小明\n書　記　官　李大", []),
        ("被　　　告　王○明　身分證統一編號：B26613*****", []),
        ("甲乙股份有限公司受託，統一編號12345678，", []),
        ("相　對　人　甲乙企業社", []),
        ("最高法院100年度台上字第5號判決", []),
        ("證人陳小華到庭陳述明確", [("name", "陳小華")]),
        ("林志玲於偵查中供述在卷", [("name", "林志玲")]),
        ("被告之母黃美玉代為清償", [("name", "黃美玉")]),
        ("原告主張其向王大明借款", [("name", "王大明")]),
        ("聯絡人李四（電話0912-345-678）", [("name", "李四"), ("phone", "0912-345-678")]),
        ("證人夏曼．藍波安證稱", [("name", "夏曼．藍波安")]),
        ("原告　阿布達悟拉浪，住甲乙市丙丁區戊己路1號3樓之2後棟8室", [("name", "阿布達悟拉浪"), ("address", "甲乙市丙丁區戊己路1號3樓之2")]),
        ("電話：+1 (415) 555-2671，", [("phone", "+1 (415) 555-2671")]),
        ("社會安全號碼123-45-6789，", [("idno", "123-45-6789")]),
        ("護照號碼：A12345678。", [("idno", "A12345678")]),
        ("原告王小明律師到庭", []), ("檢察官王小明到庭陳述", []), ("被告高雄銀行股份有限公司到庭", []),
        ("信箱" + "a" * 200 + "@mail.example", [("email", "a" * 200 + "@mail.example")]),
        (None, []), ("", []), ("@", []), ("號" * 3000, []), ("人" * 5000, []), ("．" * 5000, []),
    ],
)
def test_personal(text, want):
    assert [(k, text[a:b]) for k, a, b in private.find(text)] == want


def test_validators_and_masks(spark):
    assert private.id_holds("A123456789") and not private.id_holds("A123456788")
    assert private.luhn_holds("4111 1111 1111 1111") and private.mod97_holds("GB82 WEST 1234 5698 7654 32")
    t = "王小明（電話0912345678）雖辯稱，王小明如何。"
    assert private.masked(t) == "[NAME]（電話[PHONE]）雖辯稱，[NAME]如何。"
    d = spark.createDataFrame([(1, t), (1, t), (2, None), (None, t)], "id long, clean_text string")
    c = spark.createDataFrame([(1, "x" * 100_000)], "id long, snippet string")
    records = private.texts(d, c)
    assert private.personal_spans(records).count() == 3
    assert {(r.record_table, r.record_id) for r in private.without_personal(records).collect()} == {("decisions", 1), ("citations", 1)}


# --- neighbours ------------------------------------------------------------------------------------------------------


def chunks(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "n") for i, v in rows], "id long, embedding array<float>, note string")


@pytest.mark.parametrize(("block", "divided"), [(60, 1 << 18), (1 << 15, 1 << 18), (50, 100)])
def test_nearest(spark, monkeypatch, block, divided):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "DIVIDED", divided)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 64))
    rows = [(i, (centre[i % 20] + 0.5 * rng.normal(size=64)) * rng.uniform(0.1, 9)) for i in range(900)]
    rows += [(2000 + i, rows[5][1]) for i in range(40)] + rows[:30] + [(5000, None), (5001, np.zeros(64)), (5002, np.ones(32)), (None, np.ones(64)), (5003, [np.nan] * 64)]
    near = neighbours.nearest(chunks(spark, rows)).toPandas()
    exact = neighbours.exact_nearest(pd.DataFrame([(i, np.asarray(v, dtype=np.float32)) for i, v in rows if i is not None and v is not None and i != 5003], columns=["id", "embedding"]))
    got = near.groupby("id")["other"].apply(set).to_dict()
    assert set(got) == set(exact) and not near.duplicated(["id", "other"]).any() and (near["id"] != near["other"]).all()
    plain = [i for i in exact if i < 2000 and i % 20 != 5]
    assert np.mean([len(got.get(i, set()) & set(exact[i])) / 5 for i in plain]) >= 0.95
    assert got[2003] == {5, 2000, 2001, 2002, 2004}
    assert near["rank"].between(1, 5).all() and (near.groupby("id").size() == 5).all()


def test_few_vectors_find_all_others(spark):
    rng = np.random.default_rng(14)
    rows = [(i, rng.normal(size=64)) for i in range(30)]
    near = neighbours.nearest(chunks(spark, rows)).toPandas()
    exact = neighbours.exact_nearest(pd.DataFrame(rows, columns=["id", "embedding"]))
    assert near.sort_values(["id", "rank"]).groupby("id")["other"].apply(list).to_dict() == exact
    two = neighbours.nearest(chunks(spark, rows[:2])).toPandas()
    assert sorted(zip(two["id"], two["other"], strict=True)) == [(0, 1), (1, 0)]
    assert neighbours.nearest(chunks(spark, rows[:1])).collect() == []


def test_mutual_pairs(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=64)
    rows = [(1, v), (2, v * 3), (3, v + 0.05 * rng.normal(size=64)), (4, -v)] + [(10 + i, rng.normal(size=64)) for i in range(50)]
    w, u = np.zeros(64), np.zeros(64)
    w[0], u[0], u[1] = 1, 0.9, np.sqrt(1 - 0.9**2)
    low = np.zeros(64)
    low[2], low[3] = 0.89999, np.sqrt(1 - 0.89999**2)
    rows += [(100, w), (101, u), (102, np.roll(w, 2)), (103, low)]
    df = chunks(spark, rows)
    pairs = {tuple(r) for r in neighbours.mutual_pairs(neighbours.nearest(df), df).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (100, 101)}
    assert neighbours.nearest(chunks(spark, [])).collect() == []


def test_top_members():
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(1500, 8)).astype(np.float32), rng.normal(size=(9000, 8)).astype(np.float32)
    for keep in (1, 6):
        row, col, dot = neighbours.top_members(q, x, keep)
        want = -np.sort(-(q @ x.T), axis=1)[:, :keep]
        assert np.allclose(dot.reshape(-1, keep), want, atol=1e-5) and (row == np.repeat(np.arange(1500), keep)).all()
        assert np.allclose((q[row] * x[col]).sum(1), dot, atol=1e-5)
    row, col, _ = neighbours.top_members(x, x, 3, np.arange(9000))
    assert (row != col).all() and len(row) == 27000


@pytest.mark.parametrize("parts", [2, 4, 64, 128, 512, 1 << 15])
def test_parts_are_distinct(parts):
    x = np.random.default_rng(5).normal(size=(50, 64)).astype(np.float32)
    p = neighbours.parts_of(x, 0, parts)
    assert p.max() < parts and p.shape == (50, neighbours.parts_probed(parts)) and all(len(set(r)) == len(r) for r in p)
    assert neighbours.tables_of(1) == 10 and neighbours.tables_of(1 << 24) == 20


# --- spans -----------------------------------------------------------------------------------------------------------


def brute_shared(rows, size=120):
    at = defaultdict(list)
    for i, e, t in {r[0]: r for r in rows if r[0] is not None and r[2]}.values():
        for p in range(len(t) - size + 1):
            at[t[p : p + size]].append((i, e, p))
    pairs, cover = set(), defaultdict(set)
    for x in at.values():
        if len({e for _, e, _ in x}) > 1:
            for i, _, p in x:
                cover[i] |= set(range(p, p + size))
            pairs |= {(a, b) for a, ea, _ in x for b, eb, _ in x if a < b and ea != eb}
    return pairs, {i: len(c) for i, c in cover.items()}


def brute_removals(rows, size=120):
    """What earlier records have, character by character: windows, and whole lines that are equal when normalised."""
    plain = lambda x: "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in x if not c.isspace())
    first, ents, out = {}, defaultdict(set), defaultdict(set)
    real = sorted({r[0]: r for r in rows if r[0] is not None and r[2]}.values())
    units = {}
    for i, e, t in real:
        units[i] = [(("w", t[p : p + size]), p, p + size) for p in range(len(t) - size + 1)]
        units[i] += [(("l", plain(m[0])), m.start(), m.end()) for m in re.finditer(rf"[^\r\n]{{{size},}}", t)]
        for k, _, _ in units[i]:
            first.setdefault(k, i)
            ents[k].add(e)
    for i, _, _ in real:
        for k, a, b in units[i]:
            if first[k] < i and len(ents[k]) > 1:
                out[i] |= set(range(a, b))
    return out


@pytest.mark.parametrize(("limit", "piece"), [(0, 1 << 20), (16 << 20, 700)])
def test_shared_spans(spark, monkeypatch, limit, piece):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(spans, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(spans, "PIECE", piece)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("甲乙丙丁戊己庚辛\r\n，。𠮷ab") for _ in range(n))
    shared = [word(n) for n in (119, 120, 121, 300, 900)]
    rows = [(i, i, "".join(x for s in shared for x in (word(rng.randrange(60)), s if rng.random() < 0.15 else ""))) for i in range(60)]
    line = "".join(rng.choice("子丑寅卯辰巳ＡB") for _ in range(200))
    rows += [(200 + i, 200 + i, f"{word(20)}\r\n{line if i % 4 else line[40:170] if i % 8 else line.replace('Ａ', 'A　')}\n{word(30)}") for i in range(16)]
    rows += [(100, 100, "重" * 500), (101, 101, "重" * 200), (102, 102, None), (103, 103, ""), (None, None, shared[4])]
    d = spark.createDataFrame([(i, t) for i, _, t in rows] + [(rows[0][0], rows[0][2])], "id long, clean_text string")
    snippets = [(i, i % 7, shared[3] if i % 5 == 0 else line + word(9) if i % 3 == 0 else word(150)) for i in range(40)]
    c = spark.createDataFrame([(i, e, t) for i, e, t in snippets], "id long, source_id long, snippet string")
    w = spans.Shared(d, c)
    got = {tuple(r) for r in w.pairs().collect()}
    pd_, cover_d = brute_shared(rows)
    pc, cover_c = brute_shared(snippets)
    assert pd_ and pc and got == {("decisions", *p) for p in pd_} | {("citations", *p) for p in pc}
    parts = {(r.record_table, r.record_id): r.shared_chars for r in w.parts().collect()}
    lines_too = {k: set() for k in ("decisions", "citations")}
    for r in w.lines.collect():
        lines_too[r.record_table].add(r.id)
    assert lines_too["decisions"] and w.lines.where("not kept").count() > 3
    assert parts == {("decisions", i): n for i, n in cover_d.items()} | {("citations", i): n for i, n in cover_c.items()}
    members = defaultdict(set)
    for r in w.classes().collect():
        members[r.class_id].add((r.record_table, r.record_id, r.ent))
    assert {(t, min(a, b), max(a, b)) for m in members.values() for t, a, e in m for _, b, f in m if a != b and e != f} == got
    for r in w.stretches().collect():
        assert r.end_pos - r.start_pos >= 120
    text = {("decisions", i): t for i, _, t in rows} | {("citations", i): t for i, _, t in snippets}
    gone = {("decisions", i): x for i, x in brute_removals(rows).items()} | {("citations", i): x for i, x in brute_removals(snippets).items()}
    left = {(r.record_table, r.record_id): r for r in w.remaining().collect()}
    assert gone and set(left) == {k for k, t in text.items() if k[1] is not None and t and len(t) >= 120}
    for k, r in left.items():
        assert r.text == "".join(ch for p, ch in enumerate(text[k]) if p not in gone.get(k, ())) and r.removed_chars == len(gone.get(k, ()))


def test_no_spans(spark):
    d = spark.createDataFrame([], "id long, clean_text string")
    c = spark.createDataFrame([], "id long, source_id long, snippet string")
    s = spans.Shared(d, c)
    assert s.pairs().collect() == [] and s.parts().collect() == [] and s.remaining().collect() == []


# --- packing and mixing ----------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=40))
def test_plan(capacity, counts):
    counts = {s: n for s, n in counts.items() if s <= capacity}
    made, bins = packing.plan(counts, capacity)
    load, ranks = defaultdict(int), set()
    for size, a, b, first, each in made:
        for r in range(a, b):
            load[first + (r - a) // each] += size
            assert (size, r) not in ranks
            ranks.add((size, r))
    assert ranks == {(s, r) for s, n in counts.items() for r in range(n)}
    assert len(load) == bins and all(x <= capacity for x in load.values())
    one_by_one: list[int] = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, g in enumerate(one_by_one) if g >= s]
        if fits:
            one_by_one[min(fits, key=lambda i: one_by_one[i])] -= s
        else:
            one_by_one.append(capacity - s)
    total = sum(s * n for s, n in counts.items())
    assert bins <= len(one_by_one) * 1.1 + 1 and bins >= -(-total // capacity)


def test_plan_of_large_capacities():
    rng = random.Random(17)
    counts = {rng.randrange(1, 1_000_000): rng.randrange(1, 10**9) for _ in range(20_000)} | {300_000: 5 * 10**9}
    made, bins = packing.plan(counts, 1_000_000)
    items, tokens_in = defaultdict(int), 0
    for size, a, b, _, each in made:
        assert b > a and each * size <= 1_000_000
        items[size] += b - a
        tokens_in += size * (b - a)
    assert dict(items) == counts and bins * 1_000_000 >= tokens_in
    assert tokens_in / (bins * 1_000_000) > 0.97


@pytest.mark.parametrize("capacity", [100, 1_000_000])
def test_places_of_large_items(capacity):
    import pyarrow as pa

    rng = np.random.default_rng(18)
    size = rng.integers(1, capacity + 1, 3000)
    order = np.argsort(size, kind="stable")
    rank = np.empty(3000, dtype=np.int64)
    rank[order] = np.arange(3000) - np.searchsorted(size[order], size[order])
    n_of = {int(s): int(n) for s, n in zip(*np.unique(size, return_counts=True), strict=True)}
    made, bins = packing.plan(n_of, capacity)
    lines_ = np.array(sorted(made), dtype=np.int64)
    smaller = dict(zip(sorted(n_of), np.cumsum([0, *(n_of[s] for s in sorted(n_of))]), strict=False))
    before = np.array([smaller[s] for s in lines_[:, 0].tolist()])
    batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(3000), "piece_no": np.ones(3000, np.int32), "token_start": np.zeros(3000, np.int64), "n_tokens": size, "r": rank})
    out = next(packing._assign(iter([batch]), lines_, before, bins)).column("bin_id").to_numpy()
    load = np.bincount(out, weights=size)
    assert load.max() <= capacity and (load[1:] > 0).all() and len(load) == bins + 1


TEXTS = "doc_id long, text string, source string, title string"


def test_filled(spark):
    rng = random.Random(7)
    rows = [(i, "word " * rng.randrange(0, 90), "s", "t") for i in range(120)] + [(500, "long " * 700, "s", None), (501, None, None, None), (None, "x", "s", "")]
    df = spark.createDataFrame(rows + rows[:5], TEXTS)
    out = packing.filled(df, 100).toPandas()
    sizes = {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()}
    assert out.groupby("doc_id")["n_tokens"].sum().to_dict() == sizes
    assert out.groupby("bin_id")["n_tokens"].sum().max() <= 100
    assert not out.duplicated(["doc_id", "piece_no"]).any()
    big = out[out.doc_id == 500].sort_values("piece_no")
    assert (big["n_tokens"].to_numpy()[:-1] == 100).all() and (big["token_start"].to_numpy() == np.arange(len(big)) * 100).all()
    assert (out[out.duplicated("doc_id", keep=False)]["doc_id"] == 500).all()
    assert packing.filled(df.limit(0), 100).collect() == []
    assert packing.fill_report(packing.filled(df, 100), 100).first().fill > 0.9


def test_ranks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, i % 3 if i % 2 else 0) for i in range(3000)], "id long, g long")
    out = tokens.ranked(df, ["g"], F.xxhash64("id"), "id").toPandas()
    assert all(sorted(x["r"]) == list(range(len(x))) for _, x in out.groupby("g")) and len(out) == 3000


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), min_size=1, max_size=12), st.floats(0, 1))
def test_fit_is_as_good_as_any(counts, part):
    lengths, n = np.array(list(counts)), np.array(list(counts.values()))
    budget = int(part * (lengths * n).sum())
    take = mixing.fit(lengths, n, budget)
    assert (take >= 0).all() and (take <= n).all()
    assert budget - int((take * lengths).sum()) < max(counts)


def test_fit_of_billions_of_pages():
    lengths, n = np.array([500, 700]), np.array([2 * 10**9, 3 * 10**9])
    budget = int((lengths * n).sum()) // 2
    take = mixing.fit(lengths, n, budget)
    assert abs(take[0] / n[0] - 0.5) < 1e-3 and abs(take[1] / n[1] - 0.5) < 1e-3
    assert 0 <= budget - int((take * lengths).sum()) < 100
    odd = mixing.fit(np.array([3, 11, 10_000_000]), np.array([10**6, 10**6, 40]), 215_000_001)
    assert 3 * odd[0] + 11 * odd[1] + 10_000_000 * odd[2] == 215_000_001


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, "word " * rng.randrange(1, 60), rng.choice([" A", "a", "B", "c"]), "") for i in range(400)] + [(900, None, "a", ""), (901, "x", None, ""), (None, "x", "a", "")]
    targets = [("a", 0.5, 1), ("a", 0.5, 1), ("B ", 0.3, 2), ("c", 0.1, None), ("none", 0.1, 3), (None, 0.2, 1), ("d", None, 1)]
    df, t = spark.createDataFrame(rows, TEXTS), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mix, report = mixing.mixed(df, t, exact=True)
    m, r = mix.toPandas(), {x.source: x for x in report.collect()}
    used = (m["n_tokens"] * m["repeats"]).groupby(m["source"]).sum()
    assert {s: r[s].tokens for s in used.index} == used.to_dict()
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(used[s] / used.sum() - share / 0.9) < 0.002
    assert r["none"].tokens == 0 and (m[m.source == "a"]["repeats"] <= 1).all() and (m["repeats"] <= 2).all()
    assert mix.exceptAll(mixing.mixed(df, t, exact=True)[0]).count() == 0
    big = mixing.mixed(df, t, total=10**9)[1].toPandas().set_index("source")
    assert (big.loc[["a", "b", "c"], "tokens"] == big.loc[["a", "b", "c"], "tokens_there"] * [1, 2, 1]).all()
    whole = mixing.mixed(df, t)[1].toPandas().set_index("source").loc[["a", "b", "c"]]
    size = whole["tokens_there"].sum()
    want = np.minimum(size * np.array([0.5, 0.3, 0.1]) / 0.9, whole["tokens_there"] * [1, 2, 1])
    assert (np.abs(whole["tokens"] - want) < 60).all() and (whole["tokens"] <= whole["budget"]).all()
    assert mixing.mixed(df.limit(0), t)[0].collect() == []


# --- stuffing --------------------------------------------------------------------------------------------------------


def test_words():
    page, h, size = stuffing.words(["Ab 12甲乙", "", "ab\t12 𠮷"])
    assert page.tolist() == [0, 0, 0, 0, 2, 2, 2] and size.tolist() == [2, 2, 1, 1, 2, 2, 1]
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 5


def test_stuffed_pages(spark):
    rng = random.Random(9)
    sign = [chr(0x4E00 + i) for i in range(400)]
    ham = lambda: "，".join("".join(rng.choice(sign) for _ in range(12)) for _ in range(20)) + "。"
    keys = ["徵信調查", "離婚律師", "免費諮詢"]
    rows = [(i, ham(), None, "t") for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(keys) for _ in range(60)), "s", None) for i in range(20)]
    rows += [(2000, ham() + " ".join(rng.choice(keys) for _ in range(10)), "s", ""), (2001, None, "s", ""), (2002, "", "s", ""), (2003, "一", "s", ""), (None, "x y", "s", "")]
    df = spark.createDataFrame(rows + rows[300:305], TEXTS)
    got = sorted(r.doc_id for r in stuffing.stuffed_pages(df).collect())
    assert got == list(range(1000, 1020))
    assert stuffing.stuffed_pages(df.limit(0)).collect() == []


def test_counts_of_all_pages(spark):
    texts = ["甲乙甲乙", "甲乙", "ab ab ab ab"]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], TEXTS).repartition(3)
    values = {r.h: r for r in stuffing.pair_values(df).collect()}
    _, h, _ = stuffing.words(["甲乙"])
    r = values[int(stuffing.neighbours(np.zeros(2, int), h)[0].view(np.int64)[0])]
    assert (r.n, r.pages) == (3, 2) and np.isclose(r.repeated, np.log(1.5)) and len(values) == 3
    assert np.isclose(r.information, np.log((3 / 7) / (3 / 10) ** 2))


@pytest.mark.parametrize("held", [4, 1 << 21])
def test_rare_pairs_are_joined(spark, monkeypatch, held):
    monkeypatch.setattr(stuffing, "HELD", held)
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice(["ab", "甲乙", "cd", "丙", "9"]) for _ in range(rng.randrange(80))), "s", None) for i in range(60)] + [(99, None, "s", None), (5, "zz yy", "s", "")]
    df = spark.createDataFrame(rows, TEXTS)
    whole = {r.doc_id: tuple(r)[1:] for r in stuffing.stuffing(df).collect()}
    for most in (0, 7):
        part = {r.doc_id: tuple(r)[1:] for r in stuffing.stuffing(df, most).collect()}
        assert set(part) == set(whole) and all(np.allclose(part[i], whole[i]) for i in whole)


def test_table_of_pairs():
    h = np.unique(np.random.default_rng(1).integers(1, 1 << 63, 5000).astype(np.uint64) << np.uint64(8))  # all in a few slots
    t = stuffing.Table(h, np.arange(len(h), dtype=np.float32), -np.arange(len(h), dtype=np.float32))
    slot, there = t.find(np.concatenate([h, h + np.uint64(1)]))
    assert there[: len(h)].all() and not there[len(h) :].any()
    assert (t.values[slot[: len(h)], 0] == np.arange(len(h))).all() and (t.values[slot[: len(h)], 1] == -np.arange(len(h))).all()
