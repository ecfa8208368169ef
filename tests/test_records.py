"""Heavy keys and orphan references against plain Python."""

from collections import Counter, defaultdict
from datetime import datetime

import pytest

from casemesh.operators import heavy_keys as H
from casemesh.operators import orphans as O

CITES = "id long, source_id long, target_id long, target_canonical_id long, target_authority_id long, created_at timestamp_ntz, key string, field int"


def cites(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], CITES)


def t(day, hour=0):
    return datetime(2024, 1 + day // 28, 1 + day % 28, hour)


def brute_counts(rows):
    n, edges, sources = Counter(), defaultdict(set), defaultdict(set)
    for i, s, tid, _, aid, _ in rows:
        for f, k in (("target_id", tid), ("target_authority_id", aid)):
            if k is not None:
                n[f, k] += 1
                edges[f, k].add((i, s, tid, aid))
                if s is not None:
                    sources[f, k].add(s)
    return {(*k, n[k], len(edges[k]), len(sources[k])) for k in n}


@pytest.mark.parametrize("split_rows", [7, 1_000_000])
def test_key_counts_hot_key_copies_nulls(spark, monkeypatch, split_rows):
    rows = [(i, i % 50, 7 if i % 3 == 0 else i * 1_000_003 % 900 - 400, None, None, None) for i in range(600)]
    rows += [(1000 + i, None, None, None, i % 4, None) for i in range(40)] + rows[:90] + [(None, None, 7, None, 3, None)] * 2 + [(None, None, None, None, None, None)]
    monkeypatch.setattr(H, "SPLIT_ROWS", split_rows)
    got = {tuple(r) for r in H.key_counts(cites(spark, rows)).collect()}
    assert got == brute_counts(rows)


def test_row_counts_are_those_of_all_measures(spark):
    rows = [(i, i % 5, 7 if i % 3 == 0 else i % 11, None, i % 4 if i % 2 else None, None) for i in range(300)] * 2
    df = cites(spark, rows)
    assert {tuple(r) for r in H.row_counts(df).collect()} == {tuple(r)[:3] for r in H.key_counts(df).collect()}


def test_key_counts_extreme_keys(spark):
    rows = [(i, 1, k, None, None, None) for i, k in enumerate((2**63 - 1, -(2**63), 0, -1, 255, 256))]
    assert {tuple(r) for r in H.key_counts(cites(spark, rows)).collect()} == brute_counts(rows)


def test_heavy_keys_share_and_empty_table(spark):
    rows = [(i, 1, 5 if i < 2 else None, None, 9 if i >= 98 else None, None) for i in range(100)]
    assert {(r.key_field, r.key_value) for r in H.heavy_keys(cites(spark, rows)).collect()} == {("target_id", 5), ("target_authority_id", 9)}
    assert H.heavy_keys(cites(spark, [])).collect() == []


def brute_orphans(refs, targets, removed):
    since = {}
    for k, s in targets:
        s = s or datetime.min
        since[k] = min(since.get(k, s), s)
    out = set()
    for i, k, c in refs:
        if k is None:
            continue
        month = f"{c:%Y-%m}" if c else None
        if k not in since:
            out.add((i, "removed" if k in removed else "absent", month))
        elif c is not None and since[k] > c:
            out.add((i, "late", month))
    return out


@pytest.mark.parametrize("part", [2, 200, 10**9])
def test_orphans_heavy_and_light(spark, monkeypatch, part):
    monkeypatch.setattr(O, "HEAVY_PART", part)
    refs = [(i, 1 if i % 3 == 0 else i % 37, t(i % 50)) for i in range(300)] + [(900, 5, None), (901, 999, None), (902, None, t(1))]
    refs += refs[:40]
    targets = [(k, t(k, 1)) for k in range(0, 37, 2)] + [(4, t(0)), (6, None), (1, t(30))]
    removed = [3, 5, 5, 4, None]
    other = [(i, 2 if i % 2 else 999, t(3)) for i in range(40)]
    got = O.orphans(
        spark.createDataFrame([("a", *r) for r in refs] + [("b", *r) for r in other], "field string, row_id long, key long, created_at timestamp_ntz"),
        spark.createDataFrame(targets, "key long, since timestamp_ntz"),
        spark.createDataFrame([(k,) for k in removed], "key long"),
        len(refs) + len(other),
    )
    want = {("a", *r) for r in brute_orphans(refs, targets, removed)} | {("b", *r) for r in brute_orphans(other, targets, removed)}
    assert {tuple(r) for r in got.collect()} == want and len({r[0] for r in want}) == 2


def test_reference_orphans_jids_are_normalised_and_tables_may_be_empty(spark):
    d = spark.createDataFrame([(1, "A,1", t(3)), (2, "B,2", t(3)), (3, None, t(3))], "id long, jid string, created_at timestamp_ntz")
    raw = spark.createDataFrame([("　Ａ，１ ", t(1)), ("C", t(1))], "jid string, received_at timestamp_ntz")
    gone = spark.createDataFrame([("raw_records", "Ｂ,2"), ("decisions", "77"), ("decisions", "x")], "record_table string, record_key string")
    c = cites(spark, [(1, 1, 1, 77, None, t(4)), (2, 1, 1, 78, None, t(1))])
    got = {tuple(r) for r in O.reference_orphans(c, d, raw, gone).collect()}
    assert got == {
        ("decisions.jid", 2, "removed", "2024-01"), ("citations.target_canonical_id", 1, "removed", "2024-01"),
        ("citations.target_canonical_id", 2, "absent", "2024-01"), ("citations.target_id", 2, "late", "2024-01"),
    }
    assert O.reference_orphans(c.limit(0), d.limit(0), raw.limit(0), gone.limit(0)).collect() == []
    counts = {(r.ref_field, r.ref_state): r.n_records for r in O.orphan_counts(O.reference_orphans(c, d, raw, gone)).collect()}
    assert counts["citations.target_canonical_id", "absent"] == 1
