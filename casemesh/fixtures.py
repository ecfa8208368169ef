"""Texts with known contents, built from lineitem by SQL that both engines read, for round trips through the parsers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from casemesh.sources.tables import views

#: One row per text: a key that says all its parts, and the parts.
BASE = """SELECT DISTINCT ((CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 30000 + l_partkey) * 2000 + l_suppkey * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS id,
l_returnflag AS flag, CAST(80 + l_suppkey % 30 AS INT) AS jyear, CAST(l_orderkey + 1 AS INT) AS jno, CAST(l_partkey % 500 + 1 AS INT) AS art, CAST(l_linenumber AS INT) AS item FROM lineitem"""

_S = "CAST({} AS STRING)"
Y, N, A, I = (_S.format(x) for x in ("jyear", "jno", "art", "item"))
N1, A1, I1 = (_S.format(x) for x in ("jno + 1", "art + 1", "item + 1"))
_HEAD = "'主文', chr(13), chr(10), '被告應給付。', chr(13), chr(10), '理由', chr(13), chr(10)"

TEXTS = {
    "rulings": f"concat({_HEAD}, '一、按民法第', {A}, '條第', {I}, '項規定，最高法院', {Y}, '年度台上字第', {N}, '號', CASE flag WHEN 'A' THEN '民事判決意旨參照。' WHEN 'N' THEN '裁定意旨參照。' ELSE '判決上訴駁回確定。' END)",
    "chains": f"concat({_HEAD}, '一、最高法院', {Y}, '年度台上字第', {N}, '號、', {Y}, '年度台抗字第', {N1}, '號', CASE flag WHEN 'A' THEN '民事判決' WHEN 'N' THEN '裁定' ELSE '裁判' END, '意旨參照。')",
    "constitutional": f"concat({_HEAD}, '一、憲法法庭', {Y}, '年憲判字第', {N}, '號、第', {N1}, '號判決意旨參照。')",
    "authorities": f"concat({_HEAD}, '一、最高法院', {Y}, '年度第', {I}, '次民事庭會議決議參照。司法院釋字第', {A}, '號、第', {A1}, '號解釋參照。最高行政法院', {Y}, '年', {I}, '月份庭長法官聯席會議決議參照。臺灣高等法院暨所屬法院', {Y}, '年法律座談會民事類提案第', {I1}, '號參照。')",
    "qualifiers": f"concat('依民法第', {A}, '條第', {I}, '項第2款前段、第', {I1}, '項但書及第', {A1}, '條之1規定，請求給付。')",
    "rules": f"CASE item WHEN 1 THEN concat({_HEAD}, '一、最高法院', {Y}, '年度台上字第', {N}, '號判決意旨參照。') "
    f"WHEN 2 THEN concat('一、最高法院', {Y}, '年度台上字第', {N}, '號判決意旨參照。', chr(13), chr(10), '理由', chr(13), chr(10), '二、甲。') "
    f"WHEN 3 THEN concat({_HEAD}, '一、甲。', chr(13), chr(10), '以上正本證明與原本無異', chr(13), chr(10), '最高法院', {Y}, '年度台上字第', {N}, '號判決意旨參照。') "
    f"WHEN 4 THEN concat({_HEAD}, '一、本院999年度訴字第1號判決意旨參照（', {N}, '）。') "
    f"WHEN 5 THEN concat({_HEAD}, '一、有最高法院', {Y}, '年度台上字第', {N}, '號判決書在卷可稽。') "
    f"WHEN 6 THEN concat({_HEAD}, '一、', CASE flag WHEN 'A' THEN '本院' ELSE '臺灣新北地方法院' END, {Y}, '年度訴字第', {N}, '號判決。') "
    f"ELSE concat({_HEAD}, CASE flag WHEN 'A' THEN concat('一、原告主張依最高法院', {Y}, '年度台上字第', {N}, '號判決云云。') WHEN 'N' THEN concat('一、司法院釋字第', {A}, '號解釋。') ELSE concat('一、原告主張甲，惟最高法院', {Y}, '年度台上字第', {N}, '號判決意旨參照。') END) END",
    "opinions": f"concat({_HEAD}, '一、司法院民事廳', {Y}, '年', {I}, '月司法業務研究會第', {I}, '期研究專輯第', {A}, '號民事法律問題研審小組意見參照。')",
    "signs": f"concat({_HEAD}, '一、司法院釋字第', {A}, '號', CASE flag WHEN 'A' THEN '、' WHEN 'N' THEN '，' ELSE '及' END, '第', {A1}, '號解釋參照。')",
    "snippets": f"concat({_HEAD}, '一、甲乙。', CASE flag WHEN 'A' THEN concat('按丙丁戊（最高法院', {Y}, '年度台上字第', {N}, '號判決意旨參照）。己庚') WHEN 'N' THEN concat('丙。丁戊，最高法院', {Y}, '年度台上字第', {N}, '號判決意旨參照。」己') ELSE concat('丙丁參照）。戊己，最高法院', {Y}, '年度台上字第', {N}, '號判決意旨參照', chr(13), chr(10), '庚。') END)",
    "raw": f"concat('臺 灣 甲 地方法院民事判決', chr(13), chr(10), '原　告　某', chr(13), chr(10), '上列當事人間', {Y}, '年度事件，本院判決如下：', chr(13), chr(10), '　　主　文', chr(13), chr(10), '被告應給', chr(13), chr(10), '付', {N}, '元。', chr(13), chr(10), "
    f"'　　理　由', chr(13), chr(10), '一、甲 乙', chr(13), chr(10), '丙丁。', chr(13), chr(10), chr(13), chr(10), '㈠戊', {I}, '。', chr(13), chr(10), '中　華　民　國　113　年　1　月　2　日', chr(13), chr(10), '如不服本', chr(13), chr(10), '判決', {A}, chr(13), chr(10), '書記官　某', chr(13), chr(10), '附錄')",
    "clean": f"concat('臺灣甲地方法院民事判決', chr(13), chr(10), '原　告　某', chr(13), chr(10), '上列當事人間', {Y}, '年度事件，本院判決如下：', chr(13), chr(10), '　主文', chr(13), chr(10), '被告應給付', {N}, '元。', chr(13), chr(10), '　理由', chr(13), chr(10), '一、甲乙丙丁。', chr(13), chr(10), '㈠戊', {I}, '。', chr(13), chr(10), "
    f"'中　華　民　國　113　年　1　月　2　日', chr(13), chr(10), '如不服本判決', {A}, chr(13), chr(10), '書記官　某')",
    "items": f"concat('理由', chr(10), repeat('甲乙丙。', jyear), chr(10), '一、', repeat('丁戊。', CAST(item AS INT) * 10), chr(10), '二、按最高法院', {Y}, '年度台上字第', {N}, '號判決意旨參照。', chr(10), '三、己。', chr(10), '中　華　民　國')",
    "extension": f"concat('依民法第', {A}, '條第', {I}, '項第1款、第2款但書及第', {A1}, '條之2規定。')",
    "inline": f"concat('消費者保護法（下稱消保新法）第', {A}, '條第', {I}, '項，消保新法第', {A1}, '條及同法第', {N}, '條。')",
}


def texts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(id, flag, jyear, jno, art, item, text)."""
    views(spark, sf_dir, "lineitem")
    return spark.sql(f"SELECT *, {TEXTS[kind]} AS text FROM ({BASE})")


def parts(kind: str) -> list[str]:
    """The parts of BASE that a kind's texts are made of."""
    return [p for p in ("flag", "jyear", "jno", "art", "item") if re.search(rf"\b{p}\b", TEXTS[kind])]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, flag, jyear, jno, art, item)."""
    views(spark, sf_dir, "lineitem")
    return spark.sql(BASE)


def different(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(parts..., text): the texts of all rows, those of the same parts once.

    In as many partitions as shuffles have: few bytes, but long to parse, so adaptive execution mustn't join them.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows(spark, sf_dir).select(*parts(kind)).distinct().repartition(n).selectExpr("*", f"{TEXTS[kind]} AS text")


def sql(kind: str) -> str:
    return f"WITH f AS (SELECT *, {TEXTS[kind]} AS text FROM ({BASE}))\n"
