"""Statutes in a text: law, article and the parts of an article.

An article is looked for first and the law's name read backwards from it, so that the number of known laws doesn't matter.
Names of laws are a parameter; the defaults are the common ones and their short forms. A longer list is made from texts by rule:
an unbroken run of Han signs that ends like a law's name, without the words that lead up to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

# Words that stand for a law named before; short names; names of common laws.
PSEUDO = frozenset("本法 同法 該法 原法 舊法 新法 各法 前法 上法 系爭條例 系爭辦法 系爭規則 系爭法".split())
ALIASES = dict(
    row.split()
    for row in """民訴法 民事訴訟法
刑訴法 刑事訴訟法
行訴法 行政訴訟法
消債條例 消費者債務清理條例
憲訴法 憲法訴訟法
勞退條例 勞工退休金條例
詐欺防制條例 詐欺犯罪危害防制條例
勞基法 勞動基準法
詐欺條例 詐欺犯罪危害防制條例
詐防條例 詐欺犯罪危害防制條例
消保法 消費者保護法
詐危條例 詐欺犯罪危害防制條例
跟騷法 跟蹤騷擾防制法
就保法 就業保險法
公平法 公平交易法
兒少保障法 兒童及少年福利與權益保障法
勞保條例 勞工保險條例
個資法 個人資料保護法
兩岸人民關係條例 台灣地區與大陸地區人民關係條例
國賠法 國家賠償法
兩岸條例 台灣地區與大陸地區人民關係條例
洗防法 洗錢防制法
農發條例 農業發展條例
道交條例 道路交通管理處罰條例
兒少福權法 兒童及少年福利與權益保障法
懲罰法 陸海空軍懲罰法
組織條例 組織犯罪防制條例
職安法 職業安全衛生法
軍權法 軍人權益事件處理法
速審法 刑事妥速審判法
兒少性剝削條例 兒童及少年性剝削防制條例
兒少性剝削防制條例 兒童及少年性剝削防制條例
兒少權益保障法 兒童及少年福利與權益保障法
兒少福利法 兒童及少年福利與權益保障法
家事法 家事事件法
強保法 強制汽車責任保險法
毒危條例 毒品危害防制條例
毒品條例 毒品危害防制條例
涉民法 涉外民事法律適用法
職災保護法 職業災害勞工保護法
舊洗錢法 洗錢防制法
詐害防制條例 詐欺犯罪危害防制條例
證交法 證券交易法
災保法 勞工職業災害保險及保護法
道交處罰條例 道路交通管理處罰條例
納保法 納稅者權利保護法
槍砲條例 槍砲彈藥刀械管制條例
減租條例 耕地三七五減租條例
簽證條例 外國護照簽證條例""".split("\n")
)
COMMON = (
    "憲法 民法 刑法 民事訴訟法 刑事訴訟法 行政訴訟法 行政程序法 行政罰法 訴願法 公司法 票據法 保險法 海商法 土地法 土地稅法 土地徵收條例 平均地權條例 強制執行法 非訟事件法 破產法 "
    "家事事件法 勞動基準法 勞動事件法 消費者保護法 公平交易法 著作權法 專利法 商標法 營業秘密法 稅捐稽徵法 所得稅法 遺產及贈與稅法 貨物稅條例 洗錢防制法 銀行法 證券交易法 貪污治罪條例 "
    "毒品危害防制條例 槍砲彈藥刀械管制條例 道路交通管理處罰條例 道路交通安全規則 公寓大廈管理條例 政府採購法 建築法 都市計畫法 醫療法 醫師法 藥事法 警察職權行使法 社會秩序維護法 家庭暴力防治法 "
    "性侵害犯罪防治法 國家賠償法 公務人員保障法 法院組織法 律師法 仲裁法 信託法 民法總則施行法 民法債編施行法 民法物權編施行法 刑法施行法 中華民國刑法 陸海空軍刑法 國家安全法 入出國及移民法 就業服務法"
).split()

# Endings of laws' names; words that end alike but name none; words that lead up to a name.
ENDINGS = ("法", "條例", "通則", "規則", "細則", "辦法", "規程", "準則", "標準", "綱要")
NO_LAWS = ("方法", "無法", "合法", "違法", "不法", "依法", "非法", "說法", "看法", "作法", "做法", "手法", "想法", "用法", "寫法", "司法", "立法", "修法", "守法", "執法", "本辦法", "本條例", "本規則", "本細則", "本準則", "本標準", "本通則", "本規程", "該辦法", "該條例", "該規則")
_LEAD = re.compile(r"依據|依照|依循|依|按照|按|適用|準用|違反|觸犯|援引|援用|引用|參照|參酌|揆諸|觀諸|參諸|根據|基於|修正前|修正後|行為時|裁判時|現行|所犯|係犯|犯|構成|符合|牴觸|爰|即|係指|係|所稱|所定|所謂|上開|前揭|前開|系爭|又|復|再|次|且|均|應|亦|惟|故|而|並|認|已|與|及|或|暨|和|為|以|由|用")
_JOINS = frozenset("與及或暨和為以由用又復再次且均應亦惟故而並認已即係犯爰")
LONGEST, SHORTEST = 30, 3

ARTICLE = re.compile(r"第\s*(\d+)\s*條(?:之\s*(\d+))?")
_NOTE = re.compile(r"（[^（）]*）\s*$")
INLINE = re.compile(r"\s*（(?:下稱|簡稱)\s*「?([^」）]{1,20})」?）")
_JOIN = r"[、，及與暨或,]\s*"
_PART = r"第\s*(\d+)\s*([項款目])"
PART, CLAUSE = re.compile(_PART), re.compile(r"第\s*(\d+)\s*([款目])")
TWO = re.compile(r"第\s*(\d+)\s*[、，]\s*(\d+)\s*([項款目])")
MODIFIER = re.compile(r"前段|後段|但書|本文")
NEXT_TWO, NEXT_PART = re.compile(_JOIN + TWO.pattern), re.compile(_JOIN + _PART)
NEXT_ARTICLE = re.compile(
    r"(?:(?:第\s*\d+\s*[項款目]|前段|後段|但書|本文)\s*|[、，及與暨或,]\s*(?!第\s*\d+\s*條))*" + _JOIN + ARTICLE.pattern
)


def plain_law(name: str) -> str:
    return name.replace("臺", "台").strip()


def law_name(name: str, inline: dict[str, str] | None = None) -> str:
    """The full name of a law: first by the text's own short names, then by the known ones."""
    plain = plain_law(name)
    if inline and plain in inline:
        return plain_law(inline[plain])
    return ALIASES.get(plain, plain)


class Laws:
    """Known names, longest first by length."""

    def __init__(self, names: Iterable[str]) -> None:
        self.full = frozenset(n for n in names if n)
        self.all = self.full | frozenset(ALIASES) | PSEUDO
        self.sizes = sorted({len(n) for n in self.all}, reverse=True)

    def before(self, text: str, end: int, low: int = 0, full_only: bool = False) -> int | None:
        """Where the longest known name that ends here begins, not before low."""
        names = self.full if full_only else self.all
        return next((end - n for n in self.sizes if end - n >= low and text[end - n : end] in names), None)


def likely_names(text: str | None) -> list[str]:
    """What reads like a law's name right before an article, known names aside; in order, as often as it stands there."""
    out, known, low = [], laws(), 0
    for m in ARTICLE.finditer(text or ""):
        end = len(text[low : m.start()].rstrip()) + low
        if known.before(text, end, low) is None and (start := by_rule(text, end, low)) is not None:
            out.append(plain_law(text[start:end]))
        low = m.end()
    return out


def by_rule(text: str, end: int, low: int = 0) -> int | None:
    """Where a run of Han signs that ends like a law's name begins, after the last word that leads up to it.

    Words that also stand within names (and, with, for ...) lead up to one only after another law or another such word.
    """
    if not text.endswith(ENDINGS, low, end) or text.endswith(NO_LAWS, max(low, end - 4), end):
        return None
    start = end
    while start > max(low, end - LONGEST) and "\u4e00" <= text[start - 1] <= "\u9fff":
        start -= 1
    led = False
    for m in _LEAD.finditer(text, start, end - SHORTEST):
        strong = m[0] not in _JOINS
        if strong or (m.start() == start and not led) or text.endswith(ENDINGS, start, m.start()):
            start, led = m.end(), led or strong
    return start if SHORTEST <= end - start < LONGEST else None


@lru_cache(maxsize=4)
def laws(names: tuple[str, ...] = ()) -> Laws:
    return Laws([*COMMON, *ALIASES.values(), *names])


def inline_names(text: str, known: Laws) -> dict[str, str]:
    """Short names that the text itself gives a law."""
    out: dict[str, str] = {}
    for m in re.finditer(r"（(?:下稱|簡稱)", text):
        end = len(text[: m.start()].rstrip())
        start = known.before(text, end, full_only=True)
        said = INLINE.match(text, end)
        if start is None or not said:
            continue
        short, full = law_name(said[1]), law_name(text[start:end])
        if short and short not in PSEUDO and short != full:
            out[short] = full
    return out


def _parts(text: str, at: int, pattern: re.Pattern) -> tuple[str, int]:
    """A run of parts and at most one closing modifier."""
    out = ""
    while m := pattern.match(text, at):
        out += f"第{m[1]}{m[2]}"
        at = m.end()
    if m := MODIFIER.match(text, at):
        out += m[0]
        at = m.end()
    return out, at


def qualifiers(text: str, at: int) -> tuple[list[str], int]:
    """The parts after an article, '' for none, and where they end."""
    if m := TWO.match(text, at):
        return [f"第{m[1]}{m[3]}", f"第{m[2]}{m[3]}"], m.end()
    part, at = _parts(text, at, PART)
    return [part], at


def _named(text: str, at: int, known: Laws):
    """The next article with a known name before it: (name start, name, article match)."""
    for m in ARTICLE.finditer(text, at):
        end = len(text[at : m.start()].rstrip()) + at
        note = _NOTE.search(text, at, end)
        ends = [end]
        if note and text[end - 1 : end] == "）":
            ends.append(len(text[at : note.start()].rstrip()) + at)
        for e in ends:
            start = known.before(text, e, at)
            if start is not None:
                return start, text[start:e], m
    return None


def statutes(text: str | None, names: tuple[str, ...] = ()) -> list[tuple[str, str, str, str]]:
    """(law, article, part, as written) of each statute in a text, each (law, article, part) once."""
    if not text:
        return []
    known = laws(names)
    inline = inline_names(text, known)
    found: dict[tuple[str, str, str], str] = {}
    law: str | None = None
    article: str | None = None
    at = 0

    def keep(parts: list[str], raw: str) -> None:
        for p in parts:
            found.setdefault((law, article, p), raw)

    while at < len(text):
        if article is not None and (m := NEXT_TWO.match(text, at)):
            keep([f"第{m[1]}{m[3]}", f"第{m[2]}{m[3]}"], m[0])
            at = m.end()
        elif article is not None and (m := NEXT_PART.match(text, at)):
            more, end = _parts(text, m.end(), CLAUSE)
            keep([f"第{m[1]}{m[2]}{more}"], text[at:end])
            at = end
        elif law is not None and (m := NEXT_ARTICLE.match(text, at)):
            suffix = f"之{m[2]}" if m[2] else ""
            article = m[1] + suffix
            parts, at = qualifiers(text, m.end())
            keep(parts, f"第{m[1]}條{suffix}")
        elif (hit := _named(text, at, known)) is None:
            break
        else:
            start, name, m = hit
            full = law_name(name, inline)
            at = m.end()
            if full in PSEUDO or name in PSEUDO:
                if law is None:
                    continue
            else:
                law = full
            article = m[1] + (f"之{m[2]}" if m[2] else "")
            parts, at = qualifiers(text, m.end())
            keep(parts, text[start : m.end()])
    return [(*k, raw) for k, raw in found.items()]


def suggestions(prefix: str, names: Iterable[str], first: int = 20, blank: int = 50) -> list[str]:
    """Names of laws that begin so, shortest first, then full names of such short ones; for nothing, the shortest names."""
    by_size = sorted(dict.fromkeys(names), key=len)
    prefix = prefix.strip()
    if not prefix:
        return by_size[:blank]
    hits = [n for n in by_size if n.startswith(prefix)]
    hits += [full for short, full in ALIASES.items() if short.startswith(prefix)]
    return list(dict.fromkeys(hits))[:first]
