"""Personal information in free text, and typed placeholders for it.

Method: patterns propose spans, validators (check digits of identity numbers, Luhn for cards, mod 97 for bank accounts) and
the words near a span raise or lower its score, and spans above a threshold are taken. Names are scored in the same way:
what stands before (a party's label, a role, a relative, a preposition), what stands after (what a person does, a contact or
number, a particle) and the name itself (a surname, no signs that names don't have) each give a part, and words that say a
court's officer, a company or a role rule a name out. A name that was found is one everywhere in its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores from which a span is taken.
THRESHOLD = 0.5
#: Placeholders by type.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "idno": "[ID]", "address": "[ADDRESS]", "name": "[NAME]", "card": "[CARD]", "account": "[ACCOUNT]"}

_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}
_D = "0-9０-９"
_SEP = "[-－‐‑–. 　]?"

# --- proposals -------------------------------------------------------------------------------------------------------

_AT = re.compile(r"[@＠]|\s?[\[(（{【<]\s?(?:at|AT|At|ａｔ|小老鼠)\s?[\])）}】>]\s?|小老鼠|\s(?:at|AT)\s(?=[A-Za-z0-9-]+\s?(?:\.|\[dot|\(dot|dot\s))")
_LOCAL = re.compile(r"[A-Za-z0-9Ａ-Ｚａ-ｚ０-９](?:[A-Za-z0-9Ａ-Ｚａ-ｚ０-９._%+＿．－-]*[A-Za-z0-9Ａ-Ｚａ-ｚ０-９_])?$")
_DOT = r"(?:[.．]|\s?[\[(（{【]\s?(?:dot|DOT|Dot|點)\s?[\])）}】]\s?|\s(?:dot|DOT)\s)"
_HOST = re.compile(rf"[A-Za-z0-9Ａ-Ｚａ-ｚ０-９](?:[A-Za-z0-9Ａ-Ｚａ-ｚ０-９－-]*[A-Za-z0-9Ａ-Ｚａ-ｚ０-９])?(?:{_DOT}[A-Za-z0-9Ａ-Ｚａ-ｚ０-９-]*[A-Za-z0-9Ａ-Ｚａ-ｚ０-９])+")

_PHONE = re.compile(
    rf"""(?<![{_D}A-Za-z])(?:
      [+＋][8８][8８][6６]{_SEP}(?:[(（]?[0０][)）]?)?{_SEP}[9９][{_D}]{{2}}{_SEP}[{_D}]{{3}}{_SEP}[{_D}]{{3}}
    | [+＋]?[8８][8８][6６][-－ ]{_SEP}[1-8１-８][{_D}]?{_SEP}[{_D}]{{3,4}}{_SEP}[{_D}]{{4}}
    | [0０][9９][{_D}]{{2}}{_SEP}[{_D}]{{3}}{_SEP}[{_D}]{{3}}
    | [(（][0０][2-8２-８][{_D}]{{0,2}}[)）]{_SEP}[{_D}]{{3,4}}{_SEP}[{_D}]{{3,4}}
    | [0０][2-8２-８][{_D}]?[-－ ][{_D}]{{3,4}}{_SEP}[{_D}]{{3,4}}
    )(?![{_D}])""",
    re.X,
)
_CN = "〇零○一二三四五六七八九"
_PHONE_CN = re.compile(rf"(?<![{_CN}])[〇零○]九[{_CN}]{{2}}[-－ ]?[{_CN}]{{3}}[-－ ]?[{_CN}]{{3}}(?![{_CN}])")
_IDNO = re.compile(
    rf"(?<![A-Za-zＡ-Ｚａ-ｚ{_D}+/=_])[A-Za-zＡ-Ｚａ-ｚ](?:[-－ ]?[1289１２８９]|[A-Da-dＡ-Ｄａ-ｄ])(?:[-－ ]?[{_D}]){{8}}(?![A-Za-zＡ-Ｚａ-ｚ{_D}*＊+/=_])"
)
_PHONE_FOREIGN = re.compile(rf"(?<![{_D}A-Za-z])[+＋](?![8８]{{2}}[6６])[{_D}]{{1,3}}[-－. 　]?(?:[(（][{_D}]{{1,4}}[)）])?(?:[-－. 　]?[{_D}]{{2,4}}){{2,4}}(?![{_D}A-Za-z])")
_SSN = re.compile(rf"(?<![-－{_D}A-Za-z])[{_D}]{{3}}[-－][{_D}]{{2}}[-－][{_D}]{{4}}(?![-－{_D}A-Za-z])")
_PASSPORT = re.compile(rf"(?:護照(?:號碼|字號|號)?|居留證(?:號碼|號)|[Pp]assport(?: [Nn]o\.?)?)[ 　]*[：:]?[ 　]*([A-Za-z]{{0,2}}[{_D}]{{7,9}})(?![{_D}A-Za-z])")
_LONG_NUMBER = re.compile(rf"(?<![{_D}A-Za-z])[{_D}](?:[- －]?[{_D}]){{12,18}}(?![{_D}A-Za-z])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

_N = rf"(?:[{_D}]+|[一二三四五六七八九十百〇零]+)"
_PLACE = "[一-鿿]"
_ROAD = rf"(?:{_PLACE}{{1,4}}?(?:大道|路|街))(?:{_N}段)?(?:{_N}巷)?(?:{_N}弄)?"
_DOOR = rf"{_N}(?:[-－]{_N}|之{_N})?號(?:之{_N})?(?:(?:地下)?{_N}樓(?:之{_N})?)?(?:{_N}室)?"
_ADDRESS = re.compile(
    rf"{_PLACE}{{2}}[市縣](?:{_PLACE}{{1,3}}?[區鄉鎮市])?(?:{_PLACE}{{1,3}}?[里村])?(?:{_N}鄰)?(?:{_ROAD}|{_PLACE}{{1,4}}?)?{_DOOR}"
    rf"|(?:(?<=[住往址：])|(?<=處所)){_PLACE}{{1,4}}?(?:大道|路|街)(?:{_N}段)?(?:{_N}巷)?(?:{_N}弄)?{_DOOR}"
    rf"|{_PLACE}{{2}}(?:路|街)(?:{_N}段)?(?:{_N}巷)?(?:{_N}弄)?{_DOOR}"
)
_ADDRESS_EN = re.compile(
    r"(?:\d+F(?:-\d+)?\.?, ?)?No\. ?\d+(?:-\d+)?(?:, (?:Aly|Alley|Ln|Lane)\. ?\d+)*(?:, (?:Sec\. ?\d+,? ?)?[A-Z][A-Za-z'-]*(?: [A-Z][A-Za-z'-]*)* (?:Rd|St|Blvd|Ave|Road|Street)\.?)"
    r"(?:, Sec\. ?\d+)?(?:, [A-Z][A-Za-z'-]*(?: [A-Z][A-Za-z'-]*)* (?:Dist|Township|Village|City|County)\.?){0,3}"
)

# --- names -----------------------------------------------------------------------------------------------------------

_HAN = "㐀-鿿豈-﫿\U00020000-\U0003ffff"
_DOTS = "．·・‧•"
_DOT_SIGNS = frozenset(_DOTS)
_LATIN_AT, _LATIN_END = re.compile(r"[A-Za-zÀ-ɏ]+(?:[-'’.．·・‧• ][A-Za-zÀ-ɏ]+){1,3}"), re.compile(r"[-'’.．·・‧• ]*([A-Za-zÀ-ɏ]+(?:[-'’.．·・‧• ][A-Za-zÀ-ɏ]+){1,3})$")
_HAN_AT, _DOTTED_AT = re.compile(f"[{_HAN}]{{1,4}}"), re.compile(f"[{_HAN}]+(?:[{_DOTS}][{_HAN}]+)+")
_HAN_END, _DOTTED_END = re.compile(f"[{_HAN}]"), re.compile(f"[{_HAN}{_DOTS}]")
_LATIN_NAME = r"[A-Za-zÀ-ɏ]+(?:[-'’.．·・‧• ][A-Za-zÀ-ɏ]+){1,3}"
# Common surnames of one sign, those that are common words as well, and of two signs.
SURNAMES = frozenset(
    "王李張劉陳楊黃趙吳周徐孫馬朱胡郭何林羅鄭梁謝宋唐許韓馮鄧曹彭曾蕭蔡潘田董袁余葉蔣杜蘇魏呂丁沈姚盧姜崔鍾譚陸汪范廖石韋賈夏傅鄒熊孟秦邱江尹薛閻段雷侯龍陶黎賀顧毛郝龔邵萬錢嚴賴覃洪莫孔涂柯游詹簡施翁"
    "倪俞樊聶闕褚岳穆卓湛鞏柏鄔厲翟蒲卞霍戎殷晏席竺司端尉康伍喻艾紀路婁童顏梅盛刁駱霍虞柳鮑史費廉岑滕畢祁狄臧戴紅凌巫焦巴牧隗山谷車侯宓蓬仇欒暴甘祖武符景詹束"
)
MAYBE_SURNAMES = frozenset("高金方白成易常溫文明向應時江安官連全元平和古井房都於有包水章花魯危解辛葛左步")
DOUBLE_SURNAMES = frozenset("歐陽 司馬 尉遲 端木 上官 諸葛 司徒 夏侯 皇甫 公孫 令狐 慕容 長孫 宇文 東方 南宮 張簡 范姜".split())
# Signs that hardly stand in a given name.
NO_NAME = frozenset("的之於以及其為無因並而等元月號條項款法院案件應該此彼他她我你們被將已未不是在有所與或則即但向對由至自到請求告訴訟判決裁定書證據原本卷按查經均亦且就從得給付款額契約權利義務處分部庭級審當事兩造認稱述辯載示知說問答何誰某個次第百千萬億零各每另再又若如雖然故乃遂竟仍尚還都也者乎矣焉哉")
# Words for parties and other roles in a case, which are no names, but names follow them.
ROLES = frozenset(
    "原告 被告 上訴人 被上訴人 聲請人 相對人 抗告人 再抗告人 參加人 告訴人 告發人 自訴人 公訴人 債權人 債務人 證人 鑑定人 關係人 第三人 訴外人 被害人 受害人 出賣人 買受人 出租人 承租人 定作人 承攬人 "
    "保證人 管理人 委任人 受任人 代理人 受僱人 僱用人 繼承人 被繼承人 監護人 輔助人 合夥人 共有人 鄰居 配偶 友人 朋友 同事 同學 房東 屋主 員工 病患 駕駛人 聯絡人 聯繫人 收件人 寄件人 簽收人 匯款人 受款人 所有人 "
    "檢察官 法官 書記官 兩造 當事人 本院 原審 法院 渠等 其 伊 該 他 上開 系爭".split()
)
_NO_FIRST = NO_NAME - SURNAMES - MAYBE_SURNAMES - {d[0] for d in DOUBLE_SURNAMES}
_NO_LAST = NO_NAME | frozenset("人告院官造方，。、；：！？\n\r）)」』　 ")
_LONG_ROLES = tuple(sorted(r for r in ROLES if len(r) > 1))
_NOT_BEFORE = "檢察官 法官 書記官 兩造 當事人 本院 原審 法院 渠等 其 伊 該 他 上開 系爭".split()
KIN = "父 母 父親 母親 夫 妻 子 女 兄 弟 姊 妹 配偶 長子 次子 長女 次女 胞兄 胞弟 胞姊 胞妹 祖父 祖母 外祖父 外祖母 岳父 岳母 女兒 兒子 丈夫 妻子 前夫 前妻 男友 女友 友人 員工 受僱人 代理人 同居人".split()
_ROLE_WORDS = sorted({r for r in ROLES if len(r) > 1 and r not in _NOT_BEFORE} | {f"{o}{k}" for o in "之其伊" for k in KIN} | {"證人即", "姓名", "法定代理人", "訴訟代理人", "連帶保證人"}, key=lambda w: (-len(w), w))
_ROLE = re.compile(rf"(?:{'|'.join(_ROLE_WORDS)})(?:即)?[ 　]*[：:]?[ 　]*(?=[{_HAN}A-Za-zÀ-ɏ])")
_ROLE_BEFORE = re.compile(rf"(?:{'|'.join(_ROLE_WORDS)})(?:即)?[ 　]*[：:]?[ 　]*$")
_NARRATIVE = re.compile(r"(?<![㐀-鿿])(?:嗣後|嗣|詎料|詎|迨|俟)(?=[㐀-鿿A-Za-z])")
_COMPANY = re.compile(r"(?:公司|企業社|工程行|商行|商號|合作社|基金會|協會|委員會|管理處|分局|大學|醫院|銀行|法院|檢察署|簡易庭|分院|地方庭|[行社廠店局署府處])$")
_COMPANY_ON = re.compile(r"[㐀-鿿]{0,10}?(?:公司|企業社|工程行|商行|商號|合作社|基金會|協會|委員會|管理處|分局|大學|醫院|銀行|法院|檢察署)")
_COMPANY_LATIN = re.compile(r"\b(?:co|ltd|inc|corp|llc|bank|company|limited|group)\b", re.I)
_LABEL = re.compile(
    r"(?m)^[ 　]*(?:原[ 　]*告|被[ 　]*告|(?:被[ 　]*)?上[ 　]*訴[ 　]*人|聲[ 　]*請[ 　]*人|相[ 　]*對[ 　]*人|(?:再[ 　]*)?抗[ 　]*告[ 　]*人|參[ 　]*加[ 　]*人|告[ 　]*訴[ 　]*人|自[ 　]*訴[ 　]*人|"
    r"債[ 　]*權[ 　]*人|債[ 　]*務[ 　]*人|證[ 　]*人|關[ 　]*係[ 　]*人|第[ 　]*三[ 　]*人|(?:法[ 　]*定|訴[ 　]*訟)[ 　]*代[ 　]*理[ 　]*人|繼[ 　]*承[ 　]*人|被[ 　]*害[ 　]*人)"
    rf"[ 　：:]+([{_HAN}]+(?:[{_DOTS}][{_HAN}]+)*|{_LATIN_NAME})(?=[ 　（(，、]|\r?$)"
)
# What a person does, right after the name; titles; signs that begin a sentence's rest.
_ACTS = re.compile(
    r"到庭|到場|到案|證稱|證述|結證|供稱|供述|陳稱|陳述|陳明|指稱|指訴|指述|指證|具結|自承|自白|坦承|坦認|否認|答稱|辯稱|辯以|主張|抗辯|表示|自陳|簽收|代收|收受|收取|簽名|簽章|用印|確[為係有]|代為|死亡|受傷|受僱|任職|出庭|出面|出具|"
    r"於(?:偵查|審理|警詢|警局|訊問|本院|原審|準備程序|言詞辯論|[0-9０-９民])|所[寄有簽]|借[款貸用得]|購[買得]|承租|租用|索討|催討|催告|求償|請求|買受|受讓|給付|返還|匯款|賠償|駕駛|騎乘|搭乘|提起|委任|女士|先生|小姐|君(?=[，。、（(])|等[一二三四五六七八九十0-9]*人"
)
_NO_PERSON_AFTER = re.compile(r"律師|檢察官|法官|書記官|司法事務官|審判長")
_TO_CONTACT = re.compile(
    r"(?:曾|並|再|另|即|又)?(?:自|以|用|從|透過|使用|經由|藉由|藉|留存|留有|撥打)$|(?:現|原)?(?:住|居住於|居|設籍於|設籍|戶籍設|住所)(?:於|在|址)?[：:]?$"
    r"|[（(](?:(?:國民)?身分證(?:統一編號|字號|號碼|號)?|統一編號|護照號碼|電話|手機|行動電話|聯絡電話|住址|地址|住所|住|居|信箱|電子信箱|電子郵件|[Ee]-?mail)?(?:為|是)?[：: ]?$"
    r"|(?:之|的)?(?:電話|手機|行動電話|聯絡電話|信箱|電子信箱|電子郵件|身分證(?:統一編號|字號|號碼|號)?|住址|地址)(?:為|是|：|:)$"
)
_CONTACT_LABEL = re.compile(r"[（(](?:(?:國民)?身分證|統一編號|電話|手機|住|電子信箱|信箱)")
_EDGES = frozenset("。，、；：！？\n\r）)」』「『（( 　.．:,;") | {chr(c) for r in (range(0x3220, 0x3290), range(0x2460, 0x2500)) for c in r}
_WEAK_BEFORE, _WEAK_AFTER = frozenset("由向與對有依經請令和跟給替及讓予據從"), frozenset("於在因以自曾已前為係即未不向與及和對就所之等並亦也雖則仍乃竟遂均經受從到至得嗣既復有另更再又住")
#: Words before the name of a court's officer.
_OFFICER = re.compile(r"(?:法[ 　]*官|書[ 　]*記[ 　]*官|審[ 　]*判[ 　]*長|編[ 　]*輯|覆[ 　]*核|校[ 　]*對|製[ 　]*作|司法事務官|檢察官|通譯)[ 　：:]*$")
#: Scores: a name is taken from NAME_THRESHOLD; what its surroundings and the name itself give.
NAME_THRESHOLD = 0.7
_AT_LABEL, _AT_ROLE, _AT_NARRATIVE, _AT_WEAK, _AT_EDGE = 0.6, 0.4, 0.35, 0.2, 0.15
_BY_CONTACT, _BY_ACT, _BY_WEAK, _BY_EDGE = 0.4, 0.35, 0.15, 0.15

# --- scores ----------------------------------------------------------------------------------------------------------

#: Words near a span that raise (True) or lower its score.
_NEAR = {
    "email": ((re.compile(r"信箱|郵件|電郵|[Ee]-?mail|寄|聯絡"), 0.2), (re.compile(r"(?:法院|書記處|服務|總機|本院)[^，。\n]{0,12}(?:信箱|郵件)[：:][^，。\n]{0,3}$"), -0.8)),
    "phone": ((re.compile(r"電話|手機|聯絡|聯繫|行動|傳真"), 0.3), (re.compile(r"服[ 　]*務[ 　]*電[ 　]*話[ 　]*[：:]?[ 　]*$|(?:總機|專線|客服|洽詢電話|公司電話|本院電話)[：:]?\s*$"), -0.9)),
    "idno": ((re.compile(r"身分證|證號|統號|戶籍|居留"), 0.3), (re.compile(r"(?:案號|車牌|帳號|料號|型號)[：:]?$"), -0.4)),
    "address": ((re.compile(r"住|址|寄往|送達|處所|居"), 0.2), (re.compile(r"院[ 　]*址[ 　]*[：:]?[^，。；：:]*$|(?:設|公司|營業所|事務所|法院|本院|分院)(?:設|址|於|在)?[：:]?$"), -0.8)),
}
_START = {"email": 0.6, "phone": 0.4, "idno": 0.5, "address": 0.5}

#: The number that an identity number's first letter stands for.
_LETTER = dict(zip("ABCDEFGHJKLMNPQRSTUVXYWZIO", range(10, 36), strict=True))


def plain(s: str) -> str:
    """ASCII forms of full-width signs."""
    return s.translate(_WIDE)


def id_holds(s: str) -> bool:
    """Whether the check digit of a national or residence number holds."""
    s = re.sub(r"[^A-Z0-9]", "", plain(s).upper())
    if not re.fullmatch(r"[A-Z][A-Z0-9]\d{8}", s):
        return False
    lead = _LETTER[s[0]]
    second = int(s[1]) if s[1].isdigit() else _LETTER[s[1]] % 10
    digits = [lead // 10, lead % 10, second, *map(int, s[2:])]
    return sum(d * w for d, w in zip(digits, (1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1), strict=True)) % 10 == 0


def ssn_holds(s: str) -> bool:
    """Whether a social security number's parts are ones that are given out."""
    area, group, serial = (int(x) for x in re.split("-", plain(s)))
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def luhn_holds(s: str) -> bool:
    digits = [int(c) for c in plain(s) if c.isdigit()]
    total = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return len(digits) > 1 and total % 10 == 0


def mod97_holds(s: str) -> bool:
    s = re.sub(r"\s", "", plain(s)).upper()
    return len(s) > 4 and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _scored(text: str, kind: str, start: int, end: int) -> float:
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    line = max(before.rfind("\n"), before.rfind("\r")) + 1
    before = before[line:]
    (good, plus), (bad, minus) = _NEAR[kind]
    score = _START[kind]
    if good.search(before) or good.search(after):
        score += plus
    if kind == "idno" and id_holds(text[start:end]):
        score += 0.3
    if bad.search(before):
        score += minus
    return score


def _likely(name: str) -> float | None:
    """What a name gives to its own score; None if it can't be one."""
    if name in ROLES or "○" in name or "〇" in name or "Ｏ" in name:
        return None
    if name[0].isascii() or "À" <= name[0] <= "ɏ":
        return None if _COMPANY_LATIN.search(name) else 0.3
    if not _DOT_SIGNS.isdisjoint(name):
        return None if any(len(p) > 6 for p in re.split(f"[{_DOTS}]", name)) else 0.25
    double = name[:2] in DOUBLE_SURNAMES and len(name) > 2
    if not NO_NAME.isdisjoint(name[2 if double else 1 :]) or name.startswith(_LONG_ROLES) or name.endswith(_LONG_ROLES) or _COMPANY.search(name):
        return None
    if double:
        return 0.3 if len(name) < 5 else 0.0
    if len(name) > 3:
        return 0.0
    if name[0] in SURNAMES:
        return 0.25 if len(name) == 3 else 0.2
    return 0.1 if name[0] in MAYBE_SURNAMES and len(name) == 3 else None if name[0] in NO_NAME else 0.0


def _before(text: str, start: int) -> float:
    """What stands right before a name gives to its score."""
    if not start:
        return _AT_EDGE
    c = text[start - 1]
    if _ROLE_BEFORE.search(text, max(0, start - 10), start):
        return _AT_ROLE
    if c in "嗣詎迨俟":
        return _AT_NARRATIVE
    return _AT_WEAK if c in _WEAK_BEFORE else _AT_EDGE if c in _EDGES else 0.0


def _after(text: str, end: int, contacts: frozenset[int]) -> float:
    if end in contacts or (text[end : end + 1] in ("（", "(") and end + 1 in contacts) or _CONTACT_LABEL.match(text, end):
        return _BY_CONTACT
    if _ACTS.match(text, end):
        return _BY_ACT
    c = text[end : end + 1]
    return _BY_EDGE if not c or c in _EDGES else _BY_WEAK if c in _WEAK_AFTER else 0.0


def _ends_of(text: str, start: int) -> list[int]:
    """Where a name that starts here may end."""
    c = text[start : start + 1]
    if c.isascii() or "À" <= c <= "ɏ":
        m = _LATIN_AT.match(text, start)
        return [m.end()] if m else []
    m = _DOTTED_AT.match(text, start)
    dotted = []
    if m:  # the last part may be followed by other words
        last = max(text.rfind(d, start, m.end()) for d in _DOTS)
        dotted = [e for e in range(last + 2, min(m.end(), last + 7) + 1)]
    han = _HAN_AT.match(text, start)
    return dotted + [start + n for n in range(2, (han.end() - start if han else 0) + 1)]


def _starts_of(text: str, end: int) -> list[int]:
    """Where a name that ends here may start."""
    c = text[end - 1 : end]
    if not c:
        return []
    if c.isascii() or "À" <= c <= "ɏ":
        if not c.isalpha():
            return []
        i = end
        while i and (text[i - 1].isalpha() and not "㐀" <= text[i - 1] or text[i - 1] in "-'’.．·・‧• "):
            i -= 1
        m = _LATIN_END.match(text, i, end)
        return [m.start(1)] if m else []
    i = end
    while i > max(0, end - 4) and _HAN_END.match(text, i - 1):
        i -= 1
    out = list(range(i, end - 1))
    j = end
    while j > max(0, end - 24) and _DOTTED_END.match(text, j - 1):
        j -= 1
    dots = [k for k in range(j, end) if text[k] in _DOTS]
    if dots:  # the first part may follow other words
        out += [k for k in range(max(j, dots[0] - 6), dots[0])]
    return out


def _names(text: str, contacts: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Spans of private persons' names: proposals by what stands before or after, scored by both sides and the name itself."""
    scores: dict[tuple[int, int], float] = {}
    starts = frozenset(a for a, _ in contacts)

    def propose(start: int, end: int, before: float | None = None, after: float | None = None) -> None:
        own = _likely(text[start:end])
        if own is None or _NO_PERSON_AFTER.match(text, end) or _OFFICER.search(text, max(0, start - 16), start):
            return
        before = _before(text, start) if before is None else before
        after = _after(text, end, starts) if after is None else after
        if before and after and (after > _BY_WEAK or not _COMPANY_ON.match(text, end)):
            score = before + after + own
            if score >= NAME_THRESHOLD - 1e-9:
                scores[start, end] = max(score, scores.get((start, end), 0.0))

    for m in _LABEL.finditer(text):
        if len(m[1]) > 4 and _likely(m[1][:2]) is not None and not _COMPANY.search(m[1]) and not any(c in NO_NAME for c in m[1]) and not any(d in m[1] for d in _DOTS) and m[1] not in ROLES and not m[1][0].isascii():
            if len(m[1]) <= 12 and not _NO_PERSON_AFTER.match(text, m.end(1)):
                scores[m.span(1)] = _AT_LABEL + _BY_EDGE
        else:
            propose(*m.span(1), _AT_LABEL, max(_BY_EDGE, _after(text, m.end(1), starts)))
    for pattern, before in ((_ROLE, _AT_ROLE), (_NARRATIVE, _AT_NARRATIVE)):
        for m in pattern.finditer(text):
            if text[m.end()] not in _NO_FIRST:
                for end in _ends_of(text, m.end()):
                    propose(m.end(), end, before)
    for m in _ACTS.finditer(text):
        if m.start() and text[m.start() - 1] not in _NO_LAST:
            for start in _starts_of(text, m.start()):
                propose(start, m.start(), None, _BY_ACT)
    for a, _ in contacts:
        line = max(text.rfind("\n", 0, a) + 1, a - 16) if a else 0
        if m := _TO_CONTACT.search(text, line, a):
            for start in _starts_of(text, m.start()):
                propose(start, m.start(), None, _BY_CONTACT)
    found: set[tuple[int, int]] = set()
    taken: list[tuple[int, int]] = []
    for (a, b), _ in sorted(scores.items(), key=lambda x: (-x[1], -(x[0][1] - x[0][0]), x[0])):
        if all(b <= c or d <= a for c, d in taken):
            taken.append((a, b))
            found.add((a, b))
    # elsewhere in the text, as a name that is known now
    for name in {text[a:b] for a, b in found}:
        at = text.find(name)
        while at >= 0:
            end = at + len(name)
            latin = name[0].isascii() and (text[at - 1 : at].isalpha() and text[at - 1 : at].isascii() or text[end : end + 1].isalpha() and text[end : end + 1].isascii())
            if not latin and not _OFFICER.search(text, max(0, at - 16), at):
                found.add((at, end))
            at = text.find(name, at + 1)
    return found


_CLAUSE_END = re.compile(r"[，。；、\r\n]")
_AT_SIGNS = ("@", "＠", "小老鼠", "at", "AT", "At", "ａｔ")
_LOCAL_SIGNS = frozenset("._%+＿．－-") | {chr(c + d) for c in [*range(48, 58), *range(65, 91), *range(97, 123)] for d in (0, 0xFEE0)} | {"_"}


def _contacts(text: str) -> list[tuple[float, str, int, int]]:
    """Scored proposals of mail addresses, phone and identity numbers, and street addresses."""
    spans: list[tuple[float, str, int, int]] = []
    for m in _AT.finditer(text) if any(sign in text for sign in _AT_SIGNS) else ():
        low = m.start()
        while low and text[low - 1] in _LOCAL_SIGNS:
            low -= 1
        local = _LOCAL.search(text[low : m.start()])
        host = _HOST.match(text, m.end())
        if local and host:
            a, b = low + local.start(), host.end()
            spans.append((_scored(text, "email", a, b), "email", a, b))
    # signs without which a pattern can't match, as they are found much sooner than patterns
    for pattern, kind, signs in ((_PHONE, "phone", None), (_PHONE_CN, "phone", "九"), (_IDNO, "idno", None), (_ADDRESS_EN, "address", ("No.",))):
        if signs is None or any(sign in text for sign in signs):
            for m in pattern.finditer(text):
                spans.append((_scored(text, kind, *m.span()), kind, *m.span()))
    for m in _PHONE_FOREIGN.finditer(text) if "+" in text or "＋" in text else ():
        if 8 <= sum(c.isdigit() for c in plain(m[0])) <= 15:
            spans.append((_scored(text, "phone", *m.span()) + 0.2, "phone", *m.span()))
    for m in _SSN.finditer(text) if "-" in text or "－" in text else ():
        if ssn_holds(m[0]):
            spans.append((_scored(text, "idno", *m.span()), "idno", *m.span()))
    for m in _PASSPORT.finditer(text) if "護照" in text or "居留證" in text or "assport" in text else ():
        spans.append((0.7, "idno", *m.span(1)))
    at, seen = text.find("號"), 0
    while at >= 0:  # an address is looked for in a clause that has a door number
        low = max(seen, *(text.rfind(c, seen, at) + 1 for c in "，。；、\r\n"))
        stop = _CLAUSE_END.search(text, at)
        seen = stop.start() if stop else len(text)
        for m in _ADDRESS.finditer(text, low, seen):
            spans.append((_scored(text, "address", *m.span()), "address", *m.span()))
        at = text.find("號", seen)
    return spans


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(info_type, start, end) of the personal information in a text, by position; spans don't overlap. None in no text."""
    if not text:
        return []
    spans = _contacts(text)
    for m in _LONG_NUMBER.finditer(text):
        if luhn_holds(m.group()) and 13 <= sum(c.isdigit() for c in plain(m.group())) <= 19:
            near = re.search(r"卡號|信用卡|card", text[max(0, m.start() - 12) : m.start()])
            spans.append((0.6 if near else 0.3, "card", *m.span()))
    for m in _IBAN.finditer(text):
        if mod97_holds(m.group()):
            spans.append((0.8, "account", *m.span()))
    good = [(a, -b, kind, b) for score, kind, a, b in spans if score >= THRESHOLD]
    good += [(a, -b, "name", b) for a, b in _names(text, sorted((a, b) for a, _, kind, b in good if kind not in ("card", "account")))]
    out: list[tuple[str, int, int]] = []
    taken = 0
    for a, _, kind, b in sorted(good):
        if a >= taken:
            out.append((kind, a, b))
            taken = b
    return out


def masked(text: str | None) -> str | None:
    """The text with a typed placeholder for each piece of personal information, else unchanged."""
    if not text:
        return text
    parts, at = [], 0
    for kind, a, b in find(text):
        parts += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*parts, text[at:]])


# --- plans -----------------------------------------------------------------------------------------------------------


def _find_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, kinds, starts, ends = [], [], [], []
        for i, t in enumerate(batch.column(2).to_pylist()):
            for kind, a, b in find(t):
                rows.append(i)
                kinds.append(kind)
                starts.append(a)
                ends.append(b)
        at = pa.array(rows, type=pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(kinds, type=pa.string()), pa.array(starts, type=pa.int64()), pa.array(ends, type=pa.int64())],
            names=["record_table", "record_id", "info_type", "start_pos", "end_pos"],
        )


def texts(decisions: DataFrame, citations: DataFrame) -> DataFrame:
    """(record_table, record_id, text) of the records with an id and a text."""
    d = decisions.where("id is not null and clean_text is not null")
    c = citations.where("id is not null and snippet is not null")
    return d.select(F.lit("decisions").alias("record_table"), F.col("id").alias("record_id"), F.col("clean_text").alias("text")).unionByName(
        c.select(F.lit("citations").alias("record_table"), F.col("id").alias("record_id"), F.col("snippet").alias("text"))
    )


def personal_spans(records: DataFrame) -> DataFrame:
    """(record_table, record_id, info_type, start_pos, end_pos); copies of a row give their spans once."""
    return records.mapInArrow(_find_rows, "record_table string, record_id long, info_type string, start_pos long, end_pos long").distinct()


def without_personal(records: DataFrame) -> DataFrame:
    """(record_table, record_id, text) with placeholders, copies of a row once."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([masked(t) for t in batch.column(2).to_pylist()], type=pa.string())], names=["record_table", "record_id", "text"]
            )

    return records.dropDuplicates(["record_table", "record_id"]).mapInArrow(mask, "record_table string, record_id long, text string")
