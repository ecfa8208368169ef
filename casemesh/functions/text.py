"""Column functions on courts, dockets and rulings' texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemesh.functions.plain import WHITE, stripped

# Names and words of courts, documents and cases.
COURT_SHORT = {"北高行": "台北高等行政法院", "中高行": "台中高等行政法院", "高高行": "高雄高等行政法院"}
COURT_CLASSES = (
    ("憲法法庭", "憲法法庭"), ("最高行政法院", "最高行政法院"), ("最高法院", "最高法院"), ("智慧財產", "智慧財產法院"), ("簡易庭", "簡易庭"), ("地方庭", "高等行政法院地方庭"),
    ("行政法院", "高等行政法院"), ("高等法院", "高等法院"), ("少年", "少年及家事法院"), ("家事", "少年及家事法院"), ("地方法院", "地方法院"),
)
DOC_TYPE_WORDS = (
    ("憲判字", "憲判字"), ("宣示判決", "宣判筆錄"), ("宣判筆錄", "宣判筆錄"), ("調解筆錄", "調解筆錄"), ("和解筆錄", "和解筆錄"), ("裁定", "裁定"), ("判決", "判決"),
    ("支付命令", "裁定"), ("保護令", "裁定"), ("補償決定書", "補償決定書"),
)
CASE_TYPE_SIGNS = (("民", "民事"), ("刑", "刑事"), ("行", "行政"), ("憲", "憲法"))
COURT_LEVELS = {
    "憲法法庭": 0, "最高法院": 1, "最高行政法院": 1, "高等法院": 2, "高等行政法院": 2, "智慧財產法院": 2, "高等行政法院地方庭": 3, "地方法院": 3, "少年及家事法院": 3, "簡易庭": 4,
}


def _first(c: Column, words, otherwise: Column | None = None) -> Column:
    out = None
    for word, value in words:
        out = F.when(c.contains(word), F.lit(value)) if out is None else out.when(c.contains(word), F.lit(value))
    return out.otherwise(otherwise) if otherwise is not None else out


def graph_court(c: Column) -> Column:
    """A court's name at the graph's boundary: without white space, 台 as 臺."""
    return F.translate(c, "台" + WHITE, "臺")


def citation_court(c: Column) -> Column:
    """A court's name as the citation scanner writes it: trimmed, 臺 as 台, short names in full."""
    plain = stripped(F.translate(c, "臺", "台"))
    out = plain
    for short, full in COURT_SHORT.items():
        out = F.when(plain == short, full).otherwise(out)
    return out


def case_word(c: Column) -> Column:
    """A docket's case word: without blanks, 臺 as 台."""
    return F.translate(c, "臺 ", "台")


def court_root(c: Column) -> Column:
    """The class of a court by the first word that its name contains, else the name."""
    return _first(c, COURT_CLASSES, c)


def court_level(c: Column) -> Column:
    """The level of a court class from 0 (constitutional) to 4 (summary); null when unknown."""
    return F.create_map(*[F.lit(x) for kv in COURT_LEVELS.items() for x in kv])[c]


def doc_type(text: Column) -> Column:
    """The kind of document from its first 200 signs, blanks left out; null if none of the words is there."""
    return _first(F.translate(F.substring(text, 1, 200), WHITE, ""), DOC_TYPE_WORDS)


def date_of(c: Column) -> Column:
    """The date of eight digits yyyyMMdd; null for anything else, impossible dates included."""
    return F.when(F.length(c) == 8, F.try_to_date(c, "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(c, F.lit("yyyyMMdd"))))


def simple_court(c: Column) -> Column:
    """A summary court's name cut back to the court that it belongs to."""
    at = F.instr(c, "法院")
    return F.when(c.endswith("簡易庭") & (at > 0), F.substring(c, F.lit(1), at + 1)).otherwise(c)


def display_title(jyear: Column, jcase: Column, jno: Column) -> Column:
    """{year}年度{case}字第{no}號, empty if a part is missing."""
    whole = F.concat(jyear.cast("string"), F.lit("年度"), jcase, F.lit("字第"), jno.cast("string"), F.lit("號"))
    return F.coalesce(whole, F.lit(""))


def ref_key(unit: Column, jyear: Column, jcase: Column, jno: Column) -> Column:
    return F.concat_ws("|", unit, jyear.cast("string"), jcase, jno.cast("string"))


def target_case_type(raw_match: Column) -> Column:
    """The case type that the text of a citation names itself; null if none."""
    return _first(raw_match, CASE_TYPE_SIGNS)


def squeezed_han(c: Column) -> Column:
    """Without white space between Han signs, digits and enclosed signs."""
    signs = r"[一-鿿0-9０-９㈀-㋿①-⓿]"
    return F.regexp_replace(c, rf"(?U)(?<={signs})[\s&&[^\r\n]]+(?={signs})", "")


def flat(c: Column) -> Column:
    """On one line: line ends dropped, other white space as one blank."""
    return F.regexp_replace(F.regexp_replace(c, "[\r\n]+", ""), f"[{WHITE}]+", " ")


def place_of(text: Column, pattern: str) -> Column:
    """Where a pattern first stands, from 1, or 0. In characters; regexp_instr counts those outside the basic plane twice."""
    parts = F.split(text, pattern, 2)
    return F.when(F.size(parts) > 1, F.length(parts[0]) + 1).otherwise(0)


def last_place_of(text: Column, pattern: str) -> Column:
    """Where a pattern last begins, from 1, or 0, in characters."""
    mark = "\ue0fe"
    parts = F.split(F.regexp_replace(text, f"(?={pattern})", mark), mark)
    return F.when(F.size(parts) > 1, F.length(text) - F.length(F.element_at(parts, -1)) + 1).otherwise(0)


_HEADINGS = {"main": "主[ 　]*文", "fact": "(?:犯[ 　]*罪[ 　]*)?事[ 　]*實", "reason": "(?:(?:犯[ 　]*罪[ 　]*)?事[ 　]*實[ 　]*(?:及|與)[ 　]*)?理[ 　]*由(?:[ 　]*要[ 　]*領)?"}


def sections(text: Column) -> Column:
    """struct(header, main, fact, reason): the parts of a ruling by its heading lines; a part without heading is null."""
    t = F.concat(F.lit("\n"), F.regexp_replace(text, "\r\n", "\n"), F.lit("\n"))
    at = {k: place_of(t, rf"\n[ 　]*{p}[ 　]*[：:]?[ 　]*(?=\n)") for k, p in _HEADINGS.items()}
    end = F.length(t) + 1

    def after(*keys: str) -> Column:
        return F.least(*[F.when(at[k] > 0, at[k]).otherwise(end) for k in keys], end)

    def part(key: str, *nexts: str) -> Column:
        stop = F.least(end, *[F.when(at[n] > at[key], at[n]).otherwise(end) for n in nexts]) if nexts else end
        body = F.substring(t, at[key] + 1, stop - at[key] - 1)
        return F.when(at[key] > 0, F.btrim(F.regexp_replace(body, "^[^\n]*\n?", ""), F.lit("\n 　")))

    return F.struct(
        F.btrim(F.substring(t, F.lit(1), after(*_HEADINGS) - 1), F.lit("\n 　")).alias("header"),
        part("main", "fact", "reason").alias("main"),
        part("fact", "reason").alias("fact"),
        part("reason").alias("reason"),
    )


#: Characters at the end of a ruling in which its footer is looked for.
TAIL = 500
# Signs of items at the start of a line, by which a text is divided; digits in Han signs.
_ITEM = (
    r"((?:^|\n)[ \t　]*)(?=[㈠㈡㈢㈣㈤㈥㈦㈧㈨㈩⒈⒉⒊⒋⒌⒍⒎⒏⒐⒑⒒⒓⒔⒕⒖⒗⒘⒙⒚⒛①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳⑴⑵⑶⑷⑸⑹⑺⑻⑼⑽]|[一二三四五六七八九十]+、|[（(][一二三四五六七八九十]+[）)]|[0-9０-９]{1,3}[.、](?![0-9０-９]))"
)
_HAN_DIGITS = "一二三四五六七八九"
_MARK = "\ue0ff"


def footer_position(text: Column) -> Column:
    """Where the footer's date begins in the last TAIL signs, from 0; null if it doesn't."""
    low = F.greatest(F.length(text) - TAIL, F.lit(0))
    at = place_of(F.substring(text, low + 1, F.lit(TAIL)), r"(?U)中\s*華\s*民\s*國")
    return F.when(at > 0, low + at - 1)


def item_positions(text: Column) -> Column:
    """Where items like 一、 begin at the start of a line, from 0: the text is divided at them, and the parts' lengths added up."""
    parts = F.transform(F.split(F.regexp_replace(text, _ITEM, "$1" + _MARK), _MARK), lambda p: F.length(p))
    before = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, n: a + n)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), before)).otherwise(F.array().cast("array<int>"))


def number(written: Column) -> Column:
    """A number in digits or in Han signs below a thousand."""
    digit = lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(_HAN_DIGITS), c))
    part = lambda unit: F.regexp_extract(written, f"([{_HAN_DIGITS}]?){unit}", 1)
    times = lambda unit: F.when(F.instr(written, unit) > 0, F.greatest(digit(part(unit)), F.lit(1))).otherwise(0)
    rest = digit(F.regexp_extract(written, f"([{_HAN_DIGITS}])$", 1))
    return F.coalesce(F.when(written.rlike("^[0-9]+$"), written).try_cast("int"), (times("百") * 100 + times("十") * 10 + rest).cast("int"))


def authority_root(kind: Column, key: Column) -> Column:
    """The body that an authority comes from: by its type, of conferences by the organiser that its key begins with.

    Joint-conference resolutions of administrative courts fall to 司法院 like every type without a rule.
    """
    conference = kind == "法律座談會"
    return (
        F.when(kind == "決議", "最高法院")
        .when(conference & key.startswith("高等行政法院"), "高等行政法院")
        .when(conference & key.startswith("高等法院"), "高等法院")
        .otherwise("司法院")
    )
