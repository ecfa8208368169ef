"""Citations and statutes of texts as rows.

One Arrow pass per text proposes citations and cuts out what the conditions look at; the conditions themselves are columns,
so that each can be counted and changed by itself.
"""


from collections.abc import Callable, Iterator, Sequence
from dataclasses import astuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh.functions.text import target_case_type
from casemesh.parse import citations as C
from casemesh.parse import cleaner
from casemesh.parse import statutes as S

# Words that the conditions look for. \s and \d are written out, since engines differ on them.
_D, _S = "[0-9０-９]", "[ \t\r\n　]"
CLOSING = "意旨|參照|見解|供參|同此"
HISTORY = (
    "(?:確定|執行|終結)在案|裁定駁回|判決駁回|駁回(?:上訴|抗告)?確定|上訴(?:駁回|不受理)|(?:判決|裁定|處分)確定|廢棄|發回|緩刑|(?:此|業|嗣)經|業據|不服|(?:提起|撤回)上訴|提起公訴|提起抗告|聲請再審"
    "|裁定停止執行|言詞辯論終結|移送(?:執行|併辦)|前依|(?:審理|受理|繫屬)中|事件終結前|(?:判決|裁定)認定|即堪認定|(?:判決|裁定)所載|(?:如)?附表(?:所示|編號)?|(?:判處|處有期徒刑|處拘役)"
)
EVIDENCE = (
    f"[（( ](?:見)?(?:本院|偵查|原審|審理|上訴|抗告)[^\n]{{0,5}}卷|見本院|見外放|見偵查?卷|刑事(?:卷宗?|判決書)|偵(?:查影卷|字卷|查卷)|他字卷|執行卷|卷[^\n]{{0,2}}第{_D}|判決書[，。（(第]|鑑定(?:報告|函)|起訴書"
    f"|(?:言詞辯論|準備程序)筆錄|光碟|查閱|核閱|調閱|卷宗(?:可[稽查參])?|在卷(?:可[稽查參])?|存卷(?:可[稽查參])?|附卷(?:可[稽查參考])?|有[^\n]{{0,15}}(?:在|附)卷|可查|可稽|可憑|可按|可佐|足稽|足據|無訛"
    f"|為證(?:[，。；]|{_S})|兩造(?:所)?不爭(?:執)?"
)
ACCEPT = "考諸|參照|同旨|判決意旨|裁定意旨|裁判意旨|同此|指明|載明|闡釋|闡示|闡述|明示|係指|揭示|可知|參酌|供參"
ACCEPT_AUTHORITY = (
    "參照|可參|同旨|同此|揆諸|考諸|指明|載明|闡釋|闡示|闡述|明示|揭示|係指|所謂|係就|係以|可知|參酌|供參|釋明|判決理由|理由書略以|要旨參|解釋在案|解釋文著有明文|解釋認"
)
_SUBJECT = "(?:再審|反訴|反請求)?(?:原告|被告|檢察官|上訴人|被上訴人|抗告人|聲請人|異議人)[一-鿿]{0,4}"
PARTY_CLAIM = (
    "(?:上訴|抗告|再審|聲請刑事補償|聲請|異議|公訴)意旨(?:略以|主張|略謂|固以)"
    f"|{_SUBJECT}(?:(?:雖|固)?(?:主張|辯稱|抗辯|則以|答辯|略以|所指|稱|謂)|(?:雖|固)以|所[舉引])|{_SUBJECT}於[^\r\n]{{0,15}}(?:書|狀)"
    "|(?:主張|答辯|抗辯)略(?:以|謂)|主張要旨|上訴理由"
)
BLOCKS_RESCUE = "云云|等情(?!況|形)|等語|等等"

_OWN = ("own_court string", "own_jyear int", "own_jcase string", "own_jno int")
_ROW = (
    "id long, citation_type string, court string, raw_match string, match_start int, match_end int, jyear int, jcase_norm string, jno int, auth_type string, auth_key string, display string, "
    "doc_type string, is_abbreviated boolean, needs_intent boolean, reason_pos int, footer_pos int, post_sentence string, clause string, section_before string, just_before string, post_long string, snippet string"
)
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _proposal_rows(batches: Iterator[pa.RecordBatch], targets: frozenset[str], carried: int) -> Iterator[pa.RecordBatch]:
    """(id, text, court, and carried columns) to proposals, a ruling's carried columns with each of them."""
    schema = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in _ROW.split(", "))])
    for batch in batches:
        rows, of = [], []
        for i, (key, text, court) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
            found = C.proposals(text, court, targets)
            frame = C.text_frame(text) if found else None
            rows += [(key, *astuple(p), *frame, *C.surroundings(text, p).values()) for p in found]
            of += [i] * len(found)
            if len(rows) >= 2000:
                yield _batch(rows, schema, batch, of, carried)
                rows, of = [], []
        if rows:
            yield _batch(rows, schema, batch, of, carried)


def _batch(rows: list[tuple], schema: pa.Schema, batch: pa.RecordBatch, of: list[int], carried: int) -> pa.RecordBatch:
    made = [pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)]
    more = [batch.column(3 + k).take(pa.array(of)) for k in range(carried)]
    return pa.RecordBatch.from_arrays([*made, *more], names=[*schema.names, *batch.schema.names[3 : 3 + carried]])


def proposals(texts: DataFrame, targets: frozenset[str] = C.TARGET_COURTS) -> DataFrame:
    """From (id, text, court) every proposal with its surroundings. Null and empty texts give none."""
    return texts.select("id", "text", "court").mapInArrow(lambda b: _proposal_rows(b, targets, 0), _ROW)


def reject_reason() -> Column:
    """The first condition that a proposal fails, by name; null if it is a citation.

    Needs the source's own docket as own_court, own_jyear, own_jcase, own_jno.
    """
    ruling, authority_like = F.col("citation_type") == "decision", F.col("jcase_norm").isin(*C.CONSTITUTIONAL)
    plain_ruling = ruling & ~F.coalesce(authority_like, F.lit(False))
    closed = F.col("post_sentence").rlike(CLOSING)
    own = ruling & (F.col("court") == F.col("own_court")) & (F.col("jyear") == F.col("own_jyear")) & (F.col("jcase_norm") == F.col("own_jcase")) & (F.col("jno") == F.col("own_jno"))
    rescued = (F.col("just_before").rlike(ACCEPT) | F.col("post_sentence").rlike(ACCEPT)) & ~F.col("post_long").rlike(BLOCKS_RESCUE)
    rules = (
        ("R007_after_zhengben", F.col("match_start") >= F.col("footer_pos")),
        ("R006_before_reason", (F.col("reason_pos") > 0) & (F.col("match_start") < F.col("reason_pos"))),
        ("R001_self_citation", F.coalesce(own, F.lit(False))),
        ("R003_prior_case", plain_ruling & F.col("clause").rlike(HISTORY) & ~closed),
        ("R011_evidence_cite", plain_ruling & F.col("clause").rlike(EVIDENCE) & ~closed),
        ("R002_ben_yuan_missing_intent", F.col("raw_match").startswith("本院") & ~closed),
        ("R009_district_court_missing_intent", ruling & F.col("court").contains("地方法院") & ~closed),
        ("R005a_party_context", F.col("section_before").rlike(PARTY_CLAIM) & ~rescued),
        ("R010_authority_missing_intent", F.col("needs_intent") & ~F.col("clause").rlike(ACCEPT_AUTHORITY)),
    )
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules])


def judged(texts: DataFrame, targets: frozenset[str] = C.TARGET_COURTS, also: Sequence[str] = ()) -> DataFrame:
    """Proposals of (id, text, court, own_court, own_jyear, own_jcase, own_jno) with reject_reason and target_case_type, in one pass over the texts.

    Columns that also names are carried to each proposal of their text.
    """
    own = [F.col(n).cast(t).alias(n) for n, t in (c.split() for c in _OWN)]
    kinds = dict(texts.dtypes)
    carried = [*_OWN, *(f"{n} {kinds[n]}" for n in also)]
    found = texts.select("id", "text", "court", *own, *also).mapInArrow(lambda b: _proposal_rows(b, targets, len(carried)), ", ".join([_ROW, *carried]))
    return found.withColumns({"reject_reason": reject_reason(), "target_case_type": target_case_type(F.col("raw_match"))})


def citations(texts: DataFrame, targets: frozenset[str] = C.TARGET_COURTS) -> DataFrame:
    """The proposals that are citations."""
    surroundings = ("post_sentence", "clause", "section_before", "just_before", "post_long", "reason_pos", "footer_pos", "own_court", "own_jyear", "own_jcase", "own_jno")
    return judged(texts, targets).where("reject_reason is null").drop(*surroundings, "reject_reason")


def _statute_rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, *s) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in S.statutes(t, names)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], type=pa.int64()), *[pa.array(c, type=pa.string()) for c in columns[1:]]], names=["id", "law", "article_raw", "sub_ref", "raw_match"]
        )


def statutes(texts: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """(id, law, article_raw, sub_ref, raw_match) of the statutes in (id, text); names adds known laws."""
    return texts.select("id", "text").mapInArrow(lambda b: _statute_rows(b, names), "id long, law string, article_raw string, sub_ref string, raw_match string")


def law_names(texts: DataFrame, least: int = 3) -> DataFrame:
    """(law, n_texts): names of laws that (id, text) mention before articles in at least so many texts, besides the known ones.

    The table that statutes() takes as names. It is as long as a country has laws, not as long as the texts.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, n) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n in dict.fromkeys(S.likely_names(t))]
            ids, names = list(zip(*found, strict=True)) or ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(names, type=pa.string())], names=["id", "law"])

    each = texts.select("id", "text").mapInArrow(rows, "id long, law string").distinct()
    return each.groupBy("law").agg(F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= least)


def names_of(table: DataFrame, most: int = 20_000) -> tuple[str, ...]:
    """The names (law) of a table, for statutes(); a table of more than so many is no list of laws and an error."""
    names = sorted(r[0] for r in table.select("law").where("law is not null").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} names of laws")
    return tuple(names)


def ruling_statutes(decisions: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """(decision_id, law, article_raw, sub_ref, raw_match): the statutes of the rulings' own texts, each once per ruling."""
    texts = decisions.where("id is not null and clean_text is not null").select("id", F.col("clean_text").alias("text")).dropDuplicates(["id"])
    return statutes(texts, names).withColumnRenamed("id", "decision_id")


def missing_statutes(texts: DataFrame, done: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """Statutes of those (id, text) whose id isn't among the done (id): the back-fill after a batch."""
    return statutes(texts.join(done.select("id").distinct(), "id", "left_anti"), names)


def text_function(function: Callable[[str | None], object], kind: str) -> Callable[[Column], Column]:
    """A parser of single texts as an Arrow column function."""

    @F.pandas_udf(kind)
    def mapped(s: pd.Series) -> pd.Series:
        return s.map(function, na_action="ignore")

    return mapped


def cleaned(raw: Column) -> Column:
    """The clean text of raw texts."""
    return text_function(cleaner.clean, "string")(raw)
