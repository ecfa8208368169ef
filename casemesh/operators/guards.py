"""Older conditions on citations, kept beside the present ones: they look at sections and at what follows within a few signs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemesh.functions.text import last_place_of

# Headings of what parties say, of what the court finds, and of its legal reasoning; words of intent; reach.
_NUM = "[一二三四五六七八九十壹貳參肆伍陸柒捌玖甲乙丙丁]+"
PARTY_SECTION = (
    rf"(?:{_NUM}[、：:,，]|[㈠㈡㈢㈣㈤㈥㈦㈧㈨㈩])[^\n]{{0,50}}(?:原告(?:起訴|之|的)?主張|被告(?:答辯|抗辯)?|抗告意旨|上訴意旨|主張略以|答辯略以|抗辯略以|聲請人主張|反訴主張|反請求主張|被告則以|兩造不爭|不爭之事實|主張要旨|答辯要旨|辯護意旨"
    r"|聲請意旨略以|聲請意旨略謂|上訴意旨略以|聲請再審意旨略以|聲請刑事補償意旨略以)|(?:本件)?(?:聲請(?:再審)?|上訴|抗告)意旨略(?:以|謂)|原(?:裁定|判決|處分|審)略以"
)
COURT_SECTION = rf"{_NUM}[、：:,，][^\n]{{0,20}}(?:本院(?:之|的)?判斷|本院查|本院認為|惟查|經查|得心證之理由|茲就上訴意旨[，]?(?:再)?補充論斷如下)"
LEGAL_SECTION = rf"{_NUM}[、：:,，][^\n]{{0,40}}?(?:按|再按|復按|次按|又按|惟按)"
INTENT = "參照|意旨"
REACH, INTENT_REACH = 3000, 10


def claim_snippet(snippet: Column, raw_match: Column) -> Column:
    """Whether a snippet only reports a claim: it ends with 云云。, or the citation stands before 云云."""
    at, said = F.instr(snippet, raw_match), F.instr(snippet, "云云")
    return F.coalesce(F.rtrim(snippet).endswith("云云。") | ((at > 0) & (said > 0) & (at < said)), F.lit(False))


def lacks_intent(text: Column, match_end: Column) -> Column:
    """Whether none of the words of intent follows within a few signs."""
    return ~F.coalesce(F.substring(text, match_end + 1, F.lit(INTENT_REACH)).rlike(INTENT), F.lit(False))


def in_party_section(text: Column, match_start: Column) -> Column:
    """Whether the last heading before a citation, within REACH signs, is of what a party says.

    A heading of the court's own findings or of legal reasoning after it means that it isn't.
    """
    low = F.greatest(match_start - REACH, F.lit(0))
    before = F.substring(text, low + 1, match_start - low)
    party, court, legal = (last_place_of(before, p) for p in (PARTY_SECTION, COURT_SECTION, LEGAL_SECTION))
    return F.coalesce((party > 0) & (party >= legal) & (party > court), F.lit(False))
