"""Stage one of a search: the sources whose text meets all conditions."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh.functions.plain import stripped
from casemesh.parse.statutes import law_name

#: Case types that a search may name.
CASE_TYPES = ("民事", "刑事", "行政", "憲法")


@dataclass(frozen=True)
class StatuteFilter:
    law: str
    article: str | None = None
    sub_ref: str | None = None


@dataclass(frozen=True)
class SearchSpec:
    """What a search asks for. Keywords and statutes must all be met, exclusions must all be absent."""

    keywords: tuple[str, ...]
    statutes: tuple[StatuteFilter, ...] = ()
    exclude_keywords: tuple[str, ...] = ()
    exclude_statutes: tuple[StatuteFilter, ...] = ()
    case_types: tuple[str, ...] = ()


def spec_of(request: dict) -> SearchSpec:
    """A spec from a request: lists of terms, of (law, article, sub_ref) and a comma-separated list of case types. Unknown fields are an error."""
    if unknown := set(request) - {f.name for f in fields(SearchSpec)}:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    filters = lambda name: tuple(StatuteFilter(*(f.values() if isinstance(f, dict) else f)) for f in request.get(name) or ())
    types = request.get("case_types") or ""
    return checked(SearchSpec(tuple(request.get("keywords") or ()), filters("statutes"), tuple(request.get("exclude_keywords") or ()), filters("exclude_statutes"), normal_case_types(types if isinstance(types, str) else ",".join(types))))


def normal_terms(terms) -> tuple[str, ...]:
    """Trimmed, without blanks and repetitions, in order."""
    return tuple(dict.fromkeys(t.strip() for t in terms or () if t and t.strip()))


def normal_case_types(value: str | None) -> tuple[str, ...]:
    """Of a comma-separated list; an unknown type is an error."""
    types = normal_terms((value or "").split(","))
    if bad := [t for t in types if t not in CASE_TYPES]:
        raise ValueError(f"unknown case types: {', '.join(bad)}")
    return types


def normal_filters(filters) -> tuple[StatuteFilter, ...]:
    """With laws by their full names, each once, in order."""
    return tuple(dict.fromkeys(StatuteFilter(law_name(f.law), f.article, f.sub_ref) for f in filters or ()))


def checked(spec: SearchSpec) -> SearchSpec:
    """A spec with its terms and filters in order; without any keyword it is an error."""
    keywords = normal_terms(spec.keywords)
    if not keywords:
        raise ValueError("a search needs at least one keyword")
    return SearchSpec(keywords, normal_filters(spec.statutes), normal_terms(spec.exclude_keywords), normal_filters(spec.exclude_statutes), normal_case_types(",".join(spec.case_types)))


def statute_match(statutes: Column, f: StatuteFilter, exact: bool = False) -> Column:
    """Whether one statute of the array meets the filter; its sub_ref by prefix, or exactly."""

    def one(s: Column) -> Column:
        cond = s["law"] == f.law
        if f.article:
            cond &= s["article_raw"] == f.article
        if f.sub_ref:
            cond &= (s["sub_ref"] == f.sub_ref) if exact else s["sub_ref"].startswith(f.sub_ref)
        return F.coalesce(cond, F.lit(False))

    return F.coalesce(F.exists(statutes, one), F.lit(False))


def statute_condition(f: StatuteFilter, exact: bool = True) -> Column:
    """The same on the columns of a statute table."""
    cond = stripped(F.col("law")) == f.law
    if f.article:
        cond &= F.col("article_raw") == f.article
    if f.sub_ref:
        cond &= (F.col("sub_ref") == f.sub_ref) if exact else F.col("sub_ref").startswith(f.sub_ref)
    return cond


def keyword_hits(decisions: DataFrame, spec: SearchSpec, any_case: bool = False) -> DataFrame:
    """(source_id, case_type) of the rulings with all keywords and none of the excluded ones. Case matters, unless any_case.

    The conditions are plain substring tests, which reach the scan; only ids leave it.
    """
    text = F.lower("clean_text") if any_case else F.col("clean_text")
    low = (lambda k: k.lower()) if any_case else (lambda k: k)
    has = reduce(lambda a, b: a & b, [text.contains(low(k)) for k in spec.keywords])
    for k in spec.exclude_keywords:
        has &= ~text.contains(low(k))
    if spec.case_types:
        has &= F.col("case_type").isin(*spec.case_types)
    return decisions.where(has & F.col("id").isNotNull()).select(F.col("id").alias("source_id"), "case_type").distinct()


def with_statutes(hits: DataFrame, mentions: DataFrame, spec: SearchSpec, exact: bool = False) -> DataFrame:
    """The sources (source_id) that mention all wanted statutes and none of the excluded; mentions: (source_id, law, article_raw, sub_ref)."""
    for filters, how in ((spec.statutes, "left_semi"), (spec.exclude_statutes, "left_anti")):
        for f in filters:
            hits = hits.join(mentions.where(statute_condition(f, exact)).select("source_id").distinct(), "source_id", how)
    return hits


def cited_mentions(citations: DataFrame, statutes: DataFrame) -> DataFrame:
    """What sources mention in the passages that they cite."""
    edges = citations.select(F.col("id").alias("citation_id"), "source_id")
    return edges.join(statutes.select("citation_id", "law", "article_raw", "sub_ref"), "citation_id").select("source_id", "law", "article_raw", "sub_ref")


def recalled(decisions: DataFrame, citations: DataFrame, statutes: DataFrame, spec: SearchSpec, exact: bool = False, own: DataFrame | None = None, any_case: bool = False) -> DataFrame:
    """(source_id) of the sources that meet the spec.

    own: (decision_id, law, article_raw, sub_ref), the statutes of the rulings' own texts, if they were extracted; without
    them, statutes are those of what a source cites.
    """
    hits = keyword_hits(decisions, spec, any_case).select("source_id")
    mentions = own.withColumnRenamed("decision_id", "source_id") if own is not None else cited_mentions(citations, statutes)
    return with_statutes(hits, mentions, spec, exact)
