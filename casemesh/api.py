"""The engine's methods for a service: searches, their further pages, citations of a target, single records."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.cache import Entry, SearchCache, signature
from casemesh.operators import graph, phrase_index, preview, ranking, recall, semantic, windows
from casemesh.operators.durable import Tables
from casemesh.operators.recall import SearchSpec
from casemesh.parse import marks, statutes
from casemesh.sources.tables import load


class NotThere(LookupError):
    """No record with that id."""


@dataclass(frozen=True)
class Page:
    rows: list[dict]
    total: int
    source_count: int
    cache_key: str


def ids_of(text: str | None, most: int | None = None) -> tuple[int, ...]:
    """Ids of a comma-separated list, each once; anything else in it is a ValueError."""
    ids = tuple(dict.fromkeys(int(x) for x in (text or "").split(",") if x.strip()))
    return ids[:most] if most else ids


#: Fixed value: what stands where a prompt has nothing to list.
NOT_GIVEN = "（未指定）"


def bullets(lines) -> str:
    return "\n".join(f"- {x}" for x in lines) if lines else NOT_GIVEN


class CitationEngine:
    """Over a folder of tables. Only single pages of results leave Spark.

    windows_path: the written pair table (ingest.write_windows). index_path: the index of the texts (phrase_index.build).
    statutes_path: the statutes of the rulings' own texts (decision_id, law, article_raw, sub_ref); with it, statute filters
    look there instead of in what a ruling cites.
    """

    def __init__(self, spark: SparkSession, folder: str, windows_path: str | None = None, cache: SearchCache | None = None, index_path: str | None = None, statutes_path: str | None = None) -> None:
        self.spark, self.folder, self.cache = spark, folder, SearchCache() if cache is None else cache
        self._windows_path, self._index_path, self._statutes_path = windows_path, index_path, statutes_path

    def _thin(self, name: str, *columns: str) -> DataFrame:
        return load(self.spark, self.folder, name).select("id", *columns).where("id is not null").distinct()

    @property
    def _edges(self) -> DataFrame:
        return self._thin("citations", "source_id", "target_id", "target_canonical_id", "target_authority_id", "snippet")

    @property
    def _records(self) -> DataFrame:
        return self._thin("decisions", "canonical_id", "canonical_doc_type", "doc_type", "display_title", "root_norm", "total_citation_count")

    @property
    def _statutes(self) -> DataFrame:
        return load(self.spark, self.folder, "citation_snippet_statutes").distinct()

    def windows(self, sources: DataFrame) -> DataFrame:
        """The pair table: read, if it was written, else made of these sources' edges."""
        if self._windows_path:
            return self.spark.read.parquet(self._windows_path)
        return windows.windows(self._edges.join(sources, "source_id", "left_semi"), self._records, self._statutes)

    def _recalled(self, spec: SearchSpec) -> DataFrame:
        if self._index_path:
            hits = phrase_index.hits(self.spark, self._index_path, spec).select("source_id")
        else:
            hits = recall.keyword_hits(load(self.spark, self.folder, "decisions"), spec).select("source_id")
        if not spec.statutes and not spec.exclude_statutes:
            return hits
        if self._statutes_path:
            mentions = self.spark.read.parquet(self._statutes_path).withColumnRenamed("decision_id", "source_id")
        else:
            mentions = recall.cited_mentions(load(self.spark, self.folder, "citations").select("id", "source_id").distinct(), self._statutes)
        return recall.with_statutes(hits, mentions, spec)

    def _found(self, spec: SearchSpec) -> tuple[str, Entry]:
        """The kept search, made where it isn't there. What is kept is written; what was only needed to make it is removed."""
        spec = recall.checked(spec)
        key = signature(spec)
        entry = self.cache.get(key)
        if entry is None or entry.rankings is None:
            kept = Tables()
            with Tables():
                sources = kept.cut(self._recalled(spec))
                pairs = ranking.matched_pairs(self.windows(sources), sources, spec)
                uid = windows.with_target_uid(self._edges.drop("snippet"), self._records)
                authorities = load(self.spark, self.folder, "authorities")
                rows = ranking.ranked_targets(ranking.step_down(pairs, spec), uid, sources, self._records, authorities)
                entry = self.cache.put(key, sources, kept.cut(rows.orderBy(*ranking.order_by("relevance"))), kept.release)
        return key, entry

    def search(self, spec: SearchSpec, order: str = "relevance", page: int = 1, size: int = 20, doc_types: tuple[str, ...] = (), court_levels: tuple[int, ...] = ()) -> Page:
        """A page of targets. The same spec with another order, filter or page uses what was kept."""
        key, entry = self._found(spec)
        rows = self.cache.order(key, order, lambda r: r.orderBy(*ranking.order_by(order)))
        shown = ranking.page(ranking.filtered(rows, doc_types, court_levels), order, page, size)
        for of, df in (("sources", entry.sources), ((doc_types, court_levels), None)):
            if of not in entry.totals:
                entry.totals[of] = (df if df is not None else ranking.filtered(rows, doc_types, court_levels)).count()
        return Page([r.asDict(recursive=True) for r in shown.collect()], entry.totals[doc_types, court_levels], entry.totals["sources"], key)

    rerank = search

    def citations(self, spec: SearchSpec, target_id: int, source_ids: str = "", authority: bool = False) -> dict:
        """Counts, the best citations of up to five given sources, and the first ones of sources outside the search."""
        sources = self._found(spec)[1].sources
        of_one = preview.of_target(self._edges, target_id, authority).select("id", "source_id", "snippet")
        table = load(self.spark, self.folder, "authorities" if authority else "decisions")
        row = table.where(F.col("id") == target_id).agg(F.count(F.lit(1)).alias("n"), F.max("total_citation_count").alias("total")).first()
        if not row["n"]:
            raise NotThere(target_id)
        best = preview.matched(preview.scored(of_one, self._statutes, spec), ids_of(source_ids, preview.SHOWN))
        count = preview.counts(of_one, sources, row["total"] or 0).first().asDict()
        others = preview.others(of_one, sources).join(of_one.select("id", "snippet"), "id")
        return count | {"matched_rows": self._shown(best), "other_rows": self._shown(others)}

    def citations_more(self, spec: SearchSpec, target_id: int, loaded: str = "", limit: int = 20, authority: bool = False) -> list[dict]:
        sources = self._found(spec)[1].sources
        of_one = preview.of_target(self._edges, target_id, authority).select("id", "source_id", "snippet")
        return self._shown(preview.more(preview.scored(of_one, self._statutes, spec), sources, ids_of(loaded), limit))

    def _shown(self, few: DataFrame) -> list[dict]:
        d = self._thin("decisions", "unit_norm", "display_title", "decision_date", "doc_type", "court_unit_id")
        out = preview.hydrated(few, d, load(self.spark, self.folder, "court_units"), self._statutes)
        return [r.asDict() for r in out.orderBy("id").collect()]

    def decision(self, decision_id: int) -> dict:
        """A ruling with its text."""
        rows = graph.records(load(self.spark, self.folder, "decisions").where(F.col("id") == decision_id)).collect()
        if not rows:
            raise NotThere(decision_id)
        return rows[0].asDict()

    def laws(self, prefix: str = "", names: tuple[str, ...] = ()) -> list[str]:
        return statutes.suggestions(prefix, names or statutes.laws().full)

    def passages(self, query: str, embed: Callable[[list[str]], list[list[float]]], best: int = 10) -> list[dict]:
        """The rulings whose chunks are most similar to a text, with what they and their targets are. The text's vector gets length one."""
        v = np.asarray(embed([query])[0], dtype=np.float64)
        length = float(np.linalg.norm(v))
        chunks = self._thin("chunks", "decision_id", "target_id", "target_authority_id", "embedding")
        near = semantic.by_decision(semantic.nearest_chunks(chunks, (v / (length or 1.0)).tolist()), best)
        records = self._thin("decisions", "root_norm", "display_title").select(F.col("id").alias("decision_id"), "root_norm", "display_title")
        rows = [r.asDict() for r in near.join(records, "decision_id").collect()]
        rows.sort(key=lambda r: (-round(r["score"], 6), r["decision_id"]))
        wanted = {t for r in rows for t in r["targets"]}
        kinds = {"decision": ("decisions", ("root_norm", "display_title")), "authority": ("authorities", ("root_norm", "display"))}
        titles = {}
        for kind, (table, columns) in kinds.items():
            ids = [int(t.split(":")[1]) for t in wanted if t.startswith(kind)]
            if ids:
                titles |= {f"{kind}:{r[0]}": (r[1], r[2]) for r in self._thin(table, *columns).where(F.col("id").isin(*ids)).collect()}
        for r in rows:  # targets that aren't there any more are left out
            r["targets"] = [{"uid": t, "root_norm": titles[t][0] or "", "display_title": titles[t][1] or ""} for t in r["targets"] if t in titles]
        texts = {r["id"]: r["chunk_text"] for r in self._thin("chunks", "chunk_text").where(F.col("id").isin([r["chunk_id"] for r in rows])).collect()}
        return [r | {"chunk_text": texts.get(r["chunk_id"]) or ""} for r in rows]

    def analyze(self, text: str, ask: Callable[[str], str]) -> dict:
        """The issues and statutes that a given model finds in a case: {"issues": [...], "statutes": [{"law", "article"}, ...]}.

        Its answer must be a JSON object; laws get their full names, and what isn't of that form is left out.
        """
        answer = json.loads(ask(text))
        if not isinstance(answer, dict):
            raise ValueError("the answer is no JSON object")
        issues = [x for x in answer.get("issues") or () if isinstance(x, str) and x.strip()]
        found = [x for x in answer.get("statutes") or () if isinstance(x, dict) and x.get("law")]
        return {"issues": issues, "statutes": [{"law": statutes.law_name(str(x["law"])), "article": str(x.get("article") or "")} for x in found]}

    @staticmethod
    def prompt(query: str, passages: list[dict], issues: tuple[str, ...] = (), laws: tuple[dict, ...] = ()) -> str:
        """The case, its issues and statutes as bullets, and the numbered passages with their source and targets."""
        blocks = []
        for i, p in enumerate(passages, 1):
            targets = "".join(f"\n  - {t['root_norm']} {t['display_title']}, id={t['uid'].split(':')[1]}" for t in p["targets"])
            head = f"[source: {p['root_norm'] or ''} {p['display_title'] or ''}, decision_id={p['decision_id']}]" + (f"\n[targets:{targets}\n]" if targets else "")
            blocks.append(f"### {i}\n{head}\n{p['chunk_text']}")
        named = [f"{x['law']} 第{x['article']}條" for x in laws]
        return "\n\n".join([query, bullets(issues), bullets(named), *blocks])

    def rag(self, query: str, embed: Callable, write: Callable[[str], str], best: int = 10, issues: tuple[str, ...] = (), laws: tuple[dict, ...] = ()) -> dict:
        """An answer by a given writer from the passages, with its tags."""
        found = self.passages(query, embed, best)
        answer = write(self.prompt(query, found, issues, laws))
        return {"passages": found, "answer": answer, "tags": marks.answer_tags(answer)}
