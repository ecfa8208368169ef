"""Marks in shown texts: highlights of a search, and tags of a written answer."""

from __future__ import annotations

import re

# The tags of a written answer.
TAG = re.compile(
    r'<h3>(?P<heading>.*?)</h3>|<cite\s+type="(?P<type>source|target|supreme)"\s+id="(?P<id>\d+)">(?P<label>.*?)</cite>'
    r'|<statute\s+law="(?P<law>[^"]+)"\s+article="(?P<article>[^"]+)">(?P<text>.*?)</statute>'
)


def highlights(text: str | None, keywords: list[str], statutes: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, 'keyword' or 'statute') of the terms in a text, whatever their case; keywords win, spans don't overlap."""
    groups = [f"(?P<{name}>{'|'.join(map(re.escape, terms))})" for name, terms in (("keyword", [k for k in keywords if k]), ("statute", [s for s in statutes if s])) if terms]
    if not text or not groups:
        return []
    return [(m.start(), m.end(), m.lastgroup) for m in re.finditer("|".join(groups), text, re.I) if m.end() > m.start()]


def answer_tags(text: str | None) -> list[tuple[str, str | None, str | None, str]]:
    """(kind, type or law, id or article, label) of the tags in an answer, in order."""
    out = []
    for m in TAG.finditer(text or ""):
        if m["heading"] is not None:
            out.append(("heading", None, None, m["heading"]))
        elif m["type"]:
            out.append(("cite", m["type"], m["id"], m["label"]))
        else:
            out.append(("statute", m["law"], m["article"], m["text"]))
    return out
