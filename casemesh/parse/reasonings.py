"""A court's whole reasoning in chunks, cut at its major items."""

from __future__ import annotations

import re

from casemesh.parse.chunks import REASONS, footer_start

# Words that begin the court's own reasoning, signs of major items, sizes.
ANALYSIS = re.compile("得心證之理由|得心證的理由|本院之判斷|本院的判斷|本院判斷|惟查|經查")
MAJOR = re.compile(r"(?:^|\n)[ \t　]*(?=(?:[一二三四五六七八九十百]+|[壹貳參肆伍陸柒捌玖拾]+)、)")
LIMIT, FULL_ENOUGH, LEAST, LEAST_TEXT = 2000, 0.6, 150, 500


def reasoning_start(text: str) -> int:
    """The line in which the court's own reasoning begins, else the end of the reasons' heading, else 0."""
    if m := ANALYSIS.search(text):
        return text.rfind("\n", 0, m.start()) + 1
    m = REASONS.search(text)
    return m.end() if m else 0


def _sentences(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Parts within the limit, cut after the last sentence end in reach, else at the limit."""
    out = []
    while end - start > LIMIT:
        stop = text.rfind("。", start + 1, start + LIMIT)
        cut = stop + 1 if stop > start else start + LIMIT
        out.append((start, cut))
        start = cut
    return [*out, (start, end)] if start < end else out


def reasoning_chunks(text: str | None) -> list[tuple[int, int, int]]:
    """(number, start, end) of the chunks of a text; numbers count the short ones, which are left out.

    A chunk is closed at a major item once it is fuller than FULL_ENOUGH of the limit.
    """
    if not text or len(text) <= LEAST_TEXT:
        return []
    start = reasoning_start(text)
    footer = footer_start(text)
    end = footer if footer and footer > start else len(text)
    end = start + len(text[start:end].rstrip())
    parts: list[tuple[int, int]] = []
    at = start
    if end - start > LIMIT:
        for item in (start + m.end() for m in MAJOR.finditer(text[start:end])):
            size = item - at
            if size > LIMIT:
                parts += _sentences(text, at, item)
            elif size > LIMIT * FULL_ENOUGH:
                parts.append((at, item))
            else:
                continue
            at = item
    parts += _sentences(text, at, end)
    return [(i, a, b) for i, (a, b) in enumerate(parts) if len(text[a:b].strip()) >= LEAST]
