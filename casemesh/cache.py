"""Kept results of searches: a few, for a while, the least recently used dropped first."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from casemesh.operators.recall import SearchSpec

TTL, ENTRIES = 600.0, 20


def signature(spec: SearchSpec) -> str:
    """A search by what it asks for; order, filters and pages are no part of it."""
    return hashlib.md5(json.dumps(asdict(spec), ensure_ascii=False, sort_keys=True).encode()).hexdigest()


@dataclass
class Entry:
    """A search's sources, its rankings, the rankings in other orders, totals by filter, and what to do when it is dropped."""

    sources: DataFrame
    rankings: DataFrame | None
    until: float
    orders: dict[str, DataFrame] = field(default_factory=dict)
    totals: dict[object, int] = field(default_factory=dict)
    on_drop: list[Callable[[], None]] = field(default_factory=list)

    def drop(self) -> None:
        for df in (self.sources, self.rankings, *self.orders.values()):
            if df is not None:
                df.unpersist()
        for f in self.on_drop:
            f()


class SearchCache:
    """Reading an entry makes it the latest used but doesn't lengthen its time; new rankings do."""

    def __init__(self, ttl: float = TTL, entries: int = ENTRIES, clock: Callable[[], float] = time.monotonic) -> None:
        self._ttl, self._most, self._clock = ttl, entries, clock
        self._held: OrderedDict[str, Entry] = OrderedDict()

    def __len__(self) -> int:
        return len(self._held)

    def _prune(self) -> None:
        now = self._clock()
        for key in [k for k, e in self._held.items() if e.until <= now]:
            self._held.pop(key).drop()
        while len(self._held) > self._most:
            self._held.popitem(last=False)[1].drop()

    def put(self, key: str, sources: DataFrame, rankings: DataFrame | None = None, on_drop: Callable[[], None] | None = None) -> Entry:
        if key in self._held:
            self._held.pop(key).drop()
        entry = self._held[key] = Entry(sources.persist(), rankings.persist() if rankings is not None else None, self._clock() + self._ttl)
        entry.on_drop += [on_drop] if on_drop else []
        self._prune()
        return entry

    def get(self, key: str) -> Entry | None:
        self._prune()
        if key in self._held:
            self._held.move_to_end(key)
        return self._held.get(key)

    def update(self, key: str, rankings: DataFrame) -> None:
        """New rankings of an entry; orders and totals that were kept are made again when they are asked for."""
        if entry := self.get(key):
            for df in (entry.rankings, *entry.orders.values()):
                if df is not None:
                    df.unpersist()
            entry.rankings, entry.until = rankings.persist(), self._clock() + self._ttl
            entry.orders.clear()
            entry.totals.clear()

    def order(self, key: str, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        """The rankings in another order, kept once made."""
        entry = self.get(key)
        if entry is None or entry.rankings is None:
            return None
        if name not in entry.orders:
            entry.orders[name] = make(entry.rankings).persist()
        return entry.orders[name]

    def clear(self) -> None:
        while self._held:
            self._held.popitem()[1].drop()
