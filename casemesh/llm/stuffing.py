"""Pages made of repeated keywords, links or tags instead of sentences.

Method: corpus counts of words and of neighbouring words. From them every pair of neighbours has its pointwise mutual
information and its repetition, the mean number of times that a page which has the pair repeats it. Stretches of text whose
pairs hardly belong together (word salad) or are strong collocations that pages repeat excessively are stuffing; a page of
which more than half the characters are stuffing is flagged.

A word is a run of letters, a run of digits, or any other sign but white space; so a CJK sign is a word. Every pair of the
corpus has exact counts, by 64-bit hashes. They are added up by task, then by shuffle. The most frequent pairs, up to a fixed
number, are broadcast to where the texts are read; the others, none of which is frequent, are joined with the pages that have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemesh.llm.hashing import mixed
from casemesh.operators.durable import cut

#: Most frequent pairs that are broadcast, at most: 32 MB as a table of twice as many slots of 16 bytes.
FREQUENT = 1 << 20
#: Words to either side over which pairs are averaged.
AROUND = 20
#: A stretch is stuffing from this mean of a pair's log repetition plus COLLOCATION times its information; salad below this mean information.
REPEATED, COLLOCATION, SALAD = 1.565, 0.1, 0.0
#: Part of a page's signs that must be stuffing.
PART = 0.5
#: Characters that are worked on at a time.
PIECE = 1 << 19
#: Distinct words or pairs that a task adds up before it gives them off.
HELD = 1 << 21


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, hash, length) of the words of texts, in order."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    page = np.repeat(np.arange(len(low)), [len(t) for t in low])
    digit = (codes >= 48) & (codes <= 57)
    letter = ((codes >= 97) & (codes <= 122)) | ((codes >= 0xC0) & (codes < 0x250)) | ((codes >= 0x370) & (codes < 0x530))
    white = (codes <= 32) | (codes == 0x85) | (codes == 0xA0) | (codes == 0x3000) | ((codes >= 0x2000) & (codes <= 0x200B)) | (codes == 0x2028) | (codes == 0x2029)
    kind = np.where(white, 0, np.where(letter, 1, np.where(digit, 2, 3))).astype(np.int8)
    start = np.ones(len(codes), dtype=bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3) | (page[1:] != page[:-1])
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    size = np.diff(np.append(at, len(codes)))
    inside = (np.arange(len(codes)) - np.repeat(at, size)).astype(np.uint64)
    h = np.add.reduceat(mixed(codes.astype(np.uint64) + (inside << np.uint64(32)) + np.uint64(1)), at)
    real = kind[at] != 0
    return page[at][real], h[real], size[real]


def neighbours(page: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of pairs of neighbouring words (never 0), and which of them lie within one page."""
    pair = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    pair[pair == 0] = 1
    return pair, page[:-1] == page[1:]


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of up to PIECE characters together, and the row of the first. Single texts stay whole."""
    held: list[str] = []
    first = n = 0
    for i, t in enumerate(column.to_pylist()):
        held.append(t or "")
        n += len(held[-1])
        if n >= PIECE:
            yield first, held
            held, first, n = [], i + 1, 0
    if held:
        yield first, held


class _Sums:
    """Numbers added up by hash, a bounded number of hashes at a time. Columns that aren't added are the same in all rows of a hash."""

    def __init__(self, fixed: int) -> None:
        self.fixed, self.held, self.n = fixed, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[list[np.ndarray]]:
        self.held.append(list(columns))
        self.n += len(columns[0])
        if self.n >= 2 * HELD:
            self._merge()
            if self.n >= HELD:
                yield from self.rest()

    def _merge(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        key = columns[0][order]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else np.empty(0, np.int64)
        kept = [c[order][first] for c in columns[: self.fixed]]
        self.held = [kept + [np.add.reduceat(c[order], first) if len(first) else c for c in columns[self.fixed :]]]
        self.n = len(first)

    def rest(self) -> Iterator[list[np.ndarray]]:
        if self.held:
            self._merge()
            if self.n:
                yield self.held[0]
            self.held, self.n = [], 0


_COUNTS = "pairs boolean, h long, w1 long, w2 long, n long, pages long"


def _rows(pairs: bool, c: list[np.ndarray]) -> pa.RecordBatch:
    h, w1, w2, n, pages = c if pairs else (c[0], np.zeros(len(c[0]), np.uint64), np.zeros(len(c[0]), np.uint64), c[1], np.zeros(len(c[0]), np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(h), pairs)), *[pa.array(x.view(np.int64)) for x in (h, w1, w2)], pa.array(n), pa.array(pages)], names=["pairs", "h", "w1", "w2", "n", "pages"]
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a split to its counts: of words; of pairs, and of the pages that have them."""
    of_words, of_pairs = _Sums(1), _Sums(3)
    for batch in batches:
        for _, texts in _texts(batch.column(0)):
            page, h, _ = words(texts)
            if not len(h):
                continue
            u, c = np.unique(h, return_counts=True)
            for x in of_words.add(u, c):
                yield _rows(False, x)
            pair, same = neighbours(page, h)
            at = np.flatnonzero(same)
            at = at[np.argsort(pair[at], kind="stable")]  # pages stay in order within a pair
            if not len(at):
                continue
            key, own = pair[at], page[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            new_page = new.copy()
            new_page[1:] |= own[1:] != own[:-1]
            first = np.flatnonzero(new)
            for x in of_pairs.add(key[first], h[at[first]], h[at[first] + 1], np.diff(np.append(first, len(at))), np.add.reduceat(new_page.astype(np.int64), first)):
                yield _rows(True, x)
    for x in of_words.rest():
        yield _rows(False, x)
    for x in of_pairs.rest():
        yield _rows(True, x)


def pair_values(documents: DataFrame) -> DataFrame:
    """(h, n, pages, information, repeated) of every pair of neighbouring words; repeated is the log of its mean number in the pages that have it.

    Every delivered row counts, null texts have no words.
    """
    counted = documents.where("text is not null").select("text").mapInArrow(_count, _COUNTS)
    first = [F.min(c).alias(c) for c in ("w1", "w2")]
    summed = cut(counted.groupBy("pairs", "h").agg(*first, F.sum("n").alias("n"), F.sum("pages").alias("pages")))
    totals = {r["pairs"]: float(r["n"]) for r in summed.groupBy("pairs").agg(F.sum("n").alias("n")).collect()}
    single = summed.where("not pairs").select("h", F.ln("n").alias("log_n"))
    of = lambda w: single.select(F.col("h").alias(w), F.col("log_n").alias(f"log_{w}"))
    pairs = summed.where("pairs").join(of("w1"), "w1").join(of("w2"), "w2")
    scale = 2 * np.log(totals.get(False) or 1.0) - np.log(totals.get(True) or 1.0)
    info = F.ln("n") + F.lit(float(scale)) - F.col("log_w1") - F.col("log_w2")
    return pairs.select("h", "n", "pages", info.cast("float").alias("information"), F.ln(F.col("n") / F.col("pages")).cast("float").alias("repeated"))


def least_frequent(values: DataFrame, most: int) -> int:
    """The least n such that at most so many pairs have n or more; counted by a histogram of a few hundred classes."""
    steps = F.floor(F.log2("n") * 8).cast("int")
    histogram = sorted(((r["step"], r["low"], r["pairs"]) for r in values.groupBy(steps.alias("step")).agg(F.min("n").alias("low"), F.count(F.lit(1)).alias("pairs")).collect()), reverse=True)
    least, total = None, 0
    for _, low, pairs in histogram:
        total += pairs
        if total > most:
            break
        least = low
    return least if least is not None else (histogram[0][1] + (1 << 62) if histogram else 1)


class Table:
    """Values of pairs by hash: two numbers each, in slots that are searched one after another."""

    def __init__(self, h: np.ndarray, information: np.ndarray, repeated: np.ndarray) -> None:
        self.mask = np.uint64((1 << max(1, (2 * len(h)).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, dtype=np.uint64)
        self.values = np.zeros((int(self.mask) + 1, 2), dtype=np.float32)
        rows, slot = np.arange(len(h)), h & self.mask
        while len(rows):
            free = self.keys[slot] == 0
            _, one = np.unique(slot[free], return_index=True)  # of several for a slot one gets it
            got = np.flatnonzero(free)[one]
            self.keys[slot[got]] = h[rows[got]]
            self.values[slot[got], 0] = information[rows[got]]
            self.values[slot[got], 1] = repeated[rows[got]]
            left = np.ones(len(rows), dtype=bool)
            left[got] = False
            rows, slot = rows[left], (slot[left] + np.uint64(1)) & self.mask

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, whether the hash is there)."""
        slot = h & self.mask
        seen = self.keys[slot]
        rest = np.flatnonzero((seen != h) & (seen != 0))
        while len(rest):
            slot[rest] = (slot[rest] + np.uint64(1)) & self.mask
            seen = self.keys[slot[rest]]
            rest = rest[(seen != h[rest]) & (seen != 0)]
        return slot, self.keys[slot] == h


def stuffed_parts(texts: list[str], frequent: Table, rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """(part of the signs that are stuffing, mean information, mean log repetition) of each text. rare: by text, the pairs that aren't frequent, sorted."""
    out = np.zeros((len(texts), 3))
    page, h, size = words(texts)
    if len(h) < 2:
        return out
    pair, same = neighbours(page, h)
    slot, there = frequent.find(pair)
    info, again = (frequent.values[slot, i].astype(np.float64) for i in (0, 1))
    if rare is not None:
        for at in np.split(np.flatnonzero(~there & same), np.flatnonzero(np.diff(page[:-1][~there & same])) + 1):
            if len(at):
                keys, i, r = rare[page[at[0]]]
                where = np.searchsorted(keys, pair[at])
                info[at], again[at] = i[where], r[where]
    ones = same.astype(np.int64)
    sums = [np.concatenate([[0], np.cumsum(np.where(same, x, 0))]) for x in (info, again, ones)]
    # pairs i - AROUND .. i + AROUND around word i, within its page
    first = np.searchsorted(page, page, side="left")
    last = np.searchsorted(page, page, side="right") - 1
    at = np.arange(len(h))
    low, high = np.maximum(at - AROUND, first), np.minimum(at + AROUND, last)
    n = sums[2][high] - sums[2][low]
    mean = [(s[high] - s[low]) / np.maximum(n, 1) for s in sums[:2]]
    bad = (n > 0) & ((mean[1] + COLLOCATION * mean[0] > REPEATED) | (mean[0] < SALAD))
    signs = np.bincount(page, weights=size, minlength=len(texts))
    out[:, 0] = np.bincount(page, weights=size * bad, minlength=len(texts)) / np.maximum(signs, 1)
    pairs = np.bincount(page[:-1], weights=ones, minlength=len(texts))
    for k, x in ((1, info), (2, again)):
        out[:, k] = np.bincount(page[:-1], weights=np.where(same, x, 0), minlength=len(texts)) / np.maximum(pairs, 1)
    return out


def _rare_rows(batches: Iterator[pa.RecordBatch], frequent: Table) -> Iterator[pa.RecordBatch]:
    """(doc_id, copy, text) to the distinct pairs (h) of each page that aren't frequent."""
    for batch in batches:
        for first, texts in _texts(batch.column(2)):
            page, h, _ = words(texts)
            if len(h) < 2:
                continue
            pair, same = neighbours(page, h)
            at = np.flatnonzero(same)
            at = at[~frequent.find(pair[at])[1]]
            order = np.lexsort((pair[at], page[at]))
            key, own = pair[at][order], page[at][order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
            rows = pa.array(own[new] + first)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(key[new].view(np.int64))], names=["doc_id", "copy", "h"])


def stuffing(documents: DataFrame, most: int = FREQUENT) -> DataFrame:
    """(doc_id, stuffed, information, repetition): the part of each page that is stuffing, and the means over all its pairs.

    Pages without id are counted but not reported, copies of a row are reported once, of different rows with one id the
    largest values; pages of fewer than two words have 0. most: pairs that are broadcast at most; the result doesn't depend on it.
    """
    values = cut(pair_values(documents))
    least = least_frequent(values, most)
    t = values.where(F.col("n") >= least).select("h", "information", "repeated").toArrow()  # at most so many rows
    frequent = Table(t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy(), t.column(2).to_numpy())
    held = documents.sparkSession.sparkContext.broadcast(frequent)
    pages = documents.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("copy"), "text")
    rare = values.where(F.col("n") < least).select("h", "information", "repeated")
    some_rare = bool(rare.take(1))
    if some_rare:
        pages = pages.dropDuplicates(["doc_id", "copy"])
        of_page = pages.mapInArrow(lambda b: _rare_rows(b, held.value), "doc_id long, copy long, h long").join(rare, "h")
        lists = of_page.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list(F.struct("h", "information", "repeated"))).alias("rare"))
        pages = pages.join(lists, ["doc_id", "copy"], "left").select("doc_id", "text", "rare.h", "rare.information", "rare.repeated")
    else:
        pages = pages.select("doc_id", "text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.empty(0, np.uint64), np.empty(0, np.float32), np.empty(0, np.float32))
        for batch in batches:
            parts = []
            for first, texts in _texts(batch.column(1)):
                own = None
                if some_rare:
                    own = []
                    for i in range(first, first + len(texts)):
                        h, info, again = (batch.column(c)[i].values for c in (2, 3, 4))
                        if h is None:
                            own.append(none)
                            continue
                        keys = h.to_numpy().view(np.uint64)
                        order = np.argsort(keys)
                        own.append((keys[order], info.to_numpy()[order], again.to_numpy()[order]))
                parts.append(stuffed_parts(texts, held.value, own))
            x = np.concatenate(parts) if parts else np.empty((0, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, k]) for k in range(3)]], names=["doc_id", "stuffed", "information", "repetition"])

    rated = pages.mapInArrow(rate, "doc_id long, stuffed double, information double, repetition double")
    return rated.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("stuffed", "information", "repetition")])


def stuffed_pages(documents: DataFrame, part: float = PART) -> DataFrame:
    """The pages of which more than that part is stuffing."""
    return stuffing(documents).where(F.col("stuffed") > part)
