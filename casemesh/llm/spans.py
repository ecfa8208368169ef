"""Long spans that stand word for word in more than one record.

Method: long lines (paragraphs) are normalised and hashed, and their digests grouped globally. Of the copies of a line the
first record's (by id) is kept; the others can be removed, with their offsets in the original text. A shared span may also
begin and end within lines; what whole lines can't find is found by windows of the least length (120 characters): of the
shorter grams in a window the smallest hash is its anchor, equal windows have equal anchors, anchors are grouped globally, and
only windows whose anchor stands in two records are hashed and grouped again, by 128 bits. Of a line that stands in many
records, only two copies (of different sources) have windows; the others belong to the line's class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from casemesh.functions.plain import ASCII_SIGNS, FULL_WIDTH, WHITE
from casemesh.llm.hashing import mixed
from casemesh.llm.joins import marked
from casemesh.operators.durable import cut

#: Characters of a shared span, at least; of the grams that anchors are taken from.
SPAN, GRAM = 120, 80
#: Bytes up to which lists by record are broadcast, at so many a record; above, the texts are shuffled by id.
BROADCAST_BYTES, RECORD_BYTES = 16 << 20, 120
#: Characters that are hashed at a time.
PIECE = 1 << 20

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, list[np.ndarray]] = {}
_PLAIN = str.maketrans(FULL_WIDTH, ASCII_SIGNS, WHITE)


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64."""
    held = _POWERS.setdefault(base, [])
    if not held or len(held[0]) < n:
        size = max(n, 1 << 16)
        held.clear()
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            held.append(np.multiply.accumulate(p))
    return held[0][:n], held[1][:n]


def _hashes(text: str, *lengths: int, base: int = _BASES[0]) -> list[np.ndarray]:
    """A 64-bit hash of every gram of each of the lengths."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    power, inverse = _powers(n, base)
    codes += np.uint64(77)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.add.accumulate(mixed(codes) * power, out=sums[1:])
    return [mixed((sums[k:] - sums[:-k]) * inverse[: n - k + 1]) if n >= k else np.empty(0, np.uint64) for k in lengths]


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of width numbers."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(text: str, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """The anchor of every window of the text."""
    if len(text) < span:
        return np.empty(0, dtype=np.uint64)
    return _smallest(_hashes(text, gram)[0], span - gram + 1)


def _pieces(texts: list[str], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """Joins texts up to PIECE characters: row and start of each, and the joined text. Long texts come in overlapping pieces."""
    rows: list[int] = []
    starts: list[int] = []
    parts: list[str] = []
    n = 0
    for i, t in enumerate(texts):
        if t is None or len(t) < span:
            continue
        for s in range(0, len(t) - span + 1, PIECE):
            part = t[s : s + PIECE + span - 1]
            rows.append(i)
            starts.append(s)
            parts.append(part)
            n += len(part)
            if n >= PIECE:
                yield np.array(rows), np.array(starts), parts
                rows, starts, parts, n = [], [], [], 0
    if parts:
        yield np.array(rows), np.array(starts), parts


def _windows(texts: list[str], span: int, gram: int, with_span: bool):
    """Per window of the texts: row, offset, anchor and, if wanted, two hashes."""
    for rows, starts, parts in _pieces(texts, span):
        sizes = np.array([len(p) for p in parts])
        whole = "".join(parts)
        h = _hashes(whole, gram, span) if with_span else _hashes(whole, gram)
        anchor = _smallest(h[0], span - gram + 1)
        begin = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(parts)), sizes)[: len(anchor)]
        inside = np.arange(len(anchor)) - begin[part]
        ok = inside <= sizes[part] - span
        part, inside = part[ok], inside[ok]
        other = _hashes(whole, span, base=_BASES[1])[0][ok] if with_span else None
        yield rows[part], starts[part] + inside, anchor[ok], h[1][ok] if with_span else None, other


# --- whole lines -----------------------------------------------------------------------------------------------------


def line_digests(text: str, least: int = SPAN) -> list[tuple[int, int, int, int, int]]:
    """(start, end, two halves of the normalised line's digest, half of the line's own) of the lines of at least so many characters.

    Lines are equal without white space and with full-width signs as ASCII, as elsewhere.
    """
    out = []
    for m in _LINE_TEXT.finditer(text):
        line = m[0]
        if len(line) < least:
            continue
        own = blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        both = blake2b(line.translate(_PLAIN).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        out.append((m.start(), m.end(), *(int.from_bytes(x, "little", signed=True) for x in (both[:8], both[8:], own))))
    return out


_LINE_TEXT = re.compile(r"[^\r\n]+")
_LINE = "record_table string, id long, ent long, start int, end int, n1 long, n2 long, own long"


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for i, t in enumerate(batch.column(3).to_pylist()):
            lines = line_digests(t)
            rows += [i] * len(lines)
            found += lines
        at = pa.array(rows, type=pa.int64())
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k).take(at) for k in range(3)), *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))],
            names=["record_table", "id", "ent", "start", "end", "n1", "n2", "own"],
        )


def _texts(decisions: DataFrame, citations: DataFrame) -> DataFrame:
    """(record_table, id, ent, text) of the records that are long enough; records of the same ent don't count as shared."""
    d = decisions.where(F.col("id").isNotNull() & (F.length("clean_text") >= SPAN))
    c = citations.where(F.col("id").isNotNull() & (F.length("snippet") >= SPAN))
    return d.select(F.lit("decisions").alias("record_table"), "id", F.col("id").alias("ent"), F.col("clean_text").alias("text")).unionByName(
        c.select(F.lit("citations").alias("record_table"), "id", F.coalesce("source_id", -F.col("id") - 1).alias("ent"), F.col("snippet").alias("text"))
    )


def shared_lines(texts: DataFrame) -> DataFrame:
    """(record_table, id, ent, start, end, n1, n2, own, first_id, kept) of the long lines that stand in records of two ents.

    n1 and n2 name the class of the normalised line, whose first record is first_id; own the line as written. kept: of the
    lines that are written alike, the first, and the first of another ent; and all that are in fewer than two ents.
    """
    lines = cut(texts.mapInArrow(_line_rows, _LINE))
    by = ["record_table", "n1", "n2"]
    two = F.min("ent") < F.max("ent")
    rows = F.count(F.lit(1)).alias("n_rows")
    classes = cut(lines.groupBy(*by).agg(two.alias("two"), F.min("id").alias("first_id"), rows).where("two").drop("two"))
    total = lines.count()
    found = cut(marked(lines, classes, by, classes.count(), total).distinct())
    alike = [*by, "own"]
    ones = cut(found.groupBy(*alike).agg(F.min(F.struct("id", "ent")).alias("a"), rows))
    n = ones.count()
    with_first = marked(found, ones, alike, n, total)
    others = with_first.where(F.col("ent") != F.col("a.ent")).groupBy(*alike).agg(F.min("id").alias("b"))
    pairs = cut(ones.join(others, alike, "left"))
    kept = F.col("b").isNull() | (F.col("id") == F.col("a.id")) | (F.col("id") == F.col("b"))
    return cut(marked(found, pairs, alike, n, total).withColumn("kept", kept).drop("a", "b"))


# --- windows ---------------------------------------------------------------------------------------------------------


def _outside(row: np.ndarray, offset: np.ndarray, left_out: pa.Array, span: int) -> np.ndarray:
    """Which windows aren't inside one of the stretches (start, end) that are left out of their record."""
    ok = np.ones(len(row), dtype=bool)
    if left_out.null_count == len(left_out):
        return ok
    for r in np.unique(row).tolist():
        if left_out[r].is_valid:
            at = np.flatnonzero(row == r)
            for s in left_out[r].as_py():
                ok[at[(offset[at] >= s["start"]) & (offset[at] + span <= s["end"])]] = False
    return ok


def _anchor_rows(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(record_table, id, ent, text, left_out) to (record_table, id, ent, anchor), each anchor of a record once per stretch."""
    for batch in batches:
        table, ids, ents = (batch.column(i) for i in range(3))
        for row, offset, anchor, _, _ in _windows(batch.column(3).to_pylist(), span, gram, False):
            new = _outside(row, offset, batch.column(4), span)
            at = np.flatnonzero(new)
            a, r = anchor[at], row[at]
            first = np.ones(len(at), dtype=bool)
            first[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
            rows = pa.array(r[first])
            yield pa.RecordBatch.from_arrays(
                [table.take(rows), ids.take(rows), ents.take(rows), pa.array(a[first].view(np.int64))], names=["record_table", "id", "ent", "anchor"]
            )


def _window_rows(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(record_table, id, ent, text, left_out, anchors) to the windows with one of the anchors: their hashes and offset."""
    for batch in batches:
        table, ids, ents = (batch.column(i) for i in range(3))
        wanted = batch.column(5)
        flat = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = np.diff(wanted.offsets.to_numpy())
        own = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), sizes)
        keys = np.unique(mixed(flat + own * np.uint64(0x9E3779B97F4A7C15)))
        for row, offset, anchor, h, other in _windows(batch.column(3).to_pylist(), span, gram, True):
            k = mixed(anchor + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            i = np.searchsorted(keys, k)
            hit = keys[np.minimum(i, len(keys) - 1)] == k if len(keys) else np.zeros(len(k), dtype=bool)
            hit &= _outside(row, offset, batch.column(4), span)
            at = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays(
                [table.take(at), ids.take(at), ents.take(at), pa.array(h[hit].view(np.int64)), pa.array(other[hit].view(np.int64)), pa.array(offset[hit].astype(np.int64))],
                names=["record_table", "id", "ent", "h", "g", "pos"],
            )


def _with_lists(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Texts with a list by record: few lists are sent to the texts, else the texts are shuffled."""
    few = lists.count() * RECORD_BYTES <= BROADCAST_BYTES
    return texts.join(F.broadcast(lists) if few else lists, ["record_table", "id"], how)


class Shared:
    """What the records of two tables share.

    lines: see shared_lines. windows: (record_table, id, ent, h, g, pos), every window of 120 characters that also stands in a
    record of another ent, but for those inside of lines that aren't kept; h and g name the window's text by 128 bits.
    Citations of one source are one ent. Records without id or text and texts under 120 characters take no part; copies of a
    row change nothing.
    """

    def __init__(self, decisions: DataFrame, citations: DataFrame) -> None:
        self.texts = texts = _texts(decisions, citations)
        self.lines = shared_lines(texts)
        out = self.lines.where("not kept").groupBy("record_table", "id").agg(F.collect_list(F.struct("start", "end")).alias("left_out"))
        open_texts = _with_lists(texts, cut(out), "left").select("record_table", "id", "ent", "text", "left_out")
        rows = cut(open_texts.mapInArrow(lambda b: _anchor_rows(b, SPAN, GRAM), "record_table string, id long, ent long, anchor long"))
        two = F.min("ent") < F.max("ent")
        n_rows = F.count(F.lit(1)).alias("n_rows")
        shared = cut(rows.groupBy("record_table", "anchor").agg(two.alias("two"), n_rows).where("two").drop("two"))
        found = marked(rows, shared, ["record_table", "anchor"], shared.count(), rows.count())
        lists = cut(found.groupBy("record_table", "id").agg(F.collect_set("anchor").alias("anchors")))
        ids = lists.select("record_table", "id")
        if lists.count() * RECORD_BYTES <= BROADCAST_BYTES:
            open_texts = open_texts.join(F.broadcast(ids), ["record_table", "id"], "left_semi")
        again = open_texts.dropDuplicates(["record_table", "id"]).join(lists, ["record_table", "id"])
        windows = cut(
            again.select("record_table", "id", "ent", "text", "left_out", "anchors").mapInArrow(
                lambda b: _window_rows(b, SPAN, GRAM), "record_table string, id long, ent long, h long, g long, pos long"
            )
        )
        by = ["record_table", "h", "g"]
        twice = cut(windows.groupBy(*by).agg(two.alias("two"), F.min("id").alias("first_id"), n_rows).where("two").drop("two"))
        self.total = windows.count()
        self.windows = marked(windows, twice, by, twice.count(), self.total)

    def classes(self) -> DataFrame:
        """(record_table, class_id, record_id, ent): each set of records that share a span once, with its records.

        A long shared span has many windows with the same records. Of the windows with the same records and lines, known by
        their number and two sums of hashes, one is used; then the other records of its lines are added.
        """
        names = ["n1", "n2", "own"]
        more = self.lines.where("not kept").select("record_table", *names, "id", "ent")
        kept = self.lines.where("kept").join(more.select("record_table", *names).distinct(), ["record_table", *names], "left_semi")
        kept = kept.select(F.col("record_table").alias("of_table"), F.col("id").alias("of_id"), "start", "end", *names)
        inside = (F.col("record_table") == F.col("of_table")) & (F.col("id") == F.col("of_id")) & (F.col("pos") >= F.col("start")) & (F.col("pos") + SPAN <= F.col("end"))
        w = cut(self.windows.join(kept, inside, "left").select("record_table", "h", "g", "id", "ent", *names).distinct())
        own = F.xxhash64("id", *names)
        marks = [F.count(F.lit(1)), F.min("id"), F.max("id"), F.sum(F.shiftright(own, 16)), F.bit_xor(own), F.bit_xor(F.xxhash64(*names, "id", F.lit(1)))]
        sets = w.groupBy("record_table", "h", "g").agg(*[m.alias(f"m{i}") for i, m in enumerate(marks)])
        # of the windows with one set, the one with the smallest names: by h, and of equal h by g
        low = sets.groupBy("record_table", *[f"m{i}" for i in range(len(marks))]).agg(F.min("h").alias("h"))
        one = cut(sets.join(low, ["record_table", *[f"m{i}" for i in range(len(marks))], "h"], "left_semi").select("record_table", "h", "g", F.col("m0").alias("n_rows")))
        used = cut(marked(w, one, ["record_table", "h", "g"], one.count(), self.total).withColumn("class_id", F.xxhash64("record_table", "h", "g")))
        added = used.where("n1 is not null").select("record_table", "class_id", *names).distinct().join(more, ["record_table", *names])
        both = used.select("record_table", "class_id", "id", "ent").unionByName(added.select("record_table", "class_id", "id", "ent"))
        return both.distinct().withColumnRenamed("id", "record_id")

    def pairs(self) -> DataFrame:
        """(record_table, record_id_a, record_id_b), a < b, of the records that share a span: the classes written out."""
        c = cut(self.classes())
        a = c.select("record_table", "class_id", F.col("record_id").alias("record_id_a"), F.col("ent").alias("ent_a"))
        b = c.select("record_table", "class_id", F.col("record_id").alias("record_id_b"), F.col("ent").alias("ent_b"))
        pairs = a.join(b, ["record_table", "class_id"]).where("record_id_a < record_id_b and ent_a <> ent_b")
        return pairs.select("record_table", "record_id_a", "record_id_b").distinct()

    def stretches(self) -> DataFrame:
        """(record_table, record_id, start_pos, end_pos, later): the parts of a text that are shared elsewhere, joined where they touch.

        later: whether the whole stretch also stands in earlier records (by id), so that it may be removed here.
        """
        w = self.windows.select("record_table", "id", "pos", (F.col("pos") + SPAN).alias("stop"), (F.col("first_id") < F.col("id")).alias("later"))
        rest = self.lines.where("not kept").select("record_table", "id", F.col("start").cast("long").alias("pos"), F.col("end").cast("long").alias("stop"), F.lit(True).alias("later"))
        order = W.partitionBy("record_table", "id", "later").orderBy("pos", "stop")
        reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
        runs = w.unionByName(rest).withColumn("new", F.coalesce(F.col("pos") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
        return runs.groupBy("record_table", F.col("id").alias("record_id"), "later", "run").agg(F.min("pos").alias("start_pos"), F.max("stop").alias("end_pos")).select(
            "record_table", "record_id", "start_pos", "end_pos", "later"
        )

    def parts(self) -> DataFrame:
        """(record_table, record_id, n_chars, shared_chars, share) of the records with a shared span."""
        s = self.stretches().select("record_table", F.col("record_id").alias("id"), "start_pos", "end_pos")
        order = W.partitionBy("record_table", "id").orderBy("start_pos", "end_pos").rowsBetween(W.unboundedPreceding, -1)
        fresh = F.col("end_pos") - F.greatest("start_pos", F.coalesce(F.max("end_pos").over(order), F.lit(0)))
        covered = s.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("record_table", "id").agg(F.sum("fresh").alias("shared_chars"))
        size = self.texts.groupBy("record_table", "id").agg(F.max(F.length("text")).cast("long").alias("n_chars"))
        return covered.join(size, ["record_table", "id"]).select(
            "record_table", F.col("id").alias("record_id"), "n_chars", "shared_chars", F.round(F.col("shared_chars") / F.col("n_chars"), 4).alias("share")
        )

    def removals(self) -> DataFrame:
        """(record_table, record_id, start_pos, end_pos): what can go because an earlier record keeps it.

        Copies of a line that are equal when normalised, with the line end after them, and later stretches.
        """
        lines = self.lines.where(F.col("first_id") < F.col("id")).select("record_table", F.col("id").alias("record_id"), F.col("start").cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"))
        both = lines.unionByName(self.stretches().where("later").drop("later"))
        order = W.partitionBy("record_table", "record_id").orderBy("start_pos", "end_pos")
        reach = F.max("end_pos").over(order.rowsBetween(W.unboundedPreceding, -1))
        runs = both.withColumn("run", F.sum(F.coalesce(F.col("start_pos") > reach, F.lit(True)).cast("int")).over(order))
        return runs.groupBy("record_table", "record_id", "run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("run")

    def remaining(self) -> DataFrame:
        """(record_table, record_id, text, removed_chars) of every record: its text without what an earlier record keeps."""
        cuts = self.removals().groupBy("record_table", F.col("record_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("cuts"))
        t = self.texts.select("record_table", "id", "text").dropDuplicates(["record_table", "id"]).join(cuts, ["record_table", "id"], "left")
        start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
        part = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
        step = lambda s, c: F.struct(F.concat(s["text"], part(s["at"], c["start_pos"])).alias("text"), c["end_pos"].alias("at"))
        left = F.aggregate("cuts", start, step, lambda s: F.concat(s["text"], part(s["at"], F.length("text").cast("long"))))
        gone = F.aggregate("cuts", F.lit(0).cast("long"), lambda s, c: s + c["end_pos"] - c["start_pos"])
        return t.select("record_table", F.col("id").alias("record_id"), F.coalesce(left, "text").alias("text"), F.coalesce(gone, F.lit(0)).alias("removed_chars"))
