"""Removal of long word sequences that occur earlier, by De Bruijn compaction.

The windows of 20 words are the edges of a De Bruijn graph on token k-mers. Each window is filed
under its minimizer, the 5-word gram of least hash inside it, and the run of consecutive windows
with one minimizer is a path that is already compacted: one row (minimizer, path hash, source
coordinates, length) instead of a row per window. Spark groups the paths by minimizer. Where all
paths of a minimizer are equal, the path does not branch and is decided whole: every occurrence
but the first by its coordinates is a repeat. Where they differ, the path branches, and only the
first occurrence of each variant goes on: its source coordinates fetch its text again, and it is
compared edge by edge. Paths and edges are equal when 128 bits of hash agree.

Hot passages: a task sends an occurrence on only if it has not already seen the same path at an
earlier place; others are repeats at once. So a passage reaches a reducer about once per task,
however many documents hold it. The task's table has a fixed size; what it forgets is sent on.

Defined cases: a null or short text has no window; a null doc_id sorts before all; rows with one
doc_id and different texts are ordered by text fingerprint, equal rows are one place and get the
same result; extra columns are kept, columns with an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from phenospark.llm.common import prepare, unused
from phenospark.llm.textscan import FAMILIES, Words, grams, mix, scan
from phenospark.runtime import materialize

ANCHOR = 5
SLOTS = 1 << 19
ROWS = "h bigint, s bigint, doc bigint, place bigint, n int, decided boolean"


class Seen:
    """Fixed-size memory of hashed items and the earliest place where the task met each."""

    def __init__(self, slots: int = SLOTS):
        self.slots = slots
        self.h, self.s = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.doc, self.place = np.zeros(slots, np.int64), np.full(slots, -1, np.int64)

    def sort_out(self, h: np.ndarray, s: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the items to send on, and of those known to occur earlier."""
        order = np.lexsort((place, doc, s, h))
        h, s, doc, place = h[order], s[order], doc[order], place[order]
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
        repeat = same & ((doc != doc[head]) | (place != place[head]))
        slot = (s % np.uint64(self.slots)).astype(np.int64)
        known = (self.h[slot] == h) & (self.s[slot] == s) & (self.place[slot] >= 0)
        earlier = known & ((self.doc[slot] < doc) | ((self.doc[slot] == doc) & (self.place[slot] < place)))
        equal = known & (self.doc[slot] == doc) & (self.place[slot] == place)
        send = ~same & ~earlier & ~equal
        to = slot[send]
        self.h[to], self.s[to], self.doc[to], self.place[to] = h[send], s[send], doc[send], place[send]
        return order[send], order[repeat | earlier]


def least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest key (leftmost of ties) among the ``width`` from each position on."""
    at = np.arange(len(keys))
    have = 1
    while have < width:
        step = min(have, width - have)
        other = at[np.minimum(np.arange(len(keys)) + step, len(keys) - 1)]
        at = np.where(keys[other] < keys[at], other, at)
        have += step
    return at


def paths(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Compacted paths of a chunk: first window, number of windows, minimizer hash, path hash."""
    valid = np.flatnonzero(words.room() >= window)
    if not len(valid):
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    anchors = grams(words, ANCHOR)
    at = least_in_windows(anchors, window - ANCHOR + 1)[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)
    head = np.flatnonzero(new)
    first, n = valid[head], np.diff(np.append(head, len(valid)))
    f = FAMILIES[1]
    s = f.spans(f.prefix(words.hashes[1]), first, first + n + window - 1)
    return first, n, anchors[at[head]], s


def merged_runs(row: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join intervals of a row that touch; they come in order of row and start, ends not falling."""
    if not len(row):
        return row, first, end
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (first[1:] > end[:-1])
    head = np.flatnonzero(new)
    return row[head], first[head], end[np.append(head[1:], len(row)) - 1]


def _rows(h, s, doc, place, n, decided: bool) -> pa.RecordBatch:
    signed = lambda x: pa.array(x.astype(np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [signed(h), signed(s), pa.array(doc), pa.array(place), pa.array(n.astype(np.int32)), pa.array(np.full(len(h), decided))],
        ["h", "s", "doc", "place", "n", "decided"],
    )


def _sorted_out(seen: Seen, h, s, doc, place, n, row, first, length) -> Iterator[pa.RecordBatch]:
    """Rows to compare elsewhere, and the merged word intervals that are decided here."""
    send, repeats = seen.sort_out(h, s, doc, place)
    yield _rows(h[send], s[send], doc[send], place[send], n[send], False)
    repeats = repeats[np.lexsort((first[repeats], row[repeats]))]
    one = np.flatnonzero(np.append(True, (row[repeats][1:] != row[repeats][:-1]) | (first[repeats][1:] != first[repeats][:-1]))[: len(repeats)])
    repeats = repeats[one]
    if len(repeats):
        _, begin, end = merged_runs(row[repeats], first[repeats], (first + length)[repeats])
        keep = repeats[np.isin(first[repeats], begin)]
        spread = mix(place[keep].astype(np.uint64) ^ mix(doc[keep].astype(np.uint64)))
        yield _rows(spread, np.zeros(len(keep), np.uint64), doc[keep], place[keep], end - begin, True)


def _path_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            rids = batch.column("rid").to_numpy(zero_copy_only=False).astype(np.int64)
            for words in scan(batch.column("text")):
                first, n, h, s = paths(words, window)
                row = words.row[first]
                at = row + words.first
                place = rids[at] << 32 | first - words.bounds[row]
                yield from _sorted_out(seen, h, s, docs[at], place, n, row, first, n + window - 1)

    return run


def _edge_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            rids = batch.column("rid").to_numpy(zero_copy_only=False).astype(np.int64)
            spans = batch.column("spans")
            starts = spans.offsets.to_numpy()
            froms, counts = (spans.values.field(i).to_numpy() for i in (0, 1))
            for words in scan(batch.column("text")):
                a, b = starts[words.first], starts[words.last]
                rows = np.repeat(np.arange(words.last - words.first), np.diff(starts[words.first : words.last + 1]))
                n = counts[a:b].astype(np.int64)
                row = np.repeat(rows, n)
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first = words.bounds[row] + np.repeat(froms[a:b].astype(np.int64), n) + offset
                h, s = (f.spans(f.prefix(v), first, first + window) for f, v in zip(FAMILIES, words.hashes))
                at = row + words.first
                place = rids[at] << 32 | first - words.bounds[row]
                length = np.full(len(first), window)
                yield from _sorted_out(seen, h, s, docs[at], place, np.ones(len(first), np.int64), row, first, length)

    return run


def _kept(text: str, out: str, of_row: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for body, spans in zip(batch.column(text).to_pylist(), batch.column(of_row).to_pylist()):
                words = (body or "").encode().split()
                totals.append(len(words))
                if spans:
                    change = np.zeros(len(words) + 1, np.int64)
                    at = np.array([(x["from"], x["from"] + x["n"]) for x in spans])
                    np.add.at(change, at[:, 0], 1)
                    np.add.at(change, at[:, 1], -1)
                    words = list(compress(words, (np.cumsum(change)[:-1] == 0).tolist()))
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words).decode())
            names = [c for c in batch.schema.names if c != of_row]
            columns = [batch.column(c) for c in names] + [pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_removed", out])

    return run


def _first(*by: str) -> tuple[Column, Column]:
    """Whether a row stands at the earliest place of its group; the group's least place."""
    w = Window.partitionBy(*by)
    least = F.min(F.struct("doc", "place")).over(w)
    return (F.col("doc") == least["doc"]) & (F.col("place") == least["place"]), least


def _spans_by_row(marks: DataFrame, length: Column) -> DataFrame:
    """Per document row the array of (from, n) in words; it is bounded by the text's own length."""
    rid, start = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    return marks.select("doc", rid.alias("rid"), F.struct(start.alias("from"), length.cast("int").alias("n")).alias("x")).groupBy("doc", "rid").agg(
        F.collect_list("x").alias("spans")
    )


def repeated_spans(keyed: DataFrame, window: int = 20) -> DataFrame:
    """Word intervals to remove, per (doc, rid); ``keyed`` has doc, rid and text."""
    found = keyed.where("text IS NOT NULL").mapInArrow(_path_rows(window), ROWS)
    is_first, _ = _first("h", "s")
    group = Window.partitionBy("h")
    judged = found.withColumns({"is_first": is_first, "branches": F.min("s").over(group) != F.max("s").over(group)})
    marks = materialize(
        judged.where("decided OR NOT is_first OR branches")
        .select("doc", "place", "n", "decided", (~F.col("decided") & F.col("is_first")).alias("branch")),
        "path_marks",
    )
    whole = marks.where("NOT branch").withColumn("length", F.when(F.col("decided"), F.col("n")).otherwise(F.col("n") + (window - 1)))
    firsts = _spans_by_row(marks.where("branch"), F.col("n"))
    edges = keyed.join(firsts, ["doc", "rid"]).select("doc", "rid", "text", "spans").mapInArrow(_edge_rows(window), ROWS)
    edge_first, _ = _first("h", "s")
    edges = edges.withColumn("is_first", edge_first).where("decided OR NOT is_first")
    edges = edges.withColumn("length", F.when(F.col("decided"), F.col("n")).otherwise(F.lit(window)))
    columns = ["doc", "place", "length"]
    return _spans_by_row(whole.select(*columns).unionByName(edges.select(*columns)), F.col("length"))


def remove_repeats(docs: DataFrame, window: int = 20, text: str = "text", key: str = "doc_id", out: str = "kept_text") -> DataFrame:
    """Add n_words, n_removed and the kept words joined by one space."""
    prepare(docs.sparkSession)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("n_words", "n_removed", out.lower())))
    doc, rid, d2, r2, of_row = unused(docs, "doc", "rid", "key_doc", "key_rid", "spans")
    lowest = F.lit(-(1 << 63)).cast("bigint")
    place = docs.withColumns({
        doc: F.coalesce(F.col(key).cast("bigint"), lowest), rid: F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"),
    })
    keyed = place.select(F.col(doc).alias("doc"), F.col(rid).alias("rid"), F.col(text).alias("text"))
    spans = repeated_spans(keyed, window).select(F.col("doc").alias(d2), F.col("rid").alias(r2), F.col("spans").alias(of_row))
    names = docs.columns
    joined = place.join(spans, (F.col(doc) == F.col(d2)) & (F.col(rid) == F.col(r2)), "left").select(*names, of_row)
    schema = joined.select(*names, F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.lit("").alias(out)).schema
    return joined.mapInArrow(_kept(text, out, of_row), schema)
