"""Similarity join on word n-grams with exact Jaccard links, and the components they form.

Documents with one n-gram set are one node. A node files its prefix, the first grams of a common
order of which a linked node must share one, and its size. The order puts frequent grams last, as
told by a bounded sample of documents, and follows the hash otherwise; any order gives the same links. Nodes under one gram, in order of size, are cut
into bands wherever the next size is too large to allow the similarity; a gram and a band make a
tile, split into blocks when very large, and nodes alone in theirs go no further. In a tile only nodes whose sizes allow the similarity are
compared, first by what is left of their sorted grams from the tile's gram on, then by hashed bitmap
signatures: the bits one has and the other lacks bound the overlap from above. Pairs that pass are bounded again by signatures whose width grows with the size band,
and those left are checked by intersecting the exact sorted arrays.

A tile of many nodes sends only pairs with a central node in the first round. The links found so
far give components; a second round over those tiles sends every remaining pair of nodes from
different components that the bound lets pass. So no pair is lost, and a large group of copies
doesn't send its pairs: nodes that are already connected need no further link.

Defined cases: a text without words is linked with nothing; fewer words than n form one gram;
equal rows and equal texts are one node; null doc_ids take part in links but name no component
unless nothing else does; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from phenospark.llm.common import prepare
from phenospark.llm.components import components
from phenospark.llm.textscan import FAMILIES, Words, grams, scan
from phenospark.operators.joins import lookup
from phenospark.runtime import materialize

BITS = 2048
STAR_FROM = 16
BLOCK = 8192
COMPARED_ROWS = 256
# documents whose grams tell which are frequent, in how many of them, and the longest list of such
SAMPLE_DOCS, SAMPLE_LEAST, FREQUENT = 4096, 6, 1 << 16
TILE = ("key", "band", "lo", "hi")
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def gram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sorted distinct gram hashes, end to end, and each row's bounds in them."""
    counts = np.diff(words.bounds)
    full = np.flatnonzero(words.room() >= n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    f = FAMILIES[0]
    whole = f.spans(f.prefix(words.hashes[0]), words.bounds[short], words.bounds[short + 1])
    values = np.concatenate([grams(words, n)[full], whole])
    rows = np.concatenate([words.row[full], short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(counts) + 1))


def bitmap(values: np.ndarray) -> bytes:
    """Signature of a set with 4 to 8 bits per member; the width, a power of two, goes with the size band."""
    width = max(BITS, 1 << int(4 * len(values) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(values % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(raw: bytes, width: int) -> bytes:
    """The signature at a smaller width, which is what the set itself would give there."""
    return raw if 8 * len(raw) == width else np.bitwise_or.reduce(np.frombuffer(raw, np.uint8).reshape(-1, width // 8), axis=0).tobytes()


def _distinct_grams(n_gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in scan(batch.column("text"), lower=True, families=1):
                values, _ = gram_sets(words, n_gram)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["gram"])

    return run


def frequent_grams(base: DataFrame, n_gram: int, docs: int = SAMPLE_DOCS, least: int = SAMPLE_LEAST, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Grams that at least ``least`` of about ``docs`` documents hold, the ``most`` most frequent, in
    order of their hash, with their counts. Copies of a text count once."""
    n = base.count()
    place = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    sample = base.where(place < min(1.0, docs / max(n, 1))).select("text").distinct()
    counts = sample.mapInArrow(_distinct_grams(n_gram), "gram bigint").groupBy("gram").count().where(F.col("count") >= least)
    found = counts.orderBy(F.desc("count"), "gram").limit(most).toPandas()
    grams_, held = found["gram"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy(np.int64)
    order = np.argsort(grams_)
    return grams_[order], held[order]


def rarest_first(values: np.ndarray, rows: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The grams of each row, in the common order; ``values`` are in order of row and hash."""
    known, held = frequent
    if not len(known):
        return values
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    weight = np.where(known[at] == values, held[at], 0)
    return values[np.lexsort((weight, rows))]


def _sketch(n_gram: int, pct: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 18, np.uint64)
        for batch in batches:
            for words in scan(batch.column("text"), lower=True, families=1):
                values, at = gram_sets(words, n_gram)
                size = np.diff(at)
                sid, check = (f.spans(f.prefix(values), at[:-1], at[1:]) for f in FAMILIES)
                # a set this task has filed already needs no second filing
                slot = (sid % np.uint64(len(seen))).astype(np.int64)
                file = (seen[slot] != sid) & (size > 0)
                seen[slot] = sid
                keep = np.where(file, size - -(-pct * size // 100) + 1, 0)
                ends = np.cumsum(np.append(0, keep))
                pick = np.repeat(at[:-1] - ends[:-1], keep) + np.arange(ends[-1])
                ordered = rarest_first(values, np.repeat(np.arange(len(size)), size), shared.value)
                signed = [bitmap(values[a:b]) if k else None for a, b, k in zip(at, at[1:], file)]
                long = lambda x: pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(words.first, len(size)), batch.column("rid").slice(words.first, len(size)),
                        long(sid), long(check), pa.array(size.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), long(ordered[pick])),
                        pa.array([x and fold(x, BITS) for x in signed], pa.binary()), pa.array(signed, pa.binary()),
                    ],
                    ["doc", "rid", "sid", "check", "n", "prefix", "sig", "wide"],
                )

    return run


def _exact_sets(n_gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            # equal rows name the same set; a task sends it once
            names = batch.column("sid").to_pylist()
            new = [not (s in seen or seen.add(s)) for s in names]
            batch = batch.filter(pa.array(new, pa.bool_()))
            for words in scan(batch.column("text"), lower=True, families=1):
                values, at = gram_sets(words, n_gram)
                raw = [values[a:b].tobytes() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("sid").slice(words.first, len(raw)), pa.array(raw, pa.binary())], ["sid", "grams"]
                )

    return run


def may_link(n: np.ndarray, left: np.ndarray, bits: np.ndarray, sig: np.ndarray, i: int, js: np.ndarray, pct: int) -> np.ndarray:
    """Of the nodes ``js``, those whose overlap with node i neither ``left`` nor the bit counts rule out.

    ``left`` is how many grams a node has from the tile's gram on. In the tile of two nodes' first
    common gram all they share is among those, so linked nodes pass there, if nowhere else.
    """
    js = js[(100 + pct) * np.minimum(left[i], left[js]) >= pct * (n[i] + n[js])]
    common = np.bitwise_count(sig[js] & sig[i]).sum(axis=1, dtype=np.int64)
    overlap = np.minimum(n[i] - (bits[i] - common), n[js] - (bits[js] - common))
    return js[(100 + pct) * overlap >= pct * (n[i] + n[js])]


def most_central(sig: np.ndarray, rows: int = 512) -> int:
    """The signature that agrees best with how often each bit is set; some rows at a time."""
    bits = lambda i: np.unpackbits(sig[i : i + rows].view(np.uint8), axis=1).astype(np.float32)
    starts = range(0, len(sig), rows)
    share = sum(bits(i).sum(axis=0, dtype=np.float64) for i in starts) / len(sig)
    return int(np.argmax(np.concatenate([bits(i) @ (2.0 * share - 1).astype(np.float32) for i in starts])))


def tile_pairs(sid, n, pos, sig, comp, block, pct: int, star: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile to check exactly. ``comp`` None: the first round, where (a, a) marks a node that later pairs may need."""
    order = np.argsort(n, kind="stable")
    sid, n, sig, block = sid[order], n[order], sig[order], block[order]
    comp = sid if comp is None else comp[order]
    rest = n - pos[order]
    bits = np.bitwise_count(sig).sum(axis=1, dtype=np.int64)
    upto = np.searchsorted(n, n * 100 // pct, "right")
    left, right = [], []
    if star:
        open_ = np.ones(len(n), bool)
        while open_.any():
            at = np.flatnonzero(open_)
            centre = at[most_central(sig[at])]
            near = at[(100 * n[at] >= pct * n[centre]) & (pct * n[at] <= 100 * n[centre])]
            hits = may_link(n, rest, bits, sig, centre, near[near != centre], pct)
            left.append(np.full(len(hits), centre))
            right.append(hits)
            open_[near] = False
    two_blocks = len(block) and block.min() != block.max()
    for i in range(len(n)):
        js = np.arange(i + 1, upto[i])
        js = js[comp[js] != comp[i]]
        if two_blocks:
            js = js[block[js] != block[i]]
        hits = may_link(n, rest, bits, sig, i, js, pct) if len(js) else js
        if star:
            hits = np.append(hits, i) if len(hits) else hits
            left.append(hits)
            right.append(hits)
        else:
            left.append(np.full(len(hits), i))
            right.append(hits)
    a, b = sid[np.concatenate(left)], sid[np.concatenate(right)]
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    both = np.unique(np.stack([lo, hi]), axis=1) if len(lo) else np.empty((2, 0), np.int64)
    return both[0], both[1]


def _tiles(pct: int, again: bool):
    """Walk rows sorted by tile and yield each tile's pairs; a tile may span batches."""

    def pairs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        col = lambda c: t.column(c).to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        star = not again and t.num_rows > STAR_FROM
        a, b = tile_pairs(col("sid"), col("n").astype(np.int64), col("pos"), sig, col("comp") if again else None, col("block"), pct, star)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in TILE])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                now = tuple(keys[:, a].tolist())
                if held and now != key:
                    yield pairs(held)
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield pairs(held)

    return run


def _in_tiles(rows: DataFrame, sigs: DataFrame, pct: int, again: bool) -> DataFrame:
    """Distinct pairs to check. Tiles over ``BLOCK`` nodes are cut into blocks, compared two at a time."""
    blocks = F.ceil(F.col("g") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    placed = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "g")
    placed = placed.join(sigs, "sid")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(parts, *TILE).sortWithinPartitions(*TILE)
    return dealt.mapInArrow(_tiles(pct, again), "a bigint, b bigint").distinct()


def _verify(pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append((100 + pct) * both >= pct * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bounded(pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, nx, y, ny in zip(*(batch.column(c).to_pylist() for c in ("x", "nx", "y", "ny"))):
                width = 8 * min(len(x), len(y))
                x, y = (np.frombuffer(fold(z, width), np.uint64) for z in (x, y))
                both, bx, by = (int(np.bitwise_count(z).sum(dtype=np.int64)) for z in (x & y, x, y))
                keep.append((100 + pct) * min(nx - bx + both, ny - by + both) >= pct * (nx + ny))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _needed(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``table`` whose sid is in a pair; a short list of sids is sent to the table."""
    ids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    return lookup(table, ids, ["sid"], rows=ids.count(), row_bytes=24, skewed=False)


def _survivors(pairs: DataFrame, filed: DataFrame, pct: int) -> DataFrame:
    """Pairs that the bit counts of the full-width signatures don't rule out either."""
    # equal sets filed by several tasks have equal signatures
    wides = _needed(filed.select("sid", "n", "wide"), pairs).dropDuplicates(["sid"])
    x = wides.select(F.col("sid").alias("a"), F.col("n").alias("nx"), F.col("wide").alias("x"))
    y = wides.select(F.col("sid").alias("b"), F.col("n").alias("ny"), F.col("wide").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "nx", "y", "ny").mapInArrow(_bounded(pct), "a bigint, b bigint")


def _linked(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    # equal rows of several tasks give a set more than once
    sets = _needed(sets, pairs).dropDuplicates(["sid"])
    x = sets.select(F.col("sid").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("sid").alias("b"), F.col("grams").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(pct), "a bigint, b bigint")


def _named_apart(sketch: DataFrame) -> DataFrame:
    """Different sets that share a 64-bit name (told by a second hash) get names from both hashes."""
    clash = sketch.groupBy("sid").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x != y").select("sid", F.lit(True).alias("clash"))
    n = clash.count()
    if not n:
        return sketch
    both = lookup(sketch, clash, ["sid"], "left", rows=n)
    return both.withColumn("sid", F.when(F.col("clash"), F.xxhash64("sid", "check")).otherwise(F.col("sid"))).drop("clash")


def _banded(filed: DataFrame, pct: int) -> DataFrame:
    """Rows (key, band, pos, sid, n, g) of the tiles with g > 1 nodes."""
    order = Window.partitionBy("key").orderBy("n", "sid")
    rows = filed.select(F.posexplode("prefix").alias("pos", "key"), "sid", "n").withColumn("old", F.lag("sid").over(order).eqNullSafe(F.col("sid")))
    rows = rows.where("NOT old").drop("old")
    apart = F.coalesce(100 * F.lag("n").over(order) < pct * F.col("n"), F.lit(False)).cast("int")
    rows = rows.withColumn("apart", apart).withColumn("band", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("apart")
    return rows.withColumn("g", F.count(F.lit(1)).over(Window.partitionBy("key", "band"))).where("g > 1")


def link_sets(docs: DataFrame, n_gram: int = 4, pct: int = 85, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The sketch (doc, sid, n) of every document and exact links (a, b) between sids that suffice for the components.

    Two sets link when their overlap is at least ``pct`` percent of their union. Every step is
    written, so each step's shuffle files are given up at its end.
    """
    conf = docs.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return _link_sets(docs, n_gram, pct, text, key)
    finally:
        conf.set(CLEANUP, before)


def _link_sets(docs: DataFrame, n_gram: int, pct: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    prepare(docs.sparkSession, COMPARED_ROWS)
    rid = F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    base = docs.select(F.col(key).cast("bigint").alias("doc"), rid.alias("rid"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_grams(base, n_gram))
    sketch = materialize(
        base.mapInArrow(_sketch(n_gram, pct, shared), "doc bigint, rid int, sid bigint, check bigint, n int, prefix array<bigint>, sig binary, wide binary"),
        "sketch",
    )
    sketch = _named_apart(sketch)
    filed = sketch.where("size(prefix) > 0")
    tiles = materialize(_banded(filed, pct), "tiles")
    # equal sets filed by several tasks have equal signatures
    sigs = filed.select("sid", "sig").dropDuplicates(["sid"])
    node = F.struct("sid", "n", (F.col("n") - F.col("pos")).alias("left"))
    ends = tiles.where("g = 2").groupBy("key", "band").agg(F.min(node).alias("x"), F.max(node).alias("y"))
    # as in may_link: what is left of the grams from the tile's on must allow the overlap
    room = (100 + pct) * F.least("x.left", "y.left") >= pct * (F.col("x.n") + F.col("y.n"))
    twos = ends.where(room).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
    tried = materialize(_in_tiles(tiles.where("g > 2"), sigs, pct, again=False).unionByName(twos).distinct(), "pairs")
    pairs = materialize(_survivors(tried.where("a != b"), filed, pct), "survivors")

    marked = tried.where("a = b").select("a", "b")
    wanted = pairs.unionByName(marked)
    ids = wanted.select(F.col("a").alias("sid")).union(wanted.select("b")).distinct()
    where = lookup(sketch, ids, ["sid"], rows=ids.count(), row_bytes=24, skewed=False).groupBy("sid").agg(F.min(F.struct("doc", "rid")).alias("at"))
    no_doc = F.col("at.doc").isNull()
    where = materialize(where.select("sid", F.coalesce("at.doc", F.lit(0)).alias("k"), no_doc.alias("none"), F.col("at.rid").alias("rid")), "where")
    keyed = base.select(F.coalesce("doc", F.lit(0)).alias("k"), F.col("doc").isNull().alias("none"), "rid", "text")
    found = lookup(keyed, where, ["k", "none", "rid"], rows=where.count(), row_bytes=48, skewed=False).select("sid", "text")
    sets = materialize(found.mapInArrow(_exact_sets(n_gram), "sid bigint, grams binary"), "sets")
    links = materialize(_linked(pairs, sets, pct), "links")

    names = components(links)
    large = tiles.where(F.col("g") > STAR_FROM).join(names.select(F.col("node").alias("sid"), F.col("component").alias("comp")), "sid", "left")
    large = large.withColumn("comp", F.coalesce("comp", "sid"))
    rest = materialize(_in_tiles(large, sigs, pct, again=True).join(tried, ["a", "b"], "left_anti"), "more_pairs")
    left = materialize(_survivors(rest, filed, pct), "more_survivors")
    more = materialize(_linked(left, sets, pct), "more_links")
    return sketch.select("doc", "sid", "n"), links.unionByName(more)


def similar_components(docs: DataFrame, n_gram: int = 4, pct: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_shingles and component_id, the least key reachable by links."""
    sketch, links = link_sets(docs, n_gram, pct, text, key)
    names = components(links)
    named = sketch.where("n > 0").join(names.select(F.col("node").alias("sid"), "component"), "sid", "left")
    named = named.withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    out = named.join(least, "component").select(F.col("doc").alias(key), F.col("n").cast("bigint").alias("n_shingles"), "component_id")
    alone = sketch.where("n = 0").select(F.col("doc").alias(key), F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc").alias("component_id"))
    return out.unionByName(alone)
