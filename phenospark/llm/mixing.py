"""Mixing sources to target weights by repeating documents.

Tokens (words) are summed per source; a source's target is its weighted share of the wanted total,
limited to a multiple of its own size with the excess shared again. A document is emitted
floor(rate) times, plus one more copy with probability equal to the fraction of the rate, decided
by its hash. The decisions are systematic: documents of a source are cut into hashed chunks of
about ``CHUNK_DOCS``, those of a chunk are ordered by size class, hash of the key and hash of the
text, and a seeded random phase walks through them in steps of the fraction. Each document's chance
is exactly the fraction, a chunk's number of copies misses its share by less than one, and the words
taken miss a source's target only by what sizes differ within a class.

Only hashes and sizes are ordered, by ranges of all of them, so a key that many rows share or lack
fills no task. The order is whole but for equal rows, so any split of the rows gives the same copies.

Defined cases: a null text has size 0; null sources form the last source; a source without words
has target and rate 0; repeated rows are documents of their own (equal rows may differ in copies);
extra columns are kept, and columns with an output's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phenospark.llm.common import n_words, unused
from phenospark.operators.axis import dense_index
from phenospark.operators.joins import lookup
from phenospark.runtime import materialize

CHUNK_DOCS = 4096


def source_plan(
    sized: DataFrame, source: str, size: str, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """One row per source: mix_source, source_size, n_docs, weight, target, rate.

    ``weights`` repeat along the sources in code point order, null last. The reshare loop reads
    one summed row per round.
    """
    sums = materialize(
        sized.groupBy(F.col(source).alias("mix_source")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("n_docs")),
        "source_sums",
    )
    ranked, n = dense_index(sums.where("mix_source IS NOT NULL"), ["mix_source"], "idx")
    nulls = sums.where("mix_source IS NULL").withColumn("idx", F.lit(n).cast("bigint"))
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("idx") % len(weights)).cast("int") + 1)
    plan = materialize(ranked.unionByName(nulls).withColumn("weight", weight).drop("idx"), "source_weights")
    limit = F.col("source_size") * F.lit(cap)
    total = plan.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    wanted = share * (total.s or 0)
    level, capped = wanted / total.w if total.w else 0.0, 0
    while True:
        above = F.col("weight") * F.lit(level) >= limit
        now = plan.agg(
            F.count_if(above).alias("n"), F.sum(F.when(above, limit)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("w")
        ).first()
        if now.n == capped or not now.w:
            break
        capped, level = now.n, (wanted - now.full) / now.w
    target = F.least(limit, F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return plan.withColumn("target", target).withColumn("rate", rate)


def _hex(digits: Column, start: int, n: int) -> Column:
    """Some hexadecimal digits of a text as a number."""
    return F.conv(F.substring(digits, start, n), 16, 10).cast("bigint")


def _digest(*parts: Column) -> Column:
    """One hash that tells documents apart by some texts (null is no text)."""
    told = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws("|", *told))


def _source_key(source: str) -> tuple[Column, Column]:
    """A source as two columns without nulls, which joins would drop."""
    return F.coalesce(source, F.lit("")), F.col(source).isNull()


def walk_sources(sized: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """Who gets one more copy: (digest, n_rows, n_extra) of the documents that do.

    ``sized`` has name, nameless, key, size, text_md5, digest; ``plan`` a row per source.
    """
    chunk_of = ["nameless", "name", "chunk"]
    placed = lookup(sized, plan, ["name", "nameless"], rows=plan.count(), row_bytes=128)
    placed = placed.withColumn("md", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce("key", F.lit("null")))))
    placed = placed.select(
        "name", "nameless", (_hex(F.col("md"), 9, 8) % F.ceil(F.col("n_docs") / CHUNK_DOCS)).alias("chunk"),
        F.length(F.bin("size")).alias("size_class"), "md", "text_md5", "digest", (F.col("rate") - F.floor("rate")).alias("fraction"))
    walked, _ = dense_index(placed, [*chunk_of, "size_class", "md", "text_md5"], "at", unique=False)
    firsts = materialize(walked.groupBy(*chunk_of).agg(F.min("at").alias("first")), "chunks")
    walked = lookup(walked, firsts, chunk_of, rows=firsts.count(), row_bytes=96)
    name = F.when(F.col("nameless"), "null").otherwise(F.concat(F.lit("s"), "name"))
    phase = _hex(F.md5(F.concat_ws("|", F.lit(str(seed)), name, F.col("chunk").cast("string"))), 1, 8) / F.lit(4294967296.0)
    rank = (F.col("at") - F.col("first") + 1).cast("double")
    extra = F.floor(rank * F.col("fraction") + phase) - F.floor((rank - 1) * F.col("fraction") + phase)
    return walked.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(extra).alias("n_extra")).where("n_extra > 0")


def decide_copies(docs: DataFrame, source: str, size: str, key: str, text: str, weights: tuple[float, ...], share: float, cap: float, seed: int = 1) -> DataFrame:
    """Add source_size, target and copies (long) to every document.

    Documents meet their source's row by broadcast where the plan has a bounded size, and their
    draw by a hash of all that tells them apart. Rows equal in that, of which only some get one
    more copy, are numbered; no others are ordered.
    """
    name, nameless, rate, told, n_rows, n_extra = unused(docs, "mix_name", "no_source", "mix_rate", "mix_told", "mix_rows", "mix_extra")
    cols = docs.columns
    of_name, of_nameless = _source_key(source)
    as_text, text_md5 = F.col(key).cast("string"), F.md5(F.col(text))
    digest = _digest(F.col(source), as_text, text_md5)
    sized = materialize(docs.select(
        F.col(source).alias("mix_source"), of_name.alias("name"), of_nameless.alias("nameless"), as_text.alias("key"),
        F.col(size).alias("size"), F.coalesce(text_md5, F.lit("")).alias("text_md5"), digest.alias("digest")), "sized")
    of_name, of_nameless = _source_key("mix_source")
    plan = materialize(source_plan(sized, "mix_source", "size", weights, share, cap).select(
        of_name.alias("name"), of_nameless.alias("nameless"), "n_docs", "source_size", "target", "rate"), "mix_plan")
    draws = materialize(walk_sources(sized.drop("mix_source"), plan, seed).select(
        F.col("digest").alias(told), F.col("n_rows").alias(n_rows), F.col("n_extra").alias(n_extra)), "draws")
    split = F.col(n_extra) < F.col(n_rows)
    n, n_split = draws.agg(F.count(F.lit(1)), F.count_if(split)).first()
    # the keys of all rows, without their texts
    keys = sized.select(F.col("digest").alias(told))

    def drawn(rows: DataFrame, some: DataFrame, how: str, n: int) -> DataFrame:
        return lookup(rows, some, [told], how, rows=n, row_bytes=96, measured=keys)

    named = docs.select(*cols, *[c.alias(a) for c, a in zip((*_source_key(source), digest), (name, nameless, told))])
    rows = drawn(named, draws, "left", n)
    if n_split:
        packed = named.select(F.struct(*named.columns).alias("doc"), F.col(told))
        few = drawn(packed, draws.where(split), "inner", n_split).withColumn("ties", F.xxhash64(F.to_json("doc")))
        few, _ = dense_index(few, [told, "ties"], "at", unique=False)
        firsts = materialize(few.groupBy(told).agg(F.min("at").alias("first")), "equal_rows")
        few = lookup(few, firsts, [told], rows=n_split, row_bytes=96)
        taken = (F.col("at") - F.col("first") < F.col(n_extra)).cast("bigint")
        few = few.select("doc.*", F.lit(1).cast("bigint").alias(n_rows), taken.alias(n_extra))
        rows = rows.where(~F.coalesce(split, F.lit(False))).select(*few.columns).unionByName(few)
    of_source = plan.select(F.col("name").alias(name), F.col("nameless").alias(nameless), "source_size", "target", F.col("rate").alias(rate))
    rows = lookup(rows, of_source, [name, nameless], rows=of_source.count(), row_bytes=128)
    copies = F.floor(rate) + F.coalesce((F.col(n_extra) > 0).cast("bigint"), F.lit(0))
    return rows.select(*cols, "source_size", "target", copies.cast("bigint").alias("copies"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 1,
    text: str = "text", source: str = "source", key: str = "doc_id",
) -> DataFrame:
    """Every document with size, source_size, target and copies; :func:`emit` repeats the rows."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("size", "source_size", "target", "copies")))
    return decide_copies(docs.withColumn("size", n_words(text)), source, "size", key, text, weights, share, cap, seed)


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as its copies say."""
    (i,) = unused(mixed, "copy_no")
    return mixed.where("copies > 0").withColumn(i, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(i)
