"""Language identification by compression: the language whose text compresses a document best.

Each language gets a zstandard raw-content dictionary made of pieces of its training texts. A text
is cut into blocks, each block is encoded once per language with that language's dictionary, and
the language of the fewest bytes wins. Texts are compared as lower-case letters with single spaces
between words, whole, however long. The margin is how many bytes the second language needs more;
``rejected`` marks texts whose margin is too narrow to be trusted.

The dictionaries are a bounded sample: of the different texts of a language about ``sample_texts``
of least hash, and of their pieces the ones of least hash, up to ``dictionary_bytes`` (and 64 MB for
all languages together). Only hashes are counted and shuffled, then the chosen texts are read.

Defined results: a null or empty text, one without a letter, and any text when nothing was learned
give ``und`` with score 0. Equal sizes go to the language with more training texts, then to the
lesser name. With one learned language its score is 1. Repeated rows each get their result; an
empty table gives an empty one; all input columns are kept, except those named like an output,
which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from phenospark.llm.common import prepare, unused
from phenospark.operators.joins import lookup
from phenospark.runtime import materialize

UNKNOWN = "und"
SAMPLE_TEXTS = 1000
DICTIONARY_BYTES = 48 << 10
ALL_DICTIONARIES = 64 << 20
PIECE = 256
BLOCK = 2048
LEVEL = 8
#: A margin below this many bytes, or below this share of the best size, is narrow.
NARROW_BYTES, NARROW_SHARE = 2, 0.002
#: Bytes to nats of the score: less than 8 ln 2, as bytes of zstandard are far from exact.
SHARPNESS = 0.5
OUT = ("lang_pred", "score", "margin", "rejected")


def letters(text: Column) -> Column:
    """Lower-case words of letters, one space between; empty without letters."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}]+", " ")))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass(frozen=True)
class Languages:
    """Dictionary content by language, in the order in which ties are decided."""

    content: dict[str, bytes]


def least_hashes(df: DataFrame, sizes: DataFrame, h: str, wanted: int) -> tuple[DataFrame, dict]:
    """About ``wanted`` rows of each language, all if there are fewer: those whose hash lies in the
    lowest wanted/n of its range. Needs no order, so no task sees a language whole. Also the
    rows of ``sizes`` by language."""
    rows = {r["lang"]: r for r in sizes.collect()}
    spark = df.sparkSession
    rates = spark.createDataFrame([(k, min(1.0, wanted / r["n"])) for k, r in rows.items()], "lang string, rate double")
    place = F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))
    return lookup(df, rates, ["lang"], rows=len(rows)).where(place < F.col("rate")).drop("rate"), rows


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> Languages:
    """Dictionaries from rows with a text and its language; rows lacking either teach nothing."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = rows.withColumn("h", F.xxhash64("text"))
    keys = hashed.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("copies"))
    sizes = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"))
    chosen, size = least_hashes(hashed, sizes, "h", sample_texts)
    texts = chosen.dropDuplicates(["lang", "h"])
    clean = texts.select("lang", letters(F.col("text")).alias("t")).where("t != ''")
    starts = F.sequence(F.lit(1), F.length("t"), F.lit(PIECE))
    pieces = clean.select("lang", F.explode(F.transform(starts, lambda i: F.substring("t", i, F.lit(PIECE)))).alias("piece")).distinct()
    pieces = materialize(pieces.withColumn("h", F.xxhash64("piece")), "pieces")
    n_pieces = math.ceil(dictionary_bytes / PIECE)
    # a fifth more than fit, as their number varies a little around what is asked for
    best, _ = least_hashes(pieces, pieces.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "h", math.ceil(1.2 * n_pieces) + 8)
    found: dict[str, list] = {}
    for r in best.select("lang", "h", "piece").collect():
        found.setdefault(r["lang"], []).append((r["h"] % (1 << 64), r["piece"]))
    room = min(dictionary_bytes, ALL_DICTIONARIES // max(1, len(found)))
    content = {}
    for name in sorted(found, key=lambda x: (-size[x]["copies"], x)):
        content[name] = " ".join(p for _, p in sorted(found[name])).encode()[:room]
    return Languages(content)


class Encoder:
    """One compressor per language; made once per task."""

    def __init__(self, languages: Languages):
        self.names = list(languages.content)
        self.compress = []
        for content in languages.content.values():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(
                dict_data=held, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        """Bytes of the text under each language."""
        raw = text.encode()
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c(b)) for b in blocks) for c in self.compress]

    def judge(self, text: str) -> tuple[str, float, int | None, bool]:
        """(language, score, margin, rejected) of a text with letters."""
        sizes = self.sizes(text)
        least = min(sizes)
        best = sizes.index(least)
        score = 1.0 / sum(math.exp(-SHARPNESS * (s - least)) for s in sizes)
        if len(sizes) == 1:
            return self.names[0], 1.0, None, False
        margin = min(s for i, s in enumerate(sizes) if i != best) - least
        return self.names[best], score, margin, margin < max(NARROW_BYTES, NARROW_SHARE * least)


def identify(docs: DataFrame, languages: Languages, text: str = "text") -> DataFrame:
    """The rows with ``lang_pred``, ``score``, ``margin`` (bytes, null if there is no second) and
    ``rejected``; the text column is kept."""
    prepare(docs.sparkSession)
    docs = docs.drop(*(c for c in docs.columns if c in OUT and c != text))
    shared = docs.sparkSession.sparkContext.broadcast(languages)
    (clean,) = unused(docs, "_letters")
    rows = docs.withColumn(clean, F.when(has_letter(F.col(text)), letters(F.col(text))))
    kept = docs.columns
    schema = T.StructType([
        *docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.LongType()), T.StructField("rejected", T.BooleanType()),
    ])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            found = []
            for t in b.column(clean):
                t = t.as_py()
                found.append(encoder.judge(t) if t and encoder.names else (UNKNOWN, 0.0, None, True))
            pred, score, margin, rejected = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(margin, pa.int64()), pa.array(rejected, pa.bool_())],
                names=[*kept, *OUT])

    return rows.mapInArrow(apply, schema)
