"""Byte-level BPE: encoding by a rank file and decoding.

Texts are cut by the vocabulary's pattern; each pre-token is merged by a rank queue: a hash of
buckets, one per merge rank, holds the positions in a linked list where that merge applies, and a
two-level bitmap of the ranks in use gives the next rank by find-first-set. Entries whose pair
has changed since are skipped when they come up. A pre-token of n bytes costs O(n log n) whatever
its length. Workers remember the tokens of recent pre-tokens in a bounded table.

Defined cases: a null text is empty and has no tokens; repeated rows and extra columns pass
through, except that a column with an output's name is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StructField, StructType

REMEMBERED = 1_200_000
#: As many where a worker has other large tables before and after.
REMEMBERED_IN_STAGES = 250_000
REMEMBERED_BYTES = 64

# classes of the code points below U+0250, for texts that have no others
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r" \t-\r\x85\xa0"
BEYOND = re.compile("[^\x00-ɏ]")
NEAR_PATTERN = re.compile(
    rf" ?[{LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


WORD_BITS = 10


def merge(parts: list, rank_of: Callable) -> list:
    """Apply merges lowest rank first, leftmost first within a rank, until none is left.

    ``parts`` are the symbols (concatenated by ``+``); ``rank_of(a, b)`` gives a pair's rank or None.
    The ranks in use are bits of ``words`` (1024 ranks each), and ``top`` has a bit per word in use.
    """
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [*map(rank_of, parts, parts[1:]), None]
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    for i, r in enumerate(rank):
        if r is not None:
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                word = r >> WORD_BITS
                words[word] = words.get(word, 0) | 1 << (r & 1023)
                top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        least = bits & -bits
        r = word << WORD_BITS | least.bit_length() - 1
        bucket = buckets[r]
        i = heappop(bucket)
        if not bucket:
            del buckets[r]
            words[word] = bits = bits ^ least
            if not bits:
                top ^= 1 << word
        if rank[i] != r:
            continue
        j = after[i]
        parts[i] += parts[j]
        parts[j] = rank[j] = None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        for i in (i, before[i]):
            if i < 0:
                continue
            k = after[i]
            r = rank[i] = rank_of(parts[i], parts[k]) if k < n else None
            if r is None:
                continue
            if r in buckets:
                heappush(buckets[r], i)
            else:
                buckets[r] = [i]
                word = r >> WORD_BITS
                words[word] = words.get(word, 0) | 1 << (r & 1023)
                top |= 1 << word
    return [p for p in parts if p is not None]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PreTokens(dict):
    """Tokens by pre-token, worked out when first asked for; emptied when full."""

    def __init__(self, encode_one: Callable, most: int = REMEMBERED):
        self.encode_one, self.most = encode_one, most

    def __missing__(self, key: str):
        value = self.encode_one(key)
        if len(key) <= REMEMBERED_BYTES:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks = ranks
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            pieces[i] = b
        self.size = np.array([len(b) for b in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.joined = np.frombuffer(b"".join(pieces), np.uint8)
        self.bytes = [bytes([i]) for i in range(256)]
        self.pattern = pattern
        self.known = PreTokens(self.encode_piece, remembered)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        get = self.ranks.get
        merged = merge([self.bytes[b] for b in raw], lambda a, b: get(a + b))
        return tuple(self.ranks[p] for p in merged)

    def split(self, text: str) -> list[str]:
        return NEAR_PATTERN.findall(text) if not BEYOND.search(text) else full_pattern(self.pattern).findall(text)

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, self.split(text))), np.int32)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and where those of each id end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.joined[at], ends


@cache
def full_pattern(pattern: str):
    import regex

    return regex.compile(pattern)


_loaded: dict[tuple, ByteBpe] = {}


def _codec(shared, pattern: str, remembered: int = REMEMBERED) -> ByteBpe:
    """This worker's codec; it outlives the task so that later ones find its pre-tokens."""
    key = (shared.value[0], remembered)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBpe(shared.value[1], pattern, remembered)
    return _loaded[key]


def share_ranks(spark: SparkSession, path: str):
    """The rank table as a broadcast variable; a vocabulary file has a fixed size."""
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast((f"{path}:{len(ranks)}", ranks))


def replace_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), column], [*(batch.schema.names[i] for i in keep), name])


def with_field(schema: StructType, name: str, kind) -> StructType:
    return StructType([*(f for f in schema.fields if f.name.lower() != name.lower()), StructField(name, kind)])


def encode(docs: DataFrame, shared, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add the token ids of a text column as ``array<int>``. Special tokens are ordinary text here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            ids = [codec.encode(t) if t else np.empty(0, np.int32) for t in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield replace_column(batch, out, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    return docs.mapInArrow(run, with_field(docs.schema, out, ArrayType(IntegerType())))


def decode(docs: DataFrame, shared, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that a column of token ids stands for; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            column = batch.column(ids)
            counts = pc.list_value_length(column).fill_null(0).to_numpy()
            raw, ends = codec.decode(column.flatten().to_numpy())
            at = np.append(0, ends)[np.append(0, np.cumsum(counts))].astype(np.int32)
            yield replace_column(batch, out, pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(raw)]))

    return docs.mapInArrow(run, with_field(docs.schema, out, BinaryType()))


def encode_checked(docs: DataFrame, shared, pattern: str, text: str = "text", out: str = "token_ids", same: str = "round_trip") -> DataFrame:
    """As :func:`encode` without the text, and whether the ids decode to it (to nothing, if null).

    One pass, so a task needs one Python worker and the decoded bytes never leave it.
    """
    schema = with_field(with_field(StructType([f for f in docs.schema.fields if f.name != text]), out, ArrayType(IntegerType())), same, BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern, REMEMBERED_IN_STAGES)
        for batch in batches:
            ids, fine = [], []
            for t in batch.column(text):
                t = t.as_py() or ""
                ids.append(codec.encode(t) if t else np.empty(0, np.int32))
                fine.append(codec.decode(ids[-1])[0].tobytes() == t.encode("utf-8", "surrogatepass"))
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            kept = batch.drop_columns([text])
            kept = replace_column(kept, out, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield replace_column(kept, same, pa.array(fine, pa.bool_()))

    return docs.mapInArrow(run, schema)
