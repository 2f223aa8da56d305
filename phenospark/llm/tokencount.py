"""Token counts by whole-token shortcut.

For a vocabulary with word ends, the driver proves once which vocabulary strings encode alone as
one token (it merges each and looks). Workers cut texts into pre-tokens, count those strings
directly, and merge only the rest with the rank queue of :mod:`phenospark.llm.bpe`, remembering
results in a bounded table.

The tokenizer file's own steps are followed: special strings are cut out of the raw text first and
count one each; then NFC, white space to blanks, lower case; then its split pattern. Texts with
code points from U+0250 on go through the library's normaliser and splitter, so that Unicode
details stay its own. Defined cases: a null text is empty; repeated rows and extra columns pass
through, columns with an output's name are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType

from phenospark.llm.bpe import BEYOND, LETTER, NUMBER, SPACE, PreTokens, merge, replace_column, with_field

WORD_END = "</w>"
NEAR_SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Counts tokens as the library does for the given tokenizer file."""

    def __init__(self, source: str, whole: frozenset[str] | None = None):
        model = json.loads(source)
        self.source = source
        self.special = [t["content"] for t in model["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.letters = byte_letters()
        self.vocab = model["model"]["vocab"]
        self.whole = self.prove() if whole is None else whole
        self.known = PreTokens(self.count_piece)
        self._library = None

    def merged(self, stand_ins: str) -> list[str]:
        get = self.ranks.get
        return merge([*stand_ins[:-1], stand_ins[-1] + WORD_END], lambda a, b: get((a, b)))

    def prove(self) -> frozenset[str]:
        """Words (as text) that are one vocabulary string and whose own merges end in just that string."""
        back = {c: b for b, c in self.letters.items()}
        found = set()
        for string in self.vocab:
            word = string.removesuffix(WORD_END)
            if word == string or not word or any(c not in back for c in word) or self.merged(word) != [string]:
                continue
            try:
                found.add(bytes(back[c] for c in word).decode("utf-8"))
            except UnicodeDecodeError:
                pass
        return frozenset(found)

    def count_piece(self, piece: str) -> int:
        if piece in self.whole:
            return 1
        return len(self.merged("".join(map(self.letters.__getitem__, piece.encode("utf-8")))))

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.source)
        return self._library

    def pieces(self, text: str) -> list[str]:
        if not BEYOND.search(text):
            return NEAR_SPLIT.findall(unicodedata.normalize("NFC", text).lower())
        tok = self.library()
        normal = tok.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(normal)]

    def count(self, text: str) -> int:
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        return len(parts) - 1 + sum(sum(map(self.known.__getitem__, self.pieces(part))) for part in parts if part)


_loaded: dict[str, WordBpe] = {}


def share_tokenizer(spark: SparkSession, path: str):
    """Tokenizer file and proven words as a broadcast variable; a vocabulary file has a fixed size."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    return spark.sparkContext.broadcast((path, source, WordBpe(source).whole))


def count_tokens(docs: DataFrame, shared, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of a text column, without begin, end or padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source, whole = shared.value
        if path not in _loaded:
            _loaded.clear()
            _loaded[path] = WordBpe(source, whole)
        model = _loaded[path]
        for batch in batches:
            counts = [model.count(t) if t else 0 for t in batch.column(text).to_pylist()]
            yield replace_column(batch, out, pa.array(counts, pa.int64()))

    return docs.mapInArrow(run, with_field(docs.schema, out, LongType()))
