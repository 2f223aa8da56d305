"""Quality rules judged per document and per host, in DataFrame expressions only.

Every document is measured against a few rules. Failures are then summed per host (a URL's host,
or the source's own name), the host's failure rates are shrunk towards the corpus with a beta prior
fitted to all hosts, and the verdict on the host goes back to its documents: on a host whose rate
is past the limit a document that fails any rule goes, elsewhere one must fail the base rules or
one rule by a wide margin. A clean document stays wherever it comes from.

Defined cases: a null or blank text has no words and fails the base rules; a null source is one
host of its own; repeated rows count as often as they occur; an empty table gives an empty result.
Input columns are kept, and columns of theirs that have an output's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from phenospark.llm.common import bind, unused, words
from phenospark.operators.joins import lookup
from phenospark.runtime import materialize

SYMBOL = r"[#*$%&|<>]"
NON_SPACE = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class QualityRules:
    """Limits. Shares are in percent of words (or of lines), so that all tests are on whole numbers."""

    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbol_pct: int = 20
    gross_symbol_pct: int = 100
    max_dup_line_pct: int = 30
    gross_dup_line_pct: int = 60
    min_word_chars: int = 2
    max_word_chars: int = 12
    host_limit: float = 0.5


def repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the bound array ``ws``.

    The windows' hashes are sorted with their positions; equal neighbours are repeats, and each
    repeat covers three words less the overlap with the next repeat.
    """
    hashes = F.transform(
        F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)),
    )
    placed = lambda hs: F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = lambda s: F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h))
    places = lambda s: F.sort_array(F.transform(repeats(s), lambda x: x.i))
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x,
    )
    # most texts repeat no window, which a hash set tells without the sort
    return bind(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("bigint")).otherwise(
        bind(placed(hs), lambda s: bind(places(s), covered))
    ))


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words (all long)."""
    outs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in outs))
    w, l = unused(docs, "of_words", "of_lines")
    long = lambda c, name: c.cast("bigint").alias(name)
    has_word = lambda x: F.rlike(x, F.lit(NON_SPACE))
    of_words = bind(words(text), lambda ws: F.struct(
        long(F.size(ws), "n_words"), long(F.length(F.array_join(ws, "")), "word_chars"), repeat_words(ws).alias("n_repeat_words"),
    ))
    of_lines = lambda body: bind(
        F.filter(F.split(body, "\n"), has_word),
        lambda ls: F.struct(long(F.size(ls) - F.size(F.array_distinct(ls)), "n_dup_lines"), long(F.size(ls), "n_lines")),
    )
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    symbols = F.size(F.regexp_extract_all(body, F.lit(SYMBOL), F.lit(0)))
    docs = docs.withColumns({w: of_words, l: of_lines(body)})
    rest = [x for x in docs.columns if x not in (w, l)]
    return docs.select(
        *rest, f"{w}.n_words", f"{w}.word_chars", long(symbols, "n_symbols"), f"{l}.n_dup_lines", f"{l}.n_lines", f"{w}.n_repeat_words"
    )


def _failures(r: QualityRules) -> dict[str, Column]:
    n, lines = F.col("n_words"), F.col("n_lines")
    return {
        "base": (n < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_pct * n),
        "symbols": 100 * F.col("n_symbols") > r.max_symbol_pct * n,
        "lines": 100 * F.col("n_dup_lines") > r.max_dup_line_pct * lines,
        "shape": (F.col("word_chars") < r.min_word_chars * n) | (F.col("word_chars") > r.max_word_chars * n),
        "gross": (100 * F.col("n_symbols") > r.gross_symbol_pct * n)
        | (100 * F.col("n_dup_lines") > r.gross_dup_line_pct * lines),
    }


def host_of(source: str) -> Column:
    """The lower-case host of a URL, else the source's own name; null stays null."""
    host = F.lower(F.regexp_extract(F.col(source), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(host) > 0, host).otherwise(F.col(source))


def host_verdicts(judged: DataFrame, host: str, failed: str, limit: float) -> DataFrame:
    """One row per host: n_docs, n_failed, host_rate (shrunk) and host_failed.

    The prior Beta(a, b) has the mean of all documents and the between-host variance left after
    taking off the binomial part (method of moments). Documents are summed before they shuffle, so
    a host with a third of them costs one partial row per task.
    """
    hosts = judged.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("bigint")).alias("n_failed"))
    hosts = materialize(hosts, "hosts")
    p = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("k"), F.count(F.lit(1)).alias("h"),
        F.sum(F.col("n_docs") * p * p).alias("pp"),
    ).first()
    mean, weight = beta_prior(total.n or 0, total.k or 0, total.h, total.pp or 0.0)
    rate = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.select(host, "n_docs", "n_failed", rate.alias("host_rate"), (rate > limit).alias("host_failed"))


def beta_prior(n: int, k: int, hosts: int, pp: float) -> tuple[float, float]:
    """Mean and weight (in documents) of the prior, from n documents with k failures on so many hosts.

    ``pp`` is the sum over hosts of documents times squared rate. The weight goes from 2 (hosts
    differ widely) to 1000 (they are alike).
    """
    if not n:
        return 0.0, 1000.0
    mean = k / n
    between = pp / n - mean * mean - mean * (1 - mean) * hosts / n
    if between <= 0:
        return mean, 1000.0
    return mean, min(max(mean * (1 - mean) / between - 1, 2.0), 1000.0)


def judge(measured: DataFrame, rules: QualityRules = QualityRules(), source: str = "source") -> DataFrame:
    """Add base_failed, host_failed and kept to documents that have their counts.

    ``measured`` is read twice (for hosts, then for documents). The verdicts go to the documents if
    their number is small; otherwise both are dealt by host, large hosts in pieces.
    """
    outs = ("base_failed", "host_failed", "kept")
    measured = measured.drop(*(c for c in measured.columns if c.lower() in outs))
    (host, any_failed, gross, no_host) = unused(measured, "host", "any_failed", "gross", "no_host")
    failures = _failures(rules)
    judged = measured.withColumns({
        host: host_of(source),
        "base_failed": failures["base"],
        any_failed: failures["base"] | failures["symbols"] | failures["lines"] | failures["shape"],
        gross: failures["gross"],
    })
    # joins drop null keys
    apart = {no_host: F.col(host).isNull(), host: F.coalesce(host, F.lit(""))}
    verdicts = materialize(host_verdicts(judged, host, any_failed, rules.host_limit), "verdicts")
    verdicts = verdicts.withColumns(apart).select(host, no_host, "host_failed")
    kept = ~F.col("base_failed") & ~F.col(gross) & ~(F.col("host_failed") & F.col(any_failed))
    joined = lookup(judged.withColumns(apart), verdicts, [host, no_host], rows=verdicts.count(), row_bytes=96)
    return joined.select(*measured.columns, "base_failed", "host_failed", kept.alias("kept"))


def quality_filter(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", source: str = "source") -> DataFrame:
    """Measure and judge every document; all input columns stay."""
    return judge(materialize(rule_counts(docs, text), "measured"), rules, source)
