"""Operators on documents against plain Python, on a table of hard cases and on an empty one."""

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from compare import connect, differences
from phenospark.llm import bpe, jaccard, mixing, oracle, quality, queries, substrings, tokencount, toxicity


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("n, pct", [(4, 85), (5, 80)])
def test_jaccard_components(docs, rows, n, pct):
    got = jaccard.similar_components(docs, n, pct).collect()
    assert order(map(tuple, got)) == order(brute.jaccard_components(rows, n, pct))


def test_jaccard_in_stars_and_blocks(docs, rows, monkeypatch):
    """Every tile takes the two-round way and is cut into blocks."""
    monkeypatch.setattr(jaccard, "STAR_FROM", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    got = jaccard.similar_components(docs, 4, 85).collect()
    assert order(map(tuple, got)) == order(brute.jaccard_components(rows, 4, 85))


@pytest.mark.parametrize("slots", [1, 1 << 12])
def test_repeats(docs, rows, slots, monkeypatch):
    monkeypatch.setattr(substrings, "SLOTS", slots)
    got = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert order(map(tuple, got)) == order(brute.without_repeats(rows, 20))


def test_quality_counts(docs, rows):
    got = quality.quality_filter(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert got.dtypes[got.columns.index("n_words")][1] == "bigint"
    have = order((r.text, *(r[c] for c in names)) for r in got.collect())
    assert have == order((r[1], *brute.counts(r[1])) for r in rows)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_host_verdict_spares_clean_documents(spark):
    clean = brute.prose(80, 50)
    rows = [(i, clean + f" {i}" if i % 10 == 0 else " ".join(["#"] * 20 + ["word"] * 3 + [brute.prose(60, i)]), "bad") for i in range(100)]
    rows += [(1000 + i, brute.prose(80, 200 + i), "good") for i in range(100)] + [(2000, "# " * 20 + brute.prose(60, 999), "good")]
    got = {r.doc_id: r for r in quality.quality_filter(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got[1].host_failed and not got[1].kept and got[10].kept
    assert not got[2000].host_failed and got[2000].kept


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.WORD.findall(r[1] or ""))
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in target]
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
    target |= {s: weight[s] * level for s in names if s not in target}
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 2
    again = mixing.mix_sources(docs).collect()
    assert order((r.doc_id, r["size"], r.copies) for r in got) == order((r.doc_id, r["size"], r.copies) for r in again)
    assert mixing.emit(mixing.mix_sources(docs)).count() == sum(r.copies for r in got)


def test_mixing_comes_near_its_targets(spark):
    made = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source")
    )
    f = F.col("target") / F.col("source_size") - F.floor(F.col("target") / F.col("source_size"))
    sums = mixing.mix_sources(made).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.sum(f * (1 - f) * F.col("size") * F.col("size")).alias("var"))
    for r in sums.collect():
        assert abs(r.taken - r.target) <= 4 * r["var"] ** 0.5 + 1e-6


def test_mixing_walks_to_its_targets(spark):
    """Documents of one size, some without a key and all equal: a chunk's copies miss its share by less than one."""
    made = spark.range(9000).select(
        F.when(F.col("id") % 9 > 2, F.col("id")).alias("doc_id"), F.lit("six words are in this text").alias("text"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("source"))
    mixed = mixing.mix_sources(made)
    sums = mixed.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most"), F.count("*").alias("n"))
    for r in sums.collect():
        assert r.n == 3000 and r.most <= 2 and abs(r.taken - r.target) < 6
    equal = mixed.where("doc_id IS NULL AND source = 's2'").groupBy("copies").count().collect()
    assert len(equal) == 2 and sum(r["count"] for r in equal) == 1000


def test_mixing_reruns_agree_however_rows_lie(spark):
    """Null, equal and repeated keys; another order and split of the rows gives the same copies."""
    rows = [(None if i % 3 == 0 else i % 40, brute.prose(i % 30, i % 50) if i % 7 else None, ["a", "b", "c", None][i % 4], "x", "y", "z") for i in range(600)]
    schema = "doc_id bigint, text string, source string, mix_name string, rate string, copies string"
    tell = lambda df: sorted(map(str, mixing.mix_sources(df).collect()))
    first = tell(spark.createDataFrame(rows, schema).repartition(3))
    assert first == tell(spark.createDataFrame(rows[::-1], schema).repartition(7)) == tell(spark.createDataFrame(rows, schema).orderBy("text").coalesce(1))
    assert len(first) == 600
    plan = mixing.mix_sources(spark.createDataFrame(rows, schema))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_document_queries_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    duck = connect(folder)
    for name in ("op1_ngram_jaccard", "op3_quality_rules", "op4_mix_sources", "op7_substring_dedup", "op8_chat_windows"):
        found = differences(queries.QUERIES[name](spark, folder), duck, oracle.ORACLE_SQL[name])
        assert not [d for d in found if not d.startswith("note")], name


def test_byte_bpe_is_the_librarys(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    shared = bpe.share_ranks(spark, path)
    encoded = bpe.encode(docs, shared, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in bpe.decode(encoded, shared, public_tokenizers.PATTERN).collect():
        assert r.token_ids == lib.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_long_pretokens_merge_as_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    for text in ("a" * 5000, "ab" * 3000, "x!" + "=" * 999, brute.prose(900, 4).replace(" ", ""), "日本語" * 500):
        assert own.encode(text).tolist() == lib.encode_ordinary(text)


def test_token_counts_are_the_librarys(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    extra = spark.createDataFrame([("<|endoftext|>it's<|startoftext|> İ é ǅ",), ("<|ENDOFTEXT|> 123",)], "text string")
    lib = Tokenizer.from_file(path)
    for r in tokencount.count_tokens(docs.select("text").unionByName(extra), tokencount.share_tokenizer(spark, path)).collect():
        assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids)


def test_toxicity_learns_and_leaves_the_fold_out(spark):
    rows = [(i, brute.prose(60, 5000 + i) + (" vile zorgon of nasty xquuvy" if i % 3 == 0 else "") + " " + brute.prose(20, 9000 + i)) for i in range(400)]
    docs = spark.createDataFrame(rows + [(None, None), (401, "")], "doc_id bigint, text string")
    # labels of the held-out fold are all wrong and must not matter
    labels = docs.where("doc_id < 400").select("doc_id", F.when(toxicity.held_out(F.col("doc_id")), F.col("doc_id") % 3 != 0).otherwise(F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r.out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 50 and sum((r.score >= 0.3) == (r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in scored)
    assert all(r.score < 1e-9 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect())


def test_empty_tables(spark, no_docs):
    assert jaccard.similar_components(no_docs).count() == 0
    assert substrings.remove_repeats(no_docs).count() == 0
    assert quality.quality_filter(no_docs).count() == 0
    assert mixing.mix_sources(no_docs).count() == 0
    shared = bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(no_docs, shared, public_tokenizers.PATTERN)
    assert bpe.decode(encoded, shared, public_tokenizers.PATTERN).count() == 0
    assert tokencount.count_tokens(no_docs, tokencount.share_tokenizer(spark, public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def test_toxicity_on_the_held_out_fold(spark):
    """Ranking and threshold on labelled documents no training saw."""
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").collect()}
    rows = queries.op10_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [s for s, t, _ in held if t], [s for s, t, _ in held if not t]
    assert len(bad) > 100
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc >= 0.95
    assert sum(p for _, t, p in held if t) >= 0.75 * len(bad) and sum(p for _, t, p in held if not t) <= 0.03 * len(good)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_of_hard_tables(spark):
    """Clashing columns, very long texts, repeated labels and rows, null keys; equal texts score alike."""
    rows = [(i, brute.prose(40, i) + (" grumblefex zorgonite" if i % 2 else ""), "old", "a", "b") for i in range(120)]
    rows += [(500, "grumblefex zorgonite " * 30_000, "", "", ""), (None, "grumblefex zorgonite", "", "", ""), (501, None, "", "", ""), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, h string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] * 2 + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model)
    assert sorted(found.columns) == sorted(docs.columns) and dict(found.dtypes)["score"] == "double"
    got = found.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.text, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values())
    assert by["grumblefex zorgonite"].pop() > 0.5 and by[rows[120][1]].pop() > 0.5
    again = toxicity.fit(docs.repartition(7), labels)
    assert (again.weights == model.weights).all() and again.bias == model.bias
