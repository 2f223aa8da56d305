"""Language identification, conversation repair and whitening against plain Python."""

import hashlib
import heapq
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import brute
from compare import connect, differences
from phenospark.llm import langid, oracle, queries, repair, whitening

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ---- conversation repair ------------------------------------------------------------------------

def plain_audit(rows):
    """Cheapest, least audit of (initial, fault) rows by uniform-cost search, inserts included."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    queue, done = [(0, "", 0, 0)], set()
    while queue:
        cost, audit, i, q = heapq.heappop(queue)
        if i == len(rows) and q in (0, 3):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        other = 3 if q == 2 else 2
        heapq.heappush(queue, (cost + 5, audit + "I", i, other))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, q))
            extra = 5 if fault == "truncated" else 0
            if fault in ("", "truncated"):
                if initial in step[q]:
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, step[q][initial]))
                heapq.heappush(queue, (cost + extra + 1, audit + "R", i + 1, other))


def plain_repair(rows):
    """All columns of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    cost, audit = plain_audit([(r[:1], f) for (_, r, _), f in zip(rows, faults)])
    out, i, want = [], 0, "user"
    for edit in audit:
        if edit in "KRI":
            role = rows[i][1] if edit == "K" else want
            out.append(f"{role}:{'' if edit == 'I' else rows[i][2]}")
            want = "assistant" if role[0] == "u" else "user"
        i += edit != "I"
    turns = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"), "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


TURNS = "conv_id bigint, turn bigint, role string, text string, audit string, key string, c string"


def faulty_conversations():
    rnd = random.Random(5)
    texts = ["Yes.", "No!", "So?", "cut off", "", " \t", None, "Stop. ", "tail.\x0b\r\n", "日本.", "a\tb."]
    roles = ["user", "assistant", "system", "u", "agent", "tool", "", None]
    rows = []
    for conv in range(150):
        for i in range(rnd.randrange(1, 12)):
            role = rnd.choice(roles[:2]) if rnd.random() < 0.7 else rnd.choice(roles)
            text = f"{rnd.random()}." if rnd.random() < 0.6 else rnd.choice(texts)
            rows.append((conv, rnd.choice([None, i, i, i, i + 3, 2]), role, text))
    rows += rows[:5]
    rows += [(None, 1, "user", "who."), (None, None, "assistant", "me."), (-(1 << 63), 1 << 62, "user", "far."), (-(1 << 63), -(1 << 62), "assistant", "off.")]
    rows += [(500, i, ["user", "assistant"][i % 2], "long " * 40_000 + "end.") for i in range(4)]
    # hot: many rows of one conversation, of one turn, and of one text
    rows += [(600, i, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["x.", "cut", "", f"{i}."])) for i in range(4000)]
    rows += [(601, 7, "user", f"{rnd.random()}.") for i in range(1500)] + [(602, i, "user", "same.") for i in range(1500)] + [(603, 1, "assistant", "equal.")] * 1300
    rows += [(604, i, "user", f"{i}.") for i in range(2500)]
    return rows


def expected(rows):
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    return {conv: plain_repair(held) for conv, held in by.items()}


@pytest.fixture(scope="module")
def repaired(spark):
    rows = faulty_conversations()
    turns = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS).repartition(5)
    return rows, repair.repair(turns)


def test_repair_is_cheapest_and_least(repaired):
    rows, found = repaired
    want = expected(rows)
    got = found.conversations.collect()
    assert len(got) == len(want)
    for r in got:
        fine = {k: r[k] for k in want[r.conv_id] if k != "gaps"} | {"gaps": r.gaps}
        assert fine == want[r.conv_id] | {"gaps": min(want[r.conv_id]["gaps"], (1 << 63) - 1)}, r.conv_id


def test_repaired_rows_give_the_hash(repaired):
    _, found = repaired
    order = F.struct("pid", "run", "position", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = found.turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("l"))
    again = {r.conv_id: hashlib.sha256("\n".join(x.line for x in r.l).encode()).hexdigest() for r in lines.collect()}
    for r in found.conversations.collect():
        assert again.get(r.conv_id, hashlib.sha256(b"").hexdigest()) == r.repaired_sha256


def test_long_conversations_are_cut_into_runs(repaired):
    _, found = repaired
    runs = {r["conv_id"]: r["n"] for r in found.runs.groupBy("conv_id").agg(F.count("*").alias("n")).collect()}
    assert runs[600] >= 4 and runs[603] >= 2 and runs[0] == 1


def test_search_against_uniform_cost_search():
    rnd = random.Random(2)
    names = {"": repair.FINE, "truncated": repair.CUT, "blank": repair.GONE}
    for _ in range(400):
        rows = [(rnd.choice(["u", "a", "s", "t", " ", ""]), rnd.choice(["", "", "truncated", "blank"])) for _ in range(rnd.randrange(0, 9))]
        mine = [(a, names[f]) for a, f in rows]
        best = min(c for c in (repair.cheapest(mine, 0, q, {}) for q in repair.WHOLE) if c)
        assert best == plain_audit(rows)


def test_damage_and_dropped_conversations(spark):
    rows = [(c, t, r, x) for c in range(60) for t, (r, x) in enumerate([("system", "Be brief."), ("user", "a?"), ("assistant", None), (None, "b.")])]
    rows += [(c, 0, "user", "only.") for c in range(100, 400)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    left = []
    for c, t, r, x in rows:
        kind, r, x = zlib.crc32(f"{c}:{t}".encode()) % 20, " " if r is None else r, " " if x is None else x
        row = {1: (c, t, r, ""), 2: (c, t, r, x.replace(".", "").replace("!", "").replace("?", "")), 4: (c, t, "user", x)}.get(kind, (c, t, r, x))
        left += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = expected(left)
    got = {r.conv_id: r for r in repair.repair(repair.damage(turns)).conversations.collect()}
    assert set(got) == {r[0] for r in rows} and len(set(got) - set(want)) > 5
    for c, r in got.items():
        if c in want:
            assert {k: r[k] for k in want[c]} == want[c]
        else:
            assert (r.cost, r.gaps, r.illegal, r.audit, r.repaired_sha256) == (0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(repair.damage(turns.limit(0))).conversations.count() == 0


def test_repair_query_equals_sql(spark):
    found = differences(queries.op12_conversation_repair(spark, SMALL), connect(SMALL), oracle.ORACLE_SQL["op12_conversation_repair"])
    assert not [d for d in found if not d.startswith("note")]


# ---- language identification --------------------------------------------------------------------

def test_languages_on_held_out_documents(spark):
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op11_language_id(spark, MIDDLE).collect()
    assert len(rows) == len(true)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == true[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    # narrow margins are where the errors are
    wrong = [r for r in held if r.lang_pred != true[r.doc_id]]
    assert sum(r.rejected for r in held) <= 0.03 * len(held)
    assert np.mean([r.score for r in wrong] or [0]) < np.mean([r.score for r in held])


WORDS = {"xx": "alpha bravo carrot delta ember", "yy": "quux zwölf jäger über straße", "zz": "дом река лес гора поле"}


def test_language_cases(spark):
    rnd = random.Random(1)
    text = lambda g, n: " ".join(rnd.choices(WORDS[g].split(), k=n))
    rows = [(text(g, 60), g, "s", "p") for g in WORDS for _ in range(30)]
    rows += [(None, "xx", "", ""), ("12 3 !", "yy", "", ""), ("no label", None, "", ""), ("", "zz", "", "")] + rows[:3]
    schema = "text string, lang string, score string, margin string"
    train = spark.createDataFrame(rows, schema)
    languages = langid.fit(train)
    assert list(languages.content) == ["xx", "yy", "zz"]  # xx has more rows; then by name
    cases = [(text(g, n), g, "old", "m") for g in WORDS for n in (4, 20, 3000)]
    cases += [(None, "und", "", ""), ("", "und", "", ""), (" 12,5 \t#$", "und", "", ""), ("x" * 300_000, None, "", ""), (text("yy", 30), "yy", "", "")] * 2
    docs = spark.createDataFrame(cases, schema)
    found = langid.identify(docs, languages)
    assert found.columns == ["text", "lang", "lang_pred", "score", "margin", "rejected"]
    got = found.collect()
    assert len(got) == len(cases)
    for r in got:
        assert r.lang is None or r.lang_pred == r.lang
        if r.lang_pred == "und":
            assert (r.score, r.rejected) == (0.0, True)
    # the same by plain compression
    plain = {g: zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for g, c in languages.content.items()}
    for r in got:
        words = "".join(ch if ch.isalpha() else " " for ch in (r.text or "").lower()).split()
        if words:
            raw = " ".join(words).encode()
            size = {g: sum(len(zstandard.ZstdCompressor(
                dict_data=d, level=langid.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw[i : i + langid.BLOCK]))
                for i in range(0, len(raw), langid.BLOCK)) for g, d in plain.items()}
            ranked = sorted(size.values())
            # dictionaries prepared beforehand may be searched a little differently
            assert abs(size[r.lang_pred] - ranked[0]) <= 0.02 * ranked[0] + 2
    assert langid.identify(docs.limit(0), languages).count() == 0
    nothing = langid.fit(train.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, nothing).collect()} == {("und", 0.0)}
    one = langid.fit(train.where("lang = 'xx'"))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs.where("lang = 'yy'"), one).collect()} == {("xx", 1.0)}


def test_rejects_texts_between_languages(spark):
    docs = spark.createDataFrame([(WORDS["xx"] * 20, "xx"), (WORDS["yy"] * 20, "yy")], "text string, lang string")
    languages = langid.fit(docs)
    between = spark.createDataFrame([("qqq",), (WORDS["xx"] + " " + WORDS["xx"],)], "text string")
    got = {r.text: r.rejected for r in langid.identify(between, languages).collect()}
    assert got == {"qqq": True, WORDS["xx"] + " " + WORDS["xx"]: False}


# ---- whitening ----------------------------------------------------------------------------------

def plain_whitening(x):
    """Covariance of whole numbers by exact fractions, and what follows from it."""
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    cov = np.array([[float(Fraction(sum((n * r[j] - s[j]) * (n * r[k] - s[k]) for r in x), n**3)) for k in range(d)] for j in range(d)])
    values, vectors = np.linalg.eigh(cov)
    return n, s, cov, values[::-1], vectors[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(4)
    c = (rng.standard_normal((300, 10)) * np.arange(1, 11) ** 1.5 + 3).astype(np.float32)
    c[100:180] = c[100]
    rows = [(i, v.tolist(), "n", "e") for i, v in enumerate(c)]
    bad = [(900, None, "", ""), (901, [], "", ""), (902, [float("nan")] * 10, "", ""), (903, [None] + [1.0] * 9, "", ""), (904, [float("inf")] * 10, "", ""), (905, [1.0, 2.0], "", "")]
    table = spark.createDataFrame(rows + bad + rows[:1], "vec_id bigint, embedding array<float>, n string, extra string").repartition(3)
    x = [[int(np.floor(float(e) * 1024)) + 100_000 for e in v] for v in c.tolist() + c[:1].tolist()]
    n, s, cov, values, vectors = plain_whitening(x)
    got = whitening.whiten(table).collect()
    assert sorted({r.vec_id for r in got}) == list(range(300)) and len(got) == 8 * 301
    y = np.array([[e - t / n for e, t in zip(r, s)] for r in x])
    sign = {}
    for r in got:
        i, j = r.vec_id, r.component - 1
        assert r.n == 301 and r.extra == "e"
        assert int(r.deviation) == sum((n * e - t) ** 2 for e, t in zip(x[i], s))
        want = y[i] @ vectors[:, j] / np.sqrt(values[j])
        at = sign.setdefault(j, 1.0 if abs(r.whitened - want) < abs(r.whitened + want) else -1.0)
        assert abs(at * r.whitened - want) < 1e-8
        assert abs(r.explained - values[j] / np.trace(cov)) < 1e-12 and r.identity_error < 1e-9
    assert whitening.whiten(table.limit(0)).columns == ["vec_id", "extra", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(table.where("vec_id >= 900")).select("vec_id").distinct().count() == 1


def test_whitening_without_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert {round(r.explained, 12) for r in got if r.component == 1} == {1.0} and {r.explained for r in got if r.component > 1} == {0.0}
    one = whitening.whiten(spark.createDataFrame(rows[:1], "vec_id bigint, embedding array<double>")).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.identity_error) for r in one] == [(1, 0, None, 0.0)] * 3


def test_whitening_of_large_entries_is_exact(spark):
    c = [[1e18, -3e17, 2.5], [4e18, 1e17, 7.25], [2e18, 5e17, -1.5], [3e18, 0.0, 0.0]]
    got = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(c)], "vec_id bigint, embedding array<double>")).collect()
    x = [[int(Fraction(e) * 1024 // 1) + 100_000 for e in v] for v in c]
    s = [sum(r[j] for r in x) for j in range(3)]
    far = {i: sum((4 * e - t) ** 2 for e, t in zip(r, s)) for i, r in enumerate(x)}
    for r in got:
        assert r.deviation is None if far[r.vec_id] >= 10**38 else int(r.deviation) == far[r.vec_id]


def test_whitening_query(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = np.array([[int(np.floor(float(e) * 1024)) + 100_000 for e in r.embedding] for r in vectors])
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    values = np.linalg.eigvalsh((y / n).T @ (y / n) / n)[::-1]
    got = queries.op13_whitening(spark, SMALL).collect()
    assert len(got) == 8 * n and dict(queries.op13_whitening(spark, SMALL).dtypes)["deviation"] == "bigint"
    far = {r.vec_id: int((y[i].astype(object) ** 2).sum()) for i, r in enumerate(vectors)}
    assert all(r.deviation == far[r.vec_id] and r.identity_error < 1e-8 for r in got)
    assert np.allclose(sorted({r.explained for r in got}, reverse=True), values[:8] / values.sum(), rtol=1e-9)
    w = np.array([[r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]]).reshape(n, 8)
    assert np.abs(w.T @ w / n - np.eye(8)).max() < 1e-8
