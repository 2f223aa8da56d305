"""Chat windows, web pages, vectors and the pipeline."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from phenospark.llm import ann, bpe, chat, htmltext
from phenospark.llm.dom import Dom

TURNS = "conv_id bigint, turn bigint, role string, text string, start string, cell string"


def conversations():
    long = lambda n, s: brute.prose(n, s)
    rows = [(1, 0, "system", "be <s>brief</s>\n"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "<\\/s> \\ <s>"), (2, 0, "user", None)]
    rows += [(3, i, ["user", "assistant"][i % 2], long(300, i)) for i in range(40)]
    rows += [(4, 0, "system", "one"), (4, 1, "system", "two"), (5, 0, None, "x"), (5, None, "user\nodd\\n", "y"), (None, 1, "assistant", "z")]
    rows += [(6, i, ["user", "assistant"][i % 2], long(2500, i)) for i in range(5)] + [(1, 2, "assistant", "<\\/s> \\ <s>")]
    return [(*r, "a", "b") for r in rows]


def test_chat_reads_back_whole(spark):
    rows = conversations()
    windows = chat.chat_windows(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    assert set(got) == set(by)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha("".join(f"{role}\n{t}\n" for *_, role, t in turns))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    longest = windows.where("conv_id = 3").select(F.size(F.split("formatted", r"\s+")).alias("n"), "n_repeated").collect()
    assert len(longest) > 5 and max(r.n for r in longest) <= 2048 and sum(r.n_repeated > 0 for r in longest) == 0
    assert windows.where("conv_id = 1").first().formatted.count("<s>") == 4
    assert chat.digests(chat.chat_windows(spark.createDataFrame([], TURNS))).count() == 0


def test_chat_repeats_history(spark):
    rows = [(1, 0, "system", "sys", "", "")] + [(1, i, ["assistant", "user"][i % 2], brute.prose(40, i), "", "") for i in range(1, 120)]
    windows = chat.chat_windows(spark.createDataFrame(rows, TURNS)).orderBy("window").collect()
    assert len(windows) > 2 and windows[0].n_repeated == 0 and all(w.n_repeated > 2 for w in windows[1:])
    assert all(w.formatted.startswith("<s>system\nsys</s>\n") for w in windows)


def test_chat_windows_hold_the_budget(spark):
    """System turns and history count; only a single turn that is too long goes beyond, and every turn is new once."""
    rows = []
    for conv, (lead, n) in enumerate([(0, 100), (300, 100), (1500, 100), (1900, 40), (5000, 60), (10, 700), (10, 1990)]):
        rows += [(conv, 0, "system", "s " * lead)] if lead else []
        rows += [(conv, i, ["user", "assistant"][i % 2], f"t{i}x " * ((i * 37) % n + 1)) for i in range(1, 60)]
    windows = chat.chat_windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    lead = {r[0]: len(r[3].split()) + 4 for r in rows if r[2] == "system"}
    new = {}
    for w in windows.collect():
        turns = [t.split("\n", 1) for t in w.formatted.split("<s>")[1:]]
        sizes = [len(body.replace("</s>", "").split()) + 4 for role, body in turns if role != "system"]
        assert sum(role == "system" for role, _ in turns) == (w.conv_id in lead)
        assert sum(sizes) + lead.get(w.conv_id, 0) <= 2048 or len(sizes) == 1
        seen = [body.split()[0] for role, body in turns if role != "system"]
        new[w.conv_id, w.window] = seen
    back = chat.digests(windows).collect()
    assert all(r.n_turns == sum(x[0] == r.conv_id for x in rows) for r in back)
    assert sum(len(v) for v in new.values()) > len(rows)  # some history is repeated


def test_chat_reads_odd_roles_back(spark):
    roles = ["a\u0001\u0002b", "\\", "\\n", "x\ny", "\\\n\\\\n", "<s>", "</s>", "<\\/s>\n", "", "\n", "assistant"]
    rows = [(1, i, r, f"text {r}") for i, r in enumerate(roles)]
    (got,) = chat.digests(chat.chat_windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()


PAGE = (
    "<html><body><div class='site-header'>Top</div><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p><b>First  text, with words.<br><p>Second\n one "
    "goes on, and on.</p><div class=ad>Buy</div></article><footer>c</footer></body></html>"
)


def test_pages(spark):
    rows = []
    for i in range(60):
        body = "".join(f"<p>{brute.prose(30 + i % 7, 100 * i + j)}.</p>" for j in range(3 + i % 5))
        rows.append((i, f"<html><body><nav><ul><li><a href=/>{brute.prose(2, i)}</a></li></ul></nav><div class=ad>{brute.prose(5, i)}</div><article><h1>{brute.prose(5, 3 * i)}</h1>{body}</article><footer>{brute.prose(6, i)}</footer></body></html>", "t"))
    rows += [(100, None, "t"), (101, "", "t"), (102, "<!-- only -->", "t"), (103, "plain &lt;text&gt;  here", "t"), (104, PAGE, "t"), (104, PAGE, "t"), (105, "<![bad <p>x", "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    trees = htmltext.fit(pages)
    got = {r.page_id: r.text for r in htmltext.extract(pages, trees).collect()}
    assert got[104] == "A & B\n\nFirst text, with words.\n\nSecond one goes on, and on."
    assert got[100] == got[101] == got[102] == ""
    exact = 0
    for i in range(60):
        dom = Dom(rows[i][1])
        exact += got[i] == "\n\n".join(t for (_, t), k in zip(dom.runs, htmltext.parts_of(dom)) if k)
    assert exact >= 57
    assert htmltext.fit(pages.where("page_id in (100, 101, 102)")) is None
    assert {r.text for r in htmltext.extract(pages.where("page_id = 103"), None).collect()} == {"plain <text> here"}
    assert htmltext.extract(pages.limit(0), trees).count() == 0


def test_decoding_never_keeps_below_a_dropped_node():
    dom = Dom("<div><div><p>a</p><p>b</p></div></div>")
    kept = htmltext.decode(dom, np.array([0.9, 0.9, 0.05, 0.6, 0.01]))
    assert all(kept[dom.parent[i]] or not kept[i] for i in range(1, len(kept)))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    x = np.repeat(centres, 100, axis=0) + 0.4 * rng.standard_normal((3000, 16))
    x[5:900] = x[5]
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    bad = [(5000, None, "e"), (5020, [0.0] * 16, "e"), (5040, [float("nan")] * 16, "e"), (5060, [1.0, None] + [0.0] * 14, "e"), (5080, [float("inf")] * 16, "e")]
    vectors = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, rank string")
    got = ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=20).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 3000, 50))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        scores = np.add.reduce(x * x[q], axis=1)
        want = sorted((i for i in range(3000) if i != q), key=lambda i: (-scores[i], i))[:20]
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in [r.vec_id for r in found]
        assert np.allclose([r.score for r in found], scores[[r.vec_id for r in found]], rtol=1e-12)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(want))
    assert hits >= 0.9 * 20 * len(by)
    few = ann.nearest(vectors.where("vec_id < 5"), vectors.where("vec_id = 0"), k=20)
    assert few.count() == 4
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, rows, no_docs):
    """Each stage against plain Python on its own input; hard and empty tables pass all stages."""
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, "")
    assert kept.columns == docs.columns
    good = [r for r in rows if not (lambda c: c[0] < 50 or 2 * c[4] > c[0])(brute.counts(r[1]))]
    assert {r.doc_id for r in kept.collect()} <= {r[0] for r in good}

    near = stages["n-gram Jaccard join"](spark, docs, "")
    assert near.columns == docs.columns
    want = {(i) for i, n, c in brute.jaccard_components(rows, 5, 80) if i == c}
    assert sorted((r.doc_id for r in near.collect()), key=str) == sorted(want, key=str)

    cut = stages["substring dedup"](spark, docs, "")
    assert cut.columns == docs.columns
    texts = {}
    for (i, n, gone, text), r in zip(brute.without_repeats(rows, 20), rows):
        texts[i] = text if gone else r[1]
    assert {r.doc_id: r.text for r in cut.collect()} == texts

    mixed = stages["source mixing"](spark, docs, "")
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 2 * len(rows)
    assert all(r.round_trip for r in stages["byte-level BPE"](spark, docs, "").collect())

    left = no_docs
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, "")
    assert left.count() == 0


def test_pipeline_run_is_its_stages(spark, docs, rows, tmp_path):
    """run() on a folder gives what the stages give one by one, each written and read again; the
    tokens are the library's and the copies are those of the mix."""
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    left = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = left
        stage(spark, left, folder).write.parquet(f"{folder}/stage_{i}")
        left = spark.read.parquet(f"{folder}/stage_{i}")
    tell = lambda df: sorted((str(r.doc_id), r.n_tokens, tuple(r.token_ids), r.round_trip) for r in df.collect())
    assert tell(corpus_pipeline.run(spark, folder)) == tell(left) and left.count() > 5
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(r.doc_id), tuple(lib.encode_ordinary(r.text or ""))) for r in before.collect())
    assert [(i, t) for i, _, t, _ in tell(left)] == want
    assert set(left.columns) == set(docs.columns) - {"text"} | {"n_tokens", "token_ids", "round_trip"} and all(r.round_trip for r in left.collect())
