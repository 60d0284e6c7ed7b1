"""Quality classifier, language model, page text: held-out accuracy and exact counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passforge.llm import attention, dom, htmltext, lmscore, quality
from llm_docs import awkward, empty, frame

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([g.predicted == q for g, q in held]) > 0.97
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (999, 0), (2, 0)], "doc_id long, quality int")
    rows = quality.score(frame(spark), labels).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    none = quality.score(frame(spark), labels.filter("quality = 1")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(empty(spark), labels).count() == 0
    assert set(quality.keep_good(frame(spark), labels).columns) == set(frame(spark).columns)


def test_bradley_terry_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, quality.N_FEATURES))
    true = rng.standard_normal(quality.N_FEATURES)
    good = x @ true > -1
    model = quality.fit(x[:400], good[:400])
    assert ((model.score(x[400:]) >= 0.5) == good[400:]).mean() > 0.95


def numeric_gradient(model, args, name, at, eps=1e-3):
    keep = model.p[name][at]
    out = []
    for d in (eps, -eps):
        model.p[name][at] = keep + d
        out.append(model._gradients(*args)[0])
    model.p[name][at] = keep
    return (out[0] - out[1]) / (2 * eps)


def test_attention_gradients_and_single_scoring():
    rng = np.random.default_rng(0)
    model = attention.Attention(4, 5, dim=6, hidden=7)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    lengths = np.array([3, 40, 17])
    starts = np.cumsum(lengths) - lengths
    ids, goal = rng.integers(0, 20, 60), rng.integers(0, 20, 60)
    place, ok, scored = attention.windows(ids, starts, lengths)
    assert sorted(place[:, attention.STRIDE:][scored]) == list(range(60))  # every position once
    args = (ids[place], ok, scored, goal[place[:, attention.STRIDE:][scored]])
    _, g = model._gradients(*args)
    for name in model.p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in model.p[name].shape)
            assert g[name][at] == pytest.approx(numeric_gradient(model, args, name, at), abs=1e-4)


def test_attention_is_causal_and_normalised():
    model = attention.Attention(4, 5, dim=6, hidden=7)
    ids = np.random.default_rng(1).integers(0, 20, 50)
    one = (np.array([0]), np.array([50]))
    goal = np.roll(ids, -1)
    lp = model.log_probs(ids, *one, goal)
    changed = ids.copy()
    changed[30:] = (changed[30:] + 7) % 20
    assert np.allclose(model.log_probs(changed, *one, goal)[:30], lp[:30], atol=1e-5)
    total = sum(np.exp(model.log_probs(ids, *one, np.full(50, k))) for k in range(20))
    assert np.allclose(total, 1, atol=1e-4)


@pytest.mark.parametrize("hot", [10, 100_000])  # most words by the join, or none
def test_lm_scores(spark, hot):
    rows = lmscore.score(frame(spark), hot_words=hot).collect()
    docs = Counter()
    words = {}
    for i, t, *_ in awkward():
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [b""]
        words[(i, len(w))] = w
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            docs.update(w)
    n, v = sum(docs.values()), len(docs)
    assert len(rows) == len(awkward())
    for r in rows:
        w = words[(r.doc_id, r.n_tokens)]
        assert r.train_tokens == n and r.n_known == sum(x in docs for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((docs[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0 and r.score >= r.base_score + len(w) * math.log10(1 - lmscore.MIX) - 1e-6
    assert lmscore.score(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [10, 100_000])
def test_lm_score_is_the_mixture_of_every_token(spark, monkeypatch, hot):
    monkeypatch.setattr(lmscore, "train_everywhere", lambda *a: 0)  # start weights, the same here and there
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["the", "cat", f"rare{rng.randrange(10**6)}", "Naïve", "x" * 30]) for _ in range(rng.choice([0, 1, 7, 90])))
             for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in lmscore.score(df, hot_words=hot).collect()}
    words = [[*lmscore.words_of(t), b""] for t in texts]
    counts = Counter(w for i, ws in enumerate(words) if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    learnt = lmscore.word_counts(df.filter("crc32(cast(doc_id as string)) % 7 != 2").select("text")).withColumn("h", F.lit(0))
    cutter = lmscore.choose_pieces(learnt, lmscore.bpe.vocabulary_path())
    scorer = lmscore.Scorer(attention.Attention(lmscore.CLASSES, lmscore.WIDTH), cutter, {}, n, v)
    for i, ws in enumerate(words):
        lp = scorer.score([ws])[0]
        want = sum(math.log10(lmscore.MIX * 10**x + (1 - lmscore.MIX) * (counts[w] + 1) / (n + v + 1)) for x, w in zip(lp, ws, strict=True))
        assert rows[i].score == pytest.approx(want, rel=1e-5)


def test_lm_beats_the_base_on_held_out(spark):
    rows = [r for r in lmscore.score(spark.read.parquet(f"{SF}/documents.parquet"), passes=6).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_learns_past_a_very_long_text(spark):
    line = " ".join(["the cat sat on the mat while a dog ran over green hills"] * 30)
    rows = [(0, "yes no " * 350_000)] + [(i, line) for i in range(1, 150)]
    got = lmscore.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r.held_out]
    assert zlib.crc32(b"0") % 7 != 2 and len(held) > 5
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_trains_on_every_row_and_counts_pieces_of_all_words(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(rng.choice([0, 1, 40]))) for _ in range(3000)]
    texts[7] = " ".join(f"long{i}" for i in range(45_000))  # in sections
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = lmscore.word_counts(df.select("text"))
    path = lmscore.bpe.vocabulary_path()
    codec, want = lmscore.bpe.codec_for(path), Counter()
    for t in texts:
        for w in lmscore.words_of(t):
            ids = codec.merge_bytes(w)
            want.update([(i, -1) for i in ids] + list(zip(ids, ids[1:])))
    assert {(r.a, r.b): r.n for r in lmscore.piece_counts(counts, path).collect()} == want
    cutter = lmscore.choose_pieces(counts, path)
    pieces = sum(len(cutter.cut(w)) for t in texts for w in lmscore.words_of(t)) + len(texts)
    monkeypatch.setattr(attention.Attention, "_gradients", lambda self, *a: (0.0, {k: np.zeros_like(v) for k, v in self.p.items()}))
    for passes in (1, 2):
        model = attention.Attention(lmscore.CLASSES, lmscore.WIDTH)
        assert lmscore.train_everywhere(df, model, cutter, len(texts), 10**5, passes) == passes * pieces


def test_attention_with_large_numbers():
    rng = np.random.default_rng(4)
    model = attention.Attention(4, 5, dim=6, hidden=7)
    ids, goal, one = rng.integers(0, 20, 50), rng.integers(0, 20, 50), (np.array([0, 33]), np.array([33, 17]))
    for name, factor in (("wq", 3000), ("b1", 0), ("w1", 2000), ("w2", 2000)):
        model.p[name] = (model.p[name] + (name == "b1") * 90) * np.float32(factor or 1)
    got = model.log_probs(ids, *one, goal)
    assert np.isfinite(got).all() and got.min() < -100
    p = {k: v.astype(float) for k, v in model.p.items()}
    for start, n in zip(*one, strict=True):
        for t in range(n):
            seen = np.arange(max(0, t // attention.STRIDE - 1) * attention.STRIDE, t + 1)
            e = p["emb"][ids[start + seen]]
            w = e @ p["wk"] @ (p["emb"][ids[start + t]] @ p["wq"]) / math.sqrt(6) + p["near"][t - seen]
            w = np.exp(w - w.max())
            h = np.tanh(np.concatenate([e[-1], w / w.sum() @ (e @ p["wv"])]) @ p["wh"] + p["bh"])
            c, i = divmod(goal[start + t], 5)
            want = 0.0
            for z, k in ((h @ p["w1"] + p["b1"], c), (h @ p["w2"][c] + p["b2"][c], i)):
                want += z[k] - z.max() - math.log(np.exp(z - z.max()).sum())
            assert got[start + t] == pytest.approx(want, rel=1e-2, abs=0.1)
    place, ok, scored = attention.windows(ids, *one)
    loss, g = model._gradients(ids[place], ok, scored, goal[place[:, attention.STRIDE:][scored]])
    assert loss == pytest.approx(-got.mean(), rel=1e-4) and all(np.isfinite(x).all() for x in g.values())


def test_words_are_cut_and_merged_together():
    rng = random.Random(8)
    codec = lmscore.bpe.codec_for(lmscore.bpe.vocabulary_path())
    words = [bytes(rng.choice(b"aehnrst\xc3\xa9\x00\xff") for _ in range(rng.choice([1, 2, 5, 9, 64, 65, 200]))) for _ in range(500)]
    done = {}
    for own, ids, ends in codec.merge_words(words):
        for r, a, b in zip(own.tolist(), [0, *ends], ends):
            done[r] = ids[a:b].tolist()
    assert {r: codec.merge_bytes(words[r]) for r in done} == done
    assert [r for r, w in enumerate(words) if codec.alone(w)] == [r for r in range(len(words)) if r not in done]
    pieces = [b"a", b"he", b"hen", b"r", b"st", b"\xc3\xa9", b"nrst"]
    for cutter in (lmscore.Cutter({x: i + 2 for i, x in enumerate(pieces)}, {x: i + 20 for i, x in enumerate(pieces[1:])}), lmscore.Cutter({}, {})):
        one_by_one = [cutter.cut(w) for w in [b"", *words]]
        cut, n = cutter.cut_many([b"", *words])
        assert n.tolist() == [len(x) for x in one_by_one] and cut.tolist() == [i for x in one_by_one for i in x]
        scorer = lmscore.Scorer(None, cutter, {}, 0, 0)
        texts = [[*words, b"a" * (lmscore.WIDE_WORD + 1), b""], [b""], [*words[:50], b"new", b""]]
        goal = scorer.laid(texts)[3]
        assert goal.tolist() == [i for ws in texts for w in ws for i in (cutter.cut(w) if w else [lmscore.END])]


def test_piece_counts_of_long_and_odd_words(spark):
    words = [b"", b"x", b"the", b"\xff\x00", b"n" * 64, b"ab" * 33, b"the" * 5000, "naïveté".encode()]
    path = lmscore.bpe.vocabulary_path()
    codec, want = lmscore.bpe.codec_for(path), Counter()
    for c, w in enumerate(words, 10**10):
        ids = codec.merge_bytes(w) if w else []
        for key in [(i, -1) for i in ids] + list(zip(ids, ids[1:])):
            want[key] += c
    df = spark.createDataFrame([(bytearray(w), c) for c, w in enumerate(words, 10**10)], "word binary, c long")
    assert {(r.a, r.b): r.n for r in lmscore.piece_counts(df, path).collect()} == want


def test_sum_product_equals_enumeration():
    rng = np.random.default_rng(3)
    page = dom.parse("<div><p>a</p><ul><li>b<li>c</ul></div><p>d</p>")
    f = htmltext.forest([page])
    kinds = 1 + max(htmltext.KINDS.values())
    model = htmltext.Model(rng.standard_normal(htmltext.N_UNARY), rng.standard_normal((kinds, 2, 2)))
    n = len(f.parent)
    weight = np.zeros((n, 2))
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        e = np.exp(sum((f.x[i] @ model.unary) * y[i] for i in range(n))
                   + sum(model.pair[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        for i in range(n):
            weight[i, y[i]] += e
    p, _ = htmltext.marginals(model, f)
    assert np.allclose(p, weight[:, 1] / weight.sum(1))


PAGE = ("<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
        "<div class=content><h1>A &amp; B</h1><p>First  paragraph\nof the story, with a <b>word</b>.<p>Second one<br>goes on."
        "<script>var x = '</p>';</script></div><div class=comments><p>Nice post!</p></div><footer>&copy; us</footer>")


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = htmltext.train(pages)
    assert htmltext.main_texts(model, [PAGE, "", "plain", None or ""])[0] == \
        "A & B\n\nFirst paragraph of the story, with a word.\n\nSecond one goes on."
    rng = random.Random(77)
    good = total = 0
    for _ in range(200):
        page = dom.parse(htmltext.practice_page(rng))
        gold = htmltext.gold_of(page)
        p, _ = htmltext.marginals(model, htmltext.forest([page]))
        good += sum(gold[i] == (p[i] > 0.5) for i, _ in page.runs)
        total += len(page.runs)
    assert good / total > 0.95
    odd = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "", "x"), (None, None, "<p", "x"), (3, "u", PAGE, "x"),
                                 (3, "u", PAGE, "x"), (4, "u", "<div>" * 3000 + "deep", "x")],
                                "page_id long, url string, html string, text string")
    rows = htmltext.extract(odd, model=model).collect()
    assert len(rows) == 6 and all(r.n_chars == len(r.text) for r in rows) and rows[0].text == ""
    assert htmltext.extract(odd.limit(0)).count() == 0


def test_no_article_text_is_lost_to_odd_elements():
    page = lambda x: f"<html><body><nav class=menu><a href=/>Home page</a></nav><article class=content><h1>Title of it</h1><p>First paragraph, with a few words in it.</p>{x}<p>Last paragraph, which must stay as well.</p></article><footer class=footer>Legal words</footer></body></html>"  # noqa: E731, E501
    inner = {"<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold here.</p>": "Let x=2 hold here.",
             "<object><p>A table of the object, long enough to be read.</p></object>": "A table of the object, long enough to be read.",
             "<noscript><p>A picture shows the town, as it was.</p></noscript>": "A picture shows the town, as it was.",
             "<div><svg><text>drawn</text></div>": None, "<div><select><option>One<option>Two</div>": None,
             "<svg><text>drawn</text></svg>": None, "<svg/>": None, "<script>var x = '<p>';</script>": None}
    model = htmltext.fit(*zip(*[(p, htmltext.gold_of(p)) for p in (
        dom.parse(htmltext.practice_page(random.Random(i))) for i in range(200))], strict=True))
    for html, text in inner.items():
        got = htmltext.main_texts(model, [page(html)])[0].split("\n\n")
        want = ["Title of it", "First paragraph, with a few words in it.", *([text] if text else []),
                "Last paragraph, which must stay as well."]
        assert got == want, html
