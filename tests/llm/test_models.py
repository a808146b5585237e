"""Trained operators on held-out rows, and the pipeline against its own parts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import htmltext, quality, toxicity
from sparkloom.llm.linear import WordScores

WORDS = [f"word{i}" for i in range(600)]


def sentences(r, n):
    return ". ".join(" ".join(r.choice(WORDS, r.integers(3, 12))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def labelled():
    r = np.random.default_rng(8)
    bad = ["nastyword", "vileword", "foulword"]
    texts, labels, planted = [], [], []
    for i in range(900):
        text, toxic = sentences(r, int(r.integers(1, 12))), int(i % 6 == 0)
        if toxic:
            parts = text.split(". ")
            at = int(r.integers(len(parts)))
            parts[at] = f"{parts[at].rstrip('.')} {r.choice(bad)}"
            text = ". ".join(parts) + "."
        planted.append(toxic)
        texts.append(text)
        labels.append(toxic)
    return texts, labels


def test_noisy_or_learns_from_document_labels_and_locates_sentences(labelled):
    texts, labels = labelled
    model = toxicity.fit(texts[:600], labels[:600])
    scores = WordScores(model.weights)
    for text, label in zip(texts[600:], labels[600:], strict=True):
        p, found = toxicity.score_text(text, scores, model.bias, 0.3)
        assert (p >= 0.3) == bool(label)
        spans = [text[f["start"] : f["end"]] for f in found]
        assert len(spans) == label and all(any(w in s for w in ("nastyword", "vileword", "foulword")) for s in spans)


def test_toxicity_degenerate_training():
    for texts, labels in (([], []), (["a"], [1]), (["", ""], [0, 1])):
        model = toxicity.fit(texts, labels)
        p, found = toxicity.score_text("a b. c", WordScores(model.weights), model.bias, 0.3)
        assert 0 <= p < 0.01 and not found


def test_toxicity_never_trains_on_held_out_rows(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("toxic"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")).union(spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, toxic int"))
    texts, _ = toxicity.training_sample(docs, labels, toxicity.Training())
    ids = {int(t[1:]) for t in texts}
    assert ids == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(toxicity.training_sample(docs, labels, toxicity.Training(documents=50))[0]) == 50


def test_toxicity_sample_takes_labels_of_documents_that_are_there(spark):
    docs = spark.range(0, 20_000, 200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    docs = docs.union(spark.createDataFrame([(200, "a"), (200, "z" * 30_000), (None, "n")], "doc_id long, text string"))
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 400 == 0).cast("int").alias("toxic"))
    texts, found = toxicity.training_sample(docs, labels, toxicity.Training(documents=60))
    assert len(texts) == len(found) == 60
    texts, _ = toxicity.training_sample(docs, labels, toxicity.Training())
    expected = {"a" if i == 200 else f"t{i}" for i in range(0, 20_000, 200) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(texts) == expected and len(texts) == len(expected)


def test_scores_against_plain_formulas():
    r = np.random.default_rng(5)
    weights = r.normal(0, 2, 1 << 18).astype(np.float32)
    scores = WordScores(weights)
    from sparkloom.llm.linear import word_features

    for _ in range(50):
        text = sentences(r, int(r.integers(1, 6)))
        clean = 1.0
        for s in text.split("."):
            if words := {w.strip("0123456789") for w in s.split()}:
                z = -8.5 + sum(float(weights[word_features(w)].sum()) for w in words)
                clean *= 1 - 1 / (1 + np.exp(-z))
        assert abs(toxicity.score_text(text, scores, -8.5, 0.3)[0] - (1 - clean)) < 1e-6


def test_quality_scorer_against_plain_formulas():
    r = np.random.default_rng(6)
    weights = r.normal(0, 1, 1 << 18).astype(np.float32)
    for _ in range(30):
        text = sentences(r, 6) + " " + sentences(r, 1).upper() * 2
        words = text.split()
        again = seen = 0
        parts = [x.strip() for x in text.replace("!", ".").replace("?", ".").replace("\n", ".").split(".") if x.strip()]
        for i, p in enumerate(parts):
            again += len(p.split(" ")) * (p in parts[:i])
        same = sum(a == b for a, b in zip(words, words[1:]))
        total = sum(float(weights[quality.token_features(w)].sum()) for w in words)
        total += same * float(weights[quality.token_features(quality.SAME)].sum()) + again * float(weights[quality.token_features(quality.AGAIN)].sum())
        assert seen == 0 and abs(quality.mean_score(text, WordScores(weights, quality.token_features)) - total / len(words)) < 1e-4


def test_scores_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a. b"), (1, None), (3, "a " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offending", F.lit(1))
    model = toxicity.Model(np.zeros(1 << 18, np.float32), -7.5)
    found = toxicity.score(docs, model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in rows)
    assert all(r.score == 0 for r in found if r.doc_id in (1, 2))
    assert {len(r) for r in quality.classify(docs).collect()} == {3} and quality.classify(docs).count() == 5


def test_label_model_finds_the_bad_class():
    r = np.random.default_rng(3)
    k, counts, truth = len(quality.LABELLERS), {}, {}
    for _ in range(4000):
        good = r.random() < 0.8
        right = np.where(r.random(k) < 0.85, good, not good)
        pattern = "".join("-" if r.random() < 0.3 else "g" if x else "b" for x in right)
        counts[pattern] = counts.get(pattern, 0) + 1
        truth.setdefault(pattern, []).append(good)
    model = quality.fit_labels(counts)
    assert abs(model.prior - 0.8) < 0.05
    assert np.mean([(model.posterior(p) > 0.5) == g for p, gs in truth.items() for g in gs]) > 0.95


def test_quality_keeps_prose_and_drops_junk(spark):
    r = np.random.default_rng(4)
    prose = [sentences(r, 8).capitalize() for _ in range(120)]
    junk = [" ".join(f"{w}###" for w in r.choice(WORDS, 60)) for _ in range(12)] + [" ".join(r.choice(WORDS, 60)).upper().replace(" ", "!! ") for _ in range(12)] + [" ".join([w for w in r.choice(WORDS, 8) for _ in range(12)]) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id long, text string")
    kept = {x.doc_id for x in quality.classify(df).collect() if x.keep}
    assert kept == set(range(len(prose)))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="</p><p>no";</script><style>p{}</style></head><body>
<header><a href="/">My site</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><!-- <p>hidden</p> -->
<article><h1>Caf&eacute;   news</h1><p>First &lt;b&gt; paragraph
 with <b>bold</b>&nbsp;and <a href="/x">a link</a> inside it.<p>Second one, unclosed &#x2014; of the main text of this page.
<div class="ad">Buy now</div><ul><li>An item of a list in the text</li><li>Another item of that same list</li></ul></article>
<aside><h3>Related</h3><p><a href="/r">Other story</a></p></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Nice post!</p></div></section>
<form><p>Your email <input></p><button>Send</button></form><footer>&copy; 2020 Example. All rights reserved.</footer></body></html>"""


@pytest.fixture(scope="module")
def labeller():
    return htmltext.model()


def test_block_labeller_on_composed_pages(labeller):
    pages = [htmltext.training_page(np.random.default_rng([31, i])) for i in range(150)]
    found = htmltext.predict(labeller, [p for p, _ in pages], htmltext.Words())
    assert np.mean(np.concatenate(found) == np.concatenate([y for _, y in pages])) > 0.98


def test_main_text(spark, labeller):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (4, "w", "<<<>&&; <p"), (5, "x", "<p>" * 3000), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = [tuple(r) for r in htmltext.main_text(df, labeller).collect()]
    text = "Café news\nFirst <b> paragraph with bold and a link inside it.\nSecond one, unclosed — of the main text of this page.\nAn item of a list in the text\nAnother item of that same list"
    assert found.count((1, "u", text)) == 2 and (2, None, "") in found and (None, "v", "") in found and len(found) == 6
    assert htmltext.main_text(df.where("false"), labeller).count() == 0


def test_blocks_follow_the_page():
    texts = [b.text for b in htmltext.blocks(PAGE)]
    assert "Buy now" in texts and not any("hidden" in t or "var a" in t or "T & t" in t or "Send" in t for t in texts)
    assert htmltext.blocks("a<br>b<p>c<table><tr><td>d<td>e</table>f")[0].text == "a b"
    assert [b.text for b in htmltext.blocks("a<br>b<p>c<table><tr><td>d<td>e</table>f")] == ["a b", "c", "d", "e", "f"]


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<article><p>One.</p><button>x<p>Two.</p></article><p>Three", ["One.", "x", "Two.", "Three"]),
        ("<p>One.</p><button>x</button><p>Two.</p><button>y<p>Three</p>", ["One.", "Two.", "y", "Three"]),
        ("<p>a<svg><svg>in</svg>label</svg>b</p>", ["ab"]),
        ("<p>a</p><script data-x='<'>var x=1;</script><p>b", ["a", "b"]),
        ("<p>a</p><script data-x=a<b>var x=1;</script><p>b", ["a", "b"]),
        ("<p>a</p><noscript>js</noscript><select><option>1<option>2</select>c<style>p{}</style><p>d<script>no <p>end", ["a", "c", "d"]),
        ("<div><button>x</div><p>text</p><div>y</button></div>z", ["x", "text", "y", "z"]),
        ("<title>t</title><object>o<p>yes</p><canvas><p>too", ["o", "yes", "too"]),
        ("<p>a < b and 5 <6 x</p><p>it's \" fine</p><a href=x'y>l</a>", ["a < b and 5 <6 x", "it's \" fine", "l"]),
        ("<TEXTAREA><p>no</p></textarea\n><!-- <p>no</p> --><P>yes<!-- open", ["yes"]),
    ],
)
def test_broken_markup(page, texts):
    assert [b.text for b in htmltext.blocks(page)] == texts


@pytest.mark.parametrize("part", ["<div>", "<div>x", "<button>", "<svg>", "<script>", "<", "<a '", "<li>", "<div><li>a", "<!--", '<p x="'])
def test_blocks_take_linear_time(part):
    import time

    n, took = 100_000, []
    for k in (n // 4, n):
        began = time.perf_counter()
        htmltext.blocks(part * k + "x")
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1  # 4 if linear, 16 if quadratic


ARTICLE = ["Bridge vote delayed", "The town council met on Tuesday evening to discuss the new bridge.", "Several residents spoke against the plan, citing noise and cost.", "A second vote is expected before the end of the month."]
LAYOUTS = {
    "weblog": """<html><body class="single post"><div id="page"><div id="masthead" class="site-header"><a href="/">River Times</a><div class="main-navigation"><a href="/a">Home</a> | <a href="/b">About</a></div></div><div id="primary"><div class="hentry"><h1 class="entry-title">{}</h1><div class="entry-content"><p>{}</p><p>{}</p><blockquote><p>{}</p></blockquote></div></div><div id="comments"><ol class="comment-list"><li class="comment"><p>I walk there every day.</p></li></ol></div></div><div id="secondary" class="widget-area"><div class="widget"><h3>Recent posts</h3><ul><li><a href="/x">Market day returns</a></li></ul></div></div><div id="colophon">Proudly powered by presses</div></div></body></html>""",
    "tables": """<table width=100%><tr><td colspan=2><b><a href="/">Old Site</a></b></td></tr><tr><td width=150><a href="1">News</a><br><a href="2">Sport</a></td><td><h2>{}</h2><p>{}<p>{}<p>{}</td></tr><tr><td colspan=2><small>Copyright 2003 Old Site</small></td></tr></table>""",
    "sections": """<body><header class="top"><nav><a href="/">Home</a><a href="/w">World</a></nav></header><main><section class="story"><h1>{}</h1><p>{}</p><p>{}</p><aside class="promo"><p>Sign up for our newsletter</p></aside><p>{}</p></section></main><footer><ul><li><a>Privacy</a></li><li><a>Terms</a></li></ul></footer></body>""",
    "manual": """<div class="layout"><div class="toc"><ul><li><a href="#1">Install</a></li><li><a href="#2">Usage</a></li></ul></div><div class="doc-body"><h1>{}</h1><p>{}</p><p>{}</p><p>{}</p></div></div>""",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_main_text_of_layouts_it_wasnt_trained_on(labeller, layout):
    page = htmltext.blocks(LAYOUTS[layout].format(*ARTICLE))
    keep = htmltext.predict(labeller, [page], htmltext.Words())[0]
    assert [b.text for b, k in zip(page, keep, strict=True) if k] == ARTICLE


def test_labeller_against_plain_loops(labeller):
    p, words, sigmoid = labeller, htmltext.Words(), lambda x: 1 / (1 + np.exp(-x))
    pages = [htmltext.training_page(np.random.default_rng([77, i]))[0] for i in range(6)]
    for page, found in zip(pages, htmltext.predict(p, pages, words), strict=True):
        x = []
        for i, b in enumerate(page):
            tokens = b.text.split(" ")
            stops = sum(b.text.count(e) for e in (". ", "! ", "? ")) + (b.text[-1] in ".!?")
            counts = [np.log1p(len(b.text)) / 6, b.linked / len(b.text), min(1, 5 * stops / len(tokens)), i / len(page), min(1, len(tokens) / 20), 1]
            x.append(np.tanh(sum(p["e"][k] for k in b.path) + sum(p["e"][words[t]] for t in tokens) / len(tokens) + np.array(counts) @ p["c"]))
        sides = []
        for way, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h, c, out = np.zeros(htmltext.HIDDEN), np.zeros(htmltext.HIDDEN), {}
            for t in order:
                i, f, o, g = np.split(x[t] @ p[f"w{way}"] + h @ p[f"u{way}"] + p[f"b{way}"], 4)
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = out[t] = sigmoid(o) * np.tanh(c)
            sides.append(out)
        z = [float((np.concatenate([sides[0][t], sides[1][t], x[t]]) @ p["o"])[0] + p["ob"][0]) for t in range(len(x))]
        assert [v > 0 for v in z] == found


def test_stored_weights_are_those_of_the_code():
    assert htmltext.digest(htmltext.model()) == htmltext.DIGEST


def test_pipeline_stages_take_effect(spark, data):
    import corpus_pipeline

    from sparkloom.llm import decontam, packing, simhash_similarity, substring
    from sparkloom.llm.common import table

    docs = table(spark, data, "documents")
    columns, kept = docs.columns, {"start": {r.doc_id: r.text for r in docs.collect()}}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, data).cache()
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, table(spark, data, "labels"))).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i, s in scored.items() if s < 0.3}
    single = stages["near_duplicates"](spark, clean, data).cache()
    groups = simhash_similarity.near_duplicates(clean).collect()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in groups}
    cut = stages["substring_dedup"](spark, single, data).cache()
    removed = {r.doc_id: r for r in substring.remove_repeats(single).collect()}
    before = {r.doc_id: r for r in single.collect()}
    assert cut.columns == columns and cut.dtypes == docs.dtypes
    for r in cut.collect():
        x = removed[r.doc_id]
        assert (r.text, r.n_chars) == ((x.kept_text, len(x.kept_text)) if x.n_removed else (before[r.doc_id].text, before[r.doc_id].n_chars)) and r.source == before[r.doc_id].source
    assert {r.doc_id for r in cut.collect()} == {i for i, x in removed.items() if x.kept_text or not x.n_removed}
    safe = stages["decontamination"](spark, cut, data).cache()
    leaked = {r.doc_id for r in decontam.contaminated(cut, table(spark, data, "benchmark")).collect()}
    assert leaked and {r.doc_id for r in safe.collect()} == {r.doc_id for r in cut.collect()} - leaked
    last = sorted(map(tuple, stages["packing"](spark, safe, data).select("doc_id", "start", "length", "ids_crc32").collect()))
    assert last == sorted(map(tuple, packing.pack(safe).select("doc_id", "start", "length", "ids_crc32").collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).select("doc_id", "start", "length", "ids_crc32").collect())) == last
    assert len(kept["start"]) > safe.count() > 0


def test_pipeline_on_an_empty_table(spark, data):
    import corpus_pipeline

    from sparkloom.llm.common import table

    docs = table(spark, data, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0, name
