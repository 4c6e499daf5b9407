"""Extraction, quality, encoding and decontamination: brute force, round trips, held-out accuracy, edge cases."""

from __future__ import annotations

import html
import random
import re

import pyarrow as pa
import pytest
import sentencepiece

import public_tokenizers
from plumbline.llm import decontamination, html_crf, quality_fm, sentencepiece_lattice
from plumbline.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, score int, ids string, leaks int"


@pytest.fixture(scope="module")
def crf():
    return html_crf.trained()


def test_pages_of_the_table(spark, crf):
    for page in table(spark, SF, "pages").collect():
        inner = re.search("<article>(.*)</article>", page.html, re.S)[1]
        want = " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(?:p|h1|br)>", " ", inner))).split())
        assert crf.extract(page.html) == want


def test_held_out_labelled_pages(crf):
    total = wrong = 0
    for page in html_crf.labelled_pages(150, seed=77):
        blocks, labels = html_crf.labelled_blocks(page)
        total += len(labels)
        wrong += sum(a != b for a, b in zip(labels, crf.decode(blocks), strict=True))
    assert wrong <= 0.005 * total


def test_viterbi_is_the_best_labelling(crf):
    rng = random.Random(5)
    for _ in range(20):
        blocks = html_crf.leaf_blocks(html_crf._page(rng).replace(html_crf.MARK, ""))[:8]
        scores = [float(crf.emission[b.features].sum()) for b in blocks]

        def value(labels, scores=scores):
            return sum(s for s, x in zip(scores, labels, strict=True) if x) + sum(crf.change[int(a)][int(b)] for a, b in zip(labels, labels[1:], strict=False))

        best = max(value([bool(m >> k & 1) for k in range(len(blocks))]) for m in range(1 << len(blocks)))
        assert abs(value(crf.decode(blocks)) - best) < 1e-9


def test_page_edge_cases(spark, crf):
    pages = [None, "", "<nav><a href=x>Home</a></nav>", "<article><p>a &lt;b&gt; &amp; c\n\t d&nbsp;e</p></article>", "<article><p>1 < 2 and x<y</p><!-- never closed <p>no</p>", "<article><p>so it is<script>var a='</p>'", "<article>" + "<p>word word.</p>" * 20_000]
    df = spark.createDataFrame([(k, p, "old") for k, p in enumerate(pages)], "page_id bigint, html string, text string")
    got = {r.page_id: r.text for r in html_crf.extract(df, model=crf).collect()}
    assert [got[k] for k in range(6)] == ["", "", "", "a <b> & c d e", "1 < 2 and x", "so it is"]
    assert got[6] == " ".join(["word word."] * 20_000)
    assert html_crf.extract(spark.createDataFrame([], df.schema), model=crf).count() == 0


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").withColumnRenamed("quality", "label")
    model = quality_fm.train(docs, labels.filter(~quality_fm.held_out(labels.doc_id)))
    rows = quality_fm.score(docs, model).join(labels, "doc_id").filter(quality_fm.held_out(labels.doc_id)).select("score", "label").collect()
    good, bad = [r.score for r in rows if r.label == 1], [r.score for r in rows if r.label == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(s >= quality_fm.THRESHOLD for s in good) >= 0.97 * len(good)


def test_sum_of_squares_identity():
    import numpy as np

    rng = np.random.default_rng(0)
    model = quality_fm.Model(0.3, rng.normal(size=quality_fm.WIDTH), rng.normal(size=(quality_fm.WIDTH, 4)))
    columns, values = quality_fm.vector(b"Some words, some MORE words!! 12")
    pairs = sum(model.factors[a] @ model.factors[b] * x * y for i, (a, x) in enumerate(zip(columns, values, strict=True)) for b, y in list(zip(columns, values, strict=True))[:i])
    assert abs(model.margins([columns], [values])[0] - (0.3 + model.linear[columns] @ values + pairs)) < 1e-6


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 9, "", 0), (2, "", 9, "", 0), (2, "", 9, "", 0), (None, "some text", 9, "", 0), (4, "x " * 300_000, 9, "", 0)], DOCS)
    labels = spark.createDataFrame([(1, None), (2, 5), (None, 1)], "doc_id bigint, label int")
    rows = quality_fm.score(docs, quality_fm.train(docs, labels)).collect()
    assert len(rows) == 5 and all(r.score == 0.5 for r in rows)
    taught = quality_fm.train(docs, spark.createDataFrame([(1, 0), (2, 1), (4, 1), (2, 1)], "doc_id bigint, label int"))
    assert all(0 <= r.score <= 1 for r in quality_fm.score(docs, taught).collect())
    assert quality_fm.score(spark.createDataFrame([], DOCS), taught).count() == 0


ODD = [None, "", " ", "   ", "a  b\n c", "\tx", " lead", "trail  ", "ﬁ①  é é", "🙂 ok", "x" * 4000, " " * 47 + "zq" + " " * 15 + " q", "aaaaa bbbbbbb ababab -- ==== 1234567 $$$", "العربية 日本語 текст", " " * 31, "   \t  \n   x", "\x00\x01", "mark ▁ inside"]


@pytest.mark.parametrize("frequent", [0, 300_000])
def test_ids_equal_the_library(spark, frequent):
    pieces = sentencepiece_lattice.default_pieces(spark)
    texts = ODD + [r.text for r in table(spark, SF, "documents").limit(25).collect()]
    df = spark.createDataFrame([(k, t, 0, "old", 0) for k, t in enumerate(texts)], DOCS).drop("ids")
    rows = sentencepiece_lattice.decode(sentencepiece_lattice.encode(df, pieces, frequent_limit=frequent), pieces).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == (library.encode(r.text) if r.text else []), r.text
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_unigram_viterbi(spark):
    vocabulary = {"▁": -3.0, "a": -4.0, "b": -4.0, "ab": -5.0, "▁a": -6.5, "ba": -5.5, "aba": -7.0}
    pieces = sentencepiece_lattice.Pieces({p: k + 300 for k, p in enumerate(vocabulary)}, vocabulary, list(range(256)), merges=False)
    words = ["ab", "abab", "bab", "aabba", "b" * 300]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in sentencepiece_lattice.encode(df, pieces).collect()}

    def best(text):
        paths = [(0.0, [])] + [None] * len(text)
        for end in range(1, len(text) + 1):
            ways = [(paths[s][0] + vocabulary[text[s:end]], paths[s][1] + [pieces.ids[text[s:end]]]) for s in range(max(0, end - 3), end) if text[s:end] in vocabulary and paths[s]]
            paths[end] = max(ways, default=None)
        return paths[-1]

    score = {i: vocabulary[p] for p, i in pieces.ids.items()}
    for k, w in enumerate(words):
        assert abs(sum(score[i] for i in got[k]) - best("▁" + w)[0]) < 1e-9
    assert sentencepiece_lattice.encode(spark.createDataFrame([], df.schema), pieces).count() == 0


def slow_alignment(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_equals_brute_force():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(1, 5, rng.integers(1, 20))
        assert decontamination.local_score(a, b)[0] == slow_alignment(a.tolist(), b.tolist())


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    common = [word() for _ in range(30)]
    passage = lambda n: [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [passage(rng.randint(16, 50)) for _ in range(12)]
    texts, want = [], set()
    for k in range(60):
        body = passage(150)
        if k % 3 == 0:
            n = k % 12
            copy = list(items[n])
            if k % 2:
                for at in range(4, len(copy), 7):
                    copy[at] = word()
            body[50:50] = copy
            want.add((k, n))
        texts.append((k, " ".join(body).capitalize() + ".", 1, "", 0))
    texts += [(100, None, 1, "", 0), (101, "", 1, "", 0), (102, " ".join(passage(200_000)), 1, "", 0), (None, " ".join(items[1]).upper(), 1, "", 0), (103, "tiny item", 1, "", 0)]
    want.add((None, 1))
    bench = spark.createDataFrame([(n, " ".join(i)) for n, i in enumerate(items)] + [(50, None), (51, ""), (52, "tiny item")], "item_id bigint, text string")
    docs = spark.createDataFrame(texts, DOCS)
    for block in (1_000_000, 100):
        marked = decontamination.with_leaks(docs, bench, block_words=block).collect()
        assert {(r.doc_id, x.item_id) for r in marked for x in r.leaks} == want
    whole = [r for r in decontamination.leak_table(docs, bench).collect() if r.doc_id == 0]
    assert (whole[0].score, whole[0].first_word, whole[0].n_words) == (1.0, 50, len(items[0]))
    assert decontamination.leak_table(spark.createDataFrame([], DOCS), bench).count() == 0
    assert decontamination.leak_table(docs, bench.limit(0)).count() == 0


def test_leaks_with_edits_at_any_place():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    every, items, texts = [], [], []
    for n in (4, 5, 8, 12, 16, 20, 24, 40, 100):
        for step in (4, 5, 6, 7):
            items.append([word() for _ in range(n)])
            copy = [word() if at % step == step - 1 else w for at, w in enumerate(items[-1])]
            texts.append([word() for _ in range(30)] + copy + [word() for _ in range(30)])
    for n in (10, 30):
        items.append([word() for _ in range(n)])
        texts.append([x for at, w in enumerate(items[-1]) for x in ([w, word()] if at % 2 and at + 1 < n else [w])])
    for _ in range(150):
        items.append([rng.choice("abcdef") for _ in range(rng.randint(4, 14))])
        texts.append([rng.choice("abcdef") for _ in range(rng.randint(4, 40))])
    own = decontamination.Items([(k, " ".join(w)) for k, w in enumerate(items)])
    for k, text in enumerate(texts):
        got = {r[0]: r[1] for r in own.leaks(" ".join(text), {})}
        want = {i: s / len(w) for i, w in enumerate(items) if abs(i - k) < 12 and (s := slow_alignment(w, text)) * 2 >= len(w)}
        assert {i: s for i, s in got.items() if abs(i - k) < 12} == want
        every.append(k in want)
    assert all(every[:38])


def test_joined_leaks_with_edits_at_any_place(spark, monkeypatch):
    rng = random.Random(10)
    often = [f"often{k}" for k in range(25)]
    word = lambda: rng.choice(often) if rng.random() < 0.5 else "".join(rng.choice("abcdefghijkl") for _ in range(7))
    items = [[word() for _ in range(n)] for n in (4, 5, 8, 12, 16, 24, 40, 100) for _ in range(4)]
    texts = []
    for k, item in enumerate(items):
        copy = ["edited" if at % (4 + k % 4) == 3 + k % 4 else w for at, w in enumerate(item)]
        texts.append([word() for _ in range(60)] + copy + [word() for _ in range(60)])
    texts += [[word() for _ in range(200)] for _ in range(20)]
    want = {(d, i) for d, text in enumerate(texts) for i, item in enumerate(items) if slow_alignment(item, text) * 2 >= len(item)}
    assert {(k, k) for k in range(len(items))} <= want
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leak_table(docs, bench).collect()} == want
    monkeypatch.setattr(decontamination, "MAX_BITS", 1 << 10)
    assert {(r.doc_id, r.item_id) for r in decontamination.leak_table(docs, bench).collect()} == want


@pytest.mark.parametrize("page", ["<div>x " * 60_000, '<a href="x ' * 90_000, '<a href="x ' * 90_000 + ">", "<p>x</i>" * 60_000, "<i><div>" + "<b>x</i>" * 60_000, "< a " * 250_000, "<a href='x' b=\"y>" * 60_000])
def test_nested_and_unclosed_tags_take_linear_time(page):
    import time

    began = time.process_time()
    html_crf.leaf_blocks(page)
    assert time.process_time() - began < 10  # quadratic parsing took minutes


def test_long_block_features():
    figures = html_crf.FEATURES["digits"]
    block = html_crf.leaf_blocks("<p>" + "12345 " * 100 + "word " * 2000 + "</p>")[0]
    assert figures not in block.features
    deep = html_crf.leaf_blocks("<p><a href=x><b><i><u><span><em>all of it is linked</em></span></u></i></b></a></p>")[0]
    assert html_crf.FEATURES["links:5"] in deep.features


def test_many_distinct_tags_take_linear_memory():
    import time
    import tracemalloc

    page = "".join(f"<x{k}>" for k in range(200_000)) + "<article><p>the text</p></article>"
    began = time.process_time()
    blocks = html_crf.leaf_blocks(page)
    assert time.process_time() - began < 5
    assert [b.text for b in blocks] == ["the text"] and html_crf.FEATURES["in:article"] in blocks[0].features
    tracemalloc.start()
    html_crf.leaf_blocks(page)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_units_asked_for_are_those_of_the_gaps():
    pieces = sentencepiece_lattice.default_pieces(None)
    words = {"the": pieces.pack([5]), "cat": pieces.pack([6, 7])}
    texts = pa.array(["the cat sat", None, "", "  the  zzyx the zzyx\u2581cat", "\U0001f600 the", "cat"])
    encoder = sentencepiece_lattice.Encoder(pieces, {}, words)
    numbers, units = encoder.gaps(texts)  # without ids, and without a look at known words
    packed, want, _, known = encoder.encode(texts)
    assert units == known and [x.tolist() for x in numbers] == [x.tolist() for x in want]
    assert packed[5] == words["cat"] and packed[1] == packed[2] == b"" and len(numbers[3]) == 2 * len(set(numbers[3].tolist())) > 0


def test_only_the_model_comes_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "$$ || ##", 10) for k in range(40)], "doc_id bigint, text string, n_chars bigint")
    monkeypatch.setattr(type(docs), "toArrow", None)
    model = quality_fm.train(docs, docs.selectExpr("doc_id", "doc_id % 2 as label"))
    scores = {r.doc_id: r.score for r in quality_fm.score(docs, model).collect()}
    assert min(scores[k] for k in range(1, 40, 2)) > max(scores[k] for k in range(0, 40, 2))
