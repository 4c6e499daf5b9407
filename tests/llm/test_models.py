"""Vector codes, the language model and spelling variants against plain loops, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hmm_lm, spelling, vector_codes
from plumbline.llm.common import table

# --- vector codes ------------------------------------------------------------------------------------


@pytest.mark.parametrize("head", [1, 4, 16])
def test_partial_distance_search_is_exact(head):
    rng = np.random.default_rng(head)
    for spread, n, k in ((3, 400, 256), (1000, 300, 40), (1, 200, 16), (5, 3, 1)):
        parts, entries = rng.integers(-spread, spread + 1, (n, 16)), rng.integers(-spread, spread + 1, (k, 16))
        entries[k // 2 :] = entries[: k - k // 2]  # ties
        far = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        codes, errors = vector_codes.nearest(parts, entries, head=head, run=64)
        assert codes.tolist() == far.argmin(axis=1).tolist() and errors.tolist() == far.min(axis=1).tolist()
    assert vector_codes.nearest(parts[:0], entries)[0].tolist() == []


def slow_codes(rows, n_entries, rounds=4):
    """The contract in plain Python over ``(id, vector, label)`` rows that are kept, in order of id."""
    ints = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows]
    width = len(ints[0][1]) // 4
    parts = [[v[p * width : (p + 1) * width] for _, v, _ in ints] for p in range(4)]
    books = [[list(x) for x in part[:n_entries]] for part in parts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            found = [near(x, books[p])[1] for x in parts[p]]
            for e in set(found):
                mine = [x for x, f in zip(parts[p], found, strict=True) if f == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    final = [[near(x, books[p]) for x in parts[p]] for p in range(4)]
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return {i: ("".join(f"{final[p][k][1]:02x}" for p in range(4)), sum(final[p][k][0] for p in range(4))) for k, (i, *_) in enumerate(ints)}, hashlib.sha256(text.encode()).hexdigest()


def test_codes_equal_plain_loops(spark):
    rng = random.Random(6)
    rows = [(k, [rng.choice([-0.5, 0.25, 0.001, rng.uniform(-1, 1)]) for _ in range(8)], rng.choice([None, 1, 2])) for k in range(300)]
    rows += [(300 + k, rows[k][1], 7) for k in range(40)]
    odd = [(900, None, 1), (901, [1.0, None, 0.0, 0, 0, 0, 0, 0], 1), (902, [float("nan")] + [0.0] * 7, 1), (903, [float("-inf")] + [0.0] * 7, 1), (904, [1.0, 2.0], 1), (905, [], None)]
    df = spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, label, "extra", 0) for i, v, label in rows + odd], "vec_id long, embedding array<double>, label int, code string, error int").repartition(5)
    got = {r.vec_id: r for r in vector_codes.vector_codes(df).collect()}
    want, digest = slow_codes(rows, 256)
    assert set(got) == {i for i, *_ in rows} | {904, 905}
    assert all((got[i].code, got[i].error, got[i].codebooks_sha256) == (*want[i], digest) for i, *_ in rows)
    sums = Counter()
    for i, _, label in rows:
        sums[label] += want[i][1]
    assert all(got[i].label_error == sums[label] for i, _, label in rows)
    assert (got[904].code, got[904].error, got[905].code) == (None, None, None)


def test_codes_of_few_null_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(None, [1.0, 2.0, 3.0, 4.0], 1), (2, [1e30, -1e30, 0.0, 0.5], 1), (2, [0.0, 0.0, 0.0, -0.0001], None)]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 3 and all(r.error == 0 for r in got)
    assert len({r.code for r in got}) == 3
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1)], schema)).count() == 0


# --- language model ----------------------------------------------------------------------------------


def test_words_of_sliced_batches():
    texts = ["  A b\tc\n", None, "", "É x" * 50, "one\x0btwo\x0cthree\rfour", "a  b " * 30, " nbsp stays"] * 40
    column = pa.array(texts, pa.string())
    parts = list(hmm_lm.slices(column, 300))
    assert len(parts) > 20 and [i for p in parts for i in range(p.start, p.stop)] == list(range(len(texts)))
    found = []
    for p in parts:
        words, at, sizes = hmm_lm.tokens(column[p])
        flat = [words[k].as_py() for k in at]
        found += [flat[e - n : e] for e, n in zip(np.cumsum(sizes), sizes, strict=True)]
    assert found == [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]


def small_model(classes, states, seed):
    rng = np.random.default_rng(seed)
    share = lambda *shape: (x := rng.uniform(0.1, 1, shape)) / x.sum(axis=-1, keepdims=True)
    return hmm_lm.Model(share(2, states), share(states, states), share(states, classes).T)


def paths(model, seq, kind=0):
    """Every path of states with its probability."""
    for path in itertools.product(range(len(model.step)), repeat=len(seq)):
        p = model.start[kind, path[0]] * model.emit[seq[0], path[0]]
        for a, b, c in zip(path, path[1:], seq[1:], strict=False):
            p *= model.step[a, b] * model.emit[c, b]
        yield path, p


def test_forward_recursion_sums_all_paths():
    model = small_model(4, 3, 1)
    rng = random.Random(1)
    seqs = [[rng.randrange(4) for _ in range(n)] for n in (1, 2, 3, 5, 6, 1, 4)]
    got = hmm_lm.likelihood(model, [np.array(s, "<u2").tobytes() for s in seqs])
    assert np.allclose(10.0**got, [sum(p for _, p in paths(model, s)) for s in seqs], rtol=1e-12)
    long = [[rng.randrange(4) for _ in range(5000)]]
    assert np.isfinite(hmm_lm.likelihood(model, [np.array(s, "<u2").tobytes() for s in long])).all()
    assert hmm_lm.likelihood(model, []).tolist() == []


def test_expected_counts_sum_all_paths():
    model = small_model(4, 3, 2)
    rng = random.Random(2)
    seqs = [[rng.randrange(4) for _ in range(n)] for n in (5, 1, 3, 3, 2)]
    inner = np.array([False, False, True, False, True])
    start, step, classes, sums = hmm_lm.expected(model, np.concatenate(seqs).astype("<u2"), np.array([len(s) for s in seqs]), inner)
    emit = np.zeros_like(model.emit)
    emit[classes] = sums
    a, b, c = np.zeros((2, 3)), np.zeros((3, 3)), np.zeros((4, 3))
    for s, continues in zip(seqs, inner, strict=True):
        total = sum(p for _, p in paths(model, s, int(continues)))
        for path, p in paths(model, s, int(continues)):
            a[int(continues), path[0]] += p / total
            for x, y in itertools.pairwise(path):
                b[x, y] += p / total
            for t, (state, symbol) in enumerate(zip(path, s, strict=True)):
                if t or not continues:  # the first token of a stretch that goes on was counted in the one before
                    c[symbol, state] += p / total
    assert np.allclose(start, a) and np.allclose(step, b) and np.allclose(emit, c)


def test_stretches_count_every_transition_and_token_once():
    rng = random.Random(3)
    seqs = [np.array([rng.randrange(9) for _ in range(n)], "<u2") for n in (1, 5, 6, 11, 37, 10)]
    tokens, steps = Counter(), Counter()
    for classes, sizes, inner in hmm_lm.stretches([s.tobytes() for s in seqs], 5):
        at = 0
        for n, continues in zip(sizes, inner, strict=True):
            part = classes[at : at + n].tolist()
            at += n
            tokens.update(part[1:] if continues else part)
            steps.update(itertools.pairwise(part))
    assert tokens == Counter(x for s in seqs for x in s.tolist())
    assert steps == Counter(p for s in seqs for p in itertools.pairwise(s.tolist()))


def slow_base(rows):
    """``(n_tokens, n_known, N, base)`` of ``(id, text)`` rows by the contract."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    words = [[w.decode() for w in (t or "").encode().lower().split()] + [None] for _, t in rows]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for ws in words]


LM = dict(states=3, rounds=1)


@pytest.mark.parametrize("limits", [{}, {"n_words": 5, "buckets": 3, "lookup": 12}])
def test_base_scores_equal_plain_loops(spark, limits):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcÉx") for _ in range(rng.randint(1, 3)))
    rows = [(k if k % 11 else None, " ".join(word() for _ in range(rng.choice([0, 1, 5, 60])))) for k in range(120)] + [(500, None), (501, ""), (7, "dup row"), (7, "dup row"), (502, "w " * 3000 + "z" * 5000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_known string, row int").repartition(4)
    got = sorted(hmm_lm.language_scores(df, **LM, **limits).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.base_score, r.n_tokens))
    want = sorted(zip(rows, slow_base(rows), strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1][3], x[1][0]))
    assert len(got) == len(want)
    for r, ((i, _), (n_tokens, n_known, n, base)) in zip(got, want, strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, n_tokens, n_known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score <= 0


def test_probabilities_of_words_sum_to_one(spark):
    rows = [(k, "alpha beta beta gamma delta " + "omega " * (k % 3) + f"rare{k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    counts = hmm_lm.word_counts(docs).cache()
    lex = hmm_lm.lexicon(counts, 40, n_words=3, buckets=4, lookup=6)
    assert lex.class_counts.sum() == lex.tokens == sum(len(t.split()) + 1 for _, t in rows)
    every = {r.word: r.n for r in counts.collect()}
    named = [w.as_py() for w in lex.words][:3]
    for k in range(4):
        inside = [n for w, n in every.items() if w not in named and zlib.crc32(w.encode()[-4:]) % 4 == k]
        assert math.isclose(sum((n + 1) / lex.bucket_totals[k] for n in inside) + 1 / lex.bucket_totals[k], 1 + len(inside) / lex.bucket_totals[k] - len(inside) / lex.bucket_totals[k])
    by_spark = {r.word: r.k for r in counts.select("word", hmm_lm.bucket(F.col("word"), 4).alias("k")).collect()}
    assert by_spark == {w: zlib.crc32(w.encode()[-4:]) % 4 for w in every}


def test_model_predicts_held_out_texts_better_than_counts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = hmm_lm.language_scores(docs, states=8, rounds=1).filter("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert len(rows) > 80 and sum(r.score - r.base_score for r in rows) / tokens > 0.1
    shuffled = hmm_lm.language_scores(docs.limit(0), **LM)
    assert shuffled.count() == 0


def test_all_documents_held_out(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = hmm_lm.language_scores(spark.createDataFrame([(k, "some words") for k in held], "doc_id long, text string"), **LM).collect()
    assert all((r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and math.isfinite(r.score) for r in rows)


# --- spelling variants -------------------------------------------------------------------------------


def test_wavelet_tree_reports_every_point():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 300):
        ranks = rng.permutation(n)
        tree = spelling.WaveletTree(ranks)
        low, high = rng.integers(0, n + 1, (2, 50))
        least, most = rng.integers(0, n + 1, (2, 50))
        query, value = tree.report(low, high, least, most)
        want = sorted((q, int(v)) for q in range(50) for v in ranks[low[q] : max(low[q], high[q])] if least[q] <= v < most[q])
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == want


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "zÿÀ"])
def test_near_pairs_are_all_found_once(alphabet):
    rng = random.Random(len(alphabet))
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.choice([6, 7]))) for _ in range(150)} | {"aaaaaa", "aaaaaaa"})
    want = sorted((a, b) for a, b in itertools.combinations(words, 2) if is_near(a, b))
    found = []
    for length in (6, 7, 8):
        block = [w for w in words if len(w) in (length, length - 1)]
        for a, b in spelling.near_pairs([w.encode("latin-1") for w in block], length, range(length)):
            found += [tuple(sorted((block[x], block[y]))) for x, y in zip(a, b, strict=True)]
    assert sorted(found) == want


def slow_variants(rows, min_count=5):
    counts = Counter()
    for i, text in rows:
        lowered = (text or "").encode().lower().decode()
        run = ""
        for c in lowered + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= min_count}
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


@pytest.mark.parametrize("task_words", [8, 8000])
def test_variants_equal_plain_loops(spark, monkeypatch, task_words):
    rng = random.Random(9)
    stems = ["".join(rng.choice("aeéxÿ") for _ in range(rng.choice([6, 6, 7, 9, 12]))) for _ in range(14)]

    def bent(word):
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("aeéÿ") + word[k:], word[:k] + rng.choice("aeéÿ") + word[k + 1 :]])
        return word

    weights = [3**k for k in range(len(stems))]
    rows = [(k if k % 9 else None, rng.choice([" ", "-", "1", "ß Ā"]).join(bent(w).upper() if rng.random() < 0.1 else bent(w) for w in rng.choices(stems, [min(x, 400) for x in weights], k=60))) for k in range(150)]
    rows += [(7, None), (8, ""), (9, "x" * 3000), (9, "x" * 3000), (10, "ab" * 900 + " " + "ab" * 900 + "c")] + [(k, ("long" * 500 + " ") * 2 + "long" * 500 + "t") for k in range(5)]
    rows += [(1000 + k, "Chainabc " * 6 + "chainab " * (k < 45) + "chaina " * (k < 7)) for k in range(60)]  # a form of a form
    want = slow_variants(rows)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, word string").repartition(6)
    original = spelling.near_table
    monkeypatch.setattr(spelling, "near_table", lambda words: original(words, task_words=task_words))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 10 and any(v[0] != v[1] for v in want.values() if v[0])


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "short or rare words only")], "doc_id long, text string")).count() == 0


def test_first_pass_of_the_language_model_takes_every_text_once(spark, monkeypatch):
    original, seen = hmm_lm.counted, []

    def noted(sequences, model):
        seen.append(sorted(r.doc_id for r in sequences.select("doc_id").collect()))
        return original(sequences, model)

    monkeypatch.setattr(hmm_lm, "counted", noted)
    docs = spark.createDataFrame([(k, False, f"w{k % 7} w{k % 3} end") for k in range(30)], "doc_id long, held_out boolean, text string")
    lex = hmm_lm.lexicon(hmm_lm.word_counts(docs), 30, n_words=4, buckets=2)
    hmm_lm.train(hmm_lm.encoded(docs, lex).select("doc_id", "classes"), lex, states=3, rounds=1, blocks=4)
    assert len(seen) == 5 and sorted(k for s in seen[:4] for k in s) == list(range(30)) == seen[4]
