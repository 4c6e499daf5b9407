"""SimHash, embeddings, components and line templates against brute force, and their edge cases."""

from __future__ import annotations

import random
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from plumbline.llm import common, components, embedding_dedup, line_templates, shingle_pairs, simhash

DOCS = "doc_id bigint, text string, count int, tile string"


def groups(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def near_texts(rng, n):
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    base = [" ".join(rng.choice(words, 200)) for _ in range(n)]
    out = list(base)
    for k, text in enumerate(base[: n // 3]):
        changed = text.split()
        changed[k % 190] = "CHANGED"
        out += [" ".join(changed), text]
    return out


def test_simhash_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [*near_texts(rng, 60), None, "", " \t\n\x0b\x0c\r", "one", "One", "a b c", "ÀB\u00a0c d", "x " * 200_000, "É é"]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    assert [int(got[k].fingerprint, 16) for k in range(len(texts))] == prints
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert [got[k].component_id for k in range(len(texts))] == groups(len(texts), links)


def test_simhash_null_ids_repeats_and_empty_table(spark):
    rows = [(None, "a b c d e", 1, ""), (5, "a b c d e", 1, ""), (5, "a b c d e", 1, ""), (None, "quite other words stand here now", 1, "")]
    got = sorted(simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect(), key=str)
    assert [r.component_id for r in got if r.doc_id == 5] == [5, 5]
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == [5, None]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_cuts_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1 << 62))
    prints = sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (150, 2))} | {int(x) for x in rng.integers(1 << 62, size=50)})
    nodes = spark.createDataFrame([(p, k) for k, p in enumerate(prints)], "fp bigint, node bigint")
    found = {r.node: r.component for r in components.connected_components(simhash.fingerprint_links(nodes)).collect()}
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert [found.get(k, k) for k in range(len(prints))] == groups(len(prints), links)


def word_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard_links(texts):
    sets = [word_shingles(t) for t in texts]
    near = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    return [(a, b) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])]


def test_pipeline_stage_finds_near_copies_by_jaccard(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, rng.integers(3, 120))) for _ in range(60)]
    for k in range(150):
        changed = texts[int(rng.integers(len(texts)))].split()
        for at in rng.integers(0, len(changed), rng.integers(0, 4)):
            changed[at] = f"changed{k}"
        texts.append(" ".join(changed))
    common = " ".join(words[:20])
    texts += [f"{common} {' '.join(rng.choice(words, 6))}" for _ in range(40)] + ["", " ", None, "one", "One"]
    links = jaccard_links(texts)
    prints = [simhash.fingerprint((t or "").encode(), 5) for t in texts]
    assert sum((prints[a] ^ prints[b]).bit_count() > 4 for a, b in links) > 20
    want = groups(len(texts), links)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in shingle_pairs.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == want
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([*{k for k in range(len(texts)) if want[k] == k}, None], key=str)
    assert shingle_pairs.near_duplicates(df.limit(0)).count() == 0


def test_near_copies_with_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(shingle_pairs, "FREQUENT", 2)
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{int(x)}" for x in np.r_[0:40, rng.integers(40, 44, rng.integers(0, 14))]) for _ in range(80)]
    got = {r.doc_id: r.component_id for r in shingle_pairs.near_duplicates(spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], DOCS)).collect()}
    assert [got[k] for k in range(len(texts))] == groups(len(texts), jaccard_links(texts))


def test_near_copies_of_one_shingle_in_many_texts_meet_by_size(spark, monkeypatch):
    """A passage in a third of all texts, none of which is a copy of the smallest, and chains of near copies of many sizes."""
    monkeypatch.setattr(shingle_pairs, "LARGE", 3)
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(30)]
    texts = [" ".join([*passage, *(f"own{k}x{j}" for j in range(int(rng.integers(1, 90))))]) for k in range(60)]
    for k in range(120):
        words = texts[int(rng.integers(len(texts)))].split()
        del words[len(words) - int(rng.integers(0, 1 + len(words) // 8)) :]
        texts.append(" ".join([*words, f"new{k}"]))
    got = {r.doc_id: r.component_id for r in shingle_pairs.near_duplicates(spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], DOCS)).collect()}
    assert [got[k] for k in range(len(texts))] == groups(len(texts), jaccard_links(texts))


def test_components_of_long_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1400)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    assert all(found[k] == 0 for k in range(201)) and all(found[k] == 1000 for k in range(1000, 1400))
    assert components.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_component_rounds_of_a_badly_numbered_path(spark):
    n = 1000
    path = [(0, n), *((k, k - 1) for k in range(n, 1, -1))]
    links = spark.createDataFrame([*path, *((b, a) for a, b in path)], "src bigint, dst bigint")
    assert len(components.contraction(links)) <= 20
    assert {r.component for r in components.connected_components(links).collect()} == {0}


def test_tile_pairs_out_of_reach_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    prints = [(1 << k) - 1 for k in range(2, 50)]  # one value in the upper blocks, population counts from 2 to 49
    nodes = spark.createDataFrame([(p, k) for k, p in enumerate(prints)], "fp bigint, node bigint")
    pieces = simhash.large_tile_pairs(simhash.banded(nodes, 4), 4)
    ones = [((r.i >> 32), (r.j >> 32)) for r in pieces.select("i", "j").distinct().collect()]
    assert ones and all(abs(a - b) <= 4 for a, b in ones)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_equal_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 24))
    near = base[:40] + rng.normal(size=(40, 24)) * rng.uniform(0.05, 0.6, (40, 1))
    vectors = np.concatenate([base, near, base[:10], base[:10] * 7.5, np.tile(base[0], (30, 1))]).astype(np.float32)
    rows = [(k, v.tolist(), k) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, links int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, tile=32).collect()}
    wide = vectors.astype(float)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    assert [got[k].n_links for k in range(len(rows))] == linked.sum(axis=1).tolist()
    want = groups(len(rows), zip(*map(list, np.nonzero(linked)), strict=True))
    assert [got[k].component_id for k in range(len(rows))] == want
    assert all(got[k].kept == (want[k] == k) for k in range(len(rows)))


def test_vectors_without_links(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [-0.0, -0.0])]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == ((1 if r.vec_id == 7 else 0), r.vec_id)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 48)) * rng.lognormal(0, 2, (300, 48))
    codes, scale, error = embedding_dedup.quantise(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rough = codes * scale[:, None]
    assert (np.abs(unit @ unit.T - rough @ rough.T) <= error[:, None] + (1 + error[:, None]) * error[None, :] + 1e-12).all()


def lines_left(spark, texts, **limits):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], DOCS)
    rows = line_templates.drop_recurring_lines(df, **limits).collect()
    assert {"count", "tile"} <= set(rows[0].asDict()) if rows else True
    return {r.doc_id: r.text for r in rows}


def test_exact_lines_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    shared = [" ".join(word() for _ in range(n)) for n in (5, 9, 60, 4, 2)]
    texts = []
    for k in range(40):
        lines = [" ".join(word() for _ in range(rng.integers(1, 30))) for _ in range(4)]
        texts.append("\n".join([*lines, shared[k % 5], lines[0]]))
    seen = defaultdict(set)
    for k, t in enumerate(texts):
        for line in t.split("\n"):
            seen[line].add(k)
    want = {k: "\n".join(x for x in t.split("\n") if len(x.split()) < 5 or min(seen[x]) == k) for k, t in enumerate(texts)}
    assert lines_left(spark, texts) == want


def test_variable_fields_are_generalised(spark):
    names = ["anna", "boris", "clara", "dmitri", "elena", "farid"]
    alone = [" ".join(f"{n}{w}" for w in ("alone", "stands", "here", "without", "copies")) for n in names]
    texts = [f"{a}\non the public board today spoke {n}\nitem {k} of {k + 7} was seen here again" for k, (n, a) in enumerate(zip(names, alone, strict=True))]
    left = lines_left(spark, texts)
    assert left[0] == texts[0]
    assert all(left[k] == texts[k].split("\n")[0] for k in range(1, 6))
    few = lines_left(spark, texts[:3])
    assert few == dict(enumerate(texts[:3]))


def test_line_edge_cases(spark):
    long = " ".join(f"w{k}x" for k in range(60_000))
    left = lines_left(spark, [None, "", "a b c d e", "a b c d e", "a b c", "a b c", long, long + "\nrest of it"])
    assert left == {0: None, 1: "", 2: "a b c d e", 3: "", 4: "a b c", 5: "a b c", 6: long, 7: "rest of it"}
    assert lines_left(spark, []) == {}
    twice = spark.createDataFrame([(1, "a b c d e f", 1, ""), (1, "a b c d e f", 1, ""), (None, "g h i j k", 1, ""), (None, "g h i j k", 1, "")], DOCS)
    assert sorted(r.text for r in line_templates.drop_recurring_lines(twice).collect()) == ["a b c d e f"] * 2 + ["g h i j k"] * 2


def test_several_templates_and_a_hot_line_in_one_leaf(spark):
    rng = np.random.default_rng(9)
    name = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 9))
    shapes = ["this page was last edited by {} today", "this page was then checked by {} again", "this page was never seen by {} before"]
    hot = "this page was made in one single day"
    texts = [f"{name()} own\n{shapes[k % 3].format(name())}\n{hot if k % 2 else name()}" for k in range(120)]
    left = lines_left(spark, texts)
    for k, text in enumerate(texts):
        own, template, other = text.split("\n")
        want = [own] + ([template] if k < 3 else []) + ([other] if other != hot or k == 1 else [])
        assert left[k].split("\n") == want, k


def test_short_lines_go_when_they_recur_often(spark):
    texts = [f"alone{k} words\nRead more\n\n\t\n{'Home' if k < 9 else 'Away'}" for k in range(30)]
    left = lines_left(spark, texts)
    assert left[0] == texts[0]
    assert left[5] == "alone5 words\n\n\t\nHome"
    assert left[9] == "alone9 words\n\n\t\nAway"
    assert left[20] == "alone20 words\n\n\t"


def test_rows_of_numbers_stay(spark):
    rng = random.Random(5)
    number = lambda: f"{rng.uniform(0, 900):.2f}"
    rows = [(k, "\n".join([f"{chr(97 + k) * 5} its own {chr(98 + k) * 4} words", " ".join(number() for _ in range(6)), f"2024-01-{k + 1:02d} {number()} {number()} {number()} {number()}"])) for k in range(20)]
    rows += [(100 + k, f"Report {rng.random()} was printed at {number()} by the office\n{'abcdefghijklmnopqrst'[k]} own line that only this document has") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(df).collect()}
    for k, text in rows:
        assert got[k].n_dropped == (1 if k > 100 else 0), text
        if k <= 100:
            assert got[k].text == text


def test_short_lines_with_a_number_are_generalised(spark):
    rows = [(k, f"Page {k} of 90\n{k} {k + 1}\nown {'x' * (k + 1)} words of this one document") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(df).collect()}
    assert all(got[k] == (t if k == 0 else t.split("\n", 1)[1]) for k, t in rows)


def test_templates_equal_brute_force(spark):
    """Leaf statistics, templates and dropped lines by plain loops over a random corpus of templates, data and prose."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    forms = [["seen", "on", "the", "site", "by", None, "and", "friends"], ["seen", "on", "the", "site", "of", "our", None, "today"], ["sold", "at", "the", None, "store", "for", "2", "euros"]]
    docs = []
    for k in range(60):
        lines = [" ".join(w or word() for w in rng.choice(forms)) for _ in range(3)] + [" ".join(word() for _ in range(7)), f"ref {rng.random()} {rng.random()} {rng.random()} {word()}"]
        rng.shuffle(lines)
        docs.append((k, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(df).collect()}

    masked = lambda line: tuple("<*>" if any(c.isdigit() for c in w) else w for w in line.split())
    have = {}
    for k, text in docs:
        for line in text.split("\n"):
            have.setdefault(masked(line), set()).add(k)
    leaf = lambda m: (len(m), m[:3])
    counts = {}
    for m, where in have.items():
        for at, w in enumerate(m[3:], 3):
            counts[leaf(m), at, w] = counts.get((leaf(m), at, w), 0) + len(where)
    members = {}
    for m in have:
        members.setdefault(leaf(m), []).append(m)

    def template(m):
        own = [(at, w, counts[leaf(m), at, w]) for at, w in enumerate(m[3:], 3)]
        if len(members[leaf(m)]) < 2 or sum(len(have[x]) for x in members[leaf(m)]) < 5:
            return None
        middle = sorted(n for *_, n in own)[len(own) // 2]
        fixed = [(at, w) for at, w, n in own if n >= middle / 2]
        if middle >= 5 and len(fixed) < len(own) and sum(w != "<*>" for _, w in fixed) >= len(own) / 2:
            return (leaf(m), tuple(fixed))
        return None

    exact, by_template = {}, {}
    for k, text in docs:
        for line in set(text.split("\n")):
            exact.setdefault(line, set()).add(k)
            m = masked(line)
            t = template(m) or (m if m != tuple(line.split()) and sum(w != "<*>" for w in m) >= len(m) / 2 else None)
            by_template.setdefault(t, set()).add(k)
    dropped = 0
    for k, text in docs:
        left = []
        for line in text.split("\n"):
            m = masked(line)
            t = template(m) or (m if m != tuple(line.split()) and sum(w != "<*>" for w in m) >= len(m) / 2 else None)
            goes = len(exact[line]) >= 2 and min(exact[line]) != k or t is not None and len(by_template[t]) >= 5 and min(by_template[t]) != k
            dropped += goes
            left += [] if goes else [line]
        assert got[k] == "\n".join(left)
    assert dropped > 100


def test_text_of_very_many_lines(spark):
    many = [f"line {'abcdefghij'[k % 10]} of text number w{k} here" for k in range(200_000)]
    rows = [(1, "\n".join(many[:100_000])), (2, "\n".join(many)), (2, "\n".join(many)), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    began = time.time()
    got = sorted(line_templates.drop_recurring_lines(df, min_template_docs=5).collect(), key=lambda r: (r.doc_id, r.text))
    assert time.time() - began < 60
    assert [r.n_dropped for r in got] == [0, 100_000, 100_000, 0]
    assert [r.text for r in got] == [rows[0][1], "\n".join(many[100_000:]), "\n".join(many[100_000:]), "short"]


@pytest.mark.parametrize("scale", [1e160, 1e-170, 1.0])
def test_vectors_of_extreme_length_link(spark, scale):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    near = base + rng.normal(scale=0.02, size=base.shape)
    x = np.array([1.0, 0.0, *[0.0] * 14])
    edge = [x, 0.9000001 * x + np.sqrt(1 - 0.9000001**2) * np.roll(x, 1), 0.8999999 * x + np.sqrt(1 - 0.8999999**2) * np.roll(x, 2)]
    rows = np.vstack([base, near, edge])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(k, [float(v) for v in r * scale], 0) for k, r in enumerate(rows)], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()}
    assert [got[k] for k in range(len(rows))] == want.tolist()


def test_near_copies_are_met_by_their_fingerprints(spark):
    """The pairs of the SimHash step are those that plain comparison of fingerprints spans."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 5000, 200)) for _ in range(20)]
    texts += [" ".join([*t.split()[:-1], "other"]) for t in texts[:10]]
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    want = groups(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    sets = shingle_pairs.prefix_table(spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], DOCS), np.zeros(0, np.int64))
    place = {r.key: r.doc_id for r in sets.collect()}
    pairs = [(place[r.src], place[r.dst]) for r in shingle_pairs.simhash_pairs(sets).collect()]
    assert groups(len(texts), pairs) == want and len(pairs) > 3


def test_near_copies_leave_no_table_as_large_as_the_texts(spark):
    words = [f"w{k}" for k in range(60)]
    df = spark.createDataFrame([(k, " ".join([*words[: 50 + k % 3], f"x{k}"] if k % 2 else [f"y{k}-{i}" for i in range(20)])) for k in range(40)], "doc_id long, text string")
    with common.noted_folders() as made:
        found = shingle_pairs.near_duplicates(df).collect()
    assert {r.component_id for r in found if r.doc_id % 2} == {1} and len({r.component_id for r in found}) == 21
    left = [Path(p).name.rsplit("-", 1)[0] for p in made if Path(p.removeprefix("file:")).exists()]
    assert "star-links" in left  # read by the result
    assert not {"prefixes", "set-prefixes", "shared-shingles", "asked-sets", "shingle-sets", "placed-shingles", "open-shingles"} & set(left)


def joined_rows(spark, since: int, column: str) -> int:
    """Rows that joins by a column made in the runs from number ``since`` on."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    for run in range(since, store.executionsCount()):
        graph, found = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for k in range(graph.size()):
            node = graph.apply(k)
            for m in range(node.metrics().size()) if "Join" in node.name() and f"[{column}" in node.desc().split("Inner")[0] and "own" in node.desc() else ():
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and found.contains(metric.accumulatorId()):
                    total += int(found.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_a_passage_in_many_texts_makes_no_pairs(spark, monkeypatch):
    """The sample does not know the passage, and its shingles stand in most prefixes."""
    monkeypatch.setattr(shingle_pairs, "FREQUENT", 10**9)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([*(f"own{k}x{j}" for j in range(200 + k % 20)), *passage]) for k in range(150)]
    texts += [f"{texts[k]} more" for k in range(0, 150, 10)]
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r.doc_id: r.component_id for r in shingle_pairs.near_duplicates(spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], DOCS)).collect()}
    assert [got[k] for k in range(len(texts))] == groups(len(texts), jaccard_links(texts))
    assert joined_rows(spark, before, "shingle") < 20 * len(texts)


@pytest.mark.parametrize("many", [1, 3])
def test_near_copies_whose_common_shingles_many_texts_have(spark, monkeypatch, many):
    monkeypatch.setattr(shingle_pairs, "MANY", many)
    monkeypatch.setattr(shingle_pairs, "LARGE", 12)
    monkeypatch.setattr(shingle_pairs, "FREQUENT", 10**9)
    rng = np.random.default_rng(many)
    stock = [[f"p{s}x{k}" for k in range(12)] for s in range(12)]
    texts = []
    for k in range(60):
        words = [w for s in rng.permutation(12)[: rng.integers(2, 9)] for w in stock[s]]
        texts.append(" ".join([*words, *(f"own{k}x{j}" for j in range(int(rng.integers(0, 20))))]))
    for k in range(140):
        words = texts[int(rng.integers(len(texts)))].split()
        cut = int(rng.integers(0, 2 + len(words) // 5))
        texts.append(" ".join(words[cut:] if k % 2 else [*words, *(f"new{k}x{j}" for j in range(cut))]))
    got = {r.doc_id: r.component_id for r in shingle_pairs.near_duplicates(spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], DOCS)).collect()}
    want = groups(len(texts), jaccard_links(texts))
    assert 5 < len(set(want)) < 150
    assert [got[k] for k in range(len(texts))] == want
