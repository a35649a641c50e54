"""Line dedup, near-duplicates, vectors, mixing: small cases against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from clausewise.llm import caps, linededup, mixing, ordermin
from clausewise.llm._shared import Scratch, components

DOCS = "doc_id long, text string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def sentences(rng, n):
    return " ".join(words(rng, rng.randint(4, 9)).capitalize() + "." for _ in range(n))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (200, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in (100, 101, 102, 200)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_line_dedup(spark):
    rng = random.Random(5)
    passage = sentences(rng, 12)
    own = [sentences(rng, 8) for _ in range(6)]
    rows = [(i, f"{own[i]}\n{passage}\n{words(rng, 9)}", "s", 0) for i in range(4)]
    rows += [(10, own[4], "s", 0), (11, own[4], "s", 0), (12, own[5], "s", 0), (12, own[5], "s", 0), (13, None, "s", 0), (14, "", "s", 0), (None, own[0], "s", 0), (15, "Released under the MIT License.", "s", 0), (16, "Released under the MIT License.", "s", 0)]
    got = {}
    for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert passage in got[0][0].text and got[0][0].removed_chunks > 0  # the null id comes first and has its first line
    for i in (1, 2, 3):
        assert passage not in got[i][0].text and own[i] in got[i][0].text and got[i][0].source == "s"
    assert got[10][0].text == own[4] and got[11][0].text == ""
    assert [r.text for r in got[12]] == [own[5]] * 2
    assert got[13][0].text is None and got[14][0].text == "" and got[None][0].text == own[0]
    assert got[16][0].text == "Released under the MIT License."
    clash = spark.createDataFrame([(1, "x", 5)], "doc_id long, text string, removed_chunks int")
    assert linededup.dedup_lines(clash).first().removed_chunks == 0
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_chunks_resist_shifts():
    rng = random.Random(6)
    lines = [words(rng, 12) for _ in range(60)]
    c = linededup.Chunking()
    cut = lambda t: {t[a:b] for a, b in c.chunks(t)}
    a, b = cut("\n".join(lines)), cut("\n".join(["new line here", *lines]))
    assert len(a & b) >= len(a) - 2
    for t in ("", "one", "a\n\n\nb", sentences(rng, 300), "x" * 50_000, "w " * 5000):
        spans = c.chunks(t)
        assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:], strict=False)) and all(0 <= p < q <= len(t) for p, q in spans)


def test_short_passages_go_wherever_they_stand(spark):
    rng = random.Random(16)
    short = lambda n: [words(rng, rng.randint(8, 14)) for _ in range(n)]
    rows, passages = [], []
    for k in range(40):
        lines, inside = short(5), sentences(rng, 9)
        for i in (2 * k, 2 * k + 1):
            about = [sentences(rng, rng.randint(3, 9)) for _ in range(2)]
            rows.append((i, "\n".join([*short(rng.randint(2, 7)), *lines, *short(rng.randint(2, 7)), f"{about[0]} {inside} {about[1]}"])))
        passages.append((lines, inside))
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (lines, inside) in enumerate(passages):
        assert got[2 * k] == rows[2 * k][1]
        own = rows[2 * k + 1][1].replace("\n".join(lines) + "\n", "").replace(inside + " ", "")
        assert got[2 * k + 1] == own


def test_long_sentences_are_cut_by_their_words():
    rng, c = random.Random(17), linededup.Chunking()
    met = 0
    for _ in range(100):
        passage = words(rng, 60)
        a, b = (set(c.keyed([f"{words(rng, rng.randint(20, 50))} {passage} {words(rng, 30)}"])[1].tolist()) for _ in range(2))
        met += bool(a & b)
    assert met >= 95


def test_cover_and_merge():
    rng = random.Random(18)
    points = lambda x: {p for a, b in x for p in range(a, b)}
    for _ in range(300):
        spans = sorted({(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 20)))})
        few = [spans[i] for i in linededup.cover(spans)]
        assert points(few) == points(spans) == points(linededup.merged(spans)) and len(few) <= len(spans)


def brute_lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_alignment_is_exact():
    rng = random.Random(7)
    for _ in range(200):
        x = [rng.randint(0, 30) for _ in range(rng.randint(1, 60))]
        y = [v for v in x if rng.random() > 0.06]
        for _ in range(rng.randint(0, 3)):
            y.insert(rng.randint(0, len(y)), rng.randint(0, 30))
        m = brute_lcs(x, y)
        want = m / max(len(x), len(y))
        got = ordermin.similarity(np.array(x, dtype="<u4"), np.array(y, dtype="<u4"), 0.8)
        assert (got == pytest.approx(want)) if want >= 0.8 else got == 0.0
    assert ordermin.similarity(np.zeros(0), np.zeros(0), 0.8) == 1.0


def brute_classes(rows):
    s = ordermin.Sketcher()
    texts = {}
    for doc_id, text in rows:
        if doc_id is not None:
            texts.setdefault(doc_id, []).append((text or "", s.words(text)))
    ids = sorted(texts)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and any(a[0] == b[0] or len(a[1]) and len(b[1]) and ordermin.similarity(a[1], b[1], 0.8) >= 0.8 for a in texts[i] for b in texts[j]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def edit(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


def test_near_duplicates(spark):
    rng = random.Random(8)
    base = [words(rng, 150) for _ in range(25)]
    shared = words(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, edit(rng, base[0], rng.randint(1, 4))) for i in range(60)]
    rows += [(200 + i, edit(rng, base[i], rng.randint(1, 6))) for i in range(1, 20)]
    rows += [(300 + i, f"{words(rng, 40)} {shared} {words(rng, 40)}") for i in range(30)]
    rows += [(400, base[3]), (401, base[3]), (402, None), (403, ""), (404, "one two"), (405, "one two"), (406, "One, two!"), (None, base[1]), (407, base[4]), (407, base[4]), (500, words(rng, 5000))]
    got = ordermin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    classes = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert classes == brute_classes(rows)
    assert [(r.class_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert ordermin.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_alignment_of_one_edited_place():
    x = np.arange(100, dtype="<u4")
    y = x.copy()
    y[40:45] += 1000
    assert ordermin.similarity(x, y, 0.8) == pytest.approx(0.95)
    assert ordermin.similarity(x, np.delete(y, 60), 0.8) == pytest.approx(0.94)
    assert ordermin.similarity(x, np.roll(x, 30), 0.8) == 0.0  # the same words in another order


def test_one_repeated_shingle_leaves_candidates():
    rng, s, met = random.Random(12), ordermin.Sketcher(), 0
    for _ in range(100):
        w, phrase = words(rng, 188).split(), words(rng, 6).split()
        one = [*w[:60], *phrase, *w[60:120], *phrase, *w[120:]]
        two = [*one]
        two[128] = "changed"
        x, y = s.shingles(" ".join(one)), s.shingles(" ".join(two))
        assert len(set(x)) < len(x) and len(set(y)) == len(y)
        met += bool(set(s.sketch(x)) & set(s.sketch(y)))
    assert met == 100


def test_copies_of_one_text_are_one_class(spark):
    rng, s = random.Random(13), ordermin.Sketcher()
    base = words(rng, 220)
    rows = [(500, base)]
    for i in range(1001):
        w = base.split()
        for at in rng.sample(range(5, 215, 10), 4):
            w[at] = words(rng, 1)
        rows += [(i, " ".join(w))] * (i != 500)
    x = s.words(base)
    assert all(ordermin.similarity(x, s.words(t), 0.8) >= 0.8 for _, t in rows)
    got = ordermin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1001 and {r.class_id for r in got} == {0}


def test_crowded_keys_are_compared_whole(spark):
    # few picks make keys that unlike texts share; brute force is over all pairs
    rng = random.Random(14)
    shared = words(rng, 100)
    rows = [(i, f"{words(rng, 15)} {shared} {words(rng, 15)}") for i in range(150)]
    rows += [(200 + i, edit(rng, rows[i * 7][1], 2)) for i in range(20)]
    got = ordermin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), picks=1, sketches=4).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


def test_ids_with_several_texts_and_clashing_columns(spark):
    rng = random.Random(19)
    a, b = words(rng, 80), words(rng, 80)
    rows = [(3, a), (5, a), (5, b), (12, b), (None, a), (20, words(rng, 30))]
    schema = "doc_id long, text string, class_id string, kept string, t string, node string, keys string"
    got = ordermin.near_duplicates(spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], schema)).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in got) == [(0, 0, True), (3, 3, True), (5, 3, False), (5, 3, False), (12, 3, False), (20, 20, True)]


def test_prefixes_meet():
    rng, s, met = random.Random(15), ordermin.Sketcher(), 0
    spread = np.array([rng.randint(0, 3) for _ in range(1 << 16)])
    for _ in range(300):
        t = words(rng, rng.randint(5, 120))
        x, y = s.words(t), s.words(edit(rng, t, rng.randint(0, 4)))
        p, q = (set(s.labelled(s.shingled(w.astype(np.uint64))).tolist()) for w in (x, y))
        if len(p & q) >= 0.8 * max(len(p), len(q)):
            met += 1
            assert set(s.prefix(x, spread, 0.8)) & set(s.prefix(y, spread, 0.8))
    assert met > 50


def test_vectors(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        rows.append((i, rng.standard_normal(16).tolist(), i % 3))
    for i in range(40):
        centre = np.array(rows[i % 4][1])
        rows.append((1000 + i, (centre + 0.05 * rng.standard_normal(16)).tolist(), (i % 4) % 3))
    rows += [(2000, rows[5][1], 2), (2001, rows[5][1], 2), (2001, rows[5][1], 2), (2002, None, 1), (2003, [0.0] * 16, 1), (2004, [float("nan")] * 16, 1), (2005, rows[5][1], None), (2006, [1.0, None], 1), (2007, [], 1), (2008, [1.0, 2.0], 1), (None, rows[5][1], 2)]
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)

    def sound(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, near = Counter(), {i: {i} for i, _, _ in rows}
    for a, (i, v, l) in enumerate(rows):
        for b, (j, w, k) in enumerate(rows):
            if a != b and l == k and sound(v, l) and sound(w, k) and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                n[a] += 1
                near[i].add(j)
    for _ in range(8):
        near = {i: set().union(*(near[j] for j in s)) for i, s in near.items()}
    want = sorted((str(i), n[a], str(i if i is None else min(x for x in near[i] if x is not None))) for a, (i, _, _) in enumerate(rows))
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want
    assert caps.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_decoding_lists_every_filter():
    f = caps.Filters(10, 20, 0.02)
    x = np.random.default_rng(2).standard_normal((30, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = f.rotate(x)
    assert np.allclose(np.linalg.norm(r, axis=1), 1)
    a, b = f._halves(r)
    for i, got in enumerate(f.decode(x)):
        sums = (a[i][:, None] + b[i][None, :]).ravel()
        want = np.flatnonzero(sums >= f.level)
        assert set(want) <= set(got) and (len(want) < caps.LEAST or set(want) == set(got))


def test_mixing(spark):
    rng = random.Random(10)
    rows = [(i, words(rng, rng.randint(1, 60)), "big" if i % 10 else ("small" if i % 20 else None), 0) for i in range(1, 1200)] + [(5000, None, "empty", 0), (5001, "", "big", 0), (None, "a b c", "big", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, repetition=3.0).collect()
    tokens, taken = Counter(), Counter()
    for _, t, s, _ in rows:
        tokens[s] += len((t or "").split())
    for r in got:
        taken[r.source] += r.mix_tokens
    assert {(r.doc_id, r.text) for r in got} >= {(a, b) for a, b, _, _ in rows}
    weights = {r.source: r.mix_weight for r in got}
    budget = max(tokens[s] / w for s, w in weights.items() if w)
    for s, w in weights.items():
        if w:
            assert w * budget - 61 <= taken[s] <= w * budget * (1 + 1e-5) + 1, s
            assert taken[s] <= 3.0 * tokens[s] * 1.001
    assert max(taken[s] / tokens[s] for s in tokens if tokens[s]) == pytest.approx(3.0, rel=0.1)
    # a budget too small for a whole block keeps a prefix of each permutation
    few = mixing.mix(docs, repetition=3.0, budget=3000.0).collect()
    assert 0 < sum(r.mix_tokens for r in few) <= 3000 and {r.mix_block for r in few} == {0}
    flat = mixing.mix(docs, entropy=1.05)
    h = {r.source: r.mix_weight for r in flat.collect()}
    assert -sum(w * math.log(w) for w in h.values() if w) == pytest.approx(1.05, abs=1e-3)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(spark.createDataFrame([(1, "a b", "s", 9)], "doc_id long, text string, source string, mix_block int")).count() == 1
