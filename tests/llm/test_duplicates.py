"""Exact groups, near vectors, Jaccard components and connected components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from pairwright.llm import exact_dedup, jaccard, near_vectors
from pairwright.llm.common import connected_components


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_noise(spark):
    draw = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    links += [(draw.randint(400, 700), draw.randint(400, 700)) for _ in range(200)]
    frame = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    expected = components({n for e in links if e[0] != e[1] for n in e}, links)
    assert {r.node: r.component for r in connected_components(frame).collect()} == expected
    assert connected_components(frame.limit(0)).count() == 0


def test_exact_groups(spark):
    rows = [(i, "hot", "x") for i in range(500)] + [(1000, None, "x"), (1001, "", "x"), (1002, "Hot", "x"), (1003, "a" * 300_000, "x")]
    rows += [(1004, "twice", "x"), (1004, "twice", "x"), (None, "twice", "x"), (None, "alone", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    found = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(docs, support=0.01).collect()}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t, _ in rows:
        r = found[i, hashlib.sha256((t or "").encode()).hexdigest()]
        ids = [j for j in groups[t or ""] if j is not None]
        keep = max(ids) if ids else None
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(groups[t or ""]), i == keep)
    kept = exact_dedup.drop_exact_copies(docs, support=0.01)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1001", "1002", "1003", "1004", "499", "None"]
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    assert exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [1 << 20, 0])
def test_every_text_keeps_one_row(spark, monkeypatch, ids):
    monkeypatch.setattr(exact_dedup, "BROADCAST_IDS", ids)
    rows = [(1, "A"), (2, "A"), (1, "B only here"), (7, "D"), (7, "D"), (None, "C"), (None, "C"), (None, "A"), (3, None), (4, "")]
    rows += [(k, "hot") for k in range(10, 200)] + [(500, "hot")] * 50
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row long")
    kept = exact_dedup.drop_exact_copies(docs.repartition(5)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "C"), (1, "B only here"), (2, "A"), (4, ""), (7, "D"), (500, "hot")]
    assert all(rows[r.row] == (r.doc_id, r.text) for r in kept)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(words[i:] for i in range(k)))) if len(words) >= k else frozenset([tuple(words)] if words else [])


def jaccard_texts():
    draw = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "A", "a"]
    texts = [None, "", "  \n", "one", "ONE", "one two", "one\xa0two", "x " * 5000]
    passage = " ".join(draw.choices(words, k=30))
    for _ in range(30):
        base = draw.choices(words, k=draw.choice([3, 5, 20, 60, 200]))
        for _ in range(draw.randint(1, 6)):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 25))):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy) + draw.choice(["", "", f" {passage}"]))
    return texts


def expected_components(texts, k, share):
    sets = [shingles(t, k) for t in texts]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j])
    ]
    found = components(range(len(sets)), links)
    return {i: (len(s), found[i]) for i, s in enumerate(sets)}


def test_jaccard_components(spark):
    texts = jaccard_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    for k, share in ((4, 85), (5, 80)):
        for tile in (512, 3):
            spec = jaccard.JaccardSpec(words=k, share=share, tile=tile)
            found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, spec).collect()}
            assert found == expected_components(texts, k, share)
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in expected_components(texts, 5, 80).items() if c == i}
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    found = sorted(map(tuple, jaccard.jaccard_components(docs).collect()), key=str)
    assert found == sorted([(3, 2, 1), (3, 2, 1), (1, 2, 1), (None, 2, None)], key=str)


def test_bounds_and_intersections():
    draw = np.random.default_rng(4)
    spec = jaccard.JaccardSpec(share=80)
    universe = np.unique(draw.integers(0, 1 << 63, 400).astype(np.uint64))
    sets = [np.sort(draw.choice(universe[:120], n, replace=False)) for n in draw.integers(1, 60, 40)]
    sets += [np.sort(np.append(s[1:], universe[200 + i])) for i, s in enumerate(sets)]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - c)
    ]
    found = jaccard.tile_links(np.arange(len(sets)), sets, spec)
    assert components(range(len(sets)), found) == components(range(len(sets)), links)


def test_near_vectors(spark):
    draw = np.random.default_rng(2)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = draw.standard_normal(16)
            for _ in range(int(draw.integers(1, 9))):
                rows.append((k, (base + 0.25 * draw.standard_normal(16)).tolist(), label, "x"))
                k += 1
    rows += [(k, rows[0][1], 0, "x"), (k + 1, [2.0 * v for v in rows[0][1]], 0, "x"), (k + 2, None, 0, "x"), (k + 3, [], 0, "x")]
    rows += [(k + 4, [0.0] * 16, 0, "x"), (k + 5, [float("nan")] * 16, 0, "x"), (k + 6, [1e300] * 16, 0, "x")]
    rows += [(k + 7, [1.0, None], 0, "x"), (k + 8, [1.0, 0.0], 0, "x"), (k + 9, [-1e300] * 16, 0, "x"), (k + 10, [3.0] * 16, 0, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or not a[1] or not b[1] or len(a[1]) != len(b[1]) or None in a[1] + b[1]:
            return False
        x, y = np.array(a[1]), np.array(b[1])
        if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
            return False
        x, y = x / abs(x).max(), y / abs(y).max()
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93

    pairs = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[:i] if linked(a, b)]
    found = components([r[0] for r in rows], pairs)
    degree = {r[0]: sum(r[0] in p for p in pairs) for r in rows}
    assert len(pairs) > 30
    for tile in (512, 2):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.cosine_components(frame, tile=tile).collect()}
        assert got == {i: (degree[i], found[i], found[i] == i) for i in found}
    assert near_vectors.cosine_components(frame.limit(0)).count() == 0


def test_repeated_vector_ids(spark):
    """An id under two labels or with several vectors has a row for each; equal rows are one vector."""
    a, near, other = [1.0, 0.0, 0.1], [1.0, 0.05, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (2, near, 0), (1, a, 1), (3, near, 1), (4, near, 1), (5, a, 0), (5, other, 0), (6, other, 0)]
    rows += [(7, other, 1), (7, other, 1), (8, other, 1), (None, a, 0), (9, a, None), (10, other, 2), (10, near, 2)]
    vectors = sorted({(i, tuple(v), lab) for i, v, lab in rows if i is not None and lab is not None})

    def linked(x, y):
        u, v = np.array(x[1]), np.array(y[1])
        return x[2] == y[2] and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93

    pairs = [(x, y) for k, x in enumerate(vectors) for y in vectors[:k] if linked(x, y)]
    root = components(vectors, pairs)
    least = {}
    for v in vectors:
        least[root[v]] = min(least.get(root[v], v[0]), v[0])
    expected = []
    for i, v, lab in rows:
        x = (i, tuple(v), lab)
        if x in root:
            expected.append((i, sum(x in p for p in pairs), least[root[x]], i == least[root[x]]))
        else:
            expected.append((i, 0, i, True))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in near_vectors.cosine_components(frame.repartition(3), tile=2).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_keys_meet_the_recall():
    draw = np.random.default_rng(9)
    bits, tables = near_vectors.hash_plan(50_000, 0.93, 0.9999)
    x = draw.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = draw.standard_normal(x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    met = (near_vectors.sign_keys(x, bits, tables, 7) == near_vectors.sign_keys(y, bits, tables, 7)).any(1)
    assert met.mean() > 0.998
