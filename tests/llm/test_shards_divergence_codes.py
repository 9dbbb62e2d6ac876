"""Ring shards, source divergence and vector codes against plain Python."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairwright.llm import divergence, ring, vector_codes

# ---------------------------------------------------------------- shards


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def ring_of(spec):
    points = []
    for i in range(spec.shards * spec.nodes):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
        points.append((signed(xxhash.xxh64_intdigest(b"node", seed)), i // spec.nodes))
    return sorted(points)


def walk(texts, spec):
    """How many rows of each text every shard takes, one row after the other."""
    points, n = ring_of(spec), len(texts)
    arc_of = lambda key: next((i for i, (p, _) in enumerate(points) if key <= p), 0)
    keys = {t: signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in set(texts)}
    room = [n // spec.shards + (s < n % spec.shards) for s in range(spec.shards)]
    if spec.slack:
        room = [math.ceil((1 + spec.slack) * n / spec.shards)] * spec.shards
    counts, taken = Counter(texts), defaultdict(Counter)
    for single in (False, True):
        waiting = [
            (arc_of(keys[t]), place, t)
            for place, t in enumerate(t for t in sorted(keys, key=keys.get) if (counts[t] == 1) == single for _ in range(counts[t]))
        ]
        waiting = [(at, (at, place), t) for at, place, t in waiting]
        while waiting:
            left = []
            for at, place, t in sorted(waiting, key=lambda w: w[1]):
                shard = points[at][1]
                if room[shard]:
                    room[shard] -= 1
                    taken[t][shard] += 1
                else:
                    left.append((at, place, t))
            waiting = []
            for at, place, t in left:
                while not room[points[at := (at + 1) % len(points)][1]]:
                    pass
                waiting.append((at, place, t))
    return taken


def place(spark, rows, spec):
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string, shard string").repartition(5)
    return ring.ring_shards(docs, spec).collect()


@pytest.mark.parametrize("spec", [ring.RingSpec(8, 16), ring.RingSpec(3, 5, slack=0.25), ring.RingSpec(1, 1)])
def test_ring_equals_row_by_row_walk(spark, spec):
    draw = random.Random(3)
    texts = [None, "", "é" * 2000] + [f"text {i}" for i in range(700)] + ["hot"] * 300
    texts += [f"pair {i}" for i in range(60) for _ in range(draw.randint(2, 5))]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(8, "text 5", "x", "y"), (None, "no id", "x", "y")]
    found = place(spark, rows, spec)
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    slots, shards = defaultdict(list), defaultdict(Counter)
    by_id = {r[0]: r[1] or "" for r in rows}
    for r in found:
        text = by_id[r.doc_id]
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        slots[r.shard].append(r.slot)
        shards[text][r.shard] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if not spec.slack:
        sizes = [len(slots[s]) for s in range(spec.shards)]
        assert max(sizes) - min(sizes) <= 1
    assert shards == walk([r[1] or "" for r in rows], spec)
    cut = [t for t, c in shards.items() if len(c) > 1]
    assert spec.slack or len(cut) <= 2  # the hot text and where it pushes on


def test_ring_of_few_and_no_rows(spark):
    assert place(spark, [], ring.RingSpec()) == []
    found = place(spark, [(1, "a", "", ""), (2, "b", "", ""), (3, None, "", "")], ring.RingSpec())
    assert len({r.shard for r in found}) == 3 and {r.slot for r in found} == {0}
    with pytest.raises(ValueError):
        ring.RingSpec(shards=0)


def test_a_new_shard_moves_few_rows_with_slack(spark):
    rows = [(i, f"text {i}", "", "") for i in range(4000)]
    before = {r.doc_id: r.shard for r in place(spark, rows, ring.RingSpec(8, 64, 0.25))}
    after = {r.doc_id: r.shard for r in place(spark, rows, ring.RingSpec(9, 64, 0.25))}
    assert sum(before[i] != after[i] for i in before) < 4000 * 0.25


def test_shards_are_written_with_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 7}", i * 2) for i in range(50)], "doc_id long, text string, slot long")
    ring.write_shards(docs, f"file://{tmp_path}/out", ring.RingSpec(4, 8))
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(tuple, back.drop("shard").collect())) == sorted(map(tuple, docs.collect()))
    sizes = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_cells_of_keys_do_not_change_the_shards_sizes(spark, monkeypatch):
    monkeypatch.setattr(ring, "KEYS_PER_CELL", 1)
    rows = [(i, f"text {i % 900}", "", "") for i in range(1500)]
    found = place(spark, rows, ring.RingSpec(4, 3))
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(375)) for s in slots.values()) and len(slots) == 4


# ---------------------------------------------------------------- divergence


def audit(rows, spec):
    """lang, source, part, item, value, rank by the definition."""
    words = [
        (lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")])
        for lang, source, text in rows
    ]
    out = []
    for lang in {w[0] for w in words}:
        mine = [w for w in words if w[0] == lang]
        docs = Counter(t for _, _, ts in mine for t in set(ts))
        kept = {t for t, n in docs.items() if n >= spec.documents}
        counts = {s: Counter() for _, s, _ in mine}
        for _, s, ts in mine:
            counts[s].update(t for t in ts if t in kept)

        def share(c):
            total = sum(c.values())
            return {t: 1 + spec.scale * (c[t] + spec.smoothing) // (total + spec.smoothing * len(kept)) for t in kept}

        shares, whole = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s, p in shares.items():
            pairs = [(o, sum(abs(p[t] - q[t]) for t in kept)) for o, q in shares.items() if o != s]
            terms = [(t, p[t] - whole[t]) for t in kept if counts[s][t] and p[t] > whole[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, spec.top)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


@pytest.mark.parametrize("spec", [divergence.DivergenceSpec(), divergence.DivergenceSpec(2, 3, 1000, 4)])
def test_divergence_equals_its_definition(spark, spec):
    draw = random.Random(11)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Ärger", "日本", "éà", "don"]
    rows = []
    for i in range(300):
        lang = draw.choice(["en", "de", None, ""])
        source = draw.choice(["hot", "hot", "hot", "a", "B", "é", None])
        text = " ".join(draw.choice(vocabulary[: draw.randint(1, 64)]) for _ in range(draw.randint(0, 40)))
        rows.append((lang, source, draw.choice([text, text.upper(), text.replace(" ", "-1'")])))
    rows += [("xx", "only", None), ("xx", "other", "..."), ("en", "wordless", ""), rows[0], rows[0]]
    rows += [("en", "long", "wide word's " * 200_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, term long")
    found = divergence.source_divergence(docs.repartition(6), spec)
    assert sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect())) == audit(rows, spec)
    assert divergence.source_divergence(docs.limit(0), spec).count() == 0


def test_counts_passed_on_early_change_nothing(spark, monkeypatch):
    rows = [("en", "abc"[i % 3], f"alpha beta {'xyz'[i % 3]}") for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    batches = docs.select("lang", "source", F.col("text").cast("binary")).toArrow().to_batches(max_chunksize=7)
    total = {}
    for held in (1 << 19, 2):
        monkeypatch.setattr(divergence, "_HELD", held)
        monkeypatch.setattr(divergence, "_SLICE", 4)
        total[held] = Counter()
        for batch in divergence._count_terms(iter(batches)):
            for r in batch.to_pylist():
                total[held][r["lang"], r["source"], r["term"]] += 1000 * r["n"] + r["docs"]
    assert total[2] == total[1 << 19] and total[2]["en", "a", b"alpha"] == 14 * 1001


# ---------------------------------------------------------------- codes


def plain_codes(rows, spec):
    kept = [(i, label, v) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    whole = [[math.floor(spec.scale * x) if abs(x) < 2**53 else int(x) * spec.scale for x in v] for _, _, v in kept]
    width = len(whole[0]) // spec.parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(spec.parts)] for v in whole]
    books = [[c[p] for c in cut[: spec.entries]] for p in range(spec.parts)]

    def nearest(p, x):
        distances = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return min(zip(distances, range(len(distances))))

    for _ in range(spec.rounds):
        moved = []
        for p in range(spec.parts):
            members = defaultdict(list)
            for c in cut:
                members[nearest(p, c[p])[1]].append(c[p])
            moved.append([
                tuple(sum(col) // len(members[e]) for col in zip(*members[e])) if e in members else old
                for e, old in enumerate(books[p])
            ])
        books = moved
    coded = [[nearest(p, c[p]) for p in range(spec.parts)] for c in cut]
    labels = Counter()
    for (_, label, _), c in zip(kept, coded):
        labels[label] += sum(d for d, _ in c)
    told = ",".join(str(v) for part in books for e in part for v in e)
    return (
        [(i, "".join(f"{e:02x}" for _, e in c), sum(d for d, _ in c), labels[label]) for (i, label, _), c in zip(kept, coded)],
        hashlib.sha256(told.encode()).hexdigest(),
    )


def coded(spark, rows, spec, kind="double"):
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("code", F.lit(1))
    books = vector_codes.fit_codebooks(vectors.repartition(4), spec)
    found = vector_codes.encode_vectors(vectors, books, spec)
    return sorted(map(tuple, found.collect()), key=str), vector_codes.codebooks_sha256(books), (found, books)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_codes_equal_plain_search(spark, kind):
    draw, spec = np.random.default_rng(4), vector_codes.CodeSpec()
    x = draw.normal(size=(400, 64)).astype(np.float32) / 8
    x[50:80] = x[50]  # ties and repeated rows
    rows = [(i, x[i].tolist(), [None, 0, 1, 1, 1][i % 5]) for i in range(400)]
    rows += [(400, None, 1), (401, [float("nan")] * 64, 1), (402, [None] + [0.0] * 63, 1), (403, [float("inf")] * 64, 2)]
    rows += [(7, x[7].tolist(), None), (404, [0.0] * 64, 3), (405, [-1e-9] * 64, 3)]
    expected, digest = plain_codes(rows, spec)
    found, told, _ = coded(spark, rows, spec, kind)
    assert told == digest and found == sorted(expected, key=str)


def test_codes_of_large_values_and_few_vectors(spark):
    spec = vector_codes.CodeSpec(parts=2, entries=4, rounds=3)
    rows = [(1, [1e12, 0.5, -3e4, 2.0], 1), (2, [3.0, -5e3, 1e3, 0.1], None), (3, [0.1, 0.2, 0.3, 0.4], 1)]
    rows += [(4, [1e3, 0.2, 0.3, 9e2], 1), (5, [1e12, 7.0, 0.3, 0.4], 1), (6, [0.1, 0.2, 1e9, 0.4], 2)]
    expected, digest = plain_codes(rows, spec)
    found, told, _ = coded(spark, rows, spec)
    limit = lambda v: v if v < 1 << 63 else None
    assert told == digest and found == sorted([(i, c, limit(e), s) for i, c, e, s in expected], key=str)
    expected, digest = plain_codes(rows[1:3], vector_codes.CodeSpec(2))
    found, told, _ = coded(spark, rows[1:3], vector_codes.CodeSpec(2))
    assert told == digest and found == sorted(expected, key=str)


def test_codes_of_no_vectors_and_uneven_ones(spark):
    assert coded(spark, [], vector_codes.CodeSpec())[0] == []
    assert coded(spark, [(1, None, 1), (2, [], 1)], vector_codes.CodeSpec())[0] == []
    rows = [(2, [1.0, 2.0], 0), (1, [0.5, 1.5], 0), (3, [1.0] * 4, 0), (None, [9.0, 9.0], 1)]
    found, _, (_, books) = coded(spark, rows, vector_codes.CodeSpec(2, 2, 0))
    assert books == [[(2048,), (4096,)], [(6144,), (8192,)]] and {r[0] for r in found} == {1, 2, None}
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.fit_codebooks(spark.createDataFrame([(1, [1.0] * 3)], "vec_id long, embedding array<double>"))


def test_decoding_names_the_entries(spark):
    draw, spec = np.random.default_rng(1), vector_codes.CodeSpec(4, 8, 2)
    rows = [(i, draw.normal(size=16).tolist(), 0) for i in range(100)]
    _, _, (found, books) = coded(spark, rows, spec)
    for r in vector_codes.decode_vectors(found, books, spec).collect():
        entries = [books[p][int(r.code[2 * p : 2 * p + 2], 16)] for p in range(4)]
        assert r.decoded == [v / spec.scale for e in entries for v in e]
        error = sum((math.floor(spec.scale * x) - v * spec.scale) ** 2 for x, v in zip(rows[r.vec_id][1], r.decoded))
        assert error == r.error


def test_boxes_never_lose_the_nearest_entry():
    draw = np.random.default_rng(9)
    for spread in (1, 3, 40, 5000):
        entries = [tuple(e) for e in draw.integers(-spread, spread + 1, (16, 8)).tolist()]
        part = vector_codes._Cells(entries)
        points = draw.integers(-2 * spread, 2 * spread + 1, (3000, 8))
        best, distance = part.nearest(points)
        every = ((points[:, None] - np.array(entries)) ** 2).sum(2)
        assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
        assert sum(m.sum() for m in part.known.values()) < 16 * len(part.known) or spread == 1
