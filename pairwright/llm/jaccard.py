"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersection, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialize, only_listed


@dataclass(frozen=True)
class JaccardSpec:
    """Documents link when ``|A & B| * over >= share * |A | B|`` for sets of ``words``-word shingles.

    ``extra`` is the share of a set by which the prefix is lengthened so that a document
    must share that many more prefix shingles; ``tile`` is the most rows of a block.
    """

    words: int = 5
    share: int = 80
    over: int = 100
    extra: Fraction = Fraction(3, 20)
    tile: int = 512

    def overlap(self, n: int) -> int:
        """The least overlap of a linked pair whose larger set has ``n`` elements, for a set of that size."""
        return -(-self.share * n // self.over)

    def needed(self, n: int) -> int:
        """Prefix shingles that a set of ``n`` shares with any partner."""
        return min(max(1, math.ceil(self.extra * n)), self.overlap(n))

    def prefix(self, n: int) -> int:
        return n - self.overlap(n) + self.needed(n)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value
        return value


_WORDS = _Hashes()
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; A-Z count as a-z, ASCII white space separates.

    Fewer words make one shingle of all of them, no words an empty set.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out ^= h[i : len(h) - k + 1 + i]
        out *= _A
        out ^= out >> np.uint64(29)
    out *= _B
    out ^= out >> np.uint64(32)
    return np.unique(out)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit words per set; four bits or more per element of the largest set."""
    bits = 1 << max(6, (4 * max(map(len, sets)) - 1).bit_length())
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets):
        at = s & np.uint64(bits - 1)
        np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def tile_links(
    ids: np.ndarray, sets: list[np.ndarray], spec: JaccardSpec, left: np.ndarray | None = None,
    right: np.ndarray | None = None,
) -> list[tuple[int, int]]:
    """Links that span the components of a tile, as (position, position of the component's first row).

    Pairs of a row of ``left`` with a row of ``right`` (masks; by default all pairs) that are
    in one component already need no look. For the others bit counts bound the overlap
    from above: every bit that only one bitmap has stands for an element that only
    its set has. Pairs that pass are intersected exactly.
    """
    n = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((ids, n))
    maps = bitmaps(sets)
    root = np.arange(len(ids))
    is_left = np.ones(len(ids), bool) if left is None else left
    is_right = np.ones(len(ids), bool) if right is None else right
    sizes = n[order]
    for at, i in enumerate(order):
        # partners are not smaller, so each pair is met once
        last = np.searchsorted(sizes, n[i] * spec.over // spec.share, "right")
        js = order[at + 1 : last]
        js = js[(root[js] != root[i]) & ((is_left[i] & is_right[js]) | (is_right[i] & is_left[js]))]
        if not len(js):
            continue
        only_i = np.bitwise_count(maps[i] & ~maps[js]).sum(1, dtype=np.int64)
        only_j = np.bitwise_count(maps[js] & ~maps[i]).sum(1, dtype=np.int64)
        most = np.minimum(n[i] - only_i, n[js] - only_j)
        for j in js[spec.over * most >= spec.share * (n[i] + n[js] - most)]:
            if root[j] == root[i]:
                continue
            common = overlap(sets[i], sets[j])
            if spec.over * common >= spec.share * (n[i] + n[j] - common):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root[root == old] = new
    return [(i, int(r)) for i, r in enumerate(root) if r != i]


def signatures(docs: DataFrame, spec: JaccardSpec, id_column: str, text_column: str) -> DataFrame:
    """``doc, n, set_a, set_b, prefix``: set size, 128 bits that identify the set, and its least hashes.

    Prefixes are taken in the order of the hashes. Two sets that link share
    ``needed(n)`` elements of their prefixes at least, for either one's n.
    """
    names = ["doc", "n", "set_a", "set_b", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sizes, a, b, prefixes = [], [], [], []
                for text in part.column(1):
                    s = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else b"", spec.words)
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    sizes.append(len(s))
                    a.append((whole >> 64) - (1 << 63))
                    b.append((whole & (1 << 64) - 1) - (1 << 63))
                    prefixes.append(s[: spec.prefix(len(s)) if len(s) else 0].view(np.int64))
                ends = np.cumsum([0] + [len(p) for p in prefixes])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()),
                        pa.array(b, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes))),
                    ],
                    names=names,
                )

    return docs.select(
        F.col(id_column).cast("long").alias("doc"), F.col(text_column).cast("binary").alias("text")
    ).mapInArrow(run, "doc long, n long, set_a long, set_b long, prefix array<long>")


def candidate_groups(sets: DataFrame, spec: JaccardSpec) -> DataFrame:
    """``doc, hub, band``: groups of documents that may link; a linked pair is in one group at least.

    Only shingles that stand in the prefixes of two different sets matter, and a document
    that has fewer of them than :meth:`JaccardSpec.needed` of its size has no partner. The
    documents with a shingle, within two neighbouring size bands, form a star round the
    least of them, the hub. An edge of a star is weak if few of the document's shingles lead to
    that hub. Of the shingles that a linked pair shares, either one makes both edges
    strong, or one of the two documents has half of them on weak edges. So weak edges count only
    for documents that have that many, which passing likenesses do not.
    """
    tokens = sets.select("doc", "n", "set_a", F.explode("prefix").alias("token"))
    repeated = materialize(
        tokens.groupBy("token").agg(F.min("set_a").alias("a"), F.max("set_a").alias("b")).where("a <> b").select("token"),
        "repeated-shingles",
    )
    shared = materialize(tokens.join(repeated, "token").select("doc", "n", "token"), "shared-shingles")
    need = F.least(
        F.greatest(F.lit(1), F.ceil(F.col("n") * spec.extra.numerator / spec.extra.denominator)),
        F.ceil(F.col("n") * spec.share / spec.over),
    )
    # of two linked sets the larger may share one shingle less than it needs
    live = shared.groupBy("doc").agg(F.count("*").alias("shared"), F.first("n").alias("n")).where(
        F.col("shared") >= F.greatest(F.lit(1), need - 1)
    )
    copies = sets.groupBy("set_a", "set_b").agg(F.min("doc").alias("doc")).select("doc")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(spec.over / spec.share) + 1e-9)
    live = materialize(live.join(copies, "doc").select("doc"), "live-documents")
    banded = materialize(
        only_listed(shared, live, "doc")
        .select("doc", "n", "token", band.alias("own"), F.explode(F.array(band, band + 1)).alias("band")),
        "banded-shingles",
    )
    hubs = materialize(
        banded.groupBy("token", "band").agg(F.min("doc").alias("hub"), F.max("doc").alias("last"), F.max("own").alias("top"))
        .where("hub <> last and top = band").select("token", "band", "hub"),
        "hubs",
    )
    edges = (
        banded.join(hubs, ["token", "band"]).where("doc <> hub")
        .groupBy("doc", "hub", "band").agg(F.count("*").alias("through"), F.first("n").alias("n"))
        .withColumn("strong", F.col("through") >= F.greatest(F.lit(2), need / 3))
        .withColumn("weak", F.sum(F.when(~F.col("strong"), F.col("through"))).over(Window.partitionBy("doc")))
        .where(F.col("strong") | (2 * F.col("weak") >= need - 1))
        .select("doc", "hub", "band")
    )
    edges = materialize(edges, "edges")
    return edges.union(edges.select("hub", "hub", "band").distinct())


def tiles(groups: DataFrame, spec: JaccardSpec) -> DataFrame:
    """``doc, tile, side``: every pair of documents of a group meets in one tile.

    A group is dealt into blocks of about ``spec.tile`` documents; each pair of blocks is a
    tile, so no task holds more than two blocks. ``side`` is 0 for the first block of a
    tile, 1 for the second, 2 where they are the same.
    """
    sizes = materialize(
        groups.groupBy("hub", "band").agg(F.ceil(F.count("*") / spec.tile).cast("int").alias("blocks")), "tile-groups"
    )
    block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    lower = F.transform(F.sequence(F.lit(0), F.col("block")), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    upper = F.transform(
        F.sequence(F.col("block"), F.col("blocks") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"))
    )
    return (
        groups.join(sizes, ["hub", "band"])
        .select("doc", "hub", "band", "blocks", block.alias("block"))
        .select("doc", "hub", "band", "block", F.explode(F.array_union(lower, upper)).alias("t"))
        .select(
            "doc",
            F.concat_ws("/", "hub", "band", "t.i", "t.j").alias("tile"),
            F.when(F.col("t.i") == F.col("t.j"), 2).when(F.col("block") == F.col("t.i"), 0).otherwise(1).alias("side"),
        )
    )


def verified_links(docs: DataFrame, tiled: DataFrame, spec: JaccardSpec, id_column: str, text_column: str) -> DataFrame:
    """``a, b``: links that span the components of every tile, found on the whole sets."""
    placed = materialize(
        tiled.groupBy("doc").agg(F.collect_list(F.struct("tile", "side")).alias("tiles")), "placed-documents"
    )
    texts = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                sets = [shingle_set(t.as_buffer().to_pybytes(), spec.words).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sets, pa.binary())], names=["doc", "tiles", "shingles"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, sides, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            side = np.array(sides)
            keys = np.array(ids, np.int64)
            found = tile_links(keys, sets, spec, side != 1, side != 0)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[r] for _, r in found], pa.int64())],
                names=["a", "b"],
            )

        for batch in batches:
            for t, d, s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                  batch.column(2).to_pylist(), batch.column(3)):
                if t != tile:
                    if len(ids) > 1:
                        yield links()
                    tile, ids, sides, sets = t, [], [], []
                ids.append(d)
                sides.append(s)
                sets.append(np.frombuffer(x.as_buffer(), np.uint64))
        if len(ids) > 1:
            yield links()

    shingled = (
        only_listed(texts, placed, "doc").join(placed, "doc").select("doc", "text", "tiles")
        .mapInArrow(cut, "doc long, tiles array<struct<tile:string,side:int>>, shingles binary")
        .select("doc", F.explode("tiles").alias("t"), "shingles")
        .select("t.tile", "doc", "t.side", "shingles")
    )
    return (
        shingled.repartition("tile").sortWithinPartitions("tile", "doc").mapInArrow(compare, "a long, b long")
    )


def jaccard_components(
    docs: DataFrame, spec: JaccardSpec = JaccardSpec(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``id_column, n_shingles, component_id``.

    ``component_id`` is the smallest id reachable by links. The join is exact up to
    64-bit hashes of shingles. Equal sets are one node: their document with the smallest
    id stands for them. A null or wordless text has an empty set and links with nothing,
    as does one that shares no shingle. A null id links with nothing and keeps its row;
    an id on several rows is one document whose texts are all compared.
    Steps: :func:`signatures`, :func:`candidate_groups`, :func:`tiles`,
    :func:`verified_links`, connected components. No pairs of a group are emitted.
    """
    rows = materialize(signatures(docs, spec, id_column, text_column), "signatures")
    by_set = materialize(
        rows.where("n > 0 and doc is not null").groupBy("set_a", "set_b")
        .agg(F.min("doc").alias("rep"), F.max("doc").alias("last")),
        "sets",
    )
    tiled = materialize(tiles(candidate_groups(rows.where("n > 0 and doc is not null"), spec), spec), "tiles")
    links = verified_links(docs, tiled, spec, id_column, text_column)
    copies = rows.where("n > 0 and doc is not null").join(by_set.where("rep <> last"), ["set_a", "set_b"])
    spans = links.union(copies.select(F.col("doc").alias("a"), F.col("rep").alias("b")))
    components = materialize(connected_components(spans), "components")
    return rows.join(components, rows.doc == components.node, "left").select(
        F.col("doc").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc").alias("component_id"),
    )


def drop_near_copies(
    docs: DataFrame, spec: JaccardSpec = JaccardSpec(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` of which no document with a smaller id is in the same component."""
    found = jaccard_components(docs, spec, id_column, text_column)
    dropped = found.where(F.col("component_id") < F.col(id_column)).select(id_column).distinct()
    return docs.join(dropped, id_column, "left_anti").select(docs.columns)
