"""Near duplicates among embeddings: sign hashing, exact cosines in tiles, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize


def hash_plan(vectors: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits of a key and number of tables for this many vectors.

    Bits grow with the logarithm of the corpus, so that few unrelated vectors share a
    key at any size; tables follow so that a pair exactly at ``cosine`` meets in one of
    them with probability ``recall`` at least, and closer pairs more surely.
    """
    bits = min(24, max(8, math.ceil(math.log2(max(vectors, 1) + 1))))
    agree = 1 - math.acos(cosine) / math.pi
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(agree**bits))))


def hyperplanes(dimension: int, count: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dimension])).standard_normal((dimension, count))


def sign_keys(unit: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One key per row and table, of ``bits`` signs each."""
    signs = unit @ hyperplanes(unit.shape[1], bits * tables, seed) >= 0
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def tile_neighbours(
    unit: np.ndarray, keys: np.ndarray, weight: np.ndarray, table: int, side: np.ndarray, cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """Linked weight and least linked row per row of a tile of one table.

    Pairs within side 2 or between sides 0 and 1 are compared. A pair counts in the
    first table in which it meets, so sums over tables count it once.
    """
    count, root = np.zeros(len(unit), np.int64), np.arange(len(unit))
    near = unit @ unit.T >= cosine
    near &= (side[:, None] + side[None, :] == 1) | ((side[:, None] == 2) & (side[None, :] == 2))
    np.fill_diagonal(near, False)
    for a in np.flatnonzero(near.any(1)):
        js = np.flatnonzero(near[a])
        js = js[~(keys[js, :table] == keys[a, :table]).any(1)]
        count[a] = weight[js].sum()
        js = js[root[js] != root[a]]
        for j in js:
            if root[j] != root[a]:
                low, high = sorted((root[a], root[j]))
                root[root == high] = low
    return count, root


def cosine_components(
    vectors: DataFrame,
    cosine: float = 0.93,
    recall: float = 0.9999,
    seed: int = 7,
    tile: int = 512,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str | None = "label",
) -> DataFrame:
    """One row per row of ``vectors``: ``id_column, n_links, component_id, kept``.

    Two vectors link when their labels are equal and not null (``label_column=None``: always)
    and their cosine in double precision is at least ``cosine``. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, as do vectors of
    different length. ``n_links`` counts the other vectors linked directly,
    ``component_id`` is the smallest id reachable by links, ``kept`` marks that vector.

    Equal vectors of a label are one node with a weight, named by a hash of both. Keys of random hyperplane signs
    in several tables (:func:`hash_plan`) bring candidates together; keys held by one
    node vanish before vectors are sent. Large keys are dealt into blocks of ``tile``
    rows and every pair of blocks is a tile, so no task holds more than two blocks. Tiles
    verify exactly and return a count and a link to the tile's component per row, never
    pairs. Rows with the same id, label and vector are one vector; an id with several vectors or
    labels has a row each, with the links and the component of that vector. A null id links with nothing.
    """
    label = F.lit(0) if label_column is None else F.col(label_column)
    source = vectors.select(
        F.col(id_column).cast("long").alias("vec"), label.cast("string").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    )
    total = source.count()
    bits, tables = hash_plan(total, cosine, recall)

    def usable_vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
        """Row numbers, vectors and nodes of the usable rows, by length of the vector."""
        column, labels = batch.column(2), batch.column(1).to_pylist()
        lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
        values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        named = np.asarray(batch.column(0).is_valid()) & np.asarray(batch.column(1).is_valid())
        for dimension in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero((lengths == dimension) & named)
            x = values[starts[at][:, None] + np.arange(dimension)] + 0.0
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            at, x = at[good], x[good]
            yield at, x, [
                xxhash.xxh3_64_intdigest(labels[i].encode() + b"\0" + row.tobytes()) - (1 << 63) for i, row in zip(at, x)
            ]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node: list[int | None] = [None] * batch.num_rows
            keys: list[list[int] | None] = [None] * batch.num_rows
            for at, x, nodes_here in usable_vectors(batch):
                unit = x / np.abs(x).max(1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for i, own_node, own_keys in zip(at, nodes_here, sign_keys(unit, bits, tables, seed)):
                    node[i], keys[i] = own_node, own_keys.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["vec", "label", "node", "keys"],
            )

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.zeros(batch.num_rows, np.int64)
            kept = np.zeros(batch.num_rows, bool)
            for at, _, nodes_here in usable_vectors(batch):
                node[at], kept[at] = nodes_here, True
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node), batch.column(2)], names=["vec", "node", "vector"]
            ).filter(pa.array(kept))

    signed = materialize(
        source.mapInArrow(sign, "vec long, label string, node long, keys array<long>"), "signed-vectors"
    )
    usable = signed.where("node is not null")
    nodes = materialize(
        usable.select("vec", "label", "node").distinct().groupBy("label", "node")
        .agg(F.min("vec").alias("rep"), F.count("*").alias("weight")),
        "nodes",
    )
    # rows of one id and node are equal, so it does not matter which of them stays
    own = usable.join(nodes, ["label", "node"]).where("vec = rep").dropDuplicates(["node"])
    keyed = own.select("node", "vec", "label", "weight", F.posexplode("keys").alias("table", "key"))
    groups = materialize(
        keyed.groupBy("label", "table", "key").agg(F.count("*").alias("rows")).where("rows > 1")
        .select("label", "table", "key", F.ceil(F.col("rows") / tile).cast("int").alias("blocks")),
        "shared-keys",
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.concat(
        F.transform(F.sequence(F.lit(0), block), lambda i: F.struct(i.alias("i"), block.alias("j"))),
        F.transform(
            F.filter(F.sequence(block, F.col("blocks")), lambda j: (j > block) & (j < F.col("blocks"))),
            lambda j: F.struct(block.alias("i"), j.alias("j")),
        ),
    )
    placed = (
        keyed.join(groups, ["label", "table", "key"])
        .select("node", "vec", "label", "weight", "table", "key", block.alias("block"), F.explode(pairs).alias("t"))
        .select(
            "node", "vec", "weight", "table",
            F.xxhash64("label", "table", "key", "t.i", "t.j").alias("tile"),
            F.when(F.col("t.i") == F.col("t.j"), 2).when(F.col("block") == F.col("t.i"), 0).otherwise(1).alias("side"),
        )
    )
    by_vector = materialize(
        placed.groupBy("node", "vec").agg(
            F.first("weight").alias("weight"), F.collect_list(F.struct("table", "tile", "side")).alias("tiles")
        ),
        "placed-vectors",
    )
    sent = (
        by_vector.join(own.select("node", "keys"), "node")
        .join(source.mapInArrow(name, "vec long, node long, vector array<double>"), ["node", "vec"])
        .dropDuplicates(["node"])
        .select("node", "weight", "keys", "vector", F.explode("tiles").alias("t"))
        .select("t.tile", "t.table", "t.side", "node", "weight", "keys", "vector")
    )

    def linked(rows: pa.RecordBatch) -> pa.RecordBatch:
        table, side, ids, weight = (rows.column(k).to_numpy() for k in (1, 2, 3, 4))
        x = rows.column(6).flatten().to_numpy().reshape(len(ids), -1)
        unit = x / np.abs(x).max(1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        keys = rows.column(5).flatten().to_numpy().reshape(len(ids), -1)
        count, root = tile_neighbours(unit, keys, weight, int(table[0]), side, cosine)
        at = np.flatnonzero((count > 0) | (root != np.arange(len(ids))))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[at]), pa.array(count[at]), pa.array(ids[root[at]])], names=["node", "links", "hub"]
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the tile that the next batch may continue, two blocks at most
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            lengths = pa.compute.list_value_length(batch.column(6)).to_numpy()
            marks = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), lengths]
            starts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            bounds = [0, *starts.tolist()]
            found = [linked(batch.slice(a, b - a)) for a, b in zip(bounds, bounds[1:]) if b - a > 1]
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()
            rest = batch.slice(bounds[-1])
        if rest is not None and rest.num_rows > 1:
            yield linked(rest)

    found = materialize(
        sent.withColumn("dimension", F.size("vector"))
        .repartition("tile", "dimension").sortWithinPartitions("tile", "table", "dimension", "node").drop("dimension")
        .mapInArrow(compare, "node long, links long, hub long"),
        "vector-links",
    )
    components = materialize(
        connected_components(found.select(F.col("node").alias("a"), F.col("hub").alias("b"))), "components"
    )
    least = components.join(nodes, "node").groupBy("component").agg(F.min("rep").alias("least"))
    resolved = (
        nodes.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(components.join(least, "component").select("node", "least"), "node", "left")
        .select(
            "node",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("least", "rep").alias("component_id"),
        )
    )
    resolved = materialize(resolved, "resolved-nodes")
    return (
        signed.join(resolved, "node", "left")
        .select(
            F.col("vec").alias(id_column),
            F.when(F.col("vec").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
            F.when(F.col("vec").isNotNull(), F.coalesce("component_id", "vec")).alias("component_id"),
        )
        .withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))
    )
