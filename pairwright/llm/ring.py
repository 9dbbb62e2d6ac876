"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Distinct keys that one window orders at a time, about: keys are hashes, so they spread evenly.
KEYS_PER_CELL = 1 << 15

#: The ring is cut at every multiple of this power of two, so that a key finds its arc by equality.
_BUCKET_BITS = 52
_RING_END = (1 << 63) - 1


@dataclass(frozen=True)
class RingSpec:
    """``shards`` numbered from 0, ``nodes`` points of each on the ring, ``slack`` of a shard over an equal share.

    Without slack the shards' row counts are at most one apart. With slack a shard
    takes ``(1 + slack)`` times an equal share, rounded up, and fewer rows overflow.
    """

    shards: int = 8
    nodes: int = 128
    slack: float = 0.0

    def __post_init__(self):
        if self.shards < 1 or self.nodes < 1 or self.slack < 0:
            raise ValueError(f"no ring: {self}")


def _nodes(spark: SparkSession, spec: RingSpec) -> DataFrame:
    """``(arc, shard, low, high)``: the keys above ``low`` up to ``high`` belong to the node at ``high``.

    A table of ``shards * nodes`` rows.
    """
    points = spark.range(spec.shards * spec.nodes, numPartitions=1).select(
        F.floor(F.col("id") / spec.nodes).cast("int").alias("shard"), F.xxhash64("id", F.lit("node")).alias("high")
    )
    clockwise = Window.orderBy("high", "shard")
    return points.select(
        (F.row_number().over(clockwise) - 1).alias("arc"), "shard", F.lag("high").over(clockwise).alias("low"), "high"
    )


def _lookup(nodes: DataFrame) -> DataFrame:
    """``(bucket, low, high, arc)`` of every stretch of the ring; behind the last node the first follows."""
    behind = nodes.agg(F.max("high").alias("low")).select(F.lit(0).alias("arc"), "low", F.lit(_RING_END).alias("high"))
    stretches = nodes.select("arc", "low", "high").unionByName(behind)
    first = F.coalesce(F.shiftright("low", _BUCKET_BITS), F.lit(-(1 << (63 - _BUCKET_BITS))).cast("long"))
    return stretches.select(
        F.explode(F.sequence(first, F.shiftright("high", _BUCKET_BITS))).alias("bucket"), "low", "high", "arc"
    )


def _next_open(nodes: DataFrame, room: DataFrame, spec: RingSpec) -> DataFrame:
    """``(at, to)``: the next arc clockwise of every arc whose shard has room."""
    arcs = spec.shards * spec.nodes
    known = nodes.select("arc", "shard").join(F.broadcast(room), "shard")
    laps = known.select("arc", "room").union(known.select(F.col("arc") + arcs, "room"))
    ahead = Window.orderBy("arc").rowsBetween(1, Window.unboundedFollowing)
    return laps.select(
        F.col("arc").alias("at"), (F.min(F.when(F.col("room") > 0, F.col("arc"))).over(ahead) % arcs).alias("to")
    ).where(F.col("at") < arcs)


def _walk(loads: DataFrame, nodes: DataFrame, rows: int, spec: RingSpec) -> DataFrame:
    """``(arc, single, start, stop, shard, slot)``: where the rows from ``start`` to ``stop`` of an arc go.

    In each round every shard takes what lies at its arcs, as far as it has room; the
    rest goes on clockwise to the next shard with room. A round that leaves something
    has filled a shard, so there are at most as many rounds as shards. Groups of equal
    texts go first, rows that are alone then fill what is left. All tables here have
    the size of the ring, whatever the input.
    """
    spark = loads.sparkSession
    share, more = divmod(rows, spec.shards)
    limit = F.lit(share) + F.when(F.col("id") < more, 1).otherwise(0)
    if spec.slack:
        limit = F.lit(-int(-(1 + spec.slack) * rows // spec.shards))
    shards = spark.range(spec.shards, numPartitions=1).select(
        F.col("id").cast("int").alias("shard"), limit.cast("long").alias("room")
    )
    room = shards.select("shard", "room", F.lit(0).cast("long").alias("filled"))
    earlier = Window.partitionBy("shard").orderBy("arc", "start").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("stop") - F.col("start")
    placed = []
    for single in (False, True):
        waiting = loads.where(F.col("single") == single).select(
            "arc", "single", F.lit(0).cast("long").alias("start"), F.col("rows").alias("stop"), F.col("arc").alias("at")
        )
        while True:
            asked = (
                waiting.join(F.broadcast(nodes.select(F.col("arc").alias("at"), "shard")), "at")
                .join(F.broadcast(room), "shard")
                .withColumn("before", F.coalesce(F.sum(length).over(earlier), F.lit(0)))
                .withColumn("taken", F.greatest(F.lit(0), F.least(length, F.col("room") - F.col("before"))))
            )
            asked = materialize(asked, "ring-asked")
            placed.append(
                asked.where("taken > 0").select(
                    "arc", "single", "start", (F.col("start") + F.col("taken")).alias("stop"), "shard",
                    (F.col("filled") + F.col("before")).alias("slot"),
                )
            )
            taken = asked.groupBy("shard").agg(F.sum("taken").alias("taken"))
            now = F.coalesce("taken", F.lit(0))
            room = materialize(
                room.join(taken, "shard", "left").select(
                    "shard", (F.col("room") - now).alias("room"), (F.col("filled") + now).alias("filled")
                ),
                "ring-room",
            )
            left = asked.where(F.col("taken") < length)
            if left.isEmpty():
                break
            waiting = materialize(
                left.join(F.broadcast(_next_open(nodes, room, spec)), "at").select(
                    "arc", "single", (F.col("start") + F.col("taken")).alias("start"), "stop", F.col("to").alias("at")
                ),
                "ring-waiting",
            )
    return reduce(DataFrame.union, placed)


def ring_shards(
    docs: DataFrame, spec: RingSpec = RingSpec(), id_column: str = "doc_id", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs``: ``id_column, size, text_crc32, shard, slot`` and, if asked, ``row``.

    ``size`` is the text's UTF-8 bytes plus 1, ``slot`` the place in the shard, without
    gaps from 0. ``carry`` names columns that come along in the struct ``row``.

    The key of a row is its text's hash, so equal texts stand at one point of the ring.
    They go to one shard together; a group is cut only where its shard, or the next one
    clockwise, is full. Which shard takes them depends on the text, the ring and the
    loads, not on how the table is partitioned.

    Rows are counted per key and partition of the input before anything is shuffled by
    key, and a key's rows are numbered per partition, so a text on a third of all rows
    makes no large group. Ranks within an arc come from totals of cells of about
    ``KEYS_PER_CELL`` keys. What is broadcast has the size of the ring.

    A null text counts as empty. Ids may be null or repeated: rows are placed, not ids.
    An empty table gives an empty one. Other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.struct(*carry).alias("row")] if carry else []
    nodes = materialize(_nodes(docs.sparkSession, spec), "ring-nodes")
    ring = _lookup(nodes)
    keyed = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.spark_partition_id().alias("part"),
        *own,
    )
    here = (F.shiftright("key", _BUCKET_BITS) == F.col("bucket")) & (F.col("key") <= F.col("high"))
    here = here & (F.col("low").isNull() | (F.col("key") > F.col("low")))
    rows = materialize(keyed.join(F.broadcast(ring), here).drop("bucket", "low", "high"), "ring-rows")
    n = rows.count()
    cells = n // (KEYS_PER_CELL * spec.shards * spec.nodes) + 1

    in_order = Window.partitionBy("arc", "cell", "single").orderBy("key", "part")
    groups = (
        rows.groupBy("arc", "key", "part").agg(F.count("*").alias("rows"))
        .withColumn("cell", F.pmod("key", F.lit(cells)))
        .withColumn("single", F.sum("rows").over(Window.partitionBy("arc", "cell", "key")) == 1)
        .withColumn("first", F.coalesce(F.sum("rows").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    groups = materialize(groups, "ring-groups")
    earlier = Window.partitionBy("arc", "single").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = groups.groupBy("arc", "single", "cell").agg(F.sum("rows").alias("rows"))
    firsts = totals.select(
        "arc", "single", "cell", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("cell_first"), "rows"
    )
    firsts = materialize(firsts, "ring-cells")
    loads = materialize(firsts.groupBy("arc", "single").agg(F.sum("rows").alias("rows")), "ring-loads")
    pieces = _walk(loads, nodes, n, spec)

    starts = groups.join(firsts.drop("rows"), ["arc", "single", "cell"]).select(
        "arc", "key", "part", "single", (F.col("first") + F.col("cell_first")).alias("first")
    )
    numbered = rows.withColumn(
        "nth", F.row_number().over(Window.partitionBy("arc", "key", "part").orderBy("id")) - 1
    )
    ranked = numbered.join(starts, ["arc", "key", "part"]).withColumn("rank", F.col("first") + F.col("nth"))
    there = (ranked["arc"] == pieces["arc"]) & (ranked["single"] == pieces["single"])
    there = there & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop"))
    return ranked.join(F.broadcast(pieces), there).select(
        F.col("id").alias(id_column), "size", "text_crc32", "shard",
        (F.col("slot") + F.col("rank") - F.col("start")).alias("slot"), *(["row"] if carry else []),
    )


def write_shards(docs: DataFrame, path: str, spec: RingSpec = RingSpec(), id_column: str = "doc_id") -> None:
    """Write all columns of ``docs`` as Parquet under ``path``, one folder ``shard=N`` for each shard.

    A shard's rows lie in as many files as tasks wrote them. A column named ``shard`` is
    replaced by the folder.
    """
    placed = ring_shards(docs, spec, id_column, tuple(docs.columns))
    columns = [F.col("row")[c].alias(c) for c in docs.columns if c != "shard"]
    placed.select(*columns, "shard").write.partitionBy("shard").parquet(path)
