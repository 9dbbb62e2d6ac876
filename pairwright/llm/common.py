"""Shared folder, lineage cuts and connected components for the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path that the driver and every executor see.

    It lies under ``spark.checkpoint.dir``; where that is unset (tests), under the
    warehouse folder, which a cluster shares as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df``: write it once to the shared folder and read it from there."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids (of eight bytes) up to which a list of them is sent to every executor.
BROADCAST_IDS = 1 << 20


def only_listed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``, a written table of distinct long ids.

    The list is counted first: up to ``BROADCAST_IDS`` ids are broadcast, so that ``df`` is
    filtered where it lies; longer lists are joined by a shuffle.
    """
    ids = ids.select(key)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``links(a, b)``; a component is named by its least node.

    Large-star and small-star rounds (Kiveris et al., 2014): each is a minimum per
    node, combined before the shuffle, and a join of the links with these minima.
    The minima are written first, so that adaptive execution may split a join on
    a hub. Rounds end when the links no longer change. Links that are null or
    lead to their own node are ignored; no links give no rows.
    """
    u, v = F.col("u"), F.col("v")
    links = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(u.alias("node"), v.alias("component")).union(
                links.select(v, v).distinct()
            )
        before = now
        nearest = materialize(
            links.union(links.select(v, u)).groupBy("u").agg(F.min("v").alias("m"))
            .select(u.alias("v"), F.least("u", "m").alias("m")),
            "nearest",
        )
        large = materialize(links.join(nearest, "v").select("u", F.col("m").alias("v")), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        links = materialize(
            large.join(least, "u").where("v <> m").select(v.alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct(),
            "links",
        )
