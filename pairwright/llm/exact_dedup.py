"""Exact deduplication with a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, materialize


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text: Column | None = None, support: float = 0.001
) -> DataFrame:
    """One row per row of ``docs``: ``id_column, keep_id, group_size, kept, text_sha256``.

    Texts are equal when the normalised text (``text``, by default the column of
    that name as it is, null as empty) has the same SHA-256. The largest id of a
    group stays. Misra-Gries counters (``freqItems``) name at most ``1 / support``
    digests that may hold more than this share of the rows. Their sizes and
    winners are counted exactly; this table of at most ``1 / support`` rows is
    broadcast, so rows of hot groups are decided without a shuffle. The other
    digests, none with more than that share, take one ordinary shuffle of (id,
    digest). Texts are read once and never shuffled.

    An id on several rows names one document: the rows count in ``group_size`` and
    share ``kept``. A null id stays only where its group has no other id. An empty
    table gives an empty one; other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")) if text is None else text
    rows = materialize(
        docs.select(F.col(id_column).alias("id"), F.sha2(text, 256).alias("digest")), "digests"
    )
    candidates = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    hot = materialize(
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1"),
        "winners",
    )
    by_digest = Window.partitionBy("digest")
    cold = rows.join(F.broadcast(hot), "digest", "left_anti").select(
        "digest",
        "id",
        F.max("id").over(by_digest).alias("keep_id"),
        F.count("*").over(by_digest).alias("group_size"),
    )
    decided = rows.join(F.broadcast(hot), "digest").select("digest", "id", "keep_id", "group_size").union(cold)
    return decided.select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", support: float = 0.001) -> DataFrame:
    """One row of ``docs`` for each distinct text, with all its columns.

    Rows are judged by id and digest, so a text stays though its id also stands at
    a copy, and of rows with the same id and text, or of copies without id, one stays.
    The pairs that go are broadcast if they are few, else joined; texts are shuffled in that
    case only. A null text is empty; an empty table gives an empty one. The columns may
    have any names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    judged = materialize(
        exact_groups(docs, id_column, support=support)
        .groupBy(F.col(id_column).alias("of_id"), F.unhex("text_sha256").alias("of_digest"))
        .agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"),
        "copies",
    )
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest"))

    def small(pairs: DataFrame) -> DataFrame:
        return F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS >> 2 else pairs

    single = rows.join(small(judged), same, "left_anti").select("row")
    repeated = (
        rows.join(small(judged.where("kept")), same, "left_semi").groupBy("id", "digest").agg(F.first("row").alias("row"))
    )
    return single.union(repeated.select("row")).select("row.*")
