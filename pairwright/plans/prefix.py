"""Exact running totals and ranks that never put one group into one task.

A window over ``(group) order by value`` sorts a whole group in one task, which
fails when one group holds a third of the rows.  Here the order is given as a
list of levels, each with a bounded number of distinct values inside its parent
(a score rounded to four places has at most 10,001).  Totals are taken per
level on aggregated rows, so every window partition is bounded by the fan-out
of one level, and only the finest level joins back to the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

#: Id ranges that close the order: at most 65,536 ids per leaf and, for ids below
#: 2**48, at most 65,536 ranges per level.
ID_RANGES = {"_range32": 32, "_range16": 16}
#: Rows up to which a group is ordered by one task.
ORDERED_AT_ONCE = 1 << 16

Level = tuple[str, str]


def _order(level: Level) -> Column:
    name, direction = level
    return F.col(name).desc() if direction == "desc" else F.col(name).asc()


def running_totals(
    leaf: DataFrame, keys: Sequence[str], levels: Sequence[Level], sums: Sequence[str]
) -> DataFrame:
    """Add ``before_<s>``: the total of ``s`` over the rows ordered before this one in its group.

    ``leaf`` has one row per ``keys`` + level values, none of them NULL.
    """
    names = [name for name, _ in levels]
    tables = [leaf]
    for depth in range(len(levels) - 1, 0, -1):
        path = [*keys, *names[:depth]]
        tables.insert(0, tables[0].groupBy(*path).agg(*[F.sum(s).alias(s) for s in sums]))
    out = None
    for depth, table in enumerate(tables):
        parent = [*keys, *names[:depth]]
        # Only the first level of an ungrouped order has no parent: one row per
        # distinct value of that level.
        window = (
            (Window.partitionBy(*parent) if parent else Window.partitionBy())
            .orderBy(_order(levels[depth]))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        step = table.withColumns(
            {f"before_{s}": F.coalesce(F.sum(s).over(window), F.lit(0)) for s in sums}
        )
        if out is not None:
            above = out.select(*parent, *[F.col(f"before_{s}").alias(f"_up_{s}") for s in sums])
            step = step.join(above, parent).withColumns(
                {f"before_{s}": F.col(f"before_{s}") + F.col(f"_up_{s}") for s in sums}
            ).drop(*[f"_up_{s}" for s in sums])
        out = step
    return out


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Level],
    id_column: str,
    out: str = "rank",
) -> DataFrame:
    """Add the 1-based position of each row in its group, ties broken by ascending id.

    Groups of up to ``ORDERED_AT_ONCE`` rows take one shuffle and one sort. Larger ones, counted
    first, are dealt by their levels; no task orders more than 65,536 ids of one group and one level
    value. Rows with a NULL key, level or id have no position and are left out.
    """
    if not keys:
        return _ranked_by_levels(df, keys, levels, id_column, out)
    spark = df.sparkSession
    names = [*keys, *[name for name, _ in levels], id_column]
    known = df.where(reduce(and_, [F.col(name).isNotNull() for name in names]))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # One row per 65,536 rows at most.
    large = written(spark, sizes.where(F.col("_n") > ORDERED_AT_ONCE).select(*keys), "large-groups")
    position = F.row_number().over(
        Window.partitionBy(*keys).orderBy(*[_order(level) for level in levels], F.col(id_column).asc())
    ).cast("bigint")
    if large.isEmpty():
        return known.withColumn(out, position)
    known = written(spark, known, "rows-to-rank")
    return known.join(large, keys, "left_anti").withColumn(out, position).unionByName(
        _ranked_by_levels(known.join(large, keys, "left_semi"), keys, levels, id_column, out)
    )


def _ranked_by_levels(
    df: DataFrame, keys: Sequence[str], levels: Sequence[Level], id_column: str, out: str
) -> DataFrame:
    """:func:`ranked` for groups of any size: one shuffle of the data on (keys, levels, id range)."""
    keyed = df.withColumns(
        {name: F.shiftright(F.col(id_column), bits) for name, bits in ID_RANGES.items()}
    )
    leaf_keys = [*keys, *[name for name, _ in levels], *ID_RANGES]
    leaf = keyed.groupBy(*leaf_keys).agg(F.count(F.lit(1)).alias("_n"))
    order = [*levels, *[(name, "asc") for name in ID_RANGES]]
    offsets = running_totals(leaf, keys, order, ["_n"]).drop("_n")
    within = Window.partitionBy(*leaf_keys).orderBy(id_column)
    return (
        keyed.join(offsets, leaf_keys)
        .withColumn(out, (F.col("before__n") + F.row_number().over(within)).cast("bigint"))
        .drop(*ID_RANGES, "before__n")
    )


def ranked_between(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Level],
    id_column: str,
    first: int,
    last: int,
    out: str = "rank",
) -> DataFrame:
    """The rows at positions ``first`` to ``last`` of each group, in the order of :func:`ranked`.

    Up to position ``ORDERED_AT_ONCE`` the first rows of each group are ordered by one task, and
    rows behind ``last`` leave no input partition.  A deeper
    place is sought in counts, one level after the other: only values whose positions
    overlap the range are looked into at the next level. The data then meets the few leaves
    found, so a page costs the same however deep it lies, and only its leaves are ordered.
    Groups with fewer rows than ``first`` and an empty table give no rows.
    """
    if keys and last <= ORDERED_AT_ONCE:
        known = df.where(reduce(and_, [F.col(c).isNotNull() for c in (*keys, *[c for c, _ in levels], id_column)]))
        order = [*[_order(level) for level in levels], F.col(id_column).asc()]
        rows = top_per_group(known, keys, order, last, out).where(F.col(out) >= first)
        return rows.withColumn(out, F.col(out).cast("bigint"))
    return _sought_between(written(df.sparkSession, df, "rows-to-seek"), keys, levels, id_column, first, last, out)


def _sought_between(
    df: DataFrame, keys: Sequence[str], levels: Sequence[Level], id_column: str, first: int, last: int, out: str
) -> DataFrame:
    """:func:`ranked_between` for pages of any depth."""
    keyed = df.withColumns(
        {name: F.shiftright(F.col(id_column), bits) for name, bits in ID_RANGES.items()}
    )
    order = [*levels, *[(name, "asc") for name in ID_RANGES]]
    names = [name for name, _ in order]
    leaf = written(
        df.sparkSession, keyed.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n")), "leaf-counts"
    )
    found = None
    for depth, level in enumerate(order):
        parent, path = [*keys, *names[:depth]], [*keys, *names[: depth + 1]]
        counts = leaf.groupBy(*path).agg(F.sum("_n").alias("_n"))
        counts = counts.withColumn("_up", F.lit(0)) if found is None else counts.join(found, parent)
        window = Window.partitionBy(*parent).orderBy(_order(level)).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.col("_up") + F.coalesce(F.sum("_n").over(window), F.lit(0)))
        overlaps = (F.col("_before") < last) & (F.col("_before") + F.col("_n") >= first)
        found = counts.where(overlaps).select(*path, F.col("_before").alias("_up"))
    within = Window.partitionBy(*keys, *names).orderBy(id_column)
    return (
        keyed.join(found, [*keys, *names])
        .withColumn(out, (F.col("_up") + F.row_number().over(within)).cast("bigint"))
        .where(F.col(out).between(first, last))
        .drop(*ID_RANGES, "_up")
    )


def positions(df: DataFrame, id_column: str, out: str = "position") -> DataFrame:
    """Add a dense 0-based position by ascending unique id over the whole table."""
    numbered = ranked(df, [], [], id_column, out)
    return numbered.withColumn(out, F.col(out) - 1)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group.

    The filter on ``row_number`` becomes a per-partition group limit before the
    shuffle, so a hot group sends at most ``k`` rows per input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)
