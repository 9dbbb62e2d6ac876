"""Substring joins as equality joins.

``text LIKE '%' || needle || '%'`` has no equality key and would compare every
text with every needle.  A text contains a needle exactly when one of its
substrings of that length equals it, so texts are cut into their substrings at
the lengths that occur and joined on equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import each, let


def _pieces(text: Column, lengths: Column) -> Column:
    def cut(chars: Column) -> Column:
        def of_length(n: Column) -> Column:
            starts = F.when(
                F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - n + 1)
            ).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), ""))

        return F.array_distinct(F.flatten(F.transform(lengths, of_length)))

    return let(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), cut)


def containing(
    texts: DataFrame, keys: Sequence[str], text: str, needles: DataFrame, needle: str
) -> DataFrame:
    """Pairs (text keys, needle row) where the text contains the needle.

    Matching is case-sensitive; lower both sides first for the other kind.
    """
    # As many entries as there are different needle lengths.
    lengths = needles.agg(
        F.array_sort(F.collect_set(F.length(needle)))
    ).scalar()
    staged = texts.select(*keys, F.col(text).alias("_text")).withColumn("_lengths", lengths)
    cut = each(staged, keys, _pieces(F.col("_text"), F.col("_lengths")), "_piece")
    return cut.join(needles, cut["_piece"] == needles[needle]).drop("_piece")
