"""Small column helpers the other modules share."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

WHITESPACE = " \t\n\r\f\x0b"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Inside a lambda an expression is evaluated wherever it is written; a
    one-element ``transform`` evaluates it once per row instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim white space; one argument, so it can be passed to ``transform`` as it is."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def rstrip(c: Column, chars: str = WHITESPACE) -> Column:
    return F.rtrim(c, F.lit(chars))


def not_blank(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def null_if_empty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def group(c: Column, pattern: str, index: int) -> Column:
    """Regex group as NULL when the pattern or the group does not match."""
    return null_if_empty(F.regexp_extract(c, pattern, index))


def any_of(values: Sequence, test: Callable[[object], Column]) -> Column:
    """OR over a fixed list."""
    out = F.lit(False)
    for value in values:
        out = out | test(value)
    return out


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether one of a fixed list of texts stands in ``c``, which is written and evaluated once."""
    return c.rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def words(c: Column) -> Column:
    """Whitespace-separated words of a string, none for a blank one."""
    return F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0)


def literal_map(values: dict) -> Column:
    """A fixed table.  One of texts is read from one literal: a node per entry makes plans too large."""
    if all(isinstance(v, str) for v in (*values, *values.values())):
        return F.from_json(F.lit(json.dumps(values)), "map<string,string>")
    pairs = []
    for key, value in values.items():
        pairs += [F.lit(key), F.lit(value)]
    return F.create_map(*pairs)


def choose(c: Column, values: dict) -> Column:
    """Lookup in a fixed table, NULL when absent."""
    return F.try_element_at(literal_map(values), c)


def literal_array(values: Sequence[str]) -> Column:
    """A fixed list, read from one literal."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def distinct_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """First element per key, in first-seen order."""
    def keep(entries: Column) -> Column:
        return let(
            F.transform(entries, key),
            lambda keys: F.filter(
                entries, lambda e, i: F.array_position(keys, F.get(keys, i)) == i + 1
            ),
        )

    return let(items, keep)


def each(df: DataFrame, keys: Sequence, items: Column, name: str) -> DataFrame:
    """One row per array element, NULL elements left out.

    An inner ``explode`` of a computed array makes the optimizer add a
    ``size(...) > 0`` filter below it, which computes the array again; the outer
    form followed by a filter on the element computes it once.
    """
    return df.select(*keys, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def each_with_position(
    df: DataFrame, keys: Sequence, items: Column, position: str, name: str
) -> DataFrame:
    """As :func:`each`, with the 0-based index of the element."""
    return df.select(*keys, F.posexplode_outer(items).alias(position, name)).where(
        F.col(position).isNotNull()
    )
