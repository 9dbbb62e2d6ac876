"""JSON text columns that may be corrupt: decode to native types or to a default."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import col, strip
from .text import split_terms

_EMPTY_LIST = "array<string>"


def _empty() -> Column:
    return F.array().cast(_EMPTY_LIST)


def json_list(c: Column | str) -> Column:
    """Array of strings; a scalar or an object becomes a one-element list, corrupt text none."""
    text = strip(col(c))
    valid = F.try_parse_json(text).isNotNull() & (text != "null")
    wrapped = F.when(F.startswith(text, F.lit("[")), text).otherwise(
        F.concat(F.lit("["), text, F.lit("]"))
    )
    return F.coalesce(F.when(valid, F.from_json(wrapped, _EMPTY_LIST)), _empty())


def json_dict(c: Column | str) -> Column:
    """Map of strings; anything that is not an object becomes an empty map."""
    text = strip(col(c))
    valid = F.startswith(text, F.lit("{")) & F.try_parse_json(text).isNotNull()
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(valid, F.from_json(text, "map<string,string>")), empty)


def string_list(c: Column | str) -> Column:
    """A list column that holds a JSON array, a comma list after a stray bracket, or one value."""
    text = strip(col(c))
    bracketed = F.startswith(text, F.lit("["))
    parsed = F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, _EMPTY_LIST))
    return (
        F.when(col(c).isNull(), F.lit(None).cast(_EMPTY_LIST))
        .when(F.length(text) == 0, _empty())
        .when(bracketed, F.coalesce(parsed, split_terms(text)))
        .otherwise(F.array(col(c)))
    )


def json_text(c: Column | str) -> Column:
    """Compact JSON text of an array, map or struct column."""
    return F.to_json(col(c))
