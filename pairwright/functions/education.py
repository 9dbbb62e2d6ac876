"""Degrees, institutions and study fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import lexicon as lx
from .columns import any_of, choose, col, contains_any, group, let, null_if_empty, strip, strip_chars
from .text import normalize_text, truncate


def _tokens_by_rank(tokens) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for token, rank in tokens:
        out.setdefault(rank, []).append(token)
    return dict(sorted(out.items(), reverse=True))


def _rank_of(normalized: Column, tokens) -> Column:
    """Highest rank whose token stands as whole words in the text, else 0."""
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))

    def ladder(text: Column) -> Column:
        out = None
        for rank, names in _tokens_by_rank(tokens).items():
            test = text.rlike(" (?:" + "|".join(names) + ") ")
            out = F.when(test, rank) if out is None else out.when(test, rank)
        return out.otherwise(0)

    return let(padded, ladder)


def degree_rank(c: Column | str) -> Column:
    """Free-text qualification on a 0-6 scale; 0 means unknown."""
    text = F.regexp_replace(normalize_text(c), r"(?<=[a-z])\.", "")
    return _rank_of(F.trim(F.regexp_replace(text, r"\s+", " ")), lx.DEGREE_TOKENS)


def describe_degree(c: Column | str) -> Column:
    label = F.coalesce(choose(degree_rank(c), lx.DEGREE_LABELS), F.lit("Unrecognised"))
    text = F.concat(truncate(c, 80), F.lit(" ("), label, F.lit(")"))
    return F.when(F.coalesce(F.length(col(c)), F.lit(0)) == 0, "Not detected").otherwise(text)


def meets_education_requirement(degree: Column | str, requirement: Column | str) -> Column:
    """True when the degree reaches the requirement, or nothing recognisable is required."""

    def compare(wanted: Column) -> Column:
        return (wanted == 0) | (degree_rank(degree) >= wanted)

    stated = degree_rank(requirement)
    keyword = _first_rank(normalize_text(requirement))
    return let(F.when(stated > 0, stated).otherwise(keyword), compare)


def _first_rank(normalized: Column) -> Column:
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    out = None
    for token, rank in lx.REQUIREMENT_TOKENS:
        test = F.contains(padded, F.lit(f" {token} "))
        out = F.when(test, rank) if out is None else out.when(test, rank)
    return out.otherwise(0)


def study_field(c: Column | str) -> Column:
    def pick(text: Column) -> Column:
        return F.coalesce(
            *[F.when(F.contains(text, F.lit(f)), f.title()) for f in lx.STUDY_FIELDS]
        )

    return let(normalize_text(c), pick)


def degree_phrase(c: Column | str) -> Column:
    """The qualification alone, out of a line that also names a place or a year."""
    head = F.get(F.split(col(c), r"\s*[,;|]\s*|\s+-\s+|\s+at\s+", 2), F.lit(0))
    return null_if_empty(strip(head))


def institution(c: Column | str) -> Column:
    line = col(c)
    hinted = contains_any(normalize_text(line), lx.INSTITUTION_HINTS)

    def place(text: Column) -> Column:
        at = F.instr(text, " at ")
        after = F.substring(text, at + 4, F.length(text))
        named = (at > 0) & (degree_rank(F.left(text, at - 1)) > 0)
        return null_if_empty(strip_chars(F.when(named, after).otherwise(text), " ,-–—"))

    return F.when(hinted, let(F.regexp_replace(strip(line), lx.LEADING_DEGREE, ""), place))


def year_in(c: Column | str) -> Column:
    """First four-digit year of a line."""
    return group(col(c), lx.FOUR_DIGIT_YEAR, 1).try_cast("int")


def strip_trailing_year(c: Column) -> Column:
    return strip(strip_chars(F.regexp_replace(c, lx.TRAILING_YEAR, ""), " ,;-"))
