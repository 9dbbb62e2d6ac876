"""Reading a screening question: intent, sort field, names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import lexicon as lx
from .columns import col, let, strip_chars


def _first_label(text: Column, rules) -> Column:
    out = None
    for label, pattern in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out


def classify_intent(c: Column | str) -> Column:
    """First matching intent, NULL when none matches."""
    return _first_label(col(c), lx.INTENTS)


def sort_hint(c: Column | str) -> Column:
    return F.coalesce(_first_label(col(c), lx.SORT_HINTS), F.lit("overall"))


def named_candidates(c: Column | str, most: int | None = None) -> Column:
    """Names a question mentions, the first ``most`` of them if given."""
    text = col(c)

    def names_after(marker: str):
        def build(lowered: Column) -> Column:
            at = F.instr(lowered, marker)
            tail = F.substring(lowered, at + len(marker), F.length(lowered))
            tail = F.get(F.split(tail, r"\?"), F.lit(0))
            parts = F.transform(F.split(tail, lx.NAME_SPLIT), lambda p: strip_chars(p, " ."))
            return F.filter(parts, lambda p: F.length(p) > 1)

        return build

    def by_marker(lowered: Column) -> Column:
        out = None
        for marker in lx.NAME_MARKERS:
            test, value = F.contains(lowered, F.lit(marker)), names_after(marker)(lowered)
            out = F.when(test, value) if out is None else out.when(test, value)
        quoted = F.regexp_extract_all(text, F.lit(lx.QUOTED_NAME), F.lit(1))
        found = out.otherwise(quoted)
        return found if most is None else F.slice(found, 1, most)

    return let(F.lower(text), by_marker)
