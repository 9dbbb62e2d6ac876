"""Text normalisation and display functions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

from .. import lexicon as lx
from .columns import choose, col, distinct_by, let, literal_array, null_if_empty, rstrip, strip, strip_chars, words


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition, without marks, holds matching characters.

    The first two strings map one to one; the dictionary holds the decompositions of
    several characters (ligatures, Roman numerals, fractions, squared words).  What
    decomposes to none of ``[A-Za-z0-9+#.&]`` ends as a space in the matching form anyway.
    """
    source, target, longer = [], [], {}
    for code in range(0xA0, 0x20000):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or not unicodedata.decomposition(char):
            continue
        plain = unicodedata.normalize("NFKD", char)
        base = "".join(c for c in plain if not unicodedata.combining(c))
        if base == char or not re.search(r"[A-Za-z0-9+#.&]", base):
            continue
        if len(base) == 1:
            source.append(char)
            target.append(base)
        else:
            longer[char] = base
    return "".join(source), "".join(target), longer


_FOLD_FROM, _FOLD_TO, _FOLD_LONGER = _fold_tables()
_LONGER_KEYS, _LONGER_FORMS = "".join(_FOLD_LONGER), list(_FOLD_LONGER.values())


def _class_around(chars: str, gap: int = 64) -> str:
    """A character class of few ranges that covers ``chars``; what lies in a small gap is covered too."""
    ranges: list[list[str]] = []
    for char in sorted(chars):
        if ranges and ord(char) - ord(ranges[-1][1]) <= gap:
            ranges[-1][1] = char
        else:
            ranges.append([char, char])
    return "[" + "".join(f"{a}-{b}" for a, b in ranges) + "]"


_MAY_BE_LONGER = _class_around(_LONGER_KEYS)


def fold_accents(c: Column) -> Column:
    """Compatibility forms as plain characters, without combining marks; ASCII text is left as it is."""
    def spelled(text: Column) -> Column:
        return F.array_join(
            F.transform(
                F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)),
                lambda ch: F.coalesce(
                    F.get(literal_array(_LONGER_FORMS), F.position(ch, F.lit(_LONGER_KEYS)) - 1), ch
                ),
            ),
            "",
        )

    def folded(text: Column) -> Column:
        whole = F.when(text.rlike(_MAY_BE_LONGER), spelled(text)).otherwise(text)
        return F.regexp_replace(F.translate(whole, _FOLD_FROM, _FOLD_TO), r"\p{Mn}+", "")

    return let(c, lambda text: F.when(F.octet_length(text) == F.length(text), text).otherwise(folded(text)))


def normalize_text(c: Column | str) -> Column:
    """Lower-case, accent-free matching form: ``[a-z0-9+#.]`` words, single spaces."""
    lowered = F.replace(F.lower(fold_accents(col(c))), F.lit("&"), F.lit(" and "))
    # Taking the words out costs a quarter of replacing what stands between them.
    found = F.regexp_extract_all(lowered, F.lit("[a-z0-9+#.]+"), F.lit(0))
    return F.coalesce(F.array_join(found, " "), F.lit(""))


def normalize_unicode(c: Column | str) -> Column:
    """NFKC form without zero-width characters.

    Runs in the JVM through the ICU library on Spark's own class path.
    """
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(col(c), F.lit("")),
        F.lit(True),
    )
    return F.translate(composed, lx.ZERO_WIDTH, "")


def slugify_unknown(c: Column | str) -> Column:
    """Stable identifier of a term the catalogue does not know."""
    key = F.regexp_replace(normalize_text(c), r"\.net$", " dotnet")
    key = F.trim(F.regexp_replace(key, r"[^a-z0-9+#]+", " "))
    return F.coalesce(null_if_empty(F.replace(key, F.lit(" "), F.lit("_"))), F.lit("unknown"))


def lookup_keys(c: Column | str) -> Column:
    """Catalogue keys to try for a term, best first: as written, then singular forms."""

    def keys(key: Column) -> Column:
        size = F.length(key)

        def trimmed(suffix: str, add: str = "") -> Column:
            n = len(suffix)
            return F.when(
                F.endswith(key, F.lit(suffix)) & (size > n + 2),
                F.concat(F.left(key, size - n), F.lit(add)),
            )

        return F.array_distinct(
            F.array_compact(
                F.array(
                    null_if_empty(key), trimmed("s"), trimmed("es"), trimmed("es", "e"),
                    trimmed("js"), trimmed("js", "j"),
                )
            )
        )

    return let(normalize_text(c), keys)


def collapse_whitespace(c: Column | str) -> Column:
    text = F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(text, lx.HORIZONTAL_SPACE, " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    return F.coalesce(strip(F.regexp_replace(text, r"\n{3,}", "\n\n")), F.lit(""))


def truncate(c: Column | str, limit: int, suffix: str = "...") -> Column:
    text = col(c)
    if limit <= 0:
        return text
    cut = F.concat(rstrip(F.left(text, F.lit(max(0, limit - len(suffix))))), F.lit(suffix))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def snippet(text: Column, start: Column, end: Column, padding: int = 60, limit: int = 220) -> Column:
    """Readable window around ``[start, end)`` (0-based), with ellipses where cut."""
    left = F.greatest(F.lit(0), start - padding)
    right = F.least(F.length(text), end + padding)
    window = F.substring(text, left + 1, right - left)
    first_line = F.when(left > 0, F.get(F.split(window, "\n"), F.lit(0))).otherwise(window)
    body = F.array_join(words(F.regexp_replace(first_line, lx.LIST_MARKER, "")), " ")
    body = F.when(left > 0, F.concat(F.lit("..."), body)).otherwise(body)
    body = F.when(right < F.length(text), F.concat(rstrip(body), F.lit("..."))).otherwise(body)
    return truncate(body, limit)


def strip_bullets(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), lx.LEADING_BULLET, ""))


def dehyphenate(c: Column | str) -> Column:
    return F.regexp_replace(col(c), lx.HYPHEN_BREAK, "$1$2")


def titlecase_keywords(c: Column | str) -> Column:
    """Comma list in title case; acronyms and short capitals stay as they are."""

    def word_form(word: Column) -> Column:
        lowered = F.lower(word)
        hyphenated = F.array_join(
            F.transform(
                F.filter(F.split(word, "-"), lambda p: F.length(p) > 0), lambda p: F.initcap(p)
            ),
            "-",
        )
        capitals = (word == F.upper(word)) & (word != lowered) & (F.length(word) <= 5)
        return (
            F.when(F.contains(word, F.lit("-")), F.coalesce(choose(lowered, lx.ACRONYMS), hyphenated))
            .otherwise(
                F.coalesce(
                    choose(lowered, lx.ACRONYMS),
                    F.when(capitals, word),
                    F.initcap(word),
                )
            )
        )

    def part_form(part: Column) -> Column:
        return F.coalesce(
            choose(F.lower(part), lx.ACRONYMS),
            F.array_join(F.transform(words(part), word_form), " "),
        )

    parts = F.transform(F.split(collapse_whitespace(c), r"[,;|/\n]|(?<=\w)\s{2,}"), strip)
    return F.array_join(F.transform(F.filter(parts, lambda p: F.length(p) > 0), part_form), ", ")


def split_terms(c: Column | str, separator: str = ",") -> Column:
    """Trimmed non-empty items of a delimited list."""
    parts = F.transform(F.split(col(c), separator), strip)
    return F.filter(parts, lambda p: F.length(p) > 0)


def unique_terms(items: Column) -> Column:
    """Trimmed, non-empty, distinct items in first-seen order."""
    return F.array_distinct(F.filter(F.transform(items, strip), lambda p: F.length(p) > 0))


def coerce_terms(c: Column | str, limit: int | None = None) -> Column:
    """Clean term list out of free text: bullets and quotes stripped, case-insensitive dedupe."""
    items = F.transform(
        F.split(col(c), r"[,;\n]|\s{2,}"),
        lambda t: strip_chars(F.regexp_replace(t, "^[\\s\\-*•\\d.)]+", ""), " ,;•\"'"),
    )
    kept = F.filter(items, lambda t: F.length(t).between(2, 120))
    out = distinct_by(kept, lambda t: F.lower(t))
    return out if limit is None else F.slice(out, 1, limit)


def union_terms(first: Column, second: Column) -> Column:
    """``first`` followed by the terms of ``second`` it does not have yet."""
    return let(
        F.transform(first, normalize_text),
        lambda seen: F.concat(
            first,
            distinct_by(
                F.filter(
                    second,
                    lambda t: (F.length(normalize_text(t)) > 0)
                    & ~F.array_contains(seen, normalize_text(t)),
                ),
                normalize_text,
            ),
        ),
    )
