"""Cleaning, sentences, sections and line classes of whole documents.

A document stays one row: its lines are an array that native higher-order
functions work on, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions.columns import (
    choose, col, contains_any, each, each_with_position, first_where, group, let, literal_array, not_blank, rstrip,
    strip, strip_chars, words,
)
from ..functions.dates import is_role_header
from ..functions.text import dehyphenate, normalize_text, normalize_unicode

RUNNING_HEADER_MIN_LINES = 25
SECTION_TYPE = (
    "array<struct<key:string,heading:string,start_line:int,end_line:int,text:string>>"
)


# -- cleaning -----------------------------------------------------------------
def raw_lines(text: Column) -> Column:
    """Lines of a decoded document before header removal."""
    out = normalize_unicode(text)
    out = F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(dehyphenate(out), lx.HORIZONTAL_SPACE, " ")
    return F.transform(
        F.split(out, "\n"), lambda l: rstrip(F.regexp_replace(l, lx.LEADING_BULLET, ""))
    )


def _with_repeats(lines: Column) -> Column:
    """``line, key, often, single`` per line: does its text occur three times, or once?

    Equal keys are neighbours after a sort, so a run is recognised by comparing
    with the entries two places away; a second sort restores document order.
    """
    def mark(entries: Column) -> Column:
        counted = F.filter(entries, lambda e: (F.length(e["key"]) > 0) & (F.length(e["key"]) < 90))
        rest = F.filter(entries, lambda e: ~((F.length(e["key"]) > 0) & (F.length(e["key"]) < 90)))

        def runs(ordered: Column) -> Column:
            def same(p: Column, shift: int, key: Column) -> Column:
                return F.coalesce(F.get(ordered, p + shift)["key"] == key, F.lit(False))

            return F.transform(
                ordered,
                lambda e, p: F.struct(
                    e["i"].alias("i"), e["line"].alias("line"), e["key"].alias("key"),
                    (
                        same(p, 2, e["key"])
                        | same(p, -2, e["key"])
                        | (same(p, 1, e["key"]) & same(p, -1, e["key"]))
                    ).alias("often"),
                    (~same(p, 1, e["key"]) & ~same(p, -1, e["key"])).alias("single"),
                ),
            )

        by_key = F.array_sort(
            F.transform(counted, lambda e: F.struct(e["key"].alias("key"), e["i"].alias("i"), e["line"].alias("line")))
        )
        plain = F.transform(
            rest,
            lambda e: F.struct(
                e["i"].alias("i"), e["line"].alias("line"), e["key"].alias("key"),
                F.lit(False).alias("often"), F.lit(False).alias("single"),
            ),
        )
        return F.array_sort(F.concat(let(by_key, runs), plain))

    entries = F.transform(
        lines,
        lambda l, i: F.struct(i.alias("i"), l.alias("line"), normalize_text(l).alias("key")),
    )
    return let(entries, mark)


def _drop_artefacts(lines: Column) -> Column:
    """Remove page numbers, bare URLs and running headers; blank what is blank."""
    def drop(marked: Column) -> Column:
        total = F.size(marked)

        def keep(e: Column) -> Column:
            text = strip(e["line"])
            edge = (e["i"] <= 1) | (e["i"] == total - 1)
            noise = text.rlike(lx.PAGE_NOISE) | text.rlike(lx.URL_LINE)
            repeated = (
                e["often"] & (F.length(e["key"]) < 60) & (total > RUNNING_HEADER_MIN_LINES)
            )
            banner = e["single"] & edge & text.rlike(lx.RUNNING_HEADER_HINT)
            return (F.length(text) == 0) | ~(noise | repeated | banner)

        return F.transform(F.filter(marked, keep), lambda e: strip(e["line"]))

    return let(_with_repeats(lines), drop)


def _collapse_blanks(lines: Column) -> Column:
    """One blank between paragraphs, none at the ends."""
    def keep(items: Column) -> Column:
        kept = F.filter(
            items,
            lambda l, i: (F.length(l) > 0)
            | ((i > 0) & (F.length(F.coalesce(F.get(items, i - 1), F.lit(""))) > 0)),
        )
        return let(
            kept,
            lambda k: F.filter(k, lambda l, i: (F.length(l) > 0) | (i < F.size(k) - 1)),
        )

    return let(lines, keep)


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``lines``: the cleaned lines of each document."""
    # ICU normalisation runs once per document, outside any lambda.
    staged = docs.withColumn("_raw", raw_lines(F.col(text)))
    lines = _collapse_blanks(_drop_artefacts(F.col("_raw")))
    empty = F.array().cast("array<string>")
    return staged.withColumn(
        "lines", F.coalesce(F.when(F.length(text) > 0, lines), empty)
    ).drop("_raw")


def clean_text(lines: Column | str = "lines") -> Column:
    return F.array_join(col(lines), "\n")


def split_sentences(
    docs: DataFrame, key: str, lines: str = "lines", min_length: int = lx.MIN_SENTENCE
) -> DataFrame:
    """``key, position, sentence`` for every sentence long enough."""
    pieces = F.flatten(
        F.transform(
            lines,
            lambda l: F.transform(
                F.split(strip(l), lx.SENTENCE_BREAK), lambda s: strip_chars(s, lx.SENTENCE_EDGE)
            ),
        )
    )
    kept = F.filter(pieces, lambda s: F.length(s) >= min_length)
    return each_with_position(docs, [key], kept, "position", "sentence")


def doc_lines(docs: DataFrame, key: str, lines: str = "lines") -> DataFrame:
    return each_with_position(docs, [key], F.col(lines), "line_no", "line")


# -- sections -----------------------------------------------------------------
_ALIASES = {alias: key for key, names in lx.SECTION_ALIASES.items() for alias in names}


def _alias_key(label: Column) -> Column:
    return choose(normalize_text(label), _ALIASES)


def heading_key(line: Column) -> Column:
    """Section a heading line opens, NULL for any other line."""
    def decide(text: Column) -> Column:
        letters = F.length(F.array_join(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), ""))
        shaped = (
            (F.length(text) > 0)
            & (F.length(text) <= lx.HEADING_MAX_CHARS)
            & (F.size(words(text)) <= lx.HEADING_MAX_WORDS)
            & (letters >= F.greatest(F.lit(3.0), F.length(text) * 0.5))
        )
        inline = _alias_key(F.regexp_extract(text, lx.LABEL_WITH_CONTENT, 1))
        bare = _alias_key(strip(rstrip(text, ":")))
        return F.when(
            shaped,
            F.when(
                F.contains(text, F.lit(":")) & text.rlike(lx.LABEL_WITH_CONTENT),
                F.when(inline == lx.INLINE_SECTION, inline),
            ).otherwise(bare),
        )

    return let(strip(line), decide)


def inline_content(line: Column) -> Column:
    """Content after the colon of a skills heading."""
    label = _alias_key(F.regexp_extract(line, lx.LABEL_WITH_CONTENT, 1))
    return F.when(
        label == lx.INLINE_SECTION, strip(F.regexp_extract(line, lx.LABEL_WITH_CONTENT, 2))
    )


def _spans(lines: Column) -> Column:
    marks = F.filter(
        F.transform(lines, lambda l, i: F.struct(i.alias("i"), heading_key(l).alias("key"))),
        lambda m: m["key"].isNotNull(),
    )

    def body(first: Column, end: Column) -> Column:
        return F.array_join(F.slice(lines, first + 1, F.greatest(end - first, F.lit(0))), "\n")

    def build(found: Column) -> Column:
        def span(m: Column, p: Column) -> Column:
            end = F.coalesce(F.get(found, p + 1)["i"], F.size(lines))
            heading = strip(F.get(lines, m["i"]))
            content = inline_content(heading)
            rest = body(m["i"] + 1, end)
            return F.struct(
                m["key"].alias("key"), heading.alias("heading"), m["i"].alias("start_line"),
                end.alias("end_line"),
                strip(
                    F.when(content.isNotNull(), F.concat_ws("\n", content, rest)).otherwise(rest)
                ).alias("text"),
            )

        first = F.get(found, F.lit(0))["i"]
        top = strip(body(F.lit(0), first))
        preamble = F.when(
            (first > 0) & (F.length(top) > 0),
            F.array(
                F.struct(
                    F.lit("preamble").alias("key"), F.lit("(header)").alias("heading"),
                    F.lit(0).alias("start_line"), first.alias("end_line"), top.alias("text"),
                )
            ),
        )
        none = F.array().cast(SECTION_TYPE)
        return F.concat(
            F.coalesce(preamble.cast(SECTION_TYPE), none),
            F.transform(found, span).cast(SECTION_TYPE),
        )

    return let(marks, build)


def sectionise(docs: DataFrame, lines: str = "lines") -> DataFrame:
    """Add ``sections``: one span per recognised heading, in document order.

    A section runs to the next heading; lines before the first are ``preamble``.
    """
    return docs.withColumn("sections", _spans(F.col(lines)))


def section_rows(docs: DataFrame, key: str) -> DataFrame:
    return each(docs, [key], F.col("sections"), "s").select(
        key, F.col("s.key").alias("section"), "s.heading", "s.start_line", "s.end_line", "s.text"
    )


def section_text(name: str, sections: str = "sections", max_chars: int | None = None) -> Column:
    """Text of a section, repeated sections concatenated, empty when absent."""
    texts = F.transform(
        F.filter(sections, lambda s: (s["key"] == name) & (F.length(s["text"]) > 0)),
        lambda s: s["text"] if max_chars is None else F.left(s["text"], F.lit(max_chars)),
    )
    return F.coalesce(F.array_join(texts, "\n"), F.lit(""))


def section_map(sections: str = "sections") -> Column:
    """All non-empty sections as a map."""
    keys = F.array_distinct(
        F.transform(
            F.filter(sections, lambda s: F.length(s["text"]) > 0), lambda s: s["key"]
        )
    )
    return F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(
                k.alias("key"),
                F.array_join(
                    F.transform(
                        F.filter(sections, lambda s: (s["key"] == k) & (F.length(s["text"]) > 0)),
                        lambda s: s["text"],
                    ),
                    "\n",
                ).alias("value"),
            ),
        )
    )


# -- line classes -------------------------------------------------------------
def contact_parts(line: Column) -> Column:
    return F.filter(
        F.transform(F.split(strip(line), lx.CONTACT_SPLIT), strip), lambda p: F.length(p) > 0
    )


def is_contact_line(line: Column) -> Column:
    """A strip of only e-mail, phone and URL parts."""
    parts = contact_parts(line)
    return (
        not_blank(line)
        & (F.length(strip(line)) <= 200)
        & (F.size(parts) > 0)
        & F.forall(parts, lambda p: p.rlike(lx.CONTACT_PART))
    )


def is_email_line(line: Column) -> Column:
    return strip(line).rlike(lx.EMAIL_LINE)


def _one_of(text: Column, values) -> Column:
    return F.array_contains(literal_array(values), text)


def is_header_text(line: Column) -> Column:
    """Headings, separators and contact strips that stand where a name could."""
    def decide(text: Column) -> Column:
        key = normalize_text(text)
        return (
            (F.length(text) == 0)
            | (F.size(words(text)) > 6)
            | _one_of(key, lx.ROLE_WORDS)
            | text.rlike(r"(?U)^[\W_]+$")
            | key.rlike(r"^(?:section|page)\b")
            | F.contains(text, F.lit("|"))
            | is_contact_line(text)
            | (text.rlike(lx.COUNTRY) & F.contains(text, F.lit(",")))
        )

    return let(strip(line), decide)


def is_plausible_name(value: Column) -> Column:
    """Two to five capitalisable words, no role word, no banner."""
    tokens = F.filter(F.split(strip(value), r"[\s.]+"), lambda t: F.length(t) > 0)
    return (
        F.size(tokens).between(2, 5)
        & F.length(value).between(4, 60)
        & ~_one_of(normalize_text(value), lx.ROLE_WORDS)
        & F.forall(
            tokens, lambda t: t.rlike(lx.NAME_TOKEN) & ~_one_of(F.lower(t), lx.ROLE_WORDS)
        )
        & ~((value == F.upper(value)) & (F.length(value) > 40))
    )


def is_plausible_location(value: Column) -> Column:
    """Two or three comma parts of up to three capitalised words without digits."""
    parts = F.filter(F.transform(F.split(value, ","), strip), lambda p: F.length(p) > 0)
    return (
        F.size(parts).between(2, 3)
        & (F.length(value) <= 80)
        & ~value.rlike(lx.LABEL_LINE)
        & F.forall(
            parts,
            lambda p: ~p.rlike(r"\d") & (F.size(words(p)) <= 3) & p.rlike(r"^\p{Lu}"),
        )
    )


def is_title(value: Column) -> Column:
    """A short line with a title word, without separators or a year."""
    def decide(tokens: Column) -> Column:
        return F.size(tokens).between(1, 6) & F.arrays_overlap(tokens, literal_array(lx.TITLE_HINTS))

    return (
        ~value.rlike(r"[|@]")
        & ~value.rlike(lx.FOUR_DIGIT_YEAR)
        & let(words(normalize_text(value)), decide)
    )


def classify_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Boolean class columns per line."""
    c = F.col(line)
    return lines.withColumns(
        {
            "is_contact": is_contact_line(c),
            "is_email": is_email_line(c),
            "is_header": is_header_text(c),
            "is_name": is_plausible_name(c),
            "is_location": is_plausible_location(c),
            "is_title": is_title(c),
            "is_role_header": is_role_header(c),
            "is_certification": is_certification_line(c),
        }
    )


def is_certification_line(line: Column) -> Column:
    return contains_any(normalize_text(line), lx.CERTIFICATION_MARKERS)


def label_value(line: Column, pattern: str) -> Column:
    return strip(group(strip(line), pattern, 1))
