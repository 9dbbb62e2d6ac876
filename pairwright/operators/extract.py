"""Candidate facts out of cleaned documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicon as lx
from ..functions import dates, education
from ..functions.columns import (
    any_of, contains_any, each_with_position, first_where, group, let, literal_array, null_if_empty, rstrip, strip,
    strip_chars, words,
)
from ..functions.text import normalize_text, slugify_unknown, snippet, truncate
from ..schemas import EMPLOYMENT_ENTRY
from ..session import written
from . import documents as d
from .catalogue import find_skill_mentions, resolve_terms

OBSERVATION = (
    "normalized_name", "display_name", "category", "confidence", "years_experience",
    "is_certified", "evidence", "source",
)


# -- contact details ----------------------------------------------------------
def _digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\D", ""))


def email(text: Column) -> Column:
    return null_if_empty(F.regexp_extract(text, lx.EMAIL, 0))


def phone(text: Column) -> Column:
    """The candidate with the most digits (9 to 15), the first among equals."""
    found = F.transform(F.regexp_extract_all(text, F.lit(lx.PHONE), F.lit(0)), strip)
    usable = F.filter(
        found, lambda p: _digits(p).between(9, 15) & ~p.rlike("^(?:19|20)")
    )
    ordered = F.array_sort(
        F.transform(usable, lambda p, i: F.struct((-_digits(p)).alias("n"), i.alias("i"), p.alias("p")))
    )
    return F.get(ordered, F.lit(0))["p"]


def _url(c: Column) -> Column:
    text = rstrip(strip(c), ".,;)")
    return F.when(F.startswith(text, F.lit("http")), text).otherwise(F.concat(F.lit("https://"), text))


def link(text: Column, pattern: str) -> Column:
    return _url(null_if_empty(F.regexp_extract(text, pattern, 0)))


def portfolio(text: Column) -> Column:
    """First URL with a path on a host of its own; only the listed hosts are excluded."""
    def own_host(token: Column) -> Column:
        host = F.regexp_replace(F.lower(token), r"^(?:[a-z]+://)?", "")
        host = F.regexp_replace(F.get(F.split(host, "[/:]"), F.lit(0)), r"^www\.", "")
        return (
            (F.length(token) >= len("https://x.io") + 4)
            & F.contains(token, F.lit("/"))
            & (F.length(host) > 0)
            & ~any_of(
                lx.NON_PORTFOLIO_HOSTS,
                lambda h: (host == h) | F.endswith(host, F.lit(f".{h}")),
            )
        )

    tokens = F.transform(
        F.regexp_extract_all(text, F.lit(lx.URL_TOKEN), F.lit(0)), lambda t: rstrip(strip(t), ".,;)")
    )
    return _url(first_where(tokens, own_host))


def full_name(lines: Column, mail: Column) -> Column:
    """A name-shaped line near the top, a labelled name, the e-mail's local part, or a later such line."""

    def shaped_in(candidates: Column) -> Column:
        return first_where(
            F.transform(candidates, strip),
            lambda l: (F.length(l) > 0)
            & ~d.is_contact_line(l)
            & ~d.is_header_text(l)
            & d.is_plausible_name(l),
        )

    shaped = shaped_in(F.slice(lines, 1, lx.NAME_LINES))
    labels = F.transform(lines, lambda l: d.label_value(l, lx.NAME_LABEL))
    labelled = first_where(labels, lambda l: F.coalesce(d.is_plausible_name(l), F.lit(False)))
    local = F.regexp_replace(F.get(F.split(mail, "@"), F.lit(0)), r"\d+", " ")
    parts = F.filter(F.split(local, r"[._\-]+"), lambda p: F.length(p) > 0)

    def from_mail(names: Column) -> Column:
        joined = strip(F.array_join(names, " "))
        fits = F.length(joined).between(4, 60) & F.forall(
            names,
            lambda n: n.rlike(lx.NAME_TOKEN)
            | F.array_contains(literal_array(lx.NAME_SUFFIXES), F.lower(n)),
        )
        return F.when(fits, joined)

    return F.coalesce(
        shaped, labelled, let(F.transform(parts, lambda p: F.initcap(p)), from_mail), shaped_in(lines)
    )


def location(lines: Column) -> Column:
    """City and country out of the header area, else of the whole text."""
    return F.coalesce(_location_in(F.slice(lines, 1, lx.LOCATION_LINES)), _location_in(lines))


def _location_in(lines: Column) -> Column:
    head = F.transform(lines, strip)
    in_bar = first_where(
        F.flatten(
            F.transform(F.filter(head, lambda l: F.contains(l, F.lit(","))), d.contact_parts)
        ),
        d.is_plausible_location,
    )
    alone = first_where(
        head,
        lambda l: F.contains(l, F.lit(",")) & ~d.is_header_text(l) & d.is_plausible_location(l),
    )
    text = F.array_join(lines, "\n")
    country = strip(group(text, lx.COUNTRY, 1))
    city = strip(group(text, lx.CITY_COUNTRY, 1))
    mentioned = F.when(
        country.isNotNull(),
        F.when(city.isNotNull(), F.concat_ws(", ", city, country)).otherwise(country),
    )
    return F.coalesce(in_bar, alone, mentioned)


def current_title(lines: Column, experience: Column) -> Column:
    """A labelled title, else the first title line of the experience section or document."""
    labels = F.flatten(
        F.transform(
            lines,
            lambda l: F.array(*[d.label_value(l, p) for p in lx.TITLE_LABELS]),
        )
    )
    labelled = first_where(labels, lambda t: t.isNotNull())
    source = F.when(F.length(experience) > 0, F.split(experience, "\n")).otherwise(lines)

    def title(line: Column) -> Column:
        before = strip(group(line, lx.TITLE_SEPARATOR, 1))
        usable = (F.length(line) > 0) & (F.length(line) <= 120)
        return F.when(
            usable,
            F.when(F.coalesce(d.is_title(before), F.lit(False)), before).when(
                d.is_title(line), line
            ),
        )

    found = first_where(
        F.transform(source, lambda l: let(strip(l), title)), lambda t: t.isNotNull()
    )
    return F.coalesce(labelled, found)


def extract_contacts(docs: DataFrame) -> DataFrame:
    """Add the contact columns; needs ``lines`` and ``sections``."""
    text, lines = d.clean_text(), F.col("lines")
    staged = docs.withColumns({"_text": text, "email": email(text)})
    head = F.array_join(F.slice(lines, 1, 15), "\n")
    return staged.withColumns(
        {
            "full_name": full_name(lines, F.col("email")),
            "phone": F.coalesce(phone(head), phone(F.col("_text"))),
            "location": location(lines),
            "linkedin_url": link(F.col("_text"), lx.LINKEDIN),
            "github_url": link(F.col("_text"), lx.GITHUB),
            "portfolio_url": portfolio(F.col("_text")),
            "current_title": current_title(lines, d.section_text("experience")),
        }
    ).drop("_text")


# -- dates and employment -----------------------------------------------------
def date_ranges(docs: DataFrame, key: str) -> DataFrame:
    """``key, line_no, start, end, is_current, months, raw`` of every dated line."""
    return (
        each_with_position(docs, [key], F.col("dated"), "line_no", "e")
        .where(F.col("e.r").isNotNull())
        .select(
            key, "line_no", "e.r.start", "e.r.end", "e.r.is_current",
            dates.months_between(F.col("e.r.start"), F.col("e.r.end")).alias("months"),
            "e.r.raw",
        )
    )


def merged_experience(
    spans: DataFrame, key: str, start: str = "start", end: str = "end",
    max_years: float | None = None,
) -> DataFrame:
    """Total distinct months covered by the spans of each key, as years.

    Spans with one start month are first reduced to the longest, so a key has at
    most one row per calendar month left however many spans it had; only those
    are ordered.
    """
    starts = spans.groupBy(key, F.col(start).alias("_s")).agg(F.max(end).alias("_e"))
    before = (
        Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = F.max("_e").over(before)
    added = F.greatest(F.lit(0), F.col("_e") - F.greatest(F.col("_s"), F.coalesce(reach, F.col("_s"))))
    months = starts.withColumn("_added", added).groupBy(key).agg(F.sum("_added").alias("months"))
    return months.select(
        key, "months",
        capped_years(F.col("months"), max_years).alias("years"),
    )


def covered_months(ranges: Column) -> Column:
    """Distinct months covered by an array of ranges inside one row."""
    def add(state: Column, r: Column) -> Column:
        fresh = F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], state["reach"]))
        return F.struct(
            F.greatest(state["reach"], r["end"]).alias("reach"),
            (state["months"] + fresh).alias("months"),
        )

    ordered = F.array_sort(
        F.transform(ranges, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    )
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("months"))
    return F.aggregate(ordered, zero, add, lambda s: s["months"])


def capped_years(months: Column, max_years: float | None = None) -> Column:
    years = months / F.lit(12.0)
    return F.round(years if max_years is None else F.least(years, F.lit(max_years)), 2)


def split_title_company(line: Column) -> Column:
    """``title, company`` at the first separator that leaves two usable parts."""
    def at(separator: str) -> Column:
        position = F.instr(line, separator)
        head = strip(F.left(line, position - 1))
        tail = strip(F.substring(line, position + len(separator), F.length(line)))
        fits = (
            (position > 0)
            & F.length(head).between(1, 80)
            & F.length(tail).between(1, 80)
        )
        if separator not in lx.ANY_CASE_SEPARATORS:
            fits = fits & tail.rlike(r"^\p{Lu}")
        return F.when(fits, F.struct(head.alias("title"), tail.alias("company")))

    whole = F.struct(
        null_if_empty(strip(line)).alias("title"), F.lit(None).cast("string").alias("company")
    )
    return F.coalesce(*[at(s) for s in lx.COMPANY_SEPARATORS], whole)


EMPLOYMENT_TYPE = f"struct<entries:array<{EMPLOYMENT_ENTRY}>,positions:array<string>>"


def dated(lines: Column, as_of: Column) -> Column:
    """Each line with its date range, ``array<struct<line, r>>``."""
    return F.transform(
        lines, lambda l: F.struct(strip(l).alias("line"), dates.date_range(l, as_of).alias("r"))
    )


def employment(rows: Column, max_bullets: int | None = None) -> Column:
    """Roles of an experience section given as :func:`dated` lines, and the titles that open them.

    A dated line opens a role; before the first of them a line that reads like a
    role does.  Lines in between are its bullets.  A role whose opening line
    carries no title takes it from the next line.
    """
    lines = F.filter(rows, lambda e: F.length(e["line"]) > 0)

    def read(e: Column, i: Column) -> Column:
        line, r = e["line"], e["r"]
        before = F.left(line, F.greatest(F.position(r["raw"], line) - 1, F.lit(0)))
        head = F.when(r.isNotNull(), strip_chars(before, " ,|()•-–—\t")).otherwise(line)
        return let(
            let(head, split_title_company),
            lambda named: F.struct(
                i.alias("i"), line.alias("line"), r.alias("r"),
                named["title"].alias("title"), named["company"].alias("company"),
                (r.isNotNull() | dates.is_role_header(line)).alias("opens"),
            ),
        )

    def entry(rows: Column, marks: Column, m: Column, p: Column) -> Column:
        last = F.coalesce(F.get(marks, p + 1)["i"], F.size(rows) - 1)
        borrowed = m["title"].isNull()
        title = F.coalesce(m["title"], F.get(rows, m["i"] + 1)["title"])
        skip = F.when(borrowed, m["i"] + 1).otherwise(m["i"])
        body = F.filter(
            F.slice(rows, m["i"] + 2, F.greatest(last - m["i"], F.lit(0))),
            lambda e: (e["i"] > skip)
            & F.coalesce(
                F.lower(F.when(e["r"].isNotNull(), e["title"]).otherwise(e["line"]))
                != F.lower(title),
                F.lit(False),
            ),
        )
        bullets = F.transform(body, lambda e: e["line"])
        if max_bullets is not None:
            bullets = F.slice(bullets, 1, max_bullets)
        r = m["r"]
        return F.struct(
            title.alias("title"), m["company"].alias("company"),
            F.when(r.isNotNull(), dates.month_text(r["start"])).alias("start"),
            F.when(~r["is_current"], dates.month_text(r["end"])).alias("end"),
            dates.months_between(r["start"], r["end"]).alias("months"),
            F.coalesce(r["is_current"], F.lit(False)).alias("is_current"),
            m["line"].alias("raw"), bullets.alias("bullets"),
        ).cast(EMPLOYMENT_ENTRY)

    def build(rows: Column) -> Column:
        first = first_where(rows, lambda e: e["opens"])["i"]

        def assemble(start: Column) -> Column:
            opening = F.filter(
                rows, lambda e: (e["i"] == start) | (e["r"].isNotNull() & (e["i"] > start))
            )
            return let(
                opening,
                lambda marks: F.struct(
                    F.transform(marks, lambda m, p: entry(rows, marks, m, p)).alias("entries"),
                    F.array_distinct(
                        F.filter(
                            F.transform(marks, lambda m: m["title"]), lambda t: t.isNotNull()
                        )
                    ).alias("positions"),
                ),
            )

        return let(F.coalesce(first, F.lit(-1)), lambda at: assemble(at))

    return let(F.transform(lines, read), build)


def is_relevant_title(title: Column) -> Column:
    return F.coalesce(
        dates.is_role_header(title) & contains_any(F.lower(title), lx.RELEVANT_TITLE_WORDS),
        F.lit(False),
    )


def with_dates(docs: DataFrame, as_of: Column) -> DataFrame:
    """Add ``dated``, aligned with ``lines``; every date operator reads it."""
    return docs.withColumn("dated", dated(F.col("lines"), as_of))


def _section_dates(name: str) -> Column:
    """The dated lines of a section, in document order."""
    spans = F.filter("sections", lambda s: s["key"] == name)
    return F.flatten(
        F.transform(
            spans,
            lambda s: F.slice(
                F.col("dated"), s["start_line"] + 2,
                F.greatest(s["end_line"] - s["start_line"] - 1, F.lit(0)),
            ),
        )
    )


def employment_history(docs: DataFrame) -> DataFrame:
    """Add ``employment_history`` and ``previous_positions``; needs ``dated`` and ``sections``."""
    return (
        docs.withColumn("_e", employment(_section_dates("experience")))
        .withColumns(
            {
                "employment_history": F.col("_e.entries"),
                "previous_positions": F.col("_e.positions"),
            }
        )
        .drop("_e")
    )


def _ranges(rows: Column) -> Column:
    return F.transform(F.filter(rows, lambda e: e["r"].isNotNull()), lambda e: e["r"])


def _entry_ranges(history: Column) -> Column:
    """Month ranges of dated roles, rebuilt from their start and length."""
    def one(e: Column) -> Column:
        start = F.substring(e["start"], 1, 4).cast("int") * 12 + F.substring(e["start"], 6, 2).cast("int")
        return F.struct(start.alias("start"), (start + e["months"]).alias("end"))

    return F.transform(F.filter(history, lambda e: e["start"].isNotNull()), one)


def experience_years(docs: DataFrame, section: str | None = None) -> DataFrame:
    """Add total (overlaps merged) and relevant (technical roles) years.

    The total reads every line, or one section when named.  Relevant years are
    not overlap-merged; without a dated technical role the total of the role
    lines stands in when the text is technical at all.
    """
    source = F.col("dated") if section is None else _section_dates(section)
    history = F.col("employment_history")

    def months(items: Column) -> Column:
        return F.aggregate(items, F.lit(0), lambda s, e: s + F.coalesce(e["months"], F.lit(0)))

    staged = docs.withColumns(
        {
            "_total": capped_years(covered_months(_ranges(source))),
            "_relevant": months(F.filter(history, lambda e: is_relevant_title(e["title"]))),
            "_roles": capped_years(covered_months(_entry_ranges(history))),
            "_technical": contains_any(F.lower(d.clean_text()), lx.TECHNICAL_TEXT_WORDS),
        }
    )
    total = F.when(F.col("_total") > 0, F.col("_total")).otherwise(
        F.round(months(history) / F.lit(12.0), 2)
    )
    relevant = (
        F.when(F.col("_relevant") > 0, F.round(F.col("_relevant") / F.lit(12.0), 2))
        .when(F.col("_technical"), F.col("_roles"))
        .otherwise(0.0)
    )
    return staged.withColumns(
        {"total_experience_years": total, "relevant_experience_years": relevant}
    ).drop("_total", "_relevant", "_roles", "_technical")


# -- education ----------------------------------------------------------------
def _education(lines: Column) -> Column:
    """Best qualification of a list of lines: highest rank, then latest year, then first."""
    def read(line: Column, i: Column) -> Column:
        facts = F.struct(
            education.degree_rank(line).alias("rank"), education.year_in(line).alias("year")
        )
        return let(
            facts,
            lambda f: F.struct(
                (-f["rank"]).alias("order_rank"),
                (-F.coalesce(f["year"], F.lit(0))).alias("order_year"),
                i.alias("i"),
                F.when(f["rank"] > 0, education.degree_phrase(line)).alias("degree"),
                education.study_field(line).alias("field"),
                education.institution(line).alias("institution"),
                f["year"].alias("year"),
            ),
        )

    def pick(rows: Column) -> Column:
        best = F.get(F.array_sort(rows), F.lit(0))

        def first(name: str) -> Column:
            return first_where(F.transform(rows, lambda r: r[name]), lambda v: v.isNotNull())

        field = F.coalesce(best["field"], first("field"))
        degree = best["degree"]
        named = F.when(
            degree.isNotNull()
            & field.isNotNull()
            & ~F.contains(normalize_text(degree), F.lower(field)),
            F.concat(degree, F.lit(" ("), field, F.lit(")")),
        ).otherwise(degree)
        return F.struct(
            named.alias("degree"),
            field.alias("field"),
            F.coalesce(best["institution"], first("institution")).alias("institution"),
            F.coalesce(best["year"], F.array_max(F.transform(rows, lambda r: r["year"]))).alias("year"),
            (-best["order_rank"]).alias("rank"),
        )

    return let(F.transform(lines, read), pick)


def _tidy(info: Column) -> Column:
    """Move year and institution out of the degree text."""
    place = education.strip_trailing_year(info["institution"])
    degree = education.strip_trailing_year(info["degree"])
    at = F.position(F.concat(F.lit(", "), place), degree)
    cut = F.when(at > 0, strip_chars(F.left(degree, at - 1), " ,;-")).otherwise(degree)
    return F.struct(
        null_if_empty(cut).alias("highest_degree"),
        info["field"].alias("degree_field"),
        F.when(info["degree"].isNull(), info["institution"])
        .otherwise(null_if_empty(place))
        .alias("institution"),
        info["year"].alias("graduation_year"),
        info["rank"].alias("degree_rank"),
    )


def education_of(text: Column) -> Column:
    """Education struct of a section or document text; every line is read."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda l: F.length(l) > 0)
    return let(_education(lines), _tidy)


def extract_education(docs: DataFrame) -> DataFrame:
    """Add degree, field, institution, year and rank; the whole text when no section exists."""
    section = d.section_text("education")
    source = F.when(F.length(strip(section)) > 0, section).otherwise(d.clean_text())
    return docs.withColumn("_edu", education_of(source)).select("*", "_edu.*").drop("_edu")


# -- skills -------------------------------------------------------------------
def parse_skill_entry(entry: Column) -> Column:
    """``name, years`` of a list entry such as "Python (3 years)"."""
    text = strip_chars(entry, " -*•\t[]()")
    bare = strip_chars(F.regexp_replace(text, lx.SKILL_YEARS, ""), " -,()")
    name = F.when(text.rlike(lx.SKILL_YEARS), bare).otherwise(text)
    return F.struct(
        strip_chars(F.regexp_replace(name, lx.PROFICIENCY_NOTE, ""), " -,()").alias("name"),
        group(text, lx.SKILL_YEARS, 1).try_cast("double").alias("years"),
    )


def is_skill_entry(name: Column, max_chars: int | None = None) -> Column:
    count = F.size(words(name))
    normalized = normalize_text(name)
    return (
        (F.length(name) > 0 if max_chars is None else F.length(name).between(1, max_chars))
        & (count <= 5)
        & ~(name.rlike(r"[.!?]$") & (count > 2))
        & (F.length(normalized) >= 2)
        & ~(normalized.rlike(lx.SKILL_STOPWORDS) & (count > 3))
    )


def _list_entries(text: Column) -> Column:
    """Entries of a list section: lines, bar-separated chunks without label, separators."""
    lines = F.filter(
        F.transform(F.split(text, "\n"), strip),
        lambda l: F.length(l) > 0,
    )
    chunks = F.flatten(F.transform(lines, lambda l: F.split(l, lx.CHUNK_SPLIT)))

    def unlabelled(chunk: Column) -> Column:
        rest = F.when(
            F.contains(chunk, F.lit(":")),
            F.substring(chunk, F.position(F.lit(":"), chunk) + 1, F.length(chunk)),
        )
        return F.when(F.length(strip(rest)) > 0, rest).otherwise(chunk)

    return F.transform(
        F.flatten(F.transform(chunks, lambda c: F.split(unlabelled(c), lx.SKILL_SPLIT))),
        parse_skill_entry,
    )


def explicit_skills(docs: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Observations from the skills section."""
    entries = F.filter(_list_entries(d.section_text("skills")), lambda e: is_skill_entry(e["name"]))
    listed = each_with_position(docs, [key], entries, "position", "e").select(
        key, "position", F.col("e.name").alias("entry"), F.col("e.years").alias("years_experience")
    )
    return resolve_terms(listed, "entry", aliases).select(
        key, "normalized_name", "display_name", "category",
        F.lit(lx.EXPLICIT_CONFIDENCE).alias("confidence"), "years_experience",
        F.lit(False).alias("is_certified"), F.array("entry").alias("evidence"),
        F.lit("explicit").alias("source"), F.col("position").alias("seen_at"),
    )


def implicit_skills(docs: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Observations from catalogue mentions on every line."""
    lines = d.doc_lines(docs, key).where(F.length("line") > 0)
    hits = find_skill_mentions(lines, [key, "line_no"], "line", aliases)
    names = aliases.groupBy("normalized_name").agg(
        F.min(F.struct("name", "category")).alias("_c")
    )
    return (
        hits.join(lines, [key, "line_no"]).join(names, "normalized_name")
        .select(
            key, "normalized_name", F.col("_c.name").alias("display_name"),
            F.col("_c.category").alias("category"),
            F.when(
                F.contains(F.col("surface"), F.lit(" ")), lx.PHRASE_CONFIDENCE
            ).otherwise(lx.WORD_CONFIDENCE).alias("confidence"),
            group(F.col("line"), lx.SKILL_YEARS, 1).try_cast("double").alias("years_experience"),
            F.lit(False).alias("is_certified"),
            F.array(
                snippet(F.col("line"), F.col("start"), F.col("end"), padding=40, limit=0)
            ).alias("evidence"),
            F.lit("implicit").alias("source"),
            (F.lit(1_000_000) + F.col("line_no") * 1000 + F.col("start")).alias("seen_at"),
        )
    )


def merge_skill_observations(
    observations: DataFrame, keys: list[str], max_evidence: int | None = None
) -> DataFrame:
    """One row per key and skill: strongest confidence, all mentions, most years, any certificate.

    Evidence keeps each distinct text once, at its first place, before it is gathered; with
    ``max_evidence`` only so many rows per skill leave the group-limited window.
    """
    order = [*keys, "normalized_name"]
    texts = observations.select(*order, "seen_at", F.explode("evidence").alias("_text")).groupBy(
        *order, "_text"
    ).agg(F.min("seen_at").alias("_at"))
    if max_evidence is not None:
        nearest = Window.partitionBy(*order).orderBy("_at", "_text")
        texts = texts.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= max_evidence)
    gathered = texts.groupBy(*order).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda e: e["_text"]
        ).alias("evidence")
    )
    first = F.struct("seen_at", "display_name", "category")
    return (
        observations.groupBy(*keys, "normalized_name")
        .agg(
            F.min(first).alias("_first"),
            F.max("confidence").alias("confidence"),
            F.count(F.lit(1)).alias("mention_count"),
            F.max(F.when(F.col("years_experience") > 0, F.col("years_experience"))).alias(
                "years_experience"
            ),
            F.bool_or("is_certified").alias("is_certified"),
            F.min("source").alias("source"),
        )
        .join(gathered, order, "left")
        .withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
        .select(
            *keys, "normalized_name", "_first.display_name", "_first.category", "confidence",
            "mention_count", "years_experience", "is_certified", "evidence", "source",
        )
    )


def extract_skills(docs: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Skills of each document from both channels, noise words dropped."""
    observations = explicit_skills(docs, key, aliases).unionByName(
        implicit_skills(docs, key, aliases)
    )
    return merge_skill_observations(observations, [key]).where(
        ~normalize_text("display_name").rlike(lx.NOISE_SKILL) & (F.length("normalized_name") > 1)
    )


def merge_declared(parsed: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Union of two skill sets, the higher confidence per skill; parsed wins a tie."""
    both = parsed.withColumn("_o", F.lit(1)).unionByName(
        declared.withColumn("_o", F.lit(0)), allowMissingColumns=True
    )
    rest = [c for c in both.columns if c not in (key, "normalized_name", "_o")]
    return (
        both.groupBy(key, "normalized_name")
        .agg(F.max_by(F.struct(*rest), F.struct("confidence", "_o")).alias("s"))
        .select(key, "normalized_name", "s.*")
    )


def attach_skills(
    skills: DataFrame, certifications: DataFrame, key: str, max_skills: int | None = None
) -> DataFrame:
    """Stored skill rows: clamped confidence, certified when a certificate names the skill."""
    held = certifications.select(
        key, F.transform("certifications", lambda c: F.lower(F.trim(c))).alias("_certs")
    )
    shown = F.lower("display_name")
    named = F.exists(
        F.coalesce("_certs", F.array().cast("array<string>")),
        lambda t: F.contains(shown, t) | F.contains(t, shown),
    )
    out = skills.join(held, key, "left").select(
        key, "normalized_name",
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence")), 4).alias("confidence"),
        "years_experience", (F.col("is_certified") | named).alias("is_certified"),
        "evidence",
    )
    if max_skills is None:
        return out
    order = Window.partitionBy(key).orderBy(F.col("confidence").desc(), "normalized_name")
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_skills).drop("_n")


# -- certifications -----------------------------------------------------------
def _pattern_names(text: Column) -> Column:
    found = F.flatten(
        F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in lx.CERTIFICATION_PATTERNS])
    )
    tidy = F.transform(found, lambda c: strip_chars(c, " ,;|-•"))
    return F.filter(tidy, lambda c: F.length(c) >= 4)


def most_specific(names: Column) -> Column:
    """Longest names first; a name contained in a kept one, or containing it, is dropped."""
    kind = "array<struct<name:string,key:string>>"
    ordered = F.transform(
        F.array_sort(
            F.transform(
                names,
                lambda n: F.struct((-F.length(n)).alias("l"), F.lower(n).alias("c"), n.alias("n")),
            )
        ),
        lambda e: F.struct(e["n"].alias("name"), normalize_text(e["n"]).alias("key")),
    ).cast(kind)

    def add(kept: Column, e: Column) -> Column:
        clash = F.exists(
            kept,
            lambda k: (k["key"] != e["key"])
            & (F.contains(k["key"], e["key"]) | F.contains(e["key"], k["key"])),
        )
        return F.when(clash, kept).otherwise(F.array_append(kept, e))

    kept = F.aggregate(ordered, F.array().cast(kind), add)
    return F.transform(kept, lambda k: k["name"])


def certification_names(
    docs: DataFrame, key: str, aliases: DataFrame, lines: str, section: Column
) -> DataFrame:
    """``key, certifications``: patterns, section entries and catalogue mentions, most specific kept."""
    whole = F.when(F.length(strip(section)) > 0, section).otherwise(F.array_join(lines, "\n"))
    marked = F.filter(lines, d.is_certification_line)
    patterns = F.concat(
        _pattern_names(whole), F.flatten(F.transform(marked, _pattern_names))
    )
    entries = F.filter(
        F.transform(_list_entries(section), lambda e: e["name"]),
        lambda n: F.length(n) > 0,
    )
    by_pattern = each_with_position(docs, [key], patterns, "o", "name").select(
        key, F.lit(0).alias("channel"), "o", "name"
    )
    listed = resolve_terms(
        each_with_position(docs, [key], entries, "o", "name"), "name", aliases
    )
    by_entry = listed.where(
        contains_any(normalize_text("name"), lx.CERTIFICATION_MARKERS)
        | (F.col("category") == "certification")
    ).select(key, F.lit(1).alias("channel"), "o", "name")
    wanted = aliases.where("category = 'certification'")
    mentions = find_skill_mentions(
        each_with_position(docs, [key], F.col(lines), "line_no", "line"),
        [key, "line_no"], "line", aliases,
    ).join(wanted.select("normalized_name", "name").distinct(), "normalized_name")
    by_mention = mentions.select(
        key, F.lit(2).alias("channel"), (F.col("line_no") * 1000 + F.col("start")).alias("o"), "name"
    )
    first = (
        by_pattern.unionByName(by_entry).unionByName(by_mention)
        .groupBy(key, slugify_unknown("name").alias("slug"))
        .agg(F.min(F.struct("channel", "o", "name")).alias("f"))
    )
    return first.groupBy(key).agg(
        most_specific(F.collect_list("f.name")).alias("certifications")
    )


def extract_certifications(docs: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    return certification_names(docs, key, aliases, "lines", d.section_text("certifications"))


# -- profiles -----------------------------------------------------------------
PROFILE_COLUMNS = (
    "full_name", "email", "phone", "location", "linkedin_url", "github_url", "portfolio_url",
    "current_title", "total_experience_years", "relevant_experience_years", "highest_degree",
    "degree_field", "institution", "graduation_year", "previous_positions", "employment_history",
)


def build_candidate_profiles(
    docs: DataFrame, key: str, aliases: DataFrame, as_of: Column
) -> tuple[DataFrame, DataFrame]:
    """Candidate rows and their skill rows out of raw documents ``key, text``."""
    parsed = with_dates(d.sectionise(d.clean_lines(docs.select(key, "text"))), as_of)
    parsed = extract_education(extract_contacts(parsed))
    parsed = experience_years(employment_history(parsed))
    # Read by the skill, certificate and profile branches: parsed once, written once.
    parsed = written(docs.sparkSession, parsed.drop("text", "dated"), "parsed-documents")
    skills = extract_skills(parsed, key, aliases)
    certificates = extract_certifications(parsed, key, aliases)
    counted = skills.groupBy(key).agg(F.count(F.lit(1)).alias("_skills"))
    joined = parsed.join(certificates, key, "left").join(counted, key, "left")
    title = F.coalesce(
        "current_title", F.get("employment_history", F.lit(0))["title"]
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("full_name").isNull(), lx.WARN_NAME),
            F.when(F.col("email").isNull(), lx.WARN_EMAIL),
            F.when(F.size("sections") == 0, lx.WARN_SECTIONS),
            F.when(F.coalesce("_skills", F.lit(0)) == 0, lx.WARN_SKILLS),
            F.when(F.col("total_experience_years") == 0, lx.WARN_DATES),
        )
    )
    profiles = joined.select(
        key,
        *[title.alias(c) if c == "current_title" else F.col(c) for c in PROFILE_COLUMNS],
        F.coalesce("certifications", F.array().cast("array<string>")).alias("certifications"),
        F.col("sections").alias("section_spans"),
        d.section_map().alias("sections"),
        d.clean_text().alias("raw_text"),
        F.lit("parsed").alias("status"),
        warnings.alias("warnings"),
    )
    return profiles, attach_skills(skills, certificates, key)


def candidate_embedding_text(sections: Column, title: Column, raw_text: Column) -> Column:
    """Professional sections under the title; the raw text when nothing was recognised."""
    parts = F.filter(
        F.transform(
            literal_array(lx.PROFILE_SECTIONS), lambda k: F.try_element_at(sections, k)
        ),
        lambda t: F.coalesce(F.length(t), F.lit(0)) > 0,
    )
    headed = F.concat(F.array_compact(F.array(null_if_empty(title))), parts)
    return F.when(F.size(parts) > 0, strip(F.array_join(headed, "\n"))).otherwise(
        F.coalesce(raw_text, F.lit(""))
    )
