"""Structured requirements out of job descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions import education
from ..functions.columns import (
    contains_any, distinct_by, each, each_with_position, first_where, group, let, null_if_empty, rstrip, strip,
    strip_chars, words,
)
from ..functions.scores import number_text
from ..functions.text import normalize_text, strip_bullets, truncate
from ..session import written
from . import documents as d
from .catalogue import find_skill_mentions
from .extract import certification_names

BUCKETS = tuple(key for key, _ in lx.JOB_HEADINGS)
BLOCK_TYPE = "array<struct<i:int,bucket:string,text:string>>"


def job_heading(line: Column) -> Column:
    """Requirement bucket a heading line opens, NULL for list items and sentences."""
    label_text = strip(F.regexp_replace(strip_bullets(line), r"^\s*\d+[.)]\s*", ""))

    def decide(text: Column) -> Column:
        label = strip(rstrip(text, ":"))
        count = F.size(words(label))
        shaped = (
            F.length(text).between(1, 70)
            & ~text.rlike(r"[()]")
            & ~text.rlike(r"[.;]$")
            & (F.length(label) > 0)
            & (count <= 5)
        )

        def bucket(key: Column) -> Column:
            out = None
            for name, keywords in lx.JOB_HEADINGS:
                tokens = sorted({_plain(k) for k in keywords}, key=lambda t: (len(t.split()), t))
                test = key.rlike("^(?:" + "|".join(tokens) + ")(?: |$)")
                for n in sorted({len(t.split()) for t in tokens}):
                    same = "|".join(t for t in tokens if len(t.split()) == n)
                    test = test | (key.rlike(f" (?:{same})$") & (count - n <= 2))
                out = F.when(test, name) if out is None else out.when(test, name)
            return out

        return F.when(shaped, let(normalize_text(label), bucket))

    return let(label_text, decide)


def _plain(keyword: str) -> str:
    return keyword.replace("-", " ").replace("'", " ")


def _blocks(lines: Column) -> Column:
    """Each body line with the bucket of the last heading; text after a heading's colon counts."""
    marks = F.transform(
        lines, lambda l, i: F.struct(i.alias("i"), job_heading(l).alias("key"), l.alias("line"))
    )

    def build(rows: Column) -> Column:
        headings = F.filter(rows, lambda r: r["key"].isNotNull())

        def fill(found: Column) -> Column:
            def bucket_of(i: Column) -> Column:
                before = F.filter(found, lambda h: h["i"] < i)
                return F.coalesce(
                    F.get(before, F.size(before) - 1)["key"], F.lit("other")
                )

            def one(r: Column) -> Column:
                after = strip(
                    F.when(
                        F.contains(r["line"], F.lit(":")),
                        F.substring(
                            r["line"], F.position(F.lit(":"), r["line"]) + 1, F.length(r["line"])
                        ),
                    )
                )
                return F.struct(
                    r["i"].alias("i"),
                    F.when(r["key"].isNotNull(), r["key"]).otherwise(bucket_of(r["i"])).alias("bucket"),
                    F.when(r["key"].isNotNull(), after).otherwise(r["line"]).alias("text"),
                )

            return F.filter(
                F.transform(rows, one), lambda e: F.coalesce(F.length(strip(e["text"])), F.lit(0)) > 0
            )

        return let(headings, fill)

    return let(marks, build).cast(BLOCK_TYPE)


def block_lines(blocks: Column, *names: str) -> Column:
    return F.transform(
        F.filter(blocks, lambda b: b["bucket"].isin(*names)), lambda b: b["text"]
    )


def is_skill_term(term: Column) -> Column:
    return (
        (F.length(term) > 0)
        & ~term.rlike(lx.EXPERIENCE_BULLET)
        & ~term.rlike(lx.NOT_A_SKILL)
    )


def _chunks(line: Column) -> Column:
    """Candidate terms of a requirement line."""
    def tidy(chunk: Column) -> Column:
        text = F.regexp_replace(strip_bullets(chunk), r"^\s*\d+[.)]\s*", "")
        return strip_chars(F.regexp_replace(text, lx.TRAILING_QUALIFIER, ""), " ,;•")

    return F.filter(
        F.transform(F.split(strip(line), lx.JOB_SPLIT), tidy), lambda t: F.length(t) > 0
    )


def requirement_terms(jobs: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """``key, importance, position, term``: catalogue skills first, then unknown terms, per line.

    A line that names known skills yields those; a chunk without a known skill
    stays verbatim.  Required-block lines marked as nice to have also count as
    preferred.
    """
    text = normalize_text("b.text")
    nice = contains_any(text, lx.PREFERRED_MARKERS) & ~contains_any(text, lx.REQUIRED_MARKERS)
    required = F.col("b.bucket") == "required_skills"
    lines = (
        each(jobs, [key], F.col("blocks"), "b")
        .where("b.bucket IN ('required_skills', 'preferred_skills')")
        .select(
            key, F.col("b.i").alias("line_no"), F.col("b.text").alias("line"),
            F.array_compact(
                F.array(
                    F.when(required, F.struct(F.lit("required").alias("n"), F.lit(0).alias("late"))),
                    F.when(~required, F.struct(F.lit("preferred").alias("n"), F.lit(0).alias("late"))),
                    F.when(
                        required & nice,
                        F.struct(F.lit("preferred").alias("n"), F.lit(1).alias("late")),
                    ),
                )
            ).alias("uses"),
        )
    )
    units = each_with_position(
        lines, [key, "line_no"], F.concat(F.array("line"), _chunks(F.col("line"))), "unit", "text"
    )
    mentions = find_skill_mentions(units, [key, "line_no", "unit"], "text", aliases)
    names = aliases.groupBy("normalized_name").agg(F.min("name").alias("term"))
    known = mentions.where("unit = 0").join(names, "normalized_name").select(
        key, "line_no", F.lit(0).alias("unknown"), F.col("start").alias("o"), "term"
    )
    unknown = (
        units.where("unit > 0")
        .where(is_skill_term(F.col("text")) & (F.length(normalize_text("text")) > 1))
        .join(
            mentions.where("unit > 0").select(key, "line_no", "unit").distinct(),
            [key, "line_no", "unit"], "left_anti",
        )
        .select(key, "line_no", F.lit(1).alias("unknown"), F.col("unit").alias("o"), F.col("text").alias("term"))
    )
    used = known.unionByName(unknown).join(
        lines.select(key, "line_no", F.explode("uses").alias("u")), [key, "line_no"]
    )
    first = used.groupBy(key, F.col("u.n").alias("importance"), normalize_text("term").alias("_t")).agg(
        F.min(F.struct("u.late", "line_no", "unknown", "o", "term")).alias("f")
    )
    return first.select(
        key, "importance", F.struct("f.late", "f.line_no", "f.unknown", "f.o").alias("position"),
        F.col("f.term").alias("term"),
    )


def _term_list(terms: DataFrame, key: str, importance: str, limit: int | None) -> DataFrame:
    items = F.transform(
        F.array_sort(F.collect_list(F.struct("position", "term"))), lambda e: e["term"]
    )
    if limit is not None:
        items = F.slice(items, 1, limit)
    return terms.where(F.col("importance") == importance).groupBy(key).agg(
        items.alias(f"{importance}_skills")
    )


def experience_required(text: Column) -> Column:
    """Largest stated number of years between half a year and thirty."""
    single = F.flatten(
        F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in lx.EXPERIENCE_YEARS])
    )
    plain = F.filter(
        F.transform(single, lambda v: v.try_cast("double")), lambda v: v.between(0.5, 30)
    )
    spans = F.transform(
        F.regexp_extract_all(text, F.lit(lx.EXPERIENCE_SPAN), F.lit(1)), lambda v: v.try_cast("double")
    )
    return F.round(F.coalesce(F.array_max(F.concat(plain, spans)), F.lit(0.0)), 1)


def education_required(lines: Column) -> Column:
    """The highest qualification phrase on a line that talks about education."""
    def phrase(line: Column) -> Column:
        found = F.regexp_extract(line, lx.EDUCATION_PHRASE, 0)
        rank = education.degree_rank(found)
        return F.when(
            contains_any(normalize_text(line), lx.EDUCATION_WORDS) & (rank > 0),
            F.struct((-rank).alias("r"), strip(found).alias("text")),
        )

    ranked = F.filter(
        F.transform(lines, lambda l, i: let(phrase(l), lambda p: F.struct(
            p["r"].alias("r"), i.alias("i"), p["text"].alias("text")))),
        lambda e: e["text"].isNotNull(),
    )
    return F.get(F.array_sort(ranked), F.lit(0))["text"]


def job_title(lines: Column) -> Column:
    def title(line: Column) -> Column:
        key = normalize_text(line)
        cleaned = strip_chars(F.regexp_replace(line, lx.JOB_TITLE_SUFFIX, ""), " -–—:|")
        suffixed = key.rlike("(?:" + "|".join(lx.JOB_TITLE_SUFFIXES) + ")$") & (F.length(cleaned) > 0)
        return F.when(
            F.length(line).between(1, 120),
            F.when(suffixed, cleaned).when(contains_any(key, lx.JOB_TITLE_HINTS), line),
        )

    return first_where(
        F.transform(lines, lambda l: let(strip(l), title)), lambda t: t.isNotNull()
    )


def _labelled(lines: Column, pattern: str) -> Column:
    return first_where(
        F.transform(lines, lambda l: strip(group(strip(l), pattern, 1))),
        lambda v: v.isNotNull(),
    )


def job_location(lines: Column) -> Column:
    labelled = first_where(
        F.transform(lines, lambda l: strip(group(strip(l), lx.LOCATION_LABEL, 1))),
        lambda v: v.isNotNull() & (F.length(v) > 1),
    )
    hinted = first_where(
        lines,
        lambda l: contains_any(normalize_text(l), lx.LOCATION_HINTS) & F.contains(l, F.lit(",")),
    )
    return F.coalesce(labelled, strip(hinted))


def employment_type(lines: Column) -> Column:
    def kind(line: Column) -> Column:
        key = normalize_text(line)
        return F.coalesce(
            *[F.when(F.contains(key, F.lit(t)), t.title()) for t in lx.EMPLOYMENT_TYPES]
        )

    return first_where(F.transform(lines, kind), lambda t: t.isNotNull())


def free_terms(lines: Column) -> Column:
    """Distinct candidate terms of a block."""
    kept = F.filter(
        F.flatten(F.transform(lines, _chunks)),
        lambda t: (F.length(normalize_text(t)) >= 2) & is_skill_term(t),
    )
    return distinct_by(kept, normalize_text)


def parse_job_descriptions(
    docs: DataFrame, key: str, aliases: DataFrame, limits: dict[str, int] | None = None
) -> DataFrame:
    """One structured row per job text; list lengths are only cut where ``limits`` says so."""
    limits = limits or {}
    jobs = d.clean_lines(docs.select(key, "text")).withColumn("blocks", _blocks(F.col("lines")))
    # Read by the term, mention, certificate and profile branches.
    jobs = written(docs.sparkSession, jobs.drop("text"), "job-blocks")
    blocks = F.col("blocks")
    terms = requirement_terms(jobs, key, aliases)
    lists = _term_list(terms, key, "required", limits.get("required_skills"))
    nice = _term_list(terms, key, "preferred", limits.get("preferred_skills"))
    anywhere = _mentioned_anywhere(jobs, key, aliases)
    certificates = certification_names(
        jobs, key, aliases, "lines", F.array_join(block_lines(blocks, "certifications"), "\n")
    )
    other = block_lines(blocks, "other")
    stated = F.concat(
        block_lines(blocks, "required_skills"), block_lines(blocks, "preferred_skills"),
        other,
    )
    duties = F.transform(
        block_lines(blocks, "responsibilities"), strip_bullets
    )
    soft = free_terms(block_lines(blocks, "soft_skills"))
    none = F.array().cast("array<string>")

    def cut(c: Column, name: str) -> Column:
        return F.slice(c, 1, limits[name]) if name in limits else c

    return (
        jobs.join(lists, key, "left").join(nice, key, "left").join(anywhere, key, "left")
        .join(certificates, key, "left")
        .select(
            key,
            job_title(F.col("lines")).alias("title"),
            _labelled(F.col("lines"), lx.DEPARTMENT_LABEL).alias("department"),
            job_location(F.col("lines")).alias("location"),
            employment_type(F.col("lines")).alias("employment_type"),
            experience_required(F.array_join(stated, "\n")).alias("experience_required_years"),
            education_required(stated).alias("education_required"),
            F.coalesce("required_skills", "_anywhere", none).alias("required_skills"),
            F.coalesce("preferred_skills", none).alias("preferred_skills"),
            cut(F.coalesce("certifications", none), "certifications").alias("certifications"),
            cut(duties, "responsibilities").alias("responsibilities"),
            cut(soft, "soft_skills").alias("soft_skills"),
            d.clean_text().alias("raw_text"),
        )
        .withColumn(
            "warnings",
            F.array_compact(
                F.array(
                    F.when(F.size("required_skills") == 0, lx.WARN_NO_REQUIRED),
                    F.when(F.col("experience_required_years") == 0, lx.WARN_NO_EXPERIENCE),
                )
            ),
        )
    )


def _mentioned_anywhere(jobs: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Catalogue skills named anywhere, for jobs whose headings name none."""
    names = aliases.groupBy("normalized_name").agg(F.min("name").alias("name"))
    hits = find_skill_mentions(
        d.doc_lines(jobs, key), [key, "line_no"], "line", aliases
    ).join(names, "normalized_name")
    first = hits.groupBy(key, "name").agg(F.min(F.struct("line_no", "start")).alias("at"))
    return first.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", "name"))), lambda e: e["name"]
        ).alias("_anywhere")
    )


def job_embedding_text() -> Column:
    """Labelled requirement text of a job row."""
    def listed(label: str, column: str) -> Column:
        return F.when(
            F.size(column) > 0, F.concat(F.lit(f"{label}: "), F.array_join(column, ", "))
        )

    years = F.col("experience_required_years")
    parts = F.array(
        F.col("title"), F.col("department"), F.col("description"),
        listed("Required", "required_skills"), listed("Preferred", "preferred_skills"),
        listed("Certifications", "certifications"), listed("Responsibilities", "responsibilities"),
        listed("Soft skills", "soft_skills"),
        F.when(
            years != 0, F.concat(F.lit("Requires "), number_text(years), F.lit(" years of experience."))
        ),
        F.when(
            null_if_empty(F.col("education_required")).isNotNull(),
            F.concat(F.lit("Requires "), F.col("education_required"), F.lit(".")),
        ),
    )
    return strip(F.array_join(F.filter(parts, lambda p: F.length(p) > 0), "\n"))
