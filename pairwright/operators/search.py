"""Filters and projections over candidates, jobs, skills, matches and audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicon as lx
from ..functions.columns import any_of
from ..functions.text import normalize_text
from ..plans.containment import containing
from ..plans.prefix import top_per_group
from .catalogue import category_or_other, resolve_terms


def _like(c: Column | str, text: str) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.contains(F.lower(column), F.lit(text.strip().lower())), F.lit(False))


def _given(text: str | None) -> bool:
    return bool(text and text.strip())


def search_candidates(
    candidates: DataFrame,
    search: str | None = None,
    location: str | None = None,
    current_title: str | None = None,
    min_experience: float | None = None,
    max_experience: float | None = None,
    education: str | None = None,
    certification: str | None = None,
    shortlisted_only: bool = False,
    skills: Sequence[str] | None = None,
    candidate_skills: DataFrame | None = None,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Live candidates that pass every given filter; ``skills`` asks for all of them."""
    out = candidates.where(~F.col("is_deleted"))
    if _given(search):
        fields = ("full_name", "email", "current_title", "location")
        out = out.where(any_of(fields, lambda f: _like(f, search)))
    for column, text in (
        ("location", location), ("current_title", current_title), ("highest_degree", education),
    ):
        if _given(text):
            out = out.where(_like(column, text))
    if min_experience is not None:
        out = out.where(F.col("total_experience_years") >= min_experience)
    if max_experience is not None:
        out = out.where(F.col("total_experience_years") <= max_experience)
    if shortlisted_only:
        out = out.where("shortlisted")
    if _given(certification):
        out = out.where(F.exists("certifications", lambda c: _like(c, certification)))
    if skills:
        out = out.join(has_all_skills(candidate_skills, skills, aliases), "candidate_id", "left_semi")
    return out


def has_all_skills(
    candidate_skills: DataFrame, skills: Sequence[str], aliases: DataFrame | None = None
) -> DataFrame:
    """Candidates that hold every listed skill; aliases, when given, are resolved first."""
    wanted = sorted({s.strip().lower() for s in skills if s and s.strip()})
    if aliases is None:
        held = candidate_skills.where(F.col("normalized_name").isin(wanted))
        needed = F.lit(len(wanted))
    else:
        spark = candidate_skills.sparkSession
        terms = spark.createDataFrame([(s,) for s in wanted], "term string")
        names = resolve_terms(terms, "term", aliases).select("normalized_name").distinct()
        held = candidate_skills.join(names, "normalized_name", "left_semi")
        needed = names.agg(F.count(F.lit(1))).scalar()
    return (
        held.select("candidate_id", "normalized_name")
        .distinct()
        .groupBy("candidate_id")
        .agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") == needed)
        .select("candidate_id")
    )


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def oldest(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def list_jobs(
    jobs: DataFrame, search: str | None = None, is_active: bool | None = True,
    created_by: int | None = None,
) -> DataFrame:
    """Job rows, newest first."""
    out = jobs
    if is_active is not None:
        out = out.where(F.col("is_active") == is_active)
    if created_by is not None:
        out = out.where(F.col("created_by") == created_by)
    if _given(search):
        out = out.where(_like("title", search) | _like("department", search))
    return out.orderBy(F.col("created_at").desc(), F.col("job_id").desc())


def list_skills(
    skills: DataFrame, search: str | None = None, category: str | None = None, limit: int | None = 100
) -> DataFrame:
    """Skills by name; ``limit`` is the page asked for, ``None`` lists all."""
    out = skills
    if category:
        known = category if category in lx.SKILL_CATEGORIES else "other"
        out = out.where(category_or_other(F.col("category")) == known)
    if search:
        needle = normalize_text(F.lit(search))
        out = out.where(
            F.contains(F.lower("name"), needle) | F.contains(F.lower("normalized_name"), needle)
        )
    out = out.orderBy("name")
    return out if limit is None else out.limit(limit)


def audit_log(
    logs: DataFrame, user_id: int | None = None, action: str | None = None, limit: int | None = 100
) -> DataFrame:
    """Newest audit rows; ``limit`` is the page asked for, ``None`` lists all."""
    out = logs
    if user_id is not None:
        out = out.where(F.col("user_id") == user_id)
    if action:
        out = out.where(F.col("action") == action)
    out = out.orderBy(F.col("created_at").desc(), F.col("audit_id").desc())
    return out if limit is None else out.limit(limit)


def candidate_summary(
    candidates: DataFrame, candidate_skills: DataFrame, skills: DataFrame, top: int = 8
) -> DataFrame:
    """Summary columns with the ``top`` strongest skill names; only those rows are collected."""
    named = candidate_skills.select("candidate_id", "normalized_name", "confidence").join(
        skills.select("normalized_name", "name"), "normalized_name"
    )
    best = top_per_group(
        named, ["candidate_id"], [F.col("confidence").desc(), F.col("name").asc()], top
    )
    names = best.groupBy("candidate_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]
        ).alias("top_skills")
    )
    return candidates.where(~F.col("is_deleted")).select(
        "candidate_id", "full_name", "email", "location", "current_title",
        "total_experience_years", "highest_degree", "shortlisted", "status", "created_at",
    ).join(names, "candidate_id", "left").withColumn(
        "top_skills", F.coalesce("top_skills", F.array().cast("array<string>"))
    )


def full_profiles(candidates: DataFrame, candidate_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """Candidates with their skills nested, one entry per catalogue skill."""
    linked = candidate_skills.join(
        skills.select("normalized_name", "name", "category"), "normalized_name"
    )
    nested = linked.groupBy("candidate_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "normalized_name", "name", "category", "confidence", "years_experience",
                    "is_certified", "evidence",
                )
            )
        ).alias("skills")
    )
    return candidates.join(nested, "candidate_id", "left")


def job_requirements(jobs: DataFrame) -> DataFrame:
    """One row per job and requirement term, in list order."""
    def listed(column: str, importance: str) -> DataFrame:
        return jobs.select(
            "job_id", F.lit(importance).alias("importance"), F.posexplode(column)
        ).select(
            "job_id", "importance", (F.col("pos") + 1).alias("position"), F.col("col").alias("term")
        )

    return (
        listed("required_skills", "required")
        .unionByName(listed("preferred_skills", "preferred"))
        .unionByName(listed("certifications", "certification"))
    )


def match_detail(matches: DataFrame, evidence: DataFrame, job_id: int, candidate_id: int) -> DataFrame:
    """One stored match with its evidence rows nested."""
    key = (F.col("job_id") == job_id) & (F.col("candidate_id") == candidate_id)
    rows = evidence.where(key).groupBy("job_id", "candidate_id").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.array_sort(
            F.collect_list(
                F.struct("position", "component", "label", "detail", "status", "weight", "snippet")
            )
        ).alias("evidence"),
    )
    return matches.where(key).join(rows, ["job_id", "candidate_id"], "left")


def match_details(matches: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every stored match with the number of evidence rows per status."""
    rows = evidence.groupBy("job_id", "candidate_id").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_rows") for s in ("matched", "weak", "missing")],
    )
    return matches.join(rows, ["job_id", "candidate_id"], "left")


def section_readout(sections: DataFrame, candidate_ids: DataFrame) -> DataFrame:
    return with_ids(sections, candidate_ids, "candidate_id")


def find_by_name(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """First live candidate (lowest id) whose full name contains each asked name."""
    live = candidates.where(~F.col("is_deleted")).select(
        "candidate_id", "full_name", F.lower("full_name").alias("_name")
    )
    asked = (
        names.select("name").distinct()
        .withColumn("_needle", F.lower(F.trim("name")))
        .where(F.length("_needle") > 0)
    )
    hits = containing(live, ["candidate_id", "full_name"], "_name", asked, "_needle")
    first = hits.groupBy("name").agg(F.min(F.struct("candidate_id", "full_name")).alias("c"))
    return first.select("name", "c.candidate_id", "c.full_name")


def resolve_job(questions: DataFrame, jobs: DataFrame) -> DataFrame:
    """The job each question means: an explicit id that exists, the only active job, or a title it names.

    A title counts as named when it, or its first word, is contained in the
    question; the lowest job id wins.  The first word is the weaker condition,
    so it alone decides.
    """
    active = jobs.where("is_active").select(
        "job_id", F.lower(F.coalesce("title", F.lit(""))).alias("t")
    )
    heads = (
        active.where(F.length("t") > 0)
        .groupBy(F.get(F.split("t", r"\s+"), F.lit(0)).alias("_head"))
        .agg(F.min("job_id").alias("_named"))
    )
    only = active.agg(F.when(F.count(F.lit(1)) == 1, F.max("job_id"))).scalar()
    lowered = questions.select("question_id", F.lower("text").alias("_text"))
    named = (
        containing(lowered, ["question_id"], "_text", heads, "_head")
        .groupBy("question_id")
        .agg(F.min("_named").alias("_named"))
    )
    return (
        questions.join(named, "question_id", "left")
        .withColumn("_only", only)
        .join(jobs.select(F.col("job_id").alias("_known")).distinct(), F.col("job_id") == F.col("_known"), "left")
        .withColumn(
            "resolved_job_id",
            F.when(F.col("job_id").isNotNull(), F.col("_known")).otherwise(F.coalesce("_only", "_named")),
        )
        .drop("_only", "_named", "_known")
    )


def latest_rows(df: DataFrame, keys: Sequence[str], created: str, tie: str, n: int) -> DataFrame:
    return top_per_group(df, list(keys), [F.col(created).desc(), F.col(tie).asc()], n)


def first_seen(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
