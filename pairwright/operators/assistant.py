"""Answers to screening questions as tables, for a whole batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.questions import classify_intent, named_candidates, sort_hint
from ..functions.scores import number_text, percent_text
from ..plans.prefix import top_per_group
from .compare import latest_match
from .ranking import top_candidates
from .search import find_by_name, resolve_job

NO_JOB = (
    "I need a job to answer that. Open a job and ask again, or tell me which position you mean."
)


def read_questions(questions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add intent, sort field, named candidates and the job each question means."""
    asked = questions if "job_id" in questions.columns else questions.withColumn(
        "job_id", F.lit(None).cast("bigint")
    )
    resolved = resolve_job(asked, jobs)
    return resolved.withColumns(
        {
            "intent": classify_intent("text"),
            "sort_by": sort_hint("text"),
            "names": named_candidates("text"),
        }
    )


def _of(read: DataFrame, intent: str) -> DataFrame:
    return read.where(F.col("intent") == intent)


def top_answer(read: DataFrame, rankable: DataFrame, top_k: int = 10) -> DataFrame:
    """Best candidates of the job each ``top_candidates`` question means, in its sort order.

    The rankings of each sort field in use are cut to ``top_k`` per job before
    they meet the questions.
    """
    asked = _of(read, "top_candidates").where("resolved_job_id IS NOT NULL")
    out = None
    for field in ("overall", "required_skills", "experience", "education", "semantic", "certifications"):
        best = top_candidates(rankable, top_k, field).select(
            F.col("job_id").alias("resolved_job_id"), "rank", "candidate_id", "full_name",
            "overall_score", "required_skills_score", "experience_score",
            F.when(F.col("shortlisted"), "yes").otherwise("no").alias("shortlisted"),
        )
        part = asked.where(F.col("sort_by") == field).select("question_id", "resolved_job_id").join(
            best, "resolved_job_id"
        )
        out = part if out is None else out.unionByName(part)
    return out


def missing_answer(
    read: DataFrame, rankable: DataFrame, explanations: DataFrame, top_k: int = 10
) -> DataFrame:
    """Missing and weak terms of the best candidates by required skills."""
    asked = _of(read, "missing_skills").where("resolved_job_id IS NOT NULL")
    best = top_candidates(rankable, top_k, "required_skills").select(
        "job_id", "candidate_id", "full_name", "rank"
    ).join(explanations.select("job_id", "candidate_id", "explanation"), ["job_id", "candidate_id"])

    def joined(name: str) -> Column:
        text = F.array_join(F.col(f"explanation.{name}"), ", ")
        return F.when(F.length(text) > 0, text).otherwise("none")

    return asked.select("question_id", F.col("resolved_job_id").alias("job_id")).join(
        best, "job_id"
    ).select(
        "question_id", "job_id", "rank", "candidate_id", "full_name",
        joined("missing_required").alias("missing_required"),
        joined("weak_signals").alias("weak_signals"),
    )


def shortlist_answer(
    candidates: DataFrame, candidate_skills: DataFrame, skills: DataFrame, top_k: int = 10
) -> DataFrame:
    """Most recently updated shortlisted candidates with their strongest skills."""
    newest = (
        candidates.where(~F.col("is_deleted") & F.col("shortlisted"))
        .orderBy(F.col("updated_at").desc(), "candidate_id")
        .limit(top_k)
    )
    named = candidate_skills.join(newest.select("candidate_id"), "candidate_id", "left_semi").join(
        skills.select("normalized_name", "name"), "normalized_name"
    )
    best = top_per_group(
        named, ["candidate_id"], [F.col("confidence").desc(), F.col("name").asc()], 6
    ).groupBy("candidate_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"]
            ),
            ", ",
        ).alias("top_skills")
    )
    return newest.select(
        "candidate_id", "full_name", F.coalesce("current_title", F.lit("-")).alias("current_title"),
        "total_experience_years",
    ).join(best, "candidate_id", "left").withColumn(
        "top_skills", F.coalesce("top_skills", F.lit("-"))
    )


def compare_sets(read: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate set each ``compare`` question names, when both names are known."""
    asked = _of(read, "compare").select("question_id", F.explode("names").alias("name"))
    found = asked.join(find_by_name(candidates, asked.select("name")), "name").select(
        F.col("question_id").alias("set_id"), "candidate_id"
    ).distinct()
    both = found.groupBy("set_id").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    return found.join(both.select("set_id"), "set_id", "left_semi")


def candidate_answer(
    read: DataFrame, candidates: DataFrame, matches: DataFrame, candidate_skills: DataFrame
) -> DataFrame:
    """The profile line of the candidate each ``candidate_detail`` question names."""
    asked = _of(read, "candidate_detail").select(
        "question_id", F.get("names", F.lit(0)).alias("name")
    ).where("name IS NOT NULL")
    found = asked.join(find_by_name(candidates, asked.select("name")), "name").select(
        "question_id", "candidate_id"
    )
    counted = candidate_skills.join(
        found.select("candidate_id").distinct(), "candidate_id", "left_semi"
    ).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("skills"))
    latest = latest_match(
        matches.join(found.select("candidate_id").distinct(), "candidate_id", "left_semi")
    ).select("candidate_id", "overall_score")
    return (
        found.join(
            candidates.select(
                "candidate_id", "full_name", "current_title", "total_experience_years"
            ),
            "candidate_id",
        )
        .join(counted, "candidate_id", "left")
        .join(latest, "candidate_id", "left")
        .select(
            "question_id", "candidate_id",
            F.concat(
                "full_name", F.lit(": "),
                F.coalesce("current_title", F.lit("title not detected")), F.lit(", "),
                number_text(F.coalesce("total_experience_years", F.lit(0.0))),
                F.lit(" years total experience, "),
                F.coalesce("skills", F.lit(0)).cast("string"), F.lit(" skills on file."),
            ).alias("answer"),
            "overall_score",
        )
    )


def job_answer(read: DataFrame, jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """The requirement summary of the job each ``job_summary`` question means."""
    asked = _of(read, "job_summary").where("resolved_job_id IS NOT NULL").select(
        "question_id", F.col("resolved_job_id").alias("job_id")
    )
    scored = matches.groupBy("job_id").agg(F.count(F.lit(1)).alias("scored"))
    return (
        asked.join(jobs, "job_id").join(scored, "job_id", "left")
        .select(
            "question_id", "job_id", "title",
            F.coalesce("education_required", F.lit("not specified")).alias("education_required"),
            F.array_join("required_skills", ", ").alias("required_skills"),
            F.concat(
                "title", F.lit(" needs "),
                number_text(F.coalesce("experience_required_years", F.lit(0.0))),
                F.lit(" years of experience and "),
                F.size("required_skills").cast("string"), F.lit(" required skills. "),
                F.coalesce("scored", F.lit(0)).cast("string"),
                F.lit(" candidate(s) scored so far."),
            ).alias("answer"),
        )
    )


def answer_lines(read: DataFrame, jobs: DataFrame, rankable: DataFrame) -> DataFrame:
    """One text per question: the leader of its ranking, or why there is no answer."""
    leaders = top_candidates(rankable, 1).select(
        F.col("job_id").alias("resolved_job_id"), "full_name", "overall_score",
        "required_skills_score",
    )
    counted = rankable.groupBy(F.col("job_id").alias("resolved_job_id")).agg(
        F.count(F.lit(1)).alias("scored")
    )
    titles = jobs.select(F.col("job_id").alias("resolved_job_id"), "title")
    joined = (
        read.join(titles, "resolved_job_id", "left")
        .join(leaders, "resolved_job_id", "left")
        .join(counted, "resolved_job_id", "left")
    )
    needs_job = F.col("intent").isin("top_candidates", "missing_skills")
    none = F.concat(F.lit("No candidates have been scored against '"), "title", F.lit("' yet."))
    lead = F.concat(
        F.col("scored").cast("string"), F.lit(" candidates scored against '"), F.col("title"),
        F.lit("'. "), F.col("full_name"), F.lit(" leads at "), percent_text("overall_score"),
        F.lit(" overall, with "), percent_text("required_skills_score"),
        F.lit(" of the required skills matched. Scores rank resume evidence only."),
    )
    return joined.select(
        "question_id",
        F.coalesce("intent", F.lit("unknown")).alias("intent"),
        F.when(needs_job & F.col("resolved_job_id").isNull(), NO_JOB)
        .when(needs_job & F.col("full_name").isNull(), none)
        .when(F.col("intent") == "top_candidates", lead)
        .alias("answer"),
    )
