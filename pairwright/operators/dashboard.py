"""Dashboard panels: counts, averages, histograms, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import lexicon as lx
from ..functions.scores import score_bucket


def candidate_stats(candidates: DataFrame) -> DataFrame:
    live = ~F.col("is_deleted")
    return candidates.agg(
        F.count_if(live).alias("total_candidates"),
        F.count_if(live & (F.col("status") == "parsed")).alias("candidates_processed"),
        F.count_if(live & (F.col("status") == "failed")).alias("failed_processing"),
        F.count_if(live & F.col("shortlisted")).alias("shortlisted_candidates"),
    )


def dashboard_stats(
    candidates: DataFrame, jobs: DataFrame, skills: DataFrame, matches: DataFrame,
    job_id: int | None = None, live_only: bool = False,
) -> DataFrame:
    """The header row: one aggregate per table, put side by side as scalars.

    The average covers every stored match, also those of deleted candidates,
    unless ``live_only`` is set.
    """
    rows = matches if job_id is None else matches.where(F.col("job_id") == job_id)
    if live_only:
        rows = rows.join(
            candidates.where(~F.col("is_deleted")).select("candidate_id"), "candidate_id", "left_semi"
        )
    average = rows.agg(
        F.round(F.coalesce(F.avg("overall_score"), F.lit(0.0)), 4).alias("a")
    ).scalar()
    return candidate_stats(candidates).withColumns(
        {
            "active_jobs": jobs.agg(F.count_if("is_active")).scalar(),
            "total_skills": skills.agg(F.count(F.lit(1))).scalar(),
            "average_match_score": average,
        }
    )


def candidates_per_job(jobs: DataFrame, matches: DataFrame, limit: int = 20) -> DataFrame:
    """Active jobs with match count and mean score; matches are aggregated before the join."""
    per_job = matches.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.avg("overall_score").alias("average_score")
    )
    return (
        jobs.where("is_active").select("job_id", F.col("title").alias("job_title"))
        .join(per_job, "job_id", "left")
        .select(
            "job_id",
            "job_title",
            F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
            F.round(F.coalesce("average_score", F.lit(0.0)), 4).alias("average_score"),
        )
        .orderBy(F.col("candidate_count").desc(), "job_title", "job_id")
        .limit(limit)
    )


def score_distribution(matches: DataFrame, per_job: bool = False) -> DataFrame:
    """Zero-filled histogram over five fixed buckets, over all matches or per job."""
    keys = ["job_id"] if per_job else []
    buckets = [label for label, _, _ in lx.SCORE_BUCKETS]
    counts = matches.groupBy(*keys).agg(
        *[
            F.count_if(score_bucket("overall_score") == b).alias(b) for b in buckets
        ]
    )
    pairs = F.array(
        *[F.struct(F.lit(b).alias("bucket"), F.col(f"`{b}`").alias("count")) for b in buckets]
    )
    return counts.select(*keys, F.inline(pairs))


def top_skills(
    skills: DataFrame, candidate_skills: DataFrame, candidates: DataFrame, limit: int = 15
) -> DataFrame:
    """Skills by live holders, ties by name."""
    live = candidates.where(~F.col("is_deleted")).select("candidate_id")
    holders = (
        candidate_skills.select("candidate_id", "normalized_name")
        .join(live, "candidate_id", "left_semi")
        .groupBy("normalized_name")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return (
        skills.select("normalized_name", F.col("name").alias("skill"), "category")
        .join(holders, "normalized_name")
        .orderBy(F.col("count").desc(), "skill")
        .limit(limit)
    )


def most_missing_skills(
    scored: DataFrame, candidates: DataFrame, top_n: int | None = None, limit: int = 15,
    job_id: int | None = None,
) -> DataFrame:
    """Required terms the best-scored live candidates lack, counted per job and term.

    Every scored pair counts; a caller may ask for the best ``top_n`` only.
    """
    rows = scored if job_id is None else scored.where(F.col("job_id") == job_id)
    rows = rows.join(
        candidates.where(~F.col("is_deleted")).select("candidate_id"), "candidate_id", "left_semi"
    )
    missing = F.transform(
        F.filter("required_matches", lambda m: m["status"] == "missing"), lambda m: m["term"]
    )
    rows = rows.select("job_id", "candidate_id", "overall_score", missing.alias("missing"))
    if top_n is not None:
        rows = rows.orderBy(F.col("overall_score").desc(), "job_id", "candidate_id").limit(top_n)
    return (
        rows.select("job_id", F.explode("missing").alias("skill"))
        .groupBy("job_id", "skill")
        .agg(F.count(F.lit(1)).alias("missing_count"))
        .orderBy(F.col("missing_count").desc(), "job_id", "skill")
        .limit(limit)
    )


def recent_candidates(candidates: DataFrame, candidate_skills: DataFrame, limit: int = 10) -> DataFrame:
    """Newest live candidates with their skill count; counts are joined to the kept rows only."""
    newest = (
        candidates.where(~F.col("is_deleted"))
        .select(
            "candidate_id", "full_name", "current_title", "status", "total_experience_years",
            "shortlisted", "created_at",
        )
        .orderBy(F.col("created_at").desc(), F.col("candidate_id").asc())
        .limit(limit)
    )
    counts = (
        candidate_skills.join(newest.select("candidate_id"), "candidate_id", "left_semi")
        .groupBy("candidate_id")
        .agg(F.count(F.lit(1)).alias("skill_count"))
    )
    return newest.join(counts, "candidate_id", "left").withColumn(
        "skill_count", F.coalesce("skill_count", F.lit(0))
    )


def counts(candidates: DataFrame, jobs: DataFrame, skills: DataFrame) -> DataFrame:
    """Metric and value rows."""
    stats = candidate_stats(candidates).withColumns(
        {
            "active_jobs": jobs.agg(F.count_if("is_active")).scalar(),
            "skills": skills.agg(F.count(F.lit(1))).scalar(),
        }
    )
    rows = (
        ("Candidates", "total_candidates"), ("Parsed", "candidates_processed"),
        ("Active jobs", "active_jobs"), ("Taxonomy skills", "skills"),
    )
    return stats.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in rows]
            )
        )
    )


def aggregate_context(
    candidates: DataFrame, candidate_skills: DataFrame, skills: DataFrame, ranked: DataFrame,
    top_n_skills: int = 20, top_n_candidates: int = 25,
) -> tuple[DataFrame, DataFrame]:
    """Person-free context: skill frequencies, and per job the averages of its best candidates."""
    frequencies = top_skills(skills, candidate_skills, candidates, top_n_skills).select(
        "skill", F.col("count").alias("candidates")
    )
    summary = (
        ranked.where(F.col("rank") <= top_n_candidates)
        .groupBy("job_id")
        .agg(
            F.count(F.lit(1)).alias("scored"),
            F.round(F.avg("overall_score"), 4).alias("average"),
            F.round(F.avg("required_skills_score"), 4).alias("required_skill_average"),
        )
    )
    return frequencies, summary
