"""Side-by-side comparison of small candidate sets, many sets at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import lexicon as lx
from ..functions.education import degree_rank

MIN_SET, MAX_SET = 2, 10
DEFAULT_CRITERIA = ("required_skills", "experience", "education", "preferred_skills", "semantic")
ALL_CRITERIA = DEFAULT_CRITERIA + ("certifications",)


def comparison_set(spark: SparkSession, candidate_ids: Sequence[int], set_id: int = 0) -> DataFrame:
    """One requested set as a relation ``set_id, candidate_id``."""
    ids = list(dict.fromkeys(int(i) for i in candidate_ids))
    if not MIN_SET <= len(ids) <= MAX_SET:
        raise ValueError(f"select {MIN_SET} to {MAX_SET} different candidates")
    return spark.createDataFrame([(set_id, i) for i in ids], "set_id bigint, candidate_id bigint")


def unknown_candidates(sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Requested ids that name no live candidate."""
    live = candidates.where(~F.col("is_deleted")).select("candidate_id")
    return sets.join(live, "candidate_id", "left_anti").select("set_id", "candidate_id")


def latest_match(matches: DataFrame, job_id: int | None = None) -> DataFrame:
    """Newest stored match per candidate, the higher job id on equal times.

    A max over a struct is combined before the shuffle, so a candidate with very
    many matches sends one row per partition.
    """
    rows = matches if job_id is None else matches.where(F.col("job_id") == job_id)
    value = F.struct(
        "created_at", "job_id", *[f"{c}_score" for c in lx.COMPONENTS], "overall_score"
    )
    return rows.groupBy("candidate_id").agg(F.max(value).alias("m")).select("candidate_id", "m.*")


def criteria_of(criteria: Sequence[str] | None) -> list[str]:
    known = [c for c in (criteria or ALL_CRITERIA) if c in ALL_CRITERIA]
    return known or list(DEFAULT_CRITERIA)


def compare_candidates(
    sets: DataFrame,
    candidates: DataFrame,
    matches: DataFrame,
    job_id: int | None = None,
    criteria: Sequence[str] | None = None,
) -> DataFrame:
    """One row per set, criterion and candidate: value, whether it leads, and a note.

    Education compares degree ranks; everything else the latest match.  Sets have
    at most ten members, so the windows are tiny.
    """
    selected = criteria_of(criteria)
    live = candidates.where(~F.col("is_deleted")).select(
        "candidate_id", "full_name", degree_rank("highest_degree").cast("double").alias("_degree")
    )
    latest = latest_match(matches, job_id)
    values = F.array(
        *[
            F.struct(
                F.lit(c).alias("criterion"),
                F.lit(lx.COMPONENT_LABELS[c]).alias("label"),
                (F.col("_degree") if c == "education" else F.col(f"{c}_score")).alias("value"),
            )
            for c in selected
        ]
    )
    long = (
        sets.join(live, "candidate_id")
        .join(latest, "candidate_id", "left")
        .select("set_id", "candidate_id", "full_name", F.inline(values))
    )
    row = Window.partitionBy("set_id", "criterion")
    leads = F.coalesce(F.col("value") >= F.max("value").over(row), F.lit(False))
    marked = long.withColumn("_leads", leads).withColumns(
        {
            "_leaders": F.count_if("_leads").over(row),
            "_members": F.count(F.lit(1)).over(row),
            "_known": F.count("value").over(row),
            "_spread": F.max("value").over(row) - F.min("value").over(row),
        }
    )
    spread = F.col("_spread")
    note = (
        F.when(F.col("_known") < 2, "Not available for every candidate")
        .when(
            F.col("criterion") == "education",
            "Ordinal scale: higher means a higher qualification",
        )
        .when(spread < 0.05, "Effectively equal")
        .when(spread < 0.2, "Small difference")
        .when(spread < 0.5, "Clear difference")
        .otherwise("Large difference")
    )
    return marked.select(
        "set_id", "criterion", "label", "candidate_id", "full_name", "value",
        (F.col("_leads") & (F.col("_leaders") < F.col("_members"))).alias("is_best"),
        note.alias("note"),
    )


def skills_matrix(sets: DataFrame, candidate_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """Per set and skill: which members hold it, as a list aligned with ``members``."""
    members = sets.groupBy("set_id").agg(
        F.array_sort(F.collect_set("candidate_id")).alias("members")
    )
    holders = (
        sets.join(candidate_skills.select("candidate_id", "normalized_name"), "candidate_id")
        .groupBy("set_id", "normalized_name")
        .agg(F.collect_set("candidate_id").alias("holders"))
    )
    return (
        holders.join(members, "set_id")
        .join(skills.select("normalized_name", "name"), "normalized_name", "left")
        .select(
            "set_id",
            F.coalesce("name", "normalized_name").alias("skill"),
            "members",
            F.transform("members", lambda c: F.array_contains("holders", c)).alias("held"),
        )
    )


def skills_pivot(sets: DataFrame, candidate_skills: DataFrame, candidate_ids: Sequence[int]) -> DataFrame:
    """The matrix of one requested set with a boolean column per candidate."""
    rows = sets.join(candidate_skills.select("candidate_id", "normalized_name"), "candidate_id")
    ids = [int(i) for i in candidate_ids]
    counted = rows.groupBy("normalized_name").pivot("candidate_id", ids).agg(F.count(F.lit(1)))
    return counted.select(
        "normalized_name", *[(F.coalesce(f"`{i}`", F.lit(0)) > 0).alias(str(i)) for i in ids]
    )
