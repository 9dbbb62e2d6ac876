"""Writers for rankings and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import sort_field

DISCLAIMER = "Decision-support output computed from resume text. Not a hiring decision."


def write_ranking_csv(rows: DataFrame, path: str) -> None:
    """One folder per job, ordered inside each file by rank."""
    (
        _spread(rows).sortWithinPartitions("job_id", "rank")
        .write.mode("overwrite").partitionBy("job_id").option("header", True).csv(path)
    )


def write_ranking_json(rows: DataFrame, path: str, sort_by: str | None = None) -> None:
    """One JSON line per ranked candidate with the sort field and the disclaimer."""
    tagged = rows.withColumns(
        {"sort_by": F.lit(sort_field(sort_by)), "disclaimer": F.lit(DISCLAIMER)}
    )
    (
        _spread(tagged).sortWithinPartitions("job_id", "rank")
        .write.mode("overwrite").partitionBy("job_id").json(path)
    )


def _spread(rows: DataFrame) -> DataFrame:
    """A large job is written by several tasks, each a run of consecutive ranks."""
    return rows.repartition("job_id", F.floor(F.col("rank") / 100_000))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON lines."""
    metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value")).write.mode(
        "overwrite"
    ).text(path)
