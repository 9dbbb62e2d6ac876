"""Typed tables on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import lexicon as lx
from ..functions.scores import TIE_NUDGE
from ..schemas import TABLES


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Every relation under ``root`` with its fixed schema; nothing is inferred."""
    return {name: load_table(spark, root, name) for name in (names or TABLES)}


def save_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def _scalar_functions() -> dict[str, str]:
    """Signature and body of each SQL function; bodies are inlined into the plan of the caller."""
    bands = " ".join(f"WHEN score >= {floor}D THEN '{label}'" for floor, label in lx.SCORE_BANDS)
    return {
        "score_band(score DOUBLE) RETURNS STRING": f"CASE {bands} ELSE '{lx.LOWEST_BAND}' END",
        "experience_coverage(have DOUBLE, required DOUBLE) RETURNS DOUBLE": (
            "CASE WHEN required > 0 THEN "
            f"round(least(1D, greatest(0D, have) / required) + {TIE_NUDGE!r}D, 4) ELSE 0D END"
        ),
        "cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": (
            "CASE WHEN size(a) = size(b) THEN greatest(-1D, least(1D, coalesce(try_divide("
            "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, v) -> s + v), "
            "sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * double(x)))"
            " * sqrt(aggregate(b, 0D, (s, x) -> s + double(x) * double(x)))), 0D))) ELSE 0D END"
        ),
    }


def register_functions(spark: SparkSession, matches: str | None = None) -> None:
    """Functions of this session under SQL names.

    ``encode_vector``, ``score_band``, ``experience_coverage`` and ``cosine``; with ``matches``, the name of
    a view of scored pairs, also the table function ``best_matches(k)``: its ``k`` best rows per job.
    """
    from ..operators.vectors import encode_vector

    spark.udf.register("encode_vector", encode_vector)
    for signature, body in _scalar_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    if matches is not None:
        spark.sql(
            "CREATE OR REPLACE TEMPORARY FUNCTION best_matches(k INT) RETURNS TABLE "
            "(job_id BIGINT, candidate_id BIGINT, overall_score DOUBLE, rank INT) RETURN "
            "SELECT job_id, candidate_id, overall_score, position FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY job_id ORDER BY overall_score DESC, candidate_id) AS position FROM {matches}) "
            "WHERE position <= best_matches.k"
        )
