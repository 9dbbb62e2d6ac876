"""The delimited corpus: three CSV files with bar-separated lists, and its manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import lexicon as lx
from ..functions.columns import null_if_empty
from ..functions.scores import number_text
from ..functions.text import split_terms

LISTS = {
    "jobs": ("required_skills", "preferred_skills", "certifications"),
    "candidates": ("declared_skills", "hidden_skills", "certifications"),
    "labels": (),
}
COLUMNS = {
    "jobs": (
        "job_id", "title", "role_family", "required_skills", "preferred_skills", "certifications",
        "experience_required_years", "education_required", "description",
    ),
    "candidates": (
        "candidate_id", "full_name", "role_family", "declared_skills", "hidden_skills",
        "years_experience", "highest_degree", "certifications", "summary", "gender", "birth_year",
    ),
    "labels": ("job_id", "candidate_id", "relevance"),
}
NUMBERS = {
    "job_id": "bigint", "candidate_id": "bigint", "relevance": "int", "birth_year": "int",
    "experience_required_years": "double", "years_experience": "double",
}
NULLABLE = ("education_required", "highest_degree")


def _typed(name: str, column: str) -> Column:
    text = F.col(column)
    if column in LISTS[name]:
        return F.coalesce(split_terms(text, r"\|"), F.array().cast("array<string>")).alias(column)
    if column in ("experience_required_years", "years_experience", "birth_year"):
        return F.coalesce(null_if_empty(text).cast(NUMBERS[column]), F.lit(0)).cast(
            NUMBERS[column]
        ).alias(column)
    if column in NUMBERS:
        return text.cast(NUMBERS[column]).alias(column)
    if column in NULLABLE:
        return null_if_empty(text).alias(column)
    return F.coalesce(text, F.lit("")).alias(column)


def read_delimited(
    spark: SparkSession, path: str, name: str, cells_span_lines: bool | None = None
) -> DataFrame:
    """One corpus file, typed; a missing column fails before any row is read.

    A file whose cells never span lines is split among tasks; by default that is said of
    files without text columns only.
    """
    if cells_span_lines is None:
        cells_span_lines = any(c not in NUMBERS for c in COLUMNS[name])
    raw = (
        spark.read.option("header", True).option("multiLine", cells_span_lines).option("escape", '"')
        .option("enforceSchema", False).csv(path)
    )
    missing = [c for c in COLUMNS[name] if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} is missing columns: {missing}")
    return raw.select(*[_typed(name, c) for c in COLUMNS[name]])


def read_delimited_corpus(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {
        name: read_delimited(spark, f"{root.rstrip('/')}/{name}.csv", name) for name in COLUMNS
    }


def delimited_rows(df: DataFrame, name: str) -> DataFrame:
    """The text form of each column: joined lists, shortest numbers, empty for NULL."""
    def text(column: str) -> Column:
        value = F.col(column)
        if column in LISTS[name]:
            value = F.array_join(value, "|")
        elif NUMBERS.get(column) == "double":
            value = number_text(value)
        return F.coalesce(value.cast("string"), F.lit("")).alias(column)

    return df.select(*[text(c) for c in COLUMNS[name]])


def write_delimited(df: DataFrame, path: str, name: str) -> None:
    (
        delimited_rows(df, name).write.mode("overwrite").option("header", True)
        .option("emptyValue", "").option("escape", '"').csv(path)
    )


def write_delimited_corpus(corpus: dict[str, DataFrame], root: str) -> None:
    for name, df in corpus.items():
        write_delimited(df, f"{root.rstrip('/')}/{name}.csv", name)


def grade_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("relevance").agg(F.count(F.lit(1)).alias("labels"))


def corpus_manifest(jobs: DataFrame, candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, grade distribution and share of positive labels, one row."""
    per_grade = grade_distribution(labels)
    grades = per_grade.agg(
        F.array_sort(F.collect_list(F.struct("relevance", "labels"))).alias("grade_distribution"),
        F.sum("labels").alias("labels"),
        F.round(
            F.sum(F.when(F.col("relevance") > 0, F.col("labels")).otherwise(0)) / F.sum("labels"), 4
        ).alias("positive_rate"),
    )
    return grades.withColumns(
        {
            "jobs": jobs.agg(F.count(F.lit(1))).scalar(),
            "candidates": candidates.agg(F.count(F.lit(1))).scalar(),
            "protected": F.lit(", ".join(lx.PROTECTED)),
        }
    )
