"""Ordering scored pairs: ranks, pages, top-k, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..plans.prefix import ranked, ranked_between, top_per_group
from ..session import written

MAX_PAGE_SIZE = 100
EXPORTED_PERSON = (
    "candidate_id", "full_name", "email", "location", "current_title", "total_experience_years", "highest_degree", "shortlisted",
)
EXPORTED_SCORES = (*[f"{c}_score" for c in lx.COMPONENTS], "overall_score")


def sort_field(sort_by: str | None) -> str:
    """A known sort field; anything else means the overall score."""
    return sort_by if sort_by in lx.SORT_COLUMNS else "overall"


def _levels(sort_by: str | None) -> list[tuple[str, str]]:
    column = lx.SORT_COLUMNS[sort_field(sort_by)]
    return [(c, "desc") for c in dict.fromkeys([column, "overall_score"])]


def ranking_order(sort_by: str | None = None) -> list[Column]:
    """Score, then overall score, then candidate id: a total order."""
    return [F.col(c).desc() for c, _ in _levels(sort_by)] + [F.col("candidate_id").asc()]


def rank_candidates(matches: DataFrame, sort_by: str | None = None) -> DataFrame:
    """Rank 1..n of every candidate within its job, for every job at once."""
    return ranked(matches, ["job_id"], _levels(sort_by), "candidate_id")


def top_candidates(matches: DataFrame, k: int = 10, sort_by: str | None = None) -> DataFrame:
    return top_per_group(matches, ["job_id"], ranking_order(sort_by), k)


def ranking_page(matches: DataFrame, page: int, page_size: int = 20, sort_by: str | None = None) -> DataFrame:
    """One page of every job's ranking, sought by counts: a deep page costs what the first one does."""
    first, last = page_bounds(page, page_size)
    return ranked_between(matches, ["job_id"], _levels(sort_by), "candidate_id", first, last)


def load_rankings(
    matches: DataFrame,
    candidates: DataFrame,
    sort_by: str | None = None,
    shortlisted_only: bool = False,
    page: int | None = None,
    page_size: int = 20,
) -> DataFrame:
    """Stored matches of live candidates in ranking order, optionally one page per job."""
    live = candidates.where(~F.col("is_deleted"))
    if shortlisted_only:
        live = live.where("shortlisted")
    joined = matches.join(live, "candidate_id")
    if page is None:
        return rank_candidates(joined, sort_by)
    first, last = page_bounds(page, page_size)
    # A page is a top-k prefix: only the first ``last`` rows per job are ever ordered.
    return top_candidates(joined, last, sort_by).where(F.col("rank") >= first)


def page_bounds(page: int, page_size: int) -> tuple[int, int]:
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must be >= 1 and page_size 1..{MAX_PAGE_SIZE}")
    return (page - 1) * page_size + 1, page * page_size


def paginate(df: DataFrame, order: Sequence[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    first, _ = page_bounds(page, page_size)
    return df.orderBy(*order).offset(first - 1).limit(page_size)


def page_info(df: DataFrame, page_size: int = 20) -> DataFrame:
    """Total rows and number of pages, at least one."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("bigint")
    )


def ranked_totals(matches: DataFrame, candidates: DataFrame, shortlisted_only: bool = False) -> DataFrame:
    """Rankable candidates per job."""
    live = candidates.where(~F.col("is_deleted"))
    if shortlisted_only:
        live = live.where("shortlisted")
    return (
        matches.join(live.select("candidate_id"), "candidate_id", "left_semi")
        .groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("total"))
    )


def _explained_rows(explained: DataFrame, texts: list[str], people: DataFrame, sort_by: str | None) -> DataFrame:
    """:func:`load_rankings` of the scores in ``explained`` joined with its own ``texts``.

    A pair that stands once meets only itself, so its row is taken as it is and written once; pairs
    that repeat are joined.  Rows with a NULL key meet nothing.
    """
    spark, keys = explained.sparkSession, ["job_id", "candidate_id"]
    live = people.where(~F.col("is_deleted"))
    rows = explained.where(F.col("job_id").isNotNull()).join(live, "candidate_id")
    rows = written(spark, rows, "explained-pairs")
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys)
    repeated = written(spark, repeated, "repeated-pairs")
    if not repeated.isEmpty():
        again = explained.join(repeated, keys, "left_semi")
        both = again.drop(*texts).join(again.select(*keys, *texts), keys).join(live, "candidate_id")
        rows = rows.join(repeated, keys, "left_anti").unionByName(both)
    return rank_candidates(rows, sort_by)


def export_rows(
    scored: DataFrame,
    explanations: DataFrame,
    candidates: DataFrame,
    sort_by: str | None = None,
    include_explanation: bool = True,
) -> DataFrame:
    """Flat export table of every job's ranking, lists joined with commas.

    One frame given as ``scored`` and ``explanations`` holds both and is computed once.
    """
    def joined(name: str) -> Column:
        return F.array_join(F.col(f"explanation.{name}"), ", ")

    # Only what is exported is carried, as the text it ends as.
    keys = ["job_id", "candidate_id"]
    texts = {"missing_required": joined("missing_required"), "weak_signals": joined("weak_signals")}
    if include_explanation:
        texts["explanation_summary"] = F.col("explanation.summary")
        texts["matched_required"] = joined("strong_matches")
    told = [text.alias(name) for name, text in texts.items()]
    people = candidates.select(*EXPORTED_PERSON, "is_deleted")
    if explanations is scored:
        rows = _explained_rows(scored.select(*keys, *EXPORTED_SCORES, *told), list(texts), people, sort_by)
    else:
        both = scored.select(*keys, *EXPORTED_SCORES).join(explanations.select(*keys, *told), keys)
        rows = load_rankings(both, people, sort_by)
    columns = [
        "job_id", "rank", "candidate_id", F.col("full_name").alias("name"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("email", "location", "current_title")],
        "total_experience_years",
        F.coalesce("highest_degree", F.lit("")).alias("highest_degree"),
        "shortlisted",
        *[F.col(f"{c}_score").alias(c) for c in lx.COMPONENTS],
        "overall_score",
        *texts,
    ]
    return rows.select(*columns)
