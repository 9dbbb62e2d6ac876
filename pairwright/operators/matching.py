"""Scoring candidates against jobs.

The unit of work is a *pair* relation ``(job_id, candidate_id)``: applications,
labels, or one job against a pool.  Each pair meets its job profile and its
candidate profile in two equi-joins and is then scored inside the row, so no
pair x requirement rows are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions.columns import each_with_position, let
from ..functions.education import degree_rank
from ..functions.scores import clamp, cosine_of, norm, rescale_similarity, round4
from ..functions.text import normalize_text, slugify_unknown
from ..session import written
from .catalogue import resolve_array

MATCHED, WEAK, MISSING = "matched", "weak", "missing"
#: Listed skills up to which their contributions are written out; longer lists are exact too, and slower.
TERMS_WRITTEN_OUT = 8

REQUIREMENT_TYPE = "array<struct<term:string,normalized_name:string>>"
MATCH_TYPE = (
    "struct<term:string,normalized_name:string,importance:string,status:string,"
    "contribution:double,confidence:double,similarity:double,years_experience:double,"
    "evidence:string>"
)


# -- profiles ---------------------------------------------------------------
def job_profiles(
    jobs: DataFrame, vectors: DataFrame | None = None, aliases: DataFrame | None = None
) -> DataFrame:
    """One row per job: requirement lists with normalised names, and its vector."""
    out = jobs.select(
        "job_id",
        F.coalesce("experience_required_years", F.lit(0.0)).alias("experience_required_years"),
        "education_required",
        degree_rank("education_required").alias("degree_rank_required"),
        F.col("title").alias("job_title"),
        *[
            F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
            for c in ("required_skills", "preferred_skills")
        ],
        F.coalesce(F.col("certifications"), F.array().cast("array<string>")).alias(
            "required_certifications"
        ),
    )
    for name in ("required_skills", "preferred_skills", "required_certifications"):
        if aliases is None:
            out = out.withColumn(
                name,
                F.transform(
                    name,
                    lambda t: F.struct(
                        t.alias("term"), slugify_unknown(t).alias("normalized_name")
                    ),
                ).cast(REQUIREMENT_TYPE),
            )
        else:
            out = resolve_array(out, "job_id", name, aliases)
    out = out.withColumn(
        "certification_texts", F.transform("required_certifications", lambda t: normalize_text(t["term"]))
    )
    return _with_vector(out, vectors, "job_id", "job")


def _with_vector(
    df: DataFrame, vectors: DataFrame | None, key: str, prefix: str
) -> DataFrame:
    """Attach a stored vector and its length, both NULL when there is none."""
    if vectors is None:
        out = df.withColumn(f"{prefix}_vector", F.lit(None).cast("array<float>"))
    else:
        out = df.join(
            vectors.select(key, F.col("embedding").alias(f"{prefix}_vector")), key, "left"
        )
    return out.withColumn(f"{prefix}_norm", norm(F.col(f"{prefix}_vector")))


def strongest_skills(candidate_skills: DataFrame) -> DataFrame:
    """One row per (candidate, skill): the observation with the highest confidence.

    Each column is taken by itself, from the same row, so that a query which reads no
    evidence shuffles none and sorts nothing.  A skill without any confidence has NULLs.
    """
    values = {
        "confidence": F.col("confidence").cast("double"),
        "years_experience": F.col("years_experience").cast("double"),
        "evidence": F.get("evidence", F.lit(0)),
    }
    return candidate_skills.groupBy("candidate_id", "normalized_name").agg(
        *[F.max_by(value, "confidence").alias(name) for name, value in values.items()]
    )


def candidate_profiles(
    candidates: DataFrame, candidate_skills: DataFrame, vectors: DataFrame | None = None
) -> DataFrame:
    """One row per candidate: skills as maps, held certificates in matching form, vector.

    A map has at most one entry per catalogue skill, so its size does not grow with the
    number of observations.  Scores read ``held_confidence``, the rows of matches ``held_skills``.
    """
    signal = F.when(
        F.col("confidence").isNotNull(), F.struct("confidence", "years_experience", "evidence")
    ).alias("signal")

    def held(value: Column | str) -> Column:
        return F.map_from_entries(F.collect_list(F.struct("normalized_name", value)))

    skills = (
        strongest_skills(candidate_skills)
        .groupBy("candidate_id")
        .agg(held("confidence").alias("held_confidence"), held(signal).alias("held_skills"))
    )
    out = candidates.select(
        "candidate_id",
        F.when(
            F.col("relevant_experience_years") > 0, F.col("relevant_experience_years")
        )
        .otherwise(F.coalesce("total_experience_years", F.lit(0.0)))
        .alias("experience_years"),
        degree_rank("highest_degree").alias("degree_rank_held"),
        F.transform(
            F.coalesce("certifications", F.array().cast("array<string>")), normalize_text
        ).alias("held_certifications"),
    ).join(skills, "candidate_id", "left")
    return _with_vector(out, vectors, "candidate_id", "candidate")


def eligible_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.where(~F.col("is_deleted") & (F.col("status") == "parsed"))


def pairs_for_jobs(candidates: DataFrame, job_ids: Sequence[int]) -> DataFrame:
    """Every eligible candidate for the requested jobs: rows grow with the pool only."""
    wanted = F.array(*[F.lit(int(j)).cast("bigint") for j in dict.fromkeys(job_ids)])
    return eligible_candidates(candidates).select(
        F.explode(wanted).alias("job_id"), "candidate_id"
    )


# -- one pair, inside the row ------------------------------------------------
def _match(term: Column, importance: str, **values: Column) -> Column:
    fields = ["status", "contribution", "confidence", "similarity", "years_experience", "evidence"]
    return F.struct(
        term["term"].alias("term"),
        term["normalized_name"].alias("normalized_name"),
        F.lit(importance).alias("importance"),
        *[values.get(f, F.lit(None)).alias(f) for f in fields],
    ).cast(MATCH_TYPE)


def _partial_credit() -> Column:
    """What an absent skill earns from the similarity of the two documents."""
    span = 1.0 - lx.SEMANTIC_SKILL_THRESHOLD
    return round4(
        lx.SEMANTIC_PARTIAL_CREDIT
        * F.least(F.lit(1.0), (F.col("cosine") - lx.SEMANTIC_SKILL_THRESHOLD) / span)
    )


def _skill_matches(terms: Column, importance: str) -> Column:
    """Status and contribution of each required or preferred skill.

    A held skill counts with its confidence.  Otherwise a strong overall
    similarity of the two documents earns partial credit, reported as weak.
    """
    similarity, partial = F.col("cosine"), _partial_credit()

    def one(term: Column) -> Column:
        def status(signal: Column) -> Column:
            return (
                F.when(
                    signal.isNotNull(),
                    _match(
                        term,
                        importance,
                        status=F.when(
                            signal["confidence"] >= lx.WEAK_CONFIDENCE, MATCHED
                        ).otherwise(WEAK),
                        contribution=signal["confidence"],
                        confidence=signal["confidence"],
                        years_experience=signal["years_experience"],
                        evidence=signal["evidence"],
                    ),
                )
                .when(
                    similarity >= lx.SEMANTIC_SKILL_THRESHOLD,
                    _match(
                        term,
                        importance,
                        status=F.lit(WEAK),
                        contribution=partial,
                        confidence=partial,
                        similarity=round4(similarity),
                    ),
                )
                .otherwise(
                    _match(
                        term,
                        importance,
                        status=F.lit(MISSING),
                        contribution=F.lit(0.0),
                        confidence=F.lit(0.0),
                        similarity=round4(similarity),
                    )
                )
            )

        return let(F.try_element_at("held_skills", term["normalized_name"]), status)

    return F.transform(terms, one)


def _listed(text: Column) -> Column:
    """Whether a certificate's matching form stands in one that the candidate names."""
    return (F.length(text) > 0) & F.exists("held_certifications", lambda h: F.contains(h, text))


def _certification_matches(terms: Column) -> Column:
    def one(term: Column, i: Column) -> Column:
        def status(signal: Column) -> Column:
            listed = _listed(F.get("certification_texts", i))
            return (
                F.when(
                    signal.isNotNull(),
                    _match(
                        term,
                        "certification",
                        status=F.lit(MATCHED),
                        contribution=F.lit(1.0),
                        confidence=signal["confidence"],
                        years_experience=signal["years_experience"],
                        evidence=signal["evidence"],
                    ),
                )
                .when(
                    listed,
                    _match(
                        term,
                        "certification",
                        status=F.lit(MATCHED),
                        contribution=F.lit(1.0),
                        confidence=F.lit(lx.TEXTUAL_CERTIFICATION_CONFIDENCE),
                        evidence=F.lit(lx.CERTIFICATION_EVIDENCE),
                    ),
                )
                .otherwise(
                    _match(
                        term,
                        "certification",
                        status=F.lit(MISSING),
                        contribution=F.lit(0.0),
                        confidence=F.lit(0.0),
                    )
                )
            )

        return let(F.try_element_at("held_skills", term["normalized_name"]), status)

    return F.transform(terms, one)


def skill_coverage(terms: str) -> Column:
    """Mean contribution over the listed skills, 0 when there are none.

    The figures of :func:`_skill_matches` without its rows, which queries of scores never build.
    The terms of a short list are written out, which Spark compiles; a lambda it interprets.
    """
    def contribution(term: Column) -> Column:
        held = F.try_element_at("held_confidence", term["normalized_name"])
        return F.coalesce(held, F.col("partial_credit"))

    total = F.lit(0.0)
    for i in range(TERMS_WRITTEN_OUT):
        total = total + F.when(F.size(terms) > i, contribution(F.get(terms, F.lit(i)))).otherwise(0.0)
    longer = F.aggregate(terms, F.lit(0.0), lambda s, term: s + contribution(term))
    return _mean(terms, F.when(F.size(terms) > TERMS_WRITTEN_OUT, longer).otherwise(total))


def certification_coverage(terms: str) -> Column:
    """Share of the listed certificates that are held as a skill or named by the candidate."""
    held = F.zip_with(
        terms, "certification_texts",
        lambda term, text: F.try_element_at("held_confidence", term["normalized_name"]).isNotNull() | _listed(text),
    )
    return _mean(terms, F.size(F.filter(held, lambda h: h)).cast("double"))


def _mean(terms: str, total: Column) -> Column:
    return F.when(F.size(terms) > 0, round4(total / F.size(terms))).otherwise(0.0)


def experience_score(have: Column, required: Column) -> Column:
    return F.when(
        required > 0, round4(F.least(F.lit(1.0), F.greatest(F.lit(0.0), have) / required))
    ).otherwise(0.0)


def education_score(degree_rank_held: Column, degree_rank_required: Column) -> Column:
    """1 at or above the requirement, less per missing level, NULL when not evaluable."""
    gap = degree_rank_required - degree_rank_held
    return F.when(
        (degree_rank_required > 0) & (degree_rank_held > 0),
        F.when(gap <= 0, 1.0).otherwise(
            round4(F.greatest(F.lit(0.0), 1.0 - lx.EDUCATION_STEP * gap))
        ),
    )


def weight_columns(weights: Mapping[str, float] | None) -> dict[str, Column]:
    values = weights or lx.DEFAULT_WEIGHTS
    return {c: F.lit(float(values[c])) for c in lx.COMPONENTS}


def _sum(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _candidate_parts(pairs: DataFrame) -> int:
    """Parts that pairs and candidates are dealt into: more for larger jobs, by the root.

    The rows of a job that go to one part lie side by side and its profile is compressed
    to one copy there, so fewer parts than a job has candidates keep the shuffle small.
    """
    return math.ceil(4 * math.sqrt(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def with_profiles(pairs: DataFrame, jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each pair beside its job's and its candidate's columns.

    Pairs are merged with their jobs as bare ids and leave in order of jobs.  They then
    stream past a hash table of a part of the candidates, so no row with a profile is sorted.
    """
    parts = _candidate_parts(pairs)
    return (
        pairs.join(jobs.hint("merge"), "job_id")
        .repartition(parts, "candidate_id")
        .join(candidates.repartition(parts, "candidate_id").hint("shuffle_hash"), "candidate_id")
    )


def score_pairs(
    pairs: DataFrame,
    jobs: DataFrame,
    candidates: DataFrame,
    weights: Mapping[str, float] | DataFrame | None = None,
) -> DataFrame:
    """Score each pair on six components and combine the applicable ones.

    ``jobs`` and ``candidates`` are profiles.  ``weights`` is one weighting for
    all, or a DataFrame ``job_id`` + one column per component.
    """
    if isinstance(weights, DataFrame):
        jobs = jobs.join(
            weights.select("job_id", *[F.col(c).alias(f"weight_{c}") for c in lx.COMPONENTS]),
            "job_id",
        )
        weight = {c: F.col(f"weight_{c}") for c in lx.COMPONENTS}
    else:
        weight = weight_columns(weights)
    joined = with_profiles(pairs, jobs, candidates)

    both = F.col("job_vector").isNotNull() & F.col("candidate_vector").isNotNull()
    staged = joined.withColumns(
        {
            "cosine": F.when(
                both,
                cosine_of(
                    F.col("job_vector"), F.col("candidate_vector"),
                    F.col("job_norm"), F.col("candidate_norm"),
                ),
            ),
        }
    ).withColumns(
        {
            "partial_credit": F.when(
                F.col("cosine") >= lx.SEMANTIC_SKILL_THRESHOLD, _partial_credit()
            ).otherwise(0.0),
            "required_matches": _skill_matches(F.col("required_skills"), "required"),
            "preferred_matches": _skill_matches(F.col("preferred_skills"), "preferred"),
            "certification_matches": _certification_matches(F.col("required_certifications")),
            "_education": education_score(
                F.col("degree_rank_held"), F.col("degree_rank_required")
            ),
        }
    )
    required = F.col("experience_required_years")
    raw = {
        "required_skills": skill_coverage("required_skills"),
        "experience": experience_score(F.col("experience_years"), required),
        "education": F.col("_education"),
        "preferred_skills": skill_coverage("preferred_skills"),
        "semantic": F.when(
            F.col("cosine").isNotNull(), round4(rescale_similarity(F.col("cosine")))
        ).otherwise(0.0),
        "certifications": certification_coverage("required_certifications"),
    }
    applicable = {
        "required_skills": F.size("required_skills") > 0,
        "experience": required > 0,
        "education": F.col("_education").isNotNull(),
        "preferred_skills": F.size("preferred_skills") > 0,
        "semantic": F.col("cosine").isNotNull(),
        "certifications": F.size("required_certifications") > 0,
    }
    scored = staged.withColumns(
        {f"{c}_score": F.coalesce(raw[c], F.lit(0.0)) for c in lx.COMPONENTS}
        | {
            "applicable": F.struct(*[applicable[c].alias(c) for c in lx.COMPONENTS]),
            "weights": F.struct(*[weight[c].alias(c) for c in lx.COMPONENTS]),
        }
    )
    on = {c: F.col("applicable")[c] for c in lx.COMPONENTS}
    scored = scored.withColumns(
        {
            "active_weight": _sum(
                [F.when(on[c], F.col("weights")[c]).otherwise(0.0) for c in lx.COMPONENTS]
            ),
            "_weighted": _sum(
                [
                    F.when(on[c], F.col(f"{c}_score") * F.col("weights")[c]).otherwise(0.0)
                    for c in lx.COMPONENTS
                ]
            ),
        }
    )
    active = F.col("active_weight")
    overall = F.when(active <= 0, F.col("semantic_score")).otherwise(F.col("_weighted") / active)
    return scored.select(
        "job_id",
        "candidate_id",
        *[f"{c}_score" for c in lx.COMPONENTS],
        round4(clamp(overall)).alias("overall_score"),
        "required_matches",
        "preferred_matches",
        "certification_matches",
        "applicable",
        "weights",
        "active_weight",
        "cosine",
        _notes(on, active).alias("notes"),
        "job_title",
        "experience_required_years",
        "experience_years",
        "education_required",
        "degree_rank_held",
        "degree_rank_required",
    )


def _notes(on: Mapping[str, Column], active: Column) -> Column:
    skipped = F.array_join(
        F.array_compact(F.array(*[F.when(~on[c], c) for c in sorted(lx.COMPONENTS)])), ", "
    )
    stated = F.coalesce(F.length("education_required"), F.lit(0)) > 0
    return F.array_compact(
        F.array(
            F.when(~on["education"] & stated, lx.NOTE_EDUCATION),
            F.when(~on["semantic"], lx.NOTE_SEMANTIC),
            F.when(~on["required_skills"], lx.NOTE_REQUIRED),
            F.when(active <= 0, lx.NOTE_FALLBACK),
            F.when(
                (active > 0) & (active < 1.0),
                F.concat(F.lit(lx.NOTE_RENORMALISED), skipped, F.lit(".")),
            ),
        )
    )


def match_results(scored: DataFrame) -> DataFrame:
    """The stored columns of a scored pair."""
    return scored.select(
        "job_id", "candidate_id", *[f"{c}_score" for c in lx.COMPONENTS], "overall_score", "weights"
    )


# -- requirement rows --------------------------------------------------------
def requirement_matches(scored: DataFrame) -> DataFrame:
    """One row per pair and requirement, in requirement order; a narrow explode."""
    tagged = F.concat("required_matches", "preferred_matches", "certification_matches")
    return each_with_position(scored, ["job_id", "candidate_id"], tagged, "position", "m").select("job_id", "candidate_id", "position", "m.*").withColumn(
        "is_satisfied", F.col("status") == MATCHED
    )


def status_counts(scored: DataFrame) -> DataFrame:
    """Matched, weak and missing required terms per pair."""
    def count(status: str) -> Column:
        return F.size(F.filter("required_matches", lambda m: m["status"] == status))

    return scored.select(
        "job_id",
        "candidate_id",
        count(MATCHED).alias("matched_required"),
        count(WEAK).alias("weak_required"),
        count(MISSING).alias("missing_required"),
    )


# -- batches -----------------------------------------------------------------
def pending_pairs(
    pairs: DataFrame, existing: DataFrame, weights: Mapping[str, float] | None = None,
    force: bool = False,
) -> DataFrame:
    """Pairs without a stored result under the same weights."""
    if force:
        return pairs
    wanted = weights or lx.DEFAULT_WEIGHTS
    same = existing.where(
        " AND ".join(f"weights.{c} = {float(wanted[c])!r}D" for c in lx.COMPONENTS)
    )
    return pairs.join(same, ["job_id", "candidate_id"], "left_anti")


def score_all(
    pairs: DataFrame,
    jobs: DataFrame,
    candidates: DataFrame,
    existing: DataFrame | None = None,
    weights: Mapping[str, float] | None = None,
    force: bool = False,
) -> DataFrame:
    """Scored pairs that are new or were scored under other weights."""
    todo = pairs if existing is None else pending_pairs(pairs, existing, weights, force)
    return score_pairs(todo, jobs, candidates, weights)


def batch_outcomes(pairs: DataFrame, scored: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Analysed, skipped and failed pair counts per job.

    A pair fails when it names an unknown job or candidate: it is in ``pairs``
    but neither scored nor stored before.
    """
    keys = ["job_id", "candidate_id"]
    frames = {"_pairs": pairs, "_scored": scored} | ({} if existing is None else {"_stored": existing})
    kinds = ("_pairs", "_scored", "_stored")
    rows = reduce(DataFrame.unionByName, [
        frame.select(*keys, *[F.lit(int(kind == name)).alias(kind) for kind in kinds]) for name, frame in frames.items()
    ])
    # All three meet in one shuffle.  A row with a NULL key is known to nobody.
    met = rows.groupBy(*keys).agg(*[F.sum(kind).alias(kind) for kind in kinds]).where(F.col("_pairs") > 0)
    known = F.col("job_id").isNotNull() & F.col("candidate_id").isNotNull()
    scored_, stored = known & (F.col("_scored") > 0), known & (F.col("_stored") > 0)
    outcomes = {
        "analyzed": F.when(scored_, F.col("_pairs") * F.col("_scored")).otherwise(0),
        "skipped": F.when(~scored_ & stored, F.col("_pairs") * F.col("_stored")).otherwise(0),
        "failed": F.when(~scored_ & ~stored, F.col("_pairs")).otherwise(0),
    }
    return met.groupBy("job_id").agg(*[F.sum(n).alias(name) for name, n in outcomes.items()])


def upsert_matches(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with every freshly scored pair replaced or added."""
    keys = ["job_id", "candidate_id"]
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(
        fresh.select(*existing.columns)
    )


def write_matches(matches: DataFrame, path: str) -> None:
    """Add or replace the given pairs in the store at ``path``; every other pair stays.

    The buckets of the jobs in ``matches`` are read, merged, written to the shared folder and
    only then put in place of the old ones, so a lost job leaves the store as it was.
    """
    spark = matches.sparkSession
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(256)).cast("int")
    fresh = written(spark, matches.withColumn("job_bucket", bucket), "fresh-matches")
    try:
        stored = spark.read.schema(fresh.schema).parquet(path)
    except AnalysisException:  # the first write
        stored = None
    if stored is not None:
        touched = [r[0] for r in fresh.select("job_bucket").distinct().collect()]  # 256 at most
        fresh = written(
            spark, upsert_matches(stored.where(F.col("job_bucket").isin(touched)), fresh), "merged-matches"
        )
    (
        fresh.repartition("job_bucket", F.pmod(F.xxhash64("candidate_id"), F.lit(64)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("job_bucket")
        .parquet(path)
    )
