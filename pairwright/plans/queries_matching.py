"""Registered queries: scoring, evidence, ranking, comparison, dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import lexicon as lx
from ..operators import compare as cmp
from ..operators import dashboard as dash
from ..operators import explain as ex
from ..operators import matching as m
from ..operators import ranking as rk
from ..operators import weights as wt
from ..functions.scores import score_band, score_tone
from ..session import written
from ..sources.tables import register_functions
from . import driver_tables as t
from . import oracle_relations as o
from .registry import query

SCORES = [f"{c}_score" for c in lx.COMPONENTS] + ["overall_score"]
SQL_SCORES = ", ".join(SCORES)


def stored_matches(spark, d) -> DataFrame:
    """Match rows with the date they were computed on."""
    made = t.jobs(spark, d).select("job_id", F.col("created_at").alias("_made"))
    return t.match_results(spark, d).join(made, "job_id").withColumn(
        "created_at", F.date_add("_made", (F.col("candidate_id") % 30).cast("int"))
    ).drop("_made")


@query(o.with_matches(f"SELECT job_id, candidate_id, {SQL_SCORES}, round(active_weight, 6) AS active_weight FROM matches"))
def compute_match(spark, d):
    """Every eligible application scored on six components."""
    return t.scored(spark, d).select(
        "job_id", "candidate_id", *SCORES, F.round("active_weight", 6).alias("active_weight")
    )


@query(o.with_matches(
    f"""SELECT job_id, candidate_id, {SQL_SCORES}, CAST(rank AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY overall_score DESC, candidate_id) AS rank
      FROM matches) WHERE rank <= 10"""))
def top_candidates_per_job(spark, d):
    """Flagship: the ten best candidates of every job."""
    best = rk.top_candidates(t.match_results(spark, d), 10)
    return best.select("job_id", "candidate_id", *SCORES, F.col("rank").cast("bigint").alias("rank"))


@query(o.with_matches(
    """SELECT job_id, candidate_id, CAST(position - 1 AS BIGINT) AS position, term, importance,
      status, round(contribution, 4) AS contribution, status = 'matched' AS is_satisfied
    FROM req_matches"""))
def requirement_matches(spark, d):
    rows = m.requirement_matches(t.scored(spark, d))
    return rows.select(
        "job_id", "candidate_id", F.col("position").cast("bigint").alias("position"), "term",
        "importance", "status", F.round("contribution", 4).alias("contribution"), "is_satisfied",
    )


@query(o.with_matches(
    """SELECT job_id, candidate_id, matched AS matched_required, weak AS weak_required,
      missing AS missing_required FROM matches"""))
def requirement_status_split(spark, d):
    rows = m.status_counts(t.scored(spark, d))
    return rows.select(
        "job_id", "candidate_id",
        *[F.col(f"{s}_required").cast("bigint").alias(f"{s}_required") for s in ("matched", "weak", "missing")],
    )


def _component(name: str):
    column = f"{name}_score"
    sql = o.with_matches(f"SELECT job_id, candidate_id, {column} FROM matches")

    def run(spark, d):
        return t.scored(spark, d).select("job_id", "candidate_id", column)

    run.__name__ = column
    return query(sql)(run)


for _name in lx.COMPONENTS:
    _component(_name)


CUSTOM = {
    "required_skills": 0.6, "experience": 0.15, "education": 0.1, "preferred_skills": 0.07,
    "semantic": 0.05, "certifications": 0.03,
}


@query("WITH " + ",".join((o.BASE, o.PAIRS, o.REQUIREMENT_MATCHES, o.scores({
    "required": "0.6", "experience": "0.15", "education": "0.1", "preferred": "0.07",
    "semantic": "0.05", "certification": "0.03"}))) + " SELECT job_id, candidate_id, overall_score FROM matches")
def compute_match_custom_weights(spark, d):
    weights = wt.resolve_weights(explicit=CUSTOM)
    return t.scored(spark, d, weights).select("job_id", "candidate_id", "overall_score")


@query("WITH " + ",".join((o.BASE, o.PAIRS, o.REQUIREMENT_MATCHES, o.scores({
    k: f"CASE WHEN job_id % 2 = 0 THEN {a} ELSE {b} END" for k, a, b in (
        ("required", 0.4, 0.6), ("experience", 0.2, 0.15), ("education", 0.15, 0.1),
        ("preferred", 0.1, 0.07), ("semantic", 0.1, 0.05), ("certification", 0.05, 0.03))})))
    + " SELECT job_id, candidate_id, overall_score FROM matches")
def compute_match_weights_per_job(spark, d):
    """A weighting per job, as a relation."""
    weights = t.jobs(spark, d).select(
        "job_id",
        *[
            F.when(F.col("job_id") % 2 == 0, lx.DEFAULT_WEIGHTS[c]).otherwise(CUSTOM[c]).alias(c)
            for c in lx.COMPONENTS
        ],
    )
    return t.scored(spark, d, weights).select("job_id", "candidate_id", "overall_score")


@query(o.with_matches(
    f"""SELECT job_id, candidate_id, {SQL_SCORES}, CAST(rank AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY experience_score DESC, overall_score DESC, candidate_id)
        AS rank FROM matches) WHERE rank BETWEEN 41 AND 60"""))
def deep_ranking_page(spark, d):
    """Third page of every job's ranking by experience, where many candidates tie."""
    matches = written(spark, m.match_results(t.scored_in_steps(spark, d)).drop("weights"), "matches")
    page = rk.ranking_page(matches, page=3, page_size=20, sort_by="experience")
    return page.select("job_id", "candidate_id", *SCORES, "rank")


@query(o.with_matches(
    """SELECT job_id, candidate_id, CAST(rank AS BIGINT) AS rank, experience_score AS experience,
      CASE WHEN overall_score >= 0.85 THEN 'excellent' WHEN overall_score >= 0.7 THEN 'strong'
        WHEN overall_score >= 0.55 THEN 'moderate' WHEN overall_score >= 0.4 THEN 'weak' ELSE 'poor' END AS band
    FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY overall_score DESC, candidate_id) AS rank
      FROM matches) WHERE rank <= 5"""))
def best_matches_in_sql(spark, d):
    """The registered functions, called from SQL text only."""
    scored = t.scored(spark, d).select(
        "job_id", "candidate_id", "overall_score", "experience_years", "experience_required_years"
    )
    written(spark, scored, "matches").createOrReplaceTempView("scored_matches")
    register_functions(spark, "scored_matches")
    return spark.sql(
        """SELECT b.job_id, b.candidate_id, CAST(b.rank AS BIGINT) AS rank,
          experience_coverage(s.experience_years, s.experience_required_years) AS experience,
          score_band(b.overall_score) AS band
        FROM best_matches(5) b JOIN scored_matches s ON b.job_id = s.job_id AND b.candidate_id = s.candidate_id"""
    )


# -- evidence and explanations ------------------------------------------------
_PCT = "CAST(CAST(round_even(({}) * 100, 0) AS BIGINT) AS VARCHAR) || '%'"
_YEARS = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


def _pct(e: str) -> str:
    return _PCT.format(e)


_CONFIDENCE = "CASE WHEN importance = 'certification' THEN coalesce(held, CASE WHEN status = 'matched' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) ELSE contribution END"
_SIMILARITY = f"CASE WHEN held IS NULL AND importance <> 'certification' THEN {o.r4('cosine')} END"
_CLAIMED = "n * CAST(0.5 AS DOUBLE)"

EVIDENCE = f"""
evidence AS (
  SELECT job_id, candidate_id,
    CASE importance WHEN 'required' THEN 'required_skills' WHEN 'preferred' THEN 'preferred_skills'
      ELSE 'certifications' END AS component, term AS label,
    CASE WHEN status = 'matched' THEN 'Found in the resume (confidence ' || {_pct(_CONFIDENCE)} || ')'
        || CASE WHEN held IS NOT NULL THEN ', ~' || {_YEARS.format('(' + _CLAIMED + ')')} || ' years claimed' ELSE '' END
      WHEN status = 'weak' AND {_SIMILARITY} IS NOT NULL THEN
        'Not listed explicitly; the resume text is semantically similar (' || {_pct(_SIMILARITY)}
        || '), so this is unconfirmed'
      WHEN status = 'weak' THEN 'Mentioned in the resume with low confidence ('
        || {_pct(_CONFIDENCE)} || '); treat as unconfirmed'
      WHEN {_SIMILARITY} > 0 THEN 'No evidence of this skill (text similarity only ' || {_pct(_SIMILARITY)} || ')'
      ELSE 'No evidence of this skill was found in the resume' END AS detail,
    status,
    {o.r4("contribution / count(*) OVER (PARTITION BY job_id, candidate_id, importance)")} AS weight,
    CASE WHEN held IS NOT NULL THEN 'seen in ' || n || ' lines'
      WHEN importance = 'certification' AND status = 'matched' THEN 'Listed in the candidate''s certifications'
      END AS snippet
  FROM req_matches
  UNION ALL
  SELECT job_id, candidate_id, 'experience', 'Experience',
    CASE WHEN NOT required_years > 0 THEN 'This job does not state a minimum experience requirement'
      WHEN experience_score >= 0.999 THEN 'Meets or exceeds the required experience'
      WHEN experience_score <= 0.001 THEN 'No dated experience was detected in the resume'
      ELSE 'Meets approximately ' || {_pct('experience_score')} || ' of the required experience' END,
    CASE WHEN experience_score >= 0.999 THEN 'matched' WHEN experience_score <= 0.001 THEN 'missing'
      ELSE 'weak' END, CAST(0.2 AS DOUBLE), NULL FROM matches
  UNION ALL
  SELECT job_id, candidate_id, 'education', 'Education',
    CASE WHEN education_score >= 0.999 THEN 'Highest qualification meets or exceeds the requirement'
      WHEN education_score <= 0.001 THEN 'Highest qualification is below the stated requirement'
      ELSE 'Highest qualification is ' || {_pct('education_score')} || ' of the way to the requirement' END,
    CASE WHEN education_score >= 0.999 THEN 'matched' WHEN education_score <= 0.001 THEN 'missing'
      ELSE 'weak' END, CAST(0.15 AS DOUBLE), NULL FROM matches WHERE education_raw IS NOT NULL
  UNION ALL
  SELECT job_id, candidate_id, 'semantic', 'Semantic similarity',
    'Overall similarity between the job description and the resume is ' || {_pct('semantic_score')}
      || ' after rescaling.',
    CASE WHEN semantic_score >= 0.6 THEN 'matched' ELSE 'weak' END, CAST(0.1 AS DOUBLE), NULL
  FROM matches WHERE cosine IS NOT NULL)"""


@query(o.with_matches(
    "SELECT job_id, candidate_id, component, label, detail, status, weight, snippet FROM evidence", EVIDENCE))
def evidence_rows(spark, d):
    return ex.evidence_rows(t.scored_in_steps(spark, d)).drop("position")


@query(o.with_matches(
    """SELECT job_id, candidate_id, max(m.overall_score) AS overall_score, count(*) AS evidence_count,
      count(*) FILTER (e.status = 'matched') AS matched_rows,
      count(*) FILTER (e.status = 'weak') AS weak_rows,
      count(*) FILTER (e.status = 'missing') AS missing_rows
    FROM matches m JOIN evidence e USING (job_id, candidate_id) GROUP BY job_id, candidate_id""", EVIDENCE))
def match_detail(spark, d):
    """Every stored match with the shape of its evidence."""
    from ..operators import search as se

    scored = t.scored_in_steps(spark, d)
    details = se.match_details(
        m.match_results(scored).select("job_id", "candidate_id", "overall_score"),
        ex.evidence_rows(scored),
    )
    return details


_LIST = """
term_lists AS (
  SELECT job_id, candidate_id,
    coalesce(string_agg(term, ', ' ORDER BY position) FILTER (importance = 'required' AND status = 'matched'), '') AS strong,
    coalesce(string_agg(term, ', ' ORDER BY position) FILTER (importance = 'required' AND status = 'missing'), '') AS missing_terms,
    coalesce(string_agg(term, ', ' ORDER BY position) FILTER (importance = 'required' AND status = 'weak'), '') AS weak_terms,
    coalesce(string_agg(term, ', ' ORDER BY position) FILTER (importance = 'preferred' AND status = 'matched'), '') AS preferred_terms,
    coalesce(string_agg(term, ', ' ORDER BY position) FILTER (importance = 'certification' AND status = 'matched'), '') AS certified_terms
  FROM req_matches GROUP BY job_id, candidate_id)"""
_SUMMARY = f"{_pct('overall_score')} || ' overall match for ' || title || '.' || CASE WHEN n_required > 0 THEN ' ' || matched || ' of ' || n_required || ' required skills were found explicitly' ELSE '' END"
_HAVE = "round_even(required_years * experience_score, 1)"


@query(o.with_matches(
    f"""SELECT job_id, candidate_id, {_SUMMARY} AS summary, strong AS strong_matches,
      preferred_terms AS preferred_matches, missing_terms AS missing_required, weak_terms AS weak_signals,
      CASE WHEN required_years > 0 THEN CASE
        WHEN experience_score >= 0.999 THEN 'At least ' || {_YEARS.format('required_years')} || ' years of relevant experience detected'
        WHEN required_years * experience_score <= 0 THEN 'No dated experience could be parsed from the resume'
        ELSE 'Approximately ' || {_YEARS.format(_HAVE)} || ' years of relevant experience detected against '
          || {_YEARS.format('required_years')} || ' years required' END END AS experience_note,
      CASE WHEN education_required IS NULL THEN NULL
        WHEN education_raw IS NULL THEN 'This job asks for ' || education_required
          || ', but no qualification could be detected in the resume, so education did not affect the score.'
        WHEN education_score >= 0.999 THEN 'Qualification meets the ' || education_required || ' requirement'
        ELSE 'Detected qualification is below the ' || education_required || ' requirement' END AS education_note,
      CASE WHEN n_certification > 0 THEN CASE WHEN certified > 0 THEN 'Certifications matched: ' || certified_terms
        ELSE 'None of the preferred certifications were found' END END AS certification_note,
      CASE WHEN cosine IS NOT NULL THEN 'Resume and job description are ' || {_pct('semantic_score')}
        || ' similar overall after rescaling' END AS semantic_note,
      CAST((CASE WHEN education_raw IS NULL AND education_required IS NOT NULL THEN 1 ELSE 0 END)
        + (CASE WHEN cosine IS NULL THEN 1 ELSE 0 END) + (CASE WHEN n_required = 0 THEN 1 ELSE 0 END)
        + (CASE WHEN active_weight < 1 THEN 1 ELSE 0 END)
        + (CASE WHEN weak > 0 THEN 1 ELSE 0 END) + (CASE WHEN missing > 0 THEN 1 ELSE 0 END) AS BIGINT) AS notes
    FROM matches JOIN term_lists USING (job_id, candidate_id)""", _LIST))
def explanations(spark, d):
    rows = ex.explanations(t.scored_in_steps(spark, d))
    lists = ("strong_matches", "preferred_matches", "missing_required", "weak_signals")
    plain = ("summary", "experience_note", "education_note", "certification_note", "semantic_note")
    return rows.select(
        "job_id", "candidate_id",
        *[F.col(f"explanation.{c}").alias(c) for c in plain],
        *[F.array_join(F.col(f"explanation.{c}"), ", ").alias(c) for c in lists],
        F.size("explanation.notes").cast("bigint").alias("notes"),
    )


# -- rankings -----------------------------------------------------------------
def _rank_sql(column: str) -> str:
    return o.with_matches(
        f"""SELECT job_id, candidate_id, {column}, CAST(row_number() OVER (PARTITION BY job_id
          ORDER BY {column} DESC, overall_score DESC, candidate_id) AS BIGINT) AS rank FROM matches""")


def _stored(spark, d) -> DataFrame:
    """Scores written once: a ranking reads its input twice, for offsets and for rows."""
    return written(spark, t.match_results(spark, d).drop("weights"), "matches")


@query(_rank_sql("overall_score"))
def rank_candidates(spark, d):
    """Full ranking of every job by overall score, over the stored matches."""
    return rk.rank_candidates(_stored(spark, d)).select(
        "job_id", "candidate_id", "overall_score", "rank"
    )


@query(_rank_sql("experience_score"))
def rank_candidates_by_experience(spark, d):
    return rk.rank_candidates(_stored(spark, d), "experience").select(
        "job_id", "candidate_id", "experience_score", "rank"
    )


@query(o.with_matches(
    """SELECT job_id, candidate_id, full_name, overall_score, CAST(rank AS BIGINT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY required_skills_score DESC,
        overall_score DESC, candidate_id) AS rank FROM matches WHERE shortlisted)
    WHERE rank BETWEEN 6 AND 10"""))
def ranking_page(spark, d):
    """Second page of five shortlisted candidates per job, by required skills."""
    page = rk.load_rankings(
        t.match_results(spark, d), t.candidates(spark, d), "required_skills",
        shortlisted_only=True, page=2, page_size=5,
    )
    return page.select(
        "job_id", "candidate_id", "full_name", "overall_score", F.col("rank").cast("bigint").alias("rank")
    )


@query(o.with_matches("SELECT job_id, count(*) AS total FROM matches WHERE shortlisted GROUP BY job_id"))
def ranking_totals(spark, d):
    return rk.ranked_totals(t.match_results(spark, d), t.candidates(spark, d), shortlisted_only=True)


@query(o.with_matches(
    """SELECT job_id, candidate_id,
      CASE WHEN overall_score >= 0.85 THEN 'excellent' WHEN overall_score >= 0.7 THEN 'strong'
        WHEN overall_score >= 0.55 THEN 'moderate' WHEN overall_score >= 0.4 THEN 'weak' ELSE 'poor' END AS band,
      CASE WHEN overall_score >= 0.85 THEN 'excellent' WHEN overall_score >= 0.7 THEN 'good'
        WHEN overall_score >= 0.5 THEN 'fair' ELSE 'poor' END AS tone FROM matches"""))
def score_bands(spark, d):
    return t.match_results(spark, d).select(
        "job_id", "candidate_id", score_band("overall_score").alias("band"),
        score_tone("overall_score").alias("tone"),
    )


@query(o.with_matches(
    f"""SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY overall_score DESC, candidate_id) AS BIGINT) AS rank,
      candidate_id, full_name AS name, email, home AS location, current_title, total_experience_years,
      coalesce(highest_degree, '') AS highest_degree, shortlisted, required_skills_score AS required_skills,
      experience_score AS experience, education_score AS education,
      preferred_skills_score AS preferred_skills, semantic_score AS semantic,
      certifications_score AS certifications, overall_score, missing_terms AS missing_required,
      weak_terms AS weak_signals, {_SUMMARY} AS explanation_summary, strong AS matched_required
    FROM matches JOIN term_lists USING (job_id, candidate_id)""", _LIST))
def export_ranking(spark, d):
    explained = ex.explanations(t.scored_in_steps(spark, d), carry=rk.EXPORTED_SCORES)
    return rk.export_rows(explained, explained, t.candidates(spark, d))


# -- batches ------------------------------------------------------------------
def _existing(spark, d, other: DataFrame | None = None) -> DataFrame:
    """A store that holds a third of the matches under current and a third under old weights."""
    rows = t.match_results(spark, d).withColumn("_k", (F.col("job_id") + F.col("candidate_id")) % 3)
    old = F.struct(*[F.lit(CUSTOM[c]).alias(c) for c in lx.COMPONENTS])
    rows = rows.where("_k < 2").withColumn(
        "weights", F.when(F.col("_k") == 1, old).otherwise(F.col("weights"))
    ).drop("_k")
    return written(spark, rows, "stored-matches")


@query(o.with_matches(
    "SELECT job_id, candidate_id FROM pairs WHERE (job_id + candidate_id) % 3 <> 0"))
def pending_pairs(spark, d):
    """Applications without a result under the current weights."""
    return m.pending_pairs(t.eligible_applications(spark, d), _existing(spark, d))


@query(o.with_matches(
    """SELECT a.job_id, count(*) FILTER (k IN (1, 2)) AS analyzed, count(*) FILTER (k = 0) AS skipped,
      count(*) FILTER (k IS NULL) AS failed
    FROM apps a LEFT JOIN (SELECT job_id, candidate_id, (job_id + candidate_id) % 3 AS k FROM pairs) p
      ON a.job_id = p.job_id AND a.candidate_id = p.candidate_id
    GROUP BY a.job_id"""))
def score_all_outcomes(spark, d):
    """Batch over all applications: scored, skipped as unchanged, failed as not eligible."""
    existing = _existing(spark, d)
    done = m.score_all(t.eligible_applications(spark, d), *t.profiles(spark, d), existing)
    done = written(spark, done.select("job_id", "candidate_id"), "scored-pairs")
    return m.batch_outcomes(t.applications(spark, d), done, existing)


@query(o.with_matches(
    "SELECT job_id, count(*) AS stored, round(sum(overall_score), 4) AS total FROM matches GROUP BY job_id"))
def upsert_matches(spark, d):
    """The store after rescoring everything that was not current."""
    existing = _existing(spark, d).withColumn(
        "overall_score", F.when(F.col("weights.education") == 0.1, 0.0).otherwise(F.col("overall_score"))
    )
    done = m.score_all(t.eligible_applications(spark, d), *t.profiles(spark, d), existing)
    stored = m.upsert_matches(existing, m.match_results(done))
    return stored.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("stored"), F.round(F.sum("overall_score"), 4).alias("total")
    )


# -- comparison ---------------------------------------------------------------
_SETS = "SELECT c_custkey // 5 AS set_id, c_custkey AS candidate_id FROM customer"


def _sets(spark, d) -> DataFrame:
    """Neighbouring candidates in sets of five."""
    return t.table(spark, d, "customer").select(
        F.floor(F.col("c_custkey") / 5).alias("set_id"), F.col("c_custkey").alias("candidate_id")
    )


_LATEST = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY matched_on DESC, job_id DESC) AS rn
  FROM matches) WHERE rn = 1)"""


@query(o.with_matches(
    f"SELECT candidate_id, job_id, strftime(matched_on, '%Y-%m-%d') AS created_at, {SQL_SCORES} FROM latest", _LATEST))
def latest_match(spark, d):
    return cmp.latest_match(stored_matches(spark, d)).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd")
    ).select("candidate_id", "job_id", "created_at", *SCORES)


@query(o.with_matches(
    """, long AS (
      SELECT s.set_id, s.candidate_id, c.full_name, k.criterion,
        CASE k.criterion WHEN 'required_skills' THEN l.required_skills_score WHEN 'experience' THEN l.experience_score
          WHEN 'education' THEN CAST(c.degree_rank AS DOUBLE) WHEN 'preferred_skills' THEN l.preferred_skills_score
          WHEN 'semantic' THEN l.semantic_score ELSE l.certifications_score END AS value
      FROM (""" + _SETS + """) s JOIN cands c ON c.candidate_id = s.candidate_id
      CROSS JOIN (SELECT unnest(['required_skills','experience','education','preferred_skills','semantic','certifications']) AS criterion) k
      LEFT JOIN latest l ON l.candidate_id = s.candidate_id WHERE NOT c.is_deleted),
    marked AS (
      SELECT *, max(value) OVER w AS top, min(value) OVER w AS low, count(value) OVER w AS known, count(*) OVER w AS members
      FROM long WINDOW w AS (PARTITION BY set_id, criterion)),
    led AS (SELECT *, coalesce(value >= top, false) AS leads FROM marked)
    SELECT CAST(set_id AS BIGINT) AS set_id, criterion,
      CASE criterion WHEN 'required_skills' THEN 'Required skills' WHEN 'experience' THEN 'Experience'
        WHEN 'education' THEN 'Education' WHEN 'preferred_skills' THEN 'Preferred skills'
        WHEN 'semantic' THEN 'Semantic similarity' ELSE 'Certifications' END AS label,
      candidate_id, full_name, value,
      leads AND count(*) FILTER (leads) OVER (PARTITION BY set_id, criterion) < members AS is_best,
      CASE WHEN known < 2 THEN 'Not available for every candidate'
        WHEN criterion = 'education' THEN 'Ordinal scale: higher means a higher qualification'
        WHEN top - low < 0.05 THEN 'Effectively equal' WHEN top - low < 0.2 THEN 'Small difference'
        WHEN top - low < 0.5 THEN 'Clear difference' ELSE 'Large difference' END AS note
    FROM led""".replace(", long AS", ", long AS", 1), _LATEST).replace("rn = 1)\n, long", "rn = 1), long"))
def compare_candidates(spark, d):
    return cmp.compare_candidates(_sets(spark, d), t.candidates(spark, d), stored_matches(spark, d))


@query(o.with_candidates(
    "SELECT CAST(candidate_id // 5 AS BIGINT) AS set_id, candidate_id FROM cands WHERE is_deleted"))
def unknown_compared_candidates(spark, d):
    return cmp.unknown_candidates(_sets(spark, d), t.candidates(spark, d))


@query(o.with_base(
    f"""SELECT CAST(s.set_id AS BIGINT) AS set_id, brand AS skill,
      (SELECT count(*) FROM ({_SETS}) x WHERE x.set_id = s.set_id) AS members,
      count(*) AS held, string_agg(CAST(candidate_id AS VARCHAR), ',' ORDER BY candidate_id) AS holders
    FROM ({_SETS}) s JOIN holdings USING (candidate_id) GROUP BY s.set_id, brand"""))
def skills_matrix(spark, d):
    matrix = cmp.skills_matrix(_sets(spark, d), t.candidate_skills(spark, d), t.skills(spark, d))
    holders = F.transform(
        F.filter(F.arrays_zip("members", "held"), lambda e: e["held"]), lambda e: e["members"].cast("string")
    )
    return matrix.select(
        "set_id", "skill", F.size("members").cast("bigint").alias("members"),
        F.size(holders).cast("bigint").alias("held"), F.array_join(holders, ",").alias("holders"),
    )


# -- weights ------------------------------------------------------------------
def _profiles(spark, d) -> DataFrame:
    """A weight profile per supplier, payloads partly incomplete, unnormalised or corrupt."""
    s = t.table(spark, d, "supplier")
    key = F.col("s_suppkey")
    payload = (
        F.when(key % 4 == 0, F.lit('{"required_skills":0.4,"experience":0.2}'))
        .when(key % 4 == 1, F.concat(F.lit('{"required_skills":'), (key % 7).cast("string"), F.lit(',"semantic":0.3}')))
        .when(key % 4 == 2, F.lit("{broken"))
        .otherwise(F.lit(
            '{"required_skills":0,"experience":0,"education":0,"preferred_skills":0,"semantic":0,"certifications":0}'))
    )
    return s.select(F.col("s_name").alias("name"), payload.alias("payload"), (key == 1).alias("is_default"))


@query("""
WITH w AS (SELECT s_name AS name, s_suppkey = 1 AS is_default,
    CASE s_suppkey % 4 WHEN 1 THEN CAST(s_suppkey % 7 AS DOUBLE) WHEN 3 THEN CAST(0 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS required_skills,
    CASE WHEN s_suppkey % 4 = 3 THEN CAST(0 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS experience,
    CASE WHEN s_suppkey % 4 = 3 THEN CAST(0 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END AS education,
    CASE WHEN s_suppkey % 4 = 3 THEN CAST(0 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS preferred_skills,
    CASE s_suppkey % 4 WHEN 1 THEN CAST(0.3 AS DOUBLE) WHEN 3 THEN CAST(0 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS semantic,
    CASE WHEN s_suppkey % 4 = 3 THEN CAST(0 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END AS certifications
  FROM supplier),
s AS (SELECT *, required_skills + experience + education + preferred_skills + semantic + certifications AS total FROM w)
SELECT name, is_default,
  round(CASE WHEN total <= 0 THEN 0.4 WHEN abs(total - 1) > 0.001 THEN required_skills / total ELSE required_skills END, 6) AS required_skills,
  round(CASE WHEN total <= 0 THEN 0.2 WHEN abs(total - 1) > 0.001 THEN experience / total ELSE experience END, 6) AS experience,
  round(CASE WHEN total <= 0 THEN 0.15 WHEN abs(total - 1) > 0.001 THEN education / total ELSE education END, 6) AS education,
  round(CASE WHEN total <= 0 THEN 0.1 WHEN abs(total - 1) > 0.001 THEN preferred_skills / total ELSE preferred_skills END, 6) AS preferred_skills,
  round(CASE WHEN total <= 0 THEN 0.1 WHEN abs(total - 1) > 0.001 THEN semantic / total ELSE semantic END, 6) AS semantic,
  round(CASE WHEN total <= 0 THEN 0.05 WHEN abs(total - 1) > 0.001 THEN certifications / total ELSE certifications END, 6) AS certifications
FROM s""")
def resolve_weight_profiles(spark, d):
    out = wt.effective_weights(_profiles(spark, d))
    return out.select("name", "is_default", *[F.round(c, 6).alias(c) for c in lx.COMPONENTS])


@query("SELECT s_name AS name, s_name = 'Supplier#000000003' AS is_default FROM supplier")
def single_default_profile(spark, d):
    return wt.single_default(_profiles(spark, d), "Supplier#000000003").select("name", "is_default")


# -- dashboard ----------------------------------------------------------------
@query(o.with_matches(
    """SELECT count(*) FILTER (NOT is_deleted) AS total_candidates,
      count(*) FILTER (NOT is_deleted AND status = 'parsed') AS candidates_processed,
      count(*) FILTER (NOT is_deleted AND status = 'failed') AS failed_processing,
      count(*) FILTER (NOT is_deleted AND shortlisted) AS shortlisted_candidates,
      (SELECT count(*) FROM jobs WHERE is_active) AS active_jobs,
      (SELECT count(*) FROM skills) AS total_skills,
      (SELECT round(avg(overall_score), 4) FROM matches) AS average_match_score
    FROM cands"""))
def dashboard_stats(spark, d):
    return dash.dashboard_stats(
        t.candidates(spark, d), t.jobs(spark, d), t.skills(spark, d), t.match_results(spark, d)
    )


@query(o.with_matches(
    """SELECT j.job_id, j.title AS job_title, count(m.job_id) AS candidate_count,
      round(coalesce(avg(m.overall_score), 0), 4) AS average_score
    FROM jobs j LEFT JOIN matches m ON m.job_id = j.job_id WHERE j.is_active
    GROUP BY j.job_id, j.title ORDER BY candidate_count DESC, job_title LIMIT 20"""))
def candidates_per_job(spark, d):
    return dash.candidates_per_job(t.jobs(spark, d), t.match_results(spark, d))


_BUCKET = """CASE WHEN overall_score < 0.2 THEN '0-20' WHEN overall_score < 0.4 THEN '20-40'
  WHEN overall_score < 0.6 THEN '40-60' WHEN overall_score < 0.8 THEN '60-80' ELSE '80-100' END"""


@query(o.with_matches(
    f"""SELECT b.bucket, count(m.job_id) AS count
    FROM (SELECT unnest(['0-20', '20-40', '40-60', '60-80', '80-100']) AS bucket) b
    LEFT JOIN (SELECT job_id, {_BUCKET} AS bucket FROM matches) m ON m.bucket = b.bucket GROUP BY b.bucket"""))
def score_distribution(spark, d):
    return dash.score_distribution(t.match_results(spark, d))


@query(o.with_matches(
    f"""SELECT j.job_id, b.bucket, count(m.job_id) AS count
    FROM (SELECT DISTINCT job_id FROM matches) j
    CROSS JOIN (SELECT unnest(['0-20', '20-40', '40-60', '60-80', '80-100']) AS bucket) b
    LEFT JOIN (SELECT job_id, {_BUCKET} AS bucket FROM matches) m ON m.bucket = b.bucket AND m.job_id = j.job_id
    GROUP BY j.job_id, b.bucket"""))
def score_distribution_per_job(spark, d):
    return dash.score_distribution(t.match_results(spark, d), per_job=True)


@query(o.with_base(
    """SELECT s.normalized_name, s.name AS skill, s.category, count(*) AS count
    FROM skills s JOIN holdings h ON h.normalized_name = s.normalized_name
    JOIN cands c ON c.candidate_id = h.candidate_id WHERE NOT c.is_deleted
    GROUP BY s.normalized_name, s.name, s.category ORDER BY count DESC, skill LIMIT 15"""))
def top_skills(spark, d):
    return dash.top_skills(t.skills(spark, d), t.candidate_skills(spark, d), t.candidates(spark, d))


@query(o.with_matches(
    """SELECT r.job_id, r.term AS skill, count(*) AS missing_count
    FROM req_matches r JOIN best b ON b.job_id = r.job_id AND b.candidate_id = r.candidate_id
    WHERE importance = 'required' AND status = 'missing' AND b.rn <= 200
    GROUP BY r.job_id, r.term ORDER BY missing_count DESC, job_id, skill LIMIT 15""",
    """
best AS MATERIALIZED (SELECT job_id, candidate_id,
    row_number() OVER (ORDER BY overall_score DESC, job_id, candidate_id) AS rn FROM matches)"""))
def most_missing_skills(spark, d):
    return dash.most_missing_skills(t.scored(spark, d), t.candidates(spark, d), top_n=200)


@query(o.with_matches(
    """SELECT job_id, term AS skill, count(*) AS missing_count FROM req_matches
    WHERE importance = 'required' AND status = 'missing'
    GROUP BY job_id, term ORDER BY missing_count DESC, job_id, skill LIMIT 15"""))
def most_missing_skills_over_all(spark, d):
    return dash.most_missing_skills(t.scored(spark, d), t.candidates(spark, d))


@query(o.with_base(
    """SELECT c.candidate_id, c.full_name, c.current_title, c.status, c.total_experience_years, c.shortlisted,
      strftime(c.created_at, '%Y-%m-%d') AS created_at, (SELECT count(*) FROM holdings h WHERE h.candidate_id = c.candidate_id) AS skill_count
    FROM cands c WHERE NOT c.is_deleted ORDER BY c.created_at DESC NULLS LAST, c.candidate_id LIMIT 10"""))
def recent_candidates(spark, d):
    return dash.recent_candidates(t.candidates(spark, d), t.candidate_skills(spark, d)).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd")
    )


@query(o.with_base(
    """SELECT 'Candidates' AS metric, count(*) FILTER (NOT is_deleted) AS value FROM cands
    UNION ALL SELECT 'Parsed', count(*) FILTER (NOT is_deleted AND status = 'parsed') FROM cands
    UNION ALL SELECT 'Active jobs', count(*) FILTER (is_active) FROM jobs
    UNION ALL SELECT 'Taxonomy skills', count(*) FROM skills"""))
def counts(spark, d):
    return dash.counts(t.candidates(spark, d), t.jobs(spark, d), t.skills(spark, d))


@query(o.with_matches(
    """SELECT job_id, count(*) AS scored, round(avg(overall_score), 4) AS average,
      round(avg(required_skills_score), 4) AS required_skill_average
    FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY overall_score DESC, candidate_id) AS rn FROM matches)
    WHERE rn <= 25 GROUP BY job_id"""))
def aggregate_context_scores(spark, d):
    best = rk.top_candidates(t.match_results(spark, d), 25)
    return dash.aggregate_context(
        t.candidates(spark, d), t.candidate_skills(spark, d), t.skills(spark, d), best
    )[1]


@query(o.with_base(
    """SELECT s.name AS skill, count(*) AS candidates
    FROM skills s JOIN holdings h ON h.normalized_name = s.normalized_name
    JOIN cands c ON c.candidate_id = h.candidate_id WHERE NOT c.is_deleted
    GROUP BY s.name ORDER BY candidates DESC, skill LIMIT 20"""))
def aggregate_context_skills(spark, d):
    best = rk.top_candidates(t.match_results(spark, d), 25)
    return dash.aggregate_context(
        t.candidates(spark, d), t.candidate_skills(spark, d), t.skills(spark, d), best
    )[0]
