"""Registered queries: filters, lookups, projections, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.questions import classify_intent, named_candidates, sort_hint
from ..operators import assistant as ai
from ..operators import catalogue as cat
from ..operators import explain as ex
from ..operators import ranking as rk
from ..operators import search as se
from ..operators import vectors as vec
from ..session import written
from . import driver_tables as t
from . import oracle_relations as o
from .registry import query


@query(o.with_base(
    """SELECT job_id, title, department, location, required_years, education_required, is_active,
      strftime(created_at, '%Y-%m-%d') AS created_at, required_skills, preferred_skills FROM jobs"""))
def typed_jobs(spark, d):
    """Job rows with their native types."""
    return t.jobs(spark, d).select(
        "job_id", "title", "department", "location",
        F.col("experience_required_years").alias("required_years"), "education_required", "is_active",
        F.date_format("created_at", "yyyy-MM-dd").alias("created_at"),
        F.array_join("required_skills", ", ").alias("required_skills"),
        F.array_join("preferred_skills", ", ").alias("preferred_skills"),
    )


_SEARCH = """NOT is_deleted AND (contains(lower(full_name), 'machinery') OR contains(lower(email), 'machinery')
  OR contains(lower(current_title), 'machinery') OR contains(lower(location), 'machinery'))
  AND contains(lower(location), 'nation_1') AND total_experience_years BETWEEN 3 AND 6"""


def _searched(spark, d) -> DataFrame:
    return se.search_candidates(
        t.candidates(spark, d), search="Machinery", location="nation_1", min_experience=3, max_experience=6
    )


@query(o.with_candidates(f"SELECT candidate_id, full_name, location, total_experience_years FROM cands WHERE {_SEARCH}"))
def search_candidates(spark, d):
    return _searched(spark, d).select("candidate_id", "full_name", "location", "total_experience_years")


@query(o.with_candidates(f"SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM cands WHERE {_SEARCH}"))
def search_page_info(spark, d):
    return rk.page_info(_searched(spark, d))


@query(o.with_candidates(
    """SELECT candidate_id, strftime(created_at, '%Y-%m-%d') AS created_at FROM cands WHERE NOT is_deleted
    ORDER BY cands.created_at DESC NULLS LAST, candidate_id LIMIT 20 OFFSET 20"""))
def search_second_page(spark, d):
    page = rk.paginate(
        se.search_candidates(t.candidates(spark, d)),
        [F.col("created_at").desc(), F.col("candidate_id").asc()], 2, 20,
    )
    return page.select("candidate_id", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))


@query(o.with_candidates(
    """SELECT candidate_id FROM cands WHERE NOT is_deleted AND shortlisted
      AND contains(lower(certification), 'brand#2') AND contains(lower(highest_degree), 'science')"""))
def search_by_certification_and_degree(spark, d):
    return se.search_candidates(
        t.candidates(spark, d), certification="Brand#2", education="Science", shortlisted_only=True
    ).select("candidate_id")


@query(o.with_base(
    """SELECT candidate_id FROM cands WHERE NOT is_deleted AND candidate_id IN (
      SELECT candidate_id FROM holdings WHERE normalized_name IN ('brand#3', 'brand#7')
      GROUP BY candidate_id HAVING count(DISTINCT normalized_name) = 2)"""))
def search_by_all_skills(spark, d):
    return se.search_candidates(
        t.candidates(spark, d), skills=["Brand#3", " brand#7 "], candidate_skills=t.candidate_skills(spark, d)
    ).select("candidate_id")


@query(o.with_base(
    """SELECT candidate_id FROM holdings WHERE normalized_name IN ('brand#3', 'brand#7')
    GROUP BY candidate_id HAVING count(DISTINCT normalized_name) = 2"""))
def search_by_skill_alias(spark, d):
    """Wanted skills written as catalogue aliases and plurals."""
    return se.has_all_skills(
        t.candidate_skills(spark, d), ["brand no 3s", "Brand#7"], cat.alias_table(t.skills(spark, d))
    )


@query(o.with_candidates("SELECT candidate_id FROM cands WHERE NOT is_deleted AND status = 'parsed'"))
def eligible_candidates(spark, d):
    from ..operators.matching import eligible_candidates as eligible

    return eligible(t.candidates(spark, d)).select("candidate_id")


@query(o.with_base(
    """SELECT job_id, title, department FROM jobs WHERE is_active
      AND (contains(lower(title), 'asia') OR contains(lower(department), 'asia'))"""))
def list_jobs(spark, d):
    return se.list_jobs(t.jobs(spark, d), search=" asia ").select("job_id", "title", "department")


@query("WITH " + o.SKILLS + " SELECT normalized_name, name FROM skills WHERE contains(lower(name), 'brand#1')")
def list_skills(spark, d):
    return se.list_skills(t.skills(spark, d), search="Brand#1", limit=None).select("normalized_name", "name")


def audit_rows(spark, d) -> DataFrame:
    return t.table(spark, d, "events").select(
        F.col("event_id").alias("audit_id"), F.col("ts").alias("created_at"), "user_id",
        F.col("event_type").alias("action"), F.col("props").alias("detail"),
    )


@query("""SELECT event_id AS audit_id, user_id, event_type AS action FROM events WHERE event_type = 'purchase'
""")
def audit_log(spark, d):
    return se.audit_log(audit_rows(spark, d), action="purchase", limit=None).select("audit_id", "user_id", "action")


@query(o.with_base(
    """SELECT c.candidate_id, c.full_name, coalesce(top_skills, '') AS top_skills FROM cands c LEFT JOIN (
      SELECT candidate_id, string_agg(brand, ', ' ORDER BY rn) AS top_skills FROM (
        SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY confidence DESC, brand) AS rn FROM holdings)
      WHERE rn <= 8 GROUP BY candidate_id) s USING (candidate_id) WHERE NOT c.is_deleted"""))
def candidate_summaries(spark, d):
    return se.candidate_summary(
        t.candidates(spark, d), t.candidate_skills(spark, d), t.skills(spark, d)
    ).select("candidate_id", "full_name", F.array_join("top_skills", ", ").alias("top_skills"))


@query(o.with_base(
    """SELECT c.candidate_id, c.email, coalesce(s.skills, 0) AS skills, coalesce(s.listing, '') AS listing
    FROM cands c LEFT JOIN (SELECT candidate_id, count(*) AS skills,
      string_agg(h.normalized_name || '=' || CAST(n AS VARCHAR), ';' ORDER BY h.normalized_name) AS listing
      FROM holdings h GROUP BY candidate_id) s USING (candidate_id)"""))
def candidate_profiles(spark, d):
    """Nested skills, flattened for comparison."""
    rows = se.full_profiles(t.candidates(spark, d), t.candidate_skills(spark, d), t.skills(spark, d))
    listing = F.array_join(
        F.transform(
            "skills",
            lambda s: F.concat(s["normalized_name"], F.lit("="), (s["years_experience"] * 2).cast("bigint").cast("string")),
        ),
        ";",
    )
    return rows.select(
        "candidate_id", "email",
        F.when(F.col("skills").isNull(), 0).otherwise(F.size("skills")).cast("bigint").alias("skills"),
        F.coalesce(listing, F.lit("")).alias("listing"),
    )


@query("WITH " + o.REQUIREMENTS + """ SELECT job_id, importance, term,
  CAST(row_number() OVER (PARTITION BY job_id, importance ORDER BY position) AS BIGINT) AS position FROM reqs""")
def job_requirements(spark, d):
    return se.job_requirements(t.jobs(spark, d)).withColumn("position", F.col("position").cast("bigint"))


def _asked_names(spark, d) -> DataFrame:
    return t.table(spark, d, "nation").select(F.concat(F.lit("#0000000"), F.col("n_nationkey").cast("string")).alias("name"))


@query(o.with_candidates(
    """SELECT a.name, min(c.candidate_id) AS candidate_id, min(c.full_name) AS full_name
    FROM (SELECT '#0000000' || n_nationkey AS name FROM nation) a
    JOIN cands c ON contains(c.full_name, a.name) WHERE NOT c.is_deleted GROUP BY a.name"""))
def find_candidates_by_name(spark, d):
    return se.find_by_name(t.candidates(spark, d), _asked_names(spark, d))


# -- questions ----------------------------------------------------------------
_TEXTS = (
    "Show the top candidates for {}", "Who is missing skills for {}?", "Which are shortlisted for {}",
    "compare Customer#000000007 and Customer#000000011", "who is 'Customer#000000012'",
    "Summarise the job {}", "How many people are there",
)


def questions(spark, d) -> DataFrame:
    """One question per supplier, over the seven intents."""
    title = F.col("s_name")
    text = None
    for i, template in enumerate(_TEXTS):
        before, *after = template.split("{}")
        value = F.concat(F.lit(before), title, F.lit(after[0])) if after else F.lit(before)
        test = F.col("s_suppkey") % 7 == i
        text = F.when(test, value) if text is None else text.when(test, value)
    return t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("question_id"), text.alias("text"))


_QUESTIONS = "questions AS MATERIALIZED (SELECT s_suppkey AS question_id, s_suppkey % 7 AS kind, s_name FROM supplier)"


@query("WITH " + o.BASE + "," + _QUESTIONS + """
  SELECT question_id, CASE kind WHEN 0 THEN 'top_candidates' WHEN 1 THEN 'missing_skills' WHEN 2 THEN 'shortlist'
      WHEN 3 THEN 'compare' WHEN 4 THEN 'candidate_detail' WHEN 5 THEN 'job_summary' ELSE 'counts' END AS intent,
    CASE kind WHEN 1 THEN 'required_skills' ELSE 'overall' END AS sort_by,
    CASE kind WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS names,
    CASE WHEN kind NOT IN (3, 4, 6) AND is_active THEN job_id END AS resolved_job_id
  FROM questions JOIN jobs ON job_id = question_id""")
def read_questions(spark, d):
    read = ai.read_questions(questions(spark, d), t.jobs(spark, d))
    return read.select("question_id", "intent", "sort_by", F.size("names").alias("names"), "resolved_job_id")


@query(o.with_matches(
    """SELECT question_id, r.job_id AS resolved_job_id, CAST(r.rn AS BIGINT) AS rank, r.candidate_id, r.overall_score
    FROM questions q JOIN jobs j ON j.job_id = q.question_id AND j.is_active AND q.kind = 0
    JOIN (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY overall_score DESC, candidate_id) AS rn FROM matches) r
      ON r.job_id = j.job_id WHERE r.rn <= 10""", "\n" + _QUESTIONS))
def answer_top_candidates(spark, d):
    read = ai.read_questions(questions(spark, d), t.jobs(spark, d))
    rankable = rk_rows(spark, d)
    return ai.top_answer(read, rankable).select(
        "question_id", "resolved_job_id", F.col("rank").cast("bigint").alias("rank"), "candidate_id", "overall_score"
    )


def rk_rows(spark, d) -> DataFrame:
    """Stored matches with the candidate columns an answer shows."""
    return t.match_results(spark, d).join(
        t.candidates(spark, d).where("NOT is_deleted").select("candidate_id", "full_name", "shortlisted"),
        "candidate_id",
    )


@query(o.with_matches(
    """SELECT question_id, r.job_id, r.candidate_id, CAST(r.rn AS BIGINT) AS rank,
      coalesce(l.missing_terms, 'none') AS missing_required, coalesce(l.weak_terms, 'none') AS weak_signals
    FROM questions q JOIN jobs j ON j.job_id = q.question_id AND j.is_active AND q.kind = 1
    JOIN (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY required_skills_score DESC, overall_score DESC, candidate_id) AS rn FROM matches) r
      ON r.job_id = j.job_id
    LEFT JOIN (SELECT job_id, candidate_id,
        string_agg(term, ', ' ORDER BY position) FILTER (importance = 'required' AND status = 'missing') AS missing_terms,
        string_agg(term, ', ' ORDER BY position) FILTER (importance = 'required' AND status = 'weak') AS weak_terms
      FROM req_matches GROUP BY job_id, candidate_id) l ON l.job_id = r.job_id AND l.candidate_id = r.candidate_id
    WHERE r.rn <= 10""", "\n" + _QUESTIONS))
def answer_missing_skills(spark, d):
    read = ai.read_questions(questions(spark, d), t.jobs(spark, d))
    scores = ("required_skills_score", "overall_score")
    told = F.struct("explanation.missing_required", "explanation.weak_signals").alias("explanation")
    # Read for the ranks and for the texts of the best: scored once, written once.
    explained = ex.explanations(t.scored_in_steps(spark, d), carry=scores).select("job_id", "candidate_id", *scores, told)
    explained = written(spark, explained, "explained")
    names = t.candidates(spark, d).select("candidate_id", "full_name")
    rankable = explained.select("job_id", "candidate_id", *scores).join(names, "candidate_id")
    return ai.missing_answer(read, rankable, explained).select(
        "question_id", "job_id", "candidate_id", F.col("rank").cast("bigint").alias("rank"),
        "missing_required", "weak_signals",
    )


@query(o.with_base(
    """SELECT candidate_id, full_name, current_title, total_experience_years,
      coalesce((SELECT string_agg(brand, ', ' ORDER BY rn) FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id
        ORDER BY confidence DESC, brand) AS rn FROM holdings) h WHERE h.candidate_id = c.candidate_id AND rn <= 6), '-') AS top_skills
    FROM (SELECT * FROM cands WHERE NOT is_deleted AND shortlisted ORDER BY updated_at DESC NULLS LAST, candidate_id LIMIT 10) c"""))
def answer_shortlist(spark, d):
    return ai.shortlist_answer(t.candidates(spark, d), t.candidate_skills(spark, d), t.skills(spark, d))


@query("WITH " + o.BASE + "," + _QUESTIONS + """
  SELECT question_id AS set_id, candidate_id FROM questions JOIN cands ON candidate_id IN (7, 11)
  WHERE kind = 3 AND NOT is_deleted""")
def answer_compare_sets(spark, d):
    read = ai.read_questions(questions(spark, d), t.jobs(spark, d))
    return ai.compare_sets(read, t.candidates(spark, d))


@query("WITH " + o.BASE + "," + _QUESTIONS + """
  SELECT question_id, candidate_id, full_name || ': ' || current_title || ', '
    || CASE WHEN total_experience_years = floor(total_experience_years)
        THEN CAST(CAST(total_experience_years AS BIGINT) AS VARCHAR) ELSE CAST(total_experience_years AS VARCHAR) END
    || ' years total experience, ' || (SELECT count(*) FROM holdings h WHERE h.candidate_id = 12) || ' skills on file.' AS answer
  FROM questions JOIN cands ON candidate_id = 12 WHERE kind = 4""")
def answer_candidate_detail(spark, d):
    from .queries_matching import stored_matches

    read = ai.read_questions(questions(spark, d), t.jobs(spark, d))
    return ai.candidate_answer(
        read, t.candidates(spark, d), stored_matches(spark, d), t.candidate_skills(spark, d)
    ).select("question_id", "candidate_id", "answer")


@query(o.with_matches(
    """SELECT question_id, j.job_id, title || ' needs ' || CAST(CAST(required_years AS BIGINT) AS VARCHAR)
      || ' years of experience and ' || n_required || ' required skills. ' || coalesce(s.n, 0)
      || ' candidate(s) scored so far.' AS answer
    FROM questions q JOIN jobs j ON j.job_id = q.question_id AND j.is_active AND q.kind = 5
    LEFT JOIN (SELECT job_id, count(*) AS n FROM matches GROUP BY job_id) s ON s.job_id = j.job_id""", "\n" + _QUESTIONS))
def answer_job_summary(spark, d):
    read = ai.read_questions(questions(spark, d), t.jobs(spark, d))
    return ai.job_answer(read, t.jobs(spark, d), t.match_results(spark, d)).select("question_id", "job_id", "answer")


@query("""SELECT conv_id, turn,
  CASE WHEN regexp_matches(text, '(?i)\\btop\\b|\\bbest\\s+match|\\bhighest\\s+match|\\brank(?:ed|ing)?\\b') THEN 'top_candidates'
    WHEN regexp_matches(text, '(?i)\\bmissing\\b|\\black(?:s|ing)?\\b|\\bdon''?t have\\b|\\bwithout\\b|\\bgap\\b') THEN 'missing_skills'
    WHEN regexp_matches(text, '(?i)\\bshortlist|\\bshortlisted\\b') THEN 'shortlist'
    WHEN regexp_matches(text, '(?i)\\bcompare\\b|\\bversus\\b|\\bvs\\.?\\b|\\bdifference\\b') THEN 'compare'
    WHEN regexp_matches(text, '(?i)\\bwho is\\b|\\bprofile\\b|\\bresume\\b|\\bcandidate\\b') THEN 'candidate_detail'
    WHEN regexp_matches(text, '(?i)\\bjob\\b|\\brole\\b|\\bposition\\b|\\brequirement') THEN 'job_summary'
    WHEN regexp_matches(text, '(?i)\\bhow many\\b|\\bcount\\b|\\bnumber of\\b|\\btotal\\b') THEN 'counts' END AS intent
  FROM conversations""")
def classify_conversation_intents(spark, d):
    return t.table(spark, d, "conversations").select("conv_id", "turn", classify_intent("text").alias("intent"))


def sort_and_names(spark, d):
    """Sort field and names of every conversation turn."""
    return t.table(spark, d, "conversations").select(
        "conv_id", "turn", sort_hint("text").alias("sort_by"),
        F.array_join(named_candidates("text"), "|").alias("names"),
    )


query()(sort_and_names)


@query("WITH " + o.SKILLS + """ SELECT p_partkey, p_brand AS term, lower(p_brand) AS normalized_name, lower(c) AS category, p_brand AS display_name
  FROM part JOIN (SELECT p_brand AS b, min(p_type) AS c FROM part GROUP BY p_brand) ON b = p_brand
  UNION ALL SELECT p_partkey, p_name || 's', replace(p_name || 's', ' ', '_'), 'other', p_name || 's' FROM part""")
def resolve_skill_terms(spark, d):
    """Known names and unknown terms against the catalogue."""
    part = t.table(spark, d, "part")
    terms = part.select("p_partkey", F.col("p_brand").alias("term")).unionByName(
        part.select("p_partkey", F.concat("p_name", F.lit("s")).alias("term"))
    )
    return cat.resolve_terms(terms, "term", cat.alias_table(t.skills(spark, d)))


@query("WITH " + o.SKILLS + """ SELECT normalized_name, name,
    CASE WHEN category IN ('programming_language','framework','database','cloud','ai_ml','devops','data_science','frontend','mobile','testing','soft_skill','certification') THEN category ELSE 'other' END AS category FROM skills
  UNION ALL SELECT replace(p_name, ' ', '_'), p_name, 'other' FROM part GROUP BY p_name""")
def skill_catalogue(spark, d):
    return cat.skill_catalogue(t.skills(spark, d), t.table(spark, d, "part").select("p_name"), "p_name").select(
        "normalized_name", "name", "category"
    )


@query("WITH " + o.REQUIREMENTS + """ SELECT job_id, lower(term) AS normalized_name, importance FROM reqs WHERE importance <> 'certification'""")
def job_skills(spark, d):
    return cat.job_skills(t.jobs(spark, d), cat.alias_table(t.skills(spark, d))).select("job_id", "normalized_name", "importance")


@query("""SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def latest_orders(spark, d):
    """The three newest orders of every customer."""
    orders = t.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return se.latest_rows(orders, ["o_custkey"], "o_orderdate", "o_orderkey", 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_orders(spark, d):
    """The first order of every customer."""
    return se.first_seen(t.table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25")
def oldest_customers(spark, d):
    """The page of the 25 oldest rows."""
    return se.oldest(t.table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 25)


@query("""SELECT vec_id, left(sha256('local:hash:64'), 16) AS signature, len(embedding) = 64 AS fits FROM embeddings""")
def embedder_signatures(spark, d):
    """Which stored vectors fit the configured embedder."""
    wanted = F.array_repeat(F.lit(0.0), 64)
    return t.table(spark, d, "embeddings").select(
        "vec_id", vec.embedder_signature("local", "hash", 64).alias("signature"),
        vec.compatible(F.col("embedding"), wanted).alias("fits"),
    )
