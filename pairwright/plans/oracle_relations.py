"""The table bindings in SQL, written independently of the DataFrame versions."""

from __future__ import annotations

R4 = "round(({}) + 1e-9, 4)"


def r4(expression: str) -> str:
    return R4.format(expression)


CANDIDATES = """
span AS MATERIALIZED (
  SELECT o_custkey AS candidate_id, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order
  FROM orders GROUP BY o_custkey),
people AS MATERIALIZED (
  SELECT c.*, n.n_name, s.first_order, s.last_order,
    round(coalesce((year(last_order) * 12 + month(last_order))
      - (year(first_order) * 12 + month(first_order)), 0) / CAST(12 AS DOUBLE), 2) AS total_years
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN span s ON s.candidate_id = c.c_custkey),
cands AS MATERIALIZED (
  SELECT c_custkey AS candidate_id, c_name AS full_name,
    lower(replace(c_name, '#', '.')) || '@' || lower(replace(n_name, ' ', '-')) || '.example' AS email,
    n_name AS location, c_mktsegment AS current_title,
    total_years AS total_experience_years,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(0 AS DOUBLE)
      ELSE round(total_years * CAST(0.8 AS DOUBLE), 2) END AS relevant_experience_years,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'B.S. Computer Science'
      WHEN 'BUILDING' THEN 'M.S. Data Science' WHEN 'FURNITURE' THEN 'Diploma in Electronics'
      WHEN 'MACHINERY' THEN 'Ph.D. Physics' END AS highest_degree,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 4 WHEN 'BUILDING' THEN 5 WHEN 'FURNITURE' THEN 2
      WHEN 'MACHINERY' THEN 6 ELSE 0 END AS degree_rank,
    'Brand#' || (c_nationkey + 1) || ' Certified' AS certification,
    CASE WHEN c_acctbal < 0 THEN 'failed' ELSE 'parsed' END AS status,
    c_acctbal >= 0 AS is_parsed, c_acctbal > 8000 AS shortlisted, c_custkey % 50 = 0 AS is_deleted,
    first_order AS created_at, last_order AS updated_at, c_nationkey
  FROM people)"""

HOLDINGS = """
order_lines AS MATERIALIZED (
  SELECT o.o_custkey, l.l_suppkey, l.l_orderkey, l.l_linenumber, p.p_brand
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey),
holdings AS MATERIALIZED (
  SELECT o_custkey AS candidate_id, p_brand AS brand, lower(p_brand) AS normalized_name,
    count(*) AS n,
    least(CAST(0.95 AS DOUBLE), round(CAST(0.4 AS DOUBLE) + CAST(0.1 AS DOUBLE) * count(*), 2))
      AS confidence
  FROM order_lines GROUP BY o_custkey, p_brand)"""

SKILLS = """
skills AS MATERIALIZED (
  SELECT lower(p_brand) AS normalized_name, p_brand AS name, lower(min(p_type)) AS category
  FROM part GROUP BY p_brand)"""

REQUIREMENTS = """
brand_counts AS MATERIALIZED (
  SELECT l_suppkey AS job_id, p_brand AS term, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand),
ranked_brands AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, term) AS position
  FROM brand_counts),
reqs AS MATERIALIZED (
  SELECT job_id, term, position,
    CASE WHEN position <= 5 THEN 'required' WHEN position <= 8 THEN 'preferred'
      ELSE 'certification' END AS importance
  FROM ranked_brands WHERE position <= 8 OR (position = 9 AND job_id % 3 <> 0))"""

JOBS = """
job_lists AS MATERIALIZED (
  SELECT job_id,
    string_agg(term, ', ' ORDER BY position) FILTER (importance = 'required') AS required,
    string_agg(term, ', ' ORDER BY position) FILTER (importance = 'preferred') AS preferred,
    count(*) FILTER (importance = 'required') AS n_required,
    count(*) FILTER (importance = 'preferred') AS n_preferred,
    count(*) FILTER (importance = 'certification') AS n_certification
  FROM reqs GROUP BY job_id),
jobs AS MATERIALIZED (
  SELECT s_suppkey AS job_id, s_name AS title, r_name AS department, n_name AS location,
    s_name || ' hires in ' || n_name AS description,
    CAST(s_suppkey % 9 AS DOUBLE) AS required_years,
    CASE s_suppkey % 4 WHEN 1 THEN 'Associate degree' WHEN 2 THEN 'Bachelor of Science'
      WHEN 3 THEN 'Master of Science' END AS education_required,
    CASE s_suppkey % 4 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 0 END AS wanted_rank,
    s_acctbal > 0 AS is_active,
    CAST('2000-01-01' AS DATE) + CAST(s_suppkey * 37 % 365 AS INTEGER) AS created_at,
    coalesce(required, '') AS required_skills, coalesce(preferred, '') AS preferred_skills,
    coalesce(n_required, 0) AS n_required, coalesce(n_preferred, 0) AS n_preferred,
    coalesce(n_certification, 0) AS n_certification
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN job_lists ON job_lists.job_id = s_suppkey)"""

PAIRS = """
apps AS MATERIALIZED (SELECT DISTINCT l_suppkey AS job_id, o_custkey AS candidate_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
comp AS MATERIALIZED (
  SELECT vec_id, unnest(generate_series(1, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings),
norms AS MATERIALIZED (SELECT vec_id, sqrt(sum(x * x)) AS length FROM comp GROUP BY vec_id),
keyed AS MATERIALIZED (
  SELECT a.job_id, a.candidate_id, a.job_id % (SELECT count(*) FROM embeddings) AS job_vec,
    a.candidate_id % (SELECT count(*) FROM embeddings) AS candidate_vec
  FROM apps a JOIN cands c ON c.candidate_id = a.candidate_id
  WHERE NOT c.is_deleted AND c.is_parsed),
dots AS MATERIALIZED (
  SELECT k.job_vec, k.candidate_vec, sum(a.x * b.x) AS dot
  FROM (SELECT DISTINCT job_vec, candidate_vec FROM keyed) k
  JOIN comp a ON a.vec_id = k.job_vec JOIN comp b ON b.vec_id = k.candidate_vec AND b.i = a.i
  GROUP BY k.job_vec, k.candidate_vec),
pairs AS MATERIALIZED (
  SELECT k.job_id, k.candidate_id,
    CASE WHEN k.candidate_id % 17 <> 0 THEN
      greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), d.dot / (jn.length * cn.length)))
    END AS cosine
  FROM keyed k JOIN dots d ON d.job_vec = k.job_vec AND d.candidate_vec = k.candidate_vec
  JOIN norms jn ON jn.vec_id = k.job_vec JOIN norms cn ON cn.vec_id = k.candidate_vec)"""

REQUIREMENT_MATCHES = f"""
req_matches AS MATERIALIZED (
  SELECT p.job_id, p.candidate_id, r.position, r.term, r.importance, p.cosine, h.n,
    h.confidence AS held,
    CASE WHEN r.importance = 'certification' THEN
        CASE WHEN h.confidence IS NOT NULL OR contains(lower(c.certification), lower(r.term))
          THEN 'matched' ELSE 'missing' END
      WHEN h.confidence >= CAST(0.55 AS DOUBLE) THEN 'matched'
      WHEN h.confidence IS NOT NULL THEN 'weak'
      WHEN p.cosine >= CAST(0.45 AS DOUBLE) THEN 'weak' ELSE 'missing' END AS status,
    CASE WHEN r.importance = 'certification' THEN
        CASE WHEN h.confidence IS NOT NULL OR contains(lower(c.certification), lower(r.term))
          THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      WHEN h.confidence IS NOT NULL THEN h.confidence
      WHEN p.cosine >= CAST(0.45 AS DOUBLE) THEN
        {r4("CAST(0.55 AS DOUBLE) * least(CAST(1 AS DOUBLE), (p.cosine - CAST(0.45 AS DOUBLE)) / (CAST(1 AS DOUBLE) - CAST(0.45 AS DOUBLE)))")}
      ELSE CAST(0 AS DOUBLE) END AS contribution
  FROM pairs p JOIN reqs r ON r.job_id = p.job_id JOIN cands c ON c.candidate_id = p.candidate_id
  LEFT JOIN holdings h ON h.candidate_id = p.candidate_id AND h.normalized_name = lower(r.term))"""


def scores(weights: dict[str, str] | None = None) -> str:
    """Component scores and the weighted overall; weights are SQL expressions over ``j``."""
    w = weights or {
        "required": "0.40", "experience": "0.20", "education": "0.15", "preferred": "0.10",
        "semantic": "0.10", "certification": "0.05",
    }
    w = {k: f"CAST({v} AS DOUBLE)" for k, v in w.items()}
    zero = "CAST(0 AS DOUBLE)"
    on = {
        "required": "n_required > 0", "experience": "required_years > 0",
        "education": "education_raw IS NOT NULL", "preferred": "n_preferred > 0",
        "semantic": "cosine IS NOT NULL", "certification": "n_certification > 0",
    }
    order = ("required", "experience", "education", "preferred", "semantic", "certification")
    active = " + ".join(f"CASE WHEN {on[k]} THEN {w[k]} ELSE {zero} END" for k in order)
    column = {
        "required": "required_skills_score", "experience": "experience_score",
        "education": "education_score", "preferred": "preferred_skills_score",
        "semantic": "semantic_score", "certification": "certifications_score",
    }
    weighted = " + ".join(
        f"CASE WHEN {on[k]} THEN {column[k]} * {w[k]} ELSE {zero} END" for k in order
    )
    return f"""
coverage AS MATERIALIZED (
  SELECT job_id, candidate_id,
    {r4("sum(contribution) FILTER (importance = 'required') / count(*) FILTER (importance = 'required')")} AS required_score,
    {r4("sum(contribution) FILTER (importance = 'preferred') / nullif(count(*) FILTER (importance = 'preferred'), 0)")} AS preferred_score,
    {r4("sum(contribution) FILTER (importance = 'certification') / nullif(count(*) FILTER (importance = 'certification'), 0)")} AS certification_score,
    count(*) FILTER (importance = 'required' AND status = 'matched') AS matched,
    count(*) FILTER (importance = 'required' AND status = 'weak') AS weak,
    count(*) FILTER (importance = 'required' AND status = 'missing') AS missing,
    count(*) FILTER (importance = 'preferred' AND status = 'matched') AS liked,
    count(*) FILTER (importance = 'certification' AND status = 'matched') AS certified
  FROM req_matches GROUP BY job_id, candidate_id),
components AS (
  SELECT p.job_id, p.candidate_id, p.cosine, j.*  EXCLUDE (job_id),
    c.full_name, c.email, c.location AS home, c.current_title, c.total_experience_years,
    c.highest_degree, c.degree_rank, c.shortlisted,
    coalesce(v.matched, 0) AS matched, coalesce(v.weak, 0) AS weak,
    coalesce(v.missing, 0) AS missing, coalesce(v.liked, 0) AS liked,
    coalesce(v.certified, 0) AS certified,
    CASE WHEN c.relevant_experience_years > 0 THEN c.relevant_experience_years
      ELSE c.total_experience_years END AS have_years,
    coalesce(v.required_score, {zero}) AS required_skills_score,
    coalesce(v.preferred_score, {zero}) AS preferred_skills_score,
    coalesce(v.certification_score, {zero}) AS certifications_score,
    CASE WHEN j.wanted_rank > 0 AND c.degree_rank > 0 THEN
      CASE WHEN c.degree_rank >= j.wanted_rank THEN CAST(1 AS DOUBLE) ELSE
        {r4("greatest(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) - CAST(0.4 AS DOUBLE) * (j.wanted_rank - c.degree_rank))")} END
    END AS education_raw,
    CASE WHEN p.cosine IS NULL THEN {zero} ELSE
      {r4("greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), p.cosine / CAST(0.85 AS DOUBLE)))")} END
      AS semantic_score
  FROM pairs p JOIN jobs j ON j.job_id = p.job_id JOIN cands c ON c.candidate_id = p.candidate_id
  LEFT JOIN coverage v ON v.job_id = p.job_id AND v.candidate_id = p.candidate_id),
component_scores AS (
  SELECT *, coalesce(education_raw, {zero}) AS education_score,
    CASE WHEN required_years > 0 THEN
      {r4("least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), have_years) / required_years)")}
      ELSE {zero} END AS experience_score
  FROM components),
totals AS (SELECT *, {active} AS active_weight, {weighted} AS weighted FROM component_scores),
matches AS MATERIALIZED (
  SELECT *, {r4("CASE WHEN active_weight <= 0 THEN semantic_score ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), weighted / active_weight)) END")}
    AS overall_score,
    CAST(created_at + CAST(candidate_id % 30 AS INTEGER) AS DATE) AS matched_on
  FROM totals)"""


BASE = ",".join((CANDIDATES, HOLDINGS, SKILLS, REQUIREMENTS, JOBS))
MATCHES = ",".join((BASE, PAIRS, REQUIREMENT_MATCHES, scores()))


def with_base(select: str) -> str:
    return f"WITH {BASE}\n{select}"


def with_candidates(select: str) -> str:
    return f"WITH {CANDIDATES}\n{select}"


def with_matches(select: str, extra: str = "") -> str:
    more = f",{extra}" if extra else ""
    return f"WITH {MATCHES}{more}\n{select}"
