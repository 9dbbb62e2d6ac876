"""Registered queries: text functions and extraction jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates, education, privacy, scores, text as tx, tolerant_json as tj
from ..operators import catalogue as cat
from ..operators import documents as dc
from ..operators import extract as xt
from ..operators import job_text as jt
from ..operators import manage as mg
from ..operators import search as se
from . import driver_tables as t
from . import oracle_relations as o
from .registry import query

_NORM = "trim(regexp_replace(replace(lower(strip_accents({})), '&', ' and '), '[^a-z0-9+#.]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS digest FROM documents")
def normalize_text(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.md5(tx.normalize_text("text")).alias("digest"))


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS slug, lower(replace(p_brand, ' ', '_')) AS brand_slug FROM part")
def slugify_terms(spark, d):
    return t.table(spark, d, "part").select(
        "p_partkey", tx.slugify_unknown("p_name").alias("slug"), tx.slugify_unknown("p_brand").alias("brand_slug")
    )


@query(o.with_candidates(
    """SELECT candidate_id, degree_rank AS rank, CASE degree_rank WHEN 0 THEN 'Not detected'
      ELSE highest_degree || ' (' || CASE degree_rank WHEN 2 THEN 'Diploma' WHEN 4 THEN 'Bachelor''s' WHEN 5 THEN 'Master''s' ELSE 'Doctorate' END || ')' END AS label,
      degree_rank >= 4 AS meets_bachelor FROM cands"""))
def degree_ranks(spark, d):
    return t.candidates(spark, d).select(
        "candidate_id", education.degree_rank("highest_degree").alias("rank"),
        education.describe_degree("highest_degree").alias("label"),
        education.meets_education_requirement("highest_degree", F.lit("Bachelor's degree")).alias("meets_bachelor"),
    )


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\x0b\\f\\r]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))) AS digest,
  CASE WHEN length(text) <= 60 THEN text ELSE rtrim(left(text, 57), ' ' || chr(9) || chr(10)) || '...' END AS shown FROM documents""")
def collapse_and_truncate(spark, d):
    return t.table(spark, d, "documents").select(
        "doc_id", F.md5(tx.collapse_whitespace("text")).alias("digest"), tx.truncate("text", 60).alias("shown")
    )


@query("""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+|www\\.\\S+', '[url]', 'g'),
    '[\\w.+-]+@[\\w-]+\\.[\\w.-]+', '[email]', 'g'),
    '(?:\\+\\d{1,3}[\\s.-]?)?(?:\\(\\d{2,4}\\)[\\s.-]?)?\\d{3,4}[\\s.-]?\\d{3,4}(?:[\\s.-]?\\d{2,4})?', '[phone]', 'g') AS x FROM documents)
  SELECT doc_id, (length(x) - length(replace(x, '[email]', ''))) // 7 AS emails, (length(x) - length(replace(x, '[phone]', ''))) // 7 AS phones FROM r""")
def redact_pii(spark, d):
    """Redaction tokens per document."""
    red = privacy.redact_pii("text")

    def count(token: str):
        return F.floor((F.length("x") - F.length(F.replace("x", F.lit(token), F.lit("")))) / 7)

    return t.table(spark, d, "documents").select("doc_id", red.alias("x")).select(
        "doc_id", count("[email]").alias("emails"), count("[phone]").alias("phones")
    )


@query(o.with_candidates("SELECT candidate_id, left(email, 1) || '***' || substr(email, instr(email, '@')) AS masked FROM cands"))
def mask_emails(spark, d):
    return t.candidates(spark, d).select("candidate_id", privacy.mask_email("email").alias("masked"))


@query("""SELECT event_id, '{"user":' || user_id || ',"token":"[redacted]","email":"u***@x.example","k":' || json_extract_string(props, '$.k') || '}' AS detail FROM events""")
def sanitize_audit_detail(spark, d):
    raw = F.concat(
        F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"token":"t'), F.col("event_id").cast("string"),
        F.lit('","email":"u'), F.col("user_id").cast("string"), F.lit('@x.example","k":'),
        tj.json_dict("props")["k"], F.lit("}"),
    )
    return t.table(spark, d, "events").select("event_id", privacy.sanitize_detail(raw).alias("detail"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, 1 AS listed, 0 AS broken FROM events""")
def tolerant_json(spark, d):
    """Objects decode to maps, scalars to one-element lists, broken text to nothing."""
    return t.table(spark, d, "events").select(
        "event_id", tj.json_dict("props")["k"].alias("k"), F.size(tj.json_list("props")).alias("listed"),
        F.size(tj.json_list(F.concat(F.lit("["), "props"))).alias("broken"),
    )


@query("""SELECT o_orderkey, CASE WHEN floor(o_totalprice) < 1024 THEN printf('%.0f B', floor(o_totalprice)) WHEN o_totalprice < 1048576 THEN printf('%.1f KB', floor(o_totalprice) / 1024)
    ELSE printf('%.1f MB', floor(o_totalprice) / 1048576) END AS size,
  CASE WHEN o_custkey % 45 > 41 THEN 'under 25' WHEN o_custkey % 45 > 34 THEN '25-31' WHEN o_custkey % 45 > 26 THEN '32-39' ELSE '40+' END AS age FROM orders""")
def display_functions(spark, d):
    return t.table(spark, d, "orders").select(
        "o_orderkey", scores.human_size(F.floor("o_totalprice")).alias("size"),
        scores.age_band((1960 + F.col("o_custkey") % 45), 2026).alias("age"),
    )


@query("SELECT p_partkey, 'AI, ' || upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS shown FROM part")
def titlecase_keywords(spark, d):
    return t.table(spark, d, "part").select(
        "p_partkey", tx.titlecase_keywords(F.concat(F.lit("ai; "), "p_name")).alias("shown")
    )


@query("SELECT p_partkey, p_name || ',' || p_type AS terms FROM part")
def unique_term_lists(spark, d):
    raw = F.concat_ws(" , ", "p_name", "p_type", "p_name", F.lit(""))
    return t.table(spark, d, "part").select("p_partkey", F.array_join(tx.unique_terms(tx.split_terms(raw)), ",").alias("terms"))


@query("SELECT p_partkey, p_name || '|' || p_type AS coerced, p_name || '|' || p_type AS united, p_type || '|' || p_name AS ordered FROM part")
def term_unions(spark, d):
    """Term lists cleaned and united without regard to case."""
    name, kind = F.col("p_name"), F.col("p_type")
    shown = lambda c: F.array_join(c, "|")
    return t.table(spark, d, "part").select(
        "p_partkey",
        shown(tx.coerce_terms(F.concat(F.lit("- "), name, F.lit("; "), kind, F.lit(", "), F.upper(name)))).alias("coerced"),
        shown(tx.union_terms(F.array(name), F.array(F.upper(name), kind))).alias("united"),
        shown(cat.ordered_union(F.array(kind), F.array(F.upper(kind), name))).alias("ordered"),
    )


@query("""SELECT event_id, event_type || '|x' AS listed, event_type AS single, '["' || event_type || '"]' AS told FROM events""")
def json_columns(spark, d):
    """List columns in their text forms, read and written."""
    kind = F.col("event_type")
    return t.table(spark, d, "events").select(
        "event_id",
        F.array_join(tj.string_list(F.concat(F.lit('["'), kind, F.lit('","x"]'))), "|").alias("listed"),
        F.array_join(tj.string_list(kind), "|").alias("single"),
        tj.json_text(F.array(kind)).alias("told"),
    )


# -- documents ----------------------------------------------------------------
def cleaned(spark, d) -> DataFrame:
    return dc.clean_lines(t.documents(spark, d))


_BULLETS = "•●▪◦⁃∙·\\-–—>*"
CLEAN = f"""
prepared AS MATERIALIZED (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)),
    '([\\p{{L}}\\p{{N}}_])[-‐‑‒–]\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '[ \\t\\x0b\\f\\r]+', ' ', 'g') AS x FROM documents WHERE length(text) > 0),
split AS MATERIALIZED (SELECT doc_id, unnest(string_split(x, chr(10))) AS raw, unnest(generate_series(0, len(string_split(x, chr(10))) - 1)) AS i FROM prepared),
bare AS MATERIALIZED (SELECT doc_id, i, trim(regexp_replace(raw, '^[\\s ]*[{_BULLETS}]+[\\s ]*', '')) AS line FROM split),
keyed AS MATERIALIZED (SELECT doc_id, i, line, {_NORM.format('line')} AS key FROM bare),
counted AS MATERIALIZED (SELECT *, CASE WHEN key <> '' AND length(key) < 90 THEN count(*) OVER (PARTITION BY doc_id, key) ELSE 0 END AS seen,
    count(*) OVER (PARTITION BY doc_id) AS total FROM keyed),
kept AS MATERIALIZED (SELECT doc_id, i, line FROM counted WHERE line = '' OR NOT (
    regexp_matches(line, '(?i)^(?:page\\s+)?\\d+\\s*(?:of\\s*\\d+)?\\.?$') OR regexp_matches(line, '(?i)^https?://\\S+$')
    OR (length(key) < 60 AND seen >= 3 AND total > 25)
    OR (seen = 1 AND (i <= 1 OR i = total - 1) AND regexp_matches(line, '(?i)(?:curriculum\\s*vitae|résumé|resume\\s+of|page\\s+\\d+|confidential)')))),
marked AS MATERIALIZED (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before,
    max(CASE WHEN line <> '' THEN i END) OVER (PARTITION BY doc_id) AS last_text FROM kept),
clean AS MATERIALIZED (SELECT doc_id, i, line FROM marked WHERE line <> '' OR (coalesce(before, '') <> '' AND i < last_text))"""


@query("WITH " + CLEAN + " SELECT doc_id, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM clean GROUP BY doc_id")
def clean_documents(spark, d):
    out = cleaned(spark, d).where(F.size("lines") > 0)
    return out.select("doc_id", F.size("lines").cast("bigint").alias("lines"), F.md5(dc.clean_text()).alias("digest"))


@query("WITH " + CLEAN + """, s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))), ' -*•' || chr(9)) AS sentence FROM clean)
  SELECT doc_id, count(*) AS sentences, sum(length(sentence))::BIGINT AS chars FROM s WHERE length(sentence) >= 25 GROUP BY doc_id""")
def split_sentences(spark, d):
    rows = dc.split_sentences(cleaned(spark, d), "doc_id")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).cast("bigint").alias("chars")
    )


@query("WITH " + CLEAN + f""" SELECT doc_id, count(*) FILTER (regexp_matches(line, '^\\S+@\\S+$')) AS email_lines,
  count(*) FILTER (regexp_matches({_NORM.format('line')}, 'certified|certification|certificate|licensed|license|credential|associate|professional|diploma')) AS certification_lines
  FROM clean GROUP BY doc_id""")
def classify_lines(spark, d):
    rows = dc.classify_lines(dc.doc_lines(cleaned(spark, d), "doc_id"))
    return rows.groupBy("doc_id").agg(
        F.count_if("is_email").alias("email_lines"), F.count_if("is_certification").alias("certification_lines")
    )


@query("""SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,24}'), '') AS email FROM documents""")
def document_emails(spark, d):
    return t.table(spark, d, "documents").select("doc_id", xt.email(F.col("text")).alias("email"))


def document_contacts(spark, d):
    """All contact fields of the documents."""
    out = xt.extract_contacts(dc.sectionise(cleaned(spark, d)))
    return out.select("doc_id", "email", "phone", "location", "full_name", "current_title", "portfolio_url")


query()(document_contacts)


@query("""WITH y AS (SELECT doc_id, CAST(unnest(regexp_extract_all(text, '\\b(?:19|20)\\d{2}\\b')) AS INTEGER) AS v FROM documents)
  SELECT d.doc_id, coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY v), '') AS years FROM documents d
  LEFT JOIN (SELECT DISTINCT doc_id, v FROM y WHERE v BETWEEN 1970 AND 2027) u ON u.doc_id = d.doc_id GROUP BY d.doc_id""")
def graduation_years(spark, d):
    years = dates.graduation_years("text", F.lit(2026 * 12 + 12))
    return t.table(spark, d, "documents").select("doc_id", F.array_join(years.cast("array<string>"), ",").alias("years"))


_DICTIONARY = """
dict AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
pattern AS MATERIALIZED (SELECT '\\b(?:' || string_agg(w, '|' ORDER BY length(w) DESC, w) || ')\\b' AS p FROM dict),"""


@query("WITH " + _DICTIONARY + f"""
  m AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all({_NORM.format('text')}, (SELECT p FROM pattern))) AS surface FROM documents)
  SELECT doc_id, surface AS normalized_name, count(*) AS mentions FROM m GROUP BY doc_id, surface""")
def find_skill_mentions(spark, d):
    """Mentions of every word of the benchmark texts in whole documents."""
    docs = t.documents(spark, d)
    hits = cat.find_skill_mentions(docs, ["doc_id"], "text", cat.alias_table(t.dictionary(spark, d)))
    return hits.groupBy("doc_id", "normalized_name").agg(F.count(F.lit(1)).alias("mentions"))


# -- derived resumes ----------------------------------------------------------
_RESUME = """
r AS MATERIALIZED (
  SELECT o_orderkey AS doc_id, o_custkey, o_orderpriority, o_orderstatus, c_mktsegment, o_orderkey % 4 AS kind,
    year(o_orderdate) * 12 + month(o_orderdate) AS s, year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 17 AS e,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Data Engineer' WHEN '2-HIGH' THEN 'Software Developer' WHEN '3-MEDIUM' THEN 'Sales Manager'
      WHEN '4-NOT SPECIFIED' THEN 'Machine Learning Scientist' ELSE 'Office Coordinator' END AS title,
    1985 + o_orderkey % 5 AS first_year
  FROM orders JOIN customer ON c_custkey = o_custkey),
j AS MATERIALIZED (SELECT *, CASE kind WHEN 1 THEN ((s - 1) // 12) * 12 + 1 ELSE s END AS lo,
    CASE kind WHEN 1 THEN ((e - 1) // 12) * 12 + 12 WHEN 2 THEN 24025 ELSE e END AS hi FROM r)"""


def parsed_resumes(spark, d) -> DataFrame:
    return dc.sectionise(dc.clean_lines(t.resumes(spark, d)))


@query("WITH " + _RESUME + """ SELECT doc_id, 7 AS line_no, CAST(lo AS INTEGER) AS start, CAST(hi AS INTEGER) AS "end", kind = 2 AS is_current FROM j
  UNION ALL SELECT doc_id, 9, CAST(first_year * 12 + 1 AS INTEGER), CAST((first_year + 1) * 12 + 12 AS INTEGER), false FROM j""")
def extract_date_ranges(spark, d):
    docs = xt.with_dates(dc.clean_lines(t.resumes(spark, d)), F.lit(t.AS_OF))
    return xt.date_ranges(docs, "doc_id").select("doc_id", "line_no", "start", "end", "is_current")


@query("WITH " + _RESUME + """ SELECT doc_id, 'experience' AS section, 6 AS start_line, 10 AS end_line FROM j UNION ALL SELECT doc_id, 'skills', 12, 14 FROM j
  UNION ALL SELECT doc_id, 'education', 10, 12 FROM j UNION ALL SELECT doc_id, 'certifications', 14, 16 FROM j
  UNION ALL SELECT doc_id, 'summary', 4, 6 FROM j UNION ALL SELECT doc_id, 'preamble', 0, 4 FROM j""")
def sectionise(spark, d):
    return dc.section_rows(parsed_resumes(spark, d), "doc_id").select("doc_id", "section", "start_line", "end_line")


@query("WITH " + _RESUME + """ SELECT doc_id AS candidate_id, unnest(['preamble', 'summary', 'experience', 'education', 'skills', 'certifications']) AS section
  FROM j WHERE o_custkey % 5 = 0""")
def requested_sections(spark, d):
    """The sections of the candidates asked for."""
    rows = dc.section_rows(parsed_resumes(spark, d), "doc_id").select(F.col("doc_id").alias("candidate_id"), "section")
    asked = t.table(spark, d, "orders").where("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("candidate_id"))
    return se.section_readout(rows, asked)


@query("WITH " + _RESUME + """, p AS (SELECT doc_id, o_custkey, title, lo, hi, o_orderpriority, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' '
    || CASE o_orderstatus WHEN 'F' THEN 'Lyon' WHEN 'O' THEN 'Osaka' ELSE 'Lagos' END AS full_name,
    CASE o_orderstatus WHEN 'F' THEN 'Lyon, France' WHEN 'O' THEN 'Osaka, Japan' ELSE 'Lagos, Nigeria' END AS location FROM j)
  SELECT doc_id, full_name, 'c' || o_custkey || '@mail.example' AS email, '+1 415 555 ' || (1000 + doc_id % 9000) AS phone, location, title AS current_title,
    round((hi - lo + 23) / CAST(12 AS DOUBLE), 2) AS total_experience_years,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED') AND hi > lo THEN round((hi - lo) / CAST(12 AS DOUBLE), 2)
      ELSE round((hi - lo + 23) / CAST(12 AS DOUBLE), 2) END AS relevant_experience_years,
    CASE doc_id % 3 WHEN 0 THEN 'B.S. Computer Science' WHEN 1 THEN 'M.S. Data Science' ELSE 'MBA' END AS highest_degree,
    CASE doc_id % 3 WHEN 0 THEN 'Computer Science' WHEN 1 THEN 'Data Science' END AS degree_field,
    'University of Testing' AS institution, CAST(1980 + o_custkey % 15 AS INTEGER) AS graduation_year,
    title || '|Intern' AS previous_positions, 'Databricks Certified Engineer' AS certifications, CAST(0 AS INTEGER) AS warnings FROM p""")
def build_candidate_profiles(spark, d):
    """Resumes parsed to candidate rows; the SQL never sees the text."""
    profiles, _ = xt.build_candidate_profiles(
        t.resumes(spark, d), "doc_id", cat.alias_table(t.skills(spark, d)), F.lit(t.AS_OF)
    )
    plain = (
        "full_name", "email", "phone", "location", "current_title", "total_experience_years",
        "relevant_experience_years", "highest_degree", "degree_field", "institution", "graduation_year",
    )
    return profiles.select(
        "doc_id", *plain, F.array_join("previous_positions", "|").alias("previous_positions"),
        F.array_join("certifications", "|").alias("certifications"), F.size("warnings").alias("warnings"),
    )


_NAMED = """, p AS (SELECT doc_id, title, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' '
    || CASE o_orderstatus WHEN 'F' THEN 'Lyon' WHEN 'O' THEN 'Osaka' ELSE 'Lagos' END AS full_name FROM j)"""


@query("WITH " + _RESUME + _NAMED + """ SELECT doc_id AS candidate_id, CASE WHEN doc_id % 2 = 0 THEN 'Typed name' ELSE full_name END AS full_name, title AS current_title FROM p""")
def insert_candidates(spark, d):
    """Pasted texts parsed to candidate rows; typed values beat parsed ones, blanks do not."""
    parsed = xt.extract_contacts(parsed_resumes(spark, d)).select(
        F.col("doc_id").alias("candidate_id"), "full_name", "current_title"
    )
    typed = t.resumes(spark, d).select(
        F.col("doc_id").alias("candidate_id"),
        F.when(F.col("doc_id") % 2 == 0, "Typed name").otherwise("").alias("full_name"),
    )
    return mg.insert_candidates(typed, parsed, ["full_name", "current_title"])


@query("WITH " + _RESUME + _NAMED + """ SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN full_name ELSE 'as stored' END AS full_name,
    CASE WHEN doc_id % 3 = 0 THEN title END AS current_title FROM p""")
def rebuild_profiles(spark, d):
    """Stored rows of the selected candidates replaced by what their stored text parses to today."""
    texts = t.resumes(spark, d)
    stored = texts.select("doc_id", F.lit("as stored").alias("full_name"), F.lit(None).cast("string").alias("current_title"))
    selected = stored.where("doc_id % 3 = 0").select("doc_id")
    again = dc.sectionise(dc.clean_lines(texts.join(selected, "doc_id", "left_semi")))
    fresh = xt.extract_contacts(again).select("doc_id", "full_name", "current_title")
    return mg.replace_rows(stored, fresh, "doc_id")


@query("WITH " + _RESUME + """, b AS (SELECT doc_id, 'brand#' || (doc_id % 25 + 1) AS normalized_name FROM j UNION ALL SELECT doc_id, 'brand#' || (o_custkey % 25 + 1) FROM j)
  SELECT doc_id, normalized_name, CAST(0.95 AS DOUBLE) AS confidence, CAST(3 AS DOUBLE) AS years_experience, 2 * count(*) AS mention_count, 'explicit' AS source
  FROM b GROUP BY doc_id, normalized_name""")
def extract_skills(spark, d):
    """Skills listed and mentioned in the derived resumes."""
    docs = parsed_resumes(spark, d)
    rows = xt.extract_skills(docs, "doc_id", cat.alias_table(t.skills(spark, d)))
    return rows.select("doc_id", "normalized_name", "confidence", "years_experience", "mention_count", "source")


@query("WITH " + _RESUME + """ SELECT doc_id, title, 'Acme Works' AS company, CAST(hi - lo AS INTEGER) AS months, kind = 2 AS is_current, 2 AS bullets FROM j
  UNION ALL SELECT doc_id, 'Intern', 'Beta Labs', 23, false, 0 FROM j""")
def employment_history(spark, d):
    docs = xt.employment_history(xt.with_dates(parsed_resumes(spark, d), F.lit(t.AS_OF)))
    # The inner form would have the optimizer compute the history, and all below it, again in a filter.
    rows = docs.select("doc_id", F.inline_outer("employment_history")).where(F.col("is_current").isNotNull())
    return rows.select(
        "doc_id", "title", "company", "months", "is_current", F.size("bullets").alias("bullets")
    )


@query("WITH " + _RESUME + """ SELECT doc_id, length('Handled order ' || doc_id || ' with care.') AS summary_chars, title AS first_line FROM j""")
def embedding_texts(spark, d):
    docs = xt.extract_contacts(parsed_resumes(spark, d))
    text = xt.candidate_embedding_text(dc.section_map(), F.col("current_title"), dc.clean_text())
    parts = F.split(text, "\n")
    return docs.select(
        "doc_id", F.length(F.get(parts, F.lit(1))).alias("summary_chars"), F.get(parts, F.lit(0)).alias("first_line")
    )


@query(o.with_base("""SELECT job_id, 'Platform Engineer' AS title, department, location, required_skills, preferred_skills,
    CAST(job_id % 9 + 1 AS DOUBLE) AS experience_required_years, 'Master''s degree in Physics' AS education_required,
    'Run ' || title AS responsibilities FROM jobs WHERE n_required > 0"""))
def parse_job_descriptions(spark, d):
    rows = jt.parse_job_descriptions(t.job_texts(spark, d), "job_id", cat.alias_table(t.skills(spark, d)))
    lists = ("required_skills", "preferred_skills")
    return rows.where(F.size("required_skills") > 0).select(
        "job_id", "title", "department", "location", "experience_required_years", "education_required",
        F.array_join("responsibilities", "|").alias("responsibilities"),
        *[F.array_join(c, ", ").alias(c) for c in lists],
    )


# -- spans --------------------------------------------------------------------
@query("""WITH s AS (SELECT o_custkey AS candidate_id, year(o_orderdate) * 12 + month(o_orderdate) AS a, year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 36 AS b FROM orders),
  m AS (SELECT DISTINCT candidate_id, unnest(generate_series(a, b - 1)) AS month FROM s WHERE b > a),
  c AS (SELECT candidate_id, count(*) AS months FROM m GROUP BY candidate_id)
  SELECT s.candidate_id, CAST(coalesce(max(months), 0) AS BIGINT) AS months, round(coalesce(max(months), 0) / CAST(12 AS DOUBLE), 2) AS years
  FROM (SELECT DISTINCT candidate_id FROM s) s LEFT JOIN c ON c.candidate_id = s.candidate_id GROUP BY s.candidate_id""")
def merged_experience(spark, d):
    """Months covered by each customer's overlapping order spans."""
    start = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    spans = t.table(spark, d, "orders").select(
        F.col("o_custkey").alias("candidate_id"), start.alias("start"), (start + F.col("o_orderkey") % 36).alias("end")
    )
    return xt.merged_experience(spans, "candidate_id").select("candidate_id", F.col("months").cast("bigint").alias("months"), "years")


def _observations(spark, d) -> DataFrame:
    """One skill observation per order line."""
    return t.order_lines(spark, d).select(
        F.col("o_custkey").alias("candidate_id"), F.lower("p_brand").alias("normalized_name"),
        F.col("p_brand").alias("display_name"), F.lit("other").alias("category"),
        (0.5 + F.col("l_orderkey") % 5 / 10).alias("confidence"),
        (F.col("l_orderkey") % 4).cast("double").alias("years_experience"),
        (F.col("l_orderkey") % 50 == 0).alias("is_certified"),
        F.array((F.col("l_orderkey") % 3).cast("string")).alias("evidence"),
        F.lit("implicit").alias("source"), F.col("l_orderkey").alias("seen_at"),
    )


@query("WITH " + o.HOLDINGS + """ SELECT o_custkey AS candidate_id, lower(p_brand) AS normalized_name, round(max(0.5 + l_orderkey % 5 / CAST(10 AS DOUBLE)), 6) AS confidence,
    count(*) AS mention_count, CAST(nullif(max(l_orderkey % 4), 0) AS DOUBLE) AS years_experience, bool_or(l_orderkey % 50 = 0) AS is_certified,
    count(DISTINCT l_orderkey % 3) AS evidence FROM order_lines GROUP BY o_custkey, p_brand""")
def merge_skill_observations(spark, d):
    out = xt.merge_skill_observations(_observations(spark, d), ["candidate_id"])
    return out.select(
        "candidate_id", "normalized_name", F.round("confidence", 6).alias("confidence"), "mention_count",
        "years_experience", "is_certified", F.size("evidence").cast("bigint").alias("evidence"),
    )
