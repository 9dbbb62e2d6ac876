"""Registered queries: erasure, updates, files, corpus, audit, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import extract as xt
from ..operators import manage as mg
from ..operators import matching as m
from ..session import scratch_path
from ..sources import corpus as cp
from ..sources import files as fl
from ..streaming import incremental, ingest, rate_limit
from . import driver_tables as t
from . import oracle_relations as o
from .registry import query


def erased(spark, d) -> DataFrame:
    """Customers who asked to be erased: those in debt."""
    return t.table(spark, d, "customer").where("c_acctbal < -500").select(F.col("c_custkey").alias("candidate_id"))


@query(o.with_candidates("""SELECT candidate_id, CASE WHEN gone THEN 'Deleted candidate' ELSE full_name END AS full_name,
    CASE WHEN NOT gone THEN email END AS email, CASE WHEN NOT gone THEN location END AS location,
    CASE WHEN gone THEN 'failed' ELSE status END AS status, gone OR is_deleted AS is_deleted
  FROM cands JOIN (SELECT c_custkey, c_acctbal < -500 AS gone FROM customer) g ON g.c_custkey = candidate_id"""))
def anonymise_candidates(spark, d):
    out = mg.anonymise_candidates(t.candidates(spark, d), erased(spark, d))
    return out.select("candidate_id", "full_name", "email", "location", "status", "is_deleted")


@query(o.with_base("""SELECT candidate_id, lower(brand) AS normalized_name FROM holdings JOIN customer ON c_custkey = candidate_id WHERE c_acctbal >= -500"""))
def erased_skill_rows(spark, d):
    """The skill rows that stay when the people are erased."""
    _, skills = mg.erase_candidates(t.candidates(spark, d), t.candidate_skills(spark, d), erased(spark, d))
    return skills.select("candidate_id", "normalized_name")


@query(o.with_base("""SELECT 'candidates' AS relation, count(*) AS left_over FROM customer WHERE c_acctbal >= -500
  UNION ALL SELECT 'candidate_skills', count(*) FROM holdings JOIN customer ON c_custkey = candidate_id WHERE c_acctbal >= -500
  UNION ALL SELECT 'jobs', count(*) FROM supplier"""))
def purge_candidates(spark, d):
    tables = {
        "candidates": t.candidates(spark, d), "candidate_skills": t.candidate_skills(spark, d), "jobs": t.jobs(spark, d),
    }
    kept = mg.purge_candidates(tables, erased(spark, d))
    out = None
    for name, df in kept.items():
        part = df.agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(name).alias("relation"), "left_over")
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH " + o.REQUIREMENTS + """ SELECT job_id, count(*) AS requirements FROM reqs JOIN supplier ON s_suppkey = job_id WHERE s_acctbal > 0 GROUP BY job_id""")
def delete_jobs(spark, d):
    """Requirement rows after inactive jobs were deleted."""
    gone = t.jobs(spark, d).where("NOT is_active").select("job_id")
    kept = mg.delete_jobs({"requirements": t.requirements(spark, d)}, gone)["requirements"]
    return kept.groupBy("job_id").agg(F.count(F.lit(1)).alias("requirements"))


@query(o.with_base("""SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'Renamed' ELSE title END AS title,
  CASE WHEN job_id % 2 = 0 THEN 'contract' ELSE 'full-time' END AS employment_type, job_id % 3 = 0 AS needs_reembed FROM jobs"""))
def merge_updates(spark, d):
    """Partial job updates; only a changed title alters the meaning."""
    jobs = t.jobs(spark, d)
    updates = jobs.select(
        "job_id", F.when(F.col("job_id") % 3 == 0, "Renamed").alias("title"),
        F.when(F.col("job_id") % 2 == 0, "contract").alias("employment_type"),
    )
    return mg.merge_updates(jobs, updates, "job_id").select("job_id", "title", "employment_type", "needs_reembed")


@query(o.with_candidates("SELECT candidate_id, shortlisted OR candidate_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS shortlisted FROM cands"))
def set_shortlist(spark, d):
    big = t.table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("candidate_id"))
    return mg.set_shortlist(t.candidates(spark, d), big).select("candidate_id", "shortlisted")


@query("""SELECT s_suppkey AS job_id, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 384 END AS dimensions, CAST(1 AS DOUBLE) AS norm FROM supplier""")
def refresh_embeddings(spark, d):
    """The vector store after the jobs whose text changed since, or never had, a vector were embedded."""
    now = t.jobs(spark, d).select("job_id", F.col("description").alias("text"))
    stored = now.where("job_id % 4 < 2").select(
        "job_id", F.when(F.col("job_id") % 4 == 0, F.xxhash64("text")).otherwise(F.lit(0)).alias("text_hash"),
        F.array(F.lit(1.0)).alias("embedding"),
    )
    store = mg.refresh_vectors(now, "job_id", "text", stored)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return store.select("job_id", F.size("embedding").alias("dimensions"), F.round(length, 6).alias("norm"))


@query("""WITH p AS (SELECT DISTINCT o_custkey AS candidate_id, lower(p_brand) AS normalized_name, 0.5 + o_custkey % 5 / CAST(10 AS DOUBLE) AS confidence
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 3 < 2),
  q AS (SELECT DISTINCT o_custkey AS candidate_id, lower(p_brand) AS normalized_name
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_partkey % 4 = 0)
  SELECT coalesce(p.candidate_id, q.candidate_id) AS candidate_id, coalesce(p.normalized_name, q.normalized_name) AS normalized_name,
    round(greatest(p.confidence, CASE WHEN q.candidate_id IS NOT NULL THEN CAST(0.7 AS DOUBLE) END), 6) AS confidence,
    CASE WHEN p.confidence >= 0.7 OR q.candidate_id IS NULL THEN 'parsed' ELSE 'declared' END AS source
  FROM p FULL JOIN q ON p.candidate_id = q.candidate_id AND p.normalized_name = q.normalized_name""")
def merge_declared_skills(spark, d):
    """Skills a text shows and skills the person declares, the surer of both."""
    lines = t.order_lines(spark, d)
    row = lambda rows, confidence, source: rows.select(
        F.col("o_custkey").alias("candidate_id"), F.lower("p_brand").alias("normalized_name"),
        confidence.cast("double").alias("confidence"), F.lit(source).alias("source"),
    ).distinct()
    parsed = row(lines.where("l_orderkey % 3 < 2"), 0.5 + F.col("o_custkey") % 5 / 10, "parsed")
    declared = row(lines.where("l_partkey % 4 = 0"), F.lit(0.7), "declared")
    return xt.merge_declared(parsed, declared, "candidate_id").select(
        "candidate_id", "normalized_name", F.round("confidence", 6).alias("confidence"), "source"
    )


@query("""SELECT event_id AS audit_id, '{"k":' || json_extract_string(props, '$.k') || ',"password":"[redacted]"}' AS detail, left('10.0.0.' || user_id, 64) AS ip_address FROM events""")
def audit_append(spark, d):
    events = t.table(spark, d, "events").select(
        F.col("event_id").alias("audit_id"),
        F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"password":"p'), F.col("event_id").cast("string"), F.lit('"}')).alias("detail"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip_address"),
    )
    return mg.audit_append(events)


@query("""WITH a AS (SELECT conv_id, turn, role, length(text) AS chars FROM conversations
    UNION ALL SELECT conv_id, max(turn) + 1, 'user', 11 FROM conversations GROUP BY conv_id
    UNION ALL SELECT conv_id, max(turn) + 2, 'assistant', 6 FROM conversations GROUP BY conv_id)
  SELECT conv_id, turn, role, chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM a) WHERE rn <= 4""")
def transcript_append(spark, d):
    history = t.table(spark, d, "conversations")
    turns = history.select("conv_id").distinct().select(
        "conv_id", F.lit(" what is new ").alias("question"), F.lit("answer").alias("answer")
    )
    out = mg.transcript_append(history, turns, keep=4)
    return out.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("chars"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS job_id, o_custkey AS candidate_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  n AS (SELECT job_id, count(*) AS n FROM a GROUP BY job_id)
  SELECT unnest(['jobs_present', 'candidates_present', 'labels_present', 'job_id_unique', 'candidate_id_unique', 'required_skills_present',
      'label_job_known', 'label_candidate_known', 'relevance_in_domain', 'label_unique', 'labels_per_job_equal']) AS rule,
    unnest([0, 0, 0, 0, 0, (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)), 0, 0,
      (SELECT count(*) FROM a WHERE (job_id + candidate_id) % 5 = 4), 0, (SELECT count(DISTINCT n) - 1 FROM n)]) AS violations""")
def validate_corpus(spark, d):
    labels = t.applications(spark, d).withColumn("relevance", ((F.col("job_id") + F.col("candidate_id")) % 5).cast("int"))
    return mg.validate_corpus(t.jobs(spark, d), t.candidates(spark, d), labels)


def _corpus(spark, d) -> dict[str, DataFrame]:
    """The bound tables in the shape of the delimited corpus."""
    none = F.array().cast("array<string>")
    jobs = t.jobs(spark, d).withColumn("role_family", F.col("department"))
    people = t.candidates(spark, d).select(
        "candidate_id", "full_name", F.col("current_title").alias("role_family"), F.col("certifications").alias("declared_skills"),
        none.alias("hidden_skills"), F.col("total_experience_years").alias("years_experience"), "highest_degree", "certifications",
        F.concat(F.lit("Says \"hi\",\n"), "location").alias("summary"), (F.col("c_nationkey") % 4).cast("string").alias("gender"),
        (1960 + F.col("candidate_id") % 45).cast("int").alias("birth_year"),
    )
    labels = t.applications(spark, d).withColumn("relevance", ((F.col("job_id") + F.col("candidate_id")) % 4).cast("int"))
    return {"jobs": jobs, "candidates": people, "labels": labels}


@query(o.with_candidates("""SELECT candidate_id, full_name, total_experience_years AS years_experience, highest_degree, certification AS certifications,
  'Says "hi",' || chr(10) || location AS summary, CAST(1960 + candidate_id % 45 AS INTEGER) AS birth_year, 0 AS hidden FROM cands"""))
def corpus_round_trip(spark, d):
    """Candidates written as delimited text and read back."""
    root = scratch_path(spark, "corpus")
    cp.write_delimited(_corpus(spark, d)["candidates"], f"{root}/candidates.csv", "candidates")
    back = cp.read_delimited(spark, f"{root}/candidates.csv", "candidates")
    return back.select(
        "candidate_id", "full_name", "years_experience", "highest_degree", F.array_join("certifications", "|").alias("certifications"),
        "summary", "birth_year", F.size("hidden_skills").alias("hidden"),
    )


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS j, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey), g AS (SELECT (j + c) % 4 AS r, count(*) AS n FROM a GROUP BY r)
  SELECT (SELECT count(*) FROM supplier) AS jobs, (SELECT count(*) FROM customer) AS candidates, CAST(sum(n) AS BIGINT) AS labels,
    round(sum(CASE WHEN r > 0 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 4) AS positive_rate, string_agg(r || ':' || n, ',' ORDER BY r) AS grades FROM g""")
def corpus_manifest(spark, d):
    c = _corpus(spark, d)
    out = cp.corpus_manifest(c["jobs"], c["candidates"], c["labels"])
    grades = F.transform("grade_distribution", lambda g: F.concat_ws(":", g["relevance"].cast("string"), g["labels"].cast("string")))
    return out.select("jobs", "candidates", "labels", "positive_rate", F.array_join(grades, ",").alias("grades"))


# -- files --------------------------------------------------------------------
_EXT = "CASE o_orderpriority WHEN '1-URGENT' THEN '.pdf' WHEN '2-HIGH' THEN '.docx' WHEN '3-MEDIUM' THEN '.txt' ELSE '' END"


@query(f"""WITH f AS (SELECT o_orderkey, {_EXT} AS extension, CAST(floor(o_totalprice * 30) AS BIGINT) AS length FROM orders)
  SELECT extension, count(*) AS files, count(*) FILTER (extension = '') AS unsupported, count(*) FILTER (extension <> '' AND length > 10485760) AS too_large FROM f GROUP BY extension""")
def validate_files(spark, d):
    out = fl.validate_files(t.stored_files(spark, d))
    return out.groupBy("extension").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("rejection").startswith("Unsupported")).alias("unsupported"),
        F.count_if(F.col("rejection").startswith("File is too large")).alias("too_large"),
    )


@query("""SELECT count(*) AS document_count, CAST(sum(CAST(floor(o_totalprice * 30) AS BIGINT)) AS BIGINT) AS total_bytes FROM orders""")
def storage_usage(spark, d):
    return fl.storage_usage(t.stored_files(spark, d)).select("document_count", "total_bytes")


@query("SELECT CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS yyyymm, count(*) AS files FROM orders GROUP BY 1")
def land_by_month(spark, d):
    path = scratch_path(spark, "landing")
    fl.land_by_month(t.stored_files(spark, d), path)
    return spark.read.parquet(path).groupBy("yyyymm").agg(F.count(F.lit(1)).alias("files"))


def _references(spark, d) -> DataFrame:
    """Every candidate points to the file of their first order, every third one also to that of their last
    by bare name, and every job to the first order it supplied for."""
    files = t.stored_files(spark, d)
    by_key = files.select("path", F.regexp_extract("path", r"doc-(\d+)", 1).cast("bigint").alias("k"))
    orders = t.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    ends = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"), F.max("o_orderkey").alias("last"))
    last = by_key.select(F.col("k").alias("last"), F.element_at(F.split("path", "/"), -1).alias("original_filename"))
    people = by_key.join(ends, "k").join(last.join(ends.where("o_custkey % 3 = 0").select("last"), "last"), "last", "left")
    supplied = t.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("k"))
    jobs = by_key.join(supplied, "k").select(F.col("path").alias("source_file"))
    return fl.referenced_names(people.select(F.col("path").alias("resume_path"), "original_filename"), jobs)


_FILE = "'doc-' || o_orderkey || CASE o_orderpriority WHEN '1-URGENT' THEN '.pdf' WHEN '2-HIGH' THEN '.DOCX' WHEN '3-MEDIUM' THEN '.txt' WHEN '4-NOT SPECIFIED' THEN '.exe' ELSE '' END"
_POINTED = """(SELECT min(o_orderkey) FROM orders GROUP BY o_custkey
  UNION ALL SELECT max(o_orderkey) FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey
  UNION ALL SELECT min(l_orderkey) FROM lineitem GROUP BY l_suppkey)"""


@query(f"SELECT DISTINCT {_FILE} AS name FROM orders WHERE o_orderkey IN {_POINTED}")
def referenced_files(spark, d):
    return _references(spark, d)


@query(f"""SELECT {_FILE} AS name FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 365 DAY
  AND o_orderkey NOT IN {_POINTED}""")
def expired_files(spark, d):
    as_of = F.lit("2001-01-01").cast("timestamp")
    return fl.expired_files(t.stored_files(spark, d), _references(spark, d), as_of).select("name")


_INGEST = """SELECT count(*) AS total, count(*) FILTER (doc_id % 10 <> 0 AND length(trim(text, ' ' || chr(9) || chr(10))) >= 40) AS succeeded,
  count(*) FILTER (doc_id % 10 = 0 OR length(trim(text, ' ' || chr(9) || chr(10))) < 40) AS failed FROM documents"""


@query(_INGEST)
def ingest_documents(spark, d):
    """Batch totals of a fail-soft ingest of all documents."""
    return fl.ingest_documents(t.document_files(spark, d))[2]


@query(_INGEST)
def streaming_ingest(spark, d):
    """The same documents arriving as a stream."""
    source, target = scratch_path(spark, "inbox"), scratch_path(spark, "ingested")
    t.document_files(spark, d).write.parquet(source)
    files = spark.readStream.schema(ingest.FILE_SCHEMA).parquet(source)
    ingest.streaming_ingest(files, target, scratch_path(spark, "ingest-state")).awaitTermination()
    return fl.ingest_totals(spark.read.parquet(target))


# -- streams ------------------------------------------------------------------
LIMIT, WINDOW = 2, 6 * 3600
_LIMITER = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  run AS (SELECT event_id, user_id, us, rn, true AS allowed, us AS newest, CAST(NULL AS BIGINT) AS oldest FROM e WHERE rn = 1
    UNION ALL SELECT n.event_id, n.user_id, n.us, n.rn,
      NOT (r.oldest IS NOT NULL AND n.us - r.oldest < {WINDOW}000000),
      CASE WHEN NOT (r.oldest IS NOT NULL AND n.us - r.oldest < {WINDOW}000000) THEN n.us ELSE r.newest END,
      CASE WHEN NOT (r.oldest IS NOT NULL AND n.us - r.oldest < {WINDOW}000000) THEN r.newest ELSE r.oldest END
    FROM run r JOIN e n ON n.user_id = r.user_id AND n.rn = r.rn + 1)
  SELECT event_id, user_id AS key, allowed FROM run"""


@query(_LIMITER)
def rate_limit_flags(spark, d):
    """Allowed and denied events: at most two allowed per user in six hours."""
    events = t.table(spark, d, "events")
    return rate_limit.rate_limit_flags(events, "user_id", "ts", "event_id", LIMIT, WINDOW).select("event_id", "key", "allowed")


@query(_LIMITER)
def rate_limit_stream(spark, d):
    """The same decision taken on a stream with state, to its last event."""
    events = spark.readStream.schema(t.SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(d)
    flags = rate_limit.limit_to_the_end(
        events, scratch_path(spark, "flags"), scratch_path(spark, "flags-state"), "user_id", "ts", "event_id",
        limit=LIMIT, window_seconds=WINDOW, lateness="0 seconds", slot_seconds=5 * 86400,
    )
    return flags.select("event_id", "key", "allowed")


@query(f"""SELECT event_id, user_id AS key, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {WINDOW - 1}999999 PRECEDING AND 1 PRECEDING) AS previous FROM events""")
def trailing_counts(spark, d):
    events = t.table(spark, d, "events")
    return rate_limit.trailing_counts(events, "user_id", "ts", "event_id", WINDOW).select("event_id", "key", "previous")


@query(o.with_matches("SELECT job_id, candidate_id, overall_score FROM matches WHERE (job_id + candidate_id) % 3 <> 0"))
def incremental_scoring(spark, d):
    """A stream of applications, scored where the store has no current result."""
    source, target = scratch_path(spark, "pairs"), scratch_path(spark, "scores")
    t.eligible_applications(spark, d).write.parquet(source)
    stored = t.match_results(spark, d).where((F.col("job_id") + F.col("candidate_id")) % 3 == 0)
    incremental.incremental_scoring(
        spark.readStream.schema("candidate_id bigint, job_id bigint").parquet(source),
        lambda: m.job_profiles(t.jobs(spark, d), t.job_vectors(spark, d)),
        lambda: m.candidate_profiles(t.candidates(spark, d), t.candidate_skills(spark, d), t.candidate_vectors(spark, d)),
        lambda: stored, target, scratch_path(spark, "scores-state"),
    ).awaitTermination()
    return spark.read.parquet(target).select("job_id", "candidate_id", "overall_score")
