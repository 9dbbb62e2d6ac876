"""Registered queries: features, ranking metrics, bootstrap, audits, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import lexicon as lx
from ..operators import evaluate as ev
from ..operators import features as ft
from ..operators import learn
from ..operators import vectors as vc
from ..session import scratch_path, written
from . import driver_tables as t
from . import oracle_relations as o
from .registry import query

# Grades and scores of the applications.
_GRADED = """
apps AS MATERIALIZED (SELECT DISTINCT l_suppkey AS job_id, o_custkey AS candidate_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
graded AS MATERIALIZED (
  SELECT job_id, candidate_id, CAST((candidate_id + job_id) % 4 AS INTEGER) AS relevance,
    ((candidate_id * 7 + job_id * 13) % 1001) / CAST(1000 AS DOUBLE) AS score_a,
    ((candidate_id * 3 + job_id * 5) % 101) / CAST(100 AS DOUBLE) AS score_b FROM apps)"""


def graded(spark, d, system: str = "a") -> DataFrame:
    c, j = F.col("candidate_id"), F.col("job_id")
    score = (c * 7 + j * 13) % 1001 / F.lit(1000.0) if system == "a" else (c * 3 + j * 5) % 101 / F.lit(100.0)
    relevance = ((c + j) % 4).cast("int")
    return t.applications(spark, d).select(
        "job_id", "candidate_id", relevance.alias("relevance"), score.alias("score"),
        (relevance >= lx.RELEVANCE_THRESHOLD).cast("int").alias("label"),
    )


def _per_query(score: str, name: str, source: str = "graded", keys: str = "job_id") -> str:
    """Metric CTEs written with whole-list windows."""
    k = lambda n: f"""
    coalesce(sum(relevance / log2(rn + 1)) FILTER (rn <= {n}), 0) AS dcg_{n},
    sum(relevance / log2(irn + 1)) FILTER (irn <= {n}) AS ideal_{n},
    coalesce(sum(hits / CAST(rn AS DOUBLE)) FILTER (rn <= {n} AND relevance >= 2), 0) AS ap_{n},
    count(*) FILTER (rn <= {n} AND relevance >= 2) AS hits_{n}"""  # noqa: E731
    m = lambda n: f"""
    CASE WHEN ideal_{n} > 0 THEN dcg_{n} / ideal_{n} ELSE 0 END AS ndcg_{n},
    ap_{n} / least({n}, greatest(1, relevant)) AS map_{n},
    hits_{n} / CAST(least({n}, n) AS DOUBLE) AS precision_{n},
    CASE WHEN relevant > 0 THEN hits_{n} / CAST(relevant AS DOUBLE) ELSE 0 END AS recall_{n},
    CASE WHEN first_hit IS NULL THEN 0 ELSE 1 / CAST(first_hit AS DOUBLE) END AS mrr_{n}"""  # noqa: E731
    return f"""
{name}_ordered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, relevance DESC, candidate_id) AS rn,
    row_number() OVER (PARTITION BY {keys} ORDER BY relevance DESC) AS irn FROM {source}),
{name}_hits AS MATERIALIZED (
  SELECT *, sum(CASE WHEN relevance >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY rn) AS hits FROM {name}_ordered),
{name}_sums AS MATERIALIZED (
  SELECT {keys}, count(*) AS n, count(*) FILTER (relevance >= 2) AS relevant, min(rn) FILTER (relevance >= 2) AS first_hit,
    {k(5)}, {k(10)} FROM {name}_hits GROUP BY {keys}),
{name} AS MATERIALIZED (SELECT {keys}, n, relevant, {m(5)}, {m(10)} FROM {name}_sums)"""


_METRICS = [f"{m}_{k}" for k in (5, 10) for m in ev.METRICS]
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)


@query("WITH " + _GRADED + "," + _per_query("score_a", "q") + f" SELECT job_id, n AS rows, relevant, {_ROUNDED} FROM q")
def per_query_metrics(spark, d):
    out = ev.per_query_metrics(graded(spark, d), ["job_id"], "candidate_id")
    return out.select("job_id", "rows", "relevant", *[F.round(m, 6).alias(m) for m in _METRICS])


@query("WITH " + _GRADED + "," + _per_query("score_a", "q") + " SELECT 'queries' AS metric, CAST(count(*) AS DOUBLE) AS value FROM q"
       + "".join(f" UNION ALL SELECT '{m}', round(avg({m}), 6) FROM q" for m in _METRICS))
def evaluate_ranking(spark, d):
    return ev.evaluate_ranking(graded(spark, d), "job_id", "candidate_id").select(
        "metric", F.round("value", 6).alias("value")
    )


def _means(diff: str, iterations: int, seed: int) -> str:
    return f"""
numbered AS MATERIALIZED (SELECT {diff} AS v, row_number() OVER (ORDER BY job_id) - 1 AS p, count(*) OVER () AS n FROM q),
draws AS MATERIALIZED (
  SELECT r.replicate, ('0x' || substr(md5('{seed}-' || r.replicate || '-' || p), 1, 13))::BIGINT % n AS pick
  FROM numbered, (SELECT unnest(generate_series(0, {iterations - 1})) AS replicate) r),
means AS MATERIALIZED (
  SELECT replicate, round(avg(v), 12) AS mean FROM draws JOIN numbered ON pick = p GROUP BY replicate),
ordered AS MATERIALIZED (SELECT mean, row_number() OVER (ORDER BY mean, replicate) AS rn FROM means)"""


@query("WITH " + _GRADED + "," + _per_query("score_a", "q") + "," + _means("ndcg_5", 400, 1729) + """
  SELECT round((SELECT avg(ndcg_5) FROM q), 6) AS point, round(max(mean) FILTER (rn = 10), 6) AS ci_low,
    round(max(mean) FILTER (rn = 391), 6) AS ci_high, 400 AS samples FROM ordered""")
def bootstrap_interval(spark, d):
    per_query = ev.per_query_metrics(graded(spark, d), ["job_id"], "candidate_id")
    return ev.bootstrap_interval(per_query, "job_id", "ndcg_5").select(
        *[F.round(c, 6).alias(c) for c in ("point", "ci_low", "ci_high")], "samples"
    )


@query("WITH " + _GRADED + "," + _per_query("score_a", "qa") + "," + _per_query("score_b", "qb") + """,
  q AS MATERIALIZED (SELECT job_id, qa.map_10 - qb.map_10 AS diff FROM qa JOIN qb USING (job_id)),""" + _means("diff", 2000, 2718) + """,
  s AS (SELECT max(mean) FILTER (rn = 50) AS ci_low, max(mean) FILTER (rn = 1951) AS ci_high,
    least(1, 2 * least(avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN mean >= 0 THEN 1.0 ELSE 0 END))) AS p FROM ordered)
  SELECT round((SELECT avg(diff) FROM q), 6) AS difference, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high,
    round(CAST(p AS DOUBLE), 6) AS p_value, (SELECT count(*) FROM q) AS queries,
    CASE WHEN p >= 0.05 THEN 'tie' WHEN (SELECT avg(diff) FROM q) > 0 THEN 'A' ELSE 'B' END AS better FROM s""")
def paired_bootstrap(spark, d):
    a, b = (ev.per_query_metrics(graded(spark, d, s), ["job_id"], "candidate_id") for s in "ab")
    out = ev.paired_bootstrap(a, b, "job_id", "map_10")
    return out.select(
        *[F.round(c, 6).alias(c) for c in ("difference", "ci_low", "ci_high", "p_value")], "queries", "better"
    )


@query("WITH " + _GRADED + """,
  s AS (SELECT greatest(CAST(1e-9 AS DOUBLE), least(CAST(1 AS DOUBLE) - CAST(1e-9 AS DOUBLE), score_a)) AS p,
    CASE WHEN relevance >= 2 THEN 1 ELSE 0 END AS y FROM graded),
  g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY p),
  c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
    sum(pos) OVER () AS tot_p, sum(neg) OVER () AS tot_n FROM g)
  SELECT round(1 - sum(pos * (fp - neg + neg / 2.0)) / (max(tot_p) * max(tot_n)), 6) AS roc_auc,
    round(sum(pos * tp / CAST(tp + fp AS DOUBLE)) / max(tot_p), 6) AS pr_auc,
    (SELECT round(avg((p - y) * (p - y)), 6) FROM s) AS brier, (SELECT round(avg(y), 6) FROM s) AS positive_rate FROM c""")
def classification_metrics(spark, d):
    out = ev.classification_metrics(graded(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("WITH " + _GRADED + """ SELECT round(avg(power((CASE WHEN score_a >= 0.5 THEN 1 - 1e-6 ELSE 1e-6 END)
  - (CASE WHEN relevance >= 2 THEN 1 ELSE 0 END), 2)), 6) AS decision_brier FROM graded""")
def decision_brier(spark, d):
    return ev.decision_brier(graded(spark, d)).select(F.round("decision_brier", 6).alias("decision_brier"))


def people(spark, d) -> DataFrame:
    return t.table(spark, d, "customer").select(
        F.col("c_custkey").alias("candidate_id"), (F.col("c_nationkey") % 4).alias("gender"),
        (1960 + F.col("c_custkey") % 45).cast("int").alias("birth_year"),
    )


@query("WITH " + _GRADED + """,
  member AS MATERIALIZED (SELECT 'gender=' || (c_nationkey % 4) AS subgroup, g.* FROM graded g JOIN customer ON c_custkey = candidate_id
    UNION ALL SELECT 'age=' || CASE WHEN age < 25 THEN 'under 25' WHEN age < 32 THEN '25-31' WHEN age < 40 THEN '32-39' ELSE '40+' END, g.*
    FROM graded g JOIN (SELECT c_custkey, 2026 - (1960 + c_custkey % 45) AS age FROM customer) ON c_custkey = candidate_id),"""
    + _per_query("score_a", "q", "member", "subgroup, job_id") + """
  SELECT subgroup, m.rows, positive_rate, ndcg_5, precision_5, mean_score FROM
    (SELECT subgroup, count(*) AS rows, count(DISTINCT job_id) AS jobs, round(avg(CASE WHEN relevance >= 2 THEN 1 ELSE 0 END), 6) AS positive_rate,
      round(avg(score_a), 6) AS mean_score FROM member GROUP BY subgroup) m
    JOIN (SELECT subgroup, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(precision_5), 6) AS precision_5 FROM q GROUP BY subgroup) USING (subgroup)
  WHERE m.rows >= 30 AND jobs >= 3""")
def fairness_audit(spark, d):
    out = ev.fairness_audit(graded(spark, d), people(spark, d), "job_id", "candidate_id", 2026)
    return out.select("subgroup", "rows", *[F.round(c, 6).alias(c) for c in ("positive_rate", "ndcg_5", "precision_5", "mean_score")])


@query("WITH " + _GRADED + "," + _per_query("score_a", "qa") + "," + _per_query("score_b", "qb")
       + " SELECT * FROM (" + " UNION ALL ".join(
           f"SELECT '{m}' AS metric, round(a, 6) AS value, round(b, 6) AS baseline, round((a - b) / nullif(b, 0), 4) AS lift FROM (SELECT avg({m}) AS a FROM qa), (SELECT avg({m}) AS b FROM qb)"
           for m in _METRICS) + ") WHERE lift IS NOT NULL")
def lift_table(spark, d):
    a, b = (ev.evaluate_ranking(graded(spark, d, s), "job_id", "candidate_id") for s in "ab")
    return ev.lift_table(a, b).select("metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), "lift")


def metrics_report(spark, d):
    """Metric rows with intervals, as they are written to the report file."""
    return ev.metrics_report(graded(spark, d), "system-a", "job_id", "candidate_id")


query()(metrics_report)


@query("WITH " + _GRADED + """, h AS (SELECT job_id, ('0x' || substr(md5('42-' || job_id), 1, 4))::BIGINT AS hash FROM (SELECT DISTINCT job_id FROM graded)),
  f AS (SELECT job_id, CAST((row_number() OVER (ORDER BY hash, job_id) - 1) % 5 AS INTEGER) AS fold FROM h)
  SELECT fold, count(*) AS fold_rows, count(DISTINCT g.job_id) AS fold_groups FROM graded g JOIN f ON f.job_id = g.job_id GROUP BY fold""")
def group_folds(spark, d):
    folded = learn.group_folds(graded(spark, d), "job_id")
    return learn.fold_sizes(folded, "job_id").select("fold", "fold_rows", "fold_groups")


# -- features and models ------------------------------------------------------
def corpus_texts(spark, d) -> tuple[DataFrame, DataFrame]:
    """Short job and candidate texts of the bound tables."""
    jobs = t.jobs(spark, d).select(
        "job_id", F.concat_ws(" ", "description", F.array_join("required_skills", " "), "education_required").alias("text")
    )
    people_ = t.candidates(spark, d).select(
        "candidate_id", F.concat_ws(" ", "current_title", "location", "highest_degree", F.array_join("certifications", " ")).alias("text")
    )
    return jobs, people_


def features(spark, d) -> DataFrame:
    # Pairs are read by four branches, so their numbers are computed once and written.
    scored = written(spark, ft.score_features(t.scored_in_steps(spark, d)), "score-features")
    labels = graded(spark, d)
    jobs, cands = corpus_texts(spark, d)
    both = jobs.select((-F.col("job_id") - 1).alias("doc"), "text").unionByName(
        cands.select(F.col("candidate_id").alias("doc"), "text")
    )
    vectors = vc.sparse_vectors(vc.tfidf_weights(both, "doc", "text"), "doc")
    left = vectors.where("doc < 0").select((-F.col("doc") - 1).alias("job_id"), "terms", "weights")
    right = vectors.where("doc >= 0").select(F.col("doc").alias("candidate_id"), "terms", "weights")
    pairs = scored.select("job_id", "candidate_id")
    tfidf = vc.tfidf_cosine(pairs, left, right, "job_id", "candidate_id")
    segment = F.element_at(F.array(*[F.lit(s) for s in t.DEGREES]), (F.col("job_id") % 5 + 1).cast("int"))
    families = pairs.join(
        cands.select("candidate_id", F.col("text").alias("candidate_text"), F.element_at(F.split("text", " "), 1).alias("candidate_family")),
        "candidate_id",
    ).withColumn("job_family", segment)
    tfidf = written(spark, tfidf, "pair-cosines")
    return ft.check_no_protected(ft.feature_table(scored, labels, tfidf, families))


_CHECKED = [f for f in lx.FEATURES if f not in ("tfidf_cosine", "candidate_text_length")]
_REQ = "greatest(1, n_required)"


@query(o.with_matches(f"""SELECT job_id, candidate_id, required_skills_score, experience_score, education_score, preferred_skills_score,
    semantic_score, certifications_score, overall_score, round(matched / CAST({_REQ} AS DOUBLE), 6) AS matched_required_ratio,
    round(weak / CAST({_REQ} AS DOUBLE), 6) AS weak_required_ratio, round(missing / CAST({_REQ} AS DOUBLE), 6) AS missing_required_ratio,
    round(liked / CAST(greatest(1, n_preferred) AS DOUBLE), 6) AS matched_preferred_ratio, CAST(certified AS DOUBLE) AS matched_certifications,
    CAST(matched AS DOUBLE) AS matched_required_count, CAST(missing AS DOUBLE) AS missing_required_count,
    round(greatest(0, required_years - have_years), 6) AS experience_gap_years,
    CASE WHEN have_years - required_years > 3 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS experience_overqualified,
    CAST(CASE WHEN wanted_rank > 0 THEN greatest(0, wanted_rank - degree_rank) ELSE 0 END AS DOUBLE) AS degree_gap_levels,
    round(coalesce(cosine, 0), 6) AS hashed_cosine, round(active_weight, 6) AS active_weight,
    CAST((n_required > 0)::INT + (required_years > 0)::INT + (education_raw IS NOT NULL)::INT + (n_preferred > 0)::INT
      + (cosine IS NOT NULL)::INT + (n_certification > 0)::INT AS DOUBLE) AS applicable_components,
    CAST(n_required AS DOUBLE) AS job_required_count,
    CASE WHEN current_title = CASE job_id % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END
      THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS same_role_family,
    CAST((candidate_id + job_id) % 4 AS INTEGER) AS relevance FROM matches"""))
def feature_table(spark, d):
    return features(spark, d).select(
        "job_id", "candidate_id", *[F.round(c, 6).alias(c) for c in _CHECKED], "relevance"
    )


@query(o.with_matches("""SELECT count(*) AS rows, round(avg(CASE WHEN (candidate_id + job_id) % 4 >= 2 THEN 1 ELSE 0 END), 4) AS positive_rate,
  CAST(CASE WHEN count(*) < 500 THEN 1 ELSE 0 END AS INTEGER) AS warnings FROM matches"""))
def data_warnings(spark, d):
    rows = t.match_results(spark, d).select(
        ((F.col("candidate_id") + F.col("job_id")) % 4 >= 2).cast("int").alias("label")
    )
    return ft.data_warnings(rows).withColumn("warnings", F.size("warnings"))


def _trainable(spark, d) -> DataFrame:
    """All features and the graded label, written once for the passes of a fit."""
    rows = features(spark, d).select("job_id", "candidate_id", *lx.FEATURES, (F.col("relevance") >= 2).cast("int").alias("label"))
    return written(spark, rows, "training")


@query(o.with_matches("""SELECT m.job_id, candidate_id, fold, CAST((candidate_id + m.job_id) % 4 >= 2 AS INTEGER) AS label, true AS is_probability
  FROM matches m JOIN (SELECT job_id, CAST((row_number() OVER (ORDER BY ('0x' || substr(md5('42-' || job_id), 1, 4))::BIGINT, job_id) - 1) % 5 AS INTEGER) AS fold
    FROM (SELECT DISTINCT job_id FROM matches)) f ON f.job_id = m.job_id"""))
def out_of_fold_predictions(spark, d):
    """Grouped cross-validation of the logistic reranker: every row once, by a model that never saw its job."""
    out = learn.out_of_fold_scores(_trainable(spark, d), model="logistic")
    return out.select("job_id", "candidate_id", "fold", "label", F.col("score").between(0, 1).alias("is_probability"))


@query("SELECT unnest([" + ", ".join(f"'{f}'" for f in lx.FEATURES) + "]) AS feature, true AS is_difference")
def permutation_importance(spark, d):
    """What the saved and reloaded logistic reranker loses in average precision with each feature shuffled."""
    rows = _trainable(spark, d)
    path = scratch_path(spark, "reranker")
    learn.save_model(learn.train_reranker(rows, "logistic"), path)
    out = learn.permutation_importance(learn.load_model(path), rows, ["job_id", "candidate_id"])
    return out.select("feature", F.col("importance").between(-1, 1).alias("is_difference"))


# -- vectors ------------------------------------------------------------------
@query("WITH " + o.CANDIDATES + "," + o.PAIRS + " SELECT job_id, candidate_id, round(coalesce(cosine, 0), 6) AS similarity FROM pairs")
def pair_similarity(spark, d):
    out = vc.pair_similarity(
        t.eligible_applications(spark, d), t.job_vectors(spark, d), t.candidate_vectors(spark, d), "job_id", "candidate_id"
    )
    return out.withColumn("similarity", F.round("similarity", 6))


@query("WITH " + o.CANDIDATES + "," + o.PAIRS + """ SELECT job_id, candidate_id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY job_id ORDER BY round(coalesce(cosine, 0), 9) DESC, candidate_id) AS rn FROM pairs) WHERE rn <= 5""")
def top_k_similar(spark, d):
    out = vc.pair_similarity(
        t.eligible_applications(spark, d), t.job_vectors(spark, d), t.candidate_vectors(spark, d), "job_id", "candidate_id"
    ).withColumn("similarity", F.round("similarity", 9))
    return vc.top_k_similar(out, "job_id", "candidate_id", 5).select("job_id", "candidate_id", "rank")


@query("""WITH c AS MATERIALIZED (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  n AS (SELECT vec_id, sqrt(sum(x * x)) AS len, count(*) AS dims FROM c GROUP BY vec_id)
  SELECT c.vec_id, 'ok' AS embedding_status, dims AS dimensions, round(max(x) FILTER (i = 1) / max(len), 6) AS first_value
  FROM c JOIN n ON n.vec_id = c.vec_id GROUP BY c.vec_id, dims""")
def decode_embeddings(spark, d):
    """Vectors written as blobs and read back as unit vectors."""
    blobs = t.table(spark, d, "embeddings").select("vec_id", vc.encode_vector("embedding").alias("blob"))
    out = vc.decode_embeddings(blobs, "blob", 64)
    return out.select(
        "vec_id", "embedding_status", F.size("embedding").cast("bigint").alias("dimensions"),
        F.round(F.get("embedding", F.lit(0)), 6).alias("first_value"),
    )


_HASHED = """
norm AS MATERIALIZED (SELECT conv_id * 1000 + turn AS doc, trim(regexp_replace(replace(lower(strip_accents(text)), '&', ' and '), '[^a-z0-9+#.]+', ' ', 'g')) AS tx FROM conversations),
tok AS MATERIALIZED (SELECT doc, unnest(regexp_extract_all(tx, '[a-z0-9+#.]+')) AS w, unnest(generate_series(1, len(regexp_extract_all(tx, '[a-z0-9+#.]+')))) AS i FROM norm),
chars AS MATERIALIZED (SELECT doc, substr(' ' || tx || ' ', i, 3) AS g FROM (SELECT doc, tx, unnest(generate_series(1, length(tx))) AS i FROM norm)),
feats AS MATERIALIZED (SELECT doc, 'w:' || w AS f FROM tok
  UNION ALL SELECT a.doc, 'g:' || a.w || '_' || b.w FROM tok a JOIN tok b ON a.doc = b.doc AND b.i = a.i + 1
  UNION ALL SELECT doc, 'c:' || g FROM chars WHERE trim(g) <> ''),
tf AS MATERIALIZED (SELECT doc, f, count(*) AS n FROM feats GROUP BY doc, f),
cells AS MATERIALIZED (SELECT doc, ('0x' || substr(md5(f), 2, 14))::BIGINT % 384 AS bucket,
  sum((CASE WHEN substr(md5(f), 1, 1) >= '8' THEN 1 ELSE -1 END) * (1 + ln(n))) AS w FROM tf GROUP BY doc, bucket),
len AS MATERIALIZED (SELECT doc, sqrt(sum(w * w)) AS l FROM cells GROUP BY doc)"""


@query("WITH " + _HASHED + """ SELECT doc, count(*) FILTER (abs(w / l) > 1e-9) AS buckets, round(sum(bucket * w / l), 4) AS checksum
  FROM cells JOIN len USING (doc) GROUP BY doc""")
def hashing_embed(spark, d):
    """Hashed n-gram vectors of whole conversation turns."""
    docs = t.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    return vc.hashing_embed(docs, "doc", "text").groupBy("doc").agg(
        F.count_if(F.abs("value") > 1e-9).alias("buckets"),
        F.round(F.sum(F.col("bucket") * F.col("value")), 4).alias("checksum"),
    )


@query("""WITH tok AS MATERIALIZED (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS w,
    unnest(generate_series(1, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')))) AS i FROM conversations),
  grams AS (SELECT conv_id, turn, w AS term FROM tok UNION ALL
    SELECT a.conv_id, a.turn, a.w || ' ' || b.w FROM tok a JOIN tok b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.i = a.i + 1),
  tf AS MATERIALIZED (SELECT conv_id, turn, term, count(*) AS tf FROM grams GROUP BY conv_id, turn, term),
  df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
  raw AS MATERIALIZED (SELECT conv_id, turn, tf.term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM conversations)) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN df ON df.term = tf.term),
  len AS MATERIALIZED (SELECT conv_id, turn, sqrt(sum(w * w)) AS l FROM raw GROUP BY conv_id, turn),
  u AS MATERIALIZED (SELECT raw.conv_id, raw.turn, term, w / l AS w FROM raw JOIN len ON len.conv_id = raw.conv_id AND len.turn = raw.turn),
  dots AS (SELECT a.conv_id, a.turn, sum(a.w * b.w) AS s FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.term = a.term GROUP BY a.conv_id, a.turn)
  SELECT c.conv_id * 1000 + c.turn AS left_doc, c.conv_id * 1000 + c.turn + 1 AS right_doc, round(least(1, coalesce(s, 0)), 6) AS tfidf_cosine
  FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
  LEFT JOIN dots ON dots.conv_id = c.conv_id AND dots.turn = c.turn""")
def tfidf_cosine(spark, d):
    """Similarity of each conversation turn with the next one."""
    turns = t.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    vectors = vc.sparse_vectors(vc.tfidf_weights(turns, "doc", "text"), "doc")
    pairs = turns.select(F.col("doc").alias("left_doc"), (F.col("doc") + 1).alias("right_doc")).join(
        turns.select(F.col("doc").alias("right_doc")), "right_doc", "left_semi"
    )
    out = vc.tfidf_cosine(
        pairs, vectors.withColumnRenamed("doc", "left_doc"), vectors.withColumnRenamed("doc", "right_doc"), "left_doc", "right_doc"
    )
    return out.select("left_doc", "right_doc", F.round("tfidf_cosine", 6).alias("tfidf_cosine"))
