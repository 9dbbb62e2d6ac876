"""Hand-checked metrics, skew-safe ranks, limits and guards."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwright import lexicon as lx
from pairwright.functions.scores import dot
from pairwright.operators import catalogue, compare, evaluate as ev, explain, features, learn, manage, matching, vectors, weights
from pairwright.plans import prefix
from pairwright.plans.prefix import positions, ranked, ranked_between
from pairwright.plans.containment import containing
from pairwright.sources.tables import register_functions
from pairwright.streaming.rate_limit import rate_limit_flags


def _list(spark, relevance):
    rows = [(1, i, float(-i), r) for i, r in enumerate(relevance)]
    return spark.createDataFrame(rows, "q int, item bigint, score double, relevance int")


def test_metrics_by_hand(spark):
    def one(relevance, ks):
        return ev.per_query_metrics(_list(spark, relevance), ["q"], "item", ks).collect()[0]

    assert one([3, 2, 1, 0], (4, 8))["ndcg_4"] == pytest.approx(1.0)
    assert one([0, 0, 0], (3, 6))["ndcg_3"] == 0.0
    m = one([3, 0, 2, 0, 1], (1, 5))
    assert (m["precision_5"], m["recall_5"], m["precision_1"], m["recall_1"]) == (0.4, 1.0, 1.0, 0.5)
    assert one([0, 3, 2], (5, 10))["mrr_5"] == 0.5
    assert one([0, 1], (5, 10))["mrr_5"] == 0.0


def test_paired_bootstrap_verdicts(spark):
    make = lambda v, n=29, at=0: spark.createDataFrame(
        [(at + i, v) for i in range(n)], "q bigint, v double"
    )
    better = ev.paired_bootstrap(make(0.9), make(0.1), "q", "v", 200).collect()[0]
    assert better["better"] == "A" and better["difference"] == pytest.approx(0.8) and better["p_value"] < 0.05
    assert ev.paired_bootstrap(make(0.5), make(0.5), "q", "v", 200).collect()[0]["better"] == "tie"
    apart = ev.paired_bootstrap(make(0.9), make(0.1, at=100), "q", "v", 200).collect()[0]
    assert apart["better"] == "incomparable" and apart["queries"] == 0


def test_rank_of_one_hot_group_matches_a_plain_sort(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5).alias("g"),
        (F.col("id") * 7919 % 11 / 10.0).alias("s"), (F.col("id") * 1_000_003).alias("id"),
    )
    got = {r["id"]: r["rank"] for r in ranked(rows, ["g"], [("s", "desc")], "id").collect()}
    want, by_group = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (-r["s"], r["id"])):
        by_group[r["g"]] = by_group.get(r["g"], 0) + 1
        want[r["id"]] = by_group[r["g"]]
    assert got == want


def test_ranks_of_small_and_large_groups(spark, monkeypatch):
    """Small groups take one shuffle; larger ones are dealt by levels; both give the plain order, nulls have none."""
    rows = spark.createDataFrame(
        [(k % 7 if k % 7 < 4 else 3, (k * 31 % 13) / 13, k * 70_001) for k in range(900)]
        + [(None, 0.5, 1), (1, None, 2), (1, 0.5, None)], "g int, s double, id bigint",
    )
    levels = [("s", "desc")]
    known = [r for r in rows.collect() if None not in tuple(r)]
    want, seen = {}, {}
    for r in sorted(known, key=lambda r: (-r.s, r.id)):
        seen[r.g] = seen.get(r.g, 0) + 1
        want[r.g, r.id] = seen[r.g]
    small = ranked(rows, ["g"], levels, "id")
    assert small._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(prefix, "ORDERED_AT_ONCE", 200)
    assert max(seen.values()) > 200 > min(seen.values())
    for found in (small, ranked(rows, ["g"], levels, "id")):
        assert found.columns == ["g", "s", "id", "rank"]
        got = [((r.g, r.id), r["rank"]) for r in found.collect()]
        assert len(got) == len(known) and dict(got) == want


def test_positions_are_dense(spark):
    df = spark.createDataFrame([(5,), (10**13,), (7,), (70_000,)], "id bigint")
    assert [r["p"] for r in positions(df, "id", "p").orderBy("id").collect()] == [0, 1, 2, 3]


def test_containment_join(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "xyz"), (3, "")], "k int, t string")
    needles = spark.createDataFrame([("bc",), ("z",), ("longer than all",)], "n string")
    got = {(r["k"], r["n"]) for r in containing(texts, ["k"], "t", needles, "n").collect()}
    assert got == {(1, "bc"), (2, "z")}


def test_denied_events_use_no_quota(spark):
    rows = [(i, 1, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate((0, 1, 2, 30, 50))] + [(9, 1, "2024-01-01 00:01:01")]
    events = spark.createDataFrame(rows, "id bigint, u bigint, t string").withColumn("t", F.to_timestamp("t"))
    got = [r["allowed"] for r in rate_limit_flags(events, "u", "t", "id", 2, 60).orderBy("event_id").collect()]
    assert got == [True, True, False, False, False, True]


def test_weights(spark):
    with pytest.raises(ValueError):
        weights.check_weights({c: 0.5 for c in lx.COMPONENTS})
    assert weights.resolve_weights() == lx.DEFAULT_WEIGHTS


def test_scoring_rules(spark):
    jobs = spark.createDataFrame(
        [(1, "Dev", 4.0, "Master of Science", ["Python", "SQL", "Go"], [], ["AWS Cert"])],
        "job_id bigint, title string, experience_required_years double, education_required string, "
        "required_skills array<string>, preferred_skills array<string>, certifications array<string>",
    )
    people = spark.createDataFrame(
        [(1, 3.0, 2.0, "BSc", ["AWS Cert 2020"])],
        "candidate_id bigint, total_experience_years double, relevant_experience_years double, "
        "highest_degree string, certifications array<string>",
    )
    skills = spark.createDataFrame(
        [(1, "python", 0.9, 3.0, False, ["x"]), (1, "python", 0.6, 1.0, False, ["y"]), (1, "sql", 0.5, None, False, [])],
        "candidate_id bigint, normalized_name string, confidence double, years_experience double, "
        "is_certified boolean, evidence array<string>",
    )
    row = matching.score_pairs(
        spark.createDataFrame([(1, 1)], "job_id bigint, candidate_id bigint"),
        matching.job_profiles(jobs), matching.candidate_profiles(people, skills),
    ).collect()[0]
    assert [m["status"] for m in row["required_matches"]] == ["matched", "weak", "missing"]
    assert row["required_skills_score"] == 0.4667 and row["experience_score"] == 0.5
    assert row["education_score"] == 0.6 and row["certifications_score"] == 1.0
    want = (0.4667 * 0.4 + 0.5 * 0.2 + 0.6 * 0.15 + 1.0 * 0.05) / 0.8
    assert row["overall_score"] == pytest.approx(want, abs=1e-4)
    assert any("preferred_skills, semantic" in n for n in row["notes"])


def test_guards(spark):
    with pytest.raises(ValueError):
        features.check_no_protected(spark.createDataFrame([(1,)], "gender int"))
    with pytest.raises(ValueError):
        compare.comparison_set(spark, [1])
    with pytest.raises(ValueError):
        learn.make_model("other")
    report = spark.createDataFrame([("a", 1)], "rule string, violations bigint")
    with pytest.raises(ValueError):
        manage.require_clean(report)


def test_similarity_block_and_blobs(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "k bigint, embedding array<double>")
    got = {r["k"]: r["similarity"] for r in vectors.similarity_block(df, "k", [(9, [6.0, 8.0])]).collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0}
    blobs = df.select("k", vectors.encode_vector("embedding").alias("b"))
    back = vectors.decode_embeddings(blobs, "b", 2).orderBy("k").collect()
    assert back[0]["embedding"] == pytest.approx([0.6, 0.8])
    wrong = vectors.decode_embeddings(blobs, "b", 3).collect()
    assert {r["embedding_status"] for r in wrong} == {"wrong_dimension"}


def test_sparse_cosines_against_all_terms(spark):
    """Repeated pairs stay, strangers and nulls are 0, long and empty texts meet, further columns pass by."""
    words = ["ash", "birch", "cedar", "elm", "fir", "oak", "pine", "yew"]
    texts = {k: " ".join(words[(k * j + j * j) % 8] for j in range(k % 7)) for k in range(30)}
    texts[30] = " ".join(words[i % 8] + str(i % 4000) for i in range(20_000))
    texts[31], texts[32] = texts[30] + " oak", None
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc long, text string, terms string")
    weights = vectors.tfidf_weights(docs, "doc", "text", min_df=2)
    held = {}
    for r in weights.collect():
        held.setdefault(r["doc"], {})[r["term"]] = r["weight"]
    pairs = [(a, b, a * 100 + b) for a in range(33) for b in (0, 1, 9, 17, 30, 31, 32)] + [(9, 9, 1), (9, 9, 1), (None, 3, 2), (3, 999, 3)]
    frame = spark.createDataFrame(pairs, "job long, person long, weights long")
    found = vectors.sparse_vectors(weights, "doc")
    out = vectors.tfidf_cosine(
        frame, found.withColumnRenamed("doc", "job"), found.withColumnRenamed("doc", "person"), "job", "person"
    )
    assert out.columns == ["job", "person", "weights", "tfidf_cosine"]
    got = sorted(map(tuple, out.collect()), key=str)
    want = []
    for a, b, w in pairs:
        u, v = held.get(a, {}), held.get(b, {})
        want.append((a, b, w, min(1.0, sum(x * v.get(t, 0.0) for t, x in u.items()))))
    want.sort(key=lambda r: str(r[:3]))
    got.sort(key=lambda r: str(r[:3]))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert sum(r[3] > 0 for r in got) > 50
    nothing = vectors.sparse_vectors(weights.limit(0), "doc")
    none = vectors.tfidf_cosine(
        frame, nothing.withColumnRenamed("doc", "job"), nothing.withColumnRenamed("doc", "person"), "job", "person"
    )
    assert {r["tfidf_cosine"] for r in none.collect()} == {0.0}


def test_cells_are_put_in_their_places(spark):
    cells = spark.createDataFrame([(1, 0, 0.5), (1, 3, -1.0), (2, 2, 2.0)], "k long, bucket long, value double")
    got = {r["k"]: r["embedding"] for r in vectors.densify(cells, "k", 4).collect()}
    assert got == {1: [0.5, 0.0, 0.0, -1.0], 2: [0.0, 0.0, 2.0, 0.0]}
    assert vectors.densify(cells.limit(0), "k", 4).count() == 0


def test_pages_of_any_depth_make_up_the_ranking(spark):
    """Ties, ids far apart, a hot group, a group shorter than the page, and no rows at all."""
    rows = [(1, i * 70_000, (i * 7) % 5 / 4, (i * 3) % 4 / 4) for i in range(1, 120)]
    rows += [(2, i, 0.5, 0.5) for i in range(3)] + [(3, 5_000_000_000 + i, 0.25, i % 2 / 2) for i in range(45)]
    df = spark.createDataFrame(rows, "job_id long, candidate_id long, experience_score double, overall_score double")
    levels = [("experience_score", "desc"), ("overall_score", "desc")]
    order = lambda r: (-r[2], -r[3], r[1])
    for first, last in ((1, 20), (41, 60), (110, 200), (500, 600)):
        want = [
            (job, k, r[1]) for job in (1, 2, 3)
            for k, r in enumerate(sorted((r for r in rows if r[0] == job), key=order), 1) if first <= k <= last
        ]
        got = ranked_between(df, ["job_id"], levels, "candidate_id", first, last).collect()
        assert sorted((r["job_id"], r["rank"], r["candidate_id"]) for r in got) == want
    assert ranked_between(df.limit(0), ["job_id"], levels, "candidate_id", 1, 20).isEmpty()
    whole = ranked_between(df, [], levels, "candidate_id", 30, 33)
    want = sorted(rows, key=order)[29:33]
    assert sorted((r["rank"], r["candidate_id"]) for r in whole.collect()) == [(30 + k, r[1]) for k, r in enumerate(want)]


def test_functions_called_from_sql(spark):
    register_functions(spark)
    row = spark.sql(
        """SELECT score_band(0.85D) a, score_band(0.1D) b, experience_coverage(3D, 4D) c, experience_coverage(9D, 4D) d,
          experience_coverage(1D, 0D) e, cosine(array(1F, 0F), array(1F, 1F)) f, cosine(array(0F), array(1F)) g,
          cosine(array(1F), array(1F, 2F)) h, cosine(null, array(1F)) i"""
    ).first()
    assert tuple(row)[:5] == ("excellent", "poor", 0.75, 1.0, 0.0)
    assert abs(row.f - 0.5**0.5) < 1e-9 and (row.g, row.h, row.i) == (0.0, 0.0, 0.0)


def test_scored_pairs_are_not_sorted_or_dealt_with_both_profiles(spark):
    """Only one shuffle carries a profile, in few parts and in order of jobs; repeated and null keys join as before."""
    jobs = matching.job_profiles(spark.createDataFrame(
        [(j, f"job {j}", None, 1.0, ["sql"], [], []) for j in (1, 2, 2, 3)],
        "job_id bigint, title string, education_required string, experience_required_years double, "
        "required_skills array<string>, preferred_skills array<string>, certifications array<string>",
    ))
    people = matching.candidate_profiles(
        spark.createDataFrame(
            [(c, 2.0, 1.0, None, []) for c in (10, 11, 11, None)],
            "candidate_id bigint, total_experience_years double, relevant_experience_years double, "
            "highest_degree string, certifications array<string>",
        ),
        spark.createDataFrame(
            [(10, "sql", 0.9, 1.0, ["seen"])],
            "candidate_id bigint, normalized_name string, confidence double, years_experience double, evidence array<string>",
        ),
    )
    pairs = spark.createDataFrame(
        [(1, 10), (1, 10), (2, 10), (2, 11), (3, None), (None, 10), (9, 10)], "job_id bigint, candidate_id int"
    )
    scored = matching.score_pairs(pairs, jobs, people)
    got = sorted(tuple(r) for r in scored.select("job_id", "candidate_id", "required_skills_score").collect())
    assert got == [(1, 10, 0.9), (1, 10, 0.9), (2, 10, 0.9), (2, 10, 0.9), *[(2, 11, 0.0)] * 4]
    plan = scored._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "ShuffledHashJoin" in joins[0] and "candidate_id" in joins[0], plan
    assert "SortMergeJoin [job_id" in joins[1], plan


def test_evidence_is_written_in_flat_rows(spark):
    """Texts are made behind the explode, so a reader of the status alone never makes them."""
    jobs = matching.job_profiles(spark.createDataFrame(
        [(1, "job", "Bachelor of Science", 4.0, ["sql", "go"], ["python"], ["AWS Cert"])],
        "job_id bigint, title string, education_required string, experience_required_years double, "
        "required_skills array<string>, preferred_skills array<string>, certifications array<string>",
    ))
    people = matching.candidate_profiles(
        spark.createDataFrame(
            [(1, 3.0, 2.0, "BSc", ["AWS Cert 2020"])],
            "candidate_id bigint, total_experience_years double, relevant_experience_years double, "
            "highest_degree string, certifications array<string>",
        ),
        spark.createDataFrame(
            [(1, "sql", 0.9, 1.5, ["seen"]), (1, "python", 0.5, None, [])],
            "candidate_id bigint, normalized_name string, confidence double, years_experience double, evidence array<string>",
        ),
    )
    rows = explain.evidence_rows(
        matching.score_pairs(spark.createDataFrame([(1, 1)], "job_id bigint, candidate_id bigint"), jobs, people)
    )
    assert rows.columns == [
        "job_id", "candidate_id", "position", "component", "label", "detail", "status", "weight", "snippet"
    ]
    assert [tuple(r)[2:] for r in rows.orderBy("position").collect()] == [
        (0, "required_skills", "sql", "Found in the resume (confidence 90%), ~1.5 years claimed", "matched", 0.45, "seen"),
        (1, "required_skills", "go", "No evidence of this skill was found in the resume", "missing", 0.0, None),
        (2, "preferred_skills", "python", "Mentioned in the resume with low confidence (50%); treat as unconfirmed", "weak", 0.5, None),
        (3, "certifications", "AWS Cert", "Found in the resume (confidence 90%)", "matched", 1.0, "Listed in the candidate's certifications"),
        (4, "experience", "Experience", "Meets approximately 50% of the required experience", "weak", 0.2, None),
        (5, "education", "Education", "Highest qualification meets or exceeds the requirement", "matched", 0.15, None),
    ]
    plan = rows.select("status")._jdf.queryExecution().optimizedPlan().toString()
    assert "Found in the resume" not in plan and "Found in the resume" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_hashed_in_parts_of_bounded_size(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "a loaf of rye " * 20) for k in range(4)] + [(5, None)], "k bigint, text string")
    whole = sorted(tuple(r) for r in vectors.hashing_embed(docs, "k", "text").collect())
    monkeypatch.setattr(vectors, "_PART_CHARS", 50)
    cut = vectors.hashing_embed(docs, "k", "text")
    assert "RoundRobin" not in (plan := cut._jdf.queryExecution().executedPlan().toString())
    assert "23), REPARTITION_BY_NUM" in plan, plan
    assert [r[:2] for r in whole] == [r[:2] for r in sorted(tuple(r) for r in cut.collect())]
    assert len(whole) == 4 * len({r[1] for r in whole})


def test_mentions_leave_a_task_in_bounded_lists():
    automaton = catalogue._Automaton([("rye", "rye"), ("oat", "oat")])
    texts = pa.array(["rye oat " * 10, "", "oat rye"])
    parts = list(automaton.parts(texts, most=4))
    assert [len(p) for p in parts] == [4] * 5 + [2]
    assert [hit for p in parts for hit in p] == [
        (row, *hit) for row, t in enumerate(texts.to_pylist()) for hit in automaton.mentions(t)
    ]


def test_profiles_are_dealt_in_few_parts(spark):
    """A job's rows must lie side by side in a part, or its profile is shuffled once a pair."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for partitions in (100, 600):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            found.append(matching._candidate_parts(spark.range(1)))
        assert found == [40, 98]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scores_read_no_evidence_and_sort_no_skills(spark):
    """Scores take confidences alone; lists and vectors longer than what is written out give the same figures."""
    held = {f"s{i}": (i % 10) / 10 for i in range(0, 20, 2)}
    sizes = (0, 1, 8, 9, 20)
    jobs = matching.job_profiles(
        spark.createDataFrame(
            [(n, "job", None, 0.0, [f"s{i}" for i in range(n)], None, ["s2", "s3", "s4"]) for n in sizes],
            "job_id bigint, title string, education_required string, experience_required_years double, "
            "required_skills array<string>, preferred_skills array<string>, certifications array<string>",
        )
    )
    people = matching.candidate_profiles(
        spark.createDataFrame(
            [(1, 3.0, 2.0, "BSc", [])],
            "candidate_id bigint, total_experience_years double, relevant_experience_years double, "
            "highest_degree string, certifications array<string>",
        ),
        spark.createDataFrame(
            [(1, s, c, 1.0, [f"seen {s}"]) for s, c in held.items()]
            + [(1, "s2", 0.1, 9.0, ["worse"]), (1, "s3", None, 9.0, ["unknown"])],
            "candidate_id bigint, normalized_name string, confidence double, years_experience double, evidence array<string>",
        ),
    )
    pairs = spark.createDataFrame([(n, 1) for n in sizes], "job_id bigint, candidate_id bigint")
    scored = matching.score_pairs(pairs, jobs, people)
    rows = {r["job_id"]: r for r in scored.collect()}
    for n in sizes:
        total = sum(held.get(f"s{i}", 0.0) for i in range(n))
        assert rows[n]["required_skills_score"] == (round(total / n, 4) if n else 0.0)
        assert sum(m["contribution"] for m in rows[n]["required_matches"]) == pytest.approx(total)
        assert rows[n]["certifications_score"] == 0.6667
    second = rows[20]["required_matches"]
    assert (second[2]["evidence"], second[2]["years_experience"]) == ("seen s2", 1.0)
    assert (second[3]["status"], second[3]["evidence"]) == ("missing", None)

    def plan(*columns):
        return scored.select(*columns)._jdf.queryExecution().sparkPlan().toString()

    assert "max_by(evidence" not in plan("overall_score") and "SortAggregate" not in plan("overall_score")
    assert "max_by(evidence" in plan("required_matches")


@pytest.mark.parametrize("size", (1, 63, 64, 65))
def test_products_of_vectors_are_added_in_order(spark, size):
    a, b = [0.1 * (i + 1) for i in range(size)], [(-1.0) ** i / (i + 3) for i in range(size)]
    gap = [None if i == size // 2 else x for i, x in enumerate(a)]
    rows = spark.createDataFrame([(a, b), (gap, b)], "a array<double>, b array<double>")
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    assert [r[0] for r in rows.select(dot(F.col("a"), F.col("b"))).collect()] == [total, None]
