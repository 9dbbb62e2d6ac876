"""Inputs that once gave wrong answers."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from pairwright import lexicon as lx
from pairwright.functions.columns import contains_any
from pairwright.functions.text import normalize_text
from pairwright.operators import extract as xt, features, manage as mg, matching, matching as m, ranking, search as se, vectors as vec
from pairwright.plans import prefix
from pairwright.session import scratch_path, written
from pairwright.sources import files as fl
from pairwright.streaming import rate_limit as rl

FILE = "path string, modificationTime timestamp, length long, content binary"
PROSE = "Résumé of a naïve café owner\nWorked “twenty years” behind the counter, at €5 a cup — and more\nStill there\n"


def test_ingest_of_mixed_encodings(spark):
    now = dt.datetime(2024, 1, 1)
    contents = {
        "a/utf8.txt": PROSE.encode(), "a/western.txt": PROSE.encode("cp1252"), "a/le.txt": PROSE.encode("utf-16"),
        "a/be.txt": b"\xfe\xff" + ("𝄞 " + PROSE).encode("utf-16-be"), "a/broken.txt": b"\xff\xfe" + b"\x00\xd8A\x00" * 30,
        "a/odd.txt": b"\xff\xfe" + b"A\x00" * 50 + b"A", "a/print.pdf": b"%PDF-1.7 " + b"words " * 50,
        "a/letter.docx": b"PK\x03\x04" + b"words " * 50, "a/renamed.txt": b"%PDF-1.7 " + b"words " * 50, "a/empty.txt": b"",
    }
    rows = [(p, now, len(c), bytearray(c)) for p, c in contents.items()] + [("a/none.txt", now, 5, None)]
    good, bad, totals = fl.ingest_documents(spark.createDataFrame(rows, FILE))
    texts = {r["path"]: r["text"] for r in good.collect()}
    assert set(texts) == {"a/utf8.txt", "a/western.txt", "a/le.txt", "a/be.txt"}
    assert {texts[p] for p in ("a/utf8.txt", "a/western.txt", "a/le.txt")} == {texts["a/utf8.txt"]}
    reasons = {r["path"]: r["error"] for r in bad.collect()}
    assert reasons["a/print.pdf"] == reasons["a/letter.docx"] == reasons["a/renamed.txt"] == fl.NOT_TEXT
    assert reasons["a/broken.txt"] == reasons["a/odd.txt"] == fl.UNREADABLE
    assert totals.first().asDict() == {"total": 11, "succeeded": 4, "failed": 7}


def test_a_rewritten_job_leaves_the_others(spark):
    path = scratch_path(spark, "store")
    stored = spark.range(2000).select(
        F.col("id").alias("job_id"), F.lit(1).cast("long").alias("candidate_id"), F.lit(0.5).alias("overall_score")
    )
    m.write_matches(stored, path)
    again = stored.where("job_id = 7").withColumn("overall_score", F.lit(0.9))
    m.write_matches(again.union(again.withColumn("candidate_id", F.lit(2).cast("long"))), path)
    found = spark.read.parquet(path)
    assert found.count() == 2001
    assert sorted((r.candidate_id, r.overall_score) for r in found.where("job_id = 7").collect()) == [(1, 0.9), (2, 0.9)]


def test_unknown_explicit_job(spark):
    jobs = spark.createDataFrame([(1, "Data Engineer", True), (2, "Cook", False), (3, "Welder", True)], "job_id long, title string, is_active boolean")
    asked = spark.createDataFrame(
        [(1, 99, "who fits as welder"), (2, 2, "who"), (3, None, "the welder please"), (4, None, "nobody")],
        "question_id long, job_id long, text string",
    )
    found = {r.question_id: r.resolved_job_id for r in se.resolve_job(asked, jobs).collect()}
    assert found == {1: None, 2: 2, 3: 3, 4: None}


def test_erasure_takes_the_skill_rows(spark):
    people = spark.createDataFrame([(1, "A", False), (2, "B", False)], "candidate_id long, full_name string, is_deleted boolean")
    skills = spark.createDataFrame([(1, "go"), (2, "go")], "candidate_id long, normalized_name string")
    rows, left = mg.erase_candidates(people, skills, spark.createDataFrame([(1,)], "candidate_id long"))
    assert [tuple(r) for r in left.collect()] == [(2, "go")]
    assert rows.where("candidate_id = 1").first().is_deleted


def test_evidence_without_and_with_a_bound(spark):
    rows = [(1, "go", "Go", "x", 0.5, None, False, [f"text {k % 40}"], "implicit", k) for k in range(400)]
    seen = spark.createDataFrame(
        rows, "candidate_id long, normalized_name string, display_name string, category string, confidence double, "
        "years_experience double, is_certified boolean, evidence array<string>, source string, seen_at long"
    )
    (whole,) = xt.merge_skill_observations(seen, ["candidate_id"]).collect()
    assert whole.evidence == [f"text {k}" for k in range(40)] and whole.mention_count == 400
    (cut,) = xt.merge_skill_observations(seen, ["candidate_id"], max_evidence=3).collect()
    assert cut.evidence == ["text 0", "text 1", "text 2"]


def test_blocks_beyond_one_part(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k long, embedding array<double>")
    block = [(i, [1.0, float(i)]) for i in range(vec.MAX_BLOCK + 5)]
    assert vec.similarity_block(vectors, "k", block).count() == 2 * len(block)
    assert vec.similarity_block(vectors, "k", []).count() == 0


def plain_decisions(events, limit, window):
    """The rule itself: fewer than ``limit`` allowed events in the window before."""
    allowed = []
    out = {}
    for at, i in sorted(events):
        out[i] = sum(at - window < x <= at for x in allowed) < limit
        if out[i]:
            allowed.append(at)
    return out


@pytest.fixture
def rocks_state(spark):
    before = {name: spark.conf.get(name) for name in rl.STATE_STORE}
    for name, value in rl.STATE_STORE.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_stream_decides_in_order_of_time(spark, rocks_state):
    source, target = scratch_path(spark, "events"), scratch_path(spark, "decided")
    base = 1_700_000_000
    batches = [[(0, 0), (1, 50), (2, 10), (3, 55)], [(4, 20), (5, 70), (6, 52), (7, 90)], [(8, 85), (9, 60), (10, 200)], [(11, 400)]]
    schema = "event_id long, user long, ts timestamp"
    for batch in batches:
        rows = [(i, 1, dt.datetime.fromtimestamp(base + s, dt.timezone.utc)) for i, s in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(schema).parquet(source)
        (
            rl.rate_limit_stream(events, "user", "ts", "event_id", 2, 30, "100 seconds", slot_seconds=1)
            .writeStream.format("parquet").option("path", target).option("checkpointLocation", target + "-state")
            .trigger(availableNow=True).start().awaitTermination()
        )
    found = {r.event_id: r.allowed for r in spark.read.parquet(target).collect()}
    known = [(s, i) for batch in batches for i, s in batch]
    expected = plain_decisions(known, 2, 30)
    assert set(found) == {i for s, i in known if s <= 300}
    assert found == {i: expected[i] for i in found}


def test_list_tests_hold_their_text_once(spark):
    """A list test wrote its text once per word, so plans of resumes grew with the word lists."""
    df = spark.createDataFrame([("node.js and c++",), ("nodexjs",), (None,)], "t string")
    test = contains_any(normalize_text("t"), ["node.js", "c++"])
    assert [r[0] for r in df.select(test).collect()] == [True, False, False]
    assert df.select(test.alias("x"))._jdf.queryExecution().analyzed().toString().count("[a-z0-9+#.]+") == 1
    assert [r[0] for r in df.select(contains_any(F.col("t"), [])).collect()] == [False] * 3


def test_written_leaves_no_shuffle_files(spark):
    """Shuffle files of a written step lay beside those of the next one."""
    root = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    df = spark.range(0, 100_000, 1, 4).repartition(7, "id").groupBy(F.col("id") % 100).count()
    assert written(spark, df, "test").count() == 100
    left = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    assert left - before < 4  # what the count itself shuffles is one row a task
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == root


def test_one_frame_exported_equals_the_join(spark):
    """Repeated pairs meet each other, once-only pairs themselves, NULL keys nothing."""
    pairs = [(1, 1, 0.9), (1, 2, 0.8), (1, 2, 0.7), (2, 1, 0.6), (None, 1, 0.5), (2, None, 0.4), (2, 9, 0.3), (2, 3, 0.2)]
    told = "struct<summary:string,strong_matches:array<string>,missing_required:array<string>,weak_signals:array<string>>"
    rows = [(j, c, *[s] * 7, (f"{s}", [], ["a", "b"], [])) for j, c, s in pairs]
    scores = ", ".join(f"{name} double" for name in ranking.EXPORTED_SCORES)
    explained = spark.createDataFrame(rows, f"job_id bigint, candidate_id bigint, {scores}, explanation {told}")
    people = spark.createDataFrame(
        [(1, False), (2, False), (2, False), (3, True)], "candidate_id bigint, is_deleted boolean"
    ).withColumns({c: F.lit("x") for c in ("full_name", "email", "location", "current_title", "highest_degree")}
                  | {"total_experience_years": F.lit(1.0), "shortlisted": F.lit(True)})
    texts = explained.select("job_id", "candidate_id", "explanation")
    want = ranking.export_rows(explained, texts, people).collect()
    got = ranking.export_rows(explained, explained, people).collect()
    assert len(got) == 1 + 2 * 2 * 2 + 1
    drop = lambda found: sorted(str({k: v for k, v in r.asDict().items() if k not in ("explanation_summary", "rank")}) for r in found)
    assert drop(got) == drop(want)


def test_batch_outcomes_of_repeats_and_nulls(spark):
    kind = "job_id bigint, candidate_id bigint"
    pairs = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 3), (None, 1), (1, None)], kind)
    scored = spark.createDataFrame([(1, 1), (1, 1), (7, 7), (1, None)], kind)
    stored = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (8, 8)], kind)
    got = {r["job_id"]: tuple(r)[1:] for r in matching.batch_outcomes(pairs, scored, stored).collect()}
    assert got == {1: (4, 2, 2), None: (0, 0, 1)}


def test_shallow_page_writes_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0.5, i) for i in range(30)] + [(None, 0.5, 1), (1, None, 2)], "g bigint, s double, id bigint")
    monkeypatch.setattr(prefix, "written", None)
    got = prefix.ranked_between(df, ["g"], [("s", "desc")], "id", 11, 13).collect()
    assert sorted((r["rank"], r["id"]) for r in got) == [(11, 10), (12, 11), (13, 12)]


def test_features_are_joined_as_numbers(spark):
    """Lists of matches were carried through three shuffles; numbers are taken as they are."""
    keys = "job_id bigint, candidate_id bigint"
    own = [f for f in lx.FEATURES if f not in ("tfidf_cosine", "candidate_text_length", "same_role_family")]
    scored = spark.createDataFrame([(1, 2, *[0.5] * len(own))], keys + "".join(f", {f} double" for f in own))
    out = features.feature_table(
        scored, spark.createDataFrame([(1, 2, 3)], f"{keys}, relevance int"),
        spark.createDataFrame([(1, 2, 0.25)], f"{keys}, tfidf_cosine double"),
        spark.createDataFrame([(1, 2, "a b", "x", "x")], f"{keys}, candidate_text string, candidate_family string, job_family string"),
    ).collect()[0]
    assert (out["tfidf_cosine"], out["candidate_text_length"], out["same_role_family"], out["label"]) == (0.25, 2.0, 1.0, 1)
