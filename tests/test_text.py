"""Hand-checked values for parsers and column functions."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from pairwright.functions import dates, education, text as tx, tolerant_json as tj
from pairwright.operators import catalogue as cat, documents as dc, extract as xt, job_text as jt

AS_OF = 2026 * 12 + 12


@pytest.fixture(scope="module")
def aliases(spark):
    return cat.alias_table(fx.catalogue(spark)).cache()


def _map(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_degree_ranks(spark):
    texts = ["B.S. Computer Science", "B Tech Mechanical Engineering", "M.S. in Data Science", "MBA",
             "Ph.D. Physics", "High School", "", None]
    assert _map(spark, texts, education.degree_rank) == [4, 4, 5, 5, 6, 1, 0, 0]


def test_date_ranges(spark):
    texts = ["Mar 2019 - 2022", "2021 - Present", "06/2019 - 08/2021", "Jan 2020 - Foo 99", "somewhen",
             "Jan 2020 to Mar 2018"]
    got = _map(spark, texts, lambda c: dates.date_range(c, F.lit(AS_OF)))
    spans = [None if r is None else (r["start"], r["end"], r["is_current"]) for r in got]
    m = lambda y, n: y * 12 + n
    assert spans == [
        (m(2019, 3), m(2022, 12), False), (m(2021, 1), AS_OF, True), (m(2019, 6), m(2021, 8), False),
        None, None, (m(2018, 3), m(2020, 1), False),
    ]
    assert spans[0][1] - spans[0][0] == 45


def test_normalisation(spark):
    texts = ["Crème & brûlée C++ node.js!", "  A   b ", None, "① ﬁne Ⅳ", "K\u0301 ½ 𝐀𝟗 ＋", "漢字"]
    assert _map(spark, texts, tx.normalize_text) == [
        "creme and brulee c++ node.js", "a b", "", "1 fine iv", "k 1 2 a9 +", ""
    ]
    assert _map(spark, ["ﬁne ①"], tx.normalize_unicode) == ["fine 1"]
    assert _map(spark, ["ASP.net", "C#", "!"], tx.slugify_unknown) == ["asp_dotnet", "c#", "unknown"]


def test_tolerant_json(spark):
    texts = ['["a","b"]', "5", '{"a":1}', "1,2", "[bad", "", None]
    assert _map(spark, texts, tj.json_list) == [["a", "b"], ["5"], ['{"a":1}'], [], [], [], []]
    assert _map(spark, texts, tj.json_dict)[2] == {"a": "1"}


def test_education_keeps_at_inside_a_name(spark):
    texts = ["B.S. Statistics, University of Texas at Austin, 2016",
             "MS Computer Science at Stanford University",
             "B.S. Computer Science, UC Davis, 2014\nM.S. Data Science, Stanford University, 2019"]
    got = _map(spark, texts, xt.education_of)
    assert [(g["highest_degree"], g["institution"]) for g in got] == [
        ("B.S. Statistics", "University of Texas at Austin"),
        ("MS Computer Science", "Stanford University"),
        ("M.S. Data Science", "Stanford University"),
    ]


def test_mentions_are_leftmost_longest(spark, aliases):
    lines = spark.createDataFrame(
        [(1, "C++ and c, Node.js; certified archives conservator, golang2 pyspark")], "k int, t string"
    )
    hits = cat.find_skill_mentions(lines, ["k"], "t", aliases).orderBy("start").collect()
    assert [h["normalized_name"] for h in hits] == [
        "c_plus_plus", "nodejs", "archives_conservator", "apache_spark"
    ]


@pytest.mark.parametrize("slice_chars", [1, 7, 1 << 20])
def test_mentions_equal_a_search_at_every_place(spark, monkeypatch, slice_chars):
    """Both ways, cut into pieces and whole, against one alternation of all surface forms."""
    monkeypatch.setattr(cat, "_PIECE", slice_chars)
    draw = random.Random(slice_chars)
    words = ["a", "ab", "b", "c++", "c", "+", ".net", "b.", "ab c", "a b a", "b a b", "c#", "#", "a.b"]
    forms = draw.sample(words, 10) + ["long alias of words"]
    texts = [None, "", "long alias of words", "the long alias of word"] + [
        draw.choice(["", " "]).join(draw.choice([*words, " ", "x", "9", "É"]) for _ in range(draw.randint(0, 30))) for _ in range(150)
    ]
    aliases = cat.alias_table(spark.createDataFrame([(f, f, "other", []) for f in forms], "normalized_name string, name string, category string, aliases array<string>"))
    lines = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    normal = {r[0]: r[1] for r in lines.select("k", tx.normalize_text("t")).collect()}
    every = "|".join(re.escape(f) for f in sorted({r["alias"] for r in aliases.collect()}, key=lambda f: (-len(f), f)))
    # A mention begins where a token does and touches no letter or digit.
    pattern = re.compile(rf"(?:(?<![a-z0-9]))(?:{every})(?![a-z0-9])")
    want = sorted((k, m.group(), m.start(), m.end()) for k, t in normal.items() for m in pattern.finditer(t))
    for limit in (0, 1 << 16):
        monkeypatch.setattr(cat, "AUTOMATON_ALIASES", limit)
        hits = cat.find_skill_mentions(lines, ["k"], "t", aliases).collect()
        assert sorted((h["k"], h["surface"], h["start"], h["end"]) for h in hits) == want
    assert len(want) > 50


def test_long_line_is_matched_whole(spark, aliases):
    lines = spark.createDataFrame([(1, "filler " * 2000 + "python")], "k int, t string")
    (hit,) = cat.find_skill_mentions(lines, ["k"], "t", aliases).collect()
    assert (hit["start"], hit["end"]) == (14000, 14006)


def test_running_headers_and_blanks(spark):
    body = [f"line {chr(97 + i)}" for i in range(26)]
    text = "\n".join(["Header"] + body[:13] + ["Header", "", "", "page 2 of 3"] + body[13:] + ["Header"])
    docs = spark.createDataFrame([(1, text)], "k int, text string")
    lines = dc.clean_lines(docs).collect()[0]["lines"]
    assert "Header" not in lines and "page 2 of 3" not in lines
    assert lines.count("") == 1 and len(lines) == 27


def test_resume_golden_values(spark, aliases):
    docs = spark.createDataFrame([(1, fx.CURATOR), (2, fx.BAKER)], "doc_id bigint, text string")
    profiles, skills = xt.build_candidate_profiles(docs, "doc_id", aliases, F.lit(AS_OF))
    one, two = profiles.orderBy("doc_id").collect()
    assert (one["full_name"], one["email"], one["location"]) == ("Ottoline Brask", "ottoline@brask.example", "Bergen, Norway")
    assert one["highest_degree"] == "Ph.D. Art History" and one["graduation_year"] == 2004
    assert one["institution"] == "College of Ghent at Waregem"
    assert one["certifications"] == ["Certified Archives Conservator"]
    assert one["previous_positions"] == ["Collections Manager", "Registrar"] and one["total_experience_years"] == 10.0
    assert [(e["company"], e["start"], e["end"], e["months"]) for e in one["employment_history"]] == [
        ("Maritime Museum of the North", "2009-03", "2014-08", 65), ("Glass Hall Foundation", "2004-05", "2008-12", 55)
    ]
    assert (two["full_name"], two["current_title"], two["highest_degree"]) == ("Emeka Sundqvist", "Production Manager", None)
    assert two["warnings"] == ["No skills were detected in this resume."]
    held = {r["normalized_name"]: r for r in skills.collect()}
    assert set(held) == {
        "archives_conservator", "docker", "go", "kafka", "postgresql", "python", "redis", "sql", "tms_gallery_kit"
    }
    assert held["go"]["evidence"] == ["...ght watch of sensors, read by scripts in Golang."]
    assert held["archives_conservator"]["is_certified"] and not held["sql"]["is_certified"]


def test_job_description(spark, aliases):
    docs = spark.createDataFrame([(1, fx.VACANCY)], "job_id bigint, text string")
    (job,) = jt.parse_job_descriptions(docs, "job_id", aliases).collect()
    assert job["required_skills"] == ["SQL", "Apache Kafka", "Docker"]
    assert job["preferred_skills"] == ["Python", "Terraform"] and job["experience_required_years"] == 9.0
    assert job["responsibilities"] == ["Keep soundings of forty fairways.", "Answer the night desk."]


def test_nothing_is_cut(spark, aliases):
    """Long lines, deep lines and long lists come through whole."""
    filler = [f"this remark, number {k}, says nothing of anybody in particular" for k in range(1, 20)]
    skills = ", ".join(["Python"] + [f"Tool{k:03d} Kit" for k in range(80)] + ["Redis"])
    company = "Harbour and Meadow Joint Undertaking " + "x" * 500
    text = "\n".join(
        ["an overview of the life of somebody, as told by others", *filler, "Name: Mirela Okonkwo", "mirela@example.org", "Lisbon, Portugal", "EXPERIENCE",
         f"Platform Engineer, {company}, 1971 - 2025", *[f"- did thing {k}" for k in range(30)], "SKILLS", skills]
    )
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    profiles, rows = xt.build_candidate_profiles(docs, "doc_id", aliases, F.lit(AS_OF))
    (one,) = profiles.collect()
    assert one["full_name"] == "Mirela Okonkwo" and one["location"] == "Lisbon, Portugal"
    assert one["total_experience_years"] == round((54 * 12 + 11) / 12, 2)
    held = {r["normalized_name"] for r in rows.collect()}
    assert {"python", "redis", "tool000_kit", "tool079_kit"} <= held


def test_months_of_two_digits(spark):
    texts = ["1999/03 to 2001/12", "2001/10 - 2001/12", "2001-1 to 2001-11", "2001/13 - 2002"]
    got = _map(spark, texts, lambda c: dates.date_range(c, F.lit(AS_OF)))
    m = lambda y, n: y * 12 + n
    assert [(r["start"], r["end"]) if r else None for r in got[:3]] == [
        (m(1999, 3), m(2001, 12)), (m(2001, 10), m(2001, 12)), (m(2001, 1), m(2001, 11)),
    ]


def test_documents_are_dealt_to_every_core_however_short(spark):
    """Adaptive execution joined parts of few bytes, and one task parsed them all."""
    from pairwright.plans.driver_tables import spread

    dealt = spread(spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a line").alias("text")))
    parts = dealt.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= spark.sparkContext.defaultParallelism


def test_history_is_computed_once_a_document(spark, tmp_path):
    """An inner generator had the whole parse computed again in a filter below it."""
    from pairwright.plans import driver_tables as t
    from pairwright.plans.catalog import QUERIES

    for name, row in {
        "customer": (7, "Customer#7", 3, 1.0, "BUILDING"),
        "orders": (20, 7, "F", 10.0, dt.datetime(1999, 3, 5), "1-URGENT"),
    }.items():
        spark.createDataFrame([row], t.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    out = QUERIES["employment_history"](spark, str(tmp_path))
    assert not re.search(r"Filter .*size\(", out._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(tuple(r) for r in out.collect()) == [
        (20, "Data Engineer", "Acme Works", 3, False, 2), (20, "Intern", "Beta Labs", 23, False, 0),
    ]


def test_matching_form_equals_replacing_what_is_between(spark):
    texts = ["", " ", "C++ & C# / .NET", "--a--", "Über  straße\n№ 5 ﬁn", "ΟΔΟΣ x", "́e", "ａ＋b", None]
    want = F.coalesce(F.trim(F.regexp_replace(
        F.replace(F.lower(tx.fold_accents(F.col("t"))), F.lit("&"), F.lit(" and ")), r"[^a-z0-9+#.]+", " ")), F.lit(""))
    rows = spark.createDataFrame([(v,) for v in texts], "t string").select(tx.normalize_text("t").alias("got"), want.alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
