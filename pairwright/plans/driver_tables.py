"""Relations of the engine built from the given tables.

Every relation is a plain projection, join or aggregate over whole tables, so
the work of a query grows with them.  Pairs are *applications*: a customer who
ordered from a supplier applied to that supplier's job, which grows with the
order lines and not with jobs x candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import matching as m
from ..session import written
from .prefix import top_per_group

REQUIRED, PREFERRED, CERTIFICATION = 5, 8, 9

#: Degree texts by market segment, and required degree texts by supplier key.
DEGREES = {
    "AUTOMOBILE": "B.S. Computer Science",
    "BUILDING": "M.S. Data Science",
    "FURNITURE": "Diploma in Electronics",
    "HOUSEHOLD": None,
    "MACHINERY": "Ph.D. Physics",
}
DEMANDS = {0: None, 1: "Associate degree", 2: "Bachelor of Science", 3: "Master of Science"}


#: Schemas of the given tables; stating them saves one inference job per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, values: dict) -> F.Column:
    out = None
    for key, value in values.items():
        test = F.col(column) == key
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.cast("string")


def order_span(spark, d) -> DataFrame:
    """First and last order date per customer."""
    return (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("candidate_id"))
        .agg(F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))
    )


def candidates(spark, d) -> DataFrame:
    customer = table(spark, d, "customer")
    nation = table(spark, d, "nation")
    months = lambda c: F.year(c) * 12 + F.month(c)
    total = F.round(
        F.coalesce(months(F.col("last_order")) - months(F.col("first_order")), F.lit(0))
        / F.lit(12.0),
        2,
    )
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumnRenamed("c_custkey", "candidate_id")
        .join(order_span(spark, d), "candidate_id", "left")
        .select(
            "candidate_id",
            F.col("c_name").alias("full_name"),
            F.concat(
                F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"),
                F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".example"),
            ).alias("email"),
            F.col("n_name").alias("location"),
            F.col("c_mktsegment").alias("current_title"),
            total.alias("total_experience_years"),
            F.when(F.col("candidate_id") % 3 == 0, 0.0)
            .otherwise(F.round(total * 0.8, 2))
            .alias("relevant_experience_years"),
            _case("c_mktsegment", DEGREES).alias("highest_degree"),
            F.array(
                F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string"),
                         F.lit(" Certified"))
            ).alias("certifications"),
            F.when(F.col("c_acctbal") < 0, "failed").otherwise("parsed").alias("status"),
            (F.col("c_acctbal") > 8000).alias("shortlisted"),
            (F.col("candidate_id") % 50 == 0).alias("is_deleted"),
            F.col("first_order").alias("created_at"),
            F.col("last_order").alias("updated_at"),
            F.col("c_nationkey"),
        )
    )


def order_lines(spark, d) -> DataFrame:
    """One row per order line: customer, supplier, brand."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )


def candidate_skills(spark, d) -> DataFrame:
    return (
        order_lines(spark, d)
        .groupBy(F.col("o_custkey").alias("candidate_id"), F.col("p_brand").alias("brand"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "candidate_id",
            F.lower("brand").alias("normalized_name"),
            F.least(F.lit(0.95), F.round(0.4 + 0.1 * F.col("n"), 2)).alias("confidence"),
            (F.col("n") * 0.5).alias("years_experience"),
            (F.col("n") >= 4).alias("is_certified"),
            F.array(F.concat(F.lit("seen in "), F.col("n").cast("string"), F.lit(" lines"))).alias(
                "evidence"
            ),
        )
    )


def skills(spark, d) -> DataFrame:
    return (
        table(spark, d, "part")
        .groupBy("p_brand")
        .agg(F.min("p_type").alias("category"))
        .select(
            F.lower("p_brand").alias("normalized_name"), F.col("p_brand").alias("name"),
            F.lower("category").alias("category"),
            F.array(F.replace("p_brand", F.lit("Brand#"), F.lit("brand no "))).alias("aliases"),
        )
    )


def requirements(spark, d) -> DataFrame:
    """Ranked brands of a supplier: 1-5 required, 6-8 preferred, 9 certification."""
    counts = (
        table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
        .join(
            table(spark, d, "part").select("p_partkey", "p_brand"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        .groupBy(F.col("l_suppkey").alias("job_id"), F.col("p_brand").alias("term"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = top_per_group(
        counts, ["job_id"], [F.col("n").desc(), F.col("term").asc()], CERTIFICATION, "position"
    )
    return ranked.select(
        "job_id", "term", "position",
        F.when(F.col("position") <= REQUIRED, "required")
        .when(F.col("position") <= PREFERRED, "preferred")
        .otherwise("certification")
        .alias("importance"),
    ).where("importance <> 'certification' OR job_id % 3 <> 0")


def jobs(spark, d) -> DataFrame:
    def listed(importance: str) -> F.Column:
        rows = F.array_sort(
            F.collect_list(F.when(F.col("importance") == importance, F.struct("position", "term")))
        )
        return F.transform(rows, lambda r: r["term"])

    lists = requirements(spark, d).groupBy("job_id").agg(
        listed("required").alias("required_skills"),
        listed("preferred").alias("preferred_skills"),
        listed("certification").alias("certifications"),
    )
    supplier = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "job_id")
    nation = table(spark, d, "nation")
    region = table(spark, d, "region")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(lists, "job_id", "left")
        .withColumn("_demand", F.col("job_id") % 4)
        .select(
            "job_id",
            F.col("s_name").alias("title"),
            F.col("r_name").alias("department"),
            F.col("n_name").alias("location"),
            F.lit("full-time").alias("employment_type"),
            F.concat(F.col("s_name"), F.lit(" hires in "), F.col("n_name")).alias("description"),
            (F.col("job_id") % 9).cast("double").alias("experience_required_years"),
            _case("_demand", DEMANDS).alias("education_required"),
            *[
                F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
                for c in ("required_skills", "preferred_skills", "certifications")
            ],
            (F.col("s_acctbal") > 0).alias("is_active"),
            F.date_add(F.lit("2000-01-01").cast("date"), (F.col("job_id") * 37 % 365).cast("int"))
            .alias("created_at"),
        )
    )


def applications(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("l_suppkey").alias("job_id"), F.col("o_custkey").alias("candidate_id"))
        .distinct()
    )


def eligible_applications(spark, d) -> DataFrame:
    live = m.eligible_candidates(candidates(spark, d)).select("candidate_id")
    return applications(spark, d).join(live, "candidate_id", "left_semi")


def _vectors(spark, d, ids: DataFrame, key: str) -> DataFrame:
    """Each id meets the stored vector its key maps to."""
    stored = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = stored.agg(F.count(F.lit(1))).scalar()
    return (
        ids.select(key, (F.col(key) % n).alias("vec_id")).join(stored, "vec_id")
        .select(key, "embedding")
    )


def job_vectors(spark, d) -> DataFrame:
    return _vectors(
        spark, d, table(spark, d, "supplier").select(F.col("s_suppkey").alias("job_id")), "job_id"
    )


def candidate_vectors(spark, d) -> DataFrame:
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id"))
    return _vectors(spark, d, ids.where("candidate_id % 17 <> 0"), "candidate_id")


def profiles(spark, d) -> tuple[DataFrame, DataFrame]:
    """Job and candidate profiles that pairs are scored with."""
    return (
        m.job_profiles(jobs(spark, d), job_vectors(spark, d)),
        m.candidate_profiles(
            candidates(spark, d), candidate_skills(spark, d), candidate_vectors(spark, d)
        ),
    )


def scored(spark, d, weights=None) -> DataFrame:
    """Every eligible application, scored."""
    return m.score_pairs(eligible_applications(spark, d), *profiles(spark, d), weights)


def scored_in_steps(spark, d) -> DataFrame:
    """The rows of :func:`scored`, from pairs and profiles written first.

    The shuffle files of each step go before those of the next one come, which large rankings need.
    """
    pairs = written(spark, eligible_applications(spark, d), "pairs")
    jobs_, candidates_ = profiles(spark, d)
    return m.score_pairs(pairs, written(spark, jobs_, "job-profiles"), written(spark, candidates_, "candidate-profiles"))


def match_results(spark, d) -> DataFrame:
    return m.match_results(scored(spark, d))


# -- documents ----------------------------------------------------------------
#: Month that open-ended ranges of the derived documents end in (2002-01).
AS_OF = 2002 * 12 + 1
TITLES = {
    "1-URGENT": "Data Engineer", "2-HIGH": "Software Developer", "3-MEDIUM": "Sales Manager",
    "4-NOT SPECIFIED": "Machine Learning Scientist", "5-LOW": "Office Coordinator",
}
CITIES = {"F": "Lyon, France", "O": "Osaka, Japan", "P": "Lagos, Nigeria"}
STUDIES = {0: "B.S. Computer Science", 1: "M.S. Data Science", 2: "MBA"}


def resumes(spark, d) -> DataFrame:
    """One resume text per order: its dates, customer and brands as a reader would write them."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda c: c.cast("string")
    start = F.trunc(F.col("o_orderdate").cast("date"), "month")
    end = F.add_months(start, (key % 17).cast("int"))
    kind = key % 4
    span = (
        F.when(kind == 0, F.concat(F.date_format(start, "MMM yyyy"), F.lit(" - "), F.date_format(end, "MMM yyyy")))
        .when(kind == 1, F.concat(text(F.year(start)), F.lit(" - "), text(F.year(end))))
        .when(kind == 2, F.concat(F.date_format(start, "MMMM yyyy"), F.lit(" - Present")))
        .otherwise(F.concat(F.date_format(start, "yyyy/MM"), F.lit(" to "), F.date_format(end, "yyyy/MM")))
    )
    title = _case("o_orderpriority", TITLES)
    city = _case("o_orderstatus", CITIES)
    orders = table(spark, d, "orders").withColumn("_study", key % 3)
    customer = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    first = 1985 + key % 5
    lines = [
        F.concat(F.initcap("c_mktsegment"), F.lit(" "), F.substring_index(city, ",", 1)),
        title,
        F.concat(F.lit("c"), text(cust), F.lit("@mail.example | +1 415 555 "), text(1000 + key % 9000), F.lit(" | "), city),
        F.lit(""), F.lit("SUMMARY"),
        F.concat(F.lit("Handled order "), text(key), F.lit(" with care.")),
        F.lit("EXPERIENCE"),
        F.concat(title, F.lit(", Acme Works, "), span),
        F.concat(F.lit("- Shipped order "), text(key)),
        F.concat(F.lit("Intern, Beta Labs, "), text(first), F.lit(" - "), text(first + 1)),
        F.lit("EDUCATION"),
        F.concat(_case("_study", STUDIES), F.lit(", University of Testing, "), text(1980 + cust % 15)),
        F.lit("SKILLS"),
        F.concat(F.lit("Brand#"), text(key % 25 + 1), F.lit(", Brand#"), text(cust % 25 + 1), F.lit(" (3 years)")),
        F.lit("CERTIFICATIONS"), F.lit("Databricks Certified Engineer"),
    ]
    docs = orders.join(customer, cust == F.col("c_custkey")).select(
        key.alias("doc_id"), F.concat_ws("\n", *lines).alias("text")
    )
    return spread(docs)


def spread(docs: DataFrame) -> DataFrame:
    """Documents dealt out by id: parsing is CPU work, and one file block may hold far too much of it.

    The number of parts is given, or adaptive execution would join them by their few bytes.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return docs.repartition(parts, "doc_id")


def documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def job_texts(spark, d) -> DataFrame:
    """One job description per supplier, listing its ranked brands."""
    years = F.col("job_id") % 9 + 1
    lines = [
        F.lit("Platform Engineer"),
        F.concat(F.lit("Department: "), F.col("department")),
        F.concat(F.lit("Location: "), F.col("location")),
        F.lit("REQUIRED SKILLS"), F.array_join("required_skills", ", "),
        F.lit("PREFERRED SKILLS"), F.array_join("preferred_skills", ", "),
        F.lit("REQUIREMENTS"),
        F.concat(F.lit("- "), years.cast("string"), F.lit("+ years of experience.")),
        F.lit("- Master's degree in Physics"),
        F.lit("RESPONSIBILITIES"), F.concat(F.lit("- Run "), F.col("title")),
    ]
    return jobs(spark, d).select("job_id", F.concat_ws("\n", *lines).alias("text"))


def stored_files(spark, d) -> DataFrame:
    """A file relation: one stored document per order, foldered by month."""
    ext = _case("o_orderpriority", {"1-URGENT": ".pdf", "2-HIGH": ".DOCX", "3-MEDIUM": ".txt", "4-NOT SPECIFIED": ".exe", "5-LOW": ""})
    return table(spark, d, "orders").select(
        F.concat(
            F.date_format("o_orderdate", "yyyyMM"), F.lit("/doc-"), F.col("o_orderkey").cast("string"), ext
        ).alias("path"),
        F.col("o_orderdate").cast("timestamp").alias("modificationTime"),
        F.floor(F.col("o_totalprice") * 30).cast("bigint").alias("length"),
    )


def document_files(spark, d) -> DataFrame:
    """The documents as a file relation with binary content."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"),
                 F.when(F.col("doc_id") % 10 == 0, ".exe").otherwise(".txt")).alias("path"),
        F.lit("2024-01-01").cast("timestamp").alias("modificationTime"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
    )


def dictionary(spark, d) -> DataFrame:
    """A skill catalogue whose surface forms are all words of ``benchmark``."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")
    return table(spark, d, "benchmark").select(word).distinct().select(
        F.col("w").alias("normalized_name"), F.col("w").alias("name"), F.lit("other").alias("category"),
        F.array().cast("array<string>").alias("aliases"),
    )
