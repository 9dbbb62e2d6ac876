"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF_DIR = "/root/testdata/sf0.001"
SMALL = (
    "top_candidates_per_job", "requirement_status_split", "search_candidates", "search_by_all_skills",
    "dashboard_stats", "per_query_metrics", "classification_metrics", "group_folds", "merged_experience",
    "anonymise_candidates", "validate_files", "rate_limit_flags", "skill_catalogue",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", SMALL)
def test_query_equals_sql(spark, connection, name):
    problem = oracle.compare(
        spark, connection, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR
    )
    assert problem is None, problem


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
