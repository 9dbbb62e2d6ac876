import os

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_scratch(spark, tmp_path_factory):
    """Tests run in one process, so a folder of this machine is shared by all of it."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("test tables are not here")
    return path
