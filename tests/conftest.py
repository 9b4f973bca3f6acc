import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mutagrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    return local_session(os.environ.get("TEST_CPUS", "4"), 4, **{"spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
