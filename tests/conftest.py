import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpuslens.session import build_session
    ckpt = tempfile.mkdtemp(prefix="corpuslens-test-ckpt-")
    s = build_session("local[4]", shuffle_partitions=4, app_name="corpuslens-tests",
                      extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
