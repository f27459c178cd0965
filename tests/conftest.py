import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from eventspark.session import build_session
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    s = build_session("local[4]", app_name="eventspark-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "6g",
                             "spark.checkpoint.dir": f"{scratch}/checkpoints",
                             "spark.sql.warehouse.dir": f"{scratch}/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(f"{scratch}/checkpoints")
    yield s
    s.stop()


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
