import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessella.session import session

    home = tmp_path_factory.mktemp("spark")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    s = session("tests", **{
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": str(home / "warehouse"), "spark.checkpoint.dir": str(home / "shared"), "spark.driver.memory": "4g",
    })
    s.sparkContext.setLogLevel("ERROR")
    return s
