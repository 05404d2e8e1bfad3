import tempfile

import pytest

from spanloom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"), "spark.driver.memory": "4g", "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
