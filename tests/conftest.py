import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aislemetrics.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    warehouse = tmp_path_factory.mktemp("warehouse")
    SparkSession.builder.config("spark.sql.warehouse.dir", str(warehouse))
    session = local_session("tests", 8, scratch=str(tmp_path_factory.mktemp("scratch")))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
