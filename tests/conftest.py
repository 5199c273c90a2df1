import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faultline.session import WORK_SETTING, configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Whole scan descriptions in plans.
        .config("spark.sql.maxMetadataStringLength", "4000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set(WORK_SETTING, str(tmp_path_factory.mktemp("work")))
    yield configure(session)
    session.stop()
