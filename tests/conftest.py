import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared").as_uri()
    made = SparkSession.builder.master("local[4]").config("spark.checkpoint.dir", shared).config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
