import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    work = tempfile.mkdtemp(prefix="spark-")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.local.dir": work, "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{work}/shared"}
    session = SparkSession.builder.master("local[4]").config(map=conf).config("spark.executorEnv.PYTHONPATH", str(ROOT)).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    import __spark_entry__

    __spark_entry__._ship(session)
    yield session
    session.stop()
