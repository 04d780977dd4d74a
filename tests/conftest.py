import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory(prefix="tests-") as shared:
        conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": "4g"}
        session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()
