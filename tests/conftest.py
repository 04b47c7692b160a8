import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def make(tmp_path):
    """Writes a tree of files from {path: text or bytes} and returns its root."""

    def write(files, name="tree"):
        root = tmp_path / name
        for path, body in files.items():
            at = root / path
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(body if isinstance(body, bytes) else body.encode())
        os.makedirs(root, exist_ok=True)
        return str(root)

    return write
