from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from fluxora.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, app="fluxora-tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture()
def values(spark):
    """Evaluate one column expression over a list of single values."""

    def run(make, items, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
        from pyspark.sql import functions as F

        rows = df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()
        return [r["out"] for r in rows]

    return run
