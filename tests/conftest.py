import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


PATCH = "row_id BIGINT, conv_id BIGINT, patch_id STRING, turn_index INT, patch_type STRING, payload STRING, dependencies ARRAY<STRING>, utility DOUBLE, token_cost INT, ingested_at TIMESTAMP_NTZ"


@pytest.fixture(scope="session")
def patches_of(spark):
    import datetime

    t0 = datetime.datetime(2031, 1, 1)

    def make(rows, extra=False):
        """rows: dicts with any of the columns; the others are null, row_id and times follow the order."""
        names = [c.split()[0] for c in PATCH.split(", ")]
        data = []
        for i, r in enumerate(rows):
            r = {"row_id": i, "conv_id": 1, "patch_id": f"p0_{i}", "turn_index": 0, "patch_type": "entity", "ingested_at": t0 + datetime.timedelta(minutes=i)} | r
            data.append(tuple(r.get(n) for n in names))
        df = spark.createDataFrame(data, PATCH)
        if extra:
            for c in ("dep", "ref_id", "word", "block", "_rank", "sig", "n", "path", "lang2", "rep"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make
