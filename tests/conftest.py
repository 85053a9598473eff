import glob
import os

import pandas as pd
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def several_ranges(spark):
    """Small tables would be one range else."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(frame, columns):
    frame = frame[columns].astype(object)
    rows = (tuple(None if pd.isna(x) else round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.itertuples(index=False, name=None))
    return sorted(rows, key=lambda r: [(x is not None, 0 if x is None else x) for x in r])


@pytest.fixture(scope="session")
def same(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")

    def check(query, sql):
        got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns)) or sorted(map(str, rows_of(got, sorted(got.columns)))) == sorted(map(str, rows_of(want, sorted(got.columns))))

    return check
