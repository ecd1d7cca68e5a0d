import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables():
    """The smallest synthetic tables."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def agrees(spark, tables):
    """Whether a query's rows equal those of its SQL."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")

    def plain(row):
        return repr(tuple(round(x, 9) if isinstance(x, float) else x for x in row))

    def check(query, sql):
        df = query(spark, tables)
        columns, want = sorted(df.columns), con.sql(sql)
        assert sorted(want.columns) == columns
        assert sorted(map(plain, map(tuple, df.select(columns).collect()))) == sorted(map(plain, want.select(*columns).fetchall()))

    return check
