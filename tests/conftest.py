import os
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-tests-")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def same_rows(df, con, sql):
    """Whether a DataFrame and a SQL result have the same columns and rows."""
    result = con.execute(sql)
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == sorted(df.columns)
    order = sorted(theirs)
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    other = sorted((tuple(plain(r[theirs.index(c)]) for c in order) for r in result.fetchall()), key=key)
    assert mine == other
    return len(mine)
