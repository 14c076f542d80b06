import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({[p] if os.path.isfile(p) else sorted(glob.glob(p + '/**/*.parquet', recursive=True))})")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a DataFrame and a SQL text give the same columns and rows, in any order."""

    def check(df, sql):
        result = duck.execute(sql)
        names = [x[0] for x in result.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        want = [tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall()]
        got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)

    return check
