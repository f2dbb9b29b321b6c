import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def same(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return str(value) if isinstance(value, (list, dict)) else value


def compare(frame, duck, sql):
    """Both results as sorted rows, columns by name."""
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(names) == sorted(frame.columns)
    order = [names.index(c) for c in sorted(frame.columns)]
    got = sorted((tuple(same(v) for v in row) for row in frame.select(*sorted(frame.columns)).collect()), key=repr)
    assert got == sorted((tuple(same(row[k]) for k in order) for row in expected), key=repr)
