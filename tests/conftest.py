import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    s = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def compare(spark, name, query, sql, sf_dir):
    """A query's rows against its SQL's on the same tables."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    df = query(spark, sf_dir)
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns), name
    key = lambda row: tuple(map(str, row))
    got = sorted((tuple(row[c] for c in names) for row in df.collect()), key=key)
    assert got == sorted(r.fetchall(), key=key), name
