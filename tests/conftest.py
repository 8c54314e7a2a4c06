import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from maskwell.session import ship

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    """Runs SQL over the smallest tables."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return lambda sql: con.execute(sql).df()


def normal(df):
    """A pandas table with sorted columns and rows, as text."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
        df[c] = df[c].astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def same():
    def check(got, want):
        a, b = normal(got), normal(want)
        assert list(a.columns) == list(b.columns)
        assert a.shape == b.shape
        assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head()

    return check
