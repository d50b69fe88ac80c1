"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

from axisfield import catalog
from axisfield import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = own.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(own.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    a = got[columns].sort_values(columns).reset_index(drop=True)
    b = want[columns].sort_values(columns).reset_index(drop=True)
    for c in columns:
        if a[c].dtype.kind == "f":
            assert (a[c].isna() == b[c].isna()).all() and ((a[c] - b[c]).abs().fillna(0) <= 1.1e-6).all(), c
        else:
            assert (a[c] == b[c]).all(), c


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_empty_measure_is_an_error(spark):
    from pyspark.sql import functions as F

    from axisfield.operators import reductions as R

    with pytest.raises(Exception, match="measure is zero"):
        R.mean(spark.createDataFrame([(1.0, 0.0)], "x double, w double"), F.col("x")).collect()
