"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.plans.oracle import ORACLES
from gleaner.plans.queries import QUERIES
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    oracle.same(QUERIES[name](spark, SF), ORACLES[name], con)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())


def test_zip_identities_of_large_part_keys(tmp_path, spark):
    spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") + 999_900).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    oracle.same(QUERIES["zip_identities"](spark, str(tmp_path)), ORACLES["zip_identities"], con)
