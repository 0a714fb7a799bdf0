"""The core's registered queries against their SQL."""

import duckdb
from pyspark.sql import SparkSession

from lectern import catalog


def test_token_tally():
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duckdb.sql(catalog.oracle_sql()["token_tally"]).fetchall())
    assert sorted(map(tuple, catalog.queries()["token_tally"](spark, sf).collect())) == want
