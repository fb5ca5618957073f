"""The driver contract, and a handful of queries against their SQL end to end."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortgauge.plans import oracle, population, registry

SMALL = "/root/testdata/sf0.001"
# An iterative fit over long vectors.
ROWS_ONLY = {
    "train_predict",
}


def test_every_query_has_sql_or_a_reason():
    assert set(registry.QUERIES) - set(oracle.statements()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_larger_tables_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id o_orderkey", "id % 7 o_custkey", "'F' o_orderstatus").repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    size = sum(p.stat().st_size for p in tmp_path.rglob("part-*.parquet"))
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    dealt = lambda: population._dealt(spark, str(tmp_path), "orders", columns, "o_orderkey")
    assert dealt().rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(population, "DEALT_BYTES", size // 20)
    sizes = dealt().groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert 15 <= len(sizes) <= 25 and sizes.sum() == 2000 and sizes.max() < 200


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 160


@pytest.mark.parametrize("name", ["build_cohort", "fold_roles", "threshold_youden", "positivity_verdict", "contract_all"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = registry.QUERIES[name](spark, SMALL)
    want = con.sql(oracle.statements()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(records, names):
        picked = [[dict(zip(names, r, strict=True))[c] for c in columns] for r in records]
        return sorted(["" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r] for r in picked)

    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)
