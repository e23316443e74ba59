"""Numbers and running sums over whole tables, at few and at very many partitions."""

import pytest
from pyspark.sql import functions as F

from strandlake import catalog
from strandlake.ordering import numbered, running_sums


@pytest.fixture(params=["1", "4", "400", "4000"])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbered_with_ties_and_nulls(spark, partitions):
    # a third of the rows share one key, a sixth have none
    rows = spark.range(0, 30_000, 1, 7).select(
        F.when(F.col("id") % 6 == 0, None).when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * 7919 % 30_011).alias("k"),
        (F.col("id") % 100).alias("v"), F.lit("x").alias("first"),
    )
    got = numbered(rows, "k", then=("v",)).collect()
    assert sorted(r.ord for r in got) == list(range(30_000))
    keys = [(r.k is not None, r.k or 0, r.v) for r in sorted(got, key=lambda r: r.ord)]
    assert keys == sorted(keys)


def test_catalog_at_many_partitions(spark, partitions):
    found = catalog.queries()["catalog_list"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.ord for r in found) == list(range(len(found))) and sum(r.is_reference for r in found) == 1


def test_running_sums(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    got = running_sums(rows, "id", {"s": F.col("v"), "n": F.lit(1)}, block=64).orderBy("id").collect()
    total = 0
    for r in got:
        assert (r.s, r.n) == (total, r.id)
        total += r.v
    assert running_sums(rows.limit(0), "id", {"s": F.col("v")}).collect() == []
