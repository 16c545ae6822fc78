"""Every catalog query against its SQL, and the driver's contract."""

from collections import defaultdict

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    compare.assert_same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE_SQL[name])



def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5
    assert [r["fan_in"] for r in rows] == sorted((r["fan_in"] for r in rows), reverse=True)


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_ordinal_is_looked_up(spark):
    packed = catalog.QUERIES["shard_pack"](spark, SF).orderBy("doc_id").collect()
    rows = catalog.QUERIES["shard_lookup"](spark, SF).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["shard"]) for r in rows] == [(i, r["shard"]) for i, r in enumerate(packed)]


def test_fans_of_every_scope(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").join(spark.read.parquet(f"{SF}/orders.parquet").where("o_orderstatus <> 'P'"), F.expr("l_orderkey = o_orderkey")).select("l_orderkey", "l_suppkey").collect()
    out, into = defaultdict(set), defaultdict(set)
    for r in lines:
        source, target = f"document:all:orders/o{r['l_orderkey']}.cs", f"document:all:suppliers/s{r['l_suppkey']}.cs"
        out[source].add(target)
        into[target].add(source)
    rows = catalog.QUERIES["fan_in_out"](spark, SF).collect()
    got = {r["entity"]: (r["fan_in"], r["fan_out"]) for r in rows if r["scope"] == "document"}
    assert got == {k: (len(into[k]), len(out[k])) for k in {*out, *into}}
    best = sorted(rows, key=lambda r: (-r["fan_in"], r["scope"], r["entity"]))[:5]
    assert [(r["scope"], r["entity"]) for r in catalog.QUERIES["top_fan_in"](spark, SF).collect()] == [(r["scope"], r["entity"]) for r in best]


def test_files_are_scanned_by_many_tasks(spark):
    """A table of a single row group is one task's as it is read; each of its rows is a file to be scanned."""
    files = catalog._files(spark, "/root/testdata/sf0.001")
    tasks = files.select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > spark.sparkContext.defaultParallelism
    assert files.count() == files.select("relative_path").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_outgoing_index_has_all_scopes(spark):
    rows = {(r["source"], r["ordinal"]) for r in catalog.QUERIES["dep_order"](spark, SF).collect()}
    found = catalog.QUERIES["nav_outgoing"](spark, SF).collect()
    assert {(r["key"], int(x)) for r in found for x in r["ordinals"].split(",")} == rows
    assert {":".join(r["key"].split(":")[:3:2]) for r in found} >= {"entity:component", "entity:deploymentunit"} and {r["key"].split(":")[0] for r in found} == {"entity", "document", "project"}
