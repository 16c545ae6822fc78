"""Retention by sketches: rows that stay for sure aren't shuffled, and the rest is exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import fixpoint, retain, sketch
from ledgerline.plans import catalog


def test_a_sketch_misses_no_key(spark):
    rows = spark.range(1000).select((F.col("id") % 700).alias("k"))
    again = sketch.repeated(rows, "k")
    assert {r["k"] for r in sketch.maybe(rows, again, "k").collect()} >= set(range(300))
    assert sketch.maybe(rows, again, "k").count() + sketch.never(rows, again, "k").count() == 1000


def test_support_with_unreached_sources_and_repeated_keys(spark):
    edges = spark.createDataFrame([("a", "b"), ("x", "b"), ("x", "y"), ("y", "a"), ("b", "b")], "source string, target string")
    g = catalog._relations(edges.unionByName(edges.where("source = 'x'")))
    reached = spark.createDataFrame([("all", "a"), ("all", "b")], "solution_key string, key string")
    relations, keys = retain.supported(g, reached)
    assert sorted(r["key"] for r in relations.collect()) == ["a>b", "b>b", "x>b", "y>a"]
    assert sorted(r["key"] for r in keys.collect()) == ["a", "b", "x", "y"]


def test_edges_back_into_the_seeds_change_no_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "e"), ("d", None), ("z", "y")], "source string, target string")
    seeds = spark.createDataFrame([("a",), ("b",)], "node string")
    assert sorted(r["node"] for r in fixpoint.reachable(seeds, edges).collect()) == ["a", "b", "c", "d"]
