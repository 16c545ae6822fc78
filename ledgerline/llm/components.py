"""Connected components of a graph whose links are rows, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import checkpointed

MOST_ROUNDS = 100


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the least of the node and all its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them; in ``pairs`` u > v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    tied = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u != v").distinct()


def connected_components(links: DataFrame, x: str, y: str) -> DataFrame:
    """node and root (its component's least node) of every node that has a link to another.

    Rows are pairs of numbers and each round cuts the lineage; the rounds grow with the
    logarithm of the largest component. Nulls and loops are left out.
    """
    pairs = links.select(F.greatest(x, y).cast("long").alias("u"), F.least(x, y).cast("long").alias("v")).where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))).distinct()
    pairs = checkpointed(pairs)
    before = None
    for _ in range(MOST_ROUNDS):
        # Done once the pairs stay the same: a star around each component's least node.
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before or not now[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        pairs = checkpointed(_small_star(_large_star(pairs)))
    raise RuntimeError(f"components have not settled after {MOST_ROUNDS} rounds")
