"""Operator 2: exact deduplication by skew-safe combining, built-in functions only.

1. Local: each map task's partial aggregation on (digest, salt, full text) leaves one row
   per text and task, before anything is shuffled.
2. Salted: those rows meet by (digest, salt). Only hot digests get salts: those with more
   than one row in ``HOT`` of the table (so fewer than ``HOT`` digests, whatever the size
   of the table; that bound makes them safe to broadcast). Others have the one salt 0.
3. Global: the winners of the salts of a hot digest, at most ``salts`` rows each, are
   combined. For the other digests stage 2 was global already, so each text crosses
   the network once.

Every stage groups by the full text, so equal digests never merge different texts. Rows
find their group by digest and salt; where a digest stands for several texts, which
stage 3 counts, they find it by the text as well. Any digest gives right results.

Of equal texts the row with the largest doc_id stays. Defined results: a null text counts as
empty; a null doc_id is below all others; of repeated rows (same id and text) one stays;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import checkpointed, whole_text

HOT = 512
SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def text_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, hot: int = HOT, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text, digest, salt), and the groups of equal texts: one row per (digest, salt, text).

    A group has keep_id and group_size over all salts, and n_texts, the number of
    different texts of its digest and salt.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("digest", digest(F.col("text")))
    counts = rows.groupBy("digest").agg(F.count("*").alias("rows"))
    # Fewer than `hot` digests can each have more than a `hot`-th of the rows.
    hot_digests = checkpointed(counts.where((F.col("rows") * hot > docs.count()) & (F.col("rows") > 1)).select("digest"))
    rows = rows.join(F.broadcast(hot_digests.withColumn("is_hot", F.lit(True))), "digest", "left")
    rows = rows.withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(F.lit(0)).cast("int")).select("doc_id", "text", "digest", "salt", F.coalesce("is_hot", F.lit(False)).alias("is_hot"))
    salted = rows.groupBy("digest", "salt", "is_hot", "text").agg(F.max("doc_id").alias("salt_id"), F.count("*").alias("n"))
    # One copy of each hot text and salt: no more than hot * salts texts per digest's different texts.
    winners = salted.where("is_hot").groupBy("digest", "text").agg(F.max("salt_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("its_salts"))
    groups = salted.where("not is_hot").select("digest", "salt", "text", F.col("salt_id").alias("keep_id"), F.col("n").alias("group_size")).unionByName(winners.select("digest", F.explode("its_salts").alias("salt"), "text", "keep_id", "group_size"))
    return rows, groups


def duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """doc_id, digest, keep_id, group_size and kept of every row, dropped ones too."""
    rows, groups = text_groups(docs, digest, hot, salts)
    # What crosses from here on is narrow: the text goes unless its digest stands for several.
    per_digest = Window.partitionBy("digest", "salt")
    told = groups.select("digest", "salt", F.xxhash64("text").alias("text_hash"), "keep_id", "group_size")
    told = checkpointed(told.withColumn("n_texts", F.count("*").over(per_digest)))
    shared = told.where("n_texts > 1").select("digest", "salt").distinct()
    single = told.where("n_texts = 1").select("digest", "salt", "text_hash", "keep_id", "group_size")
    narrow = rows.select("doc_id", "digest", "salt")
    if shared.isEmpty():
        found = narrow.join(single, ["digest", "salt"])
    else:
        found = narrow.join(single, ["digest", "salt"]).unionByName(_by_text(rows, groups, shared))
    # Rows alike share the id that stays; one of them does, the first as they are written down. It is found by an
    # aggregation, so that many rows without an id, or with one, meet in no task.
    found = checkpointed(found.select("doc_id", "digest", "text_hash", "keep_id", "group_size")).withColumn("row", F.monotonically_increasing_id())
    first = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "text_hash", "keep_id").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    return found.join(first, "row", "left").select("doc_id", "digest", "keep_id", "group_size", F.coalesce("first", F.lit(False)).alias("kept"))


def _by_text(rows: DataFrame, groups: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of digests that stand for several texts, matched to their groups by the text."""
    return rows.join(shared, ["digest", "salt"], "left_semi").join(groups.join(shared, ["digest", "salt"], "left_semi"), ["digest", "salt", "text"]).select("doc_id", "digest", "salt", F.xxhash64("text").alias("text_hash"), "keep_id", "group_size")


def drop_duplicates(docs: DataFrame, hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, whatever these are called."""
    kept = duplicates(docs, sha256, hot, salts).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    # The row goes as one column beside the two keys, so no name of its own can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("own_id"), sha256(whole_text(docs["text"])).alias("own_digest"))
    same = (F.col("own_digest") == F.col("kept_digest")) & F.col("own_id").eqNullSafe(F.col("kept_id"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["own_id", "own_digest"]).select("row.*")
