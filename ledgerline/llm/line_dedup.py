"""Operator 12: lines that many documents share go, but from the first document that has them.

1. Lines are exploded and normalised (blanks stripped at both ends, A-Z lower-cased); each key of at least
   ``shortest`` code points becomes two 64-bit hashes of different seeds (128 bits together).
2. Each task counts a key once a document before anything is shuffled; then distinct documents are
   counted per key, by (key, document) first, so that a line which a third of all documents share is
   spread over all tasks.
3. Keys of ``documents`` documents and more are joined back to their lines, and each text gets the places of the lines
   that it loses. Hot keys, each more than a ``HOT``-th of what all such keys count (so fewer than ``HOT`` of them, which
   bounds their broadcast), get salts: their lines meet in many tasks.
4. Texts are put together again from the places that stay, in their order.

A text is known by its id and hash, as what goes depends on these alone. Defined results: a null or
empty text is one empty line; rows with one id, or without an id, are one document each time they are counted, and
a null id comes after all others; equal rows lose the same lines; a text that loses all its lines becomes empty;
an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import checkpointed, whole_text

SHORTEST = 10
DOCUMENTS = 2
HOT = 512
SALTS = 64
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEXT = ("doc_id", "text_low", "text_high")
_KEY = ("low", "high")


def _hashes(value: Column | str) -> tuple[Column, Column]:
    """128 bits of a text: XXH64 of two seeds."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def lines_of(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, text_low, text_high, place, low and high of the lines whose key is long enough."""
    own = split_lines(F.translate(F.col("text"), _UPPER, _LOWER))
    lines = docs.select(*_TEXT, F.posexplode(own).alias("place", "line")).select(*_TEXT, "place", F.btrim(F.col("line"), F.lit(_BLANKS)).alias("key"))
    low, high = _hashes("key")
    return lines.where(F.length("key") >= shortest).select(*_TEXT, "place", low.alias("low"), high.alias("high"))


def shared_keys(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """low, high, documents and first of the keys in ``documents`` documents: their number, and the least id."""
    once = lines.groupBy(*_KEY, "doc_id").agg(F.lit(1).alias("one"))
    # Nulls aren't seen by a minimum, but a document they are.
    counted = once.groupBy(*_KEY).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))
    return counted.where(F.col("documents") >= documents)


def with_first(lines: DataFrame, shared: DataFrame, hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """The lines whose key is shared, with the first document of it."""
    total = shared.agg(F.sum("documents")).first()[0] or 0
    is_hot = F.col("documents") * hot > total
    keys = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, salts - 1).otherwise(0)))).select(*_KEY, "salt", "first")
    marked = lines.join(F.broadcast(shared.where(is_hot).select(*_KEY, F.lit(True).alias("hot"))), list(_KEY), "left")
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "text_low"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    return marked.withColumn("salt", spread).drop("hot").join(keys, [*_KEY, "salt"])


def drop_shared_lines(docs: DataFrame, shortest: int = SHORTEST, documents: int = DOCUMENTS) -> DataFrame:
    """doc_id, text, n_lines, n_dropped and kept_text of every row."""
    low, high = _hashes("text")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs["text"]).alias("text")).withColumns({"text_low": low, "text_high": high})
    lines = lines_of(rows, shortest)
    gone = with_first(lines, checkpointed(shared_keys(lines, documents))).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    places = gone.groupBy(*_TEXT).agg(F.collect_set("place").alias("gone"))
    # Nulls are equal here: an id that is missing is told apart by its flag.
    key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_low", "text_high"]
    names = ["id", "no_id", "text_low", "text_high"]
    both = rows.select("*", *key[:2]).join(places.select(*key, "gone"), names, "left")
    own = split_lines(F.col("text"))
    both = both.withColumn("lines", own).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return both.select("doc_id", "text", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept_text"))
