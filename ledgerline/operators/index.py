"""Navigation: ordinals, handles, inverted indexes, dictionary coding, size-bounded shards and their checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.identity import local_handle
from ledgerline.shipping import shipped
from ledgerline.storage import checkpointed, stored

SHARD_BYTES = 64 * 1024
EVIDENCE_SHARD_BYTES = 32 * 1024
SHARD_CEILING = 96 * 1024
#: Numbers that one page of a list holds.
PAGE = 1024
#: Buckets of rows whose digests are compared before the rows.
BUCKETS = 1024
MOST_ROUNDS = 100
NOTHING_OPEN = (-1, 0)


def ordinals(df: DataFrame, by: list[str], order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """Places from 0 in each group's canonical order; a group is sorted in one task, so for groups that fit one."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def spread_ordinals(df: DataFrame, by: list[str], order: list[str | Column], name: str = "ordinal", few: bool = True) -> DataFrame:
    """As :func:`ordinals`, for groups of any size: ordered ranges are sorted, stored and counted, and numbered each from its own begin.

    Rows are shuffled once, by ranges. ``few`` says that groups are few (solutions, families, indexes), so that their
    begins, a row for each group and range, are broadcast; else these are joined as any table.
    """
    more = {f"_by_{i}": c for i, c in enumerate(order) if not isinstance(c, str)}
    along = [*by, *[c if isinstance(c, str) else f"_by_{i}" for i, c in enumerate(order)]]
    # The id numbers a sorted range's rows in a row, and is above those of the ranges before.
    ranged = stored(df.withColumns(more).repartitionByRange(*along).sortWithinPartitions(*along).drop(*more).withColumn("_id", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_id", 33))
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select(*by, "_range", (F.coalesce(before, F.lit(0)) - F.col("_least")).alias("_begin"))
    return ranged.join(F.broadcast(begins) if few else begins, [*by, "_range"]).withColumn(name, F.col("_begin") + F.col("_id")).select(*df.columns, name)


def dictionary(keys: DataFrame, by: list[str], key: str, spread: bool = True) -> DataFrame:
    """Distinct keys with their ordinal and local handle; without ``spread`` for groups that fit one task."""
    return (spread_ordinals if spread else ordinals)(keys.select(*by, key).distinct(), by, [key]).withColumn("handle", local_handle(F.col("ordinal")))


def encoded(df: DataFrame, words: DataFrame, by: list[str], column: str) -> DataFrame:
    """``column`` replaced by its handle."""
    own = words.select(*by, F.col(words.columns[len(by)]).alias(column), F.col("handle").alias("_handle"))
    return df.join(own, [*by, column], "left").withColumn(column, F.coalesce("_handle", F.raise_error(F.concat(F.lit("no handle for "), F.coalesce(column, F.lit("null")))).cast("string"))).select(df.columns)


def decoded(df: DataFrame, words: DataFrame, by: list[str], column: str) -> DataFrame:
    """``column``'s handle replaced by its key; an unknown handle is corruption."""
    own = words.select(*by, F.col("handle").alias(column), F.col(words.columns[len(by)]).alias("_key"))
    return df.join(own, [*by, column], "left").withColumn(column, F.coalesce("_key", F.raise_error(F.concat(F.lit("corrupt handle "), F.coalesce(column, F.lit("null")))).cast("string"))).select(df.columns)


def inverted(rows: DataFrame, key: str, by: list[str], ordinal: str = "ordinal", category: str = "category") -> DataFrame:
    """key -> the ordinals that hold it, and their categories, both sorted and without repeats."""
    return rows.groupBy(*by, key).agg(F.array_sort(F.collect_set(ordinal)).alias("ordinals"), F.array_sort(F.collect_set(category)).alias("categories"))


def placed_pages(rows: DataFrame, by: list[str], order: list[str], page: int = PAGE) -> DataFrame:
    """``rows`` with the page of each in its group's order, ``page`` rows each: a hub's list falls into several records, and no task holds it whole."""
    return spread_ordinals(rows, by, order, "_at", few=False).withColumn("page", F.floor(F.col("_at") / page)).drop("_at")


def coded_list(values: Column) -> Column:
    """A page's ascending numbers as the first one and the gaps between them."""
    n = F.size(values)
    gaps = F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda x, before: x - before)
    return F.struct(F.get(values, F.lit(0)).alias("first"), gaps.alias("gaps"))


def decoded_list(first: Column, gaps: Column) -> Column:
    """The numbers of a page, for looking one up; whole tables decode by :func:`decoded_pages`."""
    return F.transform(F.sequence(F.lit(0), F.size(gaps)), lambda i: first + F.aggregate(F.slice(gaps, 1, i), F.lit(0).cast("long"), lambda acc, x: acc + x))


def decoded_pages(pages: DataFrame, by: list[str], name: str = "ordinal") -> DataFrame:
    """(``by``, ``name``) of every number of the pages (``by``, page, first, gaps)."""
    rows = pages.where("first is not null").select(*by, "page", F.posexplode(F.concat(F.array("first"), "gaps")).alias("_at", "_gap"))
    return rows.select(*by, F.sum("_gap").over(Window.partitionBy(*by, "page").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)).alias(name))


def inverted_pages(rows: DataFrame, by: list[str], ordinal: str = "ordinal", category: str = "category", page: int = PAGE) -> DataFrame:
    """(``by``, page, first, gaps, categories): as :func:`inverted`, but a hub's list is several pages, each with its own categories."""
    pages = placed_pages(rows, by, [ordinal], page).groupBy(*by, "page").agg(coded_list(F.array_sort(F.collect_list(ordinal))).alias("list"), F.array_sort(F.collect_set(category)).alias("categories"))
    return pages.select(*by, "page", "list.first", "list.gaps", "categories")


def pack_shards(records: DataFrame, family: str, key: str, size: str, target: int = SHARD_BYTES, ceiling: int | None = SHARD_CEILING) -> DataFrame:
    """Every record with the shard it goes to: in key order, a new shard begins where the target would be passed.

    A shard's begin depends on all records before it, yet a family is packed by many tasks: the
    table is cut into ordered chunks, each is packed from a guess of what the chunk before
    leaves open, and chunks whose guess was wrong are packed again. As soon as two
    packings of a chunk begin a shard at the same record they go on alike, so what a chunk
    leaves open hardly depends on its guess and two or three rounds settle it. The driver
    sees one row per chunk and family. A record over the ceiling is an error; where there is
    none (None), one over the target has a shard of its own.
    """
    rows = shipped(records).select(family, key, F.col(size).cast("long").alias("size"))
    # The chunks must be the same in every round, so they are kept.
    rows = checkpointed(rows.repartitionByRange(F.col(family), F.col(key)).sortWithinPartitions(family, key).withColumn("chunk", F.spark_partition_id()))
    entries: dict[tuple, tuple[int, int]] = {}  # (chunk, family): bytes and number of the shard that is open before it

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names, chunk, used, shards in _packed(batches, entries, family, key, target, ceiling, None):
            yield pd.DataFrame({"chunk": [chunk], "family": [names], "used": [used], "begun": [shards]})

    kind = dict(rows.dtypes)[family]
    for _ in range(MOST_ROUNDS):
        told = sorted(rows.mapInPandas(ends, f"chunk int, family {kind}, used long, begun long").collect(), key=lambda r: r["chunk"])
        found, open_ = {}, {}
        for r in told:
            before = open_.get(r["family"], NOTHING_OPEN)
            found[r["chunk"], r["family"]] = before
            open_[r["family"]] = (r["used"], before[1] + r["begun"])
        if found == entries or all(found[k][0] == entries.get(k, NOTHING_OPEN)[0] for k in found):
            break
        entries = found
    else:
        raise RuntimeError("shards have not settled")
    entries = found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _packed(batches, entries, family, key, target, ceiling, [family, key, "size"])

    return rows.mapInPandas(run, rows.drop("chunk").schema.add("shard", "long"))


def _packed(batches: Iterator[pd.DataFrame], entries: dict, family: str, key: str, target: int, ceiling: int | None, columns: list[str] | None) -> Iterator:
    """Pack a chunk's records; yields its rows with their shards, or (``columns`` None) what each family leaves open and has begun."""
    current = chunk = None
    used = shard = first = 0
    for batch in batches:
        shards = []
        for own_chunk, name, own, record in zip(batch["chunk"], batch[family], batch["size"], batch[key], strict=True):
            if ceiling is not None and own > ceiling:
                raise ValueError(f"oversized-record: {record}")
            if chunk is None or name != current:
                if columns is None and chunk is not None:
                    yield current, chunk, used, shard - first
                current, chunk = name, own_chunk
                used, first = entries.get((chunk, name), NOTHING_OPEN)
                shard = first  # the shard that is open where the chunk begins
            if used >= 0 and used + own > target:
                shard, used = shard + 1, 0
            used = max(used, 0) + own
            shards.append(shard)
        if columns is not None:
            yield batch[columns].assign(shard=shards)
    if columns is None and chunk is not None:
        yield current, chunk, used, shard - first


def sum_before(df: DataFrame, by: list[str], order: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """The sum of ``value`` over the rows before, in the order of a number; within blocks of that number, and over the blocks."""
    rows = df.withColumn("_block", F.floor(F.col(order) / block))

    def before(what: str, along: str, *own: str) -> Column:
        return F.coalesce(F.sum(what).over(Window.partitionBy(*own).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    blocks = rows.groupBy(*by, "_block").agg(F.sum(value).alias("_n")).select(*by, "_block", before("_n", "_block", *by).alias("_begin"))
    return rows.join(blocks, [*by, "_block"]).withColumn(name, F.col("_begin") + before(value, order, *by, "_block")).drop("_block", "_begin")


def shard_ranges(packed: DataFrame, family: str, block: int = 4096) -> DataFrame:
    """Each shard's records, bytes, and first ordinal."""
    shards = packed.groupBy(family, "shard").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))
    return sum_before(shards, [family], "shard", "records", "first", block)


def shard_of(ordinal_rows: DataFrame, ranges: DataFrame, family: str, bucket: int = 4096) -> DataFrame:
    """Range join of ordinals to the shard that holds them, as an equi-join on buckets of ordinals."""
    last = F.col("first") + F.col("records") - 1
    spans = ranges.where("records > 0").select(family, "shard", "first", last.alias("last"), F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor(last / bucket))).alias("bucket"))
    rows = ordinal_rows.select(family, "ordinal", F.floor(F.col("ordinal") / bucket).alias("bucket"))
    return rows.join(spans, [family, "bucket"]).where("ordinal between first and last").select(family, "ordinal", "shard")


def with_before(df: DataFrame, by: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """``value`` of the row before in each group's order (null for the first), for groups of any size.

    Ordered ranges look back within themselves, and the first row of each to the last one of the range before.
    """
    keys = {f"_by_{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    own = list(keys)
    ranged = checkpointed(df.withColumns({**keys, "_value": value}).repartitionByRange(*by, *own).withColumn("_range", F.spark_partition_id()))
    last = ranged.groupBy(*by, "_range").agg(F.max_by("_value", F.struct(*own)).alias("_last"))
    borders = last.select(*by, "_range", F.lag("_last").over(Window.partitionBy(*by).orderBy("_range")).alias("_border"))
    within = Window.partitionBy(*by, "_range").orderBy(*own)
    found = ranged.withColumns({"_lag": F.lag("_value").over(within), "_nth": F.row_number().over(within)}).join(borders, [*by, "_range"])
    return found.withColumn(name, F.when(F.col("_nth") == 1, F.col("_border")).otherwise(F.col("_lag"))).select(*df.columns, name)


def unsorted_rows(df: DataFrame, by: list[str], order: str, value: Column | str) -> DataFrame:
    """Rows whose value isn't greater than the one before."""
    own = F.col(value) if isinstance(value, str) else value
    return with_before(df, by, [order], own, "_before").where(F.col("_before") >= own).drop("_before")


def broken_ranges(ranges: DataFrame, family: str) -> DataFrame:
    """Shards that don't begin where the one before ends."""
    found = with_before(ranges, [family], ["shard"], F.col("first") + F.col("records"), "_end")
    return found.where(F.coalesce("_end", F.lit(0)) != F.col("first")).drop("_end")


def bucket_digests(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of each bucket and a digest of them that doesn't depend on their order: sums of two hashes, which bags of equal rows share."""
    row = F.struct(*sorted(df.columns))
    hashed = df.select(F.xxhash64(row).alias("_h"), F.xxhash64(F.lit(1), row).alias("_g"))
    # Sums of halves can't overflow below 2**31 rows of a bucket.
    halves = [F.sum(part(F.col(c))).alias(f"{c}{i}") for c in ("_h", "_g") for i, part in enumerate((lambda x: F.shiftrightunsigned(x, 32), lambda x: x.bitwiseAND(0xFFFFFFFF)))]
    return hashed.groupBy(F.pmod("_h", F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("_n"), *halves)


def differing_rows(pairs: list[tuple[DataFrame, DataFrame]], buckets: int = BUCKETS) -> list[tuple[DataFrame, DataFrame]]:
    """Of each pair of tables the rows (as bags) of one alone and of the other alone.

    Digests of all pairs are compared first, in one job, and rows shuffled only of buckets whose digests differ: equal
    tables shuffle a row for each bucket.
    """
    pairs = [(one.select(*sorted(one.columns)), other.select(*sorted(one.columns))) for one, other in pairs]
    told = [bucket_digests(df, buckets).withColumns({"_pair": F.lit(i), "_side": F.lit(side)}) for i, pair in enumerate(pairs) for side, df in enumerate(pair)]
    both = reduce(DataFrame.unionByName, told)
    digest = F.struct(*[c for c in both.columns if c not in ("bucket", "_pair", "_side")])
    odd = both.groupBy("_pair", "bucket").agg(F.count("*").alias("sides"), F.min(digest).alias("least"), F.max(digest).alias("most")).where("sides < 2 or least != most")
    found: dict[int, list[int]] = {}
    for r in odd.select("_pair", "bucket").collect():  # at most ``buckets`` of each pair
        found.setdefault(r["_pair"], []).append(r["bucket"])

    def within(df: DataFrame, own: list[int]) -> DataFrame:
        return df.where(F.pmod(F.xxhash64(F.struct(*df.columns)), F.lit(buckets)).isin(own))

    out = []
    for i, (one, other) in enumerate(pairs):
        if i in found:
            one, other = within(one, found[i]), within(other, found[i])
            out.append((one.exceptAll(other), other.exceptAll(one)))
        else:
            out.append((one.limit(0), other.limit(0)))
    return out


def same_rows(one: DataFrame, other: DataFrame, buckets: int = BUCKETS) -> bool:
    """Equal as bags of rows."""
    return bucket_digests(one, buckets).exceptAll(bucket_digests(other.select(one.columns), buckets)).isEmpty() and one.count() == other.count()
