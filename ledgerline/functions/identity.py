"""Canonical keys, public ids and local handles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(kind: str, *parts: Column) -> Column:
    """Parts of a key, colon-joined after its kind."""
    return F.concat_ws(":", F.lit(kind), *parts)


def solution_key(name: Column, path: Column) -> Column:
    return joined("solution", name, path)


def project_key(solution: Column, path: Column) -> Column:
    return joined("project", solution, path)


def document_key(solution: Column, path: Column) -> Column:
    return joined("document", solution, path)


def entity_key(solution: Column, kind: Column, name: Column, owner: Column | None = None) -> Column:
    return joined("entity", solution, F.lower(kind), *(() if owner is None else (owner,)), name)


def canonical_symbols(symbols: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(symbols, F.array().cast("array<string>"))))


def variant_key(variant: Column) -> Column:
    symbols = F.array_join(canonical_symbols(variant["symbols"]), ",")
    return joined("variant", variant["tfm"], variant["configuration"], F.when(symbols == "", F.lit("-")).otherwise(symbols), variant["environment"])


def evidence_key(kind: Column, payload: Column) -> Column:
    """Digest of kind and payload; the payload should name its place, or equal texts share a key."""
    return F.concat(F.lit("evidence:"), F.sha2(F.concat_ws(":", kind, payload), 256))


def relation_key(category: Column, source: Column, target: Column, discriminator: Column) -> Column:
    return F.concat(F.lit("relation:"), F.sha2(F.concat_ws(":", category, source, target, discriminator), 256))


def gap_key(kind: Column, affected: Column, discriminator: Column) -> Column:
    return F.concat(F.lit("gap:"), F.sha2(F.concat_ws(":", kind, affected, discriminator), 256))


def packed(key: Column) -> Column:
    """A key in bytes, for shuffles: a digest's hexadecimal digits, which don't compress, take half of their length. No two keys share one."""
    digest = F.concat(F.lit(b"\x01"), F.encode(F.substr(key, F.lit(1), F.length(key) - 64), "UTF-8"), F.unhex(F.substr(key, F.length(key) - 63, F.lit(64))))
    return F.when(F.rlike(key, F.lit("^[a-z]+:[0-9a-f]{64}\\z")), digest).otherwise(F.concat(F.lit(b"\x00"), F.encode(key, "UTF-8")))


def unpacked(code: Column) -> Column:
    """The key of :func:`packed` bytes."""
    rest, n = F.substr(code, F.lit(2)), F.length(code)
    digest = F.concat(F.decode(F.substr(code, F.lit(2), n - 33), "UTF-8"), F.lower(F.hex(F.substr(code, n - 31, F.lit(32)))))
    return F.when(F.substr(code, F.lit(1), F.lit(1)) == F.lit(b"\x01"), digest).otherwise(F.decode(rest, "UTF-8"))


def base32hex80(digest: Column) -> Column:
    """The leading 80 bits of a hexadecimal digest in 16 characters of base32hex."""
    return F.concat(*[F.lpad(F.lower(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(2)])


def public_id(prefix: str, key: Column) -> Column:
    """``abc_`` and 16 characters; three lower-case letters name the kind."""
    if len(prefix) != 3 or not prefix.isascii() or not prefix.islower() or not prefix.isalpha():
        raise ValueError("a public id's prefix has three lower-case letters")
    return F.concat(F.lit(prefix + "_"), base32hex80(F.sha2(key, 256)))


def collisions(rows: DataFrame, public: str, key: str) -> DataFrame:
    """Public ids that stand for several keys, with the least two of them."""
    return rows.select(public, key).distinct().groupBy(public).agg(F.count("*").alias("keys"), F.slice(F.array_sort(F.collect_set(key)), 1, 2).alias("examples")).where("keys > 1")


def handle_json(handle: Column) -> Column:
    """A handle as JSON: a string and nothing else."""
    return F.concat(F.lit('"'), handle, F.lit('"'))


def handle_of_json(text: Column) -> Column:
    """The handle of a JSON string; an error for numbers, objects, null and strings that are no handle."""
    good = F.coalesce(F.rlike(text, F.lit('^"[0-9a-z]{1,6}"$')), F.lit(False))
    return F.when(good, F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(F.raise_error(F.concat(F.lit("no handle: "), F.coalesce(text, F.lit("null")))).cast("string"))


#: Handles have at most six characters.
HANDLES = 36**6


def local_handle(place: Column) -> Column:
    """Base36 of a place counted from 0; an error from 36**6 on. Handles aren't padded, so sort by place."""
    return F.when(place >= HANDLES, F.raise_error(F.lit("local-handle-overflow")).cast("string")).otherwise(F.lower(F.conv(place.cast("string"), 10, 36)))
