"""The published package: size-bounded JSON shards, indexes and pages as rows, then stored, read back and verified.

A package is a table of artifacts (path, family, payload, records, digest). Bulk families
are packed in key order into shards of bounded size, so no row gathers more than a shard.
It is stored under ``generations/<digest>`` of a folder that all executors
share, as Parquet or as a file for each artifact; the pointer file that names the generation is replaced last, by an overwriting
rename, so readers see the old package or the new one. The digest covers the stored
content and is checked when it is read. A manifest per solution names its folders, with
their shards and records, and the index that each journey enters by.

Relations, evidence and who is reached are stored once; dependencies and measures cite them by
their places in sorted tables, in pages of bounded length with the gaps between the places. So a hub is many
records, in the package as on the way to it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import identity, predicates
from ledgerline.model import CATEGORIES, GAP_KINDS, ROOT_KINDS, SCOPES, SPAN, VARIANT, FactualGraph, ordinal
from ledgerline.operators import index, lift, measures, retain, sketch
from ledgerline.sources import artifact_files
from ledgerline.storage import checkpointed, stored

POINTER = "manifest.json"
#: How artifacts are stored, with the file that a finished folder has.
FORMS = {"parquet": "_SUCCESS", "files": artifact_files.COMMITTED}
#: Ceilings by a word of the solution's name: artifacts and bytes; and those of any other (fixed values).
CEILINGS = (("eshop", 1500, 64 << 20), ("pitstop", 750, 25 << 20))
DEFAULT_CEILING = (1500, 96 << 20)
#: Most reads and tokens of each journey (fixed values).
JOURNEYS = {"locate": (8, 12_000), "follow-flow": (32, 125_000), "reverse-impact": (32, 125_000), "evidence": (12, 25_000)}
#: Most reads of ``locate`` where the root is a component (fixed value).
COMPONENT_READS = 5
#: The index that each journey enters by (fixed values).
ENTRY_INDEX = {"locate": "roots", "follow-flow": "outgoing", "reverse-impact": "incoming", "evidence": "evidence"}
INDEXES = ("outgoing", "incoming", "contracts", "persistence", "runtime", "roots", "documents", "measures", "evidence", "identity")
#: Those with keys and the places of what they lead to; the evidence index routes places to shards, the identity index ids to keys.
NAVIGATION = INDEXES[:-2]
#: The ordinal that the evidence journey asks for (fixed value).
ASKED_EVIDENCE = 0
#: Entries of a bucket of the identity index, on average.
IDENTITIES = 200
RUNTIME = ("http", "grpc", "messaging")
#: Lines that one task joins for a digest.
DIGEST_LINES = 4096
#: Seconds after which a lock that its writer hasn't renewed may be taken over.
STALE_LOCK = 6 * 3600


@dataclass(frozen=True)
class Model:
    """What is retained of a graph, with its dependencies and measures; lists that grow with a hub are rows.

    members: solution_key, ordinal (of the dependency), part (relation or evidence) and key; impact:
    solution_key, scope, entity, dependent and depth.
    """

    graph: FactualGraph
    dependencies: DataFrame
    members: DataFrame
    measures: DataFrame
    impact: DataFrame


def build_model(graph: FactualGraph, include_tests: bool = False) -> Model:
    kept = retain.retained(graph, include_tests)
    members = lift.membership(kept.entities, kept.occurrences, include_tests)
    rows = stored(lift.contributions(kept.relations, kept.evidence, members, lift.project_by_document(graph.occurrences, include_tests)))
    return model_of(kept, rows, members)


def model_of(graph: FactualGraph, contributions: DataFrame, members: DataFrame | None = None) -> Model:
    """The model of a graph's contributions; with the entities' ``members`` gaps count for these too."""
    own = stored(lift.cited(contributions))
    # What is cited has no repeats, so it is counted as rows and not as sets.
    sums = [F.sum((F.col("part") == c).cast("long")).alias(f"{c}_count") for c in ("relation", "evidence")]
    counts = own.where("key is not null").groupBy(*lift.DEPENDENCY).agg(*sums)
    found = lift.variants(contributions).join(counts, list(lift.DEPENDENCY), "left").withColumns({f"{c}_count": F.coalesce(f"{c}_count", F.lit(0).cast("long")) for c in ("relation", "evidence")})
    order = [ordinal(F.col("scope"), SCOPES), "source", "target", ordinal(F.col("category"), CATEGORIES)]
    rows = stored(index.spread_ordinals(found, ["solution_key"], order))
    cited = stored(own.join(rows.select(*lift.DEPENDENCY, "ordinal"), list(lift.DEPENDENCY)).select("solution_key", "ordinal", "part", "key"))
    return measured(graph, rows, cited, members)


def measured(graph: FactualGraph, dependencies: DataFrame, cited: DataFrame, members: DataFrame | None = None) -> Model:
    """The model of numbered dependencies and what they cite."""
    pairs = stored(measures.pairs_of(dependencies))
    impact = stored(measures.reverse_impact(pairs, pairs=True))
    found = measures.assemble(measures.fan_of_pairs(pairs), measures.cycles(pairs, pairs=True), impact, measures.gap_counts(graph.gaps, members), lists=False)
    return Model(graph, dependencies, cited, stored(found), impact)


def solution_id(key: Column) -> Column:
    return identity.public_id("sol", key)


# --- artifacts ---


def canonical(value: Column, indented: bool = False) -> Column:
    """JSON with the fields in their order and nulls written; on one line, or indented with line feeds."""
    return F.to_json(value, {"ignoreNullFields": "false"} | ({"pretty": "true"} if indented else {}))


def _records(df: DataFrame, family: str, folder: str, key: Column, value: Column, target: int = index.SHARD_BYTES) -> DataFrame:
    """Rows (solution_key, folder, family, key, json) that are packed into shards of ``target`` bytes."""
    return df.select("solution_key", F.lit(folder).alias("folder"), F.lit(family).alias("family"), key.alias("key"), canonical(value).alias("json"), F.lit(target).alias("target"))


def _shards(records: DataFrame) -> DataFrame:
    """Each shard's path and JSON array, in key order."""
    records = stored(records.withColumn("stream", F.concat_ws("/", F.col("folder"), solution_id(F.col("solution_key")))))
    packed = [index.pack_shards(records.where(F.col("target") == t).select("stream", "key", F.octet_length("json").alias("size")), "stream", "key", "size", t) for t in (index.SHARD_BYTES, index.EVIDENCE_SHARD_BYTES)]
    rows = records.join(reduce(DataFrame.unionByName, packed).select("stream", "key", "shard"), ["stream", "key"])
    grouped = rows.groupBy("solution_key", "family", "stream", "shard").agg(F.array_sort(F.collect_list(F.struct("key", "json"))).alias("all"))
    path = F.concat(F.col("stream"), F.format_string("/%06d.json", F.col("shard")))
    return grouped.select("solution_key", path.alias("path"), "family", F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["json"]), ","), F.lit("]")).alias("payload"), F.size("all").cast("long").alias("records"))


def index_rows(model: Model) -> DataFrame:
    """solution_key, index, key, page, first, gaps and categories of the indexes by key (``NAVIGATION``)."""
    rows = model.dependencies
    parts = {"source": {"outgoing": None, "runtime": RUNTIME}, "target": {"incoming": None, "contracts": ("contract", "messaging"), "persistence": ("persistence",)}}
    found = reduce(DataFrame.unionByName, [_edge_pages(rows, key, own) for key, own in parts.items()])
    # The others number their keys, all in one go. What some other entity leads to is reached, at whatever depth.
    ends = F.array(F.struct(F.col("source").alias("key"), F.lit(False).alias("reached")), F.struct(F.col("target").alias("key"), (F.col("source") != F.col("target")).alias("reached")))
    seen = stored(rows.select("solution_key", "scope", "nature", F.explode(ends).alias("end")).groupBy("solution_key", "end.key").agg(F.bool_or(F.col("end.reached") & (F.col("nature") == "direct")).alias("reached"), F.bool_or(F.col("nature") == "direct").alias("measured"), F.bool_or(F.col("scope") == "document").alias("document")))
    reach = seen.where("measured")
    plain = {
        "roots": model.graph.entities.where(F.col("kind").isin(*ROOT_KINDS)).select("solution_key", "key"),
        "documents": seen.where("document").select("solution_key", "key"),
    }
    none = F.array().cast("array<string>")
    keys = [df.select("solution_key", F.lit(name).alias("index"), "key", none.alias("categories")) for name, df in plain.items()]
    keys.append(reach.select("solution_key", F.lit("measures").alias("index"), "key", F.when(F.col("reached"), F.array(F.lit("reachable"))).otherwise(none).alias("categories")))
    placed = index.spread_ordinals(reduce(DataFrame.unionByName, keys), ["solution_key", "index"], ["key"])
    plain_rows = placed.select("solution_key", "index", "key", F.lit(0).cast("long").alias("page"), F.col("ordinal").alias("first"), F.array().cast("array<bigint>").alias("gaps"), "categories")
    return found.unionByName(plain_rows)


def _edge_pages(rows: DataFrame, key: str, own: dict[str, tuple[str, ...] | None], page: int = index.PAGE) -> DataFrame:
    """The pages of the indexes by one end of the dependencies, which take all categories (None) or some.

    A key's list is gathered once for all of its indexes. Only keys with more rows than a page are placed in pages
    (:func:`ledgerline.operators.index.inverted_pages`); a sketch of fixed size tells them.
    """
    by = ["solution_key", "key"]
    edges = rows.select("solution_key", F.col(key).alias("key"), "ordinal", "category")
    hubs = stored(sketch.repeated(edges, *by, over=page))
    lists = sketch.never(edges, hubs, *by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ordinal", "category"))).alias("all"))

    def chosen(only: tuple[str, ...] | None) -> Column:
        return F.col("all") if only is None else F.filter("all", lambda x: x["category"].isin(*only))

    short = lists.select(*by, F.explode(F.array(*[F.struct(F.lit(name).alias("index"), chosen(only).alias("own")) for name, only in own.items()])).alias("one")).select(*by, "one.index", "one.own").where(F.size("own") > 0)
    coded = index.coded_list(F.transform("own", lambda x: x["ordinal"]))
    short = short.select("solution_key", "index", "key", F.lit(0).cast("long").alias("page"), coded.alias("list"), F.array_sort(F.array_distinct(F.transform("own", lambda x: x["category"]))).alias("categories")).select("solution_key", "index", "key", "page", "list.first", "list.gaps", "categories")
    if hubs.isEmpty():
        return short
    long = sketch.maybe(edges, hubs, *by)
    named = [(long if only is None else long.where(F.col("category").isin(*only))).withColumn("index", F.lit(name)) for name, only in own.items()]
    return short.unionByName(index.inverted_pages(reduce(DataFrame.unionByName, named), ["solution_key", "index", "key"], page=page))


def identities(words: DataFrame) -> DataFrame:
    """solution_key, bucket, buckets, id, key and handle of every entity: one bucket holds an id, and buckets don't grow with the index."""
    rows = words.where("table = 'entities'").select("solution_key", identity.public_id("ent", F.col("key")).alias("id"), "key", "handle")
    counts = rows.groupBy("solution_key").agg(F.ceil(F.count("*") / IDENTITIES).cast("long").alias("buckets"))
    return rows.join(counts, "solution_key").select("solution_key", identity_bucket(F.col("id"), F.col("buckets")).alias("bucket"), "buckets", "id", "key", "handle")


def identity_bucket(public_id: Column, buckets: Column) -> Column:
    """The bucket of a public id, from the 30 bits that follow its prefix."""
    return F.conv(F.substr(public_id, F.lit(5), F.lit(6)), 32, 10).cast("long") % buckets


def page_path(key: Column) -> Column:
    return F.concat(F.lit("pages/"), identity.public_id("ent", key), F.lit(".md"))


def pages(model: Model) -> DataFrame:
    """A page of every root and of every document with a dependency: edges both ways, measures, impact and gaps."""
    roots = model.graph.entities.where(F.col("kind").isin(*ROOT_KINDS)).select("solution_key", "key")
    ends = F.explode(F.array("source", "target"))
    documents = model.dependencies.where("scope = 'document'").select("solution_key", ends.alias("key"))
    subjects = roots.unionByName(documents).distinct()
    names = model.graph.entities.select("solution_key", "key", "display_name").unionByName(model.graph.sources.select("solution_key", "key", predicates.stem(F.col("relative_path")).alias("display_name"))).groupBy("solution_key", "key").agg(F.min("display_name").alias("name"))
    subjects = subjects.join(names, ["solution_key", "key"], "left").withColumn("name", predicates.escaped_markdown(predicates.published(F.coalesce("name", F.substring_index("key", ":", -1)))))
    linked = subjects.select("solution_key", F.col("key").alias("other"), page_path(F.col("key")).alias("page"), F.col("name").alias("other_name"))

    def lines(own: str, other: str, title: str) -> DataFrame:
        rows = model.dependencies.select("solution_key", F.col(own).alias("key"), F.col(other).alias("other"), "category", "occurrence_count").join(linked, ["solution_key", "other"], "left")
        shown = F.when(F.col("page").isNotNull(), F.concat(F.lit("["), "other_name", F.lit("]("), predicates.relative_link(page_path(F.col("key")), F.col("page")), F.lit(")"))).otherwise(predicates.escaped_markdown(predicates.published(F.substring_index("other", ":", -1))))
        line = F.concat(F.lit("- "), shown, F.lit(" "), "category", F.lit(" x"), F.col("occurrence_count").cast("string"))
        return rows.groupBy("solution_key", "key").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias(title))

    # Who is reached backward, nearest first; and gaps by kind.
    impact = model.impact.select("solution_key", F.col("entity").alias("key"), "depth", F.col("dependent").alias("other")).join(linked, ["solution_key", "other"], "left")
    shown = F.when(F.col("page").isNotNull(), F.concat(F.lit("["), "other_name", F.lit("]("), predicates.relative_link(page_path(F.col("key")), F.col("page")), F.lit(")"))).otherwise(predicates.escaped_markdown(predicates.published(F.substring_index("other", ":", -1))))
    impact = impact.groupBy("solution_key", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "other", F.concat(F.lit("- "), F.col("depth").cast("string"), F.lit(" "), shown).alias("line")))), lambda x: x["line"]), "\n").alias("impact"))
    gaps = model.measures.groupBy("solution_key", F.col("entity").alias("key")).agg(*[F.max(f"gaps_{k.lower()}").alias(k) for k in GAP_KINDS])
    gaps = gaps.select("solution_key", "key", F.concat_ws("\n", *[F.when(F.col(k) > 0, F.concat(F.lit(f"- {k} "), F.col(k).cast("string"))) for k in GAP_KINDS]).alias("gaps")).where("gaps != ''")
    told = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.lit("-"), "scope", F.concat(F.lit("fan-in="), F.col("fan_in").cast("string")), F.concat(F.lit("fan-out="), F.col("fan_out").cast("string")), F.concat(F.lit("cycles="), F.size("cycles").cast("string")), F.concat(F.lit("impact="), F.col("impact_count").cast("string")), F.concat(F.lit("gaps="), (F.col("gaps_candidate") + F.col("gaps_unknown") + F.col("gaps_openfrontier")).cast("string"))))), "\n").alias("measured")
    facts = model.measures.groupBy("solution_key", F.col("entity").alias("key")).agg(told)
    out = subjects
    for part in (lines("source", "target", "outgoing"), lines("target", "source", "incoming"), facts, impact, gaps):
        out = out.join(part, ["solution_key", "key"], "left")

    def section(title: str, column: str) -> Column:
        return F.concat(F.lit(f"\n## {title}\n\n"), F.coalesce(column, F.lit("none")), F.lit("\n"))

    page = F.concat(F.lit("# "), "name", F.lit("\n"), section("Outgoing", "outgoing"), section("Incoming", "incoming"), section("Measures", "measured"), section("Impact", "impact"), section("Gaps", "gaps"))
    return out.select("solution_key", page_path(F.col("key")).alias("path"), F.lit("Markdown").alias("family"), page.alias("payload"), F.lit(1).cast("long").alias("records"))


def summaries(model: Model) -> DataFrame:
    """A page per solution: counts, and the five components with the largest fan-in."""
    counts = model.graph.entities.groupBy("solution_key").agg(F.count("*").alias("entities")).join(model.dependencies.groupBy("solution_key").agg(F.count("*").alias("dependencies")), "solution_key", "left")
    key = F.struct((-F.col("fan_in")).alias("order"), "entity", "fan_in")
    top = model.measures.where("scope = 'component'").select("solution_key", key.alias("row"))
    best = top.withColumn("rank", F.row_number().over(Window.partitionBy("solution_key").orderBy("row"))).where("rank <= 5").groupBy("solution_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: F.concat(F.lit("- ["), predicates.escaped_markdown(F.substring_index(r["entity"], ":", -1)), F.lit("](../"), page_path(r["entity"]), F.lit(") fan-in="), r["fan_in"].cast("string"))), "\n").alias("top"))
    page = F.concat(F.lit("# Summary\n\n- entities: "), F.col("entities").cast("string"), F.lit("\n- dependencies: "), F.coalesce("dependencies", F.lit(0)).cast("string"), F.lit("\n\n## Most used\n\n"), F.coalesce("top", F.lit("none")), F.lit("\n"))
    return counts.join(best, "solution_key", "left").select("solution_key", F.concat(F.lit("summary/"), solution_id(F.col("solution_key")), F.lit(".md")).alias("path"), F.lit("Markdown").alias("family"), page.alias("payload"), F.lit(1).cast("long").alias("records"))


def artifacts(model: Model) -> DataFrame:
    """All artifacts of a package with their digests and sizes."""
    g = model.graph
    key = F.col("key")
    variants = g.evidence.select("solution_key", identity.variant_key(F.col("variant")).alias("key")).distinct()
    rings = model.measures.select("solution_key", F.explode("cycles").alias("key")).distinct()
    tables = {"entities": _universe(g, model.dependencies), "variants": variants, "relations": g.relations, "evidence": g.evidence, "cycles": rings}
    words = stored(index.dictionary(reduce(DataFrame.unionByName, [df.select("solution_key", F.lit(name).alias("table"), "key") for name, df in tables.items()]), ["solution_key", "table"], "key"))
    navigation = stored(index_rows(model))
    place = F.concat_ws("\x01", "key", F.format_string("%012d", "page"))
    records = [
        *[_records(words.where(F.col("table") == name), "Table", f"tables/{name}", key, F.struct("handle", "key")) for name in tables],
        _records(coded_relations(g.relations, words), "Graph", "graph", key, F.struct("key", "source", "target", "category", "evidence")),
        _records(coded_dependencies(model, words), "Dependencies", "dependencies/rows", F.format_string("%012d", "ordinal"), F.struct("ordinal", "scope", "source", "target", "category", "nature", "occurrence_count", "variants", "relation_count", "evidence_count")),
        _records(cited_pages(model, words), "Dependencies", "dependencies/pages", F.format_string("%012d-%s-%012d", "ordinal", "part", "page"), F.struct("ordinal", "part", "page", "first", "gaps")),
        _records(coded_measures(model, words), "Measures", "measures/rows", F.concat_ws("\x01", "scope", "place"), F.struct("scope", "entity", "fan_in", "fan_out", "cross_component_edges", "cycles", "impact_count", "gaps_candidate", "gaps_unknown", "gaps_openfrontier")),
        _records(impact_pages(model, words), "Measures", "measures/impact", F.concat_ws("\x01", "scope", "place", F.format_string("%012d", "page")), F.struct("scope", "entity", "page", "targets")),
        _records(g.evidence, "Evidence", "evidence", key, F.struct("key", "document_key", "variant", "span", "content_digest"), index.EVIDENCE_SHARD_BYTES),
        *[_records(navigation.where(F.col("index") == i), "Index", f"indexes/{i}", place, F.struct("key", "page", "first", "gaps", "categories"), index.EVIDENCE_SHARD_BYTES) for i in NAVIGATION],  # a journey reads one with what it leads to
    ]
    bulk = stored(_shards(reduce(DataFrame.unionByName, records)))
    routes = evidence_routes(bulk)
    router = _records(routes, "Index", "indexes/evidence", F.format_string("%012d", "first"), F.struct("first", "records", "shard"), index.EVIDENCE_SHARD_BYTES)
    shards = stored(bulk.unionByName(_shards(router)).unionByName(_identity_shards(words)))
    return described(shards.unionByName(manifests(g, shards)).unionByName(pages(model)).unionByName(summaries(model)))


def evidence_routes(shards: DataFrame) -> DataFrame:
    """solution_key, first, records and shard: which evidence, by its place in the sorted table, each evidence shard holds."""
    rows = shards.where(F.col("family") == "Evidence").select("solution_key", F.col("path").alias("shard"), "records", predicates.stem(F.col("path")).cast("long").alias("nth"))
    return index.sum_before(rows, ["solution_key"], "nth", "records", "first").select("solution_key", "first", "records", "shard")


def _identity_shards(words: DataFrame) -> DataFrame:
    """A shard for every bucket of ids, also one without any."""
    rows = identities(words)
    every = rows.groupBy("solution_key").agg(F.max("buckets").alias("buckets")).select("solution_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    held = rows.groupBy("solution_key", "bucket").agg(F.array_sort(F.collect_list(F.struct("id", canonical(F.struct("id", "key", "handle")).alias("json")))).alias("all"))
    shards = every.join(held, ["solution_key", "bucket"], "left").withColumn("all", F.coalesce("all", F.array().cast(held.schema["all"].dataType)))
    path = F.concat(F.lit("indexes/identity/"), solution_id(F.col("solution_key")), F.format_string("/%06d.json", F.col("bucket")))
    return shards.select("solution_key", path.alias("path"), F.lit("Index").alias("family"), F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["json"]), ","), F.lit("]")).alias("payload"), F.size("all").cast("long").alias("records"))


def described(rows: DataFrame) -> DataFrame:
    """Artifact rows with the digest and the bytes of their payload."""
    return rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})


def _table(words: DataFrame, name: str) -> DataFrame:
    return words.where(F.col("table") == name).select("solution_key", "key", "handle", "ordinal")


def coded_relations(relations: DataFrame, words: DataFrame) -> DataFrame:
    """Relations with the handles of their ends and the places of their evidence."""
    rows = relations.select("solution_key", "key", F.col("source_key").alias("source"), F.col("target_key").alias("target"), "category")
    for column in ("source", "target"):
        rows = index.encoded(rows, _table(words, "entities").drop("ordinal"), ["solution_key"], column)
    own = relations.select("solution_key", F.col("key").alias("relation"), F.explode("evidence_keys").alias("key")).join(_table(words, "evidence"), ["solution_key", "key"])
    proofs = own.groupBy("solution_key", F.col("relation").alias("key")).agg(F.array_sort(F.collect_set("ordinal")).alias("evidence"))
    return rows.join(proofs, ["solution_key", "key"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<bigint>")))


def coded_dependencies(model: Model, words: DataFrame) -> DataFrame:
    """Dependencies with the handles of both ends and of the variants."""
    rows = model.dependencies
    for column in ("source", "target"):
        rows = index.encoded(rows, _table(words, "entities").drop("ordinal"), ["solution_key"], column)
    own = rows.select("solution_key", "ordinal", F.explode("variants").alias("key")).join(_table(words, "variants").withColumnRenamed("ordinal", "place"), ["solution_key", "key"])
    variants = own.groupBy("solution_key", "ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "handle"))), lambda x: x["handle"]).alias("variants"))
    return rows.drop("variants").join(variants, ["solution_key", "ordinal"], "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<string>")))


def cited_pages(model: Model, words: DataFrame) -> DataFrame:
    """solution_key, ordinal, part, page, first and gaps: the relations and the evidence of every dependency, by their places."""
    places = words.where(F.col("table").isin("relations", "evidence")).select("solution_key", F.when(F.col("table") == "relations", "relation").otherwise("evidence").alias("part"), "key", F.col("ordinal").alias("place"))
    rows = model.members.join(places, ["solution_key", "part", "key"], "left")
    missing = F.raise_error(F.concat(F.lit("A dependency cites what isn't retained: "), F.col("key"))).cast("long")
    by = ["solution_key", "ordinal", "part"]
    pages = index.placed_pages(rows.select(*by, F.coalesce("place", missing).alias("place")), by, ["place"])
    return pages.groupBy(*by, "page").agg(index.coded_list(F.array_sort(F.collect_list("place"))).alias("list")).select(*by, "page", "list.*")


def coded_measures(model: Model, words: DataFrame) -> DataFrame:
    """Measures with the handles of the entity and of its cycles; ``place`` is the entity's key."""
    rows = model.measures.withColumn("place", F.col("entity"))
    own = rows.select("solution_key", "scope", "place", F.explode("cycles").alias("key")).join(_table(words, "cycles"), ["solution_key", "key"])
    rings = own.groupBy("solution_key", "scope", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "handle"))), lambda x: x["handle"]).alias("cycles"))
    rows = rows.drop("cycles").join(rings, ["solution_key", "scope", "place"], "left").withColumn("cycles", F.coalesce("cycles", F.array().cast("array<string>")))
    return index.encoded(rows, _table(words, "entities").drop("ordinal"), ["solution_key"], "entity")


def impact_pages(model: Model, words: DataFrame) -> DataFrame:
    """solution_key, scope, place, entity, page and targets: who reaches an entity, nearest first, in pages."""
    entities = _table(words, "entities").drop("ordinal")
    rows = model.impact.withColumns({"place": F.col("entity"), "name": F.col("dependent")})
    for column in ("entity", "dependent"):
        rows = index.encoded(rows, entities, ["solution_key"], column)
    by = ["solution_key", "scope", "place", "entity"]
    pages = index.placed_pages(rows, by, ["depth", "name"])
    targets = F.transform(F.array_sort(F.collect_list(F.struct("depth", "name", "dependent"))), lambda x: F.struct(x["depth"].alias("depth"), x["dependent"].alias("entity")))
    return pages.groupBy(*by, "page").agg(targets.alias("targets"))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/sol_[^/]*/[^/]*$", "")


def manifests(graph: FactualGraph, shards: DataFrame) -> DataFrame:
    """Two manifests per solution: one with every index, also one without an entry, and the journeys' entries; beside it one with the other folders."""
    counts = shards.select("solution_key", folder_of(F.col("path")).alias("folder"), "records")
    counts = counts.groupBy("solution_key", "folder").agg(F.count("*").alias("shards"), F.sum("records").alias("records"))
    wanted = graph.entities.select("solution_key").distinct().select("solution_key", F.explode(F.array(*[F.lit(f"indexes/{i}") for i in INDEXES])).alias("folder"))
    folders = wanted.join(counts, ["solution_key", "folder"], "full").select("solution_key", "folder", F.coalesce("shards", F.lit(0)).alias("shards"), F.coalesce("records", F.lit(0)).alias("records"))
    is_index = F.col("folder").startswith("indexes/")
    listed = folders.groupBy("solution_key", is_index.alias("main")).agg(F.array_sort(F.collect_list(F.struct("folder", "shards", "records"))).alias("folders"))
    sid = solution_id(F.col("solution_key"))
    entries = F.array(*[F.struct(F.lit(j).alias("journey"), F.lit(f"indexes/{i}").alias("entry")) for j, i in ENTRY_INDEX.items()])
    entries = F.when(F.col("main"), entries).otherwise(F.slice(entries, 1, 0))
    payload = canonical(F.struct(sid.alias("id"), F.col("solution_key").alias("key"), "folders", entries.alias("journeys")), indented=True)
    return listed.select("solution_key", F.concat(F.lit("solutions/"), sid, F.when(F.col("main"), "/manifest.json").otherwise("/folders/manifest.json")).alias("path"), F.lit("Manifest").alias("family"), payload.alias("payload"), F.lit(1).cast("long").alias("records"))


def main_manifests(rows: DataFrame) -> DataFrame:
    """The manifests that journeys begin with."""
    return rows.where((F.col("family") == "Manifest") & ~F.col("path").endswith("/folders/manifest.json"))


MANIFEST = "id string, key string, folders array<struct<folder:string,shards:bigint,records:bigint>>, journeys array<struct<journey:string,entry:string>>"


def _manifest() -> Column:
    """A manifest's content. Other payloads aren't parsed, wherever the optimiser puts the parsing."""
    return F.from_json(F.when(F.col("family") == "Manifest", F.col("payload")), MANIFEST, {"mode": "FAILFAST"})


def declared(rows: DataFrame) -> DataFrame:
    """solution_key, folder, shards and records, as the manifests say."""
    told = rows.where("family = 'Manifest'").select("solution_key", _manifest().alias("m"))
    return told.select("solution_key", F.explode("m.folders").alias("f")).select("solution_key", "f.*")


def read_declared(rows: DataFrame) -> DataFrame:
    """The JSON artifacts that a manifest declares, by the path of each; one that isn't there is an error."""
    told = declared(rows).where("shards > 0").select("solution_key", "folder", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    told = told.select(F.concat(F.col("folder"), F.lit("/"), solution_id(F.col("solution_key")), F.format_string("/%06d.json", "shard")).alias("path"))
    missing = F.raise_error(F.concat(F.lit("artifact-missing: "), "path")).cast("string")
    return told.join(rows, "path", "left").withColumn("payload", F.coalesce("payload", missing)).select(rows.columns)


def entry_of(rows: DataFrame) -> DataFrame:
    """solution_key, journey and entry (a folder) of every journey: an error unless a solution has exactly one manifest, and it exactly one folder of each index."""
    told = main_manifests(rows).select("solution_key", _manifest().alias("m"))
    n = F.aggregate(F.array(*[F.lit(f"indexes/{i}") for i in INDEXES]), F.lit(True), lambda ok, i: ok & (F.size(F.filter("m.folders", lambda f: f["folder"] == i)) == 1))
    several = told.groupBy("solution_key").agg(F.count("*").alias("manifests"), F.first("m").alias("m"))
    checked = several.withColumn("m", F.when((F.col("manifests") == 1) & n, F.col("m")).otherwise(F.raise_error(F.concat(F.lit("not-exactly-one-index: "), "solution_key")).cast(told.schema["m"].dataType)))
    return checked.select("solution_key", F.explode("m.journeys").alias("j")).select("solution_key", "j.*")


def _universe(g: FactualGraph, d: DataFrame) -> DataFrame:
    """All keys that any artifact refers to as an entity."""
    parts = [g.entities.select("solution_key", "key"), g.relations.select("solution_key", F.explode(F.array("source_key", "target_key")).alias("key")), d.select("solution_key", F.explode(F.array("source", "target")).alias("key")), g.sources.select("solution_key", "key")]
    return reduce(DataFrame.unionByName, parts).distinct()


# --- measures of the package ---


def totals(rows: DataFrame) -> DataFrame:
    """Artifacts and bytes of every family, and of all of them (family ``total``)."""
    sums = rows.rollup("family").agg(F.count("*").alias("artifacts"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.grouping("family").alias("whole"))
    return sums.select(F.when(F.col("whole") == 1, "total").otherwise(F.col("family")).alias("family"), "artifacts", "bytes")


def solution_totals(rows: DataFrame) -> DataFrame:
    """Artifacts and bytes of every solution, found by the id in the path; what has none is left out."""
    sid = F.regexp_extract("path", "(sol_[0-9a-v]{16})", 1)
    return rows.select(sid.alias("solution_id"), "bytes").where("solution_id != ''").groupBy("solution_id").agg(F.count("*").alias("artifacts"), F.sum("bytes").alias("bytes"))


def digest_rows(rows: DataFrame, most: int = DIGEST_LINES) -> DataFrame:
    """One row: SHA-256 over the ``path:digest`` lines in the order of their paths, and how many there are.

    More lines than ``most`` are hashed in runs of that many, and the runs' digests (``number:digest``)
    in their place, until they are few: no task joins more.
    """
    lines = rows.select(F.col("path").alias("key"), F.concat_ws(":", "path", "digest").alias("line"))
    n = count = lines.count()

    def hashed() -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "line"))), lambda x: x["line"]), "\n"), 256)

    while n > most:
        placed = index.spread_ordinals(lines.withColumn("all", F.lit(0)), ["all"], ["key", "line"])
        runs = placed.withColumn("run", F.floor(F.col("ordinal") / most)).groupBy("run").agg(hashed().alias("digest"))
        lines = runs.select(F.col("run").alias("key"), F.concat_ws(":", "run", "digest").alias("line"))
        n = -(-n // most)
    return lines.agg(hashed().alias("package_digest")).select("package_digest", F.lit(count).cast("long").alias("artifacts"))


def package_digest(rows: DataFrame) -> str:
    return digest_rows(rows).first()[0]


def budget(names: list[str]) -> tuple[int, int, list[str]]:
    """The least of the ceilings whose word a solution's name has, else the default; and their words."""
    hit = sorted({c for c in CEILINGS if any(c[0] in n.lower() for n in names)})
    if not hit:
        return (*DEFAULT_CEILING, ["default"])
    return min(c[1] for c in hit), min(c[2] for c in hit), [c[0] for c in hit]


class PackageError(ValueError):
    """A failure with its code and stage."""

    def __init__(self, code: str, stage: str, cause: str, artifact: str | None = None):
        super().__init__(f"{code}: {cause}")
        self.code, self.stage, self.cause, self.artifact = code, stage, cause, artifact


def check_budget(rows: DataFrame, names: list[str]) -> None:
    most, most_bytes, applied = budget(names)
    *by_family, whole = totals(rows).orderBy(F.col("family") == "total", "family").collect()
    count, size = whole["artifacts"], whole["bytes"]
    if count > most or size > most_bytes:
        told = ", ".join(f"{r['family']}={r['artifacts']}/{r['bytes']}" for r in by_family)
        raise PackageError("package-budget-exceeded", "budget", f"{count} artifacts and {size} bytes over {most} and {most_bytes} ({', '.join(applied)}): {told}")


# --- store and read ---


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through a file beside it that is renamed last."""
    fs, Path = _fs(spark, path)
    beside = Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    # A rename that overwrites: at no moment is there no file.
    jvm = spark.sparkContext._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(Path(path)), options)


def _locked(spark: SparkSession, base: str, stale: float = STALE_LOCK) -> str:
    """Take the folder's lock; one whose writer has been silent for ``stale`` seconds is taken over. Returns the owner's name."""
    fs, Path = _fs(spark, base)
    lock, owner = f"{base}/.lock", uuid.uuid4().hex
    for _ in range(2):
        try:
            out = fs.create(Path(lock), False)
            out.write(bytearray(json.dumps({"owner": owner, "time": int(time.time())}).encode()))
            out.close()
            return owner
        except Py4JJavaError:
            if not fs.exists(Path(lock)):
                continue
            if time.time() - fs.getFileStatus(Path(lock)).getModificationTime() / 1000 < stale:
                break
            # Of several writers that find it stale one alone can move it away.
            if fs.rename(Path(lock), Path(f"{lock}.{owner}")):
                fs.delete(Path(f"{lock}.{owner}"), False)
    raise PackageError("package-locked", "commit", f"{lock} exists")


def _holds(spark: SparkSession, base: str, owner: str) -> bool:
    fs, Path = _fs(spark, base)
    if not fs.exists(Path(f"{base}/.lock")):
        return False
    held = fs.open(Path(f"{base}/.lock"))
    try:
        return owner in spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    finally:
        held.close()


def _put(rows: DataFrame, folder: str, form: str) -> None:
    if form == "files":
        artifact_files.write(rows, folder)
    else:
        rows.write.parquet(folder)


def _held(spark: SparkSession, folder: str, form: str) -> DataFrame:
    return artifact_files.read(spark, folder) if form == "files" else spark.read.parquet(folder)


def publish(spark: SparkSession, model: Model, folder: str, names: list[str] | None = None, form: str = "parquet") -> str:
    """Store, read back, validate and certify a generation, then point to it; older ones go. Returns its digest.

    As ``files`` each artifact is a file at its path below ``artifacts``, and each solution's certification one below
    ``certified``; they are read back once, and what was read is validated.

    The budget is checked early on the artifacts, and again on all that will be committed. One
    writer at a time: the lock file is created exclusively, looked at again before the pointer
    is replaced, and removed at the end. A generation that is there already, with the content that
    its name says, stays as it is.
    """
    base = folder.rstrip("/")
    fs, Path = _fs(spark, base)
    fs.mkdirs(Path(base))
    owner = _locked(spark, base)
    staged = f"{base}/staging-{uuid.uuid4().hex}"
    try:
        for status in fs.listStatus(Path(base)):
            if status.getPath().getName().startswith("staging-"):
                fs.delete(status.getPath(), True)  # of a writer that was stopped
        _put(artifacts(model), f"{staged}/artifacts", form)
        rows = _held(spark, f"{staged}/artifacts", form)
        if form == "files":
            rows = checkpointed(rows)
        check_budget(rows, names or [])
        digest = package_digest(rows)
        if failure := first_failure(rows, model):
            raise failure
        certify(rows).write.parquet(f"{staged}/certification")
        certified = spark.read.parquet(f"{staged}/certification")
        if failed := certified.where("status = 'Failed'").orderBy("solution_key", "journey").take(1):
            raise PackageError("journey-certification", "certification", f"{failed[0]['journey']}: {failed[0]['reason']}")
        if failure := certified_failure(rows, certification_artifacts(certified)):
            raise failure
        if form == "files":
            artifact_files.write(certification_artifacts(certified), f"{staged}/certified")
        pointer = json.dumps({"generation": digest, "path": f"generations/{digest}"} | ({"form": form} if form != "parquet" else {}), sort_keys=True)
        sizes = certification_artifacts(certified).select("family", "bytes").unionByName(rows.select("family", "bytes"))
        check_budget(sizes.unionByName(spark.createDataFrame([("Manifest", len(pointer))], "family string, bytes long")), names or [])
        target = f"{base}/generations/{digest}"
        fs.mkdirs(Path(f"{base}/generations"))
        if not _has_digest(spark, target, digest, form):
            fs.delete(Path(target), True)
            if not fs.rename(Path(staged), Path(target)):
                raise PackageError("generation-not-moved", "commit", target)
        if not _holds(spark, base, owner):
            raise PackageError("lock-lost", "commit", f"{base}/.lock is another writer's")
        _write_text(spark, f"{base}/{POINTER}", pointer)
        for status in fs.listStatus(Path(f"{base}/generations")):
            if status.getPath().getName() != digest:
                fs.delete(status.getPath(), True)
        return digest
    finally:
        fs.delete(Path(staged), True)
        if _holds(spark, base, owner):
            fs.delete(Path(f"{base}/.lock"), False)


def _has_digest(spark: SparkSession, generation: str, digest: str, form: str) -> bool:
    """Whether the folder holds the artifacts that its digest names, in this form, and their certification."""
    fs, Path = _fs(spark, generation)
    wanted = [f"artifacts/{FORMS[form]}", "certification/_SUCCESS", *([f"certified/{FORMS[form]}"] if form == "files" else [])]
    if not all(fs.exists(Path(f"{generation}/{w}")) for w in wanted):
        return False
    return package_digest(described(_held(spark, f"{generation}/artifacts", form))) == digest


def certification_artifacts(certified: DataFrame) -> DataFrame:
    """A certification file per solution, in the form of artifact rows."""
    journeys = F.array_sort(F.collect_list(F.struct("journey", "status", "reason", "reads", "bytes", "tokens")))
    rows = certified.groupBy("solution_key", "solution_id").agg(F.to_json(journeys).alias("payload"))
    return described(rows.select("solution_key", F.concat(F.lit("certification/"), "solution_id", F.lit(".json")).alias("path"), F.lit("Certification").alias("family"), "payload", F.lit(len(JOURNEYS)).cast("long").alias("records")))


def certified_failure(rows: DataFrame, certification: DataFrame) -> PackageError | None:
    """What is wrong with the files of the certification, beside the artifacts it is about: one per solution, of all journeys, sound."""
    journeys = F.size(F.from_json("payload", "array<string>"))
    odd = certification.where((predicates.artifact_family(F.col("path")) != "Certification") | (journeys != len(JOURNEYS)) | (F.col("digest") != F.sha2("payload", 256)) | F.contains("payload", F.lit("C:/")) | ~predicates.is_safe_relative(F.col("path")))
    own = rows.unionByName(certification.select(rows.columns)).groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    lost = main_manifests(rows).select("solution_key").join(certification.select("solution_key"), "solution_key", "left_anti")
    found = odd.select("path").unionByName(own.select("path")).unionByName(lost.select(F.col("solution_key").alias("path"))).orderBy("path").take(1)
    return PackageError("certification-invalid", "certification", str(found[0]["path"]), found[0]["path"]) if found else None


def opened(spark: SparkSession, folder: str) -> tuple[str, str, str]:
    """Where the artifacts are that the pointer names, or a generation by itself: their folder, its digest and its form."""
    base = folder.rstrip("/")
    fs, Path = _fs(spark, base)
    if not fs.exists(Path(f"{base}/{POINTER}")):
        for form, done in FORMS.items():
            if fs.exists(Path(f"{base}/artifacts/{done}")):
                return f"{base}/artifacts", base.rpartition("/")[2], form
    try:
        pointer = json.loads(spark.read.text(f"{base}/{POINTER}", wholetext=True).first()[0])
    except Exception as e:
        raise PackageError("pointer-missing", "open", str(e)[:200]) from e
    if set(pointer) - {"form"} != {"generation", "path"} or not pointer["path"].startswith("generations/") or ".." in pointer["path"] or pointer.get("form", "parquet") not in FORMS:
        raise PackageError("pointer-invalid", "open", json.dumps(pointer))
    return f"{base}/{pointer['path']}/artifacts", pointer["generation"], pointer.get("form", "parquet")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The artifacts that the pointer names; an error where the digest isn't that of the content."""
    place, digest, form = opened(spark, folder)
    rows = _held(spark, place, form)
    if package_digest(described(rows)) != digest:
        raise PackageError("digest-mismatch", "open", "the content is not what was published")
    return rows


def read_one(spark: SparkSession, folder: str, path: str) -> str:
    """The payload at a path of the package, which is compared with its own digest alone: of files this one is opened."""
    place, _, form = opened(spark, folder)
    if not _is_inside(path):
        raise PackageError("unsafe-path", "read", path, path)
    rows = artifact_files.read(spark, place, path) if form == "files" else spark.read.parquet(place).where(F.col("path") == path)
    found = rows.select("payload", (F.sha2("payload", 256) == F.col("digest")).alias("sound")).take(1)
    if not found:
        raise PackageError("artifact-missing", "read", path, path)
    if not found[0]["sound"]:
        raise PackageError("digest-mismatch", "read", path, path)
    return found[0]["payload"]


def _is_inside(path: str) -> bool:
    return not (path.startswith("/") or "\\" in path or ":" in path or not {"", ".", ".."}.isdisjoint(path.split("/")))


def read_artifact(rows: DataFrame, path: str) -> str:
    """The payload at a path, which may not leave the package."""
    if not _is_inside(path):
        raise PackageError("unsafe-path", "read", path, path)
    found = rows.where(F.col("path") == path).select("payload").take(1)
    if not found:
        raise PackageError("artifact-missing", "read", path, path)
    return found[0][0]


def records_of(rows: DataFrame, folder: str | list[str], schema: str) -> DataFrame:
    """The records of the shards of a folder, or of some, strictly parsed: a record with another set of keys is an error."""
    within = [F.col("path").startswith(f + "/") for f in ([folder] if isinstance(folder, str) else folder)]
    parsed = rows.where(reduce(Column.__or__, within)).select("solution_key", "path", F.posexplode(F.from_json("payload", "array<string>")).alias("place", "record"))
    names = [x.strip().split(" ")[0] for x in _fields(schema)]
    extra = F.size(F.array_except(F.json_object_keys("record"), F.array(*map(F.lit, names)))) > 0
    checked = F.when(extra, F.raise_error(F.concat(F.lit("unknown property in "), "path")).cast("string")).otherwise(F.col("record"))
    return parsed.select("solution_key", "path", "place", F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("solution_key", "path", "place", "r.*")


def _fields(schema: str) -> list[str]:
    out, depth, own = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(own)
            own = ""
        else:
            own += c
    return [*out, own]


NAVIGATED = "key string, page bigint, first bigint, gaps array<bigint>, categories array<string>"


def index_records(rows: DataFrame, names: tuple[str, ...] = NAVIGATION) -> DataFrame:
    """The records of some indexes by key, with the name of each (``index``)."""
    found = records_of(rows, [f"indexes/{i}" for i in names], NAVIGATED)
    return found.withColumn("index", F.split_part("path", F.lit("/"), F.lit(2)))


def locate(rows: DataFrame, name: str, key: str) -> DataFrame:
    """The entry of one key in an index, a row for each of its pages: path, ordinals and categories."""
    found = index_records(rows, (name,)).where(F.col("key") == key)
    return found.select("path", index.decoded_list(F.col("first"), F.col("gaps")).alias("ordinals"), "categories")


def identity_path(rows: DataFrame, solution: str, public_id: str) -> str:
    """The one artifact that may know an id, by the manifest and the id alone."""
    known = json.loads(read_artifact(rows, f"solutions/{solution}/manifest.json"))
    buckets = next(f["shards"] for f in known["folders"] if f["folder"] == "indexes/identity")
    return f"indexes/identity/{solution}/{int(public_id[4:10], 32) % max(buckets, 1):06d}.json"


def locate_identity(rows: DataFrame, solution: str, public_id: str) -> dict | None:
    """The id, key and handle of a public id (None: unknown); two artifacts are read, whatever the index's size."""
    for known in json.loads(read_artifact(rows, identity_path(rows, solution, public_id))):
        if known["id"] == public_id:
            return known
    return None


def evidence_shards(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """solution_key, ordinal, shard and router: the shard that holds each asked (solution_key, ordinal), and the artifact that routes there."""
    routes = records_of(rows, "indexes/evidence", "first bigint, records bigint, shard string")
    found = index.shard_of(asked, routes.select("solution_key", F.struct("shard", F.col("path").alias("router")).alias("shard"), "first", "records"), "solution_key")
    return found.select("solution_key", "ordinal", "shard.*")


# --- validation and certification ---


def first_failure(rows: DataFrame, model: Model | None = None) -> PackageError | None:
    """The first check that fails, in a fixed order; with ``model`` indexes and pages are made again and compared."""
    checks = [
        ("unknown-family", "open", rows.where(predicates.artifact_family(F.col("path")).isNull() & (F.col("family") != "Markdown"))),
        ("digest-mismatch", "integrity", rows.where(F.col("digest") != F.sha2("payload", 256))),
        ("unsafe-path", "safety", rows.where(F.contains("payload", F.lit("C:/")) | ~predicates.is_safe_relative(F.col("path")))),
        ("duplicate-path", "integrity", rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")),
        ("shard-gap", "layout", _shard_gaps(rows)),
        ("record-count", "layout", rows.where(F.col("path").endswith(".json") & (F.col("family") != "Manifest") & (F.size(F.from_json("payload", "array<string>")) != F.col("records")))),
        ("undeclared", "layout", _undeclared(rows)),
        ("table-order", "content", _unsorted_tables(rows)),
        ("duplicate-key", "content", records_of(rows, "tables", "handle string, key string").groupBy("solution_key", F.split_part("path", F.lit("/"), F.lit(2)).alias("table"), "key").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")),
        ("unretained-evidence", "content", _unretained(rows)),
        ("short-list", "content", _short_lists(rows)),
    ]
    if model is not None:
        names = ["index", "solution_key", "key", "page", "first", "gaps", "categories"]
        markdown = rows.where("family = 'Markdown'").select("path", "digest")
        compared = [
            ("index-mismatch", index_rows(model).select(*names), index_records(rows).select(*names)),
            ("page-mismatch", pages(model).unionByName(summaries(model)).select("path", F.sha2("payload", 256).alias("digest")), markdown),
            ("dependency-mismatch", model.dependencies, dependencies_of(rows)),
            ("dependency-mismatch", model.members, cited_of(rows)),
            ("measure-mismatch", model.measures, measures_of(rows)),
            ("measure-mismatch", model.impact, impact_of(rows)),
            ("relation-mismatch", model.graph.relations, relations_of(rows)),
            ("evidence-mismatch", model.graph.evidence, records_of(rows, "evidence", PROOF).drop("path", "place")),
        ]
        found = index.differing_rows([(made.select(*held.columns), held) for _, made, held in compared])
        checks += [(code, "rehydrate", bad) for (code, *_), sides in zip(compared, found, strict=True) for bad in sides]
    # Checks of one stage are one job; a later stage may take for granted what the ones before have seen.
    stages = list(dict.fromkeys(stage for _, stage, _ in checks))
    for stage in stages:
        own = [(i, bad) for i, (_, s, bad) in enumerate(checks) if s == stage]
        rows_of = [bad.select(F.lit(i).alias("i"), (F.col("path") if "path" in bad.columns else F.lit(None).cast("string")).alias("path"), (F.col("key") if "key" in bad.columns else F.lit(None).cast("string")).alias("key")) for i, bad in own]
        if found := reduce(DataFrame.unionByName, rows_of).orderBy("i", "path", "key").take(1):
            return PackageError(checks[found[0]["i"]][0], stage, str(found[0]["path"] or found[0]["key"]), found[0]["path"])
    return None


DEPENDENCY = "ordinal bigint, scope string, source string, target string, category string, nature string, occurrence_count bigint, variants array<string>, relation_count bigint, evidence_count bigint"
CITED = "ordinal bigint, part string, page bigint, first bigint, gaps array<bigint>"
MEASURE = "scope string, entity string, fan_in bigint, fan_out bigint, cross_component_edges bigint, cycles array<string>, impact_count bigint, gaps_candidate bigint, gaps_unknown bigint, gaps_openfrontier bigint"
IMPACT = "scope string, entity string, page bigint, targets array<struct<depth:int,entity:string>>"
RELATION = "key string, source string, target string, category string, evidence array<bigint>"
PROOF = f"key string, document_key string, variant {VARIANT}, span {SPAN}, content_digest string"


def words_of(rows: DataFrame, name: str) -> DataFrame:
    """solution_key, key, handle and ordinal of a stored table."""
    return records_of(rows, f"tables/{name}", "handle string, key string").select("solution_key", "key", "handle", F.conv("handle", 36, 10).cast("long").alias("ordinal"))


def _decoded_lists(rows: DataFrame, words: DataFrame, by: list[str], column: str) -> DataFrame:
    """``rows`` with the handles of a short list replaced by their keys."""
    own = rows.select("solution_key", *by, F.explode(column).alias("handle")).join(words.select("solution_key", "key", "handle"), ["solution_key", "handle"], "left")
    lists = own.groupBy("solution_key", *by).agg(F.array_sort(F.collect_list(F.coalesce("key", F.raise_error(F.concat(F.lit("corrupt handle "), F.col("handle"))).cast("string")))).alias("_list"))
    return rows.join(lists, ["solution_key", *by], "left").withColumn(column, F.coalesce("_list", F.array().cast("array<string>"))).drop("_list")


def dependencies_of(rows: DataFrame) -> DataFrame:
    """The stored dependencies with their ends and variants decoded."""
    words = words_of(rows, "entities").drop("ordinal")
    out = records_of(rows, "dependencies/rows", DEPENDENCY).drop("path", "place")
    for column in ("source", "target"):
        out = index.decoded(out, words, ["solution_key"], column)
    return _decoded_lists(out, words_of(rows, "variants"), ["ordinal"], "variants")


def cited_of(rows: DataFrame) -> DataFrame:
    """solution_key, ordinal, part and key: the stored relations and evidence of every dependency."""
    tables = words_of(rows, "relations").withColumn("part", F.lit("relation")).unionByName(words_of(rows, "evidence").withColumn("part", F.lit("evidence")))
    placed = index.decoded_pages(records_of(rows, "dependencies/pages", CITED).drop("path", "place"), ["solution_key", "ordinal", "part"], "at")
    found = placed.join(tables.select("solution_key", "part", F.col("ordinal").alias("at"), "key"), ["solution_key", "part", "at"], "left")
    lost = F.raise_error(F.concat(F.lit("corrupt place "), F.col("at").cast("string"))).cast("string")
    return found.select("solution_key", "ordinal", "part", F.coalesce("key", lost).alias("key"))


def measures_of(rows: DataFrame) -> DataFrame:
    out = index.decoded(records_of(rows, "measures/rows", MEASURE).drop("path", "place"), words_of(rows, "entities").drop("ordinal"), ["solution_key"], "entity")
    return _decoded_lists(out, words_of(rows, "cycles"), ["scope", "entity"], "cycles")


def impact_of(rows: DataFrame) -> DataFrame:
    """solution_key, scope, entity, dependent and depth, as stored."""
    words = words_of(rows, "entities").drop("ordinal")
    out = records_of(rows, "measures/impact", IMPACT).select("solution_key", "scope", "entity", F.explode("targets").alias("t")).select("solution_key", "scope", "entity", F.col("t.entity").alias("dependent"), F.col("t.depth").alias("depth"))
    for column in ("entity", "dependent"):
        out = index.decoded(out, words, ["solution_key"], column)
    return out


def relations_of(rows: DataFrame) -> DataFrame:
    words = words_of(rows, "entities").drop("ordinal")
    out = records_of(rows, "graph", RELATION).select("solution_key", "key", F.col("source").alias("source_key"), F.col("target").alias("target_key"), "category", "evidence")
    for column in ("source_key", "target_key"):
        out = index.decoded(out, words, ["solution_key"], column)
    proofs = out.select("solution_key", "key", F.explode("evidence").alias("at")).join(words_of(rows, "evidence").select("solution_key", F.col("ordinal").alias("at"), F.col("key").alias("proof")), ["solution_key", "at"])
    lists = proofs.groupBy("solution_key", "key").agg(F.array_sort(F.collect_list("proof")).alias("evidence_keys"))
    return out.drop("evidence").join(lists, ["solution_key", "key"], "left").withColumn("evidence_keys", F.coalesce("evidence_keys", F.array().cast("array<string>")))


def _unretained(rows: DataFrame) -> DataFrame:
    """Dependencies that cite evidence which the package doesn't hold."""
    cited = index.decoded_pages(records_of(rows, "dependencies/pages", CITED).where("part = 'evidence'").drop("path", "place"), ["solution_key", "ordinal"], "at")
    known = words_of(rows, "evidence").join(records_of(rows, "evidence", PROOF).select("solution_key", "key"), ["solution_key", "key"], "left_semi")
    lost = cited.join(known.select("solution_key", F.col("ordinal").alias("at")), ["solution_key", "at"], "left_anti")
    return lost.select(F.concat_ws(" ", F.lit("dependency"), F.col("ordinal").cast("string")).alias("key"))


def _short_lists(rows: DataFrame) -> DataFrame:
    """Dependencies whose pages hold more or fewer places than they count."""
    pages = records_of(rows, "dependencies/pages", CITED).groupBy("solution_key", "ordinal").agg(*[F.sum(F.when(F.col("part") == p, F.size("gaps") + 1).otherwise(0)).alias(f"own_{p}") for p in ("relation", "evidence")])
    both = records_of(rows, "dependencies/rows", DEPENDENCY).join(pages, ["solution_key", "ordinal"], "full")
    return both.where(~(F.col("relation_count").eqNullSafe(F.col("own_relation")) & F.col("evidence_count").eqNullSafe(F.col("own_evidence")))).select(F.concat_ws(" ", F.lit("dependency"), F.col("ordinal").cast("string")).alias("key"))


def _undeclared(rows: DataFrame) -> DataFrame:
    """Folders whose shards or records aren't as many as the manifest says."""
    own = rows.where(F.col("path").endswith(".json") & (F.col("family") != "Manifest")).select("solution_key", folder_of(F.col("path")).alias("folder"), "records")
    own = own.groupBy("solution_key", "folder").agg(F.count("*").alias("own_shards"), F.sum("records").alias("own_records"))
    both = own.join(declared(rows), ["solution_key", "folder"], "full")
    return both.where(~(F.coalesce("own_shards", F.lit(0)).eqNullSafe(F.col("shards")) & F.coalesce("own_records", F.lit(0)).eqNullSafe(F.col("records")))).select(F.col("folder").alias("path"))


def _shard_gaps(rows: DataFrame) -> DataFrame:
    """Folders whose shards aren't numbered from 0 without a hole."""
    shards = rows.where(F.col("path").endswith(".json") & (F.col("family") != "Manifest")).select(predicates.folder(F.col("path")).alias("path"), predicates.stem(F.col("path")).cast("long").alias("n"))
    return shards.groupBy("path").agg(F.count("*").alias("shards"), F.max("n").alias("last")).where("shards != last + 1")


def _unsorted_tables(rows: DataFrame) -> DataFrame:
    table = records_of(rows, "tables", "handle string, key string").withColumn("stream", predicates.folder(F.col("path")))
    return index.with_before(table, ["stream"], ["path", "place"], F.col("key"), "before").where("before >= key")


def journey_costs(opened: DataFrame, by: tuple[str, ...] = ("journey",)) -> DataFrame:
    """reads, bytes and tokens of each journey from the artifacts (path, bytes) it opens; one opened again costs nothing."""
    once = opened.dropDuplicates([*by, "path"])
    return once.groupBy(*by).agg(F.count("*").alias("reads"), F.sum("bytes").alias("bytes")).withColumn("tokens", predicates.tokens_of_bytes(F.col("bytes")))


def within_budget(reads: Column, tokens: Column, most_reads: Column, most_tokens: Column) -> tuple[Column, Column]:
    """Status and reason: reads are judged before tokens."""
    told = F.when(reads > most_reads, F.concat(F.lit("reads-exceeded:"), reads.cast("string"), F.lit(">"), most_reads.cast("string"))).when(tokens > most_tokens, F.concat(F.lit("tokens-exceeded:"), tokens.cast("string"), F.lit(">"), most_tokens.cast("string")))
    return F.when(told.isNotNull(), "Failed").otherwise("Certified"), told


def _navigation(rows: DataFrame) -> DataFrame:
    """Of each solution what its indexes say: entries, categories, and whether they lead anywhere; one row."""
    entries = index_records(rows).withColumnRenamed("index", "i")

    def where(name: str, *more: Column) -> Column:
        found = F.col("i") == name
        for m in more:
            found = found & m
        return found

    def has(*categories: str) -> Column:
        return F.arrays_overlap("categories", F.array(*map(F.lit, categories)))

    leads = F.col("first").isNotNull()
    causal = ("http", "grpc", "messaging", "contract")
    flags = {
        "roots": where("roots"), "measured": where("measures"), "reached": where("measures", has("reachable")),
        "causal": where("outgoing", has(*causal)), "out_contract": where("outgoing", has("contract")), "out_persistence": where("outgoing", has("persistence")), "out_external": where("outgoing", has(*RUNTIME)),
        "contract_leads": where("contracts", has("contract"), leads), "persistence_leads": where("persistence", has("persistence"), leads), "impact": where("incoming", has(*causal, "persistence")),
    }
    first = F.min(F.when(F.col("i") == "roots", F.col("key"))).alias("root")
    return entries.groupBy("solution_key").agg(first, *[F.bool_or(c).alias(k) for k, c in flags.items()])


def certify(rows: DataFrame) -> DataFrame:
    """solution_key, solution_id, journey, status, reason, reads, bytes and tokens of the four journeys of every solution.

    Each is told from the artifacts that it opens: its solution's manifest, the shards of the
    indexes it reads, and where it ends (the first root's page; the shard that the evidence index routes
    the asked ordinal to). Of a flow's ends one that the dependencies have and the index doesn't
    lead to fails before one that they lack makes the journey inapplicable.
    """
    sid = solution_id(F.col("solution_key"))
    told = main_manifests(rows).select("solution_key").join(_navigation(rows), "solution_key", "left")
    entries = entry_of(rows)
    more = {"follow-flow": ("indexes/contracts", "indexes/persistence"), "reverse-impact": ("indexes/measures",)}
    others = F.create_map(*[x for j in JOURNEYS for x in (F.lit(j), F.array(*map(F.lit, more.get(j, ()))).cast("array<string>"))])
    wanted = entries.select("solution_key", "journey", F.explode(F.concat(F.array("entry"), F.element_at(others, F.col("journey")))).alias("folder"))
    shards = rows.where(F.col("path").endswith(".json")).select("solution_key", folder_of(F.col("path")).alias("folder"), "path", "bytes")
    is_first = F.col("path").endswith("/000000.json")
    # A walk through the graph reads whole indexes, locating the shard that begins one, and evidence what routes to it.
    walks = F.col("journey").isin("follow-flow", "reverse-impact") | ((F.col("journey") == "locate") & is_first)
    indexes = wanted.join(shards, ["solution_key", "folder"]).where(walks).select("solution_key", "journey", "path", "bytes")
    whole = main_manifests(rows).select("solution_key", F.explode(F.array(*map(F.lit, JOURNEYS))).alias("journey"), "path", "bytes")
    page = told.where("root is not null").select("solution_key", F.lit("locate").alias("journey"), page_path(F.col("root")).alias("path")).join(rows.select("solution_key", "path", "bytes"), ["solution_key", "path"]).select("solution_key", "journey", "path", "bytes")
    asked = told.select("solution_key", F.lit(ASKED_EVIDENCE).cast("long").alias("ordinal"))
    route = evidence_shards(rows, asked).select("solution_key", F.lit("evidence").alias("journey"), "shard", "router")
    proof = route.select("solution_key", "journey", F.explode(F.array("router", "shard")).alias("path")).join(shards.select("solution_key", "path", "bytes"), ["solution_key", "path"]).select("solution_key", "journey", "path", "bytes")
    costs = journey_costs(reduce(DataFrame.unionByName, (whole, indexes, page, proof)), ("solution_key", "journey"))
    ends = page.unionByName(proof.where(F.col("path").startswith("evidence/"))).select("solution_key", "journey", F.lit(True).alias("ends")).distinct()
    routed = records_of(rows, "indexes/evidence", "first bigint, records bigint, shard string").select("solution_key", F.lit(True).alias("proofs")).distinct()
    told = told.join(routed, "solution_key", "left")
    out = entries.select("solution_key", "journey").join(costs, ["solution_key", "journey"]).join(ends, ["solution_key", "journey"], "left").join(told, "solution_key")

    def flag(name: str) -> Column:
        return F.coalesce(name, F.lit(False))

    def listed(**named: Column) -> Column:
        return F.concat_ws(",", *[F.when(c, k.replace("_", "-")) for k, c in named.items()])

    lost = listed(contracts=flag("out_contract") & ~flag("contract_leads"), persistence=flag("out_persistence") & ~flag("persistence_leads"))
    absent = listed(contracts=~flag("out_contract"), persistence=~flag("out_persistence"), external_effects=~flag("out_external"))
    journey = F.col("journey")
    nothing = F.when((journey == "locate") & ~flag("roots"), "no-root").when((journey == "follow-flow") & ~flag("causal"), "no-causal-root").when((journey == "reverse-impact") & ~(flag("impact") & flag("measured")), "no-impact-root").when((journey == "evidence") & ~flag("proofs"), "no-evidence-index")
    missing = F.when((journey == "follow-flow") & (lost != ""), lost).when((journey == "reverse-impact") & ~flag("reached"), "reachable-set").when((journey == "locate") & ~flag("ends"), "page").when((journey == "evidence") & ~flag("ends"), "evidence-shard")
    limits = [F.element_at(F.create_map(*[F.lit(x) for j, own in JOURNEYS.items() for x in (j, own[i])]), journey) for i in range(2)]
    reads = F.when((journey == "locate") & F.contains("root", F.lit(":component:")), F.lit(COMPONENT_READS)).otherwise(limits[0])
    status, reason = within_budget(F.col("reads"), F.col("tokens"), reads, limits[1])
    is_absent = (journey == "follow-flow") & (absent != "")
    status = F.when(nothing.isNotNull(), "NotApplicable").when(missing.isNotNull(), "Failed").when(is_absent, "NotApplicable").otherwise(status)
    reason = F.when(nothing.isNotNull(), nothing).when(missing.isNotNull(), F.concat(F.lit("missing-terminal:"), missing)).when(is_absent, F.concat(F.lit("absent-terminal:"), absent)).otherwise(reason)
    return out.select("solution_key", sid.alias("solution_id"), "journey", status.alias("status"), reason.alias("reason"), "reads", "bytes", "tokens")
