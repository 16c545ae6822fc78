"""Retention: the part of a graph that proven roots reach, with its support and gaps."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.identity import packed, unpacked
from ledgerline.functions.predicates import is_test_path
from ledgerline.model import ROOT_KINDS, FactualGraph
from ledgerline.operators import fixpoint, sketch


class InvalidRelation(ValueError):
    """A relation without an existing end or without existing evidence."""


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key: the first in a named order (never an arbitrary one)."""
    packed = F.struct(*[F.col(c) for c in df.columns])
    first = df.groupBy(*key).agg(F.min_by(packed, F.struct(*order)).alias("row"))
    return first.select("row.*")


def test_only(occurrences: DataFrame) -> DataFrame:
    """solution_key, key of the entities that occur, and in test projects alone."""
    return occurrences.groupBy("solution_key", F.col("entity_key").alias("key")).agg(F.bool_and(is_test_path(F.col("project.path"))).alias("only")).where("only").drop("only")


def shape_conflicts(occurrences: DataFrame) -> DataFrame:
    """Entities that one variant shows in several shapes; equal rows are no conflict."""
    return occurrences.groupBy("solution_key", "entity_key", "variant").agg(F.count_distinct("shape_digest").alias("shapes")).where("shapes > 1")


def _ends(graph: FactualGraph) -> DataFrame:
    return graph.relations.select("solution_key", F.explode(F.array("source_key", "target_key")).alias("entity"))


def _unknown(graph: FactualGraph) -> DataFrame:
    """solution_key, entity: ends of relations that are no entities."""
    return _ends(graph).distinct().join(graph.entities.select("solution_key", F.col("key").alias("entity")), ["solution_key", "entity"], "left_anti")


def _unproven(graph: FactualGraph, *more: Column) -> DataFrame:
    """solution_key and ``more`` of relations for each piece of evidence that is missing, or for having none."""
    proof = graph.relations.select("solution_key", *more, F.explode_outer("evidence_keys").alias("evidence")).withColumn("evidence", packed(F.col("evidence")))
    return proof.join(graph.evidence.select("solution_key", packed(F.col("key")).alias("evidence")), ["solution_key", "evidence"], "left_anti").drop("evidence")


def has_invalid_relations(graph: FactualGraph) -> bool:
    """Whether :func:`invalid_relations` has a row; no relation's key is shuffled for it."""
    return not (_unknown(graph).isEmpty() and _unproven(graph).isEmpty())


def invalid_relations(graph: FactualGraph) -> DataFrame:
    """solution_key, key of relations with an unknown end, without evidence, or with unknown evidence."""
    unknown = _unknown(graph)
    ends = graph.relations.select("solution_key", packed(F.col("key")).alias("key"), F.explode(F.array("source_key", "target_key")).alias("entity"))
    ends = sketch.maybe(ends, sketch.cells(unknown), "solution_key", "entity")
    # A null end is in no cell that equality could confirm.
    ends = ends.join(unknown.withColumn("_unknown", F.lit(True)), ["solution_key", "entity"], "left").where(F.col("_unknown") | F.col("entity").isNull() | F.col("solution_key").isNull())
    found = ends.select("solution_key", "key").unionByName(_unproven(graph, packed(F.col("key")).alias("key"))).distinct()
    return found.select("solution_key", unpacked(F.col("key")).alias("key"))


def seeds(graph: FactualGraph, include_tests: bool = False) -> DataFrame:
    """Roots, and every entity that occurs in a project where a root occurs."""
    roots = graph.entities.where(F.col("kind").isin(*ROOT_KINDS)).select("solution_key", "key")
    if not include_tests:
        roots = roots.join(test_only(graph.occurrences), ["solution_key", "key"], "left_anti")
    placed = graph.occurrences.select("solution_key", F.col("entity_key").alias("key"), F.col("project.key").alias("project"))
    projects = placed.join(roots, ["solution_key", "key"], "left_semi").select("solution_key", "project").distinct()
    beside = placed.join(projects, ["solution_key", "project"], "left_semi").select("solution_key", "key")
    return roots.unionByName(beside).distinct()


def semi_or_unknown(rows: DataFrame, allowed: DataFrame, inventory: DataFrame, on: str) -> DataFrame:
    """Rows whose key is allowed, or isn't in the inventory at all."""
    refused = inventory.select(on).distinct().join(allowed.select(on).distinct(), on, "left_anti")
    return rows.join(refused, on, "left_anti")


def supported(graph: FactualGraph, reached: DataFrame, include_tests: bool = False) -> tuple[DataFrame, DataFrame]:
    """Relations that start or end at a reached entity, once each, and the keys of all that these bring in.

    Of sources that only tests have no relation comes in from outside.
    """
    # Relations whose source is reached for sure, by a sketch of the sources that aren't, stay where they are.
    there = reached.withColumnRenamed("key", "source_key")
    outside = graph.relations.select("solution_key", "source_key").distinct().join(there, ["solution_key", "source_key"], "left_anti")
    far = fixpoint.checkpointed(sketch.cells(outside))
    again = fixpoint.checkpointed(sketch.repeated(graph.relations, "solution_key", "key"))
    relations, keys = graph.relations, reached
    if not far.isEmpty():
        unsure = sketch.maybe(relations, far, "solution_key", "source_key").join(there.withColumn("_reached", F.lit(True)), ["solution_key", "source_key"], "left")
        incoming = unsure.where("_reached is null").drop("_reached").join(reached.withColumnRenamed("key", "target_key"), ["solution_key", "target_key"], "left_semi")
        if not include_tests:
            incoming = incoming.join(test_only(graph.occurrences).withColumnRenamed("key", "source_key"), ["solution_key", "source_key"], "left_anti")
        columns = relations.columns
        relations = sketch.never(relations, far, "solution_key", "source_key").unionByName(unsure.where("_reached").select(columns)).unionByName(incoming.select(columns))
        keys = reached.unionByName(incoming.select("solution_key", F.col("source_key").alias("key")).distinct())
    if not again.isEmpty():
        first = keep_first(sketch.maybe(relations, again, "solution_key", "key"), ["solution_key", "key"], ["source_key", "target_key", "category"])
        relations = sketch.never(relations, again, "solution_key", "key").unionByName(first)
    return relations, keys


def retained(graph: FactualGraph, include_tests: bool = False) -> FactualGraph:
    """Closure along outgoing relations from the seeds, one hop of incoming support, and what these cite.

    Evidence of refused test documents goes, and with it relations that are left without any.
    """
    if has_invalid_relations(graph):
        raise InvalidRelation(f"invalid-confirmed-relation: {invalid_relations(graph).first()['key']}")
    by = ("solution_key",)
    edges = graph.relations.select("solution_key", F.col("source_key").alias("source"), F.col("target_key").alias("target")).distinct()
    reached = fixpoint.reachable(seeds(graph, include_tests).withColumnRenamed("key", "node"), edges, by).withColumnRenamed("node", "key")
    relations, keys = supported(graph, reached, include_tests)

    inventory = graph.sources.select("solution_key", F.col("key").alias("document_key"), "is_test")
    refused = inventory.where("is_test").select("solution_key", "document_key") if not include_tests else inventory.limit(0).select("solution_key", "document_key")
    code = packed(F.col("key"))
    proof = graph.evidence.join(refused, ["solution_key", "document_key"], "left_anti").withColumn("_code", code)
    cited = relations.select("solution_key", F.explode("evidence_keys").alias("_code")).withColumn("_code", packed(F.col("_code")))
    evidence = proof.join(cited, ["solution_key", "_code"], "left_semi").select(graph.evidence.columns)
    held = proof.select("solution_key", "_code")
    # A relation with one piece of evidence stays with it or goes; others are gathered again.
    single = F.size(F.array_distinct("evidence_keys")) == 1
    ones = relations.where(single).withColumns({"key": code, "_code": packed(F.get("evidence_keys", F.lit(0)))}).drop("evidence_keys").join(held, ["solution_key", "_code"], "left_semi")
    ones = ones.withColumns({"key": unpacked(F.col("key")), "evidence_keys": F.array(unpacked(F.col("_code")))}).select(graph.relations.columns)
    several = relations.where(~single)
    left = several.select("solution_key", "key", F.explode("evidence_keys").alias("evidence")).withColumn("_code", packed(F.col("evidence"))).join(held, ["solution_key", "_code"], "left_semi")
    proven = left.groupBy("solution_key", "key").agg(F.array_sort(F.collect_set("evidence")).alias("evidence_keys"))
    relations = several.drop("evidence_keys").join(proven, ["solution_key", "key"]).select(graph.relations.columns).unionByName(ones)
    documents = evidence.select("solution_key", F.col("document_key").alias("key")).distinct()
    placed = occurrences_kept(graph.occurrences, keys, evidence.select("solution_key", "key"))
    return replace(
        graph,
        entities=graph.entities.join(keys, ["solution_key", "key"], "left_semi"),
        occurrences=placed,
        evidence=evidence,
        relations=relations,
        gaps=touched_gaps(graph.gaps, keys).drop("affected_retained"),
        sources=graph.sources.join(documents, ["solution_key", "key"], "left_semi"),
    )


def occurrences_kept(occurrences: DataFrame, keys: DataFrame, evidence: DataFrame) -> DataFrame:
    """Occurrences of retained entities; of those that cite evidence the ones that cite some that is retained."""
    own = occurrences.join(keys.select("solution_key", F.col("key").alias("entity_key")), ["solution_key", "entity_key"], "left_semi")
    # An occurrence is found again by its row, as it has no key.
    own = own.withColumn("_row", F.xxhash64(*[c for c in own.columns if c != "evidence_keys"], F.to_json("evidence_keys")))
    cited = own.select("solution_key", "_row", F.explode("evidence_keys").alias("key")).join(evidence.select("solution_key", "key"), ["solution_key", "key"], "left_semi").select("solution_key", "_row").distinct().withColumn("_held", F.lit(True))
    return own.join(cited, ["solution_key", "_row"], "left").where(F.col("_held") | (F.size("evidence_keys") <= 0) | F.col("evidence_keys").isNull()).select(occurrences.columns)


def touched_gaps(gaps: DataFrame, keys: DataFrame) -> DataFrame:
    """Gaps that touch a retained entity, with how many."""
    touched = gaps.select("solution_key", "key", F.explode("affected_keys").alias("entity")).join(keys.select("solution_key", F.col("key").alias("entity")), ["solution_key", "entity"], "left_semi")
    counts = touched.groupBy("solution_key", "key").agg(F.count("*").alias("affected_retained"))
    return gaps.join(counts, ["solution_key", "key"]).select(*gaps.columns, "affected_retained")


def relevant_gaps(gaps: DataFrame, keys: DataFrame) -> DataFrame:
    """As :func:`touched_gaps`, the most first: for who shows them, as a sort of all is no part of retention."""
    return touched_gaps(gaps, keys).orderBy(F.desc("affected_retained"), "key")


def fragment_counts(fragments: list[tuple[FactualGraph, FactualGraph]]) -> DataFrame:
    """extracted and filtered rows of every solution, summed up over fragments (each before and after retention)."""
    rows = reduce(DataFrame.unionByName, [retention_counts(before, after) for before, after in fragments])
    return rows.groupBy("solution_key").agg(F.sum(F.col("retained") + F.col("filtered")).alias("extracted"), F.sum("filtered").alias("filtered"))


def retention_counts(before: FactualGraph, after: FactualGraph) -> DataFrame:
    """retained and filtered rows of a solution over all row sets."""
    def counted(graph: FactualGraph, name: str) -> DataFrame:
        rows = None
        for table in ("entities", "relations", "evidence", "gaps", "sources"):
            own = getattr(graph, table).select("solution_key")
            rows = own if rows is None else rows.unionByName(own)
        return rows.groupBy("solution_key").agg(F.count("*").alias(name))

    both = counted(before, "total").join(counted(after, "kept"), "solution_key", "left")
    kept = F.coalesce("kept", F.lit(0))
    return both.select("solution_key", kept.alias("retained"), F.greatest(F.lit(0), F.col("total") - kept).alias("filtered"))
