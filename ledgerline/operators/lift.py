"""Lifting of relations to document, project, component and deployment-unit scope, and their aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.identity import document_key, packed, unpacked, variant_key
from ledgerline.functions.predicates import is_test_path
from ledgerline.model import CATEGORIES, SCOPES, FactualGraph, category_of, ordinal

DEPENDENCY = ("solution_key", "scope", "source", "target", "category")
#: Parts into which the occurrences of a component or deployment unit are dealt.
SALTS = 64
#: Cells of the sketch of keys that are in several pairs.
CELLS = 1 << 20


def scoped_occurrences(occurrences: DataFrame, include_tests: bool = False) -> DataFrame:
    return occurrences if include_tests else occurrences.where(~is_test_path(F.col("project.path")))


def project_by_document(occurrences: DataFrame, include_tests: bool = False) -> DataFrame:
    """solution_key, document_key, project: one row for each project that owns a document."""
    rows = scoped_occurrences(occurrences, include_tests)
    return rows.select("solution_key", document_key(F.col("solution_key"), F.col("relative_path")).alias("document_key"), F.col("project.key").alias("project")).distinct()


def _salted(key: Column) -> Column:
    """Whether an entity may occur in a large share of all projects. Told by the key alone, so that both sides of a join agree."""
    return F.coalesce(F.contains(key, F.lit(":component:")) | F.contains(key, F.lit(":deploymentunit:")), F.lit(False))


def membership(entities: DataFrame, occurrences: DataFrame, include_tests: bool = False) -> DataFrame:
    """solution_key, entity_key, scope, member: where each entity belongs, one row each.

    Components and deployment units of an entity are those of the projects it occurs in. An
    entity without an occurrence has no row. Components and deployment units, which have most of the
    occurrences each, are dealt out by salts of the project.
    """
    def dealt(df: DataFrame) -> DataFrame:
        return df.select("solution_key", F.col("key").alias("entity_key"), "kind", F.explode(F.when(_salted(F.col("key")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))

    at = ["solution_key", "entity_key", "_salt"]
    salt = F.when(_salted(F.col("entity_key")), F.pmod(F.xxhash64("project"), F.lit(SALTS)).cast("int")).otherwise(0)
    rows = scoped_occurrences(occurrences, include_tests).select("solution_key", "entity_key", F.col("project.key").alias("project"), document_key(F.col("solution_key"), F.col("relative_path")).alias("document")).withColumn("_salt", salt)
    # Rows come out of the last join several times, so these keep the session's number of partitions: by the bytes that come in, few tasks would
    # have them all. Repeats are removed once, at the end: each time before that a task would hold all its rows twice more. A project's roots
    # travel as an array, so that an occurrence is joined once for all scopes.
    parts = int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = rows.repartition(parts, *at).join(dealt(entities).drop("kind"), at)
    roots = rows.join(dealt(entities.where(F.col("kind").isin("Component", "DeploymentUnit"))), at).select("solution_key", "project", F.struct(F.when(F.col("kind") == "Component", "component").otherwise("deploymentunit").alias("scope"), F.col("entity_key").alias("member")).alias("root"))
    held = roots.groupBy("solution_key", "project").agg(F.collect_set("root").alias("_roots"))
    own = F.array(*[F.struct(F.lit(scope).alias("scope"), F.col(scope).alias("member")) for scope in ("document", "project")])
    every = F.concat(own, F.coalesce("_roots", F.array().cast("array<struct<scope:string,member:string>>")))
    found = known.repartition(parts, "solution_key", "project").join(held, ["solution_key", "project"], "left").select("solution_key", "entity_key", F.explode(every).alias("own"))
    return found.select("solution_key", "entity_key", "own.*").distinct()


def _pairs(relations: DataFrame) -> DataFrame:
    """solution_key, relation, source_key, target_key, category, evidence: relations of a category, a row for each evidence."""
    return relations.withColumn("category", category_of(F.col("category"))).where("category is not null").select("solution_key", F.col("key").alias("relation"), "source_key", "target_key", "category", F.explode(F.array_distinct("evidence_keys")).alias("evidence"))


def _never_null(key: str, missing: bytes) -> Column:
    """A :func:`packed` key with ``missing`` for null, which no key has.

    Of a key that may be null a join asks whether it is, and Spark asks that where tables are read, with the digests computed there, some times over.
    """
    return F.coalesce(packed(F.col(key)), F.lit(missing))


def _proofs(evidence: DataFrame) -> DataFrame:
    return evidence.select("solution_key", _never_null("key", b"\x02").alias("evidence"), "document_key", variant_key(F.col("variant")).alias("variant"))


def _lifted(rows: DataFrame, members: DataFrame, owners: DataFrame, scopes: tuple[str, ...], stored_rows: bool = False) -> DataFrame:
    """``rows`` (solution_key, source_key, target_key, document_key and more) once for each scope, source and target.

    A row's sources of all scopes travel as an array for each scope, so that it is shuffled once for each of its ends and not once for each scope.
    ``stored_rows`` says that the rows are read from a table, with no null end: then sources are looked up once for
    each pair of entity and document, which are fewer than the rows, and the rows shuffled once for both.
    """
    pair = ["solution_key", "source_key", "document_key"]
    whole = rows
    if stored_rows:
        rows = rows.select(*pair).distinct()
    more = [c for c in whole.columns if c not in (*pair, "target_key")]

    def start(value: str) -> Column:
        return F.struct(F.col(value).alias("source"))

    starts = {"document": F.array(start("document_key"))} if "document" in scopes else {}
    if above := [s for s in scopes if s in ("component", "deploymentunit")]:
        sources = members.where(F.col("scope").isin(*above)).groupBy("solution_key", F.col("entity_key").alias("source_key")).agg(*[F.collect_list(F.when(F.col("scope") == s, start("member"))).alias(f"_{s}") for s in above])
        rows = rows.join(sources, ["solution_key", "source_key"], "left")
        starts |= {s: F.col(f"_{s}") for s in above}
    if "project" in scopes:
        held = owners.groupBy("solution_key", "document_key").agg(F.collect_list(start("project")).alias("_project"))
        rows = rows.join(held, ["solution_key", "document_key"], "left")
        starts["project"] = F.col("_project")
    if stored_rows and starts.keys() != {"document"}:
        rows = whole.join(rows, pair)
    else:
        rows = whole if stored_rows else rows
    rows = rows.select("solution_key", "target_key", *more, *[c.alias(f"_{s}") for s, c in starts.items()])
    rows = rows.where(reduce(Column.__or__, [F.size(f"_{s}") > 0 for s in starts]))
    # Both ends must be known entities, though they may belong to nothing in a scope.
    targets = members.where(F.col("scope").isin(*scopes)).select("solution_key", F.col("entity_key").alias("target_key"), "scope", F.col("member").alias("target"))
    own = F.coalesce(*[F.when(F.col("scope") == s, F.col(f"_{s}")) for s in starts])
    return rows.join(targets, ["solution_key", "target_key"]).select("solution_key", "scope", F.explode(own).alias("own"), "target", *more).select("solution_key", "scope", "own.source", "target", *more)


def contributions(relations: DataFrame, evidence: DataFrame, members: DataFrame, owners: DataFrame, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """One row for each (relation, evidence, scope, source, target) before aggregation.

    Document scope starts at the evidence's document, project scope at that document's owners (so
    it vanishes where there is none), the other two at the source's membership. Targets
    are always the target's membership.
    """
    rows = packed_contributions(relations, evidence, members, owners, scopes)
    return rows.withColumns({c: unpacked(F.col(c)) for c in ("relation", "evidence")})


def packed_contributions(relations: DataFrame, evidence: DataFrame, members: DataFrame, owners: DataFrame, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """As :func:`contributions`, with relations and evidence as :func:`packed` keys."""
    rows = _pairs(relations).withColumns({"relation": packed(F.col("relation")), "evidence": _never_null("evidence", b"\x03")})
    rows = rows.join(_proofs(evidence), ["solution_key", "evidence"])
    return _contributed(_lifted(rows, members, owners, scopes))


def _contributed(lifted: DataFrame) -> DataFrame:
    return lifted.select(*DEPENDENCY, "variant", "relation", "evidence", F.lit(True).alias("is_confirmed"))


def _of_category(proven: DataFrame) -> DataFrame:
    return proven.withColumn("category", category_of(F.col("category"))).where("category is not null")


def proven_contributions(proven: DataFrame, members: DataFrame, owners: DataFrame, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """As :func:`packed_contributions`, of stored relations that have their evidence beside them.

    ``proven`` has solution_key, relation, source_key, target_key, category, evidence, document_key and variant (its key), a
    row for each relation and piece of evidence, and no null but in ``relation``: what a source that finds both at one place
    knows without a join of two tables of digests.
    """
    return _contributed(_lifted(_of_category(proven).withColumns({c: packed(F.col(c)) for c in ("relation", "evidence")}), members, owners, scopes, stored_rows=True))


def counted(relations: DataFrame, evidence: DataFrame, members: DataFrame, owners: DataFrame, scopes: tuple[str, ...] = SCOPES, distinct: bool = True) -> DataFrame:
    """The contributions, aggregated as by :func:`aggregate` without members; without ``distinct`` relations and evidence aren't counted.

    A relation or piece of evidence that is in one pair alone is counted as it comes, and its key is dropped
    before the pair is lifted. Keys that may be in several pairs, by a sketch of fixed size, are kept and their repeats removed.
    """
    rows = _marked(_pairs(relations)) if distinct else _pairs(relations).drop("relation")
    rows = rows.withColumn("evidence", _never_null("evidence", b"\x03")).join(_proofs(evidence), ["solution_key", "evidence"])
    return _summed(rows, members, owners, scopes, distinct)


def counted_proven(proven: DataFrame, members: DataFrame, owners: DataFrame, scopes: tuple[str, ...] = SCOPES, distinct: bool = True) -> DataFrame:
    """As :func:`counted`, of the rows of :func:`proven_contributions`."""
    rows = _of_category(proven)
    rows = _marked(rows).withColumn("evidence", packed(F.col("evidence"))) if distinct else rows.drop("relation")
    return _summed(rows, members, owners, scopes, distinct, stored_rows=True)


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with relation_once and evidence_again: whether their keys are in no other pair for sure, or may be. Relations that are lose their key."""
    cells = {c: F.xxhash64(F.lit(c), "solution_key", c) for c in ("relation", "evidence")}
    twice = rows.select(F.explode(F.array(*cells.values())).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    twice = twice.select(F.pmod("cell", F.lit(CELLS)).alias("cell")).distinct()
    for c in cells:
        # At most CELLS numbers are broadcast.
        rows = rows.withColumn("cell", F.pmod(cells[c], F.lit(CELLS))).join(F.broadcast(twice.withColumn(f"{c}_again", F.lit(True))), "cell", "left").drop("cell")
    return rows.withColumn("relation_once", F.col("relation").isNotNull() & F.col("relation_again").isNull()).withColumn("relation", F.when(F.col("relation_again"), packed(F.col("relation")))).drop("relation_again")


def _summed(rows: DataFrame, members: DataFrame, owners: DataFrame, scopes: tuple[str, ...], distinct: bool, stored_rows: bool = False) -> DataFrame:
    keys = ("relation", "evidence") if distinct else ()
    if distinct:
        rows = rows.withColumn("evidence_once", F.col("evidence_again").isNull()).withColumn("evidence", F.when(F.col("evidence_again"), F.col("evidence"))).drop("evidence_again")
    else:
        rows = rows.drop("evidence")
    rows = _lifted(rows, members, owners, scopes, stored_rows)
    sums = {c: f"{c}_count" for c in keys}
    found = rows.select(*DEPENDENCY, "variant", F.lit(1).alias("n"), *[F.col(f"{c}_once").cast("int").alias(c) for c in keys])
    if distinct:
        pairs = F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("key")) for c in keys])
        again = rows.where("relation is not null or evidence is not null").select(*DEPENDENCY, F.explode(F.filter(pairs, lambda p: p["key"].isNotNull())).alias("own")).select(*DEPENDENCY, "own.*").distinct()
        found = found.unionByName(again.select(*DEPENDENCY, F.lit(None).cast("string").alias("variant"), F.lit(0).alias("n"), *[(F.col("part") == c).cast("int").alias(c) for c in keys]))
    return found.groupBy(*DEPENDENCY).agg(F.lit("direct").alias("nature"), F.sum("n").alias("occurrence_count"), F.array_sort(F.collect_set("variant")).alias("variants"), *[F.sum(c).alias(name) for c, name in sums.items()])


def linked(relations: DataFrame, evidence: DataFrame, members: DataFrame, owners: DataFrame, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """solution_key, scope, source, target, rows: the pairs of the dependencies, each with the number of its categories.

    As grouping the dependencies by pair, in one aggregation of the contributions.
    """
    rows = _lifted(_pairs(relations).drop("relation").withColumn("evidence", _never_null("evidence", b"\x03")).join(_proofs(evidence).drop("variant"), ["solution_key", "evidence"]).drop("evidence"), members, owners, scopes)
    return _linked(rows)


def linked_proven(proven: DataFrame, members: DataFrame, owners: DataFrame, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """As :func:`linked`, of the rows of :func:`proven_contributions`."""
    return _linked(_lifted(_of_category(proven).drop("relation", "evidence", "variant"), members, owners, scopes, stored_rows=True))


def _linked(rows: DataFrame) -> DataFrame:
    bit = F.coalesce(*[F.when(F.col("category") == c, F.lit(1 << i)) for i, c in enumerate(CATEGORIES)])
    return rows.groupBy(*DEPENDENCY[:-1]).agg(F.bit_count(F.bit_or(bit)).cast("long").alias("rows"))


def aggregate(rows: DataFrame, keep_members: bool = True, by: tuple[str, ...] = DEPENDENCY, are_packed: bool = False) -> DataFrame:
    """Dependencies: contributions counted before, and variants, relations and evidence gathered after removing repeats.

    With ``keep_members`` relations and evidence come as sorted arrays, for publishing; without,
    as distinct counts, which stay small for scopes that gather a whole corpus. ``are_packed`` says that
    the rows have :func:`packed` keys.
    """
    rows = rows.where("is_confirmed")
    sets = [F.array_sort(F.collect_set("variant")).alias("variants")]
    if keep_members:
        sets += [F.array_sort(F.transform(F.collect_set(c), unpacked) if are_packed else F.collect_set(c)).alias(name) for c, name in (("relation", "relations"), ("evidence", "evidence"))]
    else:
        sets += [F.count_distinct(c).alias(name) for c, name in (("relation", "relation_count"), ("evidence", "evidence_count"))]
    return rows.groupBy(*by).agg(F.lit("direct").alias("nature"), F.count("*").alias("occurrence_count"), *sets)


def variants(rows: DataFrame, by: tuple[str, ...] = DEPENDENCY) -> DataFrame:
    """As :func:`aggregate`, with neither relations nor evidence, nor counts of them."""
    return rows.where("is_confirmed").groupBy(*by).agg(F.lit("direct").alias("nature"), F.count("*").alias("occurrence_count"), F.array_sort(F.collect_set("variant")).alias("variants"))


def cited(rows: DataFrame, by: tuple[str, ...] = DEPENDENCY) -> DataFrame:
    """(``by``, part, key): each relation and each piece of evidence (``part`` says which) that a dependency stands for, a row each.

    In this form no row grows with the busiest pair.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("key")) for c in ("relation", "evidence")])
    return rows.where("is_confirmed").select(*by, F.explode(pairs).alias("own")).select(*by, "own.*").distinct()


def in_order(dependencies: DataFrame) -> DataFrame:
    """Canonical order: scope and category by their place in the vocabulary, not by name."""
    return dependencies.orderBy("solution_key", ordinal(F.col("scope"), SCOPES), "source", "target", ordinal(F.col("category"), CATEGORIES))


def dependencies_of(graph: FactualGraph, include_tests: bool = False) -> DataFrame:
    members = membership(graph.entities, graph.occurrences, include_tests)
    return aggregate(contributions(graph.relations, graph.evidence, members, project_by_document(graph.occurrences, include_tests)))
