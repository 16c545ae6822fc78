"""Lifting without a row for each scope in the shuffles, and counts without all keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.identity import packed, unpacked, variant_key
from ledgerline.model import SCOPES
from ledgerline.operators import fixpoint, lift, measures
from ledgerline.plans import catalog
from ledgerline.sources import facts


def test_packed_keys_come_back_and_stay_different(spark):
    digest = "0123456789abcdef" * 4
    keys = [f"relation:{digest}", f"evidence:{digest}", f":{digest}", f"relation:{digest.upper()}", f"relation:{digest}\n", digest, f"a:b:{digest}", "", "r1", "ä:ö", None]
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", packed(F.col("key")).alias("code"))
    got = rows.select("key", unpacked(F.col("code")).alias("back"), F.hex("code").alias("code"), F.length("code").alias("n")).collect()
    assert [r["back"] for r in got] == [r["key"] for r in got]
    assert len({r["code"] for r in got}) == len(keys)
    assert {r["key"]: r["n"] for r in got}[f"relation:{digest}"] == 42


def _graph(spark):
    """Relations with two pieces of evidence, evidence of two relations, keys that repeat, and ends that belong to nothing."""
    variant = lambda tfm: (tfm, "Debug", [], "x")
    place = [("a", "p1", "a.cs"), ("b", "p2", "b.cs"), ("b", "p3", "b.cs"), ("C", "p1", "C"), ("D", "p2", "D"), ("D", "p3", "D"), ("U", "p1", "U"), ("U", "p2", "U")]
    occurrences = [("s", e, (p, f"{p}/x.csproj"), variant("n"), path, None, "d", []) for e, p, path in place]
    entities = [("s", k, kind, k, None) for k, kind in (("a", "Symbol"), ("b", "Contract"), ("C", "Component"), ("D", "Component"), ("U", "DeploymentUnit"), ("lone", "Symbol"))]
    proofs = [("e1", "document:s:a.cs", "n"), ("e2", "document:s:a.cs", "m"), ("e3", "document:s:b.cs", "n"), ("e4", "document:s:gone.cs", "n")]
    evidence = [("s", k, d, variant(v), None, "d") for k, d, v in proofs]
    ends = [("r1", "a", "b", "http", ["e1", "e2"]), ("r2", "a", "b", "http", ["e2"]), ("r3", "b", "a", "http", ["e3", "e3"]), ("r3", "b", "b", "http", ["e4"]), ("r4", "lone", "b", "grpc", ["e4"]), ("r5", "a", "lone", "http", ["e1"]), ("r6", "a", "b", "no", ["e1"]), (None, "a", "b", "grpc", ["e1"])]
    relations = [("s", *r) for r in ends]
    rows = {"entities": entities, "occurrences": occurrences, "evidence": evidence, "relations": relations}
    return {name: spark.createDataFrame(own, facts.SCHEMAS[name]) for name, own in rows.items()}


def test_counts_without_keys_are_those_of_the_contributions(spark):
    g = _graph(spark)
    ends = (g["relations"], g["evidence"], lift.membership(g["entities"], g["occurrences"]), lift.project_by_document(g["occurrences"]))
    contributed = lift.contributions(*ends)
    plain = sorted(map(str, lift.aggregate(contributed, keep_members=False).select(*lift.DEPENDENCY, "occurrence_count", "variants", "relation_count", "evidence_count").collect()))
    assert {r["scope"] for r in contributed.collect()} == set(SCOPES)
    assert sorted(map(str, lift.counted(*ends).select(*lift.DEPENDENCY, "occurrence_count", "variants", "relation_count", "evidence_count").collect())) == plain
    documents = contributed.where("scope = 'document'")
    told = sorted(map(str, lift.aggregate(documents).collect()))
    assert sorted(map(str, lift.aggregate(lift.packed_contributions(*ends, scopes=("document",)), are_packed=True).select(lift.aggregate(documents).columns).collect())) == told
    assert any(r["relation_count"] == 2 and r["evidence_count"] == 2 and r["occurrence_count"] == 3 for r in lift.counted(*ends).collect())


def test_no_unit_or_component_is_in_one_partition(spark):
    """Occurrences of a component in many projects are dealt out before they are joined with its kind."""
    rows = spark.range(4000).select(F.lit("s").alias("solution_key"), F.lit("entity:s:component:c").alias("entity_key"), F.struct(F.concat(F.lit("p"), F.col("id").cast("string")).alias("key"), F.lit("p.csproj").alias("path")).alias("project"), F.lit("f").alias("relative_path"))
    entities = spark.createDataFrame([("s", "entity:s:component:c", "Component", "c", None)], facts.SCHEMAS["entities"])
    members = lift.membership(entities, rows)
    assert members.count() == 4000 + 2
    assert "_salt" in members._jdf.queryExecution().optimizedPlan().toString()


def test_dependencies_shuffle_no_digest_for_each_scope(spark):
    """Counts are taken without keys of relations behind the join with evidence."""
    rows = catalog.dependencies(spark, "/root/testdata/sf0.001")
    assert "relation" not in lift.counted(*catalog._facts(catalog.graph(spark, "/root/testdata/sf0.001")), distinct=False).columns
    assert rows.columns == [*lift.DEPENDENCY, "nature", "occurrence_count", "variants"]


def test_membership_keeps_partitions_where_rows_are_repeated(spark):
    """The joins that rows come out of several times are dealt among all of the session's partitions, and repeats are removed once."""
    place = [("a", "p1", "a.cs"), ("a", "p1", "b.cs"), ("a", "p1", "b.cs"), ("C", "p1", "C"), ("C", "p2", "C"), ("lost", "p1", "x.cs")]
    occurrences = spark.createDataFrame([("s", e, (p, f"{p}/x.csproj"), ("n", "Debug", [], "x"), path, None, "d", []) for e, p, path in place], facts.SCHEMAS["occurrences"])
    entities = spark.createDataFrame([("s", "a", "Symbol", "a", None), ("s", "a", "Symbol", "a", None), ("s", "C", "Component", "C", None)], facts.SCHEMAS["entities"])
    found = lift.membership(entities, occurrences)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") >= 2 and plan.count("Aggregate [solution_key") <= 2
    want = [("a", "document", "document:s:a.cs"), ("a", "document", "document:s:b.cs"), ("a", "project", "p1"), ("a", "component", "C"), ("C", "document", "document:s:C"), ("C", "project", "p1"), ("C", "project", "p2"), ("C", "component", "C")]
    assert sorted(found.select("entity_key", "scope", "member").collect()) == sorted(want)


def test_gaps_are_counted_by_packed_keys(spark):
    gaps = spark.createDataFrame([("s", f"gap:{'0f' * 32}", "Unknown", "c", ["a", "a", "b"], []), ("s", "g", "Candidate", "c", ["a"], [])], facts.SCHEMAS["gaps"])
    members = spark.createDataFrame([("s", "a", "project", "p"), ("s", "b", "project", "p")], "solution_key string, entity_key string, scope string, member string")
    found = measures.gap_counts(gaps, members)
    assert "unhex" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["entity"]: (r["gaps_candidate"], r["gaps_unknown"]) for r in found.collect()} == {"a": (1, 1), "b": (0, 1), "p": (1, 1)}


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_no_digest_is_computed_for_a_null_check(spark):
    """Keys of evidence are digests: a null check of them, pushed down to the scan, would compute each several times."""
    g = catalog.graph(spark, "/root/testdata/sf0.001")
    for rows in (lift.counted(*catalog._facts(g), distinct=False), lift.linked(*catalog._facts(g))):
        assert "sha2(" in _plan(rows) and not [line for line in _plan(rows).splitlines() if "Filter" in line and "sha2(" in line]


def test_null_evidence_proves_nothing(spark):
    g = _graph(spark)
    ends = (lift.membership(g["entities"], g["occurrences"]), lift.project_by_document(g["occurrences"]))
    null = spark.createDataFrame([("s", "r9", "a", "b", "messaging", [None])], facts.SCHEMAS["relations"])
    proof = spark.createDataFrame([("s", None, "document:s:a.cs", ("n", "Debug", [], "x"), None, "d")], facts.SCHEMAS["evidence"])
    relations, evidence = g["relations"].unionByName(null), g["evidence"].unionByName(proof)
    for distinct in (False, True):
        assert "messaging" not in {r["category"] for r in lift.counted(relations, evidence, *ends, distinct=distinct).collect()}
    assert "messaging" not in {r["category"] for r in lift.contributions(relations, evidence, *ends).collect()}


def test_linked_pairs_are_those_of_the_dependencies(spark):
    g = _graph(spark)
    ends = (g["relations"], g["evidence"], lift.membership(g["entities"], g["occurrences"]), lift.project_by_document(g["occurrences"]))
    for scopes in (SCOPES, ("document",), ("component", "project")):
        pairs = lift.linked(*ends, scopes=scopes)
        want = lift.counted(*ends, scopes=scopes).groupBy("solution_key", "scope", "source", "target").agg(F.count("*").alias("rows"))
        assert sorted(pairs.collect()) == sorted(want.select(pairs.columns).collect()) != []
    # One aggregation, of contributions without variants.
    assert _plan(lift.linked(*ends)).splitlines()[0].startswith("Aggregate") and "tfm" not in _plan(lift.linked(*ends))


def test_members_are_made_once_for_both_ends(spark):
    """The lookup of sources and that of targets read a stored table; an occurrence is dealt once for all scopes."""
    members = catalog._facts(catalog.graph(spark, "/root/testdata/sf0.001"), ("component",))[2]
    assert members.inputFiles() and {r["scope"] for r in members.collect()} == {"component"}
    g = _graph(spark)
    plan = _plan(lift.membership(g["entities"], g["occurrences"]))
    assert "Union" not in plan and plan.count("relative_path") > 0


def test_rounds_are_kept_as_tables_and_edges_once(spark, monkeypatch):
    """What a fixpoint keeps is compressed, and the first frontier of a closure is its edges, not a copy of them."""
    made = []
    own = fixpoint.checkpointed
    monkeypatch.setattr(fixpoint, "checkpointed", lambda df: made.append(own(df)) or made[-1])
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    found = fixpoint.depths(edges, in_one_task=0)
    assert sorted(tuple(r) for r in found.select("source", "target", "depth").collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert all(df.inputFiles() and df.inputFiles()[0].endswith(".zstd.parquet") for df in made) and len(made) == 3


def test_relations_with_their_evidence_are_lifted_without_a_join_of_digests(spark):
    g = _graph(spark)
    ends = (lift.membership(g["entities"], g["occurrences"]), lift.project_by_document(g["occurrences"]))
    proofs = g["evidence"].select("solution_key", F.col("key").alias("evidence"), "document_key", variant_key(F.col("variant")).alias("variant"))
    cited = g["relations"].select("solution_key", F.col("key").alias("relation"), "source_key", "target_key", "category", F.explode(F.array_distinct("evidence_keys")).alias("evidence"))
    proven = cited.join(proofs, ["solution_key", "evidence"])
    for scopes in (SCOPES, ("document",), ("component", "project")):
        for distinct in (False, True):
            want = lift.counted(g["relations"], g["evidence"], *ends, scopes=scopes, distinct=distinct)
            assert sorted(map(str, lift.counted_proven(proven, *ends, scopes=scopes, distinct=distinct).select(want.columns).collect())) == sorted(map(str, want.collect())) != []
        want = lift.linked(g["relations"], g["evidence"], *ends, scopes=scopes)
        assert sorted(lift.linked_proven(proven, *ends, scopes=scopes).select(want.columns).collect()) == sorted(want.collect())
        want = lift.packed_contributions(g["relations"], g["evidence"], *ends, scopes=scopes)
        assert sorted(map(str, lift.proven_contributions(proven, *ends, scopes=scopes).select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_the_tables_relations_need_no_digest_to_find_their_evidence(spark):
    for rows in (catalog.dependencies(spark, "/root/testdata/sf0.001"), catalog._fans(spark, "/root/testdata/sf0.001")):
        assert "sha2(" not in _plan(rows)
