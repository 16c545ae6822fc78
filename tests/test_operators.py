"""Operators on small literal graphs, against values worked out by hand or by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import identity, predicates
from ledgerline.model import ENTITIES, EVIDENCE, GAPS, OCCURRENCES, RELATIONS, SOURCES, FactualGraph
from ledgerline import storage
from ledgerline.operators import fixpoint, index, lift, measures, retain
from ledgerline.plans import package


def edges(spark, pairs, scope="component"):
    return spark.createDataFrame([("s", scope, a, b, "http", "direct") for a, b in pairs], "solution_key string, scope string, source string, target string, category string, nature string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- identity and predicates ---


def test_public_id_is_80_bits_of_sha256(spark):
    import base64
    import hashlib

    for key in ("a", "entity:solution:x", "é"):
        expected = "ent_" + base64.b32hexencode(hashlib.sha256(key.encode()).digest()[:10]).decode().lower()
        assert one(spark, identity.public_id("ent", F.lit(key))) == expected
    with pytest.raises(ValueError):
        identity.public_id("Ent", F.lit("x"))


def test_handles_count_in_base36(spark):
    assert [one(spark, identity.local_handle(F.lit(n))) for n in (0, 9, 10, 35, 36, 36**6 - 1)] == ["0", "9", "a", "z", "10", "zzzzzz"]
    with pytest.raises(Exception, match="overflow"):
        one(spark, identity.local_handle(F.lit(36**6)))


def test_collisions_of_public_ids(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "a"), ("y", "c"), ("y", "c")], "id string, key string")
    assert [tuple(r) for r in identity.collisions(df, "id", "key").collect()] == [("x", 2, ["a", "b"])]


def test_safety_of_texts(spark):
    cases = {"token: x": ("Redacted", "secret", "[REDACTED]"), "/etc": ("Redacted", "absolute-path", "[REDACTED]"), "a/../b": ("Rejected", "path-escape", None), "plain": ("Retained", "retained", "plain")}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [tuple(r[0]) for r in df.select(predicates.safety(F.col("t"))).collect()] == list(cases.values())


def test_handles_are_json_strings(spark):
    assert one(spark, identity.handle_of_json(identity.handle_json(F.lit("a9")))) == "a9"
    for bad in ("7", "null", '{"a":1}', '"A"', '""', '"abcdefg"'):
        with pytest.raises(Exception, match="no handle"):
            one(spark, identity.handle_of_json(F.lit(bad)))


def test_occurrences_follow_their_evidence(spark):
    span, v, p = (1, 1, 1, 2), ("t", "D", [], "l"), ("k", "k.csproj")
    rows = spark.createDataFrame([("s", "a", p, v, f"{i}.cs", span, "d", own) for i, own in enumerate([[], ["e1"], ["e2"], ["e1", "e2"], None])] + [("s", "b", p, v, "b.cs", span, "d", ["e1"])], OCCURRENCES)
    kept = retain.occurrences_kept(rows, spark.createDataFrame([("s", "a")], "solution_key string, key string"), spark.createDataFrame([("s", "e1")], "solution_key string, key string"))
    assert sorted(r["relative_path"] for r in kept.collect()) == ["0.cs", "1.cs", "3.cs", "4.cs"]


def test_variant_key_sorts_symbols(spark):
    df = spark.createDataFrame([(("net8.0", "Debug", ["b", "a", "b"], "linux"),), (("net8.0", "Debug", [], "linux"),)], "v struct<tfm:string,configuration:string,symbols:array<string>,environment:string>")
    assert [r[0] for r in df.select(identity.variant_key(F.col("v"))).collect()] == ["variant:net8.0:Debug:a,b:linux", "variant:net8.0:Debug:-:linux"]


def test_paths(spark):
    cases = [
        ("src/A.cs", "CSharpSource", False, True), ("A.Tests/A.Tests.CSPROJ", "ProjectFile", True, True), ("x/AppSettings.Dev.json", "Configuration", False, True),
        ("testes/readme.md", "Unsupported", True, True), ("contests/a.cs", "CSharpSource", False, True), ("../a.cs", "CSharpSource", False, False), ("/a.cs", "CSharpSource", False, False), ("C:/a.cs", "CSharpSource", False, False), ("a//b", "Unsupported", False, False), ("", "Unsupported", False, False),
    ]
    df = spark.createDataFrame([(p,) for p, *_ in cases], "path string")
    got = df.select("path", predicates.source_kind(F.col("path")), predicates.is_test_path(F.col("path")), predicates.is_safe_relative(F.col("path"))).collect()
    assert [tuple(r) for r in got] == cases


def test_dispositions_take_the_first_rule(spark):
    cases = {"password = 1 ..": "secret", "api_key: x": "secret", "/etc/x": "absolute-path", "\\\\host\\x": "absolute-path", "a/../b": "path-escape", "a\\b": "path-escape", "plain": "retained"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(predicates.disposition(F.col("t"))).collect()] == list(cases.values())


def test_redaction_leaves_comments(spark):
    source = 'var a = "token: x"; // "token: y"\nvar b = "ok"; /* "secret=1" */ var c = @"password=""q""";'
    expected = 'var a = "[REDACTED]"; // "token: y"\nvar b = "ok"; /* "secret=1" */ var c = "[REDACTED]";'
    assert one(spark, predicates.redacted_source(F.lit(source))) == expected


def test_canonical_text_and_spans(spark):
    df = spark.createDataFrame([("a b",), (" a",), ("a  b",), ("a\tb",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(predicates.is_canonical_text(F.col("t"))).collect()] == [True, False, False, False, False, False]
    spans = spark.createDataFrame([((1, 1, 1, 1),), ((1, 2, 1, 1),), ((0, 1, 1, 1),), ((1, 9, 2, 1),)], "s struct<start_line:int,start_column:int,end_line:int,end_column:int>")
    assert [r[0] for r in spans.select(predicates.is_valid_span(F.col("s"))).collect()] == [True, False, False, True]


# --- measures ---


def test_aggregation_counts_before_removing_repeats(spark):
    rows = spark.createDataFrame([("s", "component", "a", "b", "http", v, r, e, c) for v, r, e, c in [("v1", "r1", "e1", True), ("v1", "r1", "e1", True), ("v2", "r1", "e2", True), ("v3", "r2", "e3", False)]], "solution_key string, scope string, source string, target string, category string, variant string, relation string, evidence string, is_confirmed boolean")
    r = lift.aggregate(rows).first()
    assert (r["occurrence_count"], r["variants"], r["relations"], r["evidence"]) == (3, ["v1", "v2"], ["r1"], ["e1", "e2"])


def test_fans_count_neighbours_once_and_crossings_by_category(spark):
    rows = edges(spark, [("a", "b"), ("a", "a"), ("c", "b")]).unionByName(edges(spark, [("a", "b")]).withColumn("category", F.lit("grpc")))
    got = {r["entity"]: (r["fan_in"], r["fan_out"], r["cross_component_edges"]) for r in measures.fan(rows).collect()}
    assert got == {"a": (1, 2, 2), "b": (2, 0, 0), "c": (0, 1, 1)}


def test_impact_of_diamond_and_cycle(spark):
    rows = edges(spark, [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d")])
    got = {(r["entity"], r["dependent"]): r["depth"] for r in measures.reverse_impact(rows).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"b": 1, "c": 1, "d": 2}
    assert not any(a == b for a, b in got)


def brute_components(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    for _ in nodes:
        reach = {n: r | {y for x in r for y in reach[x]} for n, r in reach.items()}
    return {frozenset(m for m in nodes if m == n or (m in reach[n] and n in reach[m])) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("seed", range(3))
def test_cycles_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    pairs = {(f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}") for _ in range(13)}
    got = {frozenset(r["members"]) for r in measures.cycles(edges(spark, pairs)).collect()}
    assert got == brute_components(pairs)


def test_cycle_names_and_loops(spark):
    got = [r["cycle"] for r in measures.cycles(edges(spark, [("b", "a"), ("a", "b"), ("c", "c"), ("d", "c")])).orderBy("cycle").collect()]
    assert got == ["cycle:component:a,b", "cycle:component:c"]


def test_doubling_equals_breadth_first(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    e = edges(spark, pairs).select("source", "target")
    assert index.same_rows(fixpoint.depths(e), fixpoint.depths_by_doubling(e))


def brute_depths(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = {}
    for start in after:
        frontier, n = after[start], 1
        while frontier:
            for x in frontier:
                out[start, x] = n
            frontier, n = {y for x in frontier for y in after.get(x, ()) if (start, y) not in out}, n + 1
    return out


@pytest.mark.parametrize("in_one_task,seed,nodes,pairs", [(0, 8, 8, 11), (10**6, 8, 8, 11), (10**6, 1, 20, 22), (10**6, 2, 9, 30)])
def test_fixpoints_equal_brute_force(spark, in_one_task, seed, nodes, pairs):
    rnd = random.Random(seed)
    graphs = {s: {(f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}") for _ in range(pairs)} for s in ("one", "two")}
    rows = [(s, a, b) for s, pairs in graphs.items() for a, b in pairs] + [("one", None, "n1"), ("one", "n1", None)]
    df = spark.createDataFrame(rows, "s string, source string, target string")
    starts = [("one", "n0"), ("two", "n3"), ("two", "alone"), ("three", "n1"), ("one", None)]
    got = {tuple(r) for r in fixpoint.reachable(spark.createDataFrame(starts, "s string, node string"), df, ("s",)).collect()}
    paths = {s: brute_depths(pairs) for s, pairs in graphs.items()}
    assert got == {(s, n) for s, n in starts if n} | {(s, b) for s, n in starts for (a, b) in paths.get(s, ()) if a == n}
    for most in (None, 2):
        found = fixpoint.depths(df, ("s",), most, in_one_task).collect()
        assert len(found) == len({tuple(r)[:3] for r in found})
        assert {tuple(r) for r in found} == {(s, a, b, d) for s, own in paths.items() for (a, b), d in own.items() if most is None or d <= most}
    sets = {}
    for r in fixpoint.strong_components(df, ("s",)).collect():
        sets.setdefault((r["s"], r["component"]), set()).add(r["node"])
    assert {(s, frozenset(m)) for (s, c), m in sets.items()} == {(s, m) for s, pairs in graphs.items() for m in brute_components(pairs)}
    assert all(c == min(m) for (_, c), m in sets.items())
    without = df.drop("s").where("source is not null")
    assert fixpoint.depths(without, in_one_task=in_one_task).count() == len(brute_depths({(a, b) for _, a, b in rows if a and b}))
    assert fixpoint.strong_components(without.limit(0)).isEmpty()


def chain(n):
    """Two-node cycles, each leading to the next, with names in the chain's order."""
    return [(f"n{i:05d}", f"n{j:05d}") for k in range(n) for i, j in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k), (2 * k + 1, 2 * k + 2)) if j < 2 * n]


def test_a_long_chain_of_cycles(spark):
    got = fixpoint.strong_components(spark.createDataFrame(chain(1500), "source string, target string"))
    assert {tuple(r) for r in got.collect()} == {(f"n{i:05d}", f"n{i - i % 2:05d}") for i in range(3000)}


@pytest.fixture
def checkpoints(monkeypatch):
    """How many checkpoints are made: a few a round."""
    made = []
    own = fixpoint.checkpointed
    monkeypatch.setattr(fixpoint, "checkpointed", lambda df: made.append(1) or own(df))
    return made


def test_rounds_grow_with_the_logarithm_of_chains_and_rings(spark, checkpoints):
    n = 10_000
    numbers = spark.range(n).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    ring = numbers.withColumn("target", F.col("target") % n)
    found = fixpoint.strong_components(ring.unionByName(numbers.select((F.col("source") + n).alias("source"), (F.col("target") + n).alias("target"))))
    assert tuple(found.agg(F.count("*"), F.min("node"), F.max("node"), F.max("component")).first()) == (n, 0, n - 1, 0)
    assert len(checkpoints) < 110
    checkpoints.clear()
    assert fixpoint.reachable(spark.createDataFrame([(7,)], "node long"), numbers).count() == n - 6
    assert len(checkpoints) < 110


def test_what_does_not_settle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "MOST_ROUNDS", 1)
    df = spark.createDataFrame([(i, j) for i in range(6) for j in range(6) if i != j], "source long, target long")
    with pytest.raises(RuntimeError, match="not settled"):
        fixpoint.strong_components(df)


# --- retention and lifting on one small graph ---


@pytest.fixture(scope="module")
def graph(spark):
    v = ("net8.0", "Debug", [], "linux")
    span = (1, 1, 1, 2)
    project = {"p1": ("project:s:A/A.csproj", "A/A.csproj"), "p2": ("project:s:B/B.csproj", "B/B.csproj"), "pt": ("project:s:A.Tests/A.Tests.csproj", "A.Tests/A.Tests.csproj")}
    entities = [("s", "c1", "Component", "A", None), ("s", "c2", "Component", "B", None), ("s", "m1", "Symbol", "m1", None), ("s", "m2", "Symbol", "m2", None), ("s", "far", "Symbol", "far", None), ("s", "t1", "Symbol", "t1", None), ("s", "up", "Symbol", "up", None), ("s", "lone", "Symbol", "lone", None)]
    occurrences = [("s", e, project[p], v, path, span, "d", []) for e, p, path in [("c1", "p1", "A/A.csproj"), ("m1", "p1", "A/m1.cs"), ("c2", "p2", "B/B.csproj"), ("m2", "p2", "B/m2.cs"), ("t1", "pt", "A.Tests/t.cs")]]
    evidence = [("s", "e1", "document:s:A/m1.cs", v, span, "x"), ("s", "e2", "document:s:B/m2.cs", v, span, "x"), ("s", "et", "document:s:A.Tests/t.cs", v, span, "x"), ("s", "eu", "document:s:elsewhere.cs", v, span, "x")]
    relations = [("s", "r1", "m1", "m2", "internal-invocation", ["e1"]), ("s", "r2", "m2", "far", "http", ["e2"]), ("s", "rt", "t1", "m1", "internal-invocation", ["et"]), ("s", "ru", "up", "m2", "persistence-store", ["eu"]), ("s", "rc", "m1", "m2", "configuration", ["e1"])]
    gaps = [("s", "g1", "Unknown", "x", ["m1", "far"], []), ("s", "g2", "Candidate", "x", ["m2"], []), ("s", "g3", "Unknown", "x", ["lone"], [])]
    sources = [("s", "document:s:A/m1.cs", "A/m1.cs", False, "d"), ("s", "document:s:B/m2.cs", "B/m2.cs", False, "d"), ("s", "document:s:A.Tests/t.cs", "A.Tests/t.cs", True, "d")]
    make = spark.createDataFrame
    return FactualGraph(make(entities, ENTITIES), make(occurrences, OCCURRENCES), make(evidence, EVIDENCE), make(relations, RELATIONS), make(gaps, GAPS), make(sources, SOURCES))


def keys(df, column="key"):
    return sorted(r[column] for r in df.select(column).collect())


def test_retention(spark, graph):
    kept = retain.retained(graph)
    assert keys(kept.entities) == ["c1", "c2", "far", "m1", "m2", "up"]
    assert keys(kept.relations) == ["r1", "r2", "rc", "ru"]
    assert keys(kept.evidence) == ["e1", "e2", "eu"]
    assert keys(kept.gaps) == ["g1", "g2"]
    shown = retain.relevant_gaps(graph.gaps, kept.entities.select("solution_key", "key")).collect()
    assert [(r["key"], r["affected_retained"]) for r in shown] == [("g1", 2), ("g2", 1)]
    assert keys(kept.sources) == ["document:s:A/m1.cs", "document:s:B/m2.cs"]
    counts = retain.retention_counts(graph, kept).first()
    assert counts["retained"] == 6 + 4 + 3 + 2 + 2
    assert counts["filtered"] == 8 + 5 + 4 + 3 + 3 - counts["retained"]


def test_retention_with_tests(spark, graph):
    assert keys(retain.retained(graph, include_tests=True).relations) == ["r1", "r2", "rc", "rt", "ru"]


def test_broken_relations_are_refused(spark, graph):
    from dataclasses import replace

    bad = graph.relations.unionByName(spark.createDataFrame([("s", "rx", "m1", "nowhere", "http", ["e1"])], RELATIONS))
    with pytest.raises(retain.InvalidRelation, match="invalid-confirmed-relation"):
        retain.retained(replace(graph, relations=bad))


def test_scopes_take_their_ends_from_different_columns(spark, graph):
    kept = retain.retained(graph)
    got = {(r["scope"], r["source"], r["target"], r["category"]): r["occurrence_count"] for r in lift.dependencies_of(kept).collect()}
    assert got == {
        ("document", "document:s:A/m1.cs", "document:s:B/m2.cs", "internal-invocation"): 1,
        ("project", "project:s:A/A.csproj", "project:s:B/B.csproj", "internal-invocation"): 1,
        ("component", "c1", "c2", "internal-invocation"): 1,
        # No one owns the document of ``up``, so its relation has a document scope only.
        ("document", "document:s:elsewhere.cs", "document:s:B/m2.cs", "persistence"): 1,
    }


def test_order_of_input_does_not_matter(spark, graph):
    from dataclasses import replace

    turned = replace(graph, **{k: v.orderBy(F.rand(7)) for k, v in graph.tables().items()})
    assert index.same_rows(lift.dependencies_of(retain.retained(graph)), lift.dependencies_of(retain.retained(turned)))


# --- indexes and shards ---


def test_shards_close_before_the_target_is_passed(spark):
    df = spark.createDataFrame([("f", f"k{i}", s) for i, s in enumerate([40, 30, 30, 100, 1, 99])] + [("g", "a", 7)], "family string, key string, size long")
    got = {(r["family"], r["key"]): r["shard"] for r in index.pack_shards(df, "family", "key", "size", 100, 150).collect()}
    assert got == {("f", "k0"): 0, ("f", "k1"): 0, ("f", "k2"): 0, ("f", "k3"): 1, ("f", "k4"): 2, ("f", "k5"): 2, ("g", "a"): 0}
    ranges = index.shard_ranges(index.pack_shards(df, "family", "key", "size", 100, 150), "family")
    assert sorted(map(tuple, ranges.select("family", "shard", "records", "first").collect())) == [("f", 0, 3, 0), ("f", 1, 1, 3), ("f", 2, 2, 4), ("g", 0, 1, 0)]
    assert index.broken_ranges(ranges, "family").isEmpty()
    assert index.broken_ranges(ranges.withColumn("first", F.col("first") + F.col("shard")), "family").count() == 2


def test_oversized_records_are_an_error(spark):
    with pytest.raises(Exception, match="oversized-record: k"):
        index.pack_shards(spark.createDataFrame([("f", "k", 200)], "family string, key string, size long"), "family", "key", "size", 100, 150).collect()


def test_corrupt_handles_are_an_error(spark):
    words = index.dictionary(spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "a")], "solution_key string, key string"), ["solution_key"], "key")
    rows = spark.createDataFrame([("s", "b"), ("s", "a")], "solution_key string, source string")
    coded = index.encoded(rows, words, ["solution_key"], "source")
    assert keys(coded, "source") == ["0", "1"]
    assert keys(index.decoded(coded, words, ["solution_key"], "source"), "source") == ["a", "b"]
    with pytest.raises(Exception, match="corrupt handle zz"):
        index.decoded(spark.createDataFrame([("s", "zz")], "solution_key string, source string"), words, ["solution_key"], "source").collect()


def test_rows_that_differ_are_found_by_digests(spark):
    one = spark.createDataFrame([(i, f"v{i}", [i, i + 1]) for i in range(500)] + [(3, "v3", [3, 4])], "a long, b string, c array<long>")
    same, less = one.repartition(7), one.where("a != 77").withColumn("b", F.when(F.col("a") == 400, "other").otherwise(F.col("b")))
    once = one.dropDuplicates()
    found = [[sorted(r["a"] for r in side.collect()) for side in pair] for pair in index.differing_rows([(one, same.select("c", "b", "a")), (one, less), (one, once), (one.limit(0), one.limit(0))], 16)]
    assert found == [[[], []], [[77, 400], [400]], [[3], []], [[], []]]
    assert index.same_rows(one, same) and not index.same_rows(one, once) and not index.same_rows(one, less)


def test_lists_come_in_pages_and_back(spark):
    rows = spark.createDataFrame([("s", k, n, c) for k, own in (("hub", range(0, 5000, 7)), ("leaf", [3])) for n, c in ((n, f"c{n % 2}") for n in own)], "s string, key string, ordinal long, category string")
    pages = index.inverted_pages(rows, ["s", "key"], page=100)
    told = sorted((r["key"], r["page"], r["first"], len(r["gaps"]) + 1, tuple(r["categories"])) for r in pages.collect())
    assert told == [("hub", k, 700 * k, min(100, 715 - 100 * k), ("c0", "c1")) for k in range(8)] + [("leaf", 0, 3, 1, ("c1",))]
    assert index.same_rows(index.decoded_pages(pages, ["s", "key"]), rows.select("s", "key", "ordinal"))
    whole = {(r["key"], n) for r in pages.select("key", index.decoded_list(F.col("first"), F.col("gaps")).alias("own")).collect() for n in r["own"]}
    assert whole == {(r["key"], r["ordinal"]) for r in rows.collect()}


def test_the_row_before_is_found_across_ranges(spark):
    df = spark.createDataFrame([("s", i, i * 2) for i in range(1000)] + [("t", 5, 1)], "s string, at long, v long").repartition(5)
    found = index.with_before(df, ["s"], ["at"], F.col("v"), "before")
    assert {(r["s"], r["at"]): r["before"] for r in found.collect()} == {("s", i): 2 * i - 2 if i else None for i in range(1000)} | {("t", 5): None}


def test_unsorted_rows_are_found(spark):
    df = spark.createDataFrame([("s", 0, "a"), ("s", 1, "c"), ("s", 2, "b"), ("s", 3, "b")], "solution_key string, ordinal long, key string")
    assert [r["ordinal"] for r in index.unsorted_rows(df, ["solution_key"], "ordinal", "key").orderBy("ordinal").collect()] == [2, 3]


def test_first_row_is_by_a_named_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, o int, v string")
    assert sorted(map(tuple, retain.keep_first(df, ["k"], [F.col("o")]).collect())) == [("a", 1, "y"), ("b", 1, None)]


def test_empty_graph(spark):
    nothing = edges(spark, [("a", "b")]).limit(0)
    assert measures.fan(nothing).isEmpty()
    assert measures.cycles(nothing).isEmpty()
    assert measures.reverse_impact(nothing).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_chunked_packing_equals_one_stream(spark, seed):
    rnd = random.Random(seed)
    records = [(f"f{i % 2}", f"k{i:05d}", rnd.choice((0, 5, 30, 60, 99, 140))) for i in range(600)]
    expected = {}
    for family in ("f0", "f1"):
        used = shard = count = 0
        for _, key, size in sorted(r for r in records if r[0] == family):
            if count and used + size > 100:
                shard, used, count = shard + 1, 0, 0
            used, count = used + size, count + 1
            expected[family, key] = shard
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(records, "family string, key string, size long")
        packed = index.pack_shards(df, "family", "key", "size", 100, 150)
        assert packed.select(F.spark_partition_id()).distinct().count() > 5
        assert {(r["family"], r["key"]): r["shard"] for r in packed.collect()} == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_are_given_with_one_shuffle(spark):
    """Sorted ranges number their rows as they are stored: no window, which would shuffle them all again."""
    rows = spark.range(5000).select(F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("by"), (F.col("id") * 7919 % 5003).alias("n"), F.when(F.col("id") % 11 != 0, F.col("id") % 5).alias("m"))
    order = [F.col("m") * 2, "n"]
    for few in (True, False):
        placed = index.spread_ordinals(rows, ["by"], order, few=few)
        assert "row_number" not in placed._jdf.queryExecution().optimizedPlan().toString()
        assert placed.columns == [*rows.columns, "ordinal"]
        want = index.ordinals(rows.withColumn("o", order[0]), ["by"], ["o", "n"]).drop("o")
        assert placed.exceptAll(want).isEmpty() and want.exceptAll(placed).isEmpty()


def test_split_closures_and_cycles_equal_whole_ones(spark):
    """Edges that lead no further are told apart first: ways through the middle, loops, ends alone and two groups."""
    draw = random.Random(1)
    inner = {(f"n{draw.randrange(8)}", f"n{draw.randrange(8)}") for _ in range(14)}
    outer = {(f"s{i}", f"t{draw.randrange(9)}") for i in range(30)} | {(f"s{i}", f"n{i % 8}") for i in range(5)} | {(f"n{i}", "t0") for i in range(3)} | {("l", "l")}
    edges = spark.createDataFrame([(g, a, b) for g in "xy" for a, b in sorted(inner | outer)], "g string, source string, target string")
    edges = storage.stored(edges)
    for most in (None, 2):
        whole = fixpoint.depths(edges, ("g",), most, 10**3)
        own = fixpoint.depths(edges, ("g",), most, 0, unique=True, split_over=3)
        assert sorted(own.select(whole.columns).collect()) == sorted(whole.collect()) != []
    whole = fixpoint.strong_components(edges, ("g",), split_over=10**6)
    assert sorted(fixpoint.strong_components(edges, ("g",), unique=True, split_over=3).select(whole.columns).collect()) == sorted(whole.collect()) != []


def test_edges_that_lead_no_further_are_not_shuffled_each_round(spark, monkeypatch):
    made = []
    own = fixpoint.checkpointed
    monkeypatch.setattr(fixpoint, "checkpointed", lambda df: made.append(own(df)) or made[-1])
    edges = storage.stored(spark.range(200).select(F.concat(F.lit("s"), "id").alias("source"), F.concat(F.lit("t"), F.col("id") % 7).alias("target")))
    found = fixpoint.depths(edges, in_one_task=0, unique=True, split_over=10)
    assert found.count() == 200 and max(df.count() for df in made) < 200


def test_hub_pages_beside_short_lists(spark):
    """Keys with more rows than a page fall into pages; the others' lists are gathered once for all indexes."""
    rows = spark.range(40).select(F.lit("s").alias("solution_key"), F.lit("document").alias("scope"), F.concat(F.lit("a"), F.least(F.col("id") % 9, F.lit(4)).cast("string")).alias("source"), F.concat(F.lit("b"), (F.col("id") % 20).cast("string")).alias("target"), F.when(F.col("id") % 2 == 0, "http").otherwise("persistence").alias("category"), F.col("id").alias("ordinal"))
    for key, own in (("source", {"outgoing": None, "runtime": ("http",)}), ("target", {"incoming": None, "persistence": ("persistence",)})):
        named = [(rows if only is None else rows.where(F.col("category").isin(*only))).select("solution_key", F.lit(name).alias("index"), F.col(key).alias("key"), "ordinal", "category") for name, only in own.items()]
        want = index.inverted_pages(named[0].unionByName(named[1]), ["solution_key", "index", "key"], page=3)
        found = package._edge_pages(rows, key, own, page=3)
        assert sorted(map(str, decoded_rows(found))) == sorted(map(str, decoded_rows(want)))


def decoded_rows(pages):
    return [(r["index"], r["key"], r["page"], r["first"], r["gaps"], r["categories"]) for r in pages.collect()]
