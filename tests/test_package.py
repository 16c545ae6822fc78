"""Publishing, reading back, corruption, budgets and the command line."""

import hashlib
import json
import posixpath
import re
import shutil
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_operators import graph  # noqa: F401

from ledgerline.functions import identity, predicates
from ledgerline.model import ENTITIES, EVIDENCE, GAPS, OCCURRENCES, RELATIONS, SOURCES, FactualGraph
from ledgerline.operators import index
from ledgerline.plans import engine, package
from ledgerline.sources import facts


@pytest.fixture(scope="module")
def published(spark, graph, tmp_path_factory):  # noqa: F811
    base = tmp_path_factory.mktemp("package")
    model = package.build_model(graph)
    digest = package.publish(spark, model, str(base / "p"), ["s"])
    return model, base / "p", digest


def test_package_reads_back_and_validates(spark, published):
    model, folder, digest = published
    pointer = json.loads((folder / "manifest.json").read_text())
    assert pointer["generation"] == digest
    rows = package.read(spark, str(folder))
    assert package.first_failure(rows, model) is None
    assert not (folder / ".lock").exists()
    assert {r["family"] for r in rows.select("family").distinct().collect()} == {"Dependencies", "Evidence", "Graph", "Index", "Manifest", "Markdown", "Measures", "Table"}
    assert rows.where(F.col("path").endswith(".json") & (F.col("bytes") > 96 * 1024)).isEmpty()


def test_everything_comes_back_as_it_was(spark, published):
    model, folder, _ = published
    rows = package.read(spark, str(folder))
    for made, held in ((model.dependencies, package.dependencies_of(rows)), (model.members, package.cited_of(rows)), (model.measures, package.measures_of(rows)), (model.impact, package.impact_of(rows)), (model.graph.relations, package.relations_of(rows))):
        got = held.select(*made.columns).collect()
        assert got and sorted(map(str, got)) == sorted(map(str, made.collect()))
    with pytest.raises(Exception, match="unknown property"):
        package.records_of(rows, "dependencies", "ordinal bigint").collect()


def hub(spark, targets=700, calls=4):
    """One component whose two methods call ``targets`` others several times, each proven on its own: lists far over a shard's bytes."""
    v, span = ("net", "Debug", [], "x"), (1, 1, 1, 2)
    project = ("project:s:a.csproj", "a.csproj")
    names = ["root", "caller", *[f"t{i}" for i in range(targets)]]
    kinds = {"root": "Component"}
    entities = spark.createDataFrame([("s", n, kinds.get(n, "Symbol"), n, None) for n in names], ENTITIES)
    occurrences = spark.createDataFrame([("s", n, project, v, f"{n}.cs", span, n, []) for n in names], OCCURRENCES)
    pairs = [(f"r{i:05d}", f"t{i % targets}", f"e{i:05d}-{'x' * 60}") for i in range(targets * calls)]
    evidence = spark.createDataFrame([("s", e, "document:s:caller.cs", v, span, e) for _, _, e in pairs], EVIDENCE)
    relations = spark.createDataFrame([("s", r, "caller", t, "http", [e]) for r, t, e in pairs], RELATIONS)
    sources = spark.createDataFrame([("s", f"document:s:{n}.cs", f"{n}.cs", False, n) for n in names], SOURCES)
    return FactualGraph(entities, occurrences, evidence, relations, spark.createDataFrame([], GAPS), sources)


def test_a_hub_is_published_in_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(package, "JOURNEYS", {j: (10**6, 10**9) for j in package.JOURNEYS})
    model = package.build_model(hub(spark))
    component = model.dependencies.where("scope = 'component'").first()
    assert component["relation_count"] == component["evidence_count"] == 2800
    package.publish(spark, model, str(tmp_path / "p"))
    rows = package.read(spark, str(tmp_path / "p"))
    assert package.first_failure(rows, model) is None
    pages = package.records_of(rows, "dependencies/pages", package.CITED).where(F.col("ordinal") == component["ordinal"]).collect()
    assert sorted((r["part"], r["page"], len(r["gaps"]) + 1) for r in pages) == [(p, k, min(1024, 2800 - 1024 * k)) for p in ("evidence", "relation") for k in range(3)]
    assert rows.where(F.col("path").endswith(".json") & (F.col("bytes") > 96 * 1024)).isEmpty()
    assert package.locate(rows, "outgoing", "document:s:caller.cs").count() == 1
    # Evidence is found by its place, in the shard that the index routes to.
    keys = [r["key"] for r in model.graph.evidence.orderBy("key").collect()]
    asked = spark.createDataFrame([("s", i) for i in range(0, 2800, 199)], "solution_key string, ordinal long")
    found = {r["ordinal"]: r["shard"] for r in package.evidence_shards(rows, asked).collect()}
    assert len(found) == 15 and len(set(found.values())) > 5
    for i, path in found.items():
        assert keys[i] in {r["key"] for r in json.loads(package.read_artifact(rows, path))}


def test_an_id_is_found_in_one_shard(spark):
    """Of many keys of one solution and three of another; an id of neither leads nowhere."""
    keys = spark.createDataFrame([("big", f"k{i}", str(i), i, "entities") for i in range(1500)] + [("small", f"k{i}", str(i), i, "entities") for i in range(3)], "solution_key string, key string, handle string, ordinal long, table string")
    shards = package._identity_shards(keys)
    rows = package.described(shards.unionByName(package.manifests(FactualGraph(keys, *[None] * 5), shards)))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    sizes = [r["bytes"] for r in rows.where(F.col("path").startswith("indexes/identity/")).collect()]
    assert len(sizes) == 9 and max(sizes) < 40_000
    ids = {tuple(r) for r in keys.select("solution_key", package.solution_id(F.col("solution_key")), "key", identity.public_id("ent", F.col("key"))).where("key in ('k0', 'k2', 'k777', 'k1499')").collect()}
    assert len(ids) == 6
    for _, solution, key, public in ids:
        assert package.locate_identity(rows, solution, public)["key"] == key
        assert package.locate_identity(rows, solution, "ent_0000000000000000") is None


def test_lists_that_are_cut_are_found(spark, published):
    model, folder, _ = published
    rows = package.read(spark, str(folder))
    first = F.col("path").startswith("dependencies/pages/")
    cut = rows.withColumn("payload", F.when(first, F.regexp_replace("payload", '"gaps":\\[[0-9,]+\\]', '"gaps":[]')).otherwise(F.col("payload")))
    same = cut.where(first).select("payload").exceptAll(rows.where(first).select("payload")).isEmpty()
    failure = package.first_failure(cut.withColumn("digest", F.sha2("payload", 256)), model)
    assert same or failure.code == "short-list"
    other = rows.withColumn("payload", F.when(first, F.regexp_replace("payload", '"first":0', '"first":1')).otherwise(F.col("payload")))
    assert package.first_failure(other.withColumn("digest", F.sha2("payload", 256)), model).code == "dependency-mismatch"


def test_an_index_leads_to_the_dependency(spark, published):
    model, folder, _ = published
    (entry,) = package.locate(package.read(spark, str(folder)), "outgoing", "c1").collect()
    assert [r["target"] for r in model.dependencies.where(F.col("ordinal").isin(entry["ordinals"])).collect()] == ["c2"]
    assert entry["categories"] == ["internal-invocation"]


def test_pages_link_only_to_pages(spark, published):
    _, folder, _ = published
    rows = package.read(spark, str(folder)).where("family = 'Markdown'").collect()
    pages = {r["path"] for r in rows}
    links = {posixpath.normpath(posixpath.join(posixpath.dirname(r["path"]), x)) for r in rows for x in re.findall(r"\]\(([^)]*)\)", r["payload"])}
    assert links and links <= pages


def test_certification(spark, published):
    _, folder, digest = published
    got = {r["journey"]: (r["status"], r["reason"], r["reads"]) for r in spark.read.parquet(str(folder / "generations" / digest / "certification")).collect()}
    assert got == {"locate": ("Certified", None, 3), "evidence": ("Certified", None, 3), "reverse-impact": ("Certified", None, 3), "follow-flow": ("NotApplicable", "no-causal-root", 3)}


#: Categories of the dependencies, what is done to the indexes, and what follows for a flow and for an impact.
WALKS = [
    (["structural-type-use"], None, ("NotApplicable", "no-causal-root"), ("NotApplicable", "no-impact-root")),
    (["persistence"], None, ("NotApplicable", "no-causal-root"), ("Certified", None)),
    (["http"], None, ("NotApplicable", "absent-terminal:contracts,persistence"), ("Certified", None)),
    (["contract", "persistence"], None, ("NotApplicable", "absent-terminal:external-effects"), ("Certified", None)),
    (["http", "contract", "persistence"], None, ("Certified", None), ("Certified", None)),
    (["http", "contract"], "contracts", ("Failed", "missing-terminal:contracts"), ("Certified", None)),
    (["http", "contract", "persistence"], "persistence", ("Failed", "missing-terminal:persistence"), ("Certified", None)),
    (["http", "contract", "persistence"], "measures", ("Certified", None), ("Failed", "missing-terminal:reachable-set")),
]


def test_walks_through_the_graph(spark, graph):  # noqa: F811
    """Each case is a solution of its own."""
    rows = [(f"s{k}", "component", "c1", f"t{i}", c, "direct", 1, [], 0, 0) for k, (categories, *_) in enumerate(WALKS) for i, c in enumerate(categories)]
    every = F.explode(F.array(*[F.lit(f"s{k}") for k in range(len(WALKS))]))
    graph = replace(graph, **{name: df.withColumn("solution_key", every) for name, df in graph.tables().items()})
    dependencies = index.ordinals(spark.createDataFrame(rows, "solution_key string, scope string, source string, target string, category string, nature string, occurrence_count bigint, variants array<string>, relation_count long, evidence_count long"), ["solution_key"], ["target"])
    nothing = spark.createDataFrame([], "solution_key string, ordinal long, part string, key string")
    stored = package.artifacts(package.measured(graph, dependencies, nothing))
    for k, (_, broken, _, _) in enumerate(WALKS):
        lost = F.replace("payload", F.lit("reachable"), F.lit("other")) if broken == "measures" else F.regexp_replace("payload", r'"first":\d+', '"first":null')
        stored = stored.withColumn("payload", F.when((F.col("solution_key") == f"s{k}") & F.col("path").startswith(f"indexes/{broken}/"), lost).otherwise(F.col("payload")))
    got = {(r["solution_key"], r["journey"]): (r["status"], r["reason"]) for r in package.certify(stored).collect()}
    for k, (_, _, flow, impact) in enumerate(WALKS):
        assert (got[f"s{k}", "follow-flow"], got[f"s{k}", "reverse-impact"]) == (flow, impact), WALKS[k]


def test_budgets_of_journeys_name_what_is_exceeded(spark, published, monkeypatch):
    _, folder, _ = published
    rows = package.read(spark, str(folder))
    monkeypatch.setattr(package, "JOURNEYS", {"locate": (2, 10**6), "follow-flow": (32, 1), "reverse-impact": (32, 1), "evidence": (12, 25_000)})
    got = {r["journey"]: (r["status"], (r["reason"] or "").partition(":")[0]) for r in package.certify(rows).collect()}
    assert got["locate"] == ("Failed", "reads-exceeded") and got["reverse-impact"] == ("Failed", "tokens-exceeded") and got["evidence"] == ("Certified", "")


def test_exactly_one_index_of_each_kind(spark, published):
    _, folder, _ = published
    rows = package.read(spark, str(folder))
    manifest = F.col("family") == "Manifest"
    with pytest.raises(Exception, match="not-exactly-one-index"):
        package.entry_of(rows.withColumn("payload", F.when(manifest, F.replace("payload", F.lit("indexes/runtime"), F.lit("indexes/other"))).otherwise(F.col("payload")))).collect()
    with pytest.raises(Exception, match="not-exactly-one-index"):
        package.entry_of(rows.unionByName(package.main_manifests(rows))).collect()


def test_what_the_manifest_declares_is_read(spark, published):
    _, folder, _ = published
    rows = package.read(spark, str(folder))
    told = {r["path"] for r in package.read_declared(rows).collect()}
    assert told == {r["path"] for r in rows.where("path like '%.json' and family != 'Manifest'").collect()}
    with pytest.raises(Exception, match="artifact-missing"):
        package.read_declared(rows.where("path not like 'evidence/%'")).collect()
    with pytest.raises(package.PackageError, match="unsafe-path"):
        package.read_artifact(rows, "tables/../secret")


def test_totals_and_digest(spark):
    rows = spark.createDataFrame([(f"{f}/sol_{'0' * 15}{k}/{i}.json", f, "d", 3) for f in "ab" for k in range(2) for i in range(5)], "path string, family string, digest string, bytes long")
    assert sorted(map(tuple, package.totals(rows).collect())) == [("a", 10, 30), ("b", 10, 30), ("total", 20, 60)]
    assert sorted(map(tuple, package.solution_totals(rows).collect())) == [(f"sol_{'0' * 15}{k}", 10, 30) for k in range(2)]
    lines = [f"{r['path']}:{r['digest']}" for r in rows.orderBy("path").collect()]

    def sha(x):
        return hashlib.sha256("\n".join(x).encode()).hexdigest()

    assert tuple(package.digest_rows(rows).first()) == (sha(lines), 20)
    runs = [f"{i}:{sha(lines[i * 6 : i * 6 + 6])}" for i in range(4)]
    assert package.digest_rows(rows, 6).first()[0] == sha(runs)


def test_publishing_again_keeps_the_generation(spark, published, monkeypatch):
    model, folder, digest = published
    before = sorted(p.name for p in (folder / "generations" / digest / "artifacts").iterdir())
    # The lock of a writer that was killed is taken over.
    lock = folder / ".lock"
    lock.write_text("{}")
    monkeypatch.setattr(package._locked, "__defaults__", (0,))
    assert package.publish(spark, model, str(folder), ["s"]) == digest
    assert not lock.exists()
    assert sorted(p.name for p in (folder / "generations" / digest / "artifacts").iterdir()) == before
    assert package.read(spark, str(folder / "generations" / digest)).count() == package.read(spark, str(folder)).count()


def test_names_of_fields_are_snake_case(spark, published):
    _, folder, _ = published
    for r in package.read(spark, str(folder)).where("path like '%.json'").collect():
        waiting = [json.loads(r["payload"])]
        while waiting:
            x = waiting.pop()
            waiting += x if isinstance(x, list) else x.values() if isinstance(x, dict) else []
            assert not isinstance(x, dict) or all(re.fullmatch("[a-z][a-z0-9_]*", k) for k in x)
        assert "\r" not in r["payload"] and (r["family"] != "Manifest" or "\n  " in r["payload"])


def test_a_folder_holds_one_solution(spark, graph, tmp_path):  # noqa: F811
    facts.save(replace(graph, entities=graph.entities.unionByName(graph.entities.withColumn("solution_key", F.lit("other")))), str(tmp_path / "facts"))
    assert [d.code for d in engine.analyze(spark, [str(tmp_path / "facts")], str(tmp_path / "out")).diagnostics] == ["not-one-solution"]


def test_links_go_up_and_down(spark):
    cases = {("pages/a.md", "pages/b.md"): "b.md", ("summary/a.md", "pages/b.md"): "../pages/b.md", ("a/b/c/d.md", "a/x/y.md"): "../../x/y.md", ("a.md", "pages/b.md"): "pages/b.md", ("x/y.md", "b.md"): "../b.md"}
    df = spark.createDataFrame(list(cases), "page string, target string")
    assert [r[0] for r in df.select(predicates.relative_link(F.col("page"), F.col("target"))).collect()] == list(cases.values())


@pytest.mark.parametrize("change,code", [("digest", "digest-mismatch"), ("payload", "digest-mismatch"), ("path", "shard-gap"), ("records", "record-count"), ("index", "index-mismatch"), ("page", "page-mismatch"), ("order", "table-order"), ("drive", "unsafe-path")])
def test_corruption_is_found(spark, published, change, code):
    model, folder, _ = published
    rows = package.read(spark, str(folder))
    first = rows.where("path like 'dependencies/rows/%'").first()["path"]
    at = F.col("path") == first

    def changed(where, payload):
        return rows.withColumn("payload", F.when(where, payload).otherwise(F.col("payload"))).withColumn("digest", F.sha2("payload", 256))

    broken = {
        "digest": rows.withColumn("digest", F.when(at, F.lit("0")).otherwise(F.col("digest"))),
        "payload": rows.withColumn("payload", F.when(at, F.lit("[]")).otherwise(F.col("payload"))),
        "path": rows.withColumn("path", F.when(at, F.replace("path", F.lit("000000"), F.lit("000007"))).otherwise(F.col("path"))),
        "records": rows.withColumn("records", F.when(at, F.lit(99)).otherwise(F.col("records"))),
        "index": changed(F.col("path").startswith("indexes/outgoing/"), F.replace("payload", F.lit('"first":0'), F.lit('"first":5'))),
        "page": changed(F.col("path").startswith("pages/"), F.concat("payload", F.lit("x"))),
        "order": changed(F.col("path").startswith("tables/entities/"), F.to_json(F.reverse(F.from_json("payload", "array<struct<handle:string,key:string>>")))),
        "drive": changed(at, F.concat("payload", F.lit(" "))).withColumn("payload", F.when(at, F.concat("payload", F.lit("C:/x"))).otherwise(F.col("payload"))).withColumn("digest", F.sha2("payload", 256)),
    }[change]
    failure = package.first_failure(broken, model)
    assert failure is not None and failure.code == code


def test_changed_content_is_refused_on_opening(spark, published, tmp_path):
    _, folder, digest = published
    copy = tmp_path / "copy"
    shutil.copytree(folder, copy)
    artifacts = copy / "generations" / digest / "artifacts"
    spark.read.parquet(str(artifacts)).withColumn("payload", F.concat("payload", F.lit(" "))).write.parquet(str(copy / "new"))
    shutil.rmtree(artifacts)
    (copy / "new").rename(artifacts)
    assert [d.code for d in engine.validate(spark, str(copy)).diagnostics] == ["digest-mismatch"]


def test_a_package_of_files(spark, published, tmp_path, monkeypatch):
    model, stored, digest = published
    # The artifacts are those that were published; what they say of the model was compared there.
    checks = package.first_failure
    monkeypatch.setattr(package, "artifacts", lambda _: package.read(spark, str(stored)))
    monkeypatch.setattr(package, "first_failure", lambda rows, _=None: checks(rows))
    folder = tmp_path / "files"
    (folder / "staging-stopped" / "artifacts").mkdir(parents=True)
    assert package.publish(spark, model, str(folder), ["s"], "files") == digest
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == ["generations", "manifest.json"]
    rows, kept = package.read(spark, str(folder)), package.read(spark, str(stored))
    assert sorted(map(str, rows.collect())) == sorted(map(str, kept.select(rows.columns).collect()))
    assert engine.validate(spark, str(folder)).digest == engine.validate(spark, str(folder / "generations" / digest)).digest == digest
    artifacts = folder / "generations" / digest / "artifacts"
    page = kept.where("family = 'Markdown'").first()
    assert (artifacts / page["path"]).read_text() == page["payload"] == package.read_one(spark, str(folder), page["path"]) == package.read_one(spark, str(stored), page["path"])
    told = [json.loads(p.read_text()) for p in (folder / "generations" / digest / "certified" / "certification").glob("*.json")]
    assert [sorted(j["journey"] for j in t) for t in told] == [sorted(package.JOURNEYS)]
    with pytest.raises(package.PackageError, match="artifact-missing"):
        package.read_one(spark, str(folder), "solutions/none.json")
    with pytest.raises(package.PackageError, match="unsafe-path"):
        package.read_one(spark, str(folder), "../manifest.json")
    # Publishing again would keep what is there; other content is found, by the file and by the package.
    assert package._has_digest(spark, str(folder / "generations" / digest), digest, "files")
    assert not package._has_digest(spark, str(folder / "generations" / digest), digest, "parquet")
    (artifacts / page["path"]).write_text(page["payload"] + " ")
    with pytest.raises(package.PackageError, match="digest-mismatch"):
        package.read_one(spark, str(folder), page["path"])
    assert [d.code for d in engine.validate(spark, str(folder)).diagnostics] == ["digest-mismatch"]


def test_a_lock_keeps_other_writers_out(spark, published):
    model, folder, digest = published
    (folder / ".lock").touch()
    try:
        with pytest.raises(package.PackageError, match="package-locked"):
            package.publish(spark, model, str(folder))
    finally:
        (folder / ".lock").unlink(missing_ok=True)
        (folder / "..lock.crc").unlink(missing_ok=True)
    assert json.loads((folder / "manifest.json").read_text())["generation"] == digest


def test_budgets():
    assert package.budget(["x"]) == (1500, 96 << 20, ["default"])
    assert package.budget(["my-eShop", "Pitstop"]) == (750, 25 << 20, ["eshop", "pitstop"])


def test_budget_gate(spark, published, monkeypatch):
    _, folder, _ = published
    monkeypatch.setattr(package, "DEFAULT_CEILING", (3, 1 << 20))
    with pytest.raises(package.PackageError, match="package-budget-exceeded"):
        package.check_budget(package.read(spark, str(folder)), ["x"])


def test_command_line(spark, graph, tmp_path, capsys):  # noqa: F811
    facts.save(graph, str(tmp_path / "facts"))
    assert engine.main(["analyze", "--facts", str(tmp_path / "facts"), "--output", str(tmp_path / "out")]) == engine.OK
    digest = capsys.readouterr().out.strip()
    assert engine.main(["validate", "--package", str(tmp_path / "out")]) == engine.OK
    assert capsys.readouterr().out.strip() == digest
    assert engine.main(["validate", "--package", str(tmp_path / "nothing")]) == engine.INVALID
    assert capsys.readouterr().err.startswith("code=pointer-missing stage=open cause=")
    assert engine.main(["analyze", "--facts", "a", "--facts", "a", "--output", "x"]) == engine.REJECTED
    assert engine.main(["unknown"]) == engine.USAGE
    assert engine.main(["analyze", "--facts", "a", "--solution", "b", "--output", "x"]) == engine.USAGE
    assert [engine._name_of(k) for k in ("solution:Shop:pitstop/Shop.sln", "plain")] == ["Shop", "plain"]


def test_the_form_is_an_argument(spark, graph, tmp_path, capsys, monkeypatch):  # noqa: F811
    facts.save(graph, str(tmp_path / "facts"))
    monkeypatch.setattr(package, "build_model", lambda *_: None)
    monkeypatch.setattr(package, "publish", lambda _spark, _model, _folder, _names, form: form)
    for given, form in ((["--form", "files"], "files"), ([], "parquet")):
        assert engine.main(["analyze", "--facts", str(tmp_path / "facts"), "--output", "x", *given]) == engine.OK
        assert capsys.readouterr().out.strip() == form
    assert engine.main(["analyze", "--facts", "a", "--output", "x", "--form", "other"]) == engine.USAGE


TREE = {
    "Shop.slnx": '<Solution><Project Path="Web/Web.csproj" /><Project Path="Data/Data.csproj" /></Solution>',
    "Web/Web.csproj": '<Project><PropertyGroup><OutputType>Exe</OutputType><TargetFramework>net8.0</TargetFramework></PropertyGroup><ItemGroup><ProjectReference Include="..\\Data\\Data.csproj" /></ItemGroup></Project>',
    "Data/Data.csproj": "<Project><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup></Project>",
    "Web/Pages/Home.cs": "public class Home : ControllerBase { [HttpGet] public void Show() { Save(1); client.GetAsync(\"/stock\"); } }",
    "Data/Store.cs": "public class Store { public void Save(int n) { } }",
    "Other/Lost.cs": "public class Lost { public void Gone() { Save(2); } }", "Web/obj/Made.cs": "public class Made { }",
}


def test_a_solution_is_analysed_from_its_files(spark, tmp_path, capsys):
    for name, text in TREE.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    solution = str(tmp_path / "in" / "Shop.slnx")
    assert engine.main(["analyze", "--solution", solution, "--output", str(tmp_path / "out")]) == engine.OK, capsys.readouterr().err
    rows = package.read(spark, str(tmp_path / "out"))
    got = {(r["scope"], r["source"].split(":", 3)[-1], r["target"].split(":", 3)[-1], r["category"]) for r in package.dependencies_of(rows).collect()}
    assert ("project", "Shop.slnx:Web/Web.csproj", "Shop.slnx:Data/Data.csproj", "internal-invocation") in got and ("project", "Shop.slnx:Web/Web.csproj", "Shop.slnx:Data/Data.csproj", "project-reference") in got
    documents = {s for scope, s, *_ in got if scope == "document"}
    assert "Shop.slnx:Web/Pages/Home.cs" in documents and not any("Lost" in d or "Made" in d for d in documents)
    assert engine.main(["analyze", "--solution", str(tmp_path / "none.sln"), "--output", str(tmp_path / "x")]) == engine.REJECTED
    assert capsys.readouterr().err.startswith("code=solution-unreadable stage=request")
