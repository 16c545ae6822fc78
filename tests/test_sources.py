"""File sources and lexical extraction on a small tree made here."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import lift, retain
from ledgerline.sources import facts, lexical, projects

FILES = {
    "S.slnx": '<Solution><Project Path="A/A.csproj" /><Folder Name="/x/"><Project Path="B\\B.csproj" /></Folder><Project Path="A.Tests/A.Tests.csproj" /></Solution>',
    "S2.sln": 'Project("{FAE04EC0}") = "A", "A\\A.csproj", "{1}"\nEndProject\nProject("{2}") = "docs", "docs", "{3}"\n',
    "A/A.csproj": '\ufeff<?xml version="1.0"?>\n<Project Sdk="x" xmlns="http://m"><PropertyGroup><OutputType> Exe </OutputType><TargetFrameworks>net8.0; net9.0</TargetFrameworks></PropertyGroup><ItemGroup><ProjectReference Include="..\\B\\B.csproj" /></ItemGroup></Project>',
    "B/B.csproj": "<Project><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup></Project>",
    "A.Tests/A.Tests.csproj": '<Project><ItemGroup><ProjectReference Include="../A/A.csproj" /></ItemGroup></Project>',
    "A/Orders.cs": """// comment GetAsync("no")
public class OrdersController : Base<int> {
  [HttpGet]
  public async Task<int> List(int a) {
    var x = client.GetAsync("/stock"); client.PostAsync(url); bus.Publish<OrderPlaced>(m); bus.Publish(z);
    Reserve(1); var c = cfg.GetSection("Db"); return 1; }
}
public abstract class Base<T> : ControllerBase { }
""",
    "B/Stock.cs": "public class Stock { public void Reserve(int n) { } public DbSet<Item> Items { get; set; } }\npublic record Item(int Id);",
    "B/obj/x.cs": "class Z {}", "B/tests/T.cs": "class T {}", "B/readme.md": "x", "A/appsettings.json": "{}",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


def short(df, root, *columns):
    return sorted(tuple(r[c].removeprefix(root + "/") if isinstance(r[c], str) else r[c] for c in columns) for r in df.collect())


def test_solutions_name_their_projects(spark, root):
    found = projects.declared_projects(projects.texts(spark, [f"{root}/S.slnx", f"{root}/S2.sln"]))
    assert short(found, root, "solution", "project") == [("S.slnx", "A.Tests/A.Tests.csproj"), ("S.slnx", "A/A.csproj"), ("S.slnx", "B/B.csproj"), ("S2.sln", "A/A.csproj")]
    assert projects.common_folder(found.where("project not like '%Tests%'"), "project").first()["root"] == root
    assert projects.common_folder(found.where("solution like '%S2.sln'"), "project").first()["root"] == f"{root}/A"


def test_project_files(spark, root):
    files = projects.texts(spark, [f"{root}/{p}" for p in FILES if p.endswith(".csproj")])
    assert short(projects.project_references(files), root, "project", "target") == [("A.Tests/A.Tests.csproj", "A/A.csproj"), ("A/A.csproj", "B/B.csproj")]
    got = {r["project"].removeprefix(root + "/"): (r["output_type"], r["frameworks"]) for r in projects.project_facts(files).collect()}
    assert got == {"A/A.csproj": ("Exe", ["net8.0", "net9.0"]), "B/B.csproj": (None, ["net8.0"]), "A.Tests/A.Tests.csproj": (None, [])}
    plan = projects.variant_plan(projects.project_facts(files))
    assert short(plan, root, "project", "tfm", "problem") == sorted([("A.Tests/A.Tests.csproj", None, "missing-tfm"), ("A/A.csproj", "net8.0", None), ("A/A.csproj", "net9.0", None), ("B/B.csproj", "net8.0", None)])


def test_identities_of_references(spark, root):
    files = projects.texts(spark, [f"{root}/A/A.csproj", f"{root}/A.Tests/A.Tests.csproj"])
    got = projects.reference_identities(projects.project_references(files), projects.project_facts(files), F.lit("s"))
    assert short(got, root, "project", "target", "frameworks", "is_known") == [("A.Tests/A.Tests.csproj", "A/A.csproj", ["net8.0", "net9.0"], True), ("A/A.csproj", "B/B.csproj", [], False)]
    assert {r["key"] for r in got.collect()} == {f"project:s:{root}/{p}/{p}.csproj" for p in "AB"}


def test_excluded_folders_are_not_listed(spark, root):
    assert [p.removeprefix("file:").removeprefix(root) for p in projects.open_folders(spark, root)] == ["", "/A", "/A.Tests", "/B", "/B/tests"]


def test_inventory_admits_and_digests(spark, root):
    import hashlib

    got = {r["relative_path"]: (r["kind"], r["admitted"], r["content_digest"]) for r in projects.inventory(spark, root).collect()}
    assert "B/obj/x.cs" not in got
    assert got["A/Orders.cs"] == ("CSharpSource", True, hashlib.sha256(FILES["A/Orders.cs"].encode()).hexdigest())
    assert got["A/appsettings.json"][:2] == ("Configuration", True)
    assert got["B/tests/T.cs"] == ("CSharpSource", False, None)
    assert got["B/readme.md"] == ("Unsupported", False, None)
    assert projects.inventory(spark, root, include_tests=True).where("relative_path = 'B/tests/T.cs' and admitted").count() == 1


@pytest.fixture(scope="module")
def graph(spark, root, tmp_path_factory):
    own = lambda c: F.replace(c, F.lit(root + "/"), F.lit(""))
    files = projects.texts(spark, [f"{root}/A/Orders.cs", f"{root}/B/Stock.cs"]).select(own("path").alias("relative_path"), "content")
    first = F.split_part("relative_path", F.lit("/"), F.lit(1))
    projs = projects.texts(spark, [f"{root}/A/A.csproj", f"{root}/B/B.csproj"])
    refs = projects.project_references(projs).select(own("project").alias("project"), own("target").alias("target"))
    made = lexical.extract(files.withColumn("project", F.concat(first, F.lit("/"), first, F.lit(".csproj"))), projects.project_facts(projs).withColumn("project", own("project")), refs, "solution:S:S.slnx")
    folder = str(tmp_path_factory.mktemp("facts"))
    facts.save(made, folder)
    return facts.load(spark, folder)


def test_lexical_extraction(graph):
    tail = lambda k: k.split(":", 4)[4]
    kinds = {(r["kind"], tail(r["key"])) for r in graph.entities.collect()}
    assert {("Component", "component:A/A.csproj:A/A.csproj"), ("DeploymentUnit", "deploymentunit:A/A.csproj:A/A.csproj"), ("EntryPoint", "entrypoint:A/A.csproj:A/Orders.cs#OrdersController.List"), ("BoundaryOperation", "boundaryoperation:A/A.csproj:A/Orders.cs#OrdersController.List"), ("Symbol", "symbol:B/B.csproj:Stock.Reserve")} <= kinds
    assert not any(k == "Component" and "B.csproj" in name for k, name in kinds)
    relations = {(r["category"], tail(r["target_key"])) for r in graph.relations.collect()}
    assert relations == {("http", "httpendpoint:A/A.csproj:/stock"), ("messaging", "messagechannel:A/A.csproj:OrderPlaced"), ("contract", "contract:A/A.csproj:OrderPlaced"), ("configuration", "configurationkey:A/A.csproj:section:Db"), ("internal-invocation", "symbol:B/B.csproj:Stock.Reserve"), ("persistence-object", "persistenceobject:B/B.csproj:Item"), ("project-reference", "project:B/B.csproj:B/B.csproj")}
    assert sorted((r["kind"], r["cause"]) for r in graph.gaps.collect()) == [("Candidate", "http-destination-unresolved"), ("Unknown", "messaging-payload-unresolved")]


def test_extracted_facts_lift(graph):
    got = {(r["scope"], r["category"]) for r in lift.dependencies_of(retain.retained(graph)).collect()}
    assert ("project", "project-reference") in got and ("document", "internal-invocation") in got


def test_tables_in_order(graph):
    entities, occurrences = facts.in_order(graph)
    assert (keys := [r["key"] for r in entities.collect()]) == sorted(keys)
    assert (own := [(r["entity_key"], r["project"]["key"], r["relative_path"], tuple(r["span"])) for r in occurrences.collect()]) == sorted(own)


def test_counts_of_fragments_add_up(graph):
    kept = retain.retained(graph)
    one = retain.retention_counts(graph, kept).first()
    both = retain.fragment_counts([(graph, kept), (graph, kept)]).first()
    assert (both["extracted"], both["filtered"]) == (2 * (one["retained"] + one["filtered"]), 2 * one["filtered"])


def test_fragments_merge_to_the_same_graph(graph):
    both = facts.merged([graph, graph])
    for name in ("entities", "evidence", "relations", "gaps", "sources"):
        assert getattr(both, name).count() == getattr(graph, name).count()
    assert both.occurrences.count() == 2 * graph.occurrences.count()


SHOP = {
    "Web/Pages.cs": """public class Pages : Controller {
  private readonly ShopDbContext ctx; private Greeter.GreeterClient greeter;
  public Pages(ShopDbContext c) { Warm(); }
  [Route("x")] public void Show() {
    /* Reserve(9); */ var s = "Reserve(8)"; ctx.Items.Add(1); ctx.SaveChanges();
    Reserve(
      2); Twice(); Console.WriteLine(1); Near();
    GreeterClient g = null; g.SayHello(1); var n = new Item(1);
  }
  private void Warm() { }
  int field = Reserve(3);
}
public class Plain { [HttpGet] public void Not() { } }
""",
    "Data/Shop.cs": """public class ShopDbContext : DbContext { public DbSet<Item> Items { get; set; } public void Near() => Far(); void Far() { } }
public class Item { public void Twice() { } }
public class GreeterClient : Grpc.Core.ClientBase<GreeterClient> { }
public class Other { public void Twice() { } public static int Reserve(int n) { return n; } }
""",
    "Far/Far.cs": "public class Away { public void Reserve(int n) { } public void Far() { } public void Warm() { } }",
}


def test_callers_places_and_open_names(spark):
    files = spark.createDataFrame([(f"{p.split('/')[0]}/P.csproj", p, t) for p, t in SHOP.items()], "project string, relative_path string, content string")
    projs = spark.createDataFrame([(f"{p}/P.csproj", None, []) for p in ("Web", "Data", "Far")], "project string, output_type string, frameworks array<string>")
    refs = spark.createDataFrame([("Web/P.csproj", "Data/P.csproj")], "project string, target string")
    made = lexical.extract(files, projs, refs, "solution:S:S.slnx")
    tail = lambda k: k.split(":", 4)[4]
    rows = {r["key"]: r for r in made.evidence.collect()}
    got = {(r["category"], tail(r["source_key"]), tail(r["target_key"])) for r in made.relations.collect()}
    web, data = "symbol:Web/P.csproj:Pages.Show", "Data/P.csproj"
    assert {x for x in got if x[0] != "structural-type-use"} == {
        ("internal-invocation", web, f"symbol:{data}:Other.Reserve"), ("internal-invocation", web, f"symbol:{data}:ShopDbContext.Near"), ("internal-invocation", "symbol:Web/P.csproj:Pages.Pages", "symbol:Web/P.csproj:Pages.Warm"),
        ("persistence-store", web, "persistencestore:Web/P.csproj:DbSet<Item>"), ("persistence-operation", web, "persistencestore:Web/P.csproj:DbSet<Item>#Add"), ("persistence-object", web, "persistenceobject:Web/P.csproj:Item"),
        ("persistence-store", web, "persistencestore:Web/P.csproj:ShopDbContext"), ("persistence-operation", web, "persistencestore:Web/P.csproj:ShopDbContext#SaveChanges"),
        ("grpc", web, "grpcservice:Web/P.csproj:GreeterClient"), ("persistence-object", f"symbol:{data}:ShopDbContext", f"persistenceobject:{data}:Item"), ("project-reference", "project:Web/P.csproj:Web/P.csproj", f"project:{data}:{data}"),
    }
    assert ("structural-type-use", web, f"symbol:{data}:Item") in got and not any(s.endswith("ShopDbContext") and c == "structural-type-use" for c, s, _ in got)
    # Twice is declared twice; Far is seen in a project alone that isn't referred to, as a method without an access word isn't found.
    assert sorted((r["kind"], r["cause"], tail(r["affected_keys"][0])) for r in made.gaps.collect()) == [("Unknown", "unresolved-invocation", f"symbol:{data}:ShopDbContext.Near"), ("Unknown", "unresolved-invocation", web)]
    spans = {tail(r["target_key"]): rows[r["evidence_keys"][0]] for r in made.relations.where("category = 'internal-invocation'").collect()}
    found = spans[f"symbol:{data}:Other.Reserve"]
    assert tuple(found["span"]) == (6, 5, 7, 9)
    assert found["content_digest"] == __import__("hashlib").sha256(b"Reserve( 2)").hexdigest()
    kinds = {(r["kind"], tail(r["key"])) for r in made.entities.where("kind in ('EntryPoint', 'Solution')").collect()}
    assert kinds == {("EntryPoint", "entrypoint:Web/P.csproj:Web/Pages.cs#Pages.Show"), ("Solution", "solution:solution:S:S.slnx")}
    assert retain.shape_conflicts(made.occurrences).isEmpty()


def test_a_large_file_is_scanned_in_linear_time():
    import time

    method = "  [HttpGet] public string Show{k}(Item item) {{\n    /* note {k} */ var x = client.GetAsync(\"/a/{k}\"); Show{j}(new Item(1)); cfg.GetValue(\"k\"); return x;\n  }}\n"
    body = "".join(method.format(k=k, j=k + 1) for k in range(22_000))
    source = f"public class Big : ControllerBase {{\n{body}}}\n"
    assert len(source) > 3_000_000
    began = time.process_time()
    found = list(lexical.scan(source))
    spent = time.process_time() - began
    small = f"public class Big : ControllerBase {{\n{''.join(method.format(k=k, j=k + 1) for k in range(2_200))}}}\n"
    began = time.process_time()
    few = list(lexical.scan(small))
    assert spent < 40 * max(time.process_time() - began, 0.05)
    calls = [x for x in found if x["kind"] == "call"]
    assert len(calls) == 10 * len([x for x in few if x["kind"] == "call"]) == 3 * 22_000
    assert all(x["owner_type"] == "Big" for x in calls) and [x["owner_method"] for x in calls[::3]] == [f"Show{k}" for k in range(22_000)]


def test_a_type_that_several_projects_declare_is_the_referred_ones(spark):
    uses = "public class A { public void Go() { Twin t = null; Lone l = null; Far f = null; } }"
    files = spark.createDataFrame([("A/P", "A/a.cs", uses), ("C/P", "C/c.cs", uses.replace("class A", "class C")), ("B1/P", "B1/b.cs", "public class Twin { } public class Lone { }"), ("B2/P", "B2/b.cs", "public class Twin { }"), ("D/P", "D/d.cs", "public class Far { }")], "project string, relative_path string, content string")
    projs = spark.createDataFrame([(p, None, []) for p in ("A/P", "B1/P", "B2/P", "C/P", "D/P")], "project string, output_type string, frameworks array<string>")
    refs = spark.createDataFrame([("A/P", "B1/P"), ("C/P", "B1/P"), ("C/P", "B2/P")], "project string, target string")
    made = lexical.extract(files, projs, refs, "S")
    got = {(r["source_key"][len("entity:S:symbol:") :], r["target_key"][len("entity:S:symbol:") :]) for r in made.relations.where("category = 'structural-type-use'").collect()}
    assert got == {("A/P:A.Go", "B1/P:Twin"), ("A/P:A.Go", "B1/P:Lone"), ("C/P:C.Go", "B1/P:Lone")}
    assert [(r["cause"], r["affected_keys"]) for r in made.gaps.collect()] == [("unresolved-type-use", ["entity:S:symbol:C/P:C.Go"])]


def test_the_innermost_block_and_the_nearest_declaration():
    scopes = lexical._Scopes([(0, 100, "a"), (10, 50, "b"), (20, 30, "c"), (60, 60, "none"), (70, 120, "d")])
    assert [scopes.at(x) for x in (0, 9, 10, 19, 20, 29, 30, 49, 50, 60, 70, 99, 100, 119, 120)] == ["a", "a", "b", "b", "c", "c", "b", "b", "a", "a", "d", "d", "d", "d", None]
    declared = lexical._Declared([(5, "x", "A"), (20, "x", "B"), (30, "y", "C")])
    assert [declared.at("x", p) for p in (1, 5, 19, 20, 99)] == ["A", "A", "A", "B", "B"] and declared.at("y", 1) == "C" and declared.at("z", 1) is None
    assert lexical._is_made("var x = new  Item(1)", 13) and not lexical._is_made("renew Item(1)", 6) and lexical._is_made("new A()", 4)
