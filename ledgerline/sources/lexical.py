"""Lexical extraction of facts from C# text: an approximation by patterns, without a compiler's binding.

One pass per file finds declarations and calls with their places: line and column of both
ends, the type and the method around them (by matching braces), the declared type of a
call's receiver. All that follows is joins. What would need binding is not claimed: a call
is resolved where one method of its name is declared in its own project, else in one that the
project refers to; where names leave it open it becomes a gap, and so do calls that look
remote but name no target. A name that no source declares is taken as the framework's.

Input files: ``project`` (path), ``relative_path``, ``content``, and the project facts of
:mod:`ledgerline.sources.projects`.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import identity, predicates
from ledgerline.model import ENTITY_KINDS, SPAN, FactualGraph
from ledgerline.operators import fixpoint
from ledgerline.operators.retain import keep_first
from ledgerline.shipping import shipped

#: Names by which calls are told apart (fixed values).
MESSAGING = ("Publish", "PublishAsync", "Subscribe", "SubscribeAsync")
SECTIONS = ("GetSection",)
CONFIGURATION_KEYS = ("GetValue", "GetConnectionString", "Configure")
KEYWORDS = ("if", "for", "foreach", "while", "switch", "using", "lock", "catch", "return", "nameof", "typeof", "sizeof", "default", "new", "when", "base", "this")
BOOTSTRAP = "WebApplication.CreateBuilder("
CONTROLLERS = ("ControllerBase", "Controller")
GRPC_BASE = "ClientBase"
CONTEXT, SET = "DbContext", "DbSet<"
EXECUTABLES = ("Exe", "WinExe")
#: Stands for a file without a path.
UNKNOWN = "unknown.cs"

_COMMENT_OR_STRING = re.compile(r'//[^\n]*|/\*.*?\*/|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', re.DOTALL)
_TYPE = re.compile(r"\b(?:class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+([A-Za-z_]\w*)(?:<[^>{]*>)?(?:\s*\([^)]*\))?(?:\s*:\s*([^{;]+))?")
_METHOD = re.compile(r"((?:\[[^\]\n]*\]\s*)*)\b(public|private|protected|internal)((?:\s+(?:static|async|virtual|override|sealed|abstract|partial|new))*)\s+(?:[\w<>\[\],.?\s]+?\s)?([A-Za-z_]\w*)\s*\(([^)]*)\)\s*(?=\{|=>|;|:|where\b)")
_CALL = re.compile(r"(?:([A-Za-z_][\w.]*)\s*\.\s*)?\b([A-Za-z_]\w*)\s*(?:<\s*([\w.]+)[^>()]*>)?\s*\(")
_DECLARED = re.compile(r"\b([A-Z][\w.]*(?:\s*<[^<>;(){}]*>)?)\??\s+([A-Za-z_]\w*)\s*(?=[;=,){])")
_NAME = re.compile(r"\b[A-Z]\w+\b")
_BODY = re.compile(r"\{|=>|;")
_LITERAL = re.compile(r'\$?@?"((?:\\.|[^"\\])*)"')

ITEMS = f"project string, relative_path string, kind string, name string, owner_type string, owner_method string, place int, span {SPAN}, text string, bases array<string>, attributes string, is_public boolean, is_static boolean, receiver string, receiver_type string, type_argument string, literal string"


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def plain(source: str) -> tuple[str, str]:
    """The source with comments as blanks; and with the inside of literals as blanks too. Every sign keeps its place."""
    code = _COMMENT_OR_STRING.sub(lambda m: _blank(m[0]) if m[0][0] == "/" else m[0], source)
    return code, _COMMENT_OR_STRING.sub(lambda m: m[0][0] + _blank(m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0], code)


def _brackets(code: str) -> dict[int, int]:
    """Of each opening brace and bracket the place behind the one that closes it, in one pass; the end of the text where none does."""
    out, open_ = {}, {"{": [], "(": []}
    for m in re.finditer(r"[{}()]", code):
        if (own := open_.get(m[0])) is not None:
            own.append(m.start())
            out[m.start()] = len(code)
        elif own := open_["{" if m[0] == "}" else "("]:
            out[own.pop()] = m.end()
    return out


def _body(code: str, at: int, closed: dict[int, int]) -> tuple[int, int]:
    """From a declaration's head on: the block, or what an arrow gives, up to its end; empty for a head alone."""
    m = _BODY.search(code, at)
    if m is None or m[0] == ";":
        return at, at
    if m[0] == "{":
        return m.start(), closed[m.start()]
    end = code.find(";", m.end())
    return m.start(), len(code) if end < 0 else end


class _Scopes:
    """The innermost of some blocks at any place: places where it changes, found in one sweep over their ends."""

    def __init__(self, blocks: list[tuple[int, int, str]]):
        self.places, self.names = [-1], [None]
        starts, open_ = defaultdict(list), []
        for begin, end, name in blocks:
            if begin < end:
                starts[begin].append((end, name))
        for place in sorted({x for begin, end, _ in blocks if begin < end for x in (begin, end)}):
            for end, name in starts.get(place, ()):
                heapq.heappush(open_, (-place, end, name))
            while open_ and open_[0][1] <= place:
                heapq.heappop(open_)
            self.places.append(place)
            self.names.append(open_[0][2] if open_ else None)

    def at(self, place: int) -> str | None:
        return self.names[bisect_right(self.places, place) - 1]


class _Declared:
    """The type of the nearest declaration of a name, an earlier one first."""

    def __init__(self, variables: list[tuple[int, str, str]]):
        self.by_name: dict[str, tuple[list[int], list[str]]] = defaultdict(lambda: ([], []))
        for place, name, kind in variables:  # in the text's order
            self.by_name[name][0].append(place)
            self.by_name[name][1].append(kind)

    def at(self, name: str, place: int) -> str | None:
        if name not in self.by_name:
            return None
        places, kinds = self.by_name[name]
        return kinds[max(bisect_right(places, place) - 1, 0)]


def _is_made(code: str, place: int) -> bool:
    """Whether ``new`` stands before the place."""
    while place and code[place - 1].isspace():
        place -= 1
    return code.endswith("new", 0, place) and not (place > 3 and (code[place - 4].isalnum() or code[place - 4] == "_"))


def scan(source: str) -> Iterator[dict]:
    """The declarations and calls of one file, in a few passes over its text; each place is looked up by halving."""
    text, code = plain(source)
    lines = [0, *(m.end() for m in re.finditer("\n", code))]

    def at(place: int) -> tuple[int, int]:
        line = bisect_right(lines, place)
        return line, place - lines[line - 1] + 1

    def item(kind: str, name: str, start: int, end: int, **more) -> dict:
        (line, column), (last, last_column) = at(start), at(end)
        span = {"start_line": line, "start_column": column, "end_line": last, "end_column": last_column}
        return {"kind": kind, "name": name, "place": start, "span": span, "text": " ".join(text[start:end].split())} | more

    if BOOTSTRAP in code:
        start = code.index(BOOTSTRAP)
        yield item("host", BOOTSTRAP, start, start + len(BOOTSTRAP))
    closed = _brackets(code)
    declared_types = list(_TYPE.finditer(code))
    types = _Scopes([(*_body(code, m.end(), closed), m[1]) for m in declared_types])
    # A record's name and brackets read like a method's.
    starts = {m.start(1) for m in declared_types}
    heads = [m for m in _METHOD.finditer(code) if m[4] not in KEYWORDS and m.start(4) not in starts]
    methods = _Scopes([(*_body(code, m.end(), closed), m[4]) for m in heads])

    for m in declared_types:
        bases = [x for part in re.split(r",(?![^<]*>)", m[2] or "") if (x := "".join(re.findall(r"([A-Za-z_]\w*)\s*(?:<.*)?\s*$", part.strip())))]
        yield item("type", m[1], m.start(1), m.end(1), bases=bases, owner_type=types.at(m.start()), text=" ".join(m[0].split()))
    for m in heads:
        yield item("method", m[4], m.start(4), m.end(4), owner_type=types.at(m.start(4)), attributes=" ".join(m[1].split()), is_public=m[2] == "public", is_static="static" in m[3].split(), text=" ".join(code[m.start(2) : m.end()].split()))

    variables = [(m.start(), m[2], "".join(m[1].split())) for m in _DECLARED.finditer(code)]
    for place, name, kind in variables:
        if kind.startswith(SET) and kind.endswith(">"):
            yield item("set", name, place, code.index(name, place + len(SET)) + len(name), owner_type=types.at(place), type_argument=kind[len(SET) : -1])

    declared = _Declared(variables)
    names = {m.start(4) for m in heads}
    for m in _CALL.finditer(code):
        if m[2] in KEYWORDS or m.start(2) in names or _is_made(code, m.start()) or (method := methods.at(m.start())) is None:
            continue
        end = closed[m.end() - 1]
        inside = _LITERAL.search(text, m.end(), end)
        receiver = m[1]
        kind = declared.at(receiver.split(".")[-1], m.start()) or declared.at(receiver.split(".")[0], m.start()) if receiver else None
        yield item("call", m[2], m.start(), end, owner_type=types.at(m.start()), owner_method=method, receiver=receiver, receiver_type=kind, type_argument=m[3], literal=inside[1] if inside else None)
    for m in _NAME.finditer(code):
        if (method := methods.at(m.start())) is not None:
            yield item("use", m[0], m.start(), m.end(), owner_type=types.at(m.start()), owner_method=method)


def items(files: DataFrame) -> DataFrame:
    """All declarations and calls of the files (project, relative_path, content); one pass."""
    names = ["project", "relative_path", "kind", "name", "owner_type", "owner_method", "place", "span", "text", "bases", "attributes", "is_public", "is_static", "receiver", "receiver_type", "type_argument", "literal"]
    kinds = [pa.string()] * 6 + [pa.int32(), pa.struct([(c, pa.int32()) for c in ("start_line", "start_column", "end_line", "end_column")]), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_()] + [pa.string()] * 4

    def run(batches):
        for batch in batches:
            for project, path, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = [{"project": project, "relative_path": path} | x for x in scan(content or "")]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in found], k) for n, k in zip(names, kinds, strict=True)], names)

    return shipped(files).select("project", "relative_path", "content").mapInArrow(run, ITEMS)


def controllers(types: DataFrame) -> DataFrame:
    """Names of types below a controller's base, at any depth, whatever file declares the types between."""
    edges = types.select(F.explode("bases").alias("source"), F.col("name").alias("target"))
    seeds = types.sparkSession.createDataFrame([(c,) for c in CONTROLLERS], "node string")
    return fixpoint.reachable(seeds, edges).withColumnRenamed("node", "name")


def resolved(calls: DataFrame, methods: DataFrame, references: DataFrame) -> DataFrame:
    """Calls with target_project and target (Type.Method), and whether a name that sources declare stays open.

    The one declaration in the call's own project comes first, then the one in the projects
    that it refers to.
    """
    known = methods.select("project", "name", F.concat_ws(".", "owner_type", "name").alias("full")).distinct()
    own = known.groupBy("project", "name").agg(F.count("*").alias("own_n"), F.min("full").alias("own_full"))
    near = references.select("project", F.col("target").alias("other")).distinct().join(known.withColumnRenamed("project", "other"), "other").groupBy("project", "name").agg(F.count("*").alias("near_n"), F.min(F.struct("other", "full")).alias("near"))
    rows = calls.join(own, ["project", "name"], "left").join(near, ["project", "name"], "left").join(known.select("name").distinct().withColumn("is_known", F.lit(True)), "name", "left")
    here, there = F.col("own_n") == 1, F.col("own_n").isNull() & (F.col("near_n") == 1)
    found = rows.withColumns({"target_project": F.when(here, F.col("project")).when(there, F.col("near.other")), "target": F.when(here, F.col("own_full")).when(there, F.col("near.full"))})
    return found.withColumn("is_open", F.coalesce("is_known", F.lit(False)) & F.col("target").isNull()).drop("own_n", "own_full", "near_n", "near", "is_known")


def resolved_types(uses: DataFrame, types: DataFrame, references: DataFrame) -> DataFrame:
    """Uses with target_project, the project whose type they name, and is_open, where several projects leave it open.

    A type of the own project comes first, then one of a project that it refers to. A name that neither declares is no use
    of a type: without a reference there is no way to it.
    """
    known = types.select("project", "name").distinct()
    near = references.select("project", F.col("target").alias("other")).distinct().join(known.withColumnRenamed("project", "other"), "other").groupBy("project", "name").agg(F.count("*").alias("near_n"), F.min("other").alias("near"))
    rows = uses.join(known.withColumn("is_own", F.lit(True)), ["project", "name"], "left").join(near, ["project", "name"], "left").where("is_own or near is not null")
    target = F.when(F.col("is_own"), F.col("project")).when(F.col("near_n") == 1, F.col("near"))
    return rows.withColumn("target_project", target).withColumn("is_open", target.isNull()).drop("is_own", "near_n", "near")


def extract(files: DataFrame, facts: DataFrame, references: DataFrame, solution: str, variant: tuple = ("unknown", "Debug", [], "lexical"), include_tests: bool = False) -> FactualGraph:
    """The graph of one solution: ``files`` (project, relative_path, content), project facts and references."""
    sol = F.lit(solution)
    files = files.where(predicates.source_kind(F.col("relative_path")) == "CSharpSource")
    if not include_tests:
        files = files.where(~predicates.is_test_path(F.col("relative_path")))
    found = fixpoint.checkpointed(items(files))
    own_variant = F.struct(F.lit(variant[0]).alias("tfm"), F.lit(variant[1]).alias("configuration"), F.array(*map(F.lit, variant[2])).cast("array<string>").alias("symbols"), F.lit(variant[3]).alias("environment"))
    top = F.struct(*[F.lit(1).alias(c) for c in ("start_line", "start_column", "end_line", "end_column")])

    types, methods, calls, sets = (found.where(F.col("kind") == k).drop("kind") for k in ("type", "method", "call", "set"))
    web = types.join(controllers(types), "name", "left_semi")
    full = F.concat_ws(".", "owner_type", "name")
    endpoints = methods.where("is_public").where(F.rlike("attributes", F.lit(r"\[\s*(Http\w*|Route)\b"))).join(web.select("project", F.col("name").alias("owner_type")).distinct(), ["project", "owner_type"], "left_semi")
    mains = methods.where("is_static and name = 'Main'")
    hosts = found.where("kind = 'host'").select("project", F.lit(True).alias("is_host")).distinct()
    roots = facts.join(hosts, "project", "left").join(web.select("project").distinct().withColumn("has_web", F.lit(True)), "project", "left")
    runs = F.coalesce("is_host", F.lit(False)) | F.coalesce(F.col("output_type").isin(*EXECUTABLES), F.lit(False))
    units, parts = roots.where(runs), roots.where(runs | F.coalesce("has_web", F.lit(False)))

    def entity(df: DataFrame, kind: str, name: Column, shown: Column, path: Column, span: Column = top, shape: Column | None = None) -> DataFrame:
        """An entity and where it occurs; names within a project are qualified by it."""
        return df.select(identity.entity_key(sol, F.lit(kind), name, F.col("project")).alias("key"), F.lit(kind).alias("kind"), shown.alias("display_name"), name.alias("qualified_name"), "project", path.alias("relative_path"), span.alias("span"), F.sha2(name if shape is None else shape, 256).alias("shape_digest"))

    file, span, text = F.coalesce("relative_path", F.lit(UNKNOWN)).alias("relative_path"), F.col("span"), F.col("text")
    project_name = predicates.stem(F.col("project"))
    placed = F.concat_ws("#", file, full)
    rows = reduce(DataFrame.unionByName, [
        entity(facts, "Project", F.col("project"), project_name, F.col("project")), entity(files, "Document", file, predicates.file_name(file), file),
        entity(types, "Symbol", F.col("name"), F.col("name"), file, span, text), entity(methods, "Symbol", full, F.col("name"), file, span, text),
        entity(endpoints, "EntryPoint", placed, F.col("name"), file, span, text), entity(endpoints, "BoundaryOperation", placed, F.col("name"), file, span, text), entity(mains, "EntryPoint", placed, F.col("name"), file, span, text),
        entity(units, "DeploymentUnit", F.col("project"), project_name, F.col("project")), entity(parts, "Component", F.col("project"), project_name, F.col("project")),
    ])

    def key_of(kind: str, name: Column, project: Column | None = None) -> Column:
        return identity.entity_key(sol, F.lit(kind), name, F.col("project") if project is None else project)

    # A relation starts at the method around its call.
    caller = key_of("Symbol", F.concat_ws(".", "owner_type", "owner_method"))
    literal, receiver = F.col("literal"), F.col("receiver_type")
    clients = types.where(F.array_contains("bases", GRPC_BASE)).select(F.col("name").alias("client")).distinct().withColumn("is_client", F.lit(True))
    # A receiver that its own file doesn't declare may be a set that one context declares.
    elsewhere = sets.groupBy(F.col("name").alias("member")).agg(F.min("type_argument").alias("held"), F.count_distinct("type_argument").alias("n")).where("n = 1").drop("n")
    called = resolved(calls, methods, references).withColumn("member", F.element_at(F.split(F.coalesce("receiver", F.lit("")), r"\."), -1)).join(elsewhere, "member", "left")
    called = called.withColumn("receiver_type", F.when(F.col("held").isNotNull() & (receiver.isNull() | ~F.contains(receiver, F.lit(SET))), F.concat(F.lit(SET), "held", F.lit(">"))).otherwise(receiver))
    called = called.join(clients.withColumnRenamed("client", "receiver_type"), "receiver_type", "left")
    name = F.col("name")
    role = (
        F.when(name.isin(*MESSAGING), F.when(F.col("type_argument").isNotNull(), "messaging").otherwise("open-message")).when(name.isin(*predicates.HTTP_METHODS), F.when(literal.isNotNull(), "http").otherwise("open-http"))
        .when(F.col("is_client"), "grpc").when(name.isin(*SECTIONS, *CONFIGURATION_KEYS), F.when(literal.isNotNull(), "configuration").otherwise("none"))
        .when(F.contains(receiver, F.lit(CONTEXT)) | F.contains(receiver, F.lit(SET)), "persistence").when(F.col("target").isNotNull(), "internal-invocation").when(F.col("is_open"), "open-call").otherwise("none")
    )
    called = fixpoint.checkpointed(called.withColumn("role", role).where("role != 'none'"))

    def relation(df: DataFrame, category: str, target: Column, source: Column = caller) -> DataFrame:
        return df.select(source.alias("source_key"), target.alias("target_key"), F.lit(category).alias("category"), "project", file, "place", "span", "text")

    def of(role: str) -> DataFrame:
        return called.where(F.col("role") == role)

    held = F.regexp_extract(receiver, r"DbSet<\s*([\w.]+)\s*>", 1)
    config = F.concat(F.when(name.isin(*SECTIONS), "section:").otherwise("key:"), literal)
    named_types = found.where("kind = 'use'").where("owner_type is null or name != owner_type")
    named_types = fixpoint.checkpointed(resolved_types(named_types, types, references))
    uses = named_types.where("not is_open")
    refs = references.select("project", F.col("project").alias("relative_path"), F.lit(0).alias("place"), top.alias("span"), F.col("target").alias("text"))
    proven = reduce(DataFrame.unionByName, [
        relation(of("internal-invocation"), "internal-invocation", key_of("Symbol", F.col("target"), F.col("target_project"))), relation(of("http"), "http", key_of("HttpEndpoint", literal)), relation(of("grpc"), "grpc", key_of("GrpcService", receiver)),
        relation(of("messaging"), "messaging", key_of("MessageChannel", F.col("type_argument"))), relation(of("messaging"), "contract", key_of("Contract", F.col("type_argument"))), relation(of("configuration"), "configuration", key_of("ConfigurationKey", config)),
        relation(of("persistence"), "persistence-store", key_of("PersistenceStore", receiver)), relation(of("persistence"), "persistence-operation", key_of("PersistenceStore", F.concat_ws("#", receiver, name))), relation(of("persistence").where(held != ""), "persistence-object", key_of("PersistenceObject", held)),
        relation(sets, "persistence-object", key_of("PersistenceObject", F.col("type_argument")), key_of("Symbol", F.col("owner_type"))),
        relation(uses, "structural-type-use", key_of("Symbol", name, F.col("target_project"))), relation(refs, "project-reference", key_of("Project", F.col("text"), F.col("text")), key_of("Project", F.col("project"))),
    ])
    where = F.concat_ws(":", file, "place", "text")
    proven = fixpoint.checkpointed(proven.withColumns({"evidence": identity.evidence_key(F.col("category"), where), "key": identity.relation_key(F.col("category"), F.col("source_key"), F.col("target_key"), where)}))
    relations = proven.select(sol.alias("solution_key"), "key", "source_key", "target_key", "category", F.array("evidence").alias("evidence_keys"))

    def evidence_of(df: DataFrame) -> DataFrame:
        return df.select(sol.alias("solution_key"), F.col("evidence").alias("key"), identity.document_key(sol, file).alias("document_key"), own_variant.alias("variant"), "span", F.sha2("text", 256).alias("content_digest"))

    causes = F.when(F.col("role") == "open-http", "http-destination-unresolved").when(F.col("role") == "open-message", "messaging-payload-unresolved").otherwise("unresolved-invocation")
    kinds = F.when(F.col("role") == "open-http", "Candidate").otherwise("Unknown")
    open_types = named_types.where("is_open").select(F.lit("Unknown").alias("gap"), F.lit("unresolved-type-use").alias("cause"), caller.alias("affected"), "project", file, "place", "span", "text", identity.evidence_key(F.lit("type-use"), where).alias("evidence"))
    opened = called.where(F.col("role").startswith("open-")).select(kinds.alias("gap"), causes.alias("cause"), caller.alias("affected"), "project", file, "place", "span", "text", identity.evidence_key(F.lit("invocation"), where).alias("evidence")).unionByName(open_types)
    gaps = opened.select(sol.alias("solution_key"), identity.gap_key(F.col("gap"), F.col("affected"), where).alias("key"), F.col("gap").alias("kind"), "cause", F.array("affected").alias("affected_keys"), F.array("evidence").alias("evidence_keys"))
    evidence = evidence_of(proven).unionByName(evidence_of(opened))
    # Targets that no declaration names: endpoints, channels, contracts, stores, keys.
    named = proven.select(F.col("target_key").alias("key")).unionByName(proven.select(F.col("source_key").alias("key"))).distinct().join(rows.select("key").distinct(), "key", "left_anti")
    kind = F.element_at(F.split("key", ":"), F.size(F.split(sol, ":")) + 2)
    proper = F.element_at(F.create_map(*[F.lit(x) for k in ENTITY_KINDS for x in (k.lower(), k)]), kind)
    external = named.select("key", proper.alias("kind"), F.element_at(F.split("key", ":"), -1).alias("display_name"), F.lit(None).cast("string").alias("qualified_name"))
    whole = facts.sparkSession.range(1).select(identity.entity_key(sol, F.lit("Solution"), sol).alias("key"), F.lit("Solution").alias("kind"), F.element_at(F.split(sol, ":"), -1).alias("display_name"), sol.alias("qualified_name"))
    entities = keep_first(rows.select("key", "kind", "display_name", "qualified_name").unionByName(external).unionByName(whole), ["key"], ["kind", "display_name"]).select(sol.alias("solution_key"), "key", "kind", "display_name", "qualified_name")
    occurrences = rows.distinct().select(sol.alias("solution_key"), F.col("key").alias("entity_key"), F.struct(identity.project_key(sol, F.col("project")).alias("key"), F.col("project").alias("path")).alias("project"), own_variant.alias("variant"), "relative_path", "span", "shape_digest", F.array().cast("array<string>").alias("evidence_keys"))
    sources = files.select(sol.alias("solution_key"), identity.document_key(sol, file).alias("key"), "relative_path", predicates.is_test_path(file).alias("is_test"), F.sha2("content", 256).alias("content_digest")).distinct()
    distinct = [keep_first(df, ["solution_key", "key"], [F.col(df.columns[2])]) for df in (evidence, relations, gaps)]
    return FactualGraph(entities, occurrences, *distinct, sources)
