"""The two operations: analyse solutions, or fact tables, into a package, and validate a package; with a command line."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import identity, predicates
from ledgerline.model import FactualGraph
from ledgerline.operators.retain import InvalidRelation
from ledgerline.plans import package
from ledgerline.sources import facts, lexical, projects

#: Exit codes (fixed values).
OK, USAGE, REJECTED, INVALID = 0, 1, 4, 5


@dataclass(frozen=True)
class Diagnostic:
    code: str
    stage: str
    cause: str
    artifact: str | None = None

    def line(self) -> str:
        parts = {"code": self.code, "stage": self.stage, "cause": self.cause, "artifact": self.artifact}
        return " ".join(f"{k}={v}" for k, v in parts.items() if v)


@dataclass(frozen=True)
class Result:
    digest: str | None
    diagnostics: tuple[Diagnostic, ...] = ()


def solution_graph(spark: SparkSession, path: str, include_tests: bool = False) -> tuple[str, FactualGraph]:
    """Name and facts of a solution file: its projects, their references, and the C# files below them.

    Paths are relative to the nearest folder above all projects. What a solution names is read by Spark; the driver
    sees that folder and the names of the folders below it.
    """
    declared = projects.declared_projects(projects.texts(spark, [path])).select("project")
    root = projects.common_folder(declared, "project").first()["root"]
    if root is None:
        raise package.PackageError("no-projects", "request", "a solution names at least one project", path)
    below = projects.open_folders(spark, root)

    def relative(column: str) -> Column:
        return predicates.relative_to(F.col(column), F.lit(root)).alias(column)

    named = projects.texts(spark, below, "*.csproj").join(declared.withColumnRenamed("project", "path"), "path", "left_semi")
    owned = projects.owned_files(projects.texts(spark, below, "*.cs"), named.select(F.col("path").alias("project")))
    files = owned.select(relative("project"), relative("path"), "content").withColumnRenamed("path", "relative_path")
    own = projects.project_facts(named)
    own = own.withColumn("project", relative("project"))
    references = projects.project_references(named).select(relative("project"), relative("target")).where("target is not null")
    name, file = predicates.stem(F.lit(path)), predicates.file_name(F.lit(path))
    told = spark.range(1).select(name.alias("name"), identity.solution_key(name, file).alias("key")).first()
    return told["name"], lexical.extract(files, own, references, told["key"], include_tests=include_tests)


def analyze_solutions(spark: SparkSession, paths: list[str], output: str, include_tests: bool = False, form: str = "parquet") -> Result:
    """Publish the graphs of solution files as one package."""
    if not paths:
        return Result(None, (Diagnostic("no-solutions", "request", "no solution was given"),))
    if len(set(paths)) < len(paths):
        return Result(None, (Diagnostic("duplicate-solution", "request", "a solution was given twice"),))
    graphs, names = [], []
    for path in paths:
        try:
            name, graph = solution_graph(spark, path, include_tests)
        except AnalysisException as e:
            return Result(None, (Diagnostic("solution-unreadable", "request", str(e).splitlines()[0], path),))
        except package.PackageError as e:
            return Result(None, (Diagnostic(e.code, e.stage, e.cause, e.artifact),))
        names.append(name)
        graphs.append(facts.stored(graph))
    return _published(spark, graphs, names, output, include_tests, form)


def _published(spark: SparkSession, graphs: list[FactualGraph], names: list[str], output: str, include_tests: bool, form: str) -> Result:
    try:
        graph = facts.merged(graphs) if len(graphs) > 1 else graphs[0]
        return Result(package.publish(spark, package.build_model(graph, include_tests), output, names, form))
    except InvalidRelation as e:
        return Result(None, (Diagnostic("invalid-confirmed-relation", "retention", str(e)),))
    except package.PackageError as e:
        return Result(None, (Diagnostic(e.code, e.stage, e.cause, e.artifact),))


def _name_of(solution_key: str) -> str:
    """A solution's name, by which its ceilings are found: not its path."""
    parts = solution_key.split(":")
    return parts[1] if len(parts) > 2 and parts[0] == "solution" else solution_key


def analyze(spark: SparkSession, folders: list[str], output: str, include_tests: bool = False, form: str = "parquet") -> Result:
    """Publish the graphs of the fact folders as one package."""
    if not folders:
        return Result(None, (Diagnostic("no-solutions", "request", "no fact folder was given"),))
    if len(set(folders)) < len(folders):
        return Result(None, (Diagnostic("duplicate-solution", "request", "a fact folder was given twice"),))
    graphs, names = [facts.load(spark, f) for f in folders], []
    for folder, graph in zip(folders, graphs, strict=True):
        keys = graph.entities.select("solution_key").distinct().limit(2).collect()
        if len(keys) != 1:
            return Result(None, (Diagnostic("not-one-solution", "request", "a fact folder holds exactly one solution", folder),))
        names.append(_name_of(keys[0][0]))
    return _published(spark, graphs, names, output, include_tests, form)


def validate(spark: SparkSession, folder: str) -> Result:
    """Read a package by its pointer and run all checks that need nothing else."""
    try:
        rows = package.read(spark, folder)
        if failure := package.first_failure(rows):
            raise failure
    except package.PackageError as e:
        return Result(None, (Diagnostic(e.code, e.stage, e.cause, e.artifact),))
    return Result(package.package_digest(rows))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerline", exit_on_error=False)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("analyze")
    given = one.add_mutually_exclusive_group(required=True)
    given.add_argument("--solution", action="append")
    given.add_argument("--facts", action="append")
    one.add_argument("--output", required=True)
    one.add_argument("--include-tests", action="store_true")
    one.add_argument("--form", choices=sorted(package.FORMS), default="parquet")
    two = commands.add_parser("validate")
    two.add_argument("--package", required=True)
    try:
        found = parser.parse_args(args)
    except (argparse.ArgumentError, SystemExit):
        return USAGE
    spark = SparkSession.builder.appName("ledgerline").getOrCreate()
    if found.command == "validate":
        result = validate(spark, found.package)
    elif found.solution:
        result = analyze_solutions(spark, found.solution, found.output, found.include_tests, found.form)
    else:
        result = analyze(spark, found.facts, found.output, found.include_tests, found.form)
    for d in result.diagnostics:
        print(d.line(), file=sys.stderr)
    if not result.diagnostics:
        print(result.digest)
        return OK
    return REJECTED if found.command == "analyze" else INVALID


if __name__ == "__main__":
    sys.exit(main())
