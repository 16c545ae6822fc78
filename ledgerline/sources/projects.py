"""Sources: solution files, project files and a digest-bearing file inventory, read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import identity, predicates


def texts(spark: SparkSession, paths: str | list[str], names: str = "*") -> DataFrame:
    """path and content of whole text files whose names fit; a byte order mark is left out."""
    rows = spark.read.option("pathGlobFilter", names).text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.select(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/").alias("path"), F.regexp_replace("content", "^﻿", "").alias("content"))


def plain_xml(content: Column) -> Column:
    """XML without its declaration and default namespace, which XPath expressions would have to name."""
    return F.regexp_replace(F.regexp_replace(content, r"^\s*<\?[^>]*\?>", ""), r'\sxmlns="[^"]*"', "")


def resolved(path: Column) -> Column:
    """``/`` alone, without ``.`` segments, and ``..`` taken back."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, s)))
    return F.concat(F.when(F.replace(path, F.lit("\\"), F.lit("/")).startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def declared_projects(solutions: DataFrame) -> DataFrame:
    """solution (path) and project (resolved path), from ``.slnx`` XML or quoted ``.csproj`` names of ``.sln``."""
    xml = F.lower("path").endswith(".slnx")
    names = F.when(xml, F.xpath(F.when(xml, plain_xml(F.col("content"))), F.lit("//Project/@Path"))).otherwise(F.regexp_extract_all("content", F.lit('"([^"\\r\\n]+\\.csproj)"'), F.lit(1)))
    rows = solutions.select(F.col("path").alias("solution"), F.explode(names).alias("name")).where(F.lower("name").endswith(".csproj"))
    return rows.select("solution", resolved(F.concat_ws("/", predicates.folder(F.col("solution")), "name")).alias("project")).distinct()


def common_folder(paths: DataFrame, path: str = "path", by: tuple[str, ...] = ()) -> DataFrame:
    """The nearest folder above all paths: the least and the largest of them already share only that."""
    ends = paths.groupBy(*by).agg(F.min(predicates.folder(F.col(path))).alias("one"), F.max(predicates.folder(F.col(path))).alias("two"))
    one, two = F.split("one", "/"), F.split("two", "/")
    depth = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.size(one), F.size(two))), lambda i: F.get(one, i - 1).isNull() | F.get(two, i - 1).isNull() | (F.get(one, i - 1) != F.get(two, i - 1)))) - 1, F.size(one))
    return ends.select(*by, F.array_join(F.slice(one, 1, depth), "/").alias("root"))


def open_folders(spark: SparkSession, root: str) -> list[str]:
    """The folder and those below it, without what lies in excluded ones: these are never listed."""
    jvm = spark.sparkContext._jvm
    start = jvm.org.apache.hadoop.fs.Path(root)
    fs = start.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    waiting, found = [start], []
    while waiting:
        folder = waiting.pop()
        found.append(folder.toString())
        waiting += [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().lower() not in predicates.EXCLUDED_FOLDERS]
    return sorted(found)


def inventory(spark: SparkSession, root: str, include_tests: bool = False) -> DataFrame:
    """Files below a folder: relative_path, kind, is_test, admitted, and digest and bytes of those admitted.

    Refused files are told apart by their path alone, so their content is not read.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").load(open_folders(spark, base))
    own = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    rows = files.withColumn("relative_path", predicates.relative_to(own, F.lit(base))).where(~predicates.has_excluded_folder(F.col("relative_path")))
    path = F.col("relative_path")
    rows = rows.withColumns({"kind": predicates.source_kind(path), "is_test": predicates.is_test_path(path), "admitted": predicates.is_admitted(path, include_tests)})
    kept = rows.where("admitted").select("relative_path", "kind", "is_test", "admitted", F.sha2("content", 256).alias("content_digest"), F.col("length").alias("bytes"))
    return kept.unionByName(rows.where("not admitted").select("relative_path", "kind", "is_test", "admitted", F.lit(None).cast("string").alias("content_digest"), F.col("length").alias("bytes")))


def source_rows(files: DataFrame, solution: Column) -> DataFrame:
    """The inventory's admitted rows as the graph's sources."""
    return files.where("admitted").select(solution.alias("solution_key"), identity.document_key(solution, F.col("relative_path")).alias("key"), "relative_path", "is_test", "content_digest")


def owned_files(files: DataFrame, projects: DataFrame) -> DataFrame:
    """``files`` (path and more) with the project in the nearest folder above them; files below no project are left out.

    A file meets the projects of its own ancestors' folders alone, by equality.
    """
    parts = F.split(predicates.folder(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    homes = projects.select("project", predicates.folder(F.col("project")).alias("home")).distinct()
    found = files.select("path", F.explode(above).alias("home")).join(homes, "home")
    best = found.groupBy("path").agg(F.max_by("project", F.struct(F.length("home"), "project")).alias("project"))
    return files.join(best, "path")


def project_facts(projects: DataFrame) -> DataFrame:
    """project, output_type and frameworks of project files (path, content)."""
    xml = plain_xml(F.col("content"))
    many, single = F.trim(F.xpath_string(xml, F.lit("//TargetFrameworks"))), F.trim(F.xpath_string(xml, F.lit("//TargetFramework")))
    output = F.trim(F.xpath_string(xml, F.lit("//OutputType")))
    frameworks = F.filter(F.transform(F.split(F.when(many != "", many).otherwise(single), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return projects.select(F.col("path").alias("project"), F.when(output != "", output).alias("output_type"), F.array_distinct(frameworks).alias("frameworks"))


def project_references(projects: DataFrame) -> DataFrame:
    """project -> target of the references that a project file itself states."""
    found = projects.select(F.col("path").alias("project"), F.explode(F.xpath(plain_xml(F.col("content")), F.lit("//ProjectReference/@Include"))).alias("include"))
    return found.select("project", resolved(F.concat_ws("/", predicates.folder(F.col("project")), "include")).alias("target")).distinct()


def reference_identities(references: DataFrame, facts: DataFrame, solution: Column) -> DataFrame:
    """project, target, its key and its frameworks for every direct reference; is_known tells whether its project file was read."""
    known = facts.select(F.col("project").alias("target"), "frameworks", F.lit(True).alias("read"))
    rows = references.select("project", "target").distinct().join(known, "target", "left")
    return rows.select("project", "target", identity.project_key(solution, F.col("target")).alias("key"), F.coalesce("frameworks", F.array().cast("array<string>")).alias("frameworks"), F.coalesce("read", F.lit(False)).alias("is_known"))


def variant_plan(facts: DataFrame) -> DataFrame:
    """(project, tfm, problem): a row per framework; ``missing-tfm`` where none is stated, ``ambiguous-tfm`` where names differ in case alone."""
    rows = facts.select("project", F.explode_outer("frameworks").alias("tfm"))
    twice = rows.groupBy("project", F.lower("tfm").alias("low")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("low", F.lower("tfm")).join(twice, ["project", "low"], "left")
    return rows.select("project", "tfm", F.when(F.col("tfm").isNull(), "missing-tfm").when(F.col("n") > 1, "ambiguous-tfm").alias("problem")).orderBy("project", "tfm")
