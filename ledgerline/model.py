"""Row sets of the evidence graph, as schemas, and the closed vocabularies with their order."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closed vocabularies; a value's place is its order (fixed values).
ENTITY_KINDS = ("Solution", "Project", "Document", "Symbol", "EntryPoint", "BoundaryOperation", "DeploymentUnit", "Component", "Contract", "MessageChannel", "HttpEndpoint", "GrpcService", "PersistenceStore", "PersistenceObject", "DataField", "ConfigurationKey")
ROOT_KINDS = ("Component", "DeploymentUnit", "EntryPoint", "BoundaryOperation")
SCOPES = ("document", "project", "component", "deploymentunit")
CATEGORIES = ("project-reference", "internal-invocation", "structural-type-use", "http", "grpc", "messaging", "contract", "persistence")
NATURES = ("direct", "transitive")
GAP_KINDS = ("Candidate", "Unknown", "OpenFrontier")
#: Spellings that count as persistence (fixed values).
PERSISTENCE = ("persistence", "persistence-store", "persistence-operation", "persistence-object")

SPAN = "struct<start_line:int,start_column:int,end_line:int,end_column:int>"
PROJECT = "struct<key:string,path:string>"
VARIANT = "struct<tfm:string,configuration:string,symbols:array<string>,environment:string>"

ENTITIES = "solution_key string, key string, kind string, display_name string, qualified_name string"
OCCURRENCES = f"solution_key string, entity_key string, project {PROJECT}, variant {VARIANT}, relative_path string, span {SPAN}, shape_digest string, evidence_keys array<string>"
EVIDENCE = f"solution_key string, key string, document_key string, variant {VARIANT}, span {SPAN}, content_digest string"
RELATIONS = "solution_key string, key string, source_key string, target_key string, category string, evidence_keys array<string>"
GAPS = "solution_key string, key string, kind string, cause string, affected_keys array<string>, evidence_keys array<string>"
SOURCES = "solution_key string, key string, relative_path string, is_test boolean, content_digest string"


@dataclass(frozen=True)
class FactualGraph:
    """The fact tables of any number of solutions; every table has ``solution_key``."""

    entities: DataFrame
    occurrences: DataFrame
    evidence: DataFrame
    relations: DataFrame
    gaps: DataFrame
    sources: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def ordinal(value: Column, vocabulary: tuple[str, ...]) -> Column:
    """A value's place in its vocabulary; null for others."""
    place = F.array_position(F.array(*map(F.lit, vocabulary)), value)
    return F.when(place > 0, (place - 1).cast("int"))


def category_of(text: Column) -> Column:
    """The dependency category of a relation's category text; null where it makes no dependency."""
    return F.when(text.isin(*PERSISTENCE), F.lit("persistence")).when(text.isin(*CATEGORIES), text)
