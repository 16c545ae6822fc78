"""Predicates and classifications of paths and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders that no inventory enters (fixed values).
EXCLUDED_FOLDERS = (".git", ".vs", "bin", "obj")
#: Path segments of tests, whole or at a segment's end (fixed values).
TEST_SEGMENTS = ("test", "tests", "testes")
TEST_ENDINGS = (".tests", ".unittests", ".integrationtests", ".testes")
#: What names a secret, and calls that are remote (fixed values).
SECRET = r"(?i)(password|secret|token|apikey|api_key)\s*[:=]"
REDACTED = "[REDACTED]"
HTTP_METHODS = ("GetAsync", "PostAsync", "PostAsJsonAsync", "PutAsync", "DeleteAsync")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def relative_link(page: Column, target: Column) -> Column:
    """``target`` as seen from ``page``'s folder: up to the nearest folder of both, then down."""
    one, two = F.split(folder(page), "/"), F.split(target, "/")
    one = F.when(folder(page) == "", F.array().cast("array<string>")).otherwise(one)
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(one), F.lit(1))), lambda i: (i <= F.size(one)) & (i < F.size(two)) & (F.slice(one, 1, i) == F.slice(two, 1, i))))
    return F.concat(F.repeat(F.lit("../"), F.size(one) - same), F.array_join(F.slice(two, same + 1, F.size(two)), "/"))


def source_kind(path: Column) -> Column:
    name, kind = F.lower(file_name(path)), F.lower(extension(path))
    return F.when(kind == ".cs", "CSharpSource").when(kind == ".csproj", "ProjectFile").when(name.startswith("appsettings") & name.endswith(".json"), "Configuration").otherwise("Unsupported")


def is_test_path(path: Column) -> Column:
    """Some segment is a test folder's name or ends like a test project's."""
    return F.exists(F.split(F.lower(path), "/"), lambda s: s.isin(*TEST_SEGMENTS) | F.rlike(s, F.lit("(" + "|".join(x.replace(".", r"\.") for x in TEST_ENDINGS) + ")$")))


def has_excluded_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), r"[/\\]"), F.array(*map(F.lit, EXCLUDED_FOLDERS)))


def is_admitted(path: Column, include_tests: bool = False) -> Column:
    known = source_kind(path) != "Unsupported"
    return known if include_tests else known & ~is_test_path(path)


def is_safe_relative(path: Column) -> Column:
    """Not empty, not rooted, no drive, ``/`` alone, and no segment that is empty, ``.`` or ``..``."""
    segments = F.split(path, "/")
    return F.coalesce((path != "") & ~F.rlike(path, F.lit(r"^[A-Za-z]:|\\")) & ~F.exists(segments, lambda s: s.isin("", ".", "..")), F.lit(False))


def is_canonical_text(text: Column) -> Column:
    """Not blank, no line break or tab, no blank at either end, no two blanks together."""
    return F.coalesce((text != "") & ~F.rlike(text, F.lit(r"[\r\n\t]|^\s|\s$|  ")), F.lit(False))


def required(text: Column, holds: Column, what: str) -> Column:
    """The text, or an error where it breaks its contract."""
    return F.when(holds, text).otherwise(F.raise_error(F.concat(F.lit(what + ": "), F.coalesce(text, F.lit("null")))).cast("string"))


def is_inside(path: Column, root: Column) -> Column:
    """Equal to the root or below it; both already resolved."""
    base = F.regexp_replace(root, "/+$", "")
    return (path == base) | path.startswith(F.concat(base, F.lit("/")))


def relative_to(path: Column, root: Column) -> Column:
    base = F.regexp_replace(root, "/+$", "")
    return F.when(path.startswith(F.concat(base, F.lit("/"))), F.substr(path, F.length(base) + 2))


def is_valid_span(span: Column) -> Column:
    """One-based, and the end isn't before the start."""
    ordered = (span["end_line"] > span["start_line"]) | ((span["end_line"] == span["start_line"]) & (span["end_column"] >= span["start_column"]))
    return F.coalesce((F.least(*[span[c] for c in ("start_line", "start_column", "end_line", "end_column")]) >= 1) & ordered, F.lit(False))


def disposition(text: Column, reject_escapes: bool = True) -> Column:
    """retained, secret, absolute-path or path-escape; the first that fits."""
    out = F.when(F.rlike(text, F.lit(SECRET)), "secret").when(text.startswith("/") | F.rlike(text, F.lit(r"^\\\\")), "absolute-path")
    if reject_escapes:
        out = out.when(text.contains("..") | text.contains("\\"), "path-escape")
    return out.otherwise("retained")


def safety(text: Column, reject_escapes: bool = True) -> Column:
    """status (Retained, Redacted, Rejected), reason and value of a text to be published; a rejected one has no value."""
    reason = disposition(text, reject_escapes)
    status = F.when(reason == "retained", "Retained").when(reason == "path-escape", "Rejected").otherwise("Redacted")
    value = F.when(reason == "retained", text).when(reason != "path-escape", F.lit(REDACTED))
    return F.struct(status.alias("status"), reason.alias("reason"), value.alias("value"))


def published(text: Column) -> Column:
    return F.when(disposition(text) == "retained", text).otherwise(F.lit(REDACTED))


#: C# text in pieces: comments and literals whole, then any other sign (for redaction outside comments).
_PIECES = r'(?s)(//[^\n]*|/\*.*?\*/|@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|.)'


def redacted_source(source: Column) -> Column:
    """C# source whose unsafe string literals are redacted; comments stay as they are."""
    def safe(piece: Column) -> Column:
        value = F.when(piece.startswith('@"'), F.replace(piece.substr(F.lit(3), F.length(piece) - 3), F.lit('""'), F.lit('"'))).otherwise(piece.substr(F.lit(2), F.length(piece) - 2))
        literal = piece.startswith('"') | piece.startswith('@"')
        return F.when(literal & (disposition(value, False) != "retained"), F.lit(f'"{REDACTED}"')).otherwise(piece)

    return F.array_join(F.transform(F.regexp_extract_all(source, F.lit(_PIECES), F.lit(1)), safe), "")


def first_literal(arguments: Column) -> Column:
    """The first string literal of an argument list; null where there is none."""
    found = F.regexp_extract(arguments, r'"((?:\\.|[^"\\])*)"', 1)
    return F.when(F.contains(arguments, F.lit('"')), found)


def escaped_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]])", r"\\$1")


def tokens_of_bytes(size: Column, per_token: float = 4.0) -> Column:
    return F.ceil(size / F.lit(per_token)).cast("long")


def artifact_family(path: Column) -> Column:
    """The family that a package path belongs to; null for none."""
    return (
        F.when(F.rlike(path, F.lit(r"(^|/)manifest\.json$")), "Manifest").when(F.rlike(path, F.lit("(^|/)certification/")), "Certification").when(path.endswith(".md"), "Markdown")
        .when(F.rlike(path, F.lit("(^|/)indexes/")), "Index").when(F.rlike(path, F.lit("(^|/)evidence/")), "Evidence").when(F.rlike(path, F.lit("(^|/)tables/")), "Table")
        .when(F.rlike(path, F.lit("(^|/)graph/")), "Graph").when(F.rlike(path, F.lit("(^|/)dependencies/")), "Dependencies").when(F.rlike(path, F.lit("(^|/)measures/")), "Measures")
    )
