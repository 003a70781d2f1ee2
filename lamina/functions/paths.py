"""Path, size and content predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions (case-sensitive) of each language.
LANGUAGES = {
    "rust": "rs",
    "python": "py pyw",
    "javascript": "js mjs cjs",
    "c": "c h",
    "go": "go",
    "json": "json",
    "toml": "toml",
    "yaml": "yaml yml",
    "typescript": "ts",
    "tsx": "tsx",
    "cpp": "cpp cc cxx hpp hh",
    "java": "java",
    "csharp": "cs",
    "swift": "swift",
    "kotlin": "kt kts",
    "zig": "zig",
    "sql": "sql",
    "bash": "sh bash",
    "html": "html htm",
    "css": "css",
}
#: Names and extensions that are text by intent.
TEXT_NAMES = (".gitignore", ".dockerignore", "Dockerfile", "Makefile", "LICENSE", "COPYING", "README", "go.sum")
TEXT_EXTENSIONS = ("md", "txt", "rst", "log", "csv", "ini", "cfg", "env", "gitignore", "dockerignore", "editorconfig", "ps1")

_BY_EXTENSION = {e: lang for lang, some in LANGUAGES.items() for e in some.split()}


def language_of(path: str) -> str | None:
    """Twin of ``language`` for kernels."""
    if path.rsplit("/", 1)[-1] == "go.mod":
        return "gomod"
    return _BY_EXTENSION.get(path.rsplit(".", 1)[-1])


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    """Language by file name, else by what follows the last dot; null where there is none."""
    names = F.create_map(*[F.lit(x) for pair in _BY_EXTENSION.items() for x in pair])
    return F.when(base_name(path) == "go.mod", F.lit("gomod")).otherwise(F.element_at(names, F.substring_index(path, ".", -1)))


def is_text_only(path: Column) -> Column:
    name = base_name(path)
    named = name.isin(*TEXT_NAMES) | (name.startswith(".") & name.endswith("ignore"))
    return language(path).isNull() & (named | F.substring_index(path, ".", -1).isin(*TEXT_EXTENSIONS))


def extension(path: Column) -> Column:
    """Extension of the file name alone; null for none and for dotfiles."""
    found = F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(base_name(path).rlike(r"^.+\.[^.]*$"), found)


def is_binary(content: Column) -> Column:
    """NUL bytes or bytes that aren't UTF-8."""
    return F.hex(content).rlike("^(..)*00") | ~F.is_valid_utf8(content.cast("string"))


def normalized(path: Column) -> Column:
    """Forward slashes only; null for a path that climbs out."""
    fixed = F.regexp_replace(path, r"\\", "/")
    return F.when(~F.array_contains(F.split(fixed, "/"), ".."), fixed)


def size_text(n: Column) -> Column:
    kib, mib = F.lit(1024.0), F.lit(1024.0 * 1024.0)
    return F.when(n < 1024, F.format_string("%d bytes", n)).when(n < 1024 * 1024, F.format_string("%.1f KiB", F.bround(n / kib, 1))).when(n.isNotNull(), F.format_string("%.1f MiB", F.bround(n / mib, 1)))


def query_parameters(query: Column) -> Column:
    """Map of the parameters of a query string: a name alone has an empty value, the last of equal names counts."""
    pairs = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: (p != "") & ~p.startswith("="))
    named = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit("")).alias("value")))
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def bisect_steps(low: Column, high: Column) -> Column:
    """Rough number of tests left between two candidates."""
    return F.when(low >= high, F.lit(1)).otherwise(F.floor(F.log2(high - low)) + 1).cast("int")
