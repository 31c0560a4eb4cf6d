"""Languages by file extension, skipped folders, module names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each language.
EXTENSIONS = {
    "python": (".py", ".pyi"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts",),
    "tsx": (".tsx",),
    "css": (".css",),
    "bash": (".sh", ".bash"),
    "go": (".go",),
    "java": (".java",),
    "rust": (".rs",),
    "c": (".c", ".h"),
    "cpp": (".cc", ".cpp", ".cxx", ".hh", ".hpp", ".hxx"),
}
STORE_DIR = ".skeingraph"
# Folders (and files) that a scan leaves out, besides the store's own.
SKIPPED = frozenset(
    ".git .hg .idea .mypy_cache .next .pytest_cache .ruff_cache .svn .tox .venv __pycache__ build coverage dist node_modules out target vendor venv".split()
) | {STORE_DIR}
LANGUAGE_OF = {e: lang for lang, extensions in EXTENSIONS.items() for e in extensions}


def suffix_of(name: str) -> str:
    """The last suffix of a file name, in lower case; none if the name begins with its only dot."""
    stem, dot, rest = name.rpartition(".")
    return f".{rest.lower()}" if dot and stem and rest else ""


def language_of(path: str) -> str | None:
    return LANGUAGE_OF.get(suffix_of(path.rsplit("/", 1)[-1]))


def language_column(path: Column) -> Column:
    """The same as a column: the lower-cased last suffix looked up in a constant map."""
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(LANGUAGE_OF.items())))
    return F.element_at(table, F.lower(F.regexp_extract(path, r"(?:^|/)[^/]+(\.[^./]+)$", 1)))


def module_of(path: str, language: str) -> str:
    """Dotted module name of a path: without suffix, and without a last part that stands for its folder."""
    folder, _, name = path.rpartition("/")
    stem = name[: -len(suffix_of(name))] if suffix_of(name) else name
    parts = [*folder.split("/")] * bool(folder) + [stem]
    if stem == {"python": "__init__", "javascript": "index", "typescript": "index", "tsx": "index"}.get(language):
        parts.pop()
    return ".".join(parts) or stem


def module_column(path: Column, language: Column) -> Column:
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    folder = F.when(language == "python", F.regexp_replace(bare, r"(^|/)__init__$", "")).when(language.isin("javascript", "typescript", "tsx"), F.regexp_replace(bare, r"(^|/)index$", "")).otherwise(bare)
    return F.replace(F.when(folder == "", bare).otherwise(folder), F.lit("/"), F.lit("."))


def supported() -> list[dict]:
    return [{"name": k, "extensions": list(v), "parser": "python_ast" if k == "python" else "tree_sitter"} for k, v in EXTENSIONS.items()]
