"""Module names that import specifiers stand for."""

from __future__ import annotations

import posixpath

# Suffixes that a specifier may carry, in the order in which they are tried.
SUFFIXES = ".tsx .ts .jsx .js .mjs .cjs .css .bash .sh .rs .cpp .cxx .cc .hpp .hxx .hh .c .h".split()


def unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'`" else value


def relative_module(path: str, specifier: str) -> str:
    """A specifier that begins with a dot is a path from the file's folder; others only trade slashes for dots."""
    name = unquoted(specifier).replace("\\", "/")
    if name.startswith("."):
        name = posixpath.normpath(posixpath.join(posixpath.dirname(path), name))
        name = next((name[: -len(s)] for s in SUFFIXES if name.endswith(s)), name).removesuffix("/index").strip("./")
    return name.replace("/", ".")


def rust_use(path: str, target: str) -> str:
    """crate:: counts from the source folder, self:: from the file's folder."""
    folder, parts = path.split("/"), target.split("::")
    if parts[0] == "crate":
        root = folder.index("src") if "src" in folder else max(0, len(folder) - 2)
        parts = folder[: root + 1] + parts[1:]
    elif parts[0] == "self":
        parts = folder[:-1] + parts[1:]
    return ".".join(parts)
