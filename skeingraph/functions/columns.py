"""Column expressions for ids, dotted names and pattern matching; all run inside the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stable_id(prefix: str, *parts: Column, length: int = 12) -> Column:
    """prefix_ and the first digits of the SHA-1 of the parts, joined by the unit separator; a null part is `None`."""
    joined = F.concat_ws(UNIT, *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(joined), 1, length))


def stable_id_of(prefix: str, *parts: object, length: int = 12) -> str:
    """The same for plain values."""
    return f"{prefix}_{hashlib.sha1(UNIT.join(map(str, parts)).encode()).hexdigest()[:length]}"


def last_part(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def module_scope(fqname: Column) -> Column:
    """A name without its last part; names of one or two parts stay."""
    parts = F.split(fqname, r"\.")
    return F.when(F.size(parts) <= 2, fqname).otherwise(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "."))


def dotted_suffixes(fqname: Column) -> Column:
    """All suffixes that begin after a dot, and the whole name."""
    parts = F.split(fqname, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def normal_symbol(name: Column) -> Column:
    """A symbol as it is looked up: names that begin with a dot lose the dots at both ends."""
    return F.when(name.startswith("."), F.regexp_replace(name, r"^\.+|\.+$", "")).otherwise(name)


def fold(text: Column) -> Column:
    """Lower case for ASCII letters only."""
    return F.translate(text, UPPER, LOWER)


def like_pattern(query: str) -> tuple[str, str]:
    """(pattern, escape) for `contains query`, where % and _ in the query stay wildcards and nothing escapes."""
    escape = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in query)
    return "%" + query.translate(str.maketrans(UPPER, LOWER)) + "%", escape


def contains_like(column: Column, query: str) -> Column:
    """ASCII-case-insensitive LIKE '%query%'; a null column gives null."""
    pattern, escape = like_pattern(query)
    return F.like(fold(column), F.lit(pattern), F.lit(escape))


def percentile_nearest(column: str, percent: int) -> Column:
    """The nearest-rank percentile of a group: the value at rank ceil(percent / 100 * n)."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {column})")
