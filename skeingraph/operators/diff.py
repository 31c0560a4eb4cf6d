"""Differences: of file fingerprints, and of a new graph against the stored one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeingraph.functions.columns import stable_id

#: Columns that don't decide whether a row has changed.
BOOKKEEPING = ("created_at", "updated_at", "version", "history_ref", "status")


def fingerprint_diff(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(file_path, change) from current (file_path, size, mtime_ns) and cached rows: added, deleted,
    same (equal size and time) or suspect (to be decided by content hash)."""
    c, o = current.select("file_path", F.col("size").alias("s1"), F.col("mtime_ns").alias("m1"), F.lit(True).alias("now")), cached.select("file_path", F.col("size").alias("s2"), F.col("mtime_ns").alias("m2"), F.lit(True).alias("before"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "deleted").when((F.col("s1") == F.col("s2")) & (F.col("m1") == F.col("m2")), "same").otherwise("suspect")
    return c.join(o, "file_path", "full_outer").select("file_path", change.alias("change"))


def ordered(value: Column, kind: T.DataType) -> Column:
    """The value with each map, at any depth, as its entries in key order; nulls stay null."""
    if isinstance(kind, T.MapType):
        return F.transform(F.array_sort(F.map_keys(value)), lambda k: F.struct(k.alias("k"), ordered(F.element_at(value, k), kind.valueType).alias("v")))
    if isinstance(kind, T.ArrayType) and "map<" in kind.simpleString():
        return F.transform(value, lambda x: ordered(x, kind.elementType))
    if isinstance(kind, T.StructType) and "map<" in kind.simpleString():
        return F.when(value.isNotNull(), F.struct(*(ordered(value[f.name], f.dataType).alias(f.name) for f in kind)))
    return value


def content_of(columns: list[str], schema: T.StructType) -> Column:
    """A digest of a row without bookkeeping; nulls count as values, maps by their entries in key order."""
    return F.sha2(F.to_json(F.struct(*(ordered(F.col(c), schema[c].dataType).alias(c) for c in columns)), {"ignoreNullFields": "false"}), 256)


def graph_diff(new: DataFrame, stored_rows: DataFrame, key: str) -> DataFrame:
    """Every row of either side once, with op: create, update, restore, delete, or null if nothing
    changed (a row that was deleted and stays so counts as unchanged)."""
    columns = [c for c in new.columns if c not in BOOKKEEPING]
    n = new.select(F.col(key).alias("__k"), F.struct(*new.columns).alias("n"), content_of(columns, new.schema).alias("c1"))
    o = stored_rows.select(F.col(key).alias("__k"), F.struct(*new.columns).alias("o"), content_of(columns, stored_rows.schema).alias("c2"))
    had, has = F.col("o").isNotNull(), F.col("n").isNotNull()
    op = F.when(has & ~had, "create").when(has & (F.col("o.status") != "active"), "restore").when(has & (F.col("c1") != F.col("c2")), "update").when(had & ~has & (F.col("o.status") == "active"), "delete")
    return n.join(o, "__k", "full_outer").withColumn("op", op)


def applied(diff: DataFrame, columns: list[str], now: str) -> DataFrame:
    """The current table after a diff: versions go up with each change, creation times stay, rows that
    are gone become tombstones."""
    def value(c: str) -> Column:
        n, o = F.col(f"n.{c}"), F.col(f"o.{c}")
        op = F.col("op")
        if c == "version":
            return F.when(op == "create", n).when(op.isNotNull(), o + 1).otherwise(o)
        if c == "created_at":
            return F.coalesce(o, n)
        if c == "updated_at":
            return F.when(op.isNotNull(), F.lit(now)).otherwise(o)
        if c == "status":
            return F.when(op == "delete", "deleted").when(op.isNull(), o).otherwise(n)
        return F.when(F.col("n").isNotNull(), n).otherwise(o)

    return diff.select(*(value(c).alias(c) for c in columns), "op")


def stats(ops: DataFrame) -> DataFrame:
    """One row (created, updated, deleted) of rows with op; a restored row counts as updated."""
    op = F.col("op")
    return ops.agg(F.count_if(op == "create").alias("created"), F.count_if(op.isin("update", "restore")).alias("updated"), F.count_if(op == "delete").alias("deleted"))


def events(diff: DataFrame, entity: str, key: str, run_id: str, repo_id: str, now: str, actor: str = "indexer") -> DataFrame:
    """A history row for each change."""
    changed = diff.where("op IS NOT NULL")
    return changed.select(
        stable_id("evt", F.lit(run_id), F.lit(entity), F.col(key), F.col("op"), length=20).alias("event_id"), F.lit(entity).alias("entity_type"), F.col(key).alias("entity_id"), F.lit(repo_id).alias("repo_id"), "op",
        F.concat(F.lit(f"{entity} "), "op").alias("reason"), F.lit(actor).alias("actor"), F.lit(now).alias("timestamp"), F.expr("cast(map() as map<string,string>)").alias("patch"),
    )


def preserved(parsed: DataFrame, old: DataFrame) -> DataFrame:
    """(file_path, source, parse_status) for changed files from parsed (file_path, has_error) and the
    files known before: a file that no longer parses keeps what it had."""
    j = parsed.join(old.select("file_path", F.lit(True).alias("known")), "file_path", "left")
    keep = F.col("has_error") & F.col("known").isNotNull()
    return j.select("file_path", F.when(keep, "old").otherwise("new").alias("source"), F.when(keep, "error_preserved").when(F.col("has_error"), "error").otherwise("ok").alias("parse_status"))
