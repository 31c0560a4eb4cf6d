"""A code graph over the star-schema tables, so that the graph operators run on plain Parquet.

region > nation > customer / supplier by CONTAINS; customer > order by CONTAINS; an order CALLS its
parts (evidence: its lines) and IMPORTS its suppliers; a part INHERITS its brand.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.functions.columns import stable_id
from skeingraph.operators.graph import Edges, clustered
from skeingraph.runtime import delete_at_exit, shared_dir, stored

REPO = "star"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, fqname: Column, path: Column) -> Column:
    return stable_id("node", F.lit(REPO), F.lit(kind), fqname, path)


def entities(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """(key, kind, name, fqname, file_path, parent key) of each entity type."""
    t = lambda n: table(spark, sf_dir, n)
    s = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    region = t("region").select(F.col("r_regionkey").alias("key"), F.lit("module").alias("kind"), F.col("r_name").alias("name"), F.col("r_name").alias("fqname"), s("geo/", F.col("r_name")).alias("file_path"))
    nation = t("nation").join(F.broadcast(region.select(F.col("key").alias("n_regionkey"), F.col("fqname").alias("up"))), "n_regionkey").select(
        F.col("n_nationkey").alias("key"), F.lit("class").alias("kind"), F.col("n_name").alias("name"), s(F.col("up"), ".", F.col("n_name")).alias("fqname"), s("geo/", F.col("up"), "/", F.col("n_name")).alias("file_path"), F.col("n_regionkey").alias("parent"),
    )
    place = F.broadcast(nation.select(F.col("key").alias("parent"), F.col("fqname").alias("up"), F.col("file_path").alias("dir")))

    def people(name: str, p: str, key: str, kind: str) -> DataFrame:
        return t(name).select(F.col(f"{p}_{key}").alias("key"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("parent")).join(place, "parent").select(
            "key", F.lit(kind).alias("kind"), "name", s(F.col("up"), ".", F.col("name")).alias("fqname"), s(F.col("dir"), f"/{name}").alias("file_path"), "parent",
        )

    brand = t("part").select(F.col("p_brand").alias("key")).distinct().select("key", F.lit("trait").alias("kind"), F.col("key").alias("name"), s("brands.", F.col("key")).alias("fqname"), s("brands/", F.col("key")).alias("file_path"))
    part = t("part").select(F.col("p_partkey").alias("key"), F.lit("function").alias("kind"), F.col("p_name").alias("name"), s("brands.", F.col("p_brand"), ".", F.col("p_name")).alias("fqname"), s("parts/", F.col("p_partkey")).alias("file_path"), F.col("p_brand").alias("parent"))
    order = t("orders").select(F.col("o_orderkey").alias("key"), F.lit("method").alias("kind"), s("order", F.col("o_orderkey")).alias("name"), s("orders.", F.col("o_orderkey")).alias("fqname"), s("orders/", F.col("o_custkey")).alias("file_path"), F.col("o_custkey").alias("parent"))
    out = {"region": region, "nation": nation, "customer": people("customer", "c", "custkey", "struct"), "supplier": people("supplier", "s", "suppkey", "interface"), "brand": brand, "part": part, "orders": order}
    return {k: v.withColumn("node_id", stable_id("node", F.lit(REPO), F.col("kind"), F.col("fqname"), F.col("file_path"))) for k, v in out.items()}


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [e.select("node_id", "kind", "name", "fqname", "file_path") for e in entities(spark, sf_dir).values()]
    empty = F.lit(None).cast("string")
    return reduce(DataFrame.unionAll, each).withColumns({"language": F.lit("star"), "span": empty, "signature": empty, "status": F.lit("active")})


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, src_id, dst_id, rel_type, confidence, frequency, evidence, status)."""
    e = entities(spark, sf_dir)
    ids = {k: v.select(F.col("key").alias(f"{k}_key"), F.col("node_id").alias(f"{k}_id")) for k, v in e.items()}

    def child(name: str, parent: str, rel: str, up: bool = False) -> DataFrame:
        own = e[name].select(F.col("node_id").alias("own"), F.col("parent").alias(f"{parent}_key")).join(ids[parent], f"{parent}_key")
        src, dst = ("own", f"{parent}_id") if up else (f"{parent}_id", "own")
        return own.select(F.col(src).alias("src_id"), F.col(dst).alias("dst_id"), F.lit(rel).alias("rel_type"), F.lit(1).cast("bigint").alias("frequency"), F.array(F.lit("0")).alias("evidence"))

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orders_key"), F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supplier_key"), "l_linenumber")

    def used(name: str, rel: str) -> DataFrame:
        g = lines.groupBy("orders_key", f"{name}_key").agg(F.count("*").alias("frequency"), F.transform(F.slice(F.sort_array(F.collect_list("l_linenumber")), 1, 2), lambda x: x.cast("string")).alias("evidence"))
        return g.join(ids["orders"], "orders_key").join(ids[name], f"{name}_key").select(F.col("orders_id").alias("src_id"), F.col(f"{name}_id").alias("dst_id"), F.lit(rel).alias("rel_type"), "frequency", "evidence")

    parts = [child("nation", "region", "CONTAINS"), child("customer", "nation", "CONTAINS"), child("supplier", "nation", "CONTAINS"), child("orders", "customer", "CONTAINS"), child("part", "brand", "INHERITS", up=True), used("part", "CALLS"), used("supplier", "IMPORTS")]
    rows = reduce(DataFrame.unionAll, parts)
    sure = F.when(F.col("rel_type") == "CALLS", 0.85).when(F.col("rel_type") == "IMPORTS", 0.9).when(F.col("rel_type") == "INHERITS", 0.95).otherwise(1.0)
    return rows.select(stable_id("edge", F.col("src_id"), F.col("dst_id"), F.col("rel_type")).alias("edge_id"), "src_id", "dst_id", "rel_type", sure.alias("confidence"), "frequency", "evidence", F.lit("active").alias("status"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_snapshots: dict[tuple, str] = {}


def file_states(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(name, length, modification time) of the files at or below a path. Object stores have no times
    of folders, but of files."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Edges]:
    """(nodes, edges) as stored tables, as an index keeps them: built once for each state of the
    source tables' files and read again by later queries of the application."""
    key = (spark.sparkContext.applicationId, sf_dir, tuple(file_states(spark, f"{sf_dir}/{n}.parquet") for n in TABLES))
    if key not in _snapshots:
        base = os.path.join(shared_dir(spark), f"star-{uuid.uuid4().hex}")
        clustered(nodes(spark, sf_dir), "fqname").write.parquet(f"{base}/nodes")
        rows = stored(edges(spark, sf_dir))  # ranges are found by reading their rows twice
        clustered(rows, "src_id").write.parquet(f"{base}/by_src")
        clustered(rows, "dst_id").write.parquet(f"{base}/by_dst")
        delete_at_exit(spark, base)
        _snapshots[key] = base
    read = lambda n: spark.read.parquet(f"{_snapshots[key]}/{n}")
    return read("nodes"), Edges(read("by_src"), read("by_dst"))


def sql_id(prefix: str, *parts: str, length: int = 12) -> str:
    return f"'{prefix}_' || substr(sha1(" + " || chr(31) || ".join(parts) + f"), 1, {length})"


SQL_NODES = f"""
ent AS (
  SELECT 'region' AS t, r_regionkey::VARCHAR AS key, 'module' AS kind, r_name AS name, r_name AS fqname, 'geo/' || r_name AS file_path, NULL::VARCHAR AS parent FROM region
  UNION ALL SELECT 'nation', n_nationkey::VARCHAR, 'class', n_name, r_name || '.' || n_name, 'geo/' || r_name || '/' || n_name, n_regionkey::VARCHAR FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer', c_custkey::VARCHAR, 'struct', c_name, r_name || '.' || n_name || '.' || c_name, 'geo/' || r_name || '/' || n_name || '/customer', c_nationkey::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, 'interface', s_name, r_name || '.' || n_name || '.' || s_name, 'geo/' || r_name || '/' || n_name || '/supplier', s_nationkey::VARCHAR FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT 'brand', p_brand, 'trait', p_brand, 'brands.' || p_brand, 'brands/' || p_brand, NULL FROM part
  UNION ALL SELECT 'part', p_partkey::VARCHAR, 'function', p_name, 'brands.' || p_brand || '.' || p_name, 'parts/' || p_partkey, p_brand FROM part
  UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'method', 'order' || o_orderkey, 'orders.' || o_orderkey, 'orders/' || o_custkey, o_custkey::VARCHAR FROM orders),
nodes AS (SELECT {sql_id("node", f"'{REPO}'", "kind", "fqname", "file_path")} AS node_id, * FROM ent)"""

SQL_EDGES = f"""
raw AS (
  SELECT p.node_id AS src_id, c.node_id AS dst_id, 'CONTAINS' AS rel_type, 1 AS frequency, ['0'] AS evidence FROM nodes c JOIN nodes p ON p.key = c.parent AND (c.t, p.t) IN (('nation', 'region'), ('customer', 'nation'), ('supplier', 'nation'), ('orders', 'customer'))
  UNION ALL SELECT c.node_id, p.node_id, 'INHERITS', 1, ['0'] FROM nodes c JOIN nodes p ON p.key = c.parent AND c.t = 'part' AND p.t = 'brand'
  UNION ALL SELECT o.node_id, p.node_id, 'CALLS', n, ev FROM (SELECT l_orderkey, l_partkey, count(*) AS n, list_transform(list_sort(list(l_linenumber))[1:2], lambda x: x::VARCHAR) AS ev FROM lineitem GROUP BY ALL) JOIN nodes o ON o.t = 'orders' AND o.key = l_orderkey::VARCHAR JOIN nodes p ON p.t = 'part' AND p.key = l_partkey::VARCHAR
  UNION ALL SELECT o.node_id, p.node_id, 'IMPORTS', n, ev FROM (SELECT l_orderkey, l_suppkey, count(*) AS n, list_transform(list_sort(list(l_linenumber))[1:2], lambda x: x::VARCHAR) AS ev FROM lineitem GROUP BY ALL) JOIN nodes o ON o.t = 'orders' AND o.key = l_orderkey::VARCHAR JOIN nodes p ON p.t = 'supplier' AND p.key = l_suppkey::VARCHAR),
edges AS (SELECT {sql_id("edge", "src_id", "dst_id", "rel_type")} AS edge_id, src_id, dst_id, rel_type, CASE rel_type WHEN 'CALLS' THEN 0.85 WHEN 'IMPORTS' THEN 0.9 WHEN 'INHERITS' THEN 0.95 ELSE 1.0 END::DOUBLE AS confidence, frequency::BIGINT AS frequency, evidence FROM raw)"""
