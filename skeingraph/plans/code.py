"""Made-up code over the star-schema tables, so that extractors and linker run over whole tables.

As observations: a file and a module for each part, supplier, customer and order. A part's module has
a function of its own and one named `go`; a supplier's module a class that inherits that of the
supplier of half its key, or, if the key is a multiple of five, one that is nowhere. A customer's
module calls its own name, which is also that of its function: a guess. An order's module has a
function `run`; each of its lines is an import of the part's function by an alias, and a call, by
the line's number modulo 4: of the alias, of the supplier's class, of the next line's alias, which
is only imported later, or of `go`, which is ambiguous.

As sources: a file for each part, in one of four languages, whose function calls another one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.functions.schemas import OBSERVATION, RAW
from skeingraph.plans.starmap import sql_id, table

REPO = "code"
#: table, key, folder, first letter of modules
UNITS = (("part", "p_partkey", "parts", "p"), ("supplier", "s_suppkey", "sup", "s"), ("customer", "c_custkey", "cust", "c"), ("orders", "o_orderkey", "ord", "o"))


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def row(at: Column, order: Column, kind: str, name: Column, fqname: Column, parent: Column | None = None, target: Column | None = None, module: Column | None = None) -> list[Column]:
    """One observation of file `at`, in the columns of OBSERVATION."""
    none = F.lit(None).cast("string")
    raw = F.struct(F.lit("python").alias("language"), F.lit("python_ast").alias("parser"), (none if module is None else module).alias("module"), *(none.alias(c) for c in ("class_fqname", "alias", "style")), F.lit(None).cast("int").alias("level"), none.alias("message"))
    values = {"ord": order.cast("bigint"), "kind": F.lit(kind), "repo_id": F.lit(REPO), "file_path": at, "name": name, "fqname": fqname, "parent": none if parent is None else parent, "target": none if target is None else target, "raw": raw.cast(RAW)}
    return [c.alias(n) for n, c in values.items()]


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations of the made-up code."""
    rows = []
    for name, key, folder, letter in UNITS:
        t, k = table(spark, sf_dir, name), F.col(key)
        at, module = text(f"{folder}/", k, ".py"), text(f"{folder}.{letter}", k)
        rows += [t.select(*row(at, F.lit(0), "file", text(k, ".py"), at)), t.select(*row(at, F.lit(1), "module", module, module, at))]
        if name == "part":
            rows += [t.select(*row(at, F.lit(2), "function", text("f", k), text(module, ".f", k), module)), t.select(*row(at, F.lit(3), "function", F.lit("go"), text(module, ".go"), module))]
        elif name == "supplier":
            half = F.floor(k / 2).cast("bigint")
            base = F.when(k % 5 == 0, F.lit("Missing")).otherwise(text("sup.s", half, ".S", half))
            rows += [t.select(*row(at, F.lit(2), "class", text("S", k), text(module, ".S", k), module)), t.select(*row(at, F.lit(3), "inherit", text("S", k), text(module, ".S", k), target=base))]
        elif name == "customer":
            rows += [t.select(*row(at, F.lit(2), "function", text("c", k), text(module, ".c", k), module)), t.select(*row(at, F.lit(3), "call", module, module, target=module, module=module))]
        else:
            rows.append(t.select(*row(at, F.lit(2), "function", F.lit("run"), text(module, ".run"), module)))
    l, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    at, module = text("ord/", F.col("l_orderkey"), ".py"), text("ord.o", F.col("l_orderkey"))
    alias = lambda line: text("a", line, "x", F.col("l_partkey"))  # noqa: E731 (numbers of lines repeat within an order)
    called = F.when(n % 4 == 0, alias(n)).when(n % 4 == 1, text("S", F.col("l_suppkey"))).when(n % 4 == 2, alias(n + 1)).otherwise("go")
    rows.append(l.select(*row(at, 2 * n + 2, "import", alias(n), module, target=text("parts.p", F.col("l_partkey"), ".f", F.col("l_partkey")))))
    rows.append(l.select(*row(at, 2 * n + 3, "call", called, text(module, ".run"), target=called, module=module)))
    return spark.createDataFrame([], OBSERVATION).unionByName(reduce(DataFrame.unionAll, rows), allowMissingColumns=True)


def node(kind: str, fqname: str, path: str) -> str:
    return sql_id("node", f"'{REPO}'", f"'{kind}'", fqname, path)


def units(select: str) -> str:
    """SQL of a SELECT for each unit, with its key k, module m, file f."""
    return " UNION ALL ".join(f"SELECT {select} FROM (SELECT {key} AS k, '{folder}.{letter}' || {key} AS m, '{folder}/' || {key} || '.py' AS f, '{name}' AS t FROM {name})" for name, key, folder, letter in UNITS)


ROOT = sql_id("node", f"'{REPO}'", "'repository'")
SQL_CODE = f"""
u AS ({units("*")}),
d AS (
  SELECT k, t, f, m, 'function' AS kind, CASE t WHEN 'part' THEN 'f' || k WHEN 'customer' THEN 'c' || k ELSE 'run' END AS name FROM u WHERE t <> 'supplier'
  UNION ALL SELECT k, t, f, m, 'class', 'S' || k FROM u WHERE t = 'supplier'
  UNION ALL SELECT k, t, f, m, 'function', 'go' FROM u WHERE t = 'part'),
code_nodes AS (
  SELECT {ROOT} AS node_id, 'repository' AS kind, '{REPO}' AS name, '{REPO}' AS fqname, NULL AS file_path, NULL AS parent_id
  UNION ALL SELECT {node("file", "f", "f")}, 'file', k || '.py', f, f, {ROOT} FROM u
  UNION ALL SELECT {node("module", "m", "f")}, 'module', m, m, f, {node("file", "f", "f")} FROM u
  UNION ALL SELECT CASE kind WHEN 'class' THEN {node("class", "m || '.' || name", "f")} ELSE {node("function", "m || '.' || name", "f")} END, kind, name, m || '.' || name, f, {node("module", "m", "f")} FROM d),
part_f AS (SELECT node_id, fqname, file_path, name FROM code_nodes WHERE kind = 'function' AND name <> 'go'),
lines AS (SELECT l_orderkey, l_linenumber, {node("module", "'ord.o' || l_orderkey", "'ord/' || l_orderkey || '.py'")} AS m, {node("function", "'ord.o' || l_orderkey || '.run'", "'ord/' || l_orderkey || '.py'")} AS r,
  {node("function", "'parts.p' || l_partkey || '.f' || l_partkey", "'parts/' || l_partkey || '.py'")} AS p, {node("class", "'sup.s' || l_suppkey || '.S' || l_suppkey", "'sup/' || l_suppkey || '.py'")} AS s FROM lineitem),
code_raw AS (
  SELECT parent_id AS src_id, node_id AS dst_id, 'CONTAINS' AS rel_type FROM code_nodes WHERE parent_id IS NOT NULL
  UNION ALL SELECT parent_id, node_id, 'DEFINES' FROM code_nodes WHERE kind IN ('function', 'class')
  UNION ALL SELECT a.node_id, b.node_id, 'INHERITS' FROM code_nodes a JOIN code_nodes b ON a.kind = 'class' AND b.kind = 'class' AND substr(a.name, 2)::BIGINT % 5 <> 0 AND substr(b.name, 2)::BIGINT = substr(a.name, 2)::BIGINT // 2
  UNION ALL SELECT {node("module", "m", "f")}, {node("function", "m || '.c' || k", "f")}, 'MAY_CALL' FROM u WHERE t = 'customer'
  UNION ALL SELECT m, p, 'IMPORTS' FROM lines
  UNION ALL SELECT r, CASE l_linenumber % 4 WHEN 0 THEN p ELSE s END, 'CALLS' FROM lines WHERE l_linenumber % 4 < 2)"""

EDGES_SQL = f"""WITH {SQL_CODE}, g AS (SELECT src_id, dst_id, rel_type, count(*) AS frequency FROM code_raw GROUP BY ALL)
SELECT {sql_id("edge", "src_id", "dst_id", "rel_type")} AS edge_id, src_id, dst_id, rel_type, frequency,
  CASE rel_type WHEN 'CALLS' THEN 0.85 WHEN 'MAY_CALL' THEN 0.45 WHEN 'IMPORTS' THEN 0.9 WHEN 'INHERITS' THEN 0.95 ELSE 1.0 END::DOUBLE AS confidence,
  CASE rel_type WHEN 'CALLS' THEN 'ast_call' WHEN 'MAY_CALL' THEN 'ast_call_unresolved' WHEN 'IMPORTS' THEN 'ast_import' WHEN 'INHERITS' THEN 'ast_inherit' WHEN 'DEFINES' THEN 'ast_define'
    ELSE CASE n.kind WHEN 'file' THEN 'file_scan' WHEN 'module' THEN 'module_path' ELSE 'ast_parent' END END AS first_evidence
FROM g JOIN code_nodes n ON n.node_id = dst_id"""
NODES_SQL = f"WITH {SQL_CODE} SELECT node_id, kind, name, fqname, file_path, parent_id FROM code_nodes"


# ---- sources

#: language, ending, and a file's text: a function that calls another one, on the second line.
SOURCES = (
    ("python", "py", "def f{k}(x):\n    return g{k}(x)\n"),
    ("javascript", "js", "function f{k}(x) {\n  return g{k}(x);\n}\n"),
    ("go", "go", "package p\nfunc f{k}(x int) int { return g{k}(x) }\n"),
    ("rust", "rs", "fn f{k}(x: i32) -> i32 {\n    g{k}(x)\n}\n"),
)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, content) of a file for each part; the language follows from the key."""
    k = F.col("p_partkey")
    which = lambda i: F.element_at(F.array(*(F.lit(s[i]) for s in SOURCES)), (k % len(SOURCES)).cast("int") + 1)
    return table(spark, sf_dir, "part").select(text("src/m", k, ".", which(1)).alias("file_path"), F.replace(which(2), F.lit("{k}"), k.cast("string")).cast("binary").alias("content"))


SOURCES_SQL = (
    "WITH s AS (SELECT p_partkey AS k, p_partkey % 4 AS i, 'src/m' || p_partkey || '.' || (['py', 'js', 'go', 'rs'])[p_partkey % 4 + 1] AS f FROM part)"
    " SELECT f AS file_path, (['python', 'javascript', 'go', 'rust'])[i + 1] AS language, 'file' AS kind, NULL AS target FROM s"
    " UNION ALL SELECT f, (['python', 'javascript', 'go', 'rust'])[i + 1], 'module', NULL FROM s UNION ALL SELECT f, (['python', 'javascript', 'go', 'rust'])[i + 1], 'function', NULL FROM s"
    " UNION ALL SELECT f, (['python', 'javascript', 'go', 'rust'])[i + 1], 'call', 'g' || k FROM s"
)
