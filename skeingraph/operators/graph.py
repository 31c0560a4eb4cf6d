"""Symbol and graph queries over node and edge tables.

Edges are one table, or the same rows clustered twice (`Edges`): by source and by target. A look-up
from one end then reads few row groups of the copy for that end; a single table is scanned.
Walks over the graph keep their frontier in the shared folder, join it with the edges and drop what
was seen, hop by hop; frontiers are counted, and broadcast only below a bound.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeingraph.functions.columns import contains_like
from skeingraph.runtime import stored

SUMMARY = ("node_id", "fqname", "kind", "language", "name", "file_path", "span", "signature")
STRATEGIES = ("fqname_exact", "name_exact", "file_exact", "fuzzy")
#: Frontiers up to so many ids are broadcast; larger ones are joined by shuffle.
SMALL = 20_000
#: So many ids are named in the filter, which Parquet then compares with the bounds of row groups.
NAMED = 10


class Edges(NamedTuple):
    """The same edges, clustered by src_id and by dst_id."""

    by_src: DataFrame
    by_dst: DataFrame


def clustered(rows: DataFrame, key: str) -> DataFrame:
    """Rows in ranges of the key, sorted within them, as tables for look-ups are written."""
    return rows.repartitionByRange(key).sortWithinPartitions(key)


def one_table(edges: DataFrame | Edges) -> DataFrame:
    return edges.by_src if isinstance(edges, Edges) else edges


def active(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'active'")


def matches(query: str) -> Column:
    """Whether name, qualified name or path contains the query; a null path doesn't."""
    return F.coalesce(contains_like(F.col("name"), query), F.lit(False)) | F.coalesce(contains_like(F.col("fqname"), query), F.lit(False)) | F.coalesce(contains_like(F.col("file_path"), query), F.lit(False))


def exactness(query: str) -> Column:
    return F.when(F.col("name") == query, 0).when(F.col("fqname") == query, 1).otherwise(2)


def file_rank() -> Column:
    return F.when(F.col("kind") == "file", 0).when(F.col("kind") == "module", 1).otherwise(2)


def search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Active nodes that contain the query; exact names first, then exact qualified names, then short ones."""
    return active(nodes).where(matches(query)).orderBy(exactness(query), F.length("fqname"), "fqname", "node_id").limit(limit)


def find_nodes(nodes: DataFrame, query: str, strategy: str, limit: int = 20) -> DataFrame:
    """Active nodes by one of STRATEGIES."""
    path = query.replace("\\", "/")
    if strategy in ("fqname_exact", "name_exact"):
        return active(nodes).where(F.col(strategy.removesuffix("_exact")) == query).orderBy("fqname", "node_id").limit(limit)
    if strategy == "file_exact":
        return active(nodes).where((F.col("file_path") == path) | (F.col("fqname") == path)).orderBy(file_rank(), "fqname", "node_id").limit(limit)
    if strategy == "fuzzy":
        return active(nodes).where(matches(path)).orderBy(exactness(query), F.length("fqname"), "fqname", "node_id").limit(limit)
    raise ValueError(f"unknown node search strategy: {strategy}")


def candidates(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """What the first strategy that finds anything finds, at most limit + 1 rows, with their place
    and the number of the strategy (tier). One scan: each node gets the tier of its best match."""
    query = query.strip()
    path = query.replace("\\", "/")
    tier = F.when(F.col("fqname") == query, 0).when(F.col("name") == query, 1).when((F.col("file_path") == path) | (F.col("fqname") == path), 2).when(matches(path), 3)
    found = active(nodes).where(F.lit(bool(query))).withColumn("tier", tier).where("tier IS NOT NULL")
    rank = [F.col("tier"), F.when(F.col("tier") == 2, file_rank()).when(F.col("tier") == 3, exactness(query)).otherwise(0), F.when(F.col("tier") == 3, F.length("fqname")).otherwise(0), F.col("fqname"), F.col("node_id")]
    top = found.orderBy(*rank).limit(limit + 1)
    few = Window.partitionBy(F.lit(1)).orderBy(*rank)  # over limit + 1 rows
    return top.withColumns({"place": F.row_number().over(few), "best": F.first("tier").over(few)}).where("tier = best").drop("best")


def incident(edges: DataFrame | Edges, node_ids: list[str], direction: str = "both", rel_types: list[str] | None = None) -> DataFrame:
    """Active edges of the nodes."""
    if direction not in ("in", "out", "both"):
        raise ValueError(f"unknown edge direction: {direction}")
    starts, ends = F.col("src_id").isin(node_ids), F.col("dst_id").isin(node_ids)
    if isinstance(edges, Edges):
        found = {"out": lambda: edges.by_src.where(starts), "in": lambda: edges.by_dst.where(ends), "both": lambda: edges.by_src.where(starts).unionAll(edges.by_dst.where(ends & ~starts))}[direction]()
    else:
        found = edges.where({"out": starts, "in": ends, "both": starts | ends}[direction])
    found = active(found)
    return found.where(F.col("rel_type").isin(rel_types)) if rel_types else found


def edges_for_node(edges: DataFrame | Edges, node_id: str, direction: str = "both", rel_types: list[str] | None = None, limit: int = 100) -> DataFrame:
    """The first edges of a node by type and id."""
    return incident(edges, [node_id], direction, rel_types).orderBy("rel_type", "edge_id").limit(limit)


def with_ends(edges: DataFrame, nodes: DataFrame, columns: tuple[str, ...] = SUMMARY) -> DataFrame:
    """Edges with src and dst as structs of node columns; of a missing node only its id is set. The
    ends are counted: few are broadcast, and the nodes are scanned once for them; many are joined by
    shuffle."""
    ids = stored(edges.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct())
    hint = F.broadcast if ids.count() <= SMALL else lambda rows: rows
    known = stored(nodes.select(*columns).join(hint(ids), "node_id", "left_semi"))
    out = edges
    for end in ("src", "dst"):
        one = known.select(F.col("node_id").alias(f"__{end}"), F.struct(*columns).alias(f"{end}_node"))
        missing = F.struct(*(F.col(f"{end}_id").alias(c) if c == "node_id" else F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in columns))
        out = out.join(hint(one), F.col(f"{end}_id") == F.col(f"__{end}"), "left").withColumn(end, F.coalesce(f"{end}_node", missing)).drop(f"__{end}", f"{end}_node")
    return out


def facts(ends: DataFrame) -> DataFrame:
    """Edges with_ends() as facts: both ends in short, confidence, the first two pieces of evidence."""
    return ends.select("edge_id", "rel_type", "src", "dst", "confidence", F.slice("evidence", 1, 2).alias("evidence"))


def file_plan(target_id: str, target: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """(file_path, priority, reason, related_nodes) of the files to read, from the target's row and
    its facts in order of type and id: the target's own file first, then callers, callees and the rest."""
    into, out = F.col("dst.node_id") == target_id, F.col("src.node_id") == target_id
    call, imports, inherits = (F.col("rel_type") == x for x in ("CALLS", "IMPORTS", "INHERITS"))
    role = (
        F.when(call & into, F.struct(F.lit(2).alias("priority"), F.lit("calls target").alias("reason"), F.col("src").alias("node")))
        .when(call & out, F.struct(F.lit(3).alias("priority"), F.lit("called by target").alias("reason"), F.col("dst").alias("node")))
        .when(imports & into, F.struct(F.lit(4).alias("priority"), F.lit("imports target").alias("reason"), F.col("src").alias("node")))
        .when(imports & out, F.struct(F.lit(4).alias("priority"), F.lit("imported by target").alias("reason"), F.col("dst").alias("node")))
        .when(inherits, F.struct(F.lit(4).alias("priority"), F.lit("inheritance relation").alias("reason"), F.when(~out, F.col("src")).otherwise(F.col("dst")).alias("node")))
    )
    others = found.withColumn("r", role).where("r IS NOT NULL").select("r.priority", "r.reason", F.col("r.node.node_id").alias("node_id"), F.col("r.node.file_path").alias("file_path"), F.struct(F.lit(1), F.col("rel_type"), F.col("edge_id")).alias("ord"))
    own = target.select(F.lit(1).alias("priority"), F.lit("target definition").alias("reason"), "node_id", "file_path", F.struct(F.lit(0), F.lit(""), F.lit("")).alias("ord"))
    rows = own.unionAll(others).where(F.coalesce("file_path", F.lit("")) != "")
    grouped = rows.groupBy("file_path").agg(F.min("priority").alias("priority"), F.sort_array(F.collect_list(F.struct("ord", "reason", "node_id"))).alias("all"))
    return grouped.select("file_path", "priority", F.array_join(F.array_distinct(F.transform("all", lambda x: x["reason"])), "; ").alias("reason"), F.array_distinct(F.transform("all", lambda x: x["node_id"])).alias("related_nodes")).orderBy("priority", "file_path").limit(limit)


def near(rows: DataFrame, key: str, ids: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """rows joined on key with the id of a stored frontier of n rows: broadcast if they are few, and
    named in the filter if they are very few."""
    if n <= NAMED:
        rows = rows.where(F.col(key).isin([r["id"] for r in ids.select("id").collect()]))
    return rows.join(F.broadcast(ids) if n <= SMALL else ids, F.col(key) == F.col("id"), how)


def neighborhood(nodes: DataFrame, edges: DataFrame | Edges, node_id: str, hops: int = 1, edge_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with their hop, edges) within some hops of a node, edges taken in both directions. An
    edge belongs if one of its ends was reached before the last hop. Deleted nodes appear if an active
    edge names them; a node that has no row doesn't."""
    both = edges if isinstance(edges, Edges) else Edges(edges, edges)
    by_src, by_dst = (active(e).where(F.col("rel_type").isin(edge_types)) if edge_types else active(e) for e in both)
    seen = stored(nodes.sparkSession.createDataFrame([(node_id, 0)], "id string, hop int"))
    frontier, n, total, touched = seen, 1, 1, None
    for hop in range(1, max(1, hops) + 1):
        ids = frontier.select("id")
        hit = stored(near(by_src, "src_id", ids, n, "left_semi").unionAll(near(by_dst, "dst_id", ids, n, "left_semi")))
        touched = hit if touched is None else touched.unionAll(hit)
        ends = hit.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
        frontier = stored(ends.join(F.broadcast(seen.select("id")) if total <= SMALL else seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        n = frontier.count()
        if not n:
            break
        seen, total = seen.unionAll(frontier), total + n
    return near(nodes, "node_id", seen, total).drop("id"), touched.dropDuplicates(["edge_id"])


def path_to_any(edges: DataFrame | Edges, src_id: str, dst_ids: list[str], max_hops: int = 2) -> dict:
    """The path of fewest hops along active edges of all types from a node to any of the others; among
    these the one whose list of edge ids is smallest. A path from a node to itself needs a cycle.

    Both ends are walked towards each other, the smaller frontier first, so that hubs are entered
    late. The state of a walk is the smallest path of each node that it has reached."""
    both = edges if isinstance(edges, Edges) else Edges(edges, edges)
    start = lambda ids: stored(both.by_src.sparkSession.createDataFrame([(i, [], [i]) for i in ids], "id string, edges array<string>, nodes array<string>"))
    rows = {"src_id": both.by_src, "dst_id": both.by_dst}
    frontier = {"src_id": start([src_id]), "dst_id": start(dst_ids)}
    size = {"src_id": 1, "dst_id": len(dst_ids)}
    seen = {end: (f.select("id"), size[end]) for end, f in frontier.items()}
    for _ in range(max_hops):
        end, other = ("src_id", "dst_id") if size["src_id"] <= size["dst_id"] else ("dst_id", "src_id")
        add = F.array_append if end == "src_id" else F.array_prepend
        step = near(active(rows[end]).select("edge_id", "src_id", "dst_id"), end, frontier[end], size[end]).select(F.col(other).alias("id"), add("edges", F.col("edge_id")).alias("edges"), add("nodes", F.col(other)).alias("nodes"))
        best = stored(step.groupBy("id").agg(F.min(F.struct("edges", "nodes")).alias("p")).select("id", "p.edges", "p.nodes"))
        first, last = (best, frontier[other]) if end == "src_id" else (frontier[other], best)
        meet = first.alias("a").join(F.broadcast(last.alias("b")) if size[other] <= SMALL and end == "src_id" else last.alias("b"), "id")
        hit = meet.select(F.struct(F.concat("a.edges", "b.edges").alias("edges"), F.concat("a.nodes", F.slice("b.nodes", 2, F.size("b.nodes"))).alias("nodes")).alias("p")).agg(F.min("p")).first()[0]
        if hit:
            return {"nodes": list(hit["nodes"]), "edges": list(hit["edges"]), "found": True}
        known, total = seen[end]
        frontier[end] = stored(best.join(F.broadcast(known) if total <= SMALL else known, "id", "left_anti"))
        size[end] = frontier[end].count()
        if not size[end]:
            break
        seen[end] = known.unionAll(frontier[end].select("id")), total + size[end]
    return {"nodes": [], "edges": [], "found": False}


def shortest_path(edges: DataFrame | Edges, src_id: str, dst_id: str, max_hops: int = 2) -> dict:
    """path_to_any() for one target."""
    return path_to_any(edges, src_id, [dst_id], max_hops)
