"""Composed agent queries as frames: resolve, then incident edges, facts and the files to read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

from skeingraph.operators import graph
from skeingraph.runtime import stored

CANDIDATES, FACTS, FILES = 10, 40, 10
IMPACT = ("CALLS", "IMPORTS", "INHERITS")
#: Direction and edge types of each query.
SHAPES = {"who_calls": ("in", ("CALLS",)), "calls": ("out", ("CALLS",)), "impact": ("both", IMPACT), "read_plan": ("both", IMPACT), "pack": ("both", IMPACT)}


@dataclass
class Resolved:
    status: str
    rows: list[Row]
    truncated: bool


def cut(rows: DataFrame, limit: int) -> tuple[int, bool]:
    """How many of the rows a limit returns, and whether there are more: at most limit + 1 are read."""
    n = rows.limit(limit + 1).count()
    return min(n, limit), n > limit


def resolve(nodes: DataFrame, query: str, limit: int = CANDIDATES) -> Resolved:
    """ok with one row, ambiguous with several, or not_found; at most limit + 1 rows are read."""
    rows = sorted(graph.candidates(nodes, query, limit).collect(), key=lambda r: r["place"])
    status = "not_found" if not rows else "ok" if len(rows[:limit]) == 1 else "ambiguous"
    return Resolved(status, rows[:limit], len(rows) > limit)


@dataclass
class Answer:
    resolved: Resolved
    facts: DataFrame | None = None
    files: DataFrame | None = None


def ask(nodes: DataFrame, edges: DataFrame | graph.Edges, command: str, query: str, fact_limit: int = FACTS, file_limit: int = FILES) -> Answer:
    """facts has up to fact_limit + 1 rows and files up to file_limit + 1, so that a cut shows; the
    files come from the first fact_limit facts."""
    found = resolve(nodes, query)
    if found.status != "ok":
        return Answer(found)
    direction, types = SHAPES[command]
    target = found.rows[0]["node_id"]
    hit = stored(graph.edges_for_node(edges, target, direction, list(types), fact_limit + 1))
    ends = stored(graph.with_ends(hit, nodes))
    own = nodes.sparkSession.createDataFrame([(target, found.rows[0]["file_path"])], "node_id string, file_path string")
    return Answer(found, graph.facts(ends), graph.file_plan(target, own, ends.orderBy("rel_type", "edge_id").limit(fact_limit), file_limit + 1))
