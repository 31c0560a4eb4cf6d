"""Each query of the engine against its SQL on the smallest tables; graph edge cases."""

import pytest
from oracle import compare

from skeingraph.functions.columns import contains_like
from skeingraph.operators import graph
from skeingraph.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(QUERIES[name](spark, DATA), SQL[name], DATA)


def test_like(spark):
    rows = spark.createDataFrame([("Straße_A",), ("strabe-a",), ("ÄB",), ("a%b",), (None,)], "v string")
    hit = lambda q: [r["v"] for r in rows.where(contains_like(rows["v"], q)).collect()]
    assert hit("STRA") == ["Straße_A", "strabe-a"] and hit("äb") == [] and hit("ÄB") == ["ÄB"] and hit("a%b") == ["strabe-a", "a%b"] and hit("e_a") == ["Straße_A", "strabe-a"] and hit("\\") == []


def test_walks(spark):
    names = "abcdef"
    nodes = spark.createDataFrame([(n, n, n, "function", "x", f"{n}.py", None, None, "active") for n in names], "node_id string, name string, fqname string, kind string, language string, file_path string, span string, signature string, status string")
    pairs = [("1", "a", "b"), ("2", "b", "c"), ("3", "c", "a"), ("4", "c", "d"), ("5", "a", "e"), ("6", "e", "c"), ("7", "f", "f"), ("8", "d", "zz")]
    edges = spark.createDataFrame([(i, s, d, "CALLS", 0.85, "active") for i, s, d in pairs] + [("9", "a", "d", "CALLS", 0.85, "deleted")], "edge_id string, src_id string, dst_id string, rel_type string, confidence double, status string")
    path = lambda a, b, n: graph.shortest_path(edges, a, b, n)["edges"]
    assert path("a", "c", 2) == ["1", "2"] and path("a", "d", 2) == [] and path("a", "d", 3) == ["1", "2", "4"] and path("a", "a", 3) == ["1", "2", "3"] and path("f", "f", 1) == ["7"] and path("a", "b", 0) == [] and path("b", "b", 2) == []
    reach = lambda n, h, t=None: ({r["node_id"]: r["hop"] for r in graph.neighborhood(nodes, edges, n, h, t)[0].collect()}, {r["edge_id"] for r in graph.neighborhood(nodes, edges, n, h, t)[1].collect()})
    assert reach("d", 1) == ({"d": 0, "c": 1}, {"4", "8"}) and reach("d", 0) == reach("d", 1)
    assert reach("d", 2) == ({"d": 0, "c": 1, "a": 2, "b": 2, "e": 2}, {"2", "3", "4", "6", "8"})
    assert reach("a", 1, ["IMPORTS"]) == ({"a": 0}, set())
    with pytest.raises(ValueError):
        graph.edges_for_node(edges, "a", "sideways")
    with pytest.raises(ValueError):
        graph.find_nodes(nodes, "a", "guess")


def test_maps_are_compared_by_their_entries(spark):
    from skeingraph.operators import diff

    schema = "id string, status string, m map<string,double>, e array<struct<t:string,data:map<string,string>>>"
    old = spark.createDataFrame([("a", "active", {"x": 1.0, "y": 2.0}, [("t", {"k": "1", "l": None})]), ("b", "active", None, None), ("c", "active", {"x": 1.0}, [(None, None)])], schema)
    new = spark.createDataFrame([("a", "active", {"y": 2.0, "x": 1.0}, [("t", {"l": None, "k": "1"})]), ("b", "active", None, None), ("c", "active", {"x": 1.0}, [(None, {})])], schema)
    assert {r["__k"]: r["op"] for r in diff.graph_diff(new, old, "id").collect()} == {"a": None, "b": None, "c": "update"}


def test_paths_to_several_targets(spark):
    import random

    rng = random.Random(7)
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(70)})
    rows = [(f"e{rng.randrange(10**6):06}", f"n{a}", f"n{b}", "CALLS", "active") for a, b in pairs]
    edges = spark.createDataFrame(rows, "edge_id string, src_id string, dst_id string, rel_type string, status string")

    def brute(src, targets, most):
        paths = [((), src)]
        for _ in range(most):
            paths = [((*p, e), d) for p, at in paths for e, s, d, _, _ in rows if s == at]
            hits = [list(p) for p, at in paths if at in targets]
            if hits:
                return min(hits)
        return []

    found = 0
    for k in range(6):
        src, targets = f"n{rng.randrange(40)}", [f"n{x}" for x in rng.sample(range(40), 1 + k % 3)]
        src = targets[0] if k == 5 else src
        want = brute(src, targets, 4)
        found += bool(want)
        assert graph.path_to_any(graph.Edges(edges, edges) if k % 2 else edges, src, targets, 4)["edges"] == want
    assert found > 2
