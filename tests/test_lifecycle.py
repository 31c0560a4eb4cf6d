import json
import os
import subprocess
import sys

import pytest

from skeingraph import cli, mcp_server, rest
from skeingraph.plans import evaluate
from skeingraph.plans.service import Service, error_code
from skeingraph.sources import scan
from skeingraph.sources.store import IndexLockError, Lock, RepositoryBindingError, folder, inspect, load_config

FILES = {
    "app/__init__.py": "",
    "app/pay/__init__.py": "",
    "app/pay/gate.py": "class Gate:\n    def charge(self, n):\n        return n\n",
    "app/pay/check.py": "from app.pay.gate import Gate\n\n\ndef verify(order):\n    gate = Gate()\n    return gate.charge(order)\n",
    "app/order/flow.py": "from app.pay.check import verify\n\n\ndef checkout(order):\n    return verify(load(order))\n\n\ndef load(order):\n    return order\n",
    "app/user.py": "class Base:\n    def audit(self):\n        pass\n\n\nclass Admin(Base):\n    def run(self):\n        self.audit()\n        getattr(self, 'x')()\n",
    "app/_private/_hidden.py": "def secret():\n    pass\n",
    "app/broken.py": "def oops(:\n",
    "web/index.ts": "import { verify as check } from './lib/pay';\nexport function checkout(x: string) { return check(x); }\n",
    "web/lib/pay.ts": "export function verify(x: string) { return x; }\n",
    "node_modules/skip.js": "function no() {}\n",
    "notes.txt": "nothing",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def service(spark, repo):
    s = Service(spark, repo, repo_id="shop")
    s.first = s.index()
    return s


def names(facts):
    return {(f["rel_type"], f["src"].get("fqname"), f["dst"].get("fqname")) for f in facts}


def test_scan_lists_hidden_and_empty_files(spark, repo, service):
    rows = {r["file_path"]: r for r in scan.files(spark, str(repo)).collect()}
    assert set(rows) == {f for f in FILES if not f.startswith("node_modules") and not f.endswith(".txt")}
    assert rows["app/__init__.py"]["size"] == 0 and rows["app/user.py"]["mtime_ns"] == os.stat(repo / "app/user.py").st_mtime_ns


def test_index_and_queries(service):
    r = service.first
    assert (r["status"], r["mode"], r["files_scanned"], r["parse_errors"], r["backup_path"]) == ("ok", "full", 10, 1, None)
    assert r["languages"] == {"python": 8, "typescript": 2} and r["nodes_created"] == r["nodes"] and r["edges_created"] == r["edges"]
    pack = service.pack("verify")
    assert pack["status"] == "ambiguous" and {c["language"] for c in pack["candidates"]} == {"python", "typescript"} and pack["limits"]["candidates_returned"] == 2
    pack = service.pack("app.pay.check.verify")
    assert names(pack["facts"]) == {
        ("CALLS", "app.order.flow.checkout", "app.pay.check.verify"), ("CALLS", "app.pay.check.verify", "app.pay.gate.Gate"), ("CALLS", "app.pay.check.verify", "app.pay.gate.Gate.charge"), ("IMPORTS", "app.order.flow", "app.pay.check.verify"),
    }
    assert [(f["file_path"], f["priority"], f["reason"]) for f in pack["files"]] == [("app/pay/check.py", 1, "target definition"), ("app/order/flow.py", 2, "calls target; imports target"), ("app/pay/gate.py", 3, "called by target")]
    assert pack["schema_version"] == "1.0" and pack["index"]["state"] == "fresh" and pack["error"] is None and len(pack["limits"]) == 9 and pack["target"]["span"]["start_line"] == 4
    assert names(service.who_calls("web/lib/pay.ts")["facts"]) == set()
    assert names(service.who_calls("web.lib.pay.verify")["facts"]) == {("CALLS", "web.checkout", "web.lib.pay.verify")}
    assert names(service.calls("app.user.Admin.run")["facts"]) == {("CALLS", "app.user.Admin.run", "app.user.Base.audit")}
    assert names(service.impact("Base")["facts"]) == {("INHERITS", "app.user.Admin", "app.user.Base")}
    assert service.resolve("nothing.like.this")["status"] == "not_found" and service.resolve("  ")["status"] == "not_found"
    cut = service.impact("app.pay.check.verify", 2)
    assert len(cut["facts"]) == 2 and cut["limits"]["facts_truncated"] and not cut["limits"]["files_truncated"]


def test_reads(service):
    target = service.resolve("app.order.flow.checkout")["target"]["node_id"]
    goal = service.resolve("app.pay.gate.Gate.charge")["target"]["node_id"]
    path = service.path(target, goal, 2)
    assert path["found"] and len(path["edges"]) == 2 and not service.path(target, goal, 1)["found"] and not service.path(target, target, 3)["found"] and not service.path(target, goal, 0)["found"]
    near = service.neighborhood(target, 1, ["CALLS"])
    assert {n["name"] for n in near["nodes"]} == {"checkout", "verify", "load"} and len(near["edges"]) == 2 and near["partial"] is False
    assert service.node(target)["signature"] == "checkout(order)" and service.node("nope") is None and service.edge(path["edges"][0])["rel_type"] == "CALLS"
    assert [h["op"] for h in service.history(target)] == ["create"]
    assert service.search("CHECKOUT")[0]["name"] == "checkout" and service.search("app_order%flow", 50)
    assert {c["name"] for c in service.doctor()["checks"] if c["ok"]} >= {"python", "repository", "schema", "extractors"}
    assert rest.routes(service)[("GET", "/graph/path")](target, goal)["found"] and len(mcp_server.tools(service)) == 9
    with pytest.raises(rest.NotFound):
        rest.routes(service)[("GET", "/nodes/{node_id}")]("nope")


def test_update_cycle(spark, service, repo):
    before = {r["node_id"]: r for r in service.open().nodes.collect()}
    again = service.update()
    assert (again["mode"], again["files_changed"], again["nodes_updated"], again["metadata_only"]) == ("incremental", 0, 0, 0)
    n_history = service.open().history().count()
    (repo / "app/new.py").write_text("from app.order.flow import checkout\ncheckout(1)\n")
    (repo / "app/pay/gate.py").write_text("\n\nclass Gate:\n    def charge(self, n):\n        return n\n")
    (repo / "app/_private/_hidden.py").unlink()
    os.utime(repo / "app/user.py", ns=(1, 1))
    s = service.status()
    assert (s["state"], s["files_added"], s["files_changed"], s["files_deleted"], s["changed_files"]) == ("stale", 1, 1, 1, 3)
    r = service.update()
    assert (r["files_added"], r["files_changed"], r["files_deleted"]) == (1, 1, 1) and service.status()["state"] == "fresh"
    after = {x["node_id"]: x for x in service.open().nodes.collect()}
    gate = next(i for i, x in before.items() if x["fqname"] == "app.pay.gate.Gate")
    assert after[gate]["version"] == 2 and after[gate]["created_at"] == before[gate]["created_at"] and after[gate]["span"]["start_line"] == 3
    gone = [x for x in after.values() if x["fqname"].startswith("app._private._hidden") or x["fqname"] == "app/_private/_hidden.py"]
    assert len(gone) == 3 and {x["status"] for x in gone} == {"deleted"} and r["nodes_deleted"] == 3
    assert service.open().history().count() > n_history and service.resolve("secret")["status"] == "not_found"

    # an incremental index equals a full one over the same files
    full = Service(spark, repo, repo.parent / "other", "shop")
    full.index()
    keep = lambda st: {(x["edge_id"], x["frequency"]) for x in st.edges.where("status = 'active'").collect()}
    assert keep(full.open()) == keep(service.open())

    # a file that no longer parses keeps its symbols; one that comes back is restored
    (repo / "app/pay/gate.py").write_text("class Gate(:\n")
    (repo / "app/_private/_hidden.py").write_text(FILES["app/_private/_hidden.py"])
    r = service.update()
    assert r["parse_errors"] == 2 and service.resolve("app.pay.gate.Gate.charge")["status"] == "ok"
    secret = service.resolve("secret")["target"]["node_id"]
    assert [h["op"] for h in service.history(secret)] == ["create", "delete", "restore"] and service.node(secret)["version"] == 3
    assert {x["parse_status"] for x in service.open().table("files").collect()} == {"ok", "error", "error_preserved"}


def test_binding_incompatible_and_rebuild(spark, service, repo, tmp_path):
    with pytest.raises(RepositoryBindingError):
        Service(spark, repo, repo_id="else").open().bind("else", repo)
    assert Service(spark, repo).repo_id == "shop" and Service(spark, repo, repo_id="else").status()["error"]["code"] == "repository_binding_error"
    small = tmp_path / "small"
    small.mkdir()
    (small / "a.py").write_text("def a(): b()\ndef b(): pass\n")
    s = Service(spark, small)
    assert s.status()["state"] == "uninitialized" and s.resolve("a")["error"]["code"] == "index_uninitialized"
    folder(small).mkdir()
    (folder(small) / "MANIFEST.json").write_text('{"store_version": 1}')
    assert s.status()["state"] == "incompatible" and cli.main(["index", "--repo", str(small)], spark) == 1
    assert s.index(rebuild=True)["backup_path"] and inspect(small)["state"] == "initialized"
    cases = tmp_path / "cases.json"
    cases.write_text(json.dumps({"version": 1, "cases": [{"id": "ok", "query": "a.a", "target_fqname": "a.a", "required_files": ["a.py"], "required_facts": [{"rel_type": "CALLS", "src_fqname": "a.a", "dst_fqname": "a.b"}]}, {"id": "no", "command": "resolve", "query": "zzz"}]}))
    out = evaluate.run(s, cases)
    assert out["status"] == "failed" and [c["passed"] for c in out["cases"]] == [True, False] and out["cases"][1]["failures"] == ["status: expected ok, got not_found"]
    assert evaluate.percentile([], 50) == 0.0 and evaluate.percentile([4, 1, 3, 2], 50) == 2


def test_columns_of_paths(spark):
    from pyspark.sql import functions as F

    from skeingraph.sources.languages import language_column, language_of, module_column, module_of

    paths = ["a/b.py", "a/__init__.py", "__init__.py", "x/index.ts", "index.js", "a/index.py", "a.b/c.D.TSX", ".py", "a/.js", "no", "a/x.txt", "a/y.h", "s.SH", "a/b.test.js", "p.py/q"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").withColumn("l", language_column(F.col("p")))
    got = {r["p"]: (r["l"], r["m"]) for r in rows.withColumn("m", module_column(F.col("p"), F.col("l"))).collect()}
    assert {p: v[0] for p, v in got.items()} == {p: language_of(p) for p in paths}
    assert {p: v[1] for p, v in got.items() if v[0]} == {p: module_of(p, language_of(p)) for p in paths if language_of(p)}


def test_failed_run_and_plain_graph(spark, tmp_path):
    from skeingraph.functions import schemas
    from skeingraph.operators.link import link

    s = Service(spark, tmp_path).open()
    nodes, edges = link(spark.createDataFrame([], schemas.OBSERVATION), "r", "t0")
    assert s.commit_graph("r", tmp_path, nodes, edges, "t0")["nodes_created"] == 1
    s.record_failure(s.runs().first().asDict() | {"started_at": "t1"}, "no space")
    assert [(r["status"], r["error"]) for r in s.runs().collect()] == [("ok", None), ("error", "no space")] and s.nodes.count() == 1


def test_cli(spark, service, repo, tmp_path, capsys):
    assert cli.main(["init", "--repo", str(tmp_path)], spark) == 0 and load_config(tmp_path)["port"] == 8031
    capsys.readouterr()
    assert cli.main(["agent-pack", "app.pay.check.verify", "--repo", str(repo)], spark) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "ok"
    assert cli.main(["search", "x", "--repo", str(tmp_path)], spark) == 1 and cli.main(["serve", "--repo", str(repo)], spark) == 1
    assert len(cli.COMMANDS) == 19 and error_code(OSError()) == "o_s_error"


def test_lock(tmp_path):
    p = folder(tmp_path) / "index.lock"
    p.parent.mkdir()
    dead = subprocess.Popen([sys.executable, "-c", ""])
    dead.wait()
    p.write_text(f"{dead.pid}\n")
    with Lock(tmp_path):
        assert int(p.read_text()) == os.getpid()
        with pytest.raises(IndexLockError):
            Lock(tmp_path, 0.2).__enter__()
    assert not p.exists()


def test_stream_of_events(spark, tmp_path):
    from skeingraph.streaming.watch import update_on_events

    repo = tmp_path / "r"
    repo.mkdir()
    (repo / "m.py").write_text("def f(): pass\n")
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "1.json").write_text('{"file_path": "m.py"}\n')
    s = Service(spark, repo)
    seen = []
    update_on_events(spark.readStream.schema("file_path string").json(str(tmp_path / "events")), s, str(tmp_path / "cp"), lambda n, r: seen.append(r["nodes"])).awaitTermination(120)
    assert seen == [4]
