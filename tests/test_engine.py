"""A small tree and a small workspace, built and asked, with results worked out by hand."""

import json

import pytest

from graphloom.__main__ import run
from graphloom.engine import DomainError, Engine, NotBuilt, NotFound
from graphloom.workspace import Workspace, discover

TREE = {
    "src/pay/order.rs": "use crate::pay::charge;\n\npub fn order() {\n    charge();\n}\n\npub fn charge() { check(); }\n\npub fn check() {}\n",
    "src/pay/order_test.rs": "fn test_order_works() {\n    order();\n}\n",
    "src/shapes.ts": 'class Shape {}\nexport class Round extends Shape {}\napp.get("/round", draw);\nfunction draw() { draw(); }\n',
    "__main__.py": "def main():\n    order()\n",
    ".hidden/tool.py": "def tool():\n    pass\n",
    ".gitignore": "skip/\n",
    "skip/a.py": "def order(): pass\n",
    "notes.md": "no source",
}


def lay(folder, files):
    for path, text in files.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tree")
    lay(folder, TREE)
    engine = Engine(spark, str(folder))
    return folder, engine, engine.build()


def test_build(built):
    folder, engine, report = built
    assert report == {"files_parsed": 5, "files_skipped": 0, "symbols": 9, "edges": 6, "entrypoints": 2, "flows": 1, "embeddings": 9, "pages": 4, "stale_pages": 0}
    names = {r.id: r.name for r in engine.store.table("symbols").collect()}
    edges = {(names[r.src_symbol_id], names[r.dst_symbol_id], r.edge_type) for r in engine.store.table("edges").collect()}
    assert edges == {("order", "charge", "calls"), ("charge", "check", "calls"), ("test_order_works", "order", "calls"), ("main", "order", "calls"), ("order", "charge", "imports"), ("Round", "Shape", "extends")}
    assert {(names[r.symbol_id], r.kind, r.label) for r in engine.store.table("entrypoints").collect()} == {("draw", "http", "GET /round"), ("main", "main", "__main__.py")}
    assert [names[s.symbol_id] for s in engine.store.table("flows").first().steps] == ["order", "charge", "check"]
    symbols = json.loads((folder / ".graphloom/symbols.json").read_text())
    assert symbols["schemaVersion"] == "1.0.0" and len(symbols["symbols"]) == 9 and "moduleId" not in symbols["symbols"][0]
    assert {p.name for p in (folder / ".graphloom/wiki").iterdir() if p.suffix == ".md"} == {"index.md", "flow_pay.md", "service___main___py_main.md", "service_src_shapes_ts_draw.md"}


def test_questions(built):
    _, engine, _ = built
    impact = engine.impact("ORDER", 2)
    assert [engine.symbol(n).id for n in ("charge", "check")] == impact["affected_symbol_ids"] and impact["affected_modules"] == ["src/pay"] and not impact["risk_zones"]
    assert len(engine.impact("order", 0)["affected_symbol_ids"]) == 1
    assert engine.symbol("pay/order.rs::ch").name == "charge"
    assert engine.dependencies("check", 3)["upstream"] == [] and len(engine.dependencies("check", 3, upstream=True)["upstream"]) == 4
    assert engine.flow("PAY")["flow"]["name"] == "pay" and engine.flow("harg")["suggestions"] == ["charge"]
    with pytest.raises(NotFound):
        engine.symbol("nothing")
    with pytest.raises(NotFound):
        engine.page("nothing")


def test_context(built):
    _, engine, _ = built
    full = engine.context("order")
    assert [s["name"] for s in full["snippets"]][:4] == ["order", *sorted(["main", "test_order_works"], key=lambda n: engine.symbol(n).id), "charge"]
    assert full["related_tests"] == ["src/pay/order_test.rs"] and full["budget_advice"]["within_budget"] and "claim" not in full["markdown"]
    assert [line for line in full["markdown"].split("\n") if line.startswith("## ")][:3] == ["## Symbol", "## Knowledge", "## Execution path"]
    small = engine.context("order", budget=200)
    assert len(small["snippets"]) == 1 and "Budget notice" in small["markdown"] and not small["budget_advice"]["within_budget"]
    assert engine.context("order", auto_budget=True)["budget_advice"]["requested_budget"] == full["budget_advice"]["recommended_tokens"]
    plan = engine.context("order", plan=True)
    assert plan["snippets"] == [] and plan["markdown"].startswith("# Context plan: order")
    assert len(engine.context("order", task="onboard")["snippets"]) == 3


def test_pages_lint_and_prose(built):
    folder, engine, _ = built
    assert "_None detected._" in engine.page("main").body and "[Flow: pay](flow_pay.md)" in engine.page("index").body
    report = engine.lint()
    assert report["strict_ok"] and report["orphan_page_ids"] == []
    asked = []
    assert "Because $1." in engine.enrich("wiki_flow_pay", lambda p: asked.append(p) or "Because $1.").body
    assert engine.enrich("wiki_flow_pay").source == "mcp_sampling" and len(asked) == 1
    engine.sync([])
    assert "Because $1." in engine.page("wiki_flow_pay").body
    page = folder / ".graphloom/wiki/service___main___py_main.md"
    page.write_text(page.read_text().replace("see_also", "x_also").replace('graph_fingerprint = "', 'see_also = ["wiki_gone"]\ngraph_fingerprint = "0').replace("claim calls ", "claim calls 0"))
    report = engine.lint()
    assert report["stale_page_ids"] == ["wiki_service___main___py_main"] == engine.stale_queue()
    assert [e["page_id"] for e in report["claim_errors"]] == report["stale_page_ids"] and report["broken_links"][0]["target"] == "wiki_gone" and not report["strict_ok"]
    assert engine.page("main").stale and engine.sync() == 2 and engine.lint()["strict_ok"]


def test_context_with_a_model(built):
    _, engine, _ = built
    plain, asked = engine.context("main"), []
    assert plain["enriched_summary"] is None and plain["summary_source"] == "deterministic" and plain["affected"]
    got = engine.context("main", model=lambda p: asked.append(p) or "It starts the shop and charges nobody twice.")
    assert len(asked) == 1 and got["enriched_summary"] == "It starts the shop and charges nobody twice." and got["summary_source"] == "mcp_sampling"
    assert got["enriched_summary"] in got["wiki_body"] and got["enriched_summary"] in got["markdown"]
    assert "## Impact" in got["markdown"] and not got["affected"] and got["affected_symbol_ids"] == plain["affected_symbol_ids"]
    again = engine.context("main", model=lambda p: asked.append(p) or "no")
    assert len(asked) == 1 and again["enriched_summary"] is None and got["enriched_summary"] in again["wiki_body"]
    assert engine.context("main", plan=True, model=asked.append)["markdown"].startswith("# Context plan") and len(asked) == 1


def test_domains_and_commands(built, spark):
    folder, engine, _ = built
    assert engine.rename_domain("pay", "payments")["name"] == "payments"
    assert [s["order"] for s in engine.add_to_domain("mine", ["src/**", "main"])["steps"]] == [1, 2, 3, 4]
    for wrong in (lambda: engine.rename_domain("mine", "PAYMENTS"), lambda: engine.add_to_domain("x", []), lambda: engine.add_to_domain("x", ["tool"])):
        with pytest.raises(DomainError):
            wrong()
    (folder / "src/pay/order.rs").write_text(TREE["src/pay/order.rs"] + "fn extra() { order(); }\n")
    (folder / ".hidden/tool.py").unlink()
    report = engine.build()
    assert (report["files_parsed"], report["files_skipped"], report["symbols"]) == (1, 4, 10)
    assert {r.name for r in engine.store.table("flows").collect()} == {"payments", "mine"}
    text, code = run(spark, ["--root", str(folder), "impact", "extra", "--depth", "1"])
    assert code == 0 and len(json.loads(text)["affected_symbol_ids"]) == 1
    assert run(spark, ["--root", str(folder), "impact", "nothing"])[1] == 1
    assert run(spark, ["--root", str(folder), "context", "extra"])[0].startswith("# Context: extra")
    assert run(spark, ["--root", str(folder), "build", "--full"])[0].count('"symbols": 9') == 1


def test_nothing_built(spark, tmp_path):
    with pytest.raises(NotBuilt):
        Engine(spark, str(tmp_path)).symbol("x")
    assert Engine(spark, str(tmp_path)).build()["symbols"] == 0


def test_workspace(spark, tmp_path):
    lay(
        tmp_path,
        {
            "graphloom.workspace.toml": 'name = "shop"\n[[repos]]\nname = "web"\npath = "web"\n[[repos]]\nname = "api"\npath = "api"\n[[contracts.http]]\nclient_repo = "web"\nserver_repo = "api"\nmethod = "get"\npath = "users"\n[[contracts.queue]]\nproducer_repo = "web"\nconsumer_repo = "api"\ntopic = "t.x"\n[[contracts.shared_lib]]\npackage = "Kit"\nrepos = ["web", "api"]\n',
            "web/a.ts": 'import { Kit } from "kit";\nexport function load() { axios.get("/users"); }\nfunction stub() { new UserServiceClient(); }\n',
            "api/b.py": 'class Kit:\n    pass\n@app.get("/users")\ndef users():\n    add_UserServicer_to_server(1)\n',
        },
    )
    assert discover(spark, str(tmp_path / "web")) == f"file:{tmp_path}"
    space = Workspace(spark, str(tmp_path))
    assert space.build() == {"repos": 2, "cross_edges": 4}
    names = {r.id: r.name for e in space.members.values() for r in e.store.table("symbols").collect()}
    got = {(names[r.src_symbol_id], names[r.dst_symbol_id], r.edge_type, r.boundary, round(r.confidence, 2), r.label) for r in space.cross_edges().collect()}
    assert got == {("load", "users", "http", "network", 0.85, "GET /users"), ("stub", "users", "grpc", "network", 0.85, "UserService"), ("load", "Kit", "queue", "queue", 1.0, "t.x"), ("load", "Kit", "imports", "shared_lib", 0.9, "Kit")}
    assert json.loads((tmp_path / ".graphloom/cross_repo.json").read_text())["workspace"] == "shop"
    assert run(spark, ["--root", str(tmp_path), "workspace", "build"])[1] == 0
