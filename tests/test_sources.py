"""Parsing, ignore rules, contracts and stored documents, without a build."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import prose as P
from graphloom.sources import parse, tree
from graphloom.sources.store import Store, page_text, parse_page
from graphloom.workspace import manifest


def names(found):
    return [(s["name"], s["kind"], s["start_line"], s["end_line"], s["public"]) for s in found.symbols]


def test_rust():
    found = parse.parse(
        """use std::io::{self, Read as R};
pub(crate) struct Dog;
pub trait Pet { fn name(&self) -> [u8; 4]; }
impl<T> Pet for Dog where T: X {
    fn name(&self) -> [u8; 4] { helper('{', "a{b"); self.deep().run(); println!("{}", hidden()); }
}
/* c { */
pub async fn helper<'a>(x: &'a str) {
    Router::new().route("/u", get(list_users));
}
impl Pet for Later {}
struct Later;
""",
        "rust",
    )
    assert names(found) == [("Dog", "class", 2, 2, True), ("Pet", "type", 3, 3, True), ("name", "function", 5, 5, False), ("helper", "function", 8, 10, True), ("Later", "class", 12, 12, True)]
    assert {(c["scope"], c["name"]) for c in found.calls} == {("name", "helper"), ("name", "deep"), ("name", "run"), ("helper", "new"), ("helper", "route"), ("helper", "get")}
    assert found.imports == ["R"] and found.routes == [{"handler": "list_users", "label": "HTTP /u"}]
    assert found.inherits == [{"child": "Dog", "parent": "Pet", "edge_type": "implements"}]


def test_typescript():
    found = parse.parse(
        """import D, { A as B } from "x";
export function f(a: {x: number}): { get(p: string): void; } | null { return { get(p) { inner(p); }, n: 1 }; }
export class C extends Base<T> implements I, J {
  private x = call({a: 1});
  async run(a: string): Promise<void> { await axios.get("/users"); if (a) { this.go(/[{]/); } }
}
interface I { m(): void }
const g = function named() { f(); };
app.get("/users", listUsers);
""",
        "typescript",
    )
    assert names(found) == [("f", "function", 2, 2, False), ("get", "function", 2, 2, False), ("C", "class", 3, 6, True), ("run", "function", 5, 5, False), ("I", "type", 7, 7, True)]
    assert {(c["scope"], c["name"]) for c in found.calls} == {("get", "inner"), ("run", "get"), ("run", "go")}
    assert [(i["parent"], i["edge_type"]) for i in found.inherits] == [("Base", "extends"), ("I", "implements"), ("J", "implements")]
    assert found.imports == ["B"] and found.clients == [{"scope": "run", "method": "GET", "path": "/users"}]
    assert {"handler": "listUsers", "label": "GET /users"} in found.routes


def test_go_java_and_python():
    go = parse.parse('package m\nfunc Run(a int, f func(int) interface{}) (b struct{ c int }) {\n\thttp.Get("users")\n\tgo helper(func() { other() })\n}\nfunc (s *Server) Start() { s.Run(1) }\n', "go")
    assert names(go) == [("Run", "function", 2, 5, False), ("Start", "method", 6, 6, True)]
    assert [c["name"] for c in go.calls] == ["Get", "helper", "other", "Run"] and go.clients[0]["path"] == "/users"
    java = parse.parse(
        """import a.b.C;
@interface GetMapping { String value() default ""; }
public class Api extends q.Base<X> implements One, Two<Y> {
  private final List<String> names = make();
  public Api(int a) { }
  @GetMapping(value = "/items")
  public List<String> listItems(int a) { call(); new Thread() { public void run() { } }; return null; }
}
interface Pet { void feed(); }
""",
        "java",
    )
    assert names(java) == [("Api", "class", 3, 8, True), ("listItems", "method", 6, 7, True), ("run", "method", 7, 7, True), ("Pet", "type", 9, 9, True), ("feed", "method", 9, 9, True)]
    assert java.calls == [] and java.imports == ["C"] and java.routes == [{"handler": "listItems", "label": "GET /items"}]
    assert [(i["parent"], i["edge_type"]) for i in java.inherits] == [("Base", "extends"), ("One", "implements"), ("Two", "implements")]
    python = parse.parse('import a.b, c as d\n@app.get("/health")\ndef health():\n    requests.post("http://h/u?q=1")\n    def inner(): other.call()\n    return go()\nclass K(Base):\n    async def m(self): self.health()\n', "python")
    assert names(python) == [("health", "function", 3, 6, False), ("inner", "function", 5, 5, False), ("K", "class", 7, 8, True), ("m", "function", 8, 8, False)]
    assert python.imports == ["d"] and python.inherits == [] and python.routes == [{"handler": "health", "label": "GET /health"}]
    assert python.clients == [{"scope": "health", "method": "POST", "path": "/u?q=1"}]
    assert [(s["name"], s["end_line"]) for s in parse.parse("def a(:\n  x\nclass B:\n  def c(self):\n    pass\n", "python").symbols] == [("a", 2), ("B", 5), ("c", 5)]


@pytest.mark.parametrize("language", ["rust", "typescript", "javascript", "go", "java", "python"])
@pytest.mark.parametrize("text", ["", "}", "fn f( {", "class A {", '"open', "/* open", "func (", "impl for {", "@Get", "f((((", "a.b.c(", "import", "\u00e9 \U0001f600 {"])
def test_broken_files_don_t_fail(language, text):
    parse.parse(text, language)


def test_signals(spark):
    rows = [("a.py", 'stub = UserServiceStub(c)\nbus.publish("t.a")\nbus.send("t.b"); bus.subscribe(["t.c"])\r\nadd_UserServicer_to_server(x)'), ("b.go", "c := NewUserServiceClient(x)")]
    got = {tuple(r) for r in parse.signals(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("a.py", 1, "rpc_client", "UserService"), ("a.py", 2, "producer", "t.a"), ("a.py", 3, "producer", "t.b"), ("a.py", 3, "consumer", "t.c"), ("a.py", 4, "rpc_server", "UserService"), ("b.go", 1, "rpc_client", "UserService"), ("b.go", 1, "rpc_client", "NewUserService")}


def test_ignore_rules(spark):
    rules = [("", "*.log"), ("", "/build/"), ("", "docs/**/x.py"), ("", "!keep.log"), ("sub", "only.py"), ("", "# no"), ("", "a[bc].py")]
    paths = {"a.log": True, "d/b.log": True, "keep.log": False, "build/a.py": True, "d/build/a.py": False, "build": False, "docs/x.py": True, "docs/a/b/x.py": True, "only.py": False, "sub/only.py": True, "sub/d/only.py": True, "ab.py": True, "ad.py": False}
    got = spark.createDataFrame([(p,) for p in paths], "path string").select("path", tree.ignored(F.col("path"), rules).alias("out")).collect()
    assert {r.path: r.out for r in got} == paths


def test_pages_survive_their_files(spark):
    page = {"id": "wiki_x", "kind": "flow", "symbol_ids": ["a"], "source": "deterministic", "graph_fingerprint": "f", "see_also": [], "title": 'Ein "T\u00e4st"\n', "body": "# x\n\n---\ny"}
    assert parse_page(page_text(page)) == page
    with pytest.raises(ValueError):
        parse_page("no fence")


def test_prose(spark):
    empty = "# a\n" + P.EMPTY_SLOT
    filled = f"# a\n\n{P.SECTION}\n\n{P.SLOT}\nWhy $1.\n\n## Next\nn"
    claim = f"# a\n<!-- graphloom:claim calls x source=graph -->\n- b\n\n\n\n{P.EMPTY_SLOT}"
    rows = spark.createDataFrame([(empty,), (filled,), (claim,), ("plain",)], "b string").select(P.prose(F.col("b")), P.for_context(F.col("b")), P.keep_prose(F.lit(filled), F.col("b")), P.adds_context(F.col("b"))).collect()
    assert [r[0] for r in rows] == [None, "Why $1.", None, None]
    assert [r[1] for r in rows] == ["# a", f"# a\n\n{P.SECTION}\n\nWhy $1.\n\n## Next\nn", "# a\n- b", "plain"]
    assert [r[2] for r in rows] == [f"# a\n\n{P.SECTION}\n\n{P.SLOT}\nWhy $1.", filled.replace("Why $1.\n\n## Next", "Why $1.\n## Next"), claim.replace(P.PLACEHOLDER + "\n", "Why $1."), "plain\n\nWhy $1."]
    assert [r[3] for r in rows] == [True, True, True, False]


def test_manifest_needs_its_fields():
    assert manifest('name = "w"\n[[repos]]\nname = "a"\npath = "a"\n').contracts["http"] == []
    for text in ("[[repos]]", 'name = "w"\n[[contracts.grpc]]\nservice = "S"\n', "name ="):
        with pytest.raises(ValueError):
            manifest(text)


def test_artifacts_and_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "id string, n int, note string")
    store.write_artifact("things", {"things": rows.orderBy("id"), "ids": rows.select("id").orderBy("id")}, {"workspace": "w"})
    text = (tmp_path / ".graphloom/things.json").read_text()
    assert '"schemaVersion": "1.0.0"' in text and '"note": "x"' in text and "null" not in text
    assert store.read_artifact("things", "things", "id string, n int, note string").orderBy("id").collect() == rows.orderBy("id").collect()
    (tmp_path / ".graphloom/old.json").write_text('{"things": []}')
    with pytest.raises(Exception, match="schemaVersion"):
        store.read_artifact("old", "things", "id string").collect()
    for n in (1, 2, 3):
        store.stage("t", spark.range(n))
        store.commit()
        assert store.table("t").count() == n
    assert len(list((tmp_path / ".graphloom/tables/t").iterdir())) == 2
