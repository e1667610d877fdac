"""All graph queries against their SQL in DuckDB, and operators on small graphs."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import lines, pages, resolve, traverse
from graphloom.plans import queries
from graphloom.plans.queries import ORACLE_SQL, QUERIES

from .oracle import connect, differences

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    assert differences(QUERIES[name](spark, DATA), connect(DATA), ORACLE_SQL[name]) == ""


def test_root_is_reached_only_through_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    root = spark.createDataFrame([(1,)], "root long")
    got = lambda depth: {(r.node, r.depth) for r in traverse.reachable(edges, root, depth).collect()}
    assert got(0) == got(1) == {(2, 1)}
    assert got(3) == {(2, 1), (3, 2), (1, 3), (4, 3)}


def test_breadth_first_order(spark):
    edges = spark.createDataFrame([(1, 5), (1, 3), (5, 2), (3, 4), (3, 2)], "src long, dst long")
    order = traverse.breadth_first(edges, spark.createDataFrame([(1,)], "root long")).orderBy("position").collect()
    assert [r.node for r in order] == [1, 3, 5, 2, 4]


def test_scopes(spark):
    symbols = spark.createDataFrame([("a", "d/f", "d", "x", 1, True), ("b", "d/f", "d", "x", 9, True), ("c", "e/g", "e", "y", 1, False), ("d", "e/h", "e", "y", 1, True)], "id string, file string, dir string, name string, line int, public boolean")
    calls = spark.createDataFrame([("d/f", "d", "x"), ("d/q", "d", "y"), ("d/q", "d", "x")], "file string, dir string, name string")
    got = {(r.file, r.name): (r.target, r.scope) for r in resolve.resolve(calls, symbols).collect()}
    assert got == {("d/f", "x"): ("b", "file"), ("d/q", "y"): ("d", "global"), ("d/q", "x"): (None, None)}


def test_fixed_values(spark):
    row = spark.range(1).select(T.stable_id("file", "src/main.rs").alias("a"), T.estimate_tokens(F.lit("é" * 4)).alias("b"), T.short_id(F.lit("0123456789abcdef")).alias("c"), T.url_to_path(F.lit("http://h/p?q=1")).alias("d"), T.url_to_path(F.lit("https://h")).alias("e")).first()
    assert row == ("7ea348f4fde82610794d28c2899f83c9", 22, "01234567…", "/p?q=1", "/")


def test_fingerprint_does_not_depend_on_row_order(spark):
    anchors = spark.createDataFrame([("p", 1), ("p", 2)], "page string, id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 1)], "src long, dst long")
    assert pages.fingerprints(anchors, edges).collect() == pages.fingerprints(anchors.orderBy(F.desc("id")), edges.orderBy(F.desc("src"))).collect()


def test_symbols_by_line_rules(spark):
    code = {
        "a.rs": ("rust", "// fn no()\npub fn one(a: u8) {\n  fn two<T>(x: T)\n#[test]\nstruct Foo {\nasync fn main() {\n"),
        "b.py": ("python", "def f(x):\n# def no():\n    def inner (y):\nclass A(B):\nclass C:\nasync def skipped():"),
        "c.js": ("javascript", "export async function go(x) {\r\nexport class Box{\nlet f = function (x) {\nclass Plain extends Box {"),
        "d.go": ("go", "func main() {\nfunc (s *Server) Run(x int) error {\ntype Server struct {\ntype Name string"),
        "e.java": ("java", "public class Shop {\n  public int sum(int a) {\n  static void run () {\n  int x = 1;"),
        "f.txt": (None, "def f():"),
        "g.py": ("python", None),
    }
    rows = [(path, language, text) for path, (language, text) in code.items()]
    got = lines.line_symbols(spark.createDataFrame(rows, "path string, language string, text string")).collect()
    assert {(r.file_path, r.start_line, r.kind, r.name, r.visibility) for r in got} == {
        ("a.rs", 2, "function", "one", "public"), ("a.rs", 3, "function", "two<T>", "private"), ("a.rs", 5, "class", "Foo", "public"), ("a.rs", 6, "function", "main", "public"),
        ("b.py", 1, "function", "f", "public"), ("b.py", 3, "function", "inner", "public"), ("b.py", 4, "class", "A", "public"), ("b.py", 5, "class", "C", "public"),
        ("c.js", 1, "function", "go", "public"), ("c.js", 2, "class", "Box", "public"), ("c.js", 4, "class", "Plain", "public"),
        ("d.go", 1, "function", "main", "public"), ("d.go", 2, "function", "Run", "public"), ("d.go", 3, "class", "Server", "public"),
        ("e.java", 1, "class", "Shop", "public"), ("e.java", 2, "function", "sum", "public"), ("e.java", 3, "function", "run", "public"),
    }
    assert len({r.id for r in got}) == len(got)


def test_steps_move_no_column_that_only_tells_equal_lines_apart(spark, tmp_path):
    con = connect(DATA)
    con.execute(f"copy (select * from lineitem union all select * replace (l_suppkey + 1 as l_suppkey, l_extendedprice * 2 as l_extendedprice) from lineitem where l_orderkey % 3 = 0) to '{tmp_path}/lineitem.parquet' (format parquet)")
    found = queries.steps(spark, str(tmp_path))
    sql = f"select src, dst from (select l_partkey as src, {queries.NEXT} as dst from '{tmp_path}/lineitem.parquet') where dst is not null"
    assert differences(found, con, sql) == ""
    assert "l_extendedprice" not in found._jdf.queryExecution().executedPlan().toString()
