"""Reachability of many roots in sets against a walk in plain Python, by numbers and by strings."""

import random

import pyarrow as pa
import pytest

from graphloom.operators import sets, traverse


def plain(edges, roots, depth):
    out = set()
    for root in roots:
        seen, front = set(), {root}
        for level in range(1, max(depth, 1) + 1):
            front = {d for s, d in edges if s in front} - seen
            out |= {(root, n, level) for n in front}
            seen |= front
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("few", [64, 0])
def test_equals_plain_walks(spark, kind, few, monkeypatch):
    monkeypatch.setattr(traverse, "FEW", few)
    monkeypatch.setattr(traverse, "PART", 40)
    monkeypatch.setattr(traverse, "PIECE", 3)
    rng = random.Random(2)
    as_kind = (lambda x: f"é{x}") if kind == "string" else int
    edges = [(as_kind(rng.randint(0, 99)), as_kind(min(rng.randint(0, 99), rng.randint(0, 99)))) for _ in range(260)] + [(as_kind(1), as_kind(n)) for n in range(100)]
    roots = [as_kind(n) for n in [*range(0, 100, 3), 500, 3]]
    df = spark.createDataFrame([*edges, (None, as_kind(1)), (as_kind(1), None)], f"src {kind}, dst {kind}")
    for depth in (0, 1, 2, 4, 5):
        rows = traverse.reachable(df, spark.createDataFrame([(r,) for r in roots], f"root {kind}").distinct(), depth).where("node is not null").collect()
        assert len(rows) == len({tuple(r) for r in rows}) and {tuple(r) for r in rows} == plain(edges, roots, depth)


def test_one_root_over_many_batches(monkeypatch):
    """A root's rows come in several batches, which are made smaller on the way; long sets leave in chunks."""
    monkeypatch.setattr(sets, "HELD", 50)
    monkeypatch.setattr(sets, "CHUNK", 7)
    rng = random.Random(3)
    rows = sorted((rng.choice("ab"), rng.randint(0, 1), rng.randint(1, 2), [rng.randint(0, 80) for _ in range(rng.randint(0, 30))]) for _ in range(120))
    schema = pa.schema([("root", pa.string()), ("part", pa.int32()), ("depth", pa.int32()), ("nodes", pa.list_(pa.int64()))])
    whole = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
    got = [(r["root"], r["part"], r["depth"], n) for b in sets.united(iter(whole.to_batches(max_chunksize=9)), 2) for r in b.to_pylist() for n in r["nodes"]]
    want = set()
    for key in {r[:2] for r in rows}:
        of = lambda d: {n for r in rows if r[:2] == key and r[2] == d for n in r[3]}  # noqa: B023, E731
        want |= {(*key, 2, n) for n in of(2) - of(1)}
    assert len(got) == len(set(got)) and set(got) == want
    assert list(sets.united(iter([]), 2)) == []


def test_impact_counts_and_orders_modules(spark, monkeypatch):
    monkeypatch.setattr(traverse, "FEW", 0)
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("c", "d"), ("b", "e"), ("d", "f")], "src string, dst string")
    nodes = spark.createDataFrame([("b", "m2", "x/test_b"), ("c", "m1", "c"), ("d", "m2", "spec/d"), ("e", "", "e")], "id string, module string, path string")
    roots = spark.createDataFrame([("a",), ("f",)], "root string")
    got = {r.root: (r.affected, r.tests, r.risk, r.modules) for r in traverse.impact(edges, nodes, roots, 3).collect()}
    assert got == {"a": (5, 2, False, ["m2", "m1"]), "f": (0, 0, False, [])}


def test_breadth_first_reads_the_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(pair):
        read.add(1)
        return pair

    pairs = [(i, i + 1) for i in range(12)] + [(0, 5), (3, 0), (7, 99)]
    edges = spark.sparkContext.parallelize(pairs, 2).map(counted).toDF("src long, dst long")
    allowed = spark.createDataFrame([(0, i) for i in range(13)], "root long, node long")
    got = traverse.breadth_first(edges, spark.createDataFrame([(0,)], "root long"), allowed).orderBy("position").collect()
    assert [(r["node"], r["position"]) for r in got] == [(n, i + 1) for i, n in enumerate([0, 1, 5, 2, 6, 3, 7, 4, 8, 9, 10, 11, 12])]
    assert read.value == len(pairs)


def test_neighbours_are_dealt_to_bounded_places(spark, monkeypatch):
    monkeypatch.setattr(traverse, "ROWS_A_PLACE", 50, raising=False)
    pairs = [(i % 40, i * 7 % 41) for i in range(400)] + [(1, 1), (1, 1), (2, None)]
    nodes = spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(1,), (1,)], "node int")
    met = traverse.neighbours(spark.createDataFrame(pairs, "src int, dst int"), nodes)
    known = {r["node"] for r in nodes.collect()}
    want = {(d, "caller", s) for s, d in pairs if d in known} | {(s, "callee", d) for s, d in pairs if s in known}
    assert sorted(map(tuple, met.collect()), key=str) == sorted(want, key=str)
    assert met.rdd.getNumPartitions() == 1 + 2 * len(pairs) // 50


@pytest.mark.parametrize(("kind", "few"), [("string", 1 << 14), ("long", 0)])
def test_impact_of_many_roots_counts_sets(spark, monkeypatch, kind, few):
    monkeypatch.setattr(traverse, "FEW", 0)
    monkeypatch.setattr(traverse, "BROADCAST", few, raising=False)
    monkeypatch.setattr(traverse, "PART", 20)
    monkeypatch.setattr(traverse, "PIECE", 3)
    rng = random.Random(11)
    as_kind = (lambda x: f"é{x}") if kind == "string" else int
    edges = [(as_kind(rng.randint(0, 59)), as_kind(rng.randint(0, 59))) for _ in range(150)]
    facts = {as_kind(n): (rng.choice(["m", "k", "", None]), rng.choice(["a/test_x", "spec", "src", None])) for n in range(50)}
    nodes = spark.createDataFrame([(i, m, p) for i, (m, p) in facts.items()], f"id {kind}, module string, path string")
    roots = [as_kind(n) for n in (*range(0, 60, 2), 99)]
    met = traverse.impact(spark.createDataFrame(edges, f"src {kind}, dst {kind}"), nodes, spark.createDataFrame([(r,) for r in roots], f"root {kind}"), 2)
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(nodes") == 1
    reached = plain(edges, roots, 2)
    for r in met.collect():
        mine = [(d, n, *facts.get(n, (None, None))) for root, n, d in reached if root == r["root"]]
        firsts = {m: min((d, n) for d, n, of, _ in mine if of == m) for m in {x[2] for x in mine} if m}
        assert (r["affected"], r["tests"], r["risk"]) == (len(mine), sum(p is not None and ("test" in p or "spec" in p) for *_, p in mine), len(mine) > 10)
        assert r["modules"] == sorted(firsts, key=firsts.get)


def shuffled(spark) -> int:
    """Bytes that all stages so far have written for others."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_successors_move_to_blocks_not_to_each_root(spark, monkeypatch):
    monkeypatch.setattr(traverse, "BLOCK_NODES", 1 << 17, raising=False)
    rng = random.Random(8)
    ends = {n: [rng.getrandbits(62) for _ in range(300)] for n in range(1000, 1020)}
    pairs = [(r, n) for r in range(500) for n in ends] + [(n, d) for n, to in ends.items() for d in to]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    before = shuffled(spark)
    assert traverse.reachable(edges, spark.range(500).toDF("root"), 2).count() == 500 * len({*ends, *(d for to in ends.values() for d in to)})
    assert shuffled(spark) - before < 4 << 20


@pytest.mark.parametrize("size", [1, 3, 1000])
@pytest.mark.parametrize("chunk", [5, 1 << 16])
def test_roots_take_over_pieces_over_batches(monkeypatch, size, chunk):
    monkeypatch.setattr(sets, "CHUNK", chunk)
    pieces = {(0, "a"): [[1, 2, 3], [4]], (0, "b"): [[5]], (0, "d"): [[6]], (1, "a"): [[1, 2, 3], [4]]}
    going = {(0, "a"): [7, 8, 9], (0, "b"): [8], (1, "a"): [11], (1, "c"): [11]}
    own = [(0, 7, [20]), (0, 8, [21, 22]), (1, 11, [23])]
    rows = [{"block": b, "root": r, "node": None, "part": 0, "depth": 1, "nodes": n} for b, r, n in own]
    rows += [{"block": b, "root": None, "node": m, "part": 0, "depth": None, "nodes": n} for (b, m), of in pieces.items() for n in of]
    rows += [{"block": b, "root": r, "node": m, "part": None, "depth": None, "nodes": None} for (b, m), of in going.items() for r in of]
    rows.sort(key=lambda r: (r["block"], r["node"] or "", -1 if r["root"] is None else r["root"]))
    schema = pa.schema([("block", pa.int32()), ("root", pa.int64()), ("node", pa.string()), ("part", pa.int32()), ("depth", pa.int32()), ("nodes", pa.list_(pa.int64()))])
    got = [tuple(r.values()) for b in sets.expanded(iter(pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=size)), 2) for r in b.to_pylist()]
    want = [(b, r, 0, 1, n) for b, r, n in own] + [(b, r, 0, 2, n) for (b, m), of in going.items() for r in of for n in pieces.get((b, m), [])]
    assert sorted(got) == sorted(want) and list(sets.expanded(iter([]), 2)) == []
