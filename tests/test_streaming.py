"""Watching a folder: what was added, edited and removed reaches the rebuild, a burst at a time."""

import json
import os
import time
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from graphloom.sources.changes import TreeReader
from graphloom.streaming.watch import debounced, watch


def lay(tree, *names):
    for name in names:
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text("x = 1\n")


def test_changes_reach_the_rebuild(spark, tmp_path):
    tree = tmp_path / "tree"
    lay(tree, "src/a.py", "src/b.py", ".git/c.py", "target/d.rs")
    seen = []

    def tick():
        seen.clear()
        watch(spark, str(tree), str(tmp_path / "state"), lambda rows, _: seen.extend((r.path, r.change) for r in rows.collect()), once=True).awaitTermination(120)
        return sorted(seen)

    assert tick() == [("src/a.py", "added"), ("src/b.py", "added")]
    assert tick() == []
    (tree / "src/a.py").write_text("x = 2\n")
    (tree / "src/b.py").unlink()
    (tree / "target/d.rs").write_text("fn main() {}\n")
    (tree / "src/e.py").write_text("y = 1\n")
    assert tick() == [("src/a.py", "changed"), ("src/b.py", "removed"), ("src/e.py", "added")]


def test_source_reads_only_what_moved(tmp_path, monkeypatch):
    tree = tmp_path / "tree"
    lay(tree, "a.py", "b.py")
    reader, read = TreeReader(str(tree), str(tmp_path / "state")), []
    digest = TreeReader._digest
    monkeypatch.setattr(TreeReader, "_digest", lambda self, path: read.append(path) or digest(self, path))
    changes = lambda rows: sorted((r[1], r[2]) for r in rows if r[1])
    rows, one = reader.read(reader.initialOffset())
    assert changes(rows) == [("a.py", "added"), ("b.py", "added")] and read == []
    rows, two = reader.read(one)
    assert changes(rows) == [] and two["snapshot"] == one["snapshot"]
    os.utime(tree / "a.py", ns=(1, 1))  # no hash is known yet, so this counts
    rows, three = reader.read(two)
    assert changes(rows) == [("a.py", "changed")] and read == ["a.py"]
    os.utime(tree / "a.py", ns=(2, 2))  # now one is, and it is the same
    rows, four = reader.read(three)
    assert changes(rows) == [] and read == ["a.py", "a.py"]
    (tree / "b.py").unlink()
    rows, five = reader.read(four)
    assert changes(rows) == [("b.py", "removed")]
    assert changes(reader.readBetweenOffsets(one, five)) == [("a.py", "changed"), ("b.py", "removed")]
    reader.commit(five)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == [f"{five['snapshot']}.snapshot"]
    assert changes(TreeReader(str(tree), str(tmp_path / "state")).read(five)[0]) == []


def test_bursts_end_after_quiet_time(spark, tmp_path):
    """Edits inside the gap are one burst, edits outside two; a burst stays inside until the clock has passed its end."""
    start = datetime(2026, 1, 1, tzinfo=UTC)
    source = tmp_path / "events"
    source.mkdir()

    def batch(number, *rows):
        lines = [{"tree": t, "path": p, "change": c, "at": (start + timedelta(milliseconds=ms)).isoformat()} for t, p, c, ms in rows]
        (source / f"{number}.json").write_text("\n".join(map(json.dumps, lines)))

    out = []
    events = spark.readStream.schema("tree string, path string, change string, at timestamp").option("maxFilesPerTrigger", 1).json(str(source))

    def seen():
        out.clear()
        query = debounced(events).writeStream.outputMode("append").foreachBatch(lambda rows, _: out.extend((r.tree, r.changes, sorted((e.path, e.change) for e in r.events)) for r in rows.collect()))
        query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(out)

    batch(1, ("t", "a", "added", 0), ("t", "b", "added", 300), ("u", "z", "added", 100), ("t", None, None, 350))
    assert seen() == []
    batch(2, ("t", "a", "changed", 690), ("t", None, None, 700))
    assert seen() == [("u", 1, [("z", "added")])]
    batch(3, ("t", None, None, 1080))
    assert seen() == []
    batch(4, ("t", None, None, 1100), ("t", "c", "removed", 1100))
    assert seen() == [("t", 3, [("a", "added"), ("a", "changed"), ("b", "added")])]
    batch(5, ("t", None, None, 1600))
    assert seen() == [("t", 1, [("c", "removed")])]


def test_watch_waits_for_quiet(spark, tmp_path):
    """Two edits a second apart are one rebuild under a gap of eight; a later one is another."""
    tree, calls = tmp_path / "tree", []
    lay(tree, "a.py")
    query = watch(spark, str(tree), str(tmp_path / "state"), lambda rows, _: calls.append(sorted(tuple(r) for r in rows.select("path", F.col("change")).collect())), quiet="8 seconds")

    def until(n):
        for _ in range(900):
            if len(calls) >= n or not query.isActive:
                return
            time.sleep(0.1)

    try:
        until(1)
        lay(tree, "b.py")
        time.sleep(1)
        lay(tree, "c.py")
        until(2)
        (tree / "a.py").unlink()
        until(3)
    finally:
        query.stop()
    assert calls == [[("a.py", "added")], [("b.py", "added"), ("c.py", "added")], [("a.py", "removed")]]
