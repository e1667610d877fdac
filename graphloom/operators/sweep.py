"""Interval join by one sorted sweep: for every point of a file the innermost of the spans around it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of one unit of work, so that a long file is swept by many tasks.
STRETCH = 1 << 16


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (file, stretch, line, kind, id), a span (kind 0) before the points (kind 1) of its first line. The stack holds the
    open spans in the order of their start; what has ended on its top never comes back, so each span is pushed and popped once."""
    stretch, stack, last = None, [], None
    for batch in batches:
        files, lines, found = [], [], []
        columns = (batch.column(name).to_pylist() for name in ("file", "stretch", "line", "kind", "end_line", "id"))
        for file, at, line, kind, end, ident in zip(*columns, strict=True):
            if (file, at) != stretch:
                stretch, stack, last = (file, at), [], None
            if kind == 0:
                stack.append((end, ident))
                continue
            if last is not None and last[0] == line:
                continue
            last = (line,)
            while stack and stack[-1][0] < line:
                stack.pop()
            files.append(file)
            lines.append(line)
            found.append(stack[-1][1] if stack else None)
        schema = batch.schema
        yield pa.RecordBatch.from_arrays([pa.array(values, schema.field(name).type) for name, values in (("file", files), ("line", lines), ("id", found))], names=["file", "line", "id"])


def innermost(points: DataFrame, spans: DataFrame, *, stretch: int = STRETCH) -> DataFrame:
    """(file, line, id) for every different point (file, line): of the spans (file, start_line, end_line, id) with start_line <= line <=
    end_line the one that starts last, ties by the larger id; null where there is none.

    Files are cut into stretches of lines. A span goes to the stretches of its first and last line; of those that cover a whole stretch
    only the one that starts last can matter there, and a partial maximum leaves one row a task and stretch. So the shuffle takes two rows
    a span and one a stretch, however spans lie over each other, and a task sorts and reads them once. Points without a file or line have
    no span; spans without a bound, or that end before they start, hold nothing."""
    usable = spans.where("file is not null and start_line <= end_line").select("file", F.col("start_line").cast("long").alias("line"), F.col("end_line").cast("long").alias("end_line"), "id")
    of = lambda line: F.floor(line / stretch)
    first, last = of(F.col("line")), of(F.col("end_line"))
    ends = usable.withColumn("stretch", F.explode(F.array_distinct(F.array(first, last))))
    whole = usable.where(last - first >= 2).withColumn("stretch", F.explode(F.sequence(first + 1, last - 1)))
    whole = whole.groupBy("file", "stretch").agg(F.max(F.struct("line", "id", "end_line")).alias("top")).select("file", "stretch", "top.*")
    asked = points.select("file", F.col("line").cast("long").alias("line"))
    events = ends.unionByName(whole).withColumn("kind", F.lit(0)).unionByName(asked.withColumns({"stretch": of(F.col("line")), "kind": F.lit(1)}), allowMissingColumns=True)
    order = ["file", "stretch", "line", "kind", "id"]
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    swept = events.repartition("file", "stretch").sortWithinPartitions(*order).mapInArrow(_swept, f"file {types['file']}, line long, id {types['id']}")
    return swept.select("file", F.col("line").cast(points.schema["line"].dataType).alias("line"), "id")
