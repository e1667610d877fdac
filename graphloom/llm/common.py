"""What the operators of this subpackage share: written tables, components of a graph, reading a table."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files go when the write that needed them has ended; the table holds the rows from then on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key with at least 1/HOT of all rows is hot, so there are HOT hot keys at most.
HOT = 64


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that the cluster names in spark.checkpoint.dir; only where none is set (tests
    on one machine) in a temporary one. It is deleted when the driver ends."""
    context = spark.sparkContext
    known = getattr(context, "_graphloom_folder", None)
    if not known:
        top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not top:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            top = tempfile.mkdtemp(prefix="checkpoints")
            spark.conf.set("spark.checkpoint.dir", top)
        known = context._graphloom_folder = f"{top.rstrip('/')}/tables-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(_removed, spark, known)
    return known


def _removed(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows, written once to a table in the shared folder: nothing is computed twice or lost with an executor, and the plan starts anew.

    by: a column whose values get folders of their own, so that reading one of them reads no others."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def named(df: DataFrame, key: str, text: str, *results: str) -> DataFrame:
    """(key, text) of any column names; a key that is named like a result is refused, as the result would have two columns of one name."""
    if key in {text, *results}:
        raise ValueError(f"the key column {key!r} is named like a result; rename it")
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    return df.select(quoted(key).alias("key"), quoted(text).alias("text"))


def release(*tables: DataFrame) -> None:
    """Deletes saved tables after their last use; nothing that is still to be computed may read them."""
    for df in tables:
        _removed(df.sparkSession, df._saved_path)


def meet(rows: DataFrame, groups: DataFrame, on: list[str], *, spread: str, members: str = "members", how: str = "inner") -> DataFrame:
    """rows joined with the one row of their key in `groups`, a written table whose column `members` counts the key's rows.

    Hot keys (by the counts, at least 1/HOT of all rows that have a group, so HOT at most) are broadcast by themselves to give
    their rows a salt from the column `spread`; their row in groups is repeated for each salt. No task gets a hot key whole."""
    total = groups.agg(F.coalesce(F.sum(members), F.lit(0)).alias("n")).first()["n"]
    least = max(2, -(-total // HOT))
    hot = groups.where(F.col(members) >= least).select(*on, F.lit(True).alias("hot"))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("salt", F.expr(f"case when hot then int(pmod(xxhash64(`{spread}`), {HOT})) else 0 end")).drop("hot")
    salts = F.explode(F.expr(f"case when `{members}` >= {least} then sequence(0, {HOT - 1}) else array(0) end"))
    return salted.join(groups.withColumn("salt", salts).drop(members), [*on, "salt"], how).drop("salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Texts are long, so where the number of rows in an Arrow batch is Spark's own, it is lowered
    for the session: a task then holds a few MB of text at once."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of the undirected edges (a, b): component is the least node reachable.

    Each round takes the least label among a node's neighbours and then follows it one jump, so the
    number of rounds is about the logarithm of the longest path. Only node ids move, each round is
    written down, and the least is taken before the shuffle, so a star of any size is spread over
    the tasks.
    """
    both = saved(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = written = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = saved(labels.join(near, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("was")))
        jump = stepped.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = saved(stepped.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"), "was"))
        changed = new.where("component <> was").limit(1).count()
        release(stepped, written)
        written, labels = new, new.select("node", "component")
        if not changed:
            release(both)
            return labels
    raise RuntimeError("components did not settle")


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, *, key: str, text: str, label: str, sample: int) -> DataFrame:
    """(label, text) of at most `sample` documents for which learn holds, half of them of either label, in the order of a hash of the id.

    The ids are chosen from the narrow labels first and broadcast (`sample` rows at most), so no text is shuffled but the
    sample's. Conflicting or null labels of a document don't count; of rows with equal ids the least text does."""
    known = labels.where(learn).groupBy(F.col(key).alias("key")).agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most and label in (0, 1) and key is not null")
    known = known.select("key", F.col("label").cast("int").alias("label"))
    halves = [known.where(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(sample // 2) for v in (0, 1)]
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(halves[0].unionByName(halves[1])), "key")
    return texts.groupBy("key", "label").agg(F.min("text").alias("text")).select("label", "text")
