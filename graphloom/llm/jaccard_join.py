"""N-gram Jaccard self-join: prefix filtering on rare-first ordered shingles, every link verified.

Texts are lowered (A-Z) and cut into words; a document's set holds its distinct n-word shingles as 64-bit hashes
(a shorter text is one shingle). Two documents link when 100 * |A and B| >= percent * |A or B|.

1. One scan writes a small row for each document: size and a 128-bit digest of its set, and a bitmap with the
   parity of the shingles that fall on each bit. Each task also adds its shingles to a frequency sketch of fixed size (SKETCH counters), whose
   partial sums are merged in two steps; the merged sketch is broadcast (8 MB, whatever the input).
2. Documents with equal sets are one class, found by an aggregation; only its representative goes on.
3. Rare-first prefixes: shingles ordered by (sketched frequency, hash), one order for all, so the prefix filter is
   exact whatever the sketch's error. Posting rows hold the shingle, document, set size and position.
4. Each posting list links its members with one pivot first. Candidates pass the length and
   positional filters and the suffix filter (a bound of the Hamming distance from the two bitmaps),
   and are then verified once per pair on whole sets.
5. Lists whose members are in one component by then have nothing left to find. Over what remains, the join compares
   only across components and makes a row only of what passes all filters, so a group of copies never
   gives all its pairs and no component is lost: any link between different components shares a prefix shingle. Lists of
   more than LIST members are dealt to blocks, and every two blocks meet in a task of their own.

The suffix filter bounds the Hamming distance from parity bitmaps, as posting rows hold no suffix to probe. Common shingles, large classes of
copies and pivots of many pairs are salted (`meet`). Ids that aren't whole numbers, and those of rows with different texts, get
numbers in their own order first, so that each such row is a document.

Results: class representative, component and size for every document. Edges: null texts, empty texts and
texts without words have the empty set and link with nothing; rows with an equal id and equal text fall together, rows with an equal id and
different texts are documents of their own with that id; a null id is returned with a null component; very long texts are worked on one at a time in the memory of their
words; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import components, meet, release, saved, table
from .tokens import Words, kgrams, mix, pieces, signed

SHINGLE, PERCENT = 3, 90
SKETCH_BITS, BLOCK_BITS, BITMAP = 22, 18, 512
#: Ids of 8 bytes that are broadcast at most; more are joined by a shuffle, with the same result.
BROADCAST_IDS = 1_000_000
#: Members of a posting list that are compared in one task.
LIST = 1024
BITS = [f"b{i}" for i in range(BITMAP // 64)]


def sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, flat, and their offsets."""
    words = Words(column, lower=True)
    rows, left, counts = words.row_of(), words.left(), words.counts
    grams = kgrams(words.hashes, n)
    keep = np.flatnonzero(left[: len(grams)] >= n)
    parts = [(rows[keep], grams[keep])]
    for size in range(1, n):  # whole sequences of fewer than n words
        at = words.at[:-1][counts == size]
        if len(at):
            parts.append((rows[at], kgrams(words.hashes, size, salt=n + size)[at]))
    row, value = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[first], value[first]
    return value, np.searchsorted(row, np.arange(len(column) + 1))


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


def _digests(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    empty = lambda kind, rows: pa.nulls(rows, kind)
    names = ["doc", "n", "one", "two", *BITS, "block", "counts"]
    seen = False
    for batch in pieces(batches):
        shingles, at = sets(batch.column("text"), n)
        seen = True
        counts += np.bincount(_slot(shingles), minlength=len(counts))
        rows = batch.num_rows
        row = np.repeat(np.arange(rows), np.diff(at))
        bit = (mix(shingles, 11) % np.uint64(BITMAP)).astype(np.int64)
        odd = (np.bincount(row * BITMAP + bit, minlength=rows * BITMAP) & 1).astype(bool).reshape(rows, BITMAP)
        bits = np.packbits(odd, axis=1).view(np.int64)
        one, two = (signed(_sums(mix(shingles, s), at)) for s in (21, 22))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc").cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(one), pa.array(two), *(pa.array(bits[:, i].copy()) for i in range(len(BITS))), empty(pa.int32(), rows), empty(pa.binary(), rows)], names=names
        )
    if seen:
        for block, part in enumerate(counts.astype(np.uint32).reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([*(empty(pa.int64(), 1) for _ in names[:-2]), pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sketches by block, for the rows of one task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            part = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
            total[block] = np.minimum(total.get(block, 0) + part.astype(np.uint64), 0xFFFFFFFF).astype(np.uint32)
    for block, part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "counts"])


def _prefix_rows(batches: Iterator[pa.RecordBatch], n: int, percent: int, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        shingles, at = sets(batch.column("text"), n)
        size = np.diff(at)
        row = np.repeat(np.arange(batch.num_rows), size)
        order = np.lexsort((shingles, sketch[_slot(shingles)], row))
        place = np.arange(len(order)) - at[:-1][row]
        length = size - -(-size * percent // 100) + 1
        keep = place < length[row]
        docs = batch.column("doc").cast(pa.int64()).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(signed(shingles[order][keep])), pa.array(docs[row[keep]]), pa.array(size[row[keep]].astype(np.int32)), pa.array(place[keep].astype(np.int32))], names=["gram", "doc", "n", "place"])


def _verified(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text_a", "text_b"):
        (a, at_a), (b, at_b) = (sets(batch.column(c), n) for c in ("text_a", "text_b"))
        common = np.array([len(np.intersect1d(a[at_a[r] : at_a[r + 1]], b[at_b[r] : at_b[r + 1]], assume_unique=True)) for r in range(batch.num_rows)])
        union = np.diff(at_a) + np.diff(at_b) - common
        mask = pa.array(100 * common >= percent * union)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(mask)


def _suffix_filter(percent: int) -> str:
    """SQL: a pair that links differs in at most n_a + n_b - 2 * least places, and its bitmaps in no more bits."""
    differ = " + ".join(f"bit_count({b}_a ^ {b}_b)" for b in BITS)
    return f"{differ} <= n_a + n_b - 2 * ceil({percent} * (n_a + n_b) / {100 + percent})"


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, class_id, component_id): class_id is the least id with an equal set, component_id the least id reachable by links."""
    spark = docs.sparkSession
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    whole = isinstance(docs.schema[key].dataType, ByteType | ShortType | IntegerType | LongType)
    if whole and named.where("key is not null").groupBy("key").agg(F.min(F.xxhash64("text")).alias("one"), F.max(F.xxhash64("text")).alias("two")).where("one <> two").isEmpty():
        out = _components(spark, named.select(F.col("key").cast("long").alias("doc"), "text"), n, percent)
        return out.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), "n_shingles", *(F.col(c).cast(docs.schema[key].dataType).alias(c) for c in ("class_id", "component_id")))
    # Sorted by ranges, so these numbers ascend with the ids. Rows without an id keep a null.
    marked = named.withColumn("mark", F.xxhash64("text"))
    ids = saved(marked.where("key is not null").select("key", "mark").distinct().orderBy("key", "mark").withColumn("doc", F.monotonically_increasing_id()))
    out = _components(spark, marked.join(ids, ["key", "mark"], "left").select("doc", "text"), n, percent)
    for number, name in (("doc", "key"), ("class_id", "class"), ("component_id", "component")):
        out = out.join(ids.select(F.col("doc").alias(number), F.col("key").alias(name)), number, "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.col("class").alias("class_id"), F.col("component").alias("component_id"))


def _components(spark, source: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc, n_shingles, class_id, component_id) of source (doc long, text)."""
    digests = saved(source.mapInArrow(lambda b: _digests(b, n), f"doc long, n long, one long, two long, {' long, '.join(BITS)} long, block int, counts binary"))

    parts = digests.where("block is not null").select("block", "counts")
    merged = parts.mapInArrow(_added, parts.schema).repartition(F.col("block")).mapInArrow(_added, parts.schema)
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in merged.toLocalIterator():  # at most 2**(SKETCH_BITS - BLOCK_BITS) rows of fixed size
        sketch[row["block"] << BLOCK_BITS : (row["block"] + 1) << BLOCK_BITS] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    shared = spark.sparkContext.broadcast(np.minimum(sketch, 65535).astype(np.uint16))

    rows = digests.where("block is null").select("doc", "n", "one", "two", *BITS)
    same_set = ["n", "one", "two"]
    classes = saved(rows.where("n > 0 and doc is not null").groupBy(*same_set).agg(F.min("doc").alias("class"), F.count("*").alias("members")))
    # A row more than its class's least has it as a representative no longer.
    copies = saved(meet(rows.where("n > 0"), classes.where("members > 1"), same_set, spread="doc").select("doc", "class"))
    maps = saved(rows.where("n > 0 and doc is not null").join(copies.where("doc <> class").select("doc"), "doc", "left_anti").select("doc", *BITS).dropDuplicates(["doc"]))
    of = lambda side: maps.select(F.col("doc").alias(side), *(F.col(b).alias(f"{b}_{side}") for b in BITS))

    postings = source.where("doc is not null").mapInArrow(lambda b: _prefix_rows(b, n, percent, shared.value), "gram long, doc long, n int, place int")
    grouped = saved(postings.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1"))
    met = saved(meet(postings, grouped, ["gram"], spread="doc").join(maps.select("doc"), "doc", "left_semi"))
    # Pivots are taken among the representatives.
    lists = saved(met.groupBy("gram").agg(F.min(F.struct("doc", "n", "place")).alias("pivot"), F.max("doc").alias("most"), F.count("*").alias("members")).where("pivot.doc < most").select("gram", "pivot", "members"))
    live = saved(meet(met, lists, ["gram"], spread="doc"))
    release(grouped, met)

    def fits(n_a: str, place_a: str, n_b: str, place_b: str) -> F.Column:
        """Length and positional filters: the sizes are near enough, and enough shingles stand from the shared one on."""
        return F.expr(f"100 * least({n_a}, {n_b}) >= {percent} * greatest({n_a}, {n_b}) and {100 + percent} * (1 + least({place_a}, {place_b}) + least({n_a} - {place_a}, {n_b} - {place_b}) - 1) >= {percent} * ({n_a} + {n_b})")

    def linked(pairs: DataFrame) -> DataFrame:
        near = saved(pairs)
        ids = saved(near.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
        few = ids.count() <= BROADCAST_IDS  # then the texts of the others needn't be shuffled
        texts = saved(source.join(F.broadcast(ids) if few else ids, "doc").groupBy("doc").agg(F.min("text").alias("text")))
        pivots = saved(near.groupBy("a").agg(F.count("*").alias("members")).join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a"))
        # A pivot's text goes to the tasks of its pairs, not with each of them.
        both = meet(near.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b"), pivots, ["a"], spread="b")
        out = saved(both.select("a", "b", "text_a", "text_b").mapInArrow(lambda b: _verified(b, n, percent), "a long, b long"))
        release(near, ids, texts, pivots)
        return out

    distinct = lambda pairs: pairs.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    first = distinct(live.where("doc <> pivot.doc").where(fits("n", "place", "pivot.n", "pivot.place")).select(F.col("pivot.doc").alias("a"), F.col("doc").alias("b"), F.col("pivot.n").alias("n_a"), F.col("n").alias("n_b")))
    links = linked(first.join(of("a"), "a").join(of("b"), "b").where(_suffix_filter(percent)).select("a", "b"))
    known = components(links)

    member = saved(live.select("gram", "doc", "n", "place").join(known.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")))
    mixed = saved(member.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).where("low < high").withColumn("blocks", F.ceil(F.col("members") / LIST).cast("int")).select("gram", "members", "blocks"))
    rest = saved(meet(member, mixed, ["gram"], spread="doc").join(maps, "doc").withColumn("block", F.expr("int(pmod(xxhash64(doc), blocks))")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))))
    # Each pair of blocks of a list is a key of its own.
    keyed = rest.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    side = lambda s: keyed.select("gram", "low", "high", *(F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "place", "component", "block", *BITS)))
    across = side("a").join(side("b"), ["gram", "low", "high"]).where("doc_a < doc_b and component_a <> component_b and (low = high or block_a <> block_b)").where(fits("n_a", "place_a", "n_b", "place_b")).where(_suffix_filter(percent))
    more = distinct(across.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), "n_a", "n_b"))
    more = more.join(first.select("a", "b"), ["a", "b"], "left_anti")
    final = components(links.union(linked(more))).withColumnRenamed("node", "class")
    release(live, lists, member, mixed, rest)

    known = copies.where("doc <> class").distinct()
    same = rows.select("doc", "n").join(known, "doc", "left").withColumn("class", F.coalesce("class", "doc"))
    return same.join(final, "class", "left").select("doc", F.col("n").alias("n_shingles"), F.col("class").alias("class_id"), F.coalesce("component", "class").alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The documents without those that link with another of a lesser id in their group."""
    found = jaccard_components(docs, key=key, **options)
    gone = found.where(f"`{key}` <> component_id").select(key).distinct()
    return docs.join(gone, key, "left_anti")


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")
