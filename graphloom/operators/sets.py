"""Uniting the sets of nodes that roots have reached, as a fold over sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Nodes of an array of successors, nodes of one root that a task holds at most (about), and of an array of its result.
PIECE, PART, CHUNK = 1024, 1 << 22, 1 << 16
#: Values of one group that are held before what repeats among them goes.
HELD = 1 << 22
#: Integers that lie within such a range are numbers as they are.
NEAR = 1 << 32


def _firsts(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The different (root, part, node) of the rows, each at its least depth, as (row, node) with the depth; the rows' order stays."""
    lists = rows.column("nodes").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(rows.num_rows), sizes)
    values = lists.flatten()
    codes = _codes(values)
    groups = _groups(rows)[row]
    depth = rows.column("depth").to_numpy().astype(np.int64)[row]
    key = groups * (codes.max(initial=0) + 1) + codes
    order = np.argsort(key * (depth.max(initial=0) + 1) + depth)
    first = np.ones(len(order), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    chosen = order[first]
    tags = {"tag": rows.column("tags").combine_chunks().flatten().take(pa.array(chosen))} if "tags" in rows.column_names else {}
    return pa.table({"row": pa.array(row[chosen]), "node": values.take(pa.array(chosen))} | tags), depth[chosen]


def _codes(values: pa.Array) -> np.ndarray:
    """A number for each different value."""
    if pa.types.is_integer(values.type) and len(values):
        numbers = values.to_numpy().astype(np.int64)
        least = numbers.min()
        if int(numbers.max()) - int(least) < NEAR:
            return numbers - least
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _groups(rows: pa.Table) -> np.ndarray:
    """The number of each row's (root, part); rows of one group follow each other."""
    root = rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    part = rows.column("part").to_numpy()
    change = np.zeros(rows.num_rows, np.int64)
    change[1:] = (root[1:] != root[:-1]) | (part[1:] != part[:-1])
    return np.cumsum(change)


def _sets(rows: pa.Table, found: pa.Table, depth: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """Rows (root, part, depth, nodes and maybe tags) of found (row, node and maybe tag): nodes of one group and depth that follow each other become one array."""
    row = found.column("row").to_numpy()
    group = _groups(rows)[row]
    cut = np.ones(len(row), bool)
    cut[1:] = (group[1:] != group[:-1]) | (depth[1:] != depth[:-1])
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, len(row)))
    at = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, a + n, CHUNK) for a, n in zip(at, size, strict=True))]) if size.max(initial=0) > CHUNK else at
    lists = [pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)), found.column(c).combine_chunks()) for c in found.column_names[1:]]
    head = pa.array(row[at])
    whose = [rows.column(c).combine_chunks().take(head) for c in schema.names if c in ("block", "root", "part")]
    columns = [*whose, pa.array(depth[at].astype(np.int32)), *lists]
    return pa.RecordBatch.from_arrays([c.cast(schema.field(n).type) for c, n in zip(columns, schema.names, strict=True)], names=schema.names)


def united(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Rows (root, part, depth, nodes) sorted by root and part; returns the sets of nodes that a root and part have first at this depth."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> pa.RecordBatch:
        found, depth = _firsts(rows)
        new = depth == level
        return _sets(rows, found.filter(pa.array(new)), depth[new], rows.schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        group = _groups(pa.Table.from_batches([batch]))
        start = int(np.searchsorted(group, group[-1]))
        same = bool(held) and (held[-1].column("root")[-1], held[-1].column("part")[-1]) == (batch.column("root")[0], batch.column("part")[0])
        if held and (start or not same):
            yield done(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held = []
        elif start:
            yield done(pa.Table.from_batches([batch.slice(0, start)]))
        held.append(batch.slice(start))
        if len(held) > 1 and sum(len(b.column("nodes").flatten()) for b in held) > HELD:
            rows = pa.Table.from_batches(held)
            found, depth = _firsts(rows)
            order = np.argsort(depth, kind="stable")
            held = [_sets(rows, found.take(pa.array(order)), depth[order], rows.schema)]
    if held:
        yield done(pa.Table.from_batches(held))


def expanded(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, root, node, part, depth, nodes and maybe tags) sorted by block, node and root, of three kinds: sets that a root has, without a node; pieces of
    a node's successors, without a root; and roots that go on from a node, which follow its pieces. Returns the sets as they are, and a piece for each root that goes on."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        out = rows.drop_columns(["node"])
        node = rows.column("node").combine_chunks()
        has, piece = ~node.is_null().to_numpy(zero_copy_only=False), rows.column("root").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        code, block = node.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), rows.column("block").to_numpy()
        first = np.ones(len(code), bool)
        first[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
        group, start = np.cumsum(first) - 1, np.flatnonzero(first)
        pieces = np.bincount(group[piece], minlength=len(start))
        size = rows.column("nodes").combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        nodes = np.bincount(group[piece], size[piece], minlength=len(start)).astype(np.int64)
        if not has.all():
            yield from out.filter(pa.array(~has)).combine_chunks().to_batches()
        going = np.flatnonzero(has & ~piece)
        turn = np.cumsum(nodes[group[going]]) // CHUNK
        for on in np.split(going, np.flatnonzero(turn[1:] != turn[:-1]) + 1):
            times = pieces[group[on]]
            at = np.repeat(start[group[on]] - np.cumsum(times) + times, times) + np.arange(times.sum())
            root = rows.column("root").take(pa.array(np.repeat(on, times)))
            met = out.take(pa.array(at)).set_column(out.column_names.index("root"), "root", root)
            met = met.set_column(met.column_names.index("depth"), "depth", pa.array(np.full(len(at), level, np.int32)))
            yield from met.combine_chunks().to_batches()
        held = rows.slice(start[-1], pieces[-1]).to_batches() if pieces[-1] else []


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, depth, tag, n, least): how many nodes of a tag each set has, and the least of them."""
    for batch in batches:
        lists, tags = batch.column("nodes"), batch.column("tags").flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        values = lists.flatten()
        if pa.types.is_integer(values.type):
            place, named = values.to_numpy(), None
        else:
            coded = values.dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            turn = np.empty(len(order), np.int64)
            turn[order.to_numpy()] = np.arange(len(order))
            place, named = turn[coded.indices.to_numpy()], coded.dictionary.take(order)
        known, code = np.unique(tags, return_inverse=True)
        key = row * max(len(known), 1) + code
        by = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1])) if len(by) else by
        least = np.minimum.reduceat(place[by], start) if len(by) else place
        at = by[start]
        head = pa.array(row[at])
        least = pa.array(least) if named is None else named.take(pa.array(least))
        columns = [batch.column("root").take(head), batch.column("depth").take(head), pa.array(tags[at]), pa.array(np.diff(np.append(start, len(by))).astype(np.int64)), least.cast(values.type)]
        yield pa.RecordBatch.from_arrays(columns, names=["root", "depth", "tag", "n", "least"])
