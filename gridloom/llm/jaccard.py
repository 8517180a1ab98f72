"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams.

Rows of the matrix are distinct sets of shingle hashes, columns are shingles. Which rows can meet is found without loss: shingles
are ordered by the number of sets that hold them, exact over all documents, and two sets with a similarity of t or more
share a shingle among the n - ceil(t n) + 1 rarest of each. Most of these stand in one set only, so few rows are left; rows that
share one and whose sizes allow a link are tied, and tied rows form clusters. A cluster is multiplied in blocks of
rows: overlap counts add up over columns, and pairs are discarded that their sizes, or what columns are still to come,
cannot lift to the threshold.

Texts are read once. Shingles go to blocks of hashes, each with the sets of a chunk of documents that hold it, and only those
of two or more sets come back to their sets. From there on texts are not needed: overlaps are counted on shared
shingles, sizes on all. Nothing is a row a pair: ties within a block of sets or hashes are reduced to a forest before they leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship
from gridloom.llm.bytewords import column, mix, shingles, words
from gridloom.llm.components import components
from gridloom.llm.packing import block_of, cuts, joined, packed, unpacked
from gridloom.llm.store import cut, free

#: Sets a block of the product, and sets a tile where those outside of a large cluster's main component meet all others.
BLOCK_SETS, TILE_SETS = 256, 1024
#: Shared shingles a block of the product.
BLOCK_SHINGLES = 400_000
COLUMNS = 4096
#: What tables of numbers that go to all executors may take, and a row of such a table there.
BROADCAST_BYTES, BYTES_A_PLACE = 96 << 20, 48
#: Bytes of text that are worked on at a time, and bytes of text a block of hashes.
CHUNK_BYTES, BLOCK_BYTES = 8 << 20, 24 << 20
#: A shingle of so many sets of a chunk goes to its block once, not once a set; it is last in order everywhere.
HOT = 32
_LAST = np.int32(2**31 - 1)
_ROWS = "kind byte, block long, payload binary"
#: Kinds of rows: shingles, described documents, shared shingles of sets, ties of sets, runs of sets by shingle.
_SHINGLES, _DOCS, _SHARED, _TIES, _RUNS = range(5)


def _rows(kind, block, payload) -> pa.Table:
    return pa.table({"kind": pa.array(kind, pa.int8()), "block": pa.array(block, pa.int64()), "payload": pa.array(payload, pa.binary())})


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what ``u`` and ``v`` connect: each node with the smallest one it can reach."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not (new[new] == new).all():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    _, at = column(batch.column("text"))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def _incidence(width: int, blocks: int, most: int, hot_from: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each chunk of documents: what each is (id, size, digest), and the shingles of its distinct sets by block."""

    def of(part: pa.RecordBatch) -> pa.Table:
        hashes, starts = words(part.column("text"))
        sets = [np.unique(s) for s in shingles(hashes, starts, width)]
        size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        full = np.flatnonzero(size)
        c = np.zeros(len(sets), np.int64)
        if len(full):
            c[full] = mix(np.add.reduceat(mix(every), (np.cumsum(size) - size)[full]) + size[full].astype(np.uint64)).view(np.int64)
        ids = part.column("doc_id").to_numpy()
        kinds, where, payload = [_DOCS], [int(ids[0]) % blocks], [packed(ids, size, c)]
        names, lead = np.unique(c[full], return_index=True)  # copies give their shingles once
        lead = full[lead]
        if not len(lead):
            return _rows(kinds, where, payload)
        h = np.concatenate([sets[k] for k in lead.tolist()])
        sizes = size[lead].astype(np.int32)
        owner = np.repeat(np.arange(len(lead)), sizes)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        at = cuts(h)
        many = np.diff(at) >= hot_from
        marks = h[at[:-1][many]]
        hot = np.repeat(many, np.diff(at))
        if len(marks):
            got = np.argsort(owner[hot], kind="stable")
            held, shingle = owner[hot][got], h[hot][got]
            target = block_of(mix(names[held].view(np.uint64)), blocks)
            by = np.argsort(target, kind="stable")
            held, shingle, target = held[by], shingle[by], target[by]
            for a, b in zip((k := cuts(target))[:-1].tolist(), k[1:].tolist(), strict=True):
                kinds.append(_SHARED)
                where.append(int(target[a]))
                payload.append(_shared(names[held[a:b]], sizes[held[a:b]], shingle[a:b], np.full(b - a, _LAST, np.int32)))
            h, owner = h[~hot], owner[~hot]
        block, marked = block_of(h, blocks), block_of(marks, blocks)
        for k in np.union1d(block, marked).tolist():
            a, b = np.searchsorted(block, (k, k + 1))
            own, local = np.unique(owner[a:b], return_inverse=True)
            kinds.append(_SHINGLES)
            where.append(k)
            payload.append(packed(h[a:b], local.astype(np.uint16 if len(own) < 1 << 16 else np.uint32), names[own], sizes[own], marks[marked == k]))
        return _rows(kinds, where, payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, most):
                yield from of(part).to_batches()

    return run


def _shared(name: np.ndarray, size: np.ndarray, shingle: np.ndarray, held_by: np.ndarray) -> bytes:
    """Rows (set, its size, a shingle of it, how many sets hold that), sets together."""
    at = cuts(name)
    return packed(name[at[:-1]], size[at[:-1]], np.diff(at).astype(np.int32), shingle.view(np.int64), held_by)


def _counted(blocks: int) -> Callable[[pa.Table], pa.Table]:
    """Of a block of hashes: shingles of two or more sets, back to their sets. Described documents pass."""

    def run(group: pa.Table) -> pa.Table:
        kind = group["kind"].to_numpy()
        through = group.filter(pa.array(kind != _SHINGLES)).select(["kind", "block", "payload"])
        parts = [unpacked(x) for x in group.filter(pa.array(kind == _SHINGLES))["payload"].to_pylist()]
        if not parts:
            return through
        h = np.concatenate([p[0] for p in parts])
        name = np.concatenate([p[2][p[1]] for p in parts])
        size = np.concatenate([p[3][p[1]] for p in parts])
        marks = np.unique(np.concatenate([p[4] for p in parts]))
        parts.clear()
        order = np.lexsort((name, h))
        h, name, size = h[order], name[order], size[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (name[1:] != name[:-1])
        h, name, size = h[new], name[new], size[new]
        at = cuts(h)
        held_by = np.minimum(np.diff(at), _LAST - 1).astype(np.int32)
        held_by[np.isin(h[at[:-1]], marks)] = _LAST
        held_by = np.repeat(held_by, np.diff(at))
        keep = held_by > 1
        h, name, size, held_by = h[keep], name[keep], size[keep], held_by[keep]
        target = block_of(mix(name.view(np.uint64)), blocks)
        order = np.lexsort((name, target))
        h, name, size, held_by, target = h[order], name[order], size[order], held_by[order], target[order]
        k = cuts(target)
        payload = [_shared(name[a:b], size[a:b], h[a:b], held_by[a:b]) for a, b in zip(k[:-1].tolist(), k[1:].tolist(), strict=True)]
        return pa.concat_tables([through, _rows([_SHARED] * len(payload), target[k[:-1]], payload)])

    return run


def prefixes(name: np.ndarray, size: np.ndarray, shingle: np.ndarray, held_by: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows (set, its size, a shared shingle, how many sets hold that; by set, then from rare to common) stand in a prefix.

    A set's shingles that no other set holds come before all shared ones."""
    at = cuts(name)
    shared = np.diff(at)
    n = size[at[:-1]].astype(np.int64)
    take = n - -(-num * n // den) + 1 - (n - shared)
    return np.arange(len(name)) - np.repeat(at[:-1], shared) < np.repeat(take, shared)


def _fits(small: np.ndarray, large: np.ndarray, num: int, den: int) -> np.ndarray:
    return small.astype(np.int64) * den >= num * large.astype(np.int64)


def _active(blocks: int, num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    """Of a block of sets: those with a shared shingle in their prefix, each with all its shared ones; ties between
    them; and, by shingle, the runs of sizes that are tied already."""
    names = ["kind", "block", "payload", "name", "n"]

    def run(group: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in group["payload"].to_pylist()]
        name = np.concatenate([np.repeat(p[0], p[2]) for p in parts])
        size = np.concatenate([np.repeat(p[1], p[2]) for p in parts])
        shingle = np.concatenate([p[3] for p in parts]).view(np.uint64)
        held_by = np.concatenate([p[4] for p in parts])
        order = np.lexsort((shingle, held_by, name))
        name, size, shingle, held_by = name[order], size[order], shingle[order], held_by[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (shingle[1:] != shingle[:-1])  # copies report a hot shingle from each chunk
        name, size, shingle, held_by = name[new], size[new], shingle[new], held_by[new]
        first = prefixes(name, size, shingle, held_by, num, den)
        at = cuts(name)
        active = np.flatnonzero(np.logical_or.reduceat(first, at[:-1])) if len(name) else np.zeros(0, np.int64)
        rows = [pa.table({
            "kind": pa.array(np.full(len(active), _SHARED), pa.int8()), "block": pa.nulls(len(active), pa.int64()),
            "payload": pa.array([np.sort(shingle[at[k] : at[k + 1]]).tobytes() for k in active.tolist()], pa.binary()),
            "name": pa.array(name[at[active]]), "n": pa.array(size[at[active]].astype(np.int64)),
        })]
        h, owner, n = shingle[first], name[first], size[first]
        order = np.lexsort((n, h))
        h, owner, n = h[order], owner[order], n[order]
        tied = (h[1:] == h[:-1]) & _fits(n[:-1], n[1:], num, den)
        u, v = forest(owner[:-1][tied], owner[1:][tied])
        begin = np.flatnonzero(np.concatenate([[True], ~tied])) if len(h) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(h)) - 1 if len(h) else begin
        block = block_of(h[begin], blocks)
        k = cuts(block)
        payload = [packed(h[begin[a:b]], owner[begin[a:b]], n[begin[a:b]], n[end[a:b]]) for a, b in zip(k[:-1].tolist(), k[1:].tolist(), strict=True)]
        more = _rows([_TIES, *[_RUNS] * len(payload)], [0, *block[k[:-1]].tolist()], [packed(u, v), *payload])
        rows.append(more.append_column("name", pa.nulls(more.num_rows, pa.int64())).append_column("n", pa.nulls(more.num_rows, pa.int64())))
        return pa.concat_tables([r.select(names) for r in rows])

    return run


def _tied(num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    """Ties between runs of sizes (smallest, largest) of one shingle."""

    def run(group: pa.Table) -> pa.Table:
        h, owner, low, high = joined(group["payload"].to_pylist(), (np.uint64, np.int64, np.int32, np.int32))
        order = np.lexsort((low, h))
        h, owner, low, high = h[order], owner[order], low[order], high[order]
        at = cuts(h)
        # The largest size so far within a shingle; sizes are lifted by the run's number, so that one pass serves all.
        lift = np.repeat(np.arange(len(at) - 1), np.diff(at)) << 33
        reach = np.maximum.accumulate(high + lift) - lift
        tied = (h[1:] == h[:-1]) & _fits(reach[:-1], low[1:], num, den)
        u, v = forest(owner[:-1][tied], owner[1:][tied])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = joined(batch.column("payload").to_pylist(), (np.int64, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = joined(batch.column("payload").to_pylist(), (np.int64,) * 3)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["doc_id", "n", "c"])


def product(left: list[np.ndarray], num: int, den: int, size: np.ndarray | None = None, right: list[np.ndarray] | None = None, right_size: np.ndarray | None = None) -> np.ndarray:
    """Boolean matrix: which sets of ``left`` have a Jaccard similarity of num/den or more with which of ``right`` (else of
    ``left``, without themselves). Sizes are given where the sets lack shingles that no other has."""
    own = right is None
    right = left if own else right
    a = np.array([len(s) for s in left], np.int64) if size is None else size.astype(np.int64)
    b = a if own else np.array([len(s) for s in right], np.int64) if right_size is None else right_size.astype(np.int64)
    total = a[:, None] + b[None, :]
    alive = (a[:, None] * den >= num * b[None, :]) & (b[None, :] * den >= num * a[:, None])
    if own:
        np.fill_diagonal(alive, False)
    if not alive.any():
        return alive

    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        return every[order], doc[order]

    (h, x), (g, y) = entries(left), entries(right)
    columns = np.intersect1d(h, g)
    c, d = np.searchsorted(columns, h), np.searchsorted(columns, g)
    keep = (c < len(columns)) & (columns[np.minimum(c, len(columns) - 1)] == h) if len(columns) else np.zeros(len(h), bool)
    c, x = c[keep], x[keep]
    keep = (d < len(columns)) & (columns[np.minimum(d, len(columns) - 1)] == g) if len(columns) else np.zeros(len(g), bool)
    d, y = d[keep], y[keep]
    in_left, in_right = np.bincount(c, minlength=len(columns)), np.bincount(d, minlength=len(columns))
    shape = (len(left), len(right))
    # Columns of few rows are multiplied entry by entry, the others as dense strips.
    thin = in_left * in_right * 100 <= shape[0] * shape[1]
    few = np.flatnonzero(thin[c])
    times = in_right[c[few]]
    at = np.repeat((np.cumsum(in_right) - in_right)[c[few]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    overlap = np.bincount(np.repeat(x[few], times) * shape[1] + y[at], minlength=shape[0] * shape[1]).reshape(shape).astype(np.float32)
    wide = ~thin
    place = np.cumsum(wide) - 1
    x, c = x[wide[c]], place[c[wide[c]]]
    y, d = y[wide[d]], place[d[wide[d]]]
    rest_x, rest_y = np.bincount(x, minlength=shape[0]), np.bincount(y, minlength=shape[1])
    for low in range(0, int(wide.sum()), COLUMNS):
        alive &= (overlap + np.minimum(rest_x[:, None], rest_y[None, :])) * (den + num) >= num * total
        if not alive.any():
            return alive
        strip = min(COLUMNS, int(wide.sum()) - low)
        sides = []
        for doc, col, rows in ((x, c, shape[0]), (y, d, shape[1])):
            i, j = np.searchsorted(col, (low, low + strip))
            dense = np.zeros((rows, strip), np.float32)
            dense[doc[i:j], col[i:j] - low] = 1
            sides.append(dense)
            rest = rest_x if doc is x else rest_y
            rest -= np.bincount(doc[i:j], minlength=rows)
        overlap += sides[0] @ sides[1].T
    return alive & (overlap.astype(np.float64) * (den + num) >= num * total)


def _tasks(of: Callable[[pa.Table], pa.Table | None], keys: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``of`` each run of rows with equal ``keys``; rows come ordered by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def ends(t: pa.Table) -> np.ndarray:
            task = np.stack([t[k].to_numpy() for k in keys])
            return np.concatenate([[0], np.flatnonzero((task[:, 1:] != task[:, :-1]).any(0)) + 1, [t.num_rows]])

        def emit(t: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            got = [x for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if (x := of(t.slice(a, b - a))) is not None]
            if got:
                yield from pa.concat_tables(got).combine_chunks().to_batches()

        for batch in batches:
            if batch.num_rows:
                t = pa.concat_tables([*held, pa.Table.from_batches([batch])])
                at = ends(t)
                yield from emit(t, at[:-1])
                held = [t.slice(int(at[-2]))]
        if held:
            yield from emit(held[0], ends(held[0]))

    return run


def _block(name: np.ndarray, size: np.ndarray, sets: list[np.ndarray]) -> bytes:
    """A block's rows of the matrix: its columns once, and for each set the gaps between the columns it has. Sets of a cluster
    share most columns, so gaps are small and alike."""
    count = np.array([len(s) for s in sets], np.int32)
    columns, at = np.unique(np.concatenate(sets), return_inverse=True)
    gap = np.diff(at, prepend=0)
    first = (np.cumsum(count) - count)[count > 0]
    gap[first] = at[first]
    return packed(name, size, count, columns, gap.astype(np.uint32))


def _sets_of(payload: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    name, size, count, columns, gap = unpacked(payload)
    ends = np.cumsum(count)
    total = np.concatenate([[0], np.cumsum(gap.astype(np.int64))])
    at = total[1:] - np.repeat(total[ends - count], count)
    return name, size, np.split(columns[at], ends[:-1])


def _edges(name: np.ndarray, other: np.ndarray, link: np.ndarray) -> pa.Table:
    i, j = np.nonzero(link)
    u, v = forest(name[i], other[j])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _linked(num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    """Links within a cluster of one block."""

    def of(t: pa.Table) -> pa.Table:
        name = t["name"].to_numpy()
        return _edges(name, name, product([np.frombuffer(x, np.uint64) for x in t["payload"].to_pylist()], num, den, t["n"].to_numpy()))

    return of


def _gathered(t: pa.Table) -> pa.Table:
    """One row a block, with all its sets."""
    sets = [np.frombuffer(x, np.uint64) for x in t["payload"].to_pylist()]
    payload = _block(t["name"].to_numpy(), t["n"].to_numpy(), sets)
    return t.slice(0, 1).select(["c", "block"]).append_column("sets", pa.array([payload], pa.binary()))


def _first_links(num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    """Links within a block (the second row, if any) and between it and the cluster's first block."""

    def of(t: pa.Table) -> pa.Table:
        both = [_sets_of(x) for x in t["sets"].to_pylist()]
        name, size = (np.concatenate([b[k] for b in both]) for k in (0, 1))
        return _edges(name, name, product([s for b in both for s in b[2]], num, den, size))

    return of


def _outer_links(num: int, den: int) -> Callable[[pa.Table], pa.Table | None]:
    """Links between an outer tile (its row comes first) and the sets of a stripe of blocks."""

    def of(t: pa.Table) -> pa.Table | None:
        if t["block"][0].as_py() >= 0 or t.num_rows < 2:
            return None
        mine = _sets_of(t["sets"][0].as_py())
        out = []
        for x in t["sets"].to_pylist()[1:]:
            name, size, sets = _sets_of(x)
            link = product(mine[2], num, den, mine[1], sets, size)
            link &= mine[0][:, None] != name[None, :]
            out.append(_edges(mine[0], name, link))
        return pa.concat_tables(out)

    return of


_EDGES = "u long, v long"


def _links(sets: DataFrame, clusters: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): a forest of the links of ``sets`` (name, n, payload: shared shingles) within ``clusters`` (node, component)."""
    known = sets.select("name", "n", (F.octet_length("payload") / 8).alias("_held")).join(clusters.withColumnsRenamed({"node": "name", "component": "c"}), "name")
    whole = known.groupBy("c").agg(F.count("*").alias("_sets"), F.sum("_held").alias("_all"))
    many = F.ceil(F.greatest(F.col("_sets") / BLOCK_SETS, F.least(F.col("_sets") / 2, F.col("_all") / BLOCK_SHINGLES))).cast("int")
    places = known.select("name", "c").join(whole.select("c", many.alias("blocks")), "c").withColumn("block", F.expr("cast(pmod(xxhash64(name), blocks) as int)"))
    # A few numbers a set go to where its shingles are, so that these move once, to their block; beyond a bound they meet by a shuffle.
    places = cut(places, "places")
    few = places.count() * BYTES_A_PLACE <= BROADCAST_BYTES
    rows = sets.join(F.broadcast(places) if few else places, "name").select("c", "blocks", "block", "name", "n", "payload")
    rows = rows if few else cut(rows, "placed")

    small = rows.filter("blocks = 1").select("c", "name", "n", "payload").repartition("c").sortWithinPartitions("c", "name")
    links = cut(small.mapInArrow(_tasks(_linked(num, den), ("c",)), _EDGES), "links")
    large = places.filter("blocks > 1")
    if large.isEmpty():
        free(rows)
        return links

    # Every block meets the first; what is then outside of its cluster's largest component meets all.
    def gathered(df: DataFrame, name: str) -> DataFrame:
        df = df.select("c", "block", "name", "n", "payload").repartition("c", "block").sortWithinPartitions("c", "block", "name")
        return cut(df.mapInArrow(_tasks(_gathered, ("c", "block")), "c long, block int, sets binary"), name)

    gathered_blocks = gathered(rows.filter("blocks > 1"), "blocks")
    near = F.broadcast if few else (lambda x: x)  # no table of clusters has more rows than places
    blocks = gathered_blocks.join(near(large.groupBy("c").agg(F.max("blocks").alias("blocks"))), "c")
    to = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = blocks.select("c", "block", "sets", F.explode(to).alias("task")).repartition("c", "task").sortWithinPartitions("c", "task", "block")
    links = cut(links.unionByName(first.mapInArrow(_tasks(_first_links(num, den), ("c", "task")), _EDGES)), "links")
    reached = large.select("c", "name").join(components(links).withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    parts = reached.groupBy("c", "component").agg(F.count("*").alias("k"))
    main = parts.groupBy("c").agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("_all"))
    main = main.select("c", F.col("m.component").alias("_main"), F.ceil((F.col("_all") - F.col("m.k")) / TILE_SETS).cast("int").alias("tiles")).filter("tiles > 0")
    outside = cut(reached.join(main, "c").filter("component <> _main").select("name", "tiles"), "outside")
    if outside.isEmpty():
        free(rows, gathered_blocks)
        return links
    tiles = gathered(rows.filter("blocks > 1").join(near(outside), "name").withColumn("block", F.expr("cast(pmod(xxhash64(name, 1), tiles) as int)")), "tiles")
    stripe = max(1, TILE_SETS // BLOCK_SETS)
    counts = near(main.select("c", "tiles").join(large.groupBy("c").agg(F.max("blocks").alias("blocks")), "c"))
    stripes = F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / stripe).cast("int"))
    a = tiles.join(counts, "c").select("c", F.col("block").alias("tile"), F.explode(stripes).alias("stripe"), F.lit(-1).alias("block"), "sets")
    b = blocks.drop("blocks").join(counts, "c").select("c", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.floor(F.col("block") / stripe).cast("int").alias("stripe"), "block", "sets")
    second = a.unionByName(b).repartition("c", "tile", "stripe").sortWithinPartitions("c", "tile", "stripe", "block")
    links = cut(links.unionByName(second.mapInArrow(_tasks(_outer_links(num, den), ("c", "tile", "stripe")), _EDGES)), "links")
    free(rows, gathered_blocks, tiles)
    return links


def join(documents: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each input row.

    A text's set: its distinct shingles of ``width`` words (A-Z lower-cased, split at ASCII white space); fewer words are one
    shingle, no words none. Two documents link when den * intersection >= num * union; sets are compared by 64-bit hashes.
    ``component_id`` is the smallest doc_id reachable by links, itself included. No link between different sets is
    lost and none is capped; copies are one row of the product. Equal sets are told by a 64-bit digest.

    Clusters of over BLOCK_SETS sets are dealt into blocks. Each block meets itself and the first block, and then only
    sets outside of the cluster's largest component meet the other blocks, tile by tile; so a group of near copies that
    link costs about its size, one in which very many link with nothing costs more.

    Null or empty text: no shingles, linked with nothing. Null doc_id: component_id null, never linked. A doc_id that
    repeats is one node with all its texts. Empty table: no rows. Other columns are ignored.
    """
    if not 0 < num <= den or width < 1:
        raise ValueError("the threshold lies in (0, 1], the width is positive")
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.filter("doc_id is not null")
    read = named.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read // BLOCK_BYTES))

    shingled = named.mapInArrow(_incidence(width, blocks, CHUNK_BYTES, HOT), _ROWS)
    counted = cut(shingled.groupBy("block").applyInArrow(_counted(blocks), _ROWS), "counted")
    described = cut(counted.filter(f"kind = {_DOCS}").select("payload").mapInArrow(_documents_of, "doc_id long, n long, c long"), "described")
    shared = counted.filter(f"kind = {_SHARED}").select("block", "payload")
    active = cut(shared.groupBy("block").applyInArrow(_active(blocks, num, den), f"{_ROWS}, name long, n long"), "active")
    free(counted)
    ties = active.filter(f"kind = {_TIES}").select("payload").mapInArrow(_pairs_of, _EDGES)
    ties = ties.unionByName(active.filter(f"kind = {_RUNS}").select("block", "payload").groupBy("block").applyInArrow(_tied(num, den), _EDGES))
    links = _links(active.filter(f"kind = {_SHARED}").select("name", "n", "payload"), components(ties), num, den)

    free(active)

    # Equal sets are one node, named by the smallest doc_id; a doc_id with several texts joins their nodes.
    full = described.filter("n > 0")
    sets = cut(full.groupBy("c").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_rows")), "sets")
    several = full.select("doc_id", "c").distinct().groupBy("doc_id").agg(F.min("c").alias("u"), F.count("*").alias("_k")).filter("_k > 1")
    several = full.select("doc_id", F.col("c").alias("v")).join(several.select("doc_id", "u"), "doc_id").select("u", "v").distinct()
    rep = lambda x: sets.select(F.col("c").alias(x), F.col("rep").alias(f"_{x}"))
    named_links = links.unionByName(several).join(rep("u"), "u").join(rep("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    found = components(named_links).withColumnsRenamed({"node": "rep", "component": "component_id"})
    sets = cut(sets.join(found, "rep", "left").select("c", "_rows", F.coalesce("component_id", "rep").alias("component_id")), "labelled")
    # Sets of very many copies are few, 100,000 at most, and go to all executors, so no key of the join is hot.
    heavy = max(4096, described.count() // 100_000)
    often, seldom = F.broadcast(sets.filter(F.col("_rows") > heavy).drop("_rows")), sets.filter(F.col("_rows") <= heavy).drop("_rows")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    out = full.join(often, "c").select(*columns).unionByName(full.join(often.select("c"), "c", "left_anti").join(seldom, "c").select(*columns))
    empty = described.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).unionByName(_unnamed(docs, width))


def _sizes(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, starts = words(batch.column("text"))
            n = pa.array([len(np.unique(s)) for s in shingles(hashes, starts, width)], pa.int64())
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, n, none], names=["doc_id", "n_shingles", "component_id"])

    return run


def _unnamed(docs: DataFrame, width: int) -> DataFrame:
    return docs.filter("doc_id is null").mapInArrow(_sizes(width), "doc_id long, n_shingles long, component_id long")
