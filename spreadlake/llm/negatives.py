"""Hard negatives by dual-tree search: trees over anchors and candidates, node pairs pruned by intervals.

Rows of equal label and equal integer vector have equal scores with every anchor, so of each such group only
the first LIMIT ids can be among the answers; the others are left out before anything is compared (a group of
copies may hold any share of the rows).  The same holds for anchors: each distinct one is searched for once.

An upper tree, fitted on at most SAMPLE rows, routes all rows to cells; cells over BLOCK rows are salted into
blocks.  A task holds one block at a time with a tree of its own, and anchors, in chunks with trees of their own,
stream past it.  For a pair of nodes the inner products lie in an interval given by centres, radii and norms; a
pair is pruned, for all anchors of its node at once, where the interval lies below the smallest score that can
still be among the first k, or above the largest score allowed.  Leaf pairs that are left are scored exactly, in
integers.  The sample gives the first bounds (its k-th best is never above the true one).  Intervals are also
tried between chunks and cells, before a chunk is sent to a cell.

Where vectors are as good as random in many dimensions, few pairs can be pruned, and the search is that of all
anchors against all rows, in blocks.

Rows: those of a null id, label or vector, or of a null, non-finite or huge component (2**20 or more, whose
scores don't fit a long) take no part.  Equal rows (id, label and vector) count once.  Vectors of unequal
lengths are scored over the places they share.  An anchor's other rows are all but itself.  Other columns stay
out, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import table
from .textcore import packed

POSITIVES, NEGATIVES = 5, 5
LIMIT = max(POSITIVES + 1, NEGATIVES)  # the anchor itself may be among its group
SAMPLE = 4096
LEAST_DEPTH, MOST_DEPTH = 5, 10
BLOCK, CHUNK = 1 << 16, 512
LEAF, ANCHOR_LEAF, BATCH = 256, 64, 16
LOW, HIGH = -(1 << 62), 1 << 62
HUGE = 1 << 28


class Tree:
    """A binary tree over vectors: levels of nodes of equal size, each with centre, radius and greatest norm."""

    def __init__(self, vectors: np.ndarray, leaf: int) -> None:
        n = len(vectors)
        depth = max(0, (max(n, 1) - 1) // leaf).bit_length()
        order, starts = np.arange(n), [np.array([0, n])]
        for _ in range(depth):
            cuts = starts[-1]
            new = [0]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                mid = (lo + hi) // 2
                part = vectors[order[lo:hi]]
                if hi - lo > 1:
                    widest = int(part.var(axis=0).argmax()) if part.shape[1] else 0
                    if part.shape[1]:
                        order[lo:hi] = order[lo:hi][np.argpartition(part[:, widest], mid - lo, kind="introselect")]
                new += [mid, hi]
            starts.append(np.array(new))
        self.order, self.starts = order, starts
        sorted_vectors = vectors[order].astype(np.float64)
        norms = np.sqrt((sorted_vectors**2).sum(axis=1))
        self.nodes = []
        for cuts in starts:
            size = np.diff(cuts)
            centre = np.add.reduceat(sorted_vectors, cuts[:-1], axis=0) / np.maximum(size, 1)[:, None]
            away = np.sqrt(((sorted_vectors - np.repeat(centre, size, axis=0)) ** 2).sum(axis=1))
            self.nodes.append((centre, np.maximum.reduceat(away, cuts[:-1]), np.maximum.reduceat(norms, cuts[:-1])))


def intervals(a: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each node of a with each node of c, with some slack for rounding."""
    (ca, ra, na), (cc, rc, nc) = a, c
    middle = ca @ cc.T
    la, lc = np.sqrt((ca**2).sum(axis=1)), np.sqrt((cc**2).sum(axis=1))
    reach = la[:, None] * rc + ra[:, None] * lc + ra[:, None] * rc
    slack = 1e-9 * (la[:, None] * lc + reach) + 1e-6
    most = na[:, None] * nc + slack
    return np.maximum(middle - reach - slack, -most), np.minimum(middle + reach + slack, most)


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(a.shape[1], 1)
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (a.astype(kind) @ c.astype(kind).T).astype(np.int64)


def widened(vectors: np.ndarray, d: int) -> np.ndarray:
    return vectors if vectors.shape[1] == d else np.pad(vectors, ((0, 0), (0, d - vectors.shape[1])))


def first_of(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k entries of each query: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, query))
    query = query[order]
    start = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    kept = order[rank < k]
    return query[rank < k], score[kept], ids[kept]


class Queries:
    """Queries of a chunk: owner (row of its anchor), cap (largest score allowed) and floor (smallest that can count)."""

    def __init__(self, owner: np.ndarray, cap: np.ndarray, floor: np.ndarray) -> None:
        self.owner, self.cap, self.floor = owner, cap, floor.copy()


class Block:
    """Candidates of a block, in the order of their tree."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> None:
        self.tree = Tree(vectors, LEAF) if len(vectors) else None  # nothing is searched in an empty block
        at = self.tree.order if len(vectors) else slice(0)
        self.vectors, self.labels, self.ids = vectors[at], labels[at], ids[at]
        self.top = int(np.abs(vectors).max(initial=0))


def search(block: Block, vectors: np.ndarray, labels: np.ndarray, asked: Queries, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id) of the first k candidates of a block for each query, of the anchor's label or of others.

    Candidates whose score is below the query's floor or above its cap don't count.
    """
    none = np.zeros(0, np.int64)
    found = none, none, none
    if not len(block.ids) or not len(asked.owner):
        return found
    d = max(vectors.shape[1], block.vectors.shape[1])
    wide, cand = widened(vectors, d), widened(block.vectors, d)
    tree = Tree(wide, ANCHOR_LEAF)
    place = np.argsort(tree.order)  # anchor -> place in its tree
    by_place = np.argsort(place[asked.owner], kind="stable")
    place_of = place[asked.owner][by_place]

    def over_nodes(values: np.ndarray, cuts: np.ndarray, join: np.ufunc, empty: int) -> np.ndarray:
        at = np.searchsorted(place_of, cuts)
        out = np.full(len(cuts) - 1, empty, np.int64)
        some = at[:-1] < at[1:]
        if some.any():
            out[some] = join.reduceat(values[by_place], at[:-1][some])
        return out

    exact = np.float32 if int(np.abs(wide).max(initial=0)) * block.top * d < 1 << 24 else None
    if exact:
        wide, cand = wide.astype(exact), cand.astype(exact)
    centres = [(widened(c, d), r, n) for c, r, n in block.tree.nodes]
    alive, a, c = np.ones((1, 1), bool), 0, 0
    while True:  # both trees downwards; what a pair of parents excludes is excluded below
        low, high = intervals(tree.nodes[a], centres[c])
        cuts = tree.starts[a]
        alive &= (high >= over_nodes(asked.floor, cuts, np.minimum, HIGH)[:, None]) & (low <= over_nodes(asked.cap, cuts, np.maximum, LOW)[:, None])
        if a + 1 == len(tree.nodes) and c + 1 == len(centres) or not alive.any():
            break
        if a + 1 < len(tree.nodes):
            a, alive = a + 1, np.repeat(alive, 2, axis=0)
        if c + 1 < len(centres):
            c, alive = c + 1, np.repeat(alive, 2, axis=1)
    leaves, cuts, at = block.tree.starts[c], tree.starts[a], np.searchsorted(place_of, tree.starts[a])
    for i in np.flatnonzero(alive.any(axis=1)).tolist():
        queries = by_place[at[i] : at[i + 1]]
        anchors = tree.order[cuts[i] : cuts[i + 1]]
        row = place_of[at[i] : at[i + 1]] - cuts[i]
        left = np.flatnonzero(alive[i])
        left = left[np.argsort(-high[i, left], kind="stable")]
        got = none, none, none
        while len(left):
            left = left[high[i, left] >= asked.floor[queries].min()]
            now, left = left[:BATCH], left[BATCH:]
            if not len(now):
                break
            span = np.concatenate([np.arange(leaves[j], leaves[j + 1]) for j in now.tolist()])
            score = wide[anchors] @ cand[span].T if exact else products(wide[anchors], cand[span])
            hit, col = np.nonzero(score[row] >= asked.floor[queries][:, None])
            value = score[row[hit], col].astype(np.int64)
            label = block.labels[span[col]] == labels[anchors[row[hit]]]
            ok = (label == same) & (value <= asked.cap[queries[hit]])
            if not ok.any():
                continue
            got = first_of(*(np.concatenate([x, y]) for x, y in zip(got, (queries[hit[ok]], value[ok], block.ids[span[col[ok]]]), strict=True)), k)
            tighten(asked, got[0], got[1], k)
        found = tuple(np.concatenate([x, y]) for x, y in zip(found, got, strict=True))
    return found


def tighten(asked: Queries, query: np.ndarray, score: np.ndarray, k: int) -> None:
    """Raises the floor of each query that has k entries to its k-th (entries by query, best first)."""
    last = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if len(query) else np.zeros(0, int)
    size = np.diff(np.append(-1, last))
    full = last[size >= k]
    asked.floor[query[full]] = np.maximum(asked.floor[query[full]], score[full])


class Router:
    """The upper tree: median splits of a sample along the way between two far rows of it.  Cells are its leaves."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth, self.d = depth, sample.shape[1]
        self.ways, self.cuts = np.zeros((2**depth - 1, self.d)), np.full(2**depth - 1, np.inf)
        at = np.zeros(len(sample), int)
        for node in range(2**depth - 1):
            mine = sample[at == node]
            if len(mine) > 1:
                far = mine[((mine - mine.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                other = mine[((mine - far) ** 2).sum(axis=1).argmax()]
                on_way = mine @ (other - far)
                cut = np.median(on_way)
                if on_way.min() < cut or on_way.max() > cut:
                    self.ways[node], self.cuts[node] = other - far, cut if on_way.max() > cut else np.nextafter(cut, -np.inf)
            here = np.flatnonzero(at == node)
            at[here] = 2 * node + 1 + (sample[here] @ self.ways[node] > self.cuts[node])
        cell = at - (2**depth - 1)
        self.centres = np.zeros((2**depth, self.d))
        for i in np.unique(cell):
            self.centres[i] = sample[cell == i].mean(axis=0)

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector and how far it is from the cell's centre."""
        v = widened(vectors, self.d).astype(np.float64) if vectors.shape[1] < self.d else vectors.astype(np.float64)
        rest = (v[:, self.d :] ** 2).sum(axis=1)
        v = v[:, : self.d]
        at = np.zeros(len(v), int)
        for _ in range(self.depth):
            at = 2 * at + 1 + ((v * self.ways[at]).sum(axis=1) > self.cuts[at])
        cell = at - (2**self.depth - 1)
        return cell, np.sqrt(((v - self.centres[cell]) ** 2).sum(axis=1) + rest)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix, short ones filled with zeros."""
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    d = int(size.max(initial=0))
    if len(size) and size.min() == d:
        return values.reshape(len(size), d)
    out = np.zeros((len(size), d), np.int64)
    out[np.arange(d) < size[:, None]] = values
    return out


def _pack(vectors: np.ndarray) -> np.ndarray:
    return vectors.astype(np.int16 if np.abs(vectors).max(initial=0) < 1 << 15 else np.int32)


def _stack(bodies: list[bytes], wide: list[bool]) -> np.ndarray:
    parts = [np.frombuffer(b, np.int32 if w else np.int16) for b, w in zip(bodies, wide, strict=True)]
    d = max((len(p) for p in parts), default=0)
    if all(len(p) == d for p in parts) and not any(wide):
        return np.frombuffer(b"".join(bodies), np.int16).reshape(len(parts), d).astype(np.int32)
    out = np.zeros((len(parts), d), np.int32)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def _parts(rows: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """id, label and integer vector of the rows that take part."""
    fits = lambda x: x.isNotNull() & (F.abs(256 * x.cast("double")) < HUGE)  # noqa: E731 - NaN counts as the largest number, so it doesn't fit
    vec = F.transform(vec_col, lambda x: F.floor(256 * x.cast("double")).cast("int"))
    ok = F.col(id_col).isNotNull() & label.isNotNull() & F.col(vec_col).isNotNull()
    return rows.filter(ok).filter(F.forall(vec_col, fits)).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("vec"))


POINT = "id long, label long, key binary, body binary, wide boolean, cell int, away double, norm double"


def _route(parts: DataFrame, router) -> DataFrame:
    """Rows as packed points, with a digest of label and vector as key; equal rows of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = router.value
        for batch in batches:
            if not len(batch):
                continue
            ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            column = batch.column(2)
            vectors = _matrix(column)
            size = np.diff(column.offsets.to_numpy())
            cell, away = made.cells(vectors)
            norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
            out, seen = [], set()
            for i, (own, label) in enumerate(zip(ids, labels, strict=True)):
                body = _pack(vectors[i, : size[i]])
                raw = body.tobytes()
                key = blake2b(raw, digest_size=16, key=b"%d" % label).digest()
                if (own, key) not in seen:
                    seen.add((own, key))
                    out.append((own, label, key, raw, body.dtype == np.int32, int(cell[i]), float(away[i]), float(norm[i])))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "label", "key", "body", "wide", "cell", "away", "norm"])

    return parts.mapInArrow(run, POINT)


def _salted(points: DataFrame, counts: dict[int, int], most: int) -> Column:
    """cell * 2**20 + salt, so that no block has many more rows than most."""
    salts = {c: -(-n // most) for c, n in counts.items() if n > most}
    cell = F.col("cell").cast("long")
    if not salts:
        return cell * (1 << 20)
    parts = F.create_map(*(F.lit(x) for pair in salts.items() for x in pair))
    return cell * (1 << 20) + F.pmod(F.xxhash64("key"), F.coalesce(parts[F.col("cell")], F.lit(1)))


# A chunk: distinct anchors with their queries, packed.  seen_*: what has been found, by query.
CHUNK_ROW = "chunk long, n int, keys binary, bodies binary, d int, labels binary, owner binary, cap binary, floor binary, seen_query binary, seen_score binary, seen_id binary"


class Chunk:
    FIELDS = ["chunk", "n", "keys", "bodies", "d", "labels", "owner", "cap", "floor", "seen_query", "seen_score", "seen_id"]

    def __init__(self, chunk: int, keys: bytes, vectors: np.ndarray, labels: np.ndarray, asked: Queries, seen: tuple) -> None:
        self.chunk, self.keys, self.vectors, self.labels, self.asked, self.seen = chunk, keys, vectors, labels, asked, seen

    @classmethod
    def read(cls, r: dict) -> Chunk:
        long = lambda x: np.frombuffer(r[x], np.int64)
        vectors = np.frombuffer(r["bodies"], np.int32).reshape(r["n"], r["d"])
        return cls(r["chunk"], r["keys"], vectors, long("labels"), Queries(long("owner"), long("cap"), long("floor")), (long("seen_query"), long("seen_score"), long("seen_id")))

    def row(self) -> tuple:
        q, (a, b, c) = self.asked, self.seen
        return (self.chunk, len(self.labels), self.keys, packed(self.vectors.astype(np.int32)), self.vectors.shape[1], *(packed(np.asarray(x, np.int64)) for x in (self.labels, q.owner, q.cap, q.floor, a, b, c)))

    def ball(self) -> tuple:
        return Tree(self.vectors, max(len(self.vectors), 1)).nodes[0]


CHUNK_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 7]


def _chunks(anchors: DataFrame, counts: dict[int, int], sample) -> DataFrame:
    """Distinct anchors in chunks, each with its query for positives and a first floor from the sample."""
    dealt = anchors.withColumn("chunk", _salted(anchors, counts, CHUNK)).select("chunk", "key", "label", "body", "wide")
    return dealt.repartition("chunk").sortWithinPartitions("chunk", "key").mapInArrow(_chunked(sample), CHUNK_ROW)


def _chunked(sample) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, labels, ids = sample.value
        known = Block(vectors, labels, ids)
        for key, rows in _groups(batches, "chunk"):
            mine = _stack([r["body"] for r in rows], [r["wide"] for r in rows])
            own = np.array([r["label"] for r in rows], np.int64)
            n = len(rows)
            asked = Queries(np.arange(n), np.full(n, HIGH), np.full(n, LOW))
            search(known, mine, own, asked, POSITIVES + 1, True)
            none = np.zeros(0, np.int64)
            yield _rows([Chunk(key, b"".join(r["key"] for r in rows), mine, own, asked, (none, none, none)).row()], CHUNK_TYPES, Chunk.FIELDS)

    return run


def _rows(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    """Rows of a sorted stream by key: chunks are bounded, so a group fits."""
    held, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r[key] != held:
                yield held, rows
                rows = []
            held = r[key]
            rows.append(r)
    if rows:
        yield held, rows


def _visit(points: DataFrame, chunks: DataFrame, cells, k: int, same: bool) -> DataFrame:
    """(chunk, query, score, id) packed: what each block has for each chunk that is not pruned against its cell."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, salts, centre, away, norm = cells.value
        for batch in batches:
            for r in batch.to_pylist():
                chunk = Chunk.read(r)
                if not len(chunk.asked.owner):
                    continue
                ball = chunk.ball()
                d = max(ball[0].shape[1], centre.shape[1])
                low, high = intervals((widened(ball[0], d), *ball[1:]), (widened(centre, d), away, norm))
                met = np.flatnonzero((high[0] >= chunk.asked.floor.min()) & (low[0] <= chunk.asked.cap.max()))
                to = [(int(number[i]) << 20) + s for i in met.tolist() for s in range(int(salts[i]))]
                # the keys and what was found stay behind
                bare = Chunk(chunk.chunk, b"", chunk.vectors, chunk.labels, chunk.asked, (np.zeros(0, np.int64),) * 3).row()
                for lo in range(0, len(to), 64):
                    yield _rows([(b, *bare) for b in to[lo : lo + 64]], [pa.int64(), *CHUNK_TYPES], ["block", *Chunk.FIELDS])

    sent = chunks.mapInArrow(send, "block long, " + CHUNK_ROW)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in sent.schema.fields[1:]]
    rows = points.select("block", F.lit(0).alias("kind"), "id", "label", "body", "wide", *blank)
    own = [F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("label", "long"), ("body", "binary"), ("wide", "boolean"))]
    both = rows.unionByName(sent.select("block", F.lit(1).alias("kind"), *own, *Chunk.FIELDS))
    dealt = both.repartition("block").sortWithinPartitions("block", "kind")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered, block = None, [], None
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            kinds = batch.column(1).to_numpy()
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
                if hi == lo:
                    continue
                if blocks[lo] != held:
                    held, gathered, block = blocks[lo], [], None
                part = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    gathered.append((part.column(2).to_numpy(), part.column(3).to_numpy(), _stack(part.column(4).to_pylist(), part.column(5).to_pylist())))
                    continue
                if block is None and gathered:
                    d = max(v.shape[1] for _, _, v in gathered)
                    block = Block(np.concatenate([widened(v, d) for _, _, v in gathered]), np.concatenate([x for _, x, _ in gathered]), np.concatenate([x for x, _, _ in gathered]))
                    gathered = []
                if block is None:
                    continue
                for r in part.select(Chunk.FIELDS).to_pylist():
                    chunk = Chunk.read(r)
                    query, score, ids = search(block, chunk.vectors, chunk.labels, chunk.asked, k, same)
                    if len(query):
                        yield _rows([(chunk.chunk, packed(query), packed(score), packed(ids))], [pa.int64(), *[pa.binary()] * 3], ["chunk", "query", "score", "id"])

    return dealt.mapInArrow(walk, "chunk long, query binary, score binary, id binary")


def _merged(chunks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Chunks with the first k of all that blocks found for their queries; a block's rows at a time."""
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema.fields[1:]]
    extra = [F.lit(None).cast("binary").alias(c) for c in ("query", "score", "id")]
    both = chunks.select(F.lit(0).alias("kind"), *Chunk.FIELDS, *extra).unionByName(found.select(F.lit(1).alias("kind"), "chunk", *blank, "query", "score", "id"))
    dealt = both.repartition("chunk").sortWithinPartitions("chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if chunk is not None:
                        yield _rows([chunk.row()], CHUNK_TYPES, Chunk.FIELDS)
                    chunk = Chunk.read(r)
                else:
                    new = [np.frombuffer(r[c], np.int64) for c in ("query", "score", "id")]
                    chunk.seen = first_of(*(np.concatenate([x, y]) for x, y in zip(chunk.seen, new, strict=True)), k)
        if chunk is not None:
            yield _rows([chunk.row()], CHUNK_TYPES, Chunk.FIELDS)

    return dealt.mapInArrow(run, CHUNK_ROW)


def _windows(chunks: DataFrame, sample, low: int, high: int) -> DataFrame:
    """Chunks whose queries are the score windows of their positives: (a row a distinct positive score of an anchor).

    What was found, the positives, stays in seen_*, by anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Block(*sample.value)
        for batch in batches:
            for r in batch.to_pylist():
                chunk = Chunk.read(r)
                anchor, score, _ = chunk.seen
                pair = np.unique(np.stack([anchor, score], axis=1), axis=0) if len(anchor) else np.zeros((0, 2), np.int64)
                cap = np.array([high * s // 100 for s in pair[:, 1].tolist()], np.int64)
                floor = np.array([-(-low * s // 100) for s in pair[:, 1].tolist()], np.int64)
                some = floor <= cap
                asked = Queries(pair[some, 0], cap[some], floor[some])
                search(known, chunk.vectors, chunk.labels, asked, NEGATIVES, False)
                yield _rows([Chunk(chunk.chunk, chunk.keys, chunk.vectors, chunk.labels, asked, chunk.seen).row()], CHUNK_TYPES, Chunk.FIELDS)

    return chunks.mapInArrow(run, CHUNK_ROW)


ANSWER = "key binary, own long, positives array<struct<id: long, score: long, negatives: array<struct<id: long, score: long>>>>"


def _answers(asked: DataFrame, found: DataFrame, high: int) -> DataFrame:
    """A row a distinct anchor: its positives, each with its negatives.

    asked: chunks with windows as queries and positives in seen_*; found: the same with negatives in seen_*.
    """
    own = asked.select("chunk", *(F.col(c).alias(f"p_{c}") for c in ("seen_query", "seen_score", "seen_id")))
    both = found.join(own, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                chunk = Chunk.read(r)
                window, score, ids = (x.tolist() for x in chunk.seen)
                negatives: dict[tuple[int, int], list] = {}
                for w, s, i in zip(window, score, ids, strict=True):
                    negatives.setdefault((int(chunk.asked.owner[w]), int(chunk.asked.cap[w])), []).append({"id": i, "score": s})
                positives: list[list] = [[] for _ in chunk.labels]
                for a, s, i in zip(*(np.frombuffer(r[f"p_{c}"], np.int64).tolist() for c in ("seen_query", "seen_score", "seen_id")), strict=True):
                    positives[a].append({"id": i, "score": s, "negatives": negatives.get((a, high * s // 100), [])})
                self_score = (chunk.vectors.astype(np.int64) ** 2).sum(axis=1).tolist()
                keys = [chunk.keys[16 * i : 16 * i + 16] for i in range(len(positives))]
                kind = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64()), ("negatives", pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())])))]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(self_score, pa.int64()), pa.array(positives, kind)], ["key", "own", "positives"])

    return both.mapInArrow(run, ANSWER)


def mine(rows: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: which rows are anchors; label: the label of a row.  An anchor's positives are its first POSITIVES other
    rows of its label, the negatives of each its first NEGATIVES rows of other labels whose score is between low and
    high hundredths of the positive's.
    """
    spark = rows.sparkSession
    parts = _parts(rows, id_col, vec_col, label)
    total = parts.count()
    share = min(1.0, 0.9 * SAMPLE / max(total, 1))
    drawn = parts.filter(F.xxhash64("id", F.lit(5)).bitwiseAND((1 << 30) - 1) < int(share * (1 << 30))).limit(SAMPLE).collect()
    drawn = sorted({(r["id"], r["label"], tuple(r["vec"])) for r in drawn})
    d = max((len(v) for _, _, v in drawn), default=0)
    vectors = np.array([list(v) + [0] * (d - len(v)) for _, _, v in drawn], np.int32).reshape(len(drawn), d)
    sample = spark.sparkContext.broadcast((vectors, np.array([x for _, x, _ in drawn], np.int64), np.array([i for i, _, _ in drawn], np.int64)))
    depth = min(MOST_DEPTH, max(LEAST_DEPTH, (max(total // BLOCK, 1)).bit_length()))
    router = spark.sparkContext.broadcast(Router(np.unique(vectors, axis=0).astype(np.float64) if len(drawn) else np.zeros((0, d)), depth))

    # of rows that score alike, the first ids; before the shuffle Spark keeps as many of each task's rows
    alike = Window.partitionBy("key").orderBy("id")
    ranked = _route(parts, router).withColumn("rank", F.dense_rank().over(alike)).filter(F.col("rank") <= LIMIT)
    points = table(spark, ranked.dropDuplicates(["key", "id"]).drop("rank"), "points")
    members = table(spark, _route(_parts(rows.filter(anchor), id_col, vec_col, label), router), "anchors")
    distinct = members.groupBy("key").agg(*(F.first(c).alias(c) for c in ("label", "body", "wide", "cell")))
    cells = points.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.max("norm").alias("norm")).collect()  # a row a cell
    counts = {r["cell"]: r["n"] for r in cells}
    number = np.array([r["cell"] for r in cells], np.int64)
    salts = np.array([-(-r["n"] // BLOCK) for r in cells], np.int64)
    balls = (number, salts, router.value.centres[number], np.array([r["away"] for r in cells]), np.array([r["norm"] for r in cells]))
    shared = spark.sparkContext.broadcast(balls)
    anchor_counts = {r["cell"]: r["n"] for r in distinct.groupBy("cell").agg(F.count("*").alias("n")).collect()}

    points = points.withColumn("block", _salted(points, counts, BLOCK))
    first = table(spark, _chunks(distinct, anchor_counts, sample), "chunks")
    near = _merged(first, _visit(points, first, shared, POSITIVES + 1, True), POSITIVES + 1)
    asked = table(spark, _windows(near, sample, low, high), "windows")
    empty = [F.lit(b"").alias(c) if c.startswith("seen") else F.col(c) for c in Chunk.FIELDS]
    found = _merged(asked.select(*empty), _visit(points, asked, shared, NEGATIVES, False), NEGATIVES)
    answers = table(spark, _answers(asked, found, high), "answers")

    # the anchor itself is left out: the first entry with its id and its own score (a row like it would give the same)
    at = F.array_position(F.transform("positives", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))), F.struct(F.col("anchor_id").alias("id"), F.col("own").alias("score")))
    others = F.filter("positives", lambda p, i: (i + 1) != F.col("_at"))
    per = members.select("key", F.col("id").alias("anchor_id")).distinct().join(answers, "key").withColumn("_at", F.coalesce(at, F.lit(0)))
    pairs = per.select("anchor_id", F.explode(F.slice(others, 1, POSITIVES)).alias("p"))
    return pairs.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode("p.negatives").alias("rank", "g")).select(
        "anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("g.id").alias("negative_id"), "positive_score", F.col("g.score").alias("negative_score")
    )
