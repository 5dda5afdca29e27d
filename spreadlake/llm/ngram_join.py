"""N-gram Jaccard join: prefix-tree join of globally ordered shingle sets.

A document's set holds the distinct SHINGLE-word shingles of its lower-cased text (with fewer words,
the whole sequence as one).  Two documents link if 100 * |a & b| >= PERCENT * |a | b|.  Sets are
ordered by one global order, rare shingles first: by the number of documents that have them, then by hash.

1. members, three deals of packed rows.  Shingles go to buckets that count their documents; those that
   several documents have go back by document, where each gets its place in the order; and the ones
   in the prefix go to buckets again.  Linked sets share a shingle of their prefixes, and at the first
   one that they share both have enough elements left; a bucket keeps those that some other document may link over.
   Equal sets of a block of documents become one.  Shingles that may be in over HOT documents (by a
   counter table of fixed size) come last in the order, by their counter, and are not dealt for
   counting; and of the documents of one part with one shingle only the first travels to its bucket,
   so a shingle that a third of all rows have costs a row a part there.
2. families: documents that such shingles connect, by ids alone.  All pairs to test lie in a family.
3. trie join: a family's documents travel once, to one task.  Their sets are stored in a trie, which
   is traversed with each of them, sharing the overlap of common paths; a subtree is left when what
   remains of the sets below or of the probe can't reach the threshold.  Sets in one component are
   not tested again.
4. Large families (over FAMILY_DOCS or FAMILY_BYTES) are first thinned by star rounds: in each group of a shingle and a size
   class, documents are compared with one of them, another one in each round, so a round's work is
   linear in the members.  Families are then made anew of what is not connected yet.  What is still
   large after STAR_ROUNDS is compared in pairs of blocks of bounded size, of a family or of each of its shingles.
5. Components of the links: up to TASK_LINKS of them in one task, more of them by large-star/small-star
   rounds, each written to the shared folder; more than 60 rounds are an error.

Texts without words have no shingles and link with nothing.  A null id links with nothing, and its
component is null.  Rows that repeat an id are one node: its component is that of any of its rows.
Empty tables give empty results.  Shingles are equal if their 64-bit hashes are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, input_bytes, maybe_in, table
from .textcore import Chunk, chunks, give_back, mix, runs

U = np.uint64
SHINGLE, PERCENT = 5, 75
SKETCH_BITS, ROW_SLOTS, HOT = 20, 1024, 10_000
BLOCK_WORDS, BUCKET_BYTES = 750_000, 32 << 20
FAMILY_DOCS, FAMILY_BYTES, STAR_ROUNDS = 512, 16 << 20, 2
TASK_LINKS = 250_000


def least_overlap(a, b):
    """Smallest intersection of linked sets with a and b elements: ceil(t / (1 + t) * (a + b))."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_size(n):
    """How many first elements linked sets must share one of."""
    return n - (-(-PERCENT * n // 100)) + 1


def sets(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of a chunk, by document and hash."""
    docs, hashes = c.shingles(c.word_hashes(), SHINGLE)
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - SKETCH_BITS)).astype(np.int64)


def sketch(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """The place in the order of shingles that may be in very many documents, by slot; 0 for the others.

    All shingles are counted into a table of 2**SKETCH_BITS counters; hot are slots over HOT and over
    four times the mean, so what is not hot is in no more documents than that.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for c in chunks(batch.column(0), lower=True):
                total += np.bincount(slot(c.shingles(c.word_hashes(), SHINGLE)[1]), minlength=len(total))
        parts = total.reshape(-1, ROW_SLOTS)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())], ["part", "counts"])
        del total, parts
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["part", "counts"])

    made = df.select(text_col).mapInArrow(count, "part int, counts binary").repartition(16, "part").mapInArrow(add, "part int, counts binary")
    out = np.zeros((1 << SKETCH_BITS) // ROW_SLOTS * ROW_SLOTS, np.int64).reshape(-1, ROW_SLOTS)
    for r in made.collect():  # at most 1024 rows of 8 KB
        out[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    out = out.reshape(-1)
    return np.where(out > max(HOT, 4 * out.mean()), (1 << 31) + np.minimum(out, (1 << 31) - 1), 0).astype(np.uint32)


_MEMBER = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("extra", pa.int64())])
_MEMBER_DDL = "kind string, id bigint, n bigint, key bigint, extra bigint"
KEY_BITS = 32


def may_link(n, left, other_n, other_left):
    """False only if sets of n and other_n elements can't link that first meet where so many are left of each."""
    return (100 * np.minimum(n, other_n) >= PERCENT * np.maximum(n, other_n)) & (np.minimum(left, other_left) >= least_overlap(n, other_n))


def _rows(kind: str, ids, n, keys, extra) -> pa.Table:
    columns = [x if isinstance(x, pa.Array) else pa.array(np.asarray(x, np.int64)) for x in (ids, n, keys, extra)]
    return pa.Table.from_arrays([pa.array([kind] * len(ids), pa.string()), *columns], schema=_MEMBER)


def pack(tokens: np.ndarray, ids: np.ndarray, n: np.ndarray, *more: np.ndarray) -> bytes:
    """Postings in rows of one id: 32-bit tokens, and compressed ids, set sizes and further columns of 32 bits."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (n[1:] != n[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(ids)))
    side = [np.diff(ids[at], prepend=0).astype("<i8"), n[at].astype("<i4"), count.astype("<i4"), *(x.astype("<u4") for x in more)]
    head = np.array([len(tokens), len(at)], "<i4").tobytes()
    return head + np.ascontiguousarray(tokens, "<u4").tobytes() + zlib.compress(b"".join(x.tobytes() for x in side), 1)


def unpack(body: bytes, more: int) -> list[np.ndarray]:
    """tokens, ids, n and further columns, all as 64-bit integers."""
    k, e = np.frombuffer(body, "<i4", 2).tolist()
    side = zlib.decompress(body[8 + 4 * k :])
    ids, n, count = np.cumsum(np.frombuffer(side, "<i8", e)), np.frombuffer(side, "<i4", e, 8 * e), np.frombuffer(side, "<i4", e, 12 * e)
    rest = [np.frombuffer(side, "<u4", k, 16 * e + 4 * k * i).astype(np.int64) for i in range(more)]
    return [np.frombuffer(body, "<u4", k, 8).astype(np.int64), np.repeat(ids, count), np.repeat(n, count).astype(np.int64), *rest]


def _unpacked(bodies: list[bytes], tag: bytes, more: int) -> list[np.ndarray]:
    parts = [unpack(b[1:], more) for b in bodies if b[:1] == tag]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * (3 + more)


def _dealt(tag: bytes, to: np.ndarray, ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A message to each bucket; columns: tokens, n and further ones."""
    order = np.lexsort((ids, to))  # ids in a row are alike, and so compress well
    cut, count = runs(to[order])
    tokens, n, *more = columns
    for lo, k in zip(cut.tolist(), count.tolist(), strict=True):
        o = order[lo : lo + k]
        yield int(to[o[0]]), tag + pack(tokens[o], ids[o], n[o], *(x[o] for x in more))


def _part(ids: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix(ids.astype(U)) % U(n_buckets)).astype(np.int64)


class Block:
    """Sets of a run of documents, settled on close()."""

    def __init__(self) -> None:
        self.first: dict[tuple[int, int], int] = {}
        self.nodes: list[pa.Table] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.words = 0

    def add(self, ids: np.ndarray, null: np.ndarray, c: Chunk) -> None:
        """Node rows of all documents (key: 1 if their shingles are dealt), and the shingles of distinct sets."""
        self.words += int(c.first[-1])
        docs, hashes = sets(c)
        n = np.bincount(docs, minlength=c.n)
        at = np.concatenate([[0], np.cumsum(n)])
        keys = np.stack([np.concatenate([[U(0)], np.cumsum(mix(hashes ^ U(s)), dtype=U)]) for s in (1, 2)])
        keys = keys[:, at[1:]] - keys[:, at[:-1]]
        use, equal = np.zeros(c.n, bool), []
        for i in np.flatnonzero(~null & (n > 0)).tolist():
            own = int(ids[i])
            lead = self.first.setdefault((int(keys[0, i]), int(keys[1, i])), own)
            use[i] = lead == own
            if lead != own:
                equal.append((own, int(n[i]), lead))
        self.nodes.append(_rows("node", pa.array(ids, pa.int64(), mask=null), n, use, np.diff(c.offsets)))
        if equal:
            self.nodes.append(_rows("equal", *np.array(equal).T, np.zeros(len(equal), np.int64)))
        keep = use[docs]
        self.parts.append((hashes[keep], ids[docs[keep]], n[docs[keep]]))

    def close(self, n_buckets: int, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
        hashes, ids, n = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else [np.zeros(0, np.int64)] * 3
        bucket = (mix(hashes.astype(U)) % U(n_buckets)).astype(np.int64)
        rank = hot[slot(hashes.astype(U))]
        cold = rank == 0
        tokens = (hashes.astype(U) & U((1 << KEY_BITS) - 1)).astype(np.uint32)
        yield from _dealt(b"T", bucket[cold], ids[cold], tokens[cold], np.zeros(int(cold.sum()), np.int64))
        ids, tokens, bucket, rank = ids[~cold], tokens[~cold], bucket[~cold], rank[~cold]
        yield from _dealt(b"S", _part(ids, n_buckets), ids, tokens, np.zeros(len(ids), np.int64), bucket, rank)
        if self.nodes:
            nodes = pa.concat_tables(self.nodes).combine_chunks()
            to = _part(nodes.column("id").fill_null(self.words).to_numpy(), n_buckets)
            order = np.argsort(to, kind="stable")
            cut, count = runs(to[order])
            nodes = nodes.take(pa.array(order)).combine_chunks()
            for lo, k in zip(cut.tolist(), count.tolist(), strict=True):
                ipc = pa.BufferOutputStream()
                with pa.ipc.new_stream(ipc, _MEMBER, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
                    w.write_table(nodes.slice(lo, k))
                yield int(to[order[lo]]), b"P" + ipc.getvalue().to_pybytes()


def shared(bucket: int, bodies: list[bytes], n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Of a bucket's shingles those that several documents have, back to the documents with their number."""
    yield from ((bucket, b) for b in bodies if b[:1] != b"T")
    tokens, ids, n = _unpacked(bodies, b"T", 0)
    order = np.argsort(tokens, kind="stable")
    tokens, ids = tokens[order], ids[order]
    _, length = runs(tokens)
    df = np.repeat(length, length)
    tokens, ids, df = tokens[df > 1], ids[df > 1], df[df > 1]
    yield from _dealt(b"S", _part(ids, n_buckets), ids, tokens, np.zeros(len(ids), np.int64), np.full(len(ids), bucket), df)


def ranked(part: int, bodies: list[bytes], n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Shared shingles in the prefixes of a part's documents, to their buckets, with how many elements are left from there on.

    A document's shingles that no other has come first.  Which shingles belong to which of an id's
    rows is not known; all of them go with each row then, as if it were the first.
    """
    passed = [b for b in bodies if b[:1] == b"P"]
    nodes = pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(b[1:])).read_all() for b in passed] or [_MEMBER.empty_table()])
    yield from ((part, b) for b in passed)
    dealt = nodes.filter(pc.and_(pc.equal(nodes.column("kind"), "node"), pc.equal(nodes.column("key"), 1)))
    of, size = dealt.column("id").to_numpy(), dealt.column("n").to_numpy()
    order = np.lexsort((size, of))
    of, size = of[order], size[order]
    tokens, ids, _, bucket, rank = _unpacked(bodies, b"S", 2)
    order = np.lexsort((tokens, bucket, rank, ids))
    tokens, ids, bucket, rank = (x[order] for x in (tokens, ids, bucket, rank))
    at, length = runs(ids)
    lo, hi = np.searchsorted(of, ids), np.searchsorted(of, ids, "right")
    n = size[lo]
    place = n - np.repeat(length, length) + np.arange(len(ids)) - np.repeat(at, length)
    one = hi - lo == 1
    head = one & (place < prefix_size(n))
    rows = np.repeat(np.flatnonzero(~one), (hi - lo)[~one])
    which = lo[rows] + np.arange(len(rows)) - np.repeat(np.cumsum((hi - lo)[~one]) - (hi - lo)[~one], (hi - lo)[~one])
    tokens, ids, bucket, n, left = (np.concatenate(x) for x in ((tokens[head], tokens[rows]), (ids[head], ids[rows]), (bucket[head], bucket[rows]), (n[head], size[which]), ((n - place)[head], size[which])))
    keys = tokens | (bucket << KEY_BITS)
    order = np.lexsort((ids, keys))
    keys, tokens, ids, bucket, n, left = (x[order] for x in (keys, tokens, ids, bucket, n, left))
    at, length = runs(keys)
    many = np.flatnonzero(ids != np.repeat(ids[at], length))  # ids that repeat are no second document
    several, travel = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
    several[np.repeat(at, length)[many]] = 1
    travel[many] = False
    if len(many):
        ipc = pa.BufferOutputStream()
        with pa.ipc.new_stream(ipc, _MEMBER, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
            w.write_table(_rows("multi", ids[many], n[many], keys[many], left[many] >= least_overlap(n[many], n[many])))
        yield part, b"P" + ipc.getvalue().to_pybytes()
    yield from _dealt(b"U", bucket[travel], ids[travel], tokens[travel], n[travel], left[travel], several[travel])


def useful(group: np.ndarray, n: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which members may link with another one of their group; rows come sorted by group and n.  It may say so too often."""
    out = np.zeros(len(n), bool)
    early = np.flatnonzero(left >= least_overlap(n, n))  # only these can be the smaller one of a pair
    after = early[early + 1 < len(n)]
    after = after[group[after] == group[after + 1]]
    out[after] = may_link(n[after], left[after], n[after + 1], left[after])
    # as the larger one: with the smallest early one that is large enough
    wide = int(n.max(initial=0)) + 2
    code = group * wide + n
    at = np.searchsorted(code[early], group * wide - (-PERCENT * n // 100))
    some = np.flatnonzero(at < len(early))
    mate = early[at[some]]
    some, mate = some[mate < some], mate[mate < some]
    out[some] |= (group[mate] == group[some]) & may_link(n[some], left[some], n[mate], left[some])
    return out


def settle(bucket: int, bodies: list[bytes]) -> pa.Table:
    """What a bucket passes on: members of the keys that it has whole, with `edge` rows that connect them.

    Members of keys that several documents of one part have (`multi`) are in several buckets' rows
    and are connected later.
    """
    out = [pa.ipc.open_stream(pa.py_buffer(b[1:])).read_all() for b in bodies if b[:1] == b"P"]
    t, o, s, left, m = _unpacked(bodies, b"U", 2)
    if len(t):
        _, length = np.unique(t, return_counts=True)
        order = np.lexsort((o, s, t))
        t, o, s, left, m = (x[order] for x in (t, o, s, left, m))
        alone = np.repeat(length == 1, length) & (m == 0)
        t, o, s, left, m = (x[~alone] for x in (t, o, s, left, m))
        at, length = runs(t)
        several = np.repeat(np.maximum.reduceat(m, at) > 0, length) if len(at) else np.zeros(0, bool)
        early = (left >= least_overlap(s, s)).astype(np.int64)
        t += bucket << KEY_BITS
        out.append(_rows("multi", o[several], s[several], t[several], early[several]))
        group = np.repeat(np.arange(len(at)), length)
        use = ~several & useful(group, s, left)
        t, o, s, early = t[use], o[use], s[use], early[use]
        at, length = runs(t)
        lead = np.repeat(np.minimum.reduceat(o, at), length) if len(at) else o
        out.append(_rows("member", o, s, t, early))
        pairs = np.unique(np.stack([lead, o])[:, lead != o], axis=1)
        out.append(_rows("edge", pairs[1], np.zeros(pairs.shape[1], np.int64), pairs[0], np.zeros(pairs.shape[1], np.int64)))
    return pa.concat_tables(out) if out else _MEMBER.empty_table()


def members(df: DataFrame, hot, id_col: str, text_col: str) -> DataFrame:
    """Rows by kind: node (id, n, extra: bytes of the text) of every row; equal (id, key: an id with an equal set);
    edge (id, key: an id that it may link with, or over others); member and multi (id, n, key: a shingle, extra: 1 if it can be a pair's smaller one)."""
    size = input_bytes(df)
    n_buckets = max(8, min(128, size >> 20), -(-size // BUCKET_BYTES))

    def batch_of(made: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())], ["bucket", "body"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            for c in chunks(batch.column(1), lower=True):
                block.add(ids[c.row : c.row + c.n], null[c.row : c.row + c.n], c)
                if block.words >= BLOCK_WORDS:
                    yield batch_of(list(block.close(n_buckets, hot.value)))
                    block = Block()
        yield batch_of(list(block.close(n_buckets, hot.value)))
        del block
        give_back()

    def deal(step):
        return lambda t: pa.Table.from_batches([batch_of(list(step(t.column("bucket")[0].as_py(), t.column("body").to_pylist(), n_buckets)))])

    def meet(t: pa.Table) -> pa.Table:
        return settle(t.column("bucket")[0].as_py(), t.column("body").to_pylist())

    docs, kind = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")), "bucket int, body binary"
    counted = docs.mapInArrow(cut, kind).groupBy("bucket").applyInArrow(deal(shared), kind)
    return counted.groupBy("bucket").applyInArrow(deal(ranked), kind).groupBy("bucket").applyInArrow(meet, _MEMBER_DDL)


class Trie:
    """Sets as a prefix tree.

    Sets are lists of ranks in the global order, ascending.  In lexicographic order, a list adds to the
    tree the nodes behind the path that it shares with the one before: `shared` says how long that is.
    """

    def __init__(self, lists: list[np.ndarray], universe: int) -> None:
        self.order = sorted(range(len(lists)), key=lambda i: lists[i].astype(">u4").tobytes())
        self.lists, self.universe = [lists[i] for i in self.order], universe
        self.sizes = np.array([len(x) for x in self.lists], np.int64)
        self.shared = [0]
        for a, b in zip(self.lists, self.lists[1:], strict=False):
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            self.shared.append(int(differ[0]) if len(differ) else k)

    def linked(self, probe: np.ndarray, wanted: np.ndarray) -> list[int]:
        """Which of the wanted lists (a mask in the order given to the tree) link with the probe.

        path[d] is the overlap of the probe with the first d elements of the path that the walk is on.
        The walk leaves a path at depth `given_up`, where what is left of a list, or of the probe
        behind that element, can't reach the overlap that the list's size calls for; a list below the
        node is walked again only if its own size allows it.
        """
        m = len(probe)
        inside = np.zeros(self.universe + 1, bool)
        inside[probe] = True
        before = np.cumsum(inside) - inside  # elements of the probe before each rank
        wanted = wanted[self.order] & (100 * np.minimum(self.sizes, m) >= PERCENT * np.maximum(self.sizes, m)) & (self.sizes > 0)
        need = least_overlap(self.sizes, m)
        found, path, common, given_up, last = [], np.zeros(1, np.int64), 0, None, 0
        for k in np.flatnonzero(wanted).tolist():
            common = min([common, *self.shared[last + 1 : k + 1]]) if k > last else 0
            last, mine, size, least = k, self.lists[k], int(self.sizes[k]), int(need[k])
            if given_up is not None:
                if common >= given_up and path[given_up] + min(size - given_up, (m - before[mine[given_up]]) if size > given_up else 0) < least:
                    common = given_up
                    continue
                common, given_up = min(common, given_up), None
            tail = mine[common:]
            path = np.concatenate([path[: common + 1], path[common] + np.cumsum(inside[tail])])
            rest = np.minimum(np.arange(len(tail), 0, -1), m - before[tail])
            short = path[common:-1] + rest < least
            stop = int(short.argmax()) if len(short) else 0
            if len(short) and short[stop]:
                given_up = common + stop
                path = path[: given_up + 1]
                common = given_up
            else:
                common = size
                if path[-1] >= least:
                    found.append(self.order[k])
        return found


def ordered_sets(texts: list[str | None]) -> tuple[list[np.ndarray], int]:
    """The sets of a group as lists of ranks of their union, rare shingles of the group first, and the union's size."""
    docs, hashes, base = [np.zeros(0, np.int64)], [np.zeros(0, U)], 0
    for c in chunks(pa.array(texts, pa.string()), lower=True):
        d, h = sets(c)
        docs.append(d + base)
        hashes.append(h)
        base += c.n
    d, h = np.concatenate(docs), np.concatenate(hashes)
    union, at, df = np.unique(h, return_inverse=True, return_counts=True)
    rank = np.empty(len(union), np.uint32)
    rank[np.lexsort((union, df))] = np.arange(len(union), dtype=np.uint32)
    order = np.lexsort((rank[at], d))
    return np.split(rank[at][order], np.cumsum(np.bincount(d, minlength=base))[:-1]), len(union)


def link_within(lists: list[np.ndarray], universe: int, label: np.ndarray, asks: np.ndarray, answers: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of labels that connect all rows that links connect; only rows that ask are compared with rows that answer.

    Rows of one label count as connected already, and so does what earlier links connect.
    """
    label, found = label.copy(), []

    def join(a: int, b: int) -> None:
        if label[a] != label[b]:
            found.append((int(label[a]), int(label[b])))
            label[label == label[b]] = label[a]

    equal: dict[bytes, int] = {}
    for i, x in enumerate(lists):  # equal lists are one
        if len(x):
            join(equal.setdefault(x.tobytes(), i), i)
    at = np.flatnonzero(answers)
    trie = Trie([lists[i] for i in at.tolist()], universe)
    asked = np.zeros(len(lists), bool)
    for i in sorted(np.flatnonzero(asks).tolist(), key=lambda i: len(lists[i])):
        wanted = (label[at] != label[i]) & ~(asked[at] & answers[i])
        if len(lists[i]) and wanted.any():
            for k in trie.linked(lists[i], wanted):
                join(i, int(at[k]))
        asked[i] = True
    return found


def trie_links(rows: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between labels, by one trie for each group (g1, g2, g3) of rows (id, label, asks, answers)."""
    ids = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    held = table(df.sparkSession, rows, "groups")
    group = held.join(maybe_in(ids, held.select("id"), "id"), "id")

    def run(t: pa.Table) -> pa.Table:
        lists, universe = ordered_sets(t.column("text").to_pylist())
        label, asks, answers = (t.column(c).to_numpy() for c in ("label", "asks", "answers"))
        found = link_within(lists, universe, label, asks, answers)
        return pa.table({k: pa.array([x[i] for x in found], pa.int64()) for i, k in enumerate("ab")})

    made = group.select("g1", "g2", "g3", "id", "label", "asks", "answers", "text").groupBy("g1", "g2", "g3").applyInArrow(run, "a bigint, b bigint")
    out = table(df.sparkSession, made.distinct(), "links")
    drop_table(df.sparkSession, held)
    return out


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the smallest id that each reaches over the links u, v): labels go to the least around them and jump to their own label."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, component (smallest id reachable) of every id that has a link (a, b).

    Up to TASK_LINKS links (a few MB) are joined in one task; more of them by large-star/small-star rounds.
    """
    spark = links.sparkSession
    edges = table(spark, links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if edges.count() <= TASK_LINKS:

        def join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if ends:
                found = smallest_reachable(*(np.concatenate(x) for x in zip(*ends, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "component"])

        return edges.coalesce(1).mapInArrow(join_all, "id bigint, component bigint")
    for _ in range(max_rounds):
        # settled: stars only, that is, every u has one v, and no v is a u
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").head(1):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        before, edges = edges, table(spark, small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        drop_table(spark, before)
    raise RuntimeError("components did not settle")


def families(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """docs (id, n, bytes, label) that edges between labels connect with another label, with their family, its rows and bytes."""
    found = components(edges).withColumnsRenamed({"id": "label", "component": "family"})
    known = docs.join(found, "label")
    size = known.groupBy("family").agg(F.count("*").alias("_rows"), F.sum("bytes").alias("_bytes"))
    return table(docs.sparkSession, known.join(size, "family").withColumn("large", F.expr(f"_rows > {FAMILY_DOCS} or _bytes > {FAMILY_BYTES}")), "families")


def _stars(known: DataFrame, turn: int) -> DataFrame:
    """Rows for trie_links: of each key and size class one document asks, and those with another label answer."""
    sized = known.withColumn("size", F.floor(F.log("n") / F.log(F.lit(1.15))))
    one = F.min(F.struct((F.xxhash64("id", F.lit(turn)) if turn else F.col("id")).alias("order"), "id", "label"))
    first = sized.groupBy("key", "size").agg(one.alias("_one"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi")
    star = sized.join(first.select("key", "size", F.col("_one.id").alias("a"), F.col("_one.label").alias("al")), ["key", "size"])
    star = star.filter("label <> al").select("a", "al", F.col("id").alias("b"), F.col("label").alias("bl"), "bytes").distinct()
    parts = star.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / FAMILY_DOCS, F.sum("bytes") / FAMILY_BYTES)).alias("parts"))
    dealt = star.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    row = lambda i, label, asks: [F.col("a").alias("g1"), F.col("part").alias("g2"), F.lit(0).cast("bigint").alias("g3"), F.col(i).alias("id"), F.col(label).alias("label"), F.lit(asks).alias("asks"), F.lit(not asks).alias("answers")]
    return dealt.select(*row("b", "bl", False)).unionByName(dealt.select(*row("a", "al", True)).distinct())


def _planned(rows: DataFrame) -> DataFrame:
    """For each group g of rows (g, family, label, bytes): its main label, numbers of blocks of that label's rows and of the others, and the rows that their pairs have.

    Rows of one label need no comparison, so blocks of the main label meet only the others' blocks.
    """
    each = rows.groupBy("g", "family", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    most = F.max(F.struct("n", "label", "b"))
    of = each.groupBy("g", "family").agg(most.alias("_m"), F.sum("n").alias("_n"), F.sum("b").alias("_b")).filter("_n > _m.n")
    blocks = lambda n, b: F.ceil(F.greatest(n * 2 / FAMILY_DOCS, b * 2 / FAMILY_BYTES, F.lit(1e-9)))
    sized = of.select("g", "family", F.col("_m.label").alias("main"), F.col("_m.n").alias("_k"), (F.col("_n") - F.col("_m.n")).alias("_o"), blocks(F.col("_m.n"), F.col("_m.b")).alias("nm"), blocks(F.col("_n") - F.col("_m.n"), F.col("_b") - F.col("_m.b")).alias("no"))
    return sized.select("g", "family", "main", "nm", "no", F.expr("_k * no + _o * (nm + no)").alias("cost"))


def _blocks(known: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rows for trie_links: pairs of blocks of each family's documents, or of each key's, whichever are fewer rows.

    Of keys with the same documents only one is taken.
    """
    rows = known.select(F.col("family").alias("g"), "family", "id", "label", "bytes")
    same = [F.count("*").alias("_n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("_y")]
    keys = keyed.groupBy("key").agg(*same).groupBy("_n", "_x", "_y").agg(F.min("key").alias("key")).select("key")
    by_key = keyed.join(keys, "key").join(known.select("id", "label", "family"), ["id", "label"]).select(F.col("key").alias("g"), "family", "id", "label", "bytes").distinct()
    plans = [_planned(x).withColumn("by_key", F.lit(k)) for k, x in enumerate((rows, by_key))]
    costs = plans[0].select("family", F.col("cost").alias("_f")).join(plans[1].groupBy("family").agg(F.sum("cost").alias("_k")), "family")
    plan = table(known.sparkSession, plans[0].unionByName(plans[1]).join(costs, "family").filter(F.expr("(by_key = 1) = (_k < _f)")), "plan")
    both = rows.withColumn("by_key", F.lit(0)).unionByName(by_key.withColumn("by_key", F.lit(1))).join(plan.select("g", "by_key", "main", "nm", "no"), ["g", "by_key"])
    part = F.expr("case when label = main then pmod(xxhash64(id), nm) else nm + pmod(xxhash64(id), no) end")
    cut = both.withColumn("part", part).withColumn("_other", F.explode(F.expr("sequence(if(label = main, nm, 0L), nm + no - 1)")))
    lo, hi = F.least("part", "_other"), F.greatest("part", "_other")
    return cut.select(F.col("g").alias("g1"), lo.alias("g2"), hi.alias("g3"), "id", "label", (F.col("part") == lo).alias("asks"), (F.col("part") == hi).alias("answers"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (set size), component (smallest id reachable by links, itself included) of every row."""
    spark = df.sparkSession
    hot = spark.sparkContext.broadcast(sketch(df, text_col))
    made = table(spark, members(df, hot, id_col, text_col), "members")
    nodes = made.filter("kind = 'node'")
    multi = made.filter("kind = 'multi'").select("key", "id", "extra")
    lead = multi.groupBy("key").agg(F.min("id").alias("a"), F.max("extra").alias("_early")).filter("_early = 1").drop("_early")
    edges = made.filter("kind = 'edge'").select(F.col("key").alias("a"), F.col("id").alias("b")).unionByName(multi.join(lead, "key").select("a", F.col("id").alias("b"))).distinct()
    docs = nodes.filter("n > 0 and id is not null").groupBy("id").agg(F.max("n").alias("n"), F.sum("extra").alias("bytes")).withColumn("label", F.col("id"))
    links = made.filter("kind = 'equal'").select(F.col("key").alias("a"), F.col("id").alias("b"))
    keyed = made.filter("kind in ('member', 'multi')").select("key", "id", "n")
    every = lambda rows: rows.withColumns({"g2": F.lit(0).cast("bigint"), "g3": F.lit(0).cast("bigint"), "asks": F.lit(True), "answers": F.lit(True)}).select(F.col("family").alias("g1"), "g2", "g3", "id", "label", "asks", "answers")
    for turn in range(STAR_ROUNDS + 1):
        known = families(edges, docs)
        large = known.filter("large")
        links = links.unionByName(trie_links(every(known.filter("not large")), df, id_col, text_col))
        if not large.head(1):
            break
        keyed = table(spark, keyed.join(large.select("id", "label", "bytes"), "id").select("key", "id", "n", "bytes", "label"), "keyed")
        if turn == STAR_ROUNDS:
            links = links.unionByName(trie_links(_blocks(large, keyed), df, id_col, text_col))
            break
        new = trie_links(_stars(keyed, turn), df, id_col, text_col)
        links = links.unionByName(new)
        joined = components(new).withColumnsRenamed({"id": "label", "component": "_c"})
        relabelled = keyed.join(joined, "label", "left").select("key", "id", "n", "bytes", F.coalesce("_c", "label").alias("label"))
        open_keys = relabelled.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo <> _hi").select("key", F.col("_lo").alias("a"))
        opened = table(spark, relabelled.join(open_keys, "key"), "keyed")
        edges = opened.filter("a <> label").select("a", F.col("label").alias("b")).distinct()
        docs = opened.groupBy("id", "label").agg(F.max("n").alias("n"), F.max("bytes").alias("bytes"))
        drop_table(spark, keyed)
        drop_table(spark, known)
        keyed = opened.select("key", "id", "n")
    final = components(links)
    return nodes.join(final, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
