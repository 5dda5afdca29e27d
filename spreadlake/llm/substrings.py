"""Substring dedup by seed and extend.

A window is WINDOW consecutive words.  Each window has an anchor: of the SEED-word grams inside it, the one
with the smallest hash, of equal ones the leftmost (winnowing, so equal windows have equal anchors at equal
places, and neighbours mostly share theirs).  An occurrence is a run of windows of one document with one
anchor: the seed, and up to WINDOW - SEED words at either side.

Documents meet on anchors.  The matches of all occurrences of an anchor are extended at once, word by word,
to the left and to the right: occurrences that agree so far form a class, the next word splits it, and what
agrees with no other any more is given up.  A window that reaches a words to the left of its seed is a repeat
if an occurrence in a document with a smaller id is still in its class after a words to the left and
WINDOW - SEED - a to the right.  No pairs of documents are made, so a passage that many share costs its rows
in each step, not their square.  Neighbouring repeats are joined to maximal ones.

What a task reads is extended in the task first, a block of words at a time: of equal windows in a block only
those of the smallest id go on, the others are repeats already.  So a passage that a third of all documents
share costs a row for each block, not for each document, in any one bucket.  What goes on is sent to the bucket
of its anchor, with the words around the seed as 32-bit hashes.

Windows are equal if 32 bits of their anchors' hashes, the anchors' buckets and 32 bits of each word around the
seed are.  Nulls and texts under WINDOW words have no windows.  Only smaller ids count, so rows that repeat an
id leave each other alone; a null id counts as larger than all others.  Rows are told apart by id and 16 bits
of a hash of the text.  Other columns are carried in a struct, so their names can't clash.  Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes
from .textcore import chunks, give_back, mix, range_hashes, runs

U = np.uint64
WINDOW, SEED = 13, 5
SIDE = WINDOW - SEED  # words of a window besides its seed
BLOCK_WORDS = 1_500_000
BUCKET_BYTES = 5 << 20
_LAST = np.iinfo(np.int64).max
_GRAM_BASE = 0xC2B2AE3D27D4EB4F


def _least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each width neighbours, and where it is (the leftmost)."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        right = values[step:] < values[:-step]
        values, at = np.where(right, values[step:], values[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return values, at


def _classes(part: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Class of each element by its class so far and its next word; -1 for those that agree with no other."""
    _, number, size = np.unique(part.astype(np.int64) << 32 | word.astype(np.int64), return_inverse=True, return_counts=True)
    return np.where(size[number] > 1, number, -1).astype(np.int32)


def extend(anchor: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray, most: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which windows of occurrences are repeats: [i, a] for the window that reaches a words to the left of the seed of i.

    words: 32-bit words in which left and right say where the seeds begin and where they end; least, most: the
    reaches that an occurrence has windows for; rank: order of its document.
    """
    n = len(anchor)
    out = np.zeros((n, SIDE + 1), bool)
    seed = np.unique(anchor, return_inverse=True, return_counts=True)
    seed = np.where(seed[2][seed[1]] > 1, seed[1], -1).astype(np.int32)
    agree = []
    for reach, word_at in ((most, lambda i, k: words[left[i] - k]), (SIDE - least, lambda i, k: words[right[i] + k - 1])):
        steps = [seed]
        for k in range(1, SIDE + 1):
            alive = np.flatnonzero((steps[-1] >= 0) & (reach >= k))
            steps.append(np.full(n, -1, np.int32))
            if len(alive):
                steps[-1][alive] = _classes(steps[-2][alive], word_at(alive, k))
        agree.append(steps)
    for a in range(SIDE + 1):
        to_left, to_right = agree[0][a], agree[1][SIDE - a]
        met = np.flatnonzero((to_left >= 0) & (to_right >= 0) & (least <= a) & (a <= most))
        if len(met):
            out[met, a] = _later(to_left[met].astype(np.int64) << 32 | to_right[met], rank[met])
    return out


class Block:
    """Windows of a run of documents."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.tags: list[np.ndarray] = []
        self.flat: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.words = self.docs = 0

    def add(self, ids: np.ndarray, tags: np.ndarray, c) -> None:
        words = c.word_hashes()
        at = np.arange(max(0, len(words) - WINDOW + 1))
        at = at[at + WINDOW <= np.repeat(c.first[1:], c.n_words)[: len(at)]]
        if len(at):
            grams = np.arange(len(words) - SEED + 1)
            anchors, seeds = _least(range_hashes(words, grams, grams + SEED, _GRAM_BASE), SIDE + 1)
            doc = c.doc_of_word()[at]
            self.parts.append((anchors[at], (at + self.words).astype(np.int32), (seeds[at] + self.words).astype(np.int32), (doc + self.docs).astype(np.int32), (at - c.first[doc]).astype(np.int32)))
        self.flat.append((words >> U(32)).astype(np.uint32))
        self.ids.append(ids)
        self.tags.append(tags)
        self.docs += c.n
        self.words += len(words)

    def close(self, n_buckets: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, body): local repeats have bodies that begin with R, occurrences with S."""
        if not self.parts:
            return
        ids, tags, flat = np.concatenate(self.ids), np.concatenate(self.tags), np.concatenate(self.flat)
        anchors, start, seed, doc, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts.clear()
        self.flat.clear()
        rank = np.unique(ids, return_inverse=True)[1]
        gap = np.ones(len(start), bool)
        gap[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
        change = gap.copy()
        change[1:] |= seed[1:] != seed[:-1]
        first, count = _blocks(np.ones(len(start), bool), change)
        most = seed[first] - start[first]
        found = extend(anchors[first], flat, seed[first], seed[first] + SEED, most - count + 1, most, rank[doc[first]])
        repeat = found[np.repeat(np.arange(len(first)), count), seed - start]
        del found
        first, count = _blocks(repeat, gap)
        if len(first):
            d = doc[first]
            yield int(ids[0] % n_buckets), b"R" + _head(ids[d], tags[d], pos[first], count)
        first, count = _blocks(~repeat, change)
        if not len(first):
            return
        hashed = mix(anchors[first] ^ U(0x2545F4914F6CDD1D))
        bucket = (hashed % U(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first, count, bucket, mark = first[order], count[order], bucket[order], (hashed[order] >> U(32)).astype("<u4")
        most = (seed[first] - start[first]).astype(np.uint8)
        size = count + SIDE - 1  # the words of all its windows, but for those of the seed
        ends = np.cumsum(size)
        inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
        around = flat[np.repeat(start[first], size) + inside + SEED * (inside >= np.repeat(most, size))].astype("<u4")
        at, _ = runs(bucket)
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True):
            d = doc[first[lo:hi]]
            head = _head(ids[d], tags[d], pos[first[lo:hi]], count[lo:hi])
            body = zlib.compress(most[lo:hi].tobytes() + mark[lo:hi].tobytes() + around[ends[lo] - size[lo] : ends[hi - 1]].tobytes(), 1)
            yield int(bucket[lo]), b"S" + struct.pack("<I", len(head)) + head + body


def _blocks(wanted: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of wanted elements that no change interrupts: (first, length)."""
    before = np.zeros(len(wanted), bool)
    before[1:] = wanted[:-1]
    first = np.flatnonzero(wanted & (change | ~before))
    total = np.concatenate([[0], np.cumsum(wanted)])
    return first, np.diff(np.append(total[first], total[-1]))


def _later(keys: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Elements whose key also has an element of smaller rank."""
    order = np.argsort(keys)
    at, length = runs(keys[order])
    sorted_rank = rank[order]
    out = np.zeros(len(keys), bool)
    if len(at):
        out[order] = sorted_rank > np.repeat(np.minimum.reduceat(sorted_rank, at), length)
    return out


def _head(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, count: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes() + pos.astype("<i4").tobytes() + count.astype("<i4").tobytes() + tags.astype("<u2").tobytes(), 1)


def _unhead(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zlib.decompress(body)
    n = len(raw) // 18
    ids = np.cumsum(np.frombuffer(raw, "<i8", n))
    return ids, np.frombuffer(raw, "<u2", n, 16 * n), np.frombuffer(raw, "<i4", n, 8 * n), np.frombuffer(raw, "<i4", n, 12 * n)


_FOUND = pa.schema([("id", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("n", pa.int32())])


def settle(bodies: list[bytes]) -> pa.Table:
    """The repeats of a bucket: rows of id, tag, first window, number of windows."""
    out = [_unhead(b[1:]) for b in bodies if b[:1] == b"R"]
    heads, mosts, marks, arounds = [], [], [], []
    for b in bodies:
        if b[:1] == b"S":
            k = struct.unpack("<I", b[1:5])[0]
            head = _unhead(b[5 : 5 + k])
            n, raw = len(head[0]), zlib.decompress(b[5 + k :])
            heads.append(head)
            mosts.append(np.frombuffer(raw, np.uint8, n))
            marks.append(np.frombuffer(raw, "<u4", n, n))
            arounds.append(np.frombuffer(raw, "<u4", offset=5 * n))
    if heads:
        ids, tags, pos, count = (np.concatenate(x) for x in zip(*heads, strict=True))
        most, around = np.concatenate(mosts).astype(np.int64), np.concatenate(arounds)
        size = count.astype(np.int64) + SIDE - 1
        middle = np.cumsum(size) - size + most
        found = extend(np.concatenate(marks), around, middle, middle, most - count + 1, most, ids)
        seg = np.repeat(np.arange(len(ids)), count)
        at = np.cumsum(count) - count
        inside = np.arange(len(seg)) - at[seg]
        repeat = found[seg, most[seg] - inside]
        change = inside == 0
        first, length = _blocks(repeat, change)
        own = seg[first]
        out.append((ids[own], tags[own], pos[own] + inside[first], length))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pa.Table.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _tag, _text, and all columns of df in _row."""
    own = [F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("_id"), F.xxhash64(text_col).bitwiseAND(0xFFFF).cast("int").alias("_tag")]
    return df.select(*own, F.col(text_col).alias("_text"), F.struct(*df.columns).alias("_row"))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, tag, start, n: runs of n windows, from word start on, that also start in documents with smaller ids."""
    n_buckets = max(8, -(-input_bytes(df) // BUCKET_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()

        def done() -> pa.RecordBatch | None:
            made = list(block.close(n_buckets))
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())], ["bucket", "body"])

        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint16)
            for c in chunks(batch.column(2)):
                block.add(ids[c.row : c.row + c.n], tags[c.row : c.row + c.n], c)
                if block.words >= block_words:
                    yield done()
                    block = Block()
        yield done()
        block = Block()
        give_back()

    def meet(bodies: pa.Table) -> pa.Table:
        found = settle(bodies.column("body").to_pylist())
        give_back()
        return found

    keyed = _keyed(df, id_col, text_col).select("_id", "_tag", "_text")
    return keyed.mapInArrow(cut, "bucket int, body binary").groupBy("bucket").applyInArrow(meet, "id bigint, tag int, start int, n int")


def kept_words(text: str | None, starts: list[int], counts: list[int]) -> tuple[list[bytes], int]:
    """(words that stay, how many go)."""
    words = (text or "").encode().split()
    if not starts:
        return words, 0
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, starts, 1)
    np.add.at(gone, np.minimum(np.add(starts, counts) + WINDOW - 1, len(words)), -1)
    keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return [words[i] for i in keep.tolist()], len(words) - len(keep)


def _joined(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = repeats(df, id_col, text_col).groupBy("id", "tag").agg(F.collect_list("start").alias("_starts"), F.collect_list("n").alias("_counts"))
    found = found.withColumnsRenamed({"id": "_id", "tag": "_tag"})
    return _keyed(df, id_col, text_col).join(found, ["_id", "_tag"], "left")


def _lists(batch: pa.RecordBatch) -> Iterator[tuple]:
    for text, starts, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        yield text, *kept_words(text, starts or [], counts or [])


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256 (kept words joined by one space) of every row."""
    names = [id_col, "n_words", "n_removed", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(len(keep) + gone, gone, hashlib.sha256(b" ".join(keep)).hexdigest()) for _, keep, gone in _lists(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(3), *(pa.array([m[i] for m in made], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string())))], names)

    kind = df.schema[id_col].dataType.simpleString()
    return _joined(df, id_col, text_col).select("_text", "_starts", "_counts", F.col("_row")[id_col].alias("_own")).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with repeats taken out of its texts; texts without repeats stay as they are, in others the kept words are joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b" ".join(keep).decode() if gone else text for text, keep, gone in _lists(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(3)], ["_text", "_row"])
        give_back()

    names = [c for c in df.columns if c != text_col]
    joined = _joined(df, id_col, text_col).select("_text", "_starts", "_counts", F.struct(*(F.col("_row")[c].alias(c) for c in names)).alias("_row"))
    made = joined.mapInArrow(run, f"_text string, _row {joined.schema['_row'].dataType.simpleString()}")
    return made.select(*(F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns))
