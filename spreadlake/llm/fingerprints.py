"""Document fingerprints: one-permutation MinHash.

The hashes of a text's distinct 5-word shingles (fewer words: the whole sequence as one) are dealt
into BINS bins by their top bits; a bin keeps its smallest hash.  An empty bin copies the bin that a
fixed sequence of hashed positions reaches first (optimal densification).  The lowest BITS bits of
each bin, packed, are the fingerprint.  Two fingerprints that agree in a share m of their bins have
likeness (m - c) / (1 - c), where c = 2**-BITS is the share that agrees by chance, kept in 0 to 1.

A null text is an empty one.  Texts without words have a fingerprint of their own (`-`): like each
other (1), unlike any other (0).  Repeated rows get a result each.  Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_bytes
from .textcore import CHUNK_BYTES, Chunk, chunks, mix

U = np.uint64
BINS, BITS, WORDS = 256, 4, 5
MOST_RANGES = 1 << 16
NO_WORDS = "-"
_EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketch(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(documents x BINS low bits, has words) of a chunk."""
    docs, hashes = c.shingles(c.word_hashes(), WORDS)
    shift = U(64 - int(BINS).bit_length() + 1)
    cell = docs * BINS + (hashes >> shift).astype(np.int64)
    order = np.argsort(hashes, kind="stable")[::-1]
    least = np.full(c.n * BINS, _EMPTY, U)
    least[cell[order]] = hashes[order]  # of equal indices the last, so the smallest hash, stays
    least = least.reshape(c.n, BINS)
    filled = np.zeros(c.n * BINS, bool)
    filled[cell] = True
    filled = filled.reshape(c.n, BINS)
    some = c.n_words > 0
    rows = np.flatnonzero(some & ~filled.all(1))
    if len(rows):
        got, had = least[rows], filled[rows]
        own, attempt = had.copy(), 0
        bins = np.arange(BINS, dtype=U)
        while len(rows):
            attempt += 1
            source = (mix(bins * U(0x9E3779B97F4A7C15) + U(attempt)) >> shift).astype(np.int64)
            take = ~had & own[:, source]
            got = np.where(take, got[:, source], got)
            had |= take
            done = had.all(1)
            if done.any():
                least[rows[done]] = got[done]
                rows, got, had, own = rows[~done], got[~done], had[~done], own[~done]
    own = mix(np.arange(1, BINS + 1, dtype=U) * U(0x9E3779B97F4A7C15))  # a bin's own bits of a hash, else copies of one hash would all agree by one chance
    return (mix(least ^ own) & U((1 << BITS) - 1)).astype(np.uint8), some


def text_form(low: np.ndarray, some: bool) -> str:
    if not some:
        return NO_WORDS
    return base64.b64encode(np.packbits(np.unpackbits(low[:, None], axis=1)[:, -BITS:].reshape(-1)).tobytes()).decode()


def likeness(a: np.ndarray, a_some: bool, b: np.ndarray, b_some: bool) -> float:
    if not (a_some and b_some):
        return float(a_some == b_some)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [sketch(c) for c in chunks(pa.array(texts, pa.string()))]
    if not parts:
        return np.zeros((0, BINS), np.uint8), np.zeros(0, bool)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [text_form(low, some) for c in chunks(batch.column(1)) for low, some in zip(*sketch(c), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], [id_col, "fingerprint"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fingerprint string")


def _edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _range_of(id_col: str, cuts: list[int]) -> Column:
    """How many cuts (ascending) an id reaches, found in two steps of about their square root; a null id reaches none."""
    step = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if not blocks:
        return F.lit(0)
    reached = lambda values: F.size(F.filter(values, lambda b: b <= F.col(id_col)))
    heads = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<bigint>")
    block = reached(heads)  # how many blocks it reaches the first cut of
    inside = F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>")
    return F.when(F.col(id_col).isNull() | (block == 0), 0).otherwise((block - 1) * step + reached(F.element_at(inside, F.greatest(block, F.lit(1))))).cast("int")


def _slot_of(spark: SparkSession, ranges: list[int]) -> Column:
    """A number for each range that the hash of a repartition() into len(ranges) tasks sends to a task of its own."""
    n = len(ranges)
    tried = spark.range(max(64, 40 * n)).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("task"))
    found = [r["id"] for r in tried.groupBy("task").agg(F.min("id").alias("id")).orderBy("task").collect()]
    slots = [-1] * (max(ranges) + 1)
    for i, r in enumerate(ranges):
        slots[r] = found[i % len(found)]
    return F.element_at(F.from_json(F.lit(json.dumps(slots)), "array<bigint>"), F.col("range") + 1)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 24 << 20) -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next larger id (of rows with one id, by text), after the
    last the first.  Ranges of ids, cut at quantiles, are each sorted and read once in order; the
    first document of a range also goes to the end of the range before it.  Texts cross the network once,
    and each range goes to a task of its own.  A range's bytes grow only beyond MOST_RANGES of them; it is
    streamed, so its size is time and not memory.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    parts = max(1, min(MOST_RANGES, input_bytes(df) // range_bytes + 1))
    cuts = sorted({int(c) for c in docs.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    placed = docs.withColumn("range", _range_of("id", cuts))
    # One row for each range: its least id, and the range before it (the last, for the first).
    firsts = placed.groupBy("range").agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("null_first")).orderBy("range").collect()
    if not firsts:
        return spark.createDataFrame([], _schema(id_col))
    heads = [(r["range"], None if r["null_first"] else r["id"], firsts[i - 1]["range"]) for i, r in enumerate(firsts)]
    head = spark.createDataFrame(heads, "range int, head bigint, before int")
    again = placed.join(F.broadcast(head), "range").filter(F.col("id").eqNullSafe(F.col("head")))
    # of several rows with the head's id only the first is wanted; they are few rows of a range's least id
    again = again.groupBy("before").agg(F.min("text").alias("text")).select(F.lit(None).cast("bigint").alias("id"), "text", F.col("before").alias("range"), F.lit(1).alias("tail"))
    rows = placed.select("id", "text", "range", F.lit(0).alias("tail")).unionByName(again)
    dealt = rows.repartition(len(firsts), _slot_of(spark, [r["range"] for r in firsts])).sortWithinPartitions("range", "tail", F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # the last row of the part before

        def part(rows: list[tuple]) -> pa.RecordBatch:
            # every row but the last has its successor; tails have no result of their own
            texts = [r[1] for r in rows]
            changed = [_edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            low, some = sketches(texts)
            elow, esome = sketches(changed)
            ids, n_chars, sha, own, other, near_e, near_n = ([] for _ in range(7))
            for i, r in enumerate(rows[:-1]):
                if r[3]:
                    continue
                ids.append(r[0])
                n_chars.append(len(r[1]))
                sha.append(hashlib.sha256(changed[i].encode()).hexdigest())
                own.append(text_form(low[i], some[i]))
                other.append(text_form(elow[i], esome[i]))
                near_e.append(likeness(low[i], some[i], elow[i], esome[i]))
                near_n.append(likeness(low[i], some[i], low[i + 1], some[i + 1]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((ids, n_chars, sha, own, other, near_e, near_n), kinds, strict=True)], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            held, size = waiting, 0
            for r in zip(*cols, strict=True):
                held.append(r)
                size += len(r[1])
                if size >= CHUNK_BYTES:
                    yield part(held)
                    held, size = [r], 0
            if len(held) > 1:
                yield part(held)
            waiting = held[-1:]

    out = dealt.mapInArrow(run, _schema("id"))
    return out.withColumnRenamed("id", id_col)


def _schema(id_col: str) -> str:
    return f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
