"""Best-fit packing of token sequences.

A document's ids (and an end id) are cut into pieces of at most `capacity` tokens; only longer
documents are cut.  Each task packs its share of the pieces by bounded-space best fit: a fixed
number of bins is open, kept in a bitset keyed by free space; a piece goes to the open bin with the
least free space that holds it; when a new bin would be one too many, the fullest one closes.
Pieces come longest first, so small ones fill what the large ones leave.

The number of tasks follows from the number of pieces (PIECES_A_TASK each), dealt evenly by a hash
of id and piece number; a third of all rows from one source or copies of one text change nothing.

A null or empty text is its end id alone.  Repeated rows (one id twice) are packed twice.  Empty
tables give empty results.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .textcore import give_back

CAPACITY, END_ID, OPEN_BINS, PIECES_A_TASK = 2048, 0, 4096, 60_000


#: Lower-case letters of Latin scripts, without marks of their own.
PLAIN = "abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xDF, 0x180)) if c.isalpha() and c.islower())


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ChunkIds(dict):
    """chunk of non-space bytes -> its ids as little-endian unsigned 32-bit.

    When it is full, it becomes the older half, from which chunks that are met again come back; the half
    before is forgotten.  Chunks of over LONG bytes rarely come back, and are not kept, so its bytes are bounded.

    Right for tokenizers that drop ASCII white space before anything else looks at a text, lower-case it,
    and cut between a letter and the punctuation in TAIL: then a word and its tail have entries of their own.
    It is the last character after NFC and lower-casing that counts, which may be a combining mark where the raw one is a letter.
    """

    TAIL = b".,;:!?*$%&#"
    LONG = 64

    def __init__(self, tokenizer_file: str, half: int = 200_000) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        self.encode_one, self.model = tokenizer.encode, tokenizer.model
        self.half, self.older = half, {}
        ids = lambda text: self.encode_one(text, add_special_tokens=False).ids
        words = ("word", "W\u00f6rter", "\u6f22\u5b57", "x1", "\u0130x")
        spaced = all(ids(f" {a} \t{b}\x0b\n{a}\r\x0c") == ids(a) + ids(b) + ids(a) for a in words for b in words)
        tails = all(ids(w + t) == ids(w) + ids(t) for w in words if w[-1].isalpha() for t in (*map(chr, self.TAIL), "...", "!?", "#*"))
        # letters that the tokenizer leaves as they are, with the form in which its model gets them
        kept = {c: tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in PLAIN if tokenizer.normalizer.normalize_str(f"a{c}b") == f"a{c}b"}
        self.form = {ord(c): x[0][0] for c, x in kept.items() if len(x) == 1}
        self.plain = re.compile(f"[{''.join(map(chr, self.form))}]+").fullmatch
        whole = all([t.id for t in self.model.tokenize(w.translate(self.form))] == ids(w) for w in ("word", "the", "w\u00f6rter", "\u00e9t\u00e9s", "ma\u00f1ana", "".join(map(chr, self.form))) if self.plain(w))
        if not (spaced and tails and whole and all(ids(w.lower()) == ids(w) for w in ("word", "WORD", "Word"))):
            raise ValueError("this tokenizer keeps white space or case, or does not cut before punctuation; its chunks are not independent")

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        if (got := self.older.get(chunk)) is not None:
            self[chunk] = got
            return got
        core = chunk.rstrip(self.TAIL)
        if core and core != chunk and (core.isalpha() or unicodedata.normalize("NFC", core.decode()).lower()[-1].isalpha()):  # bytes: ASCII letters only
            got = self[core] + self[chunk[len(core) :]]
            if len(chunk) <= self.LONG:
                self[chunk] = got
            return got
        if chunk.isalpha() and chunk != chunk.lower():  # bytes: ASCII letters only
            got = self[chunk.lower()]
            if len(chunk) <= self.LONG:
                self[chunk] = got
            return got
        text = chunk.decode()
        if self.plain(text):  # one word to the model: no normalising, no cutting
            ids = [t.id for t in self.model.tokenize(text.translate(self.form))]
        else:
            ids = self.encode_one(text, add_special_tokens=False).ids
        got = _packed(ids)
        if len(chunk) <= self.LONG:
            self[chunk] = got
        return got

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


def pieces(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id_col, piece, start, length, ids_crc32 of every piece of every whole text."""
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ChunkIds(tokenizer_file)  # a task's own: workers live on, and would keep the table
        get = held.ids
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = get(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, names)
        del held, get
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, n_open, n_bins = 0, 0, 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        fits = bits >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            bin_ = by_free[free].pop()
            if not by_free[free]:
                bits ^= 1 << free
        else:
            bin_, free = n_bins, capacity
            n_bins += 1
            n_open += 1
        where[i], offset[i] = bin_, capacity - free
        free -= need
        if not free:
            n_open -= 1
            continue
        if n_open > open_bins:  # the fullest bin closes; it may be this one
            least = (bits & -bits).bit_length() - 1 if bits else capacity
            n_open -= 1
            if free <= least:
                continue
            by_free[least].pop(0)
            if not by_free[least]:
                bits ^= 1 << least
        if not by_free[free]:
            bits |= 1 << free
        by_free[free].append(bin_)
    return where, offset


def pack(parts: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """parts with sequence_id and offset.  parts should be a written table: it is read twice.

    sequence_id is the task's number times 2**40, plus the bin's number there.
    """
    tasks = max(1, -(-parts.count() // pieces_a_task))
    names = [*parts.columns, "sequence_id", "offset"]
    # which task: by content and not by arrival, so that a task that is run again gets the same pieces
    own = "_task"
    while own in parts.columns:
        own += "_"
    dealt = parts.withColumn(own, F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(tasks)).cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns=own).sort_values(["length", id_col, "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(pdf["length"].to_numpy(np.int64), capacity, open_bins)
        return pdf.assign(sequence_id=bins + (int(key[0]) << 40), offset=offsets)[names]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return dealt.groupBy(own).applyInPandas(run, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all whole texts with their places in sequences."""
    made = table(df.sparkSession, pieces(df, tokenizer_file, id_col, text_col, capacity, end_id), "pieces")
    return pack(made, id_col, capacity)
