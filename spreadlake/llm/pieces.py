"""SentencePiece encoding and decoding through a table of distinct chunks.

A text is cut where no piece of the vocabulary can lie across: before a white-space marker that
follows another character, and around line feeds (when no piece holds one).  The distinct chunks of
a run of texts are segmented once, those that the worker's table has are not segmented again, and a
text's ids and its decoded form are the joined entries of its chunks by position.  Entries never
depend on the neighbours, so the result is that of encoding the whole text.

The table is one of a worker and bounded, not one of the corpus: that would send every chunk with its
position over the network twice, which is more than the texts themselves.

Null and empty texts have no ids and decode to an empty string.  Repeated rows and ids give a row
each; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
TOGETHER = 1 << 20


class PieceTable(dict):
    """Distinct chunks with (ids as comma-joined text, decoded text).

    Each distinct chunk of a batch of texts is segmented once, unless the table has it, and its ids are
    joined back at all its positions.  A table of max_entries becomes the older half, from which chunks
    that are met again come back; the half before is forgotten.  Chunks of over LONG characters rarely come back,
    and are held for their batch only, so the bytes of the table are bounded.
    """

    LONG = 64

    def __init__(self, model_file: str, max_entries: int = 300_000) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.max_entries, self.older, self.now = max_entries, {}, {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) or ("\n" in p and p != "\n") for p in pieces):
            raise ValueError("pieces of this model lie across markers or line feeds; chunks are not independent")
        head = self.model.encode("\n")
        if len(head) != 2 or self.model.decode(head) != "\n":
            raise ValueError("this model does not keep white space and a leading marker; chunks need both")
        self.cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall

    def _learn(self, distinct: set[str]) -> None:
        """Puts all of the distinct chunks into the table."""
        if len(self) >= self.max_entries:
            self.older = dict(self)
            self.clear()
        self.now.clear()
        for chunk in distinct.difference(self):
            got = self.older.get(chunk)
            if got is None:
                # A line feed in front keeps the chunk apart from the marker that the model puts before any text.
                ids = self.model.encode("\n" + chunk)
                got = (",".join(map(str, ids[2:])), self.model.decode(ids)[1:])
            (self if len(chunk) <= self.LONG else self.now)[chunk] = got

    def __missing__(self, chunk: str) -> tuple[str, str]:
        return self.now[chunk]

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(comma-joined ids, decoded text) of each whole text, TOGETHER characters or so at a time."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < TOGETHER):
                size += len(texts[hi])
                hi += 1
            cuts = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts[lo:hi]]
            self._learn(set().union(*cuts))
            for chunks in cuts:
                got = list(map(self.__getitem__, chunks))
                decoded = "".join([x[1] for x in got])
                yield ",".join([x[0] for x in got]), decoded[1:] if decoded[:1] == " " else decoded
            lo = hi


_held: dict[tuple, PieceTable] = {}


def _table(model_file: str, max_entries: int) -> PieceTable:
    key = (model_file, max_entries)
    if key not in _held:
        _held[key] = PieceTable(*key)
    return _held[key]


def _apply(df: DataFrame, model_file: str, id_col: str, text_col: str, fields: list[tuple[str, str, pa.DataType]], row: Callable, max_entries: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _table(model_file, max_entries).encode
        for batch in batches:
            made = [row(*x) for x in encode([t or "" for t in batch.column(1).to_pylist()])]
            cols = [pa.array([m[i] for m in made], f[2]) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, *(f[0] for f in fields)])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} {k}" for n, k, _ in fields)
    return df.select(id_col, text_col).mapInArrow(run, schema)


def encode_decode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", max_entries: int = 300_000) -> DataFrame:
    """id_col, ids (array<int>), decoded (string) of every text."""
    fields = [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())]
    return _apply(df, model_file, id_col, text_col, fields, lambda ids, text: (list(map(int, ids.split(","))) if ids else [], text), max_entries)


def encode_digests(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", max_entries: int = 300_000) -> DataFrame:
    """id_col, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 of every text.

    The same rows as encode_decode(), digested in the worker that made them, so ids and texts do not travel.
    """
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    fields = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _apply(df, model_file, id_col, text_col, fields, lambda ids, text: (ids.count(",") + 1 if ids else 0, sha(ids), sha(text)), max_entries)
