"""Language identification by rank-order profiles.

A profile is the ranked list of the most frequent character 1- to 3-grams of a language, words
padded with a space on either side.  A document's own ranked list is compared with each profile by
the out-of-place distance: the sum over its n-grams of the difference of ranks, or the profile's
length for an n-gram that the profile lacks.  The nearest profile names the language.

A null text, or one without a letter, gives `und` and score 0.  Ties in frequency are ordered by
n-gram, ties in distance by language name.  Repeated rows are judged alike.  Empty tables give
empty results; without a single labelled text every document is `und`.  Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

PROFILE = 300
_SHIFT = 21
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as integers (three code points of 21 bits, the first lowest); none without a letter."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[cps]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of other characters, the one behind a word stands for all
    cps = np.where(letter, cps, 32)[keep]
    cps = np.concatenate([[32], cps, [32]] if cps[-1] != 32 else [[32], cps])
    one, two, three = cps[cps != 32], cps[:-1] | cps[1:] << _SHIFT, cps[:-2] | cps[1:-1] << _SHIFT | cps[2:] << 2 * _SHIFT
    return np.concatenate([one, two, three[cps[1:-1] != 32]])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def ranked(text: str, size: int) -> np.ndarray:
    """The most frequent n-grams of a text, best first."""
    keys, counts = counted(grams(text))
    return keys[np.argsort(-counts, kind="stable")[:size]]


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """lang, gram, rank (from 0) of each language's profile, over all rows with text and language.

    Tasks add up counts before the shuffle, so it carries distinct n-grams and not occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(lang: str) -> None:
            keys, counts = counted(np.concatenate(held.pop(lang)))
            if lang in totals:
                both = np.concatenate([totals[lang][0], keys])
                keys, where = np.unique(both, return_inverse=True)
                counts = np.bincount(where, np.concatenate([totals[lang][1], counts])).astype(np.int64)
            totals[lang] = keys, counts

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = held.setdefault(lang, [])
                part.append(grams(text))
            for lang in list(held):
                fold(lang)
        for lang, (keys, counts) in totals.items():
            for i in range(0, len(keys), 10_000):
                part = keys[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.int64()), pa.array(counts[i : i + 10_000], pa.int64())], ["lang", "gram", "n"])

    known = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), text_col)
    total = known.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return total.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


def predict(df: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """id_col, lang_pred, score of every whole text; score is 1 less the distance as a share of the largest one.

    The profiles come to the driver: size rows for each language.
    """
    rows = profiles.orderBy("lang", "rank").collect()
    langs = sorted({r["lang"] for r in rows})
    union = np.unique(np.array([r["gram"] for r in rows], np.int64))
    ranks = np.full((len(langs), len(union) + 1), -1, np.int64)  # -1: not in the profile; the last column is for unknown n-grams
    for r in rows:
        ranks[langs.index(r["lang"]), np.searchsorted(union, r["gram"])] = r["rank"]

    def one(text: str | None) -> tuple[str, float]:
        mine = ranked(text, size) if text else np.zeros(0, np.int64)
        if not len(mine) or not langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(union, mine), len(union) - 1)
        at = np.where(union[at] == mine, at, len(union))
        theirs = ranks[:, at]
        far = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(mine)))).sum(1)
        best = int(far.argmin())
        return langs[best], 1.0 - float(far[best]) / (size * len(mine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], [id_col, "lang_pred", "score"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
