"""Quality rules by weak supervision.

Rules look at counts of a text and vote good (+1), bad (-1) or abstain (0).  The votes of all
documents are summed up as a histogram of vote patterns (at most 3**rules rows, whatever the corpus).
Expectation-maximisation on that histogram estimates each rule's accuracy on good and on bad
documents and the share of good ones; a document's posterior probability of being good replaces
an all-rules-must-pass filter.

Null and empty texts have zero counts; they fail the base rule on words.  Repeated rows are judged
alike.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import Chunk, byte_hashes, chunks, mix

U = np.uint64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alpha_words", "n_shout_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
REPEAT_WINDOW = 8


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[bounds])


def _seen_before(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, shared): equals an earlier / any other element of the same document."""
    keys = mix(docs.astype(U) + U(0x51ED270B)) ^ hashes
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    later, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order], shared[order] = same[:-1], same[:-1] | same[1:]
    return later, shared


def count_chunk(c: Chunk) -> dict[str, np.ndarray]:
    """The counts of each document of a chunk."""
    data, n = c.data, len(c.data)
    letters = (data & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
    out = {"n_words": c.n_words.astype(np.int64), "n_symbols": _sums(_SYMBOL[data], c.offsets), "n_upper": _sums(_UPPER[data], c.offsets)}
    out["word_chars"] = _sums(total[c.end] - total[c.start], c.first)
    alpha = np.concatenate([[0], np.cumsum(_ALPHA[data], dtype=np.int64)])
    out["n_alpha_words"] = _sums(alpha[c.end] > alpha[c.start], c.first)
    tail = data[c.end - 1] if len(c.end) else data[:0]
    out["n_shout_words"] = _sums((tail == 33) | _SYMBOL[tail], c.first)
    # lines: from the start of a document or behind a line feed, up to the next feed or the document's end
    edge = np.zeros(n + 1, bool)
    edge[c.offsets] = True
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([c.offsets[:-1][np.diff(c.offsets) > 0], feeds[~edge[feeds + 1]] + 1]))
    doc_end = c.offsets[np.searchsorted(c.offsets, start, "right")]
    end = np.minimum(np.append(feeds, n)[np.searchsorted(feeds, start)], doc_end)
    has_word = np.searchsorted(c.start, end) > np.searchsorted(c.start, start)
    start, end = start[has_word], end[has_word]
    docs = np.searchsorted(c.offsets, start, "right") - 1
    later, _ = _seen_before(docs, byte_hashes(data, start, end))
    out["n_lines"] = np.bincount(docs, minlength=c.n).astype(np.int64)
    out["n_dup_lines"] = np.bincount(docs[later], minlength=c.n).astype(np.int64)
    # words inside windows that occur twice or more in their document
    words = c.word_hashes()
    at, hashes = c.windows(words, REPEAT_WINDOW)
    _, shared = _seen_before(c.doc_of_word()[at], hashes)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[shared], 1)
    np.add.at(cover, at[shared] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = _sums(np.cumsum(cover[:-1]) > 0, c.first)
    return out


def text_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the COUNTS of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [count_chunk(c) for c in chunks(batch.column(1))]
            cols = [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for k in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, *COUNTS])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """name -> vote (1 good, -1 bad, 0 abstains), over the COUNTS."""
    n, lines = F.col("n_words"), F.col("n_lines")
    some = n >= 20
    return {
        "length": _vote(n >= 50, n < 20),
        "word_size": _vote(some & F.col("word_chars").between(3 * n, 9 * n), some & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n))),
        "symbols": _vote(some & (50 * F.col("n_symbols") <= n), some & (10 * F.col("n_symbols") > n)),
        "dup_lines": _vote((lines >= 3) & (F.col("n_dup_lines") == 0), (lines >= 3) & (10 * F.col("n_dup_lines") > 3 * lines)),
        "repeats": _vote(some & (20 * F.col("n_repeat_words") <= n), some & (100 * F.col("n_repeat_words") > 20 * n)),
        "capitals": _vote(some & (10 * F.col("n_upper") <= F.col("word_chars")), some & (10 * F.col("n_upper") > 3 * F.col("word_chars"))),
        "letters": _vote(some & (10 * F.col("n_alpha_words") >= 9 * n), some & (10 * F.col("n_alpha_words") < 7 * n)),
        "word_ends": _vote(some & (20 * F.col("n_shout_words") <= n), some & (4 * F.col("n_shout_words") > n)),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, iterations: int = 200, tolerance: float = 1e-9) -> tuple[float, np.ndarray]:
    """EM over a histogram of vote patterns (-1, 0, 1; a column a rule): (share of good, P(good vote | class, rule) as [bad, good] x rules).

    An abstention says nothing, so it has no factor.  Documents with fewer than two votes can't show
    whether rules agree and are left out.  The start, rules that are right nine times in ten on good
    documents and six in ten on bad ones, fixes which class is which; a prior of two pseudo-votes
    keeps probabilities inside (0, 1).
    """
    use = (patterns != 0).sum(1) >= 2
    patterns, counts = patterns[use], counts[use]
    k = patterns.shape[1]
    plus, minus = (patterns == 1).astype(float), (patterns == -1).astype(float)
    prob = np.stack([np.full(k, 0.4), np.full(k, 0.9)])
    prior = 2 * prob
    share, last = 0.8, -np.inf
    for _ in range(iterations if len(counts) else 0):
        logs = plus @ np.log(prob).T + minus @ np.log(1 - prob).T + np.log([1 - share, share])
        top = logs.max(1, keepdims=True)
        post = np.exp(logs - top)
        total = post.sum(1, keepdims=True)
        post /= total
        like = float((counts * (np.log(total[:, 0]) + top[:, 0])).sum())
        weight = post * counts[:, None]
        prob = (weight.T @ plus + prior) / (weight.T @ (plus + minus) + 2)
        share = float((weight[:, 1].sum() + 0.8) / (counts.sum() + 1))
        if abs(like - last) <= tolerance * max(1.0, abs(like)):
            break
        last = like
    return share, prob


def judge(counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """counts with p_good, the posterior probability under rules fitted on all rows, and verdict (p_good >= threshold).

    One aggregation to at most 3**rules patterns comes to the driver.
    """
    votes = rules()
    table = counts.groupBy(*(v.alias(f"_v_{k}") for k, v in votes.items())).count().toPandas()
    if not len(table):
        return counts.withColumns({"p_good": F.lit(None).cast("double"), "verdict": F.lit(False)})
    patterns = table.iloc[:, :-1].to_numpy(np.int64)
    order = np.lexsort(patterns.T)  # the same sums in the same order in any run
    share, prob = fit(patterns[order], table["count"].to_numpy(float)[order])
    odds = F.lit(float(np.log(share) - np.log(1 - share)))
    for r, vote in enumerate(votes.values()):
        good, bad = (float(np.log(f(prob[1, r])) - np.log(f(prob[0, r]))) for f in (lambda p: p, lambda p: 1 - p))
        odds = odds + F.when(vote == 1, good).when(vote == -1, bad).otherwise(0.0)
    p_good = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    return counts.withColumn("p_good", p_good).withColumn("verdict", F.col("p_good") >= threshold)
