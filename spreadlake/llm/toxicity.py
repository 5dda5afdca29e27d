"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Features are the distinct 4- and 5-grams of code points of the lower-cased text (white space as one
space, a space at either end), hashed into SLOTS slots.  For slot j, r[j] is the log ratio of its
smoothed document frequencies in toxic and in other training documents, counted over all labelled
training rows.  A logistic regression on x * r, x the 0/1 feature vector, is fitted on at most
fit_rows labelled rows (chosen by a hash of the id; a documented bound), and applied to whole texts.

Null texts are empty; they and texts without a known feature get the score of the intercept.
Repeated rows are scored alike; of repeated labels of one id the largest counts.  A null label is no
label.  Without labels of both classes the score is the smoothed share of toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, maybe_in, table
from .textcore import give_back, mix

U = np.uint64
SLOTS = 1 << 18
SIZES = (4, 5)
PIECE = 1 << 12  # slots in a row of partial counts
FIT_ROWS, FIT_SLOTS, FIT_BLOCK = 3000, 30_000_000, 1_000_000
THRESHOLD = 0.3


def features(text: str | None) -> np.ndarray:
    """Distinct slots of a whole text, ascending."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.int32)
    cps = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    found = []
    for size in SIZES:
        if len(cps) >= size:
            h = cps[: len(cps) - size + 1].copy()
            for k in range(1, size):
                h = h * U(0x9E3779B97F4A7C15) + cps[k : len(cps) - size + 1 + k]
            found.append(mix(h + U(size)) >> U(64 - 18))
    flags = np.zeros(SLOTS, bool)
    for h in found:
        flags[h.astype(np.int64)] = True
    return np.flatnonzero(flags).astype(np.int32)


def fit_linear(docs: list[np.ndarray], labels: np.ndarray, r: np.ndarray, l2: float = 30.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """(weights with r folded in, intercept) of L2-regularised logistic regression, by accelerated gradient steps.

    Rows are visited in the order given and sums are in fixed order, so equal input gives equal weights.
    Besides the slots of the documents (4 bytes each) memory holds about FIT_BLOCK of them at a time.
    """
    lengths = np.array([len(d) for d in docs])
    cuts = np.unique(np.append(0, np.searchsorted(np.cumsum(lengths), np.arange(FIT_BLOCK, lengths.sum(), FIT_BLOCK), "right")))
    blocks = [(lo, hi, np.concatenate(docs[lo:hi])) for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(docs)], strict=True)]

    def sums(weight: np.ndarray) -> np.ndarray:
        """The sum of a weight over the slots of each document."""
        parts = [np.bincount(np.repeat(np.arange(hi - lo), lengths[lo:hi]), weight[slots], hi - lo) for lo, hi, slots in blocks]
        return np.concatenate(parts)

    def back(err: np.ndarray) -> np.ndarray:
        """The sum of a document's value over the documents of each slot."""
        return sum(np.bincount(slots, np.repeat(err[lo:hi], lengths[lo:hi]), SLOTS) for lo, hi, slots in blocks)

    r = r.astype(float)
    w, b = np.zeros(SLOTS), float(np.log(labels.mean() / (1 - labels.mean())))
    step = 4.0 / (sums(r**2).max() + 1.0 + 4 * l2)
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = sums(r * v) + c
        err = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels
        w2 = v - step * (r * back(err) + l2 * v)
        b2 = c - step * err.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return (w * r).astype(np.float32), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_slots: int = FIT_SLOTS) -> tuple[np.ndarray, float]:
    """Model of the labelled rows of docs: (weight of each slot, intercept).  What comes to the driver has a fixed size.

    Counts cover all labelled rows.  The weights are fitted on a sample, bounded by two parameters: at most
    fit_rows documents, and of these, in the order of a hash of their ids, as many as have fit_slots slots in all.
    """
    spark = docs.sparkSession
    label = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    n = label.count()
    share = min(1.0, 0.9 * fit_rows / max(n, 1))  # a little less, so that the draw rarely exceeds the bound
    draw = F.xxhash64("_id", F.lit(11)).bitwiseAND((1 << 30) - 1) < int(share * (1 << 30))
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = maybe_in(known, label.select("_id"), "_id").join(label, "_id").select("_id", "_text", "_label", draw.alias("_fit"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SLOTS), np.int32)
        total = [0, 0]
        names = ["kind", "key", "label", "body"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, text, y, drawn in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                slots = features(text)
                sums[int(y > 0), slots] += 1
                total[int(y > 0)] += 1
                if drawn:
                    for o, x in zip(out, ("doc", key, int(y > 0), slots.tobytes()), strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names)
        if sum(total):
            rows = [("sum", i, y, sums[y, i * PIECE : (i + 1) * PIECE].tobytes()) for y in (0, 1) for i in range(SLOTS // PIECE)]
            rows.append(("n", 0, 0, np.array(total, np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)
        give_back()

    made = table(spark, known.mapInArrow(count, "kind string, key bigint, label int, body binary"), "toxicity-counts")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = np.int32 if pdf["kind"].iloc[0] == "sum" else np.int64
        total = sum(np.frombuffer(b, kind).astype(np.int64) for b in pdf["body"])
        return pdf.iloc[:1].assign(body=[np.asarray(total, np.int64).tobytes()])

    summed = made.filter("kind <> 'doc'").groupBy("kind", "key", "label").applyInPandas(add, made.schema).collect()
    df, totals = np.zeros((2, SLOTS)), np.zeros(2)
    for x in summed:
        part = np.frombuffer(x["body"], np.int64)
        if x["kind"] == "sum":
            df[x["label"], x["key"] * PIECE : (x["key"] + 1) * PIECE] = part
        else:
            totals = part.astype(float)
    if not totals.all():
        drop_table(spark, made)
        return np.zeros(SLOTS, np.float32), float(np.log((totals[1] + 1) / (totals[0] + 1)))
    ratio = (np.log((df[1] + 1) / (totals[1] + 2)) - np.log((df[0] + 1) / (totals[0] + 2))).astype(np.float32)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        y = pdf["label"].to_numpy(float)
        if y.min() == y.max():
            return pd.DataFrame({"weights": [np.zeros(SLOTS, np.float32).tobytes()], "intercept": [float(np.log((totals[1] + 1) / (totals[0] + 1)))]})
        weights, intercept = fit_linear([np.frombuffer(b, np.int32) for b in pdf["body"]], y, ratio)
        return pd.DataFrame({"weights": [weights.tobytes()], "intercept": [intercept]})

    # At most about fit_rows rows: the draw is by a hash whose share was set from the number of labels.
    drawn = made.filter("kind = 'doc'").withColumns({"_at": F.xxhash64("key"), "_slots": F.length("body") / 4})
    rows = drawn.select("_at", "_slots").orderBy("_at").limit(fit_rows).collect()
    last = next((r["_at"] for r, total in zip(rows, np.cumsum([r["_slots"] for r in rows]), strict=True) if total > fit_slots), None)
    fitted = drawn.orderBy("_at").limit(fit_rows).drop("_slots")
    got = (fitted if last is None else fitted.filter(F.col("_at") < last)).drop("_at").withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fit, "weights binary, intercept double").collect()
    drop_table(spark, made)
    if not got:
        return np.zeros(SLOTS, np.float32), float(np.log((totals[1] + 1) / (totals[0] + 1)))
    return np.frombuffer(got[0]["weights"], np.float32), got[0]["intercept"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """id_col, score (0 to 1), predicted (1 if score >= threshold) of every whole text; keep: all columns of docs, too, but for those of these two names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted")] if keep else [id_col]
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value
        for batch in batches:
            z = np.array([float(weights[features(t)].sum(dtype=np.float64)) for t in batch.column(at).to_pylist()]) + intercept
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], [*names, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col(text_col).alias("_scored")).mapInArrow(run, f"{kinds}, score double, predicted int")
