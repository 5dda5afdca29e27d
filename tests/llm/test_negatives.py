"""Hard negatives against all pairs."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spreadlake.llm import negatives, queries

from .conftest import SF, rows


def brute(table, every=100):
    """Rows of the contract by all pairs; rows that are equal in id, label and vector count once."""
    parts = set()
    for i, v, y in table:
        if i is None or y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        parts.add((i, (y + 1) % 10 if i % 7 == 0 else y, tuple(int(np.floor(256 * float(x))) for x in v)))
    parts = sorted(parts)
    out = []
    for a in parts:
        if a[0] % every:
            continue
        by_score = sorted((-sum(x * y for x, y in zip(a[2], c[2])), c[0], c[1]) for c in parts if c != a)
        for s, i, _ in [x for x in by_score if x[2] == a[1]][:5]:
            fit = [x for x in by_score if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a[0], i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(spark, table, every=100):
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in table], "vec_id long, embedding array<float>, label int, key string, cell int")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r[c] for c in NAMES) for r in rows(negatives.mine(df, F.col("vec_id") % every == 0, moved)))


def test_op11(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    want = brute(zip(t["vec_id"], t["embedding"], t["label"], strict=True))
    got = rows(queries.op11_hard_negatives(spark, SF))
    assert sorted(tuple(r[c] for c in NAMES) for r in got) == want and want
    assert dict(queries.op11_hard_negatives(spark, SF).dtypes) == {c: "int" if c == "rank" else "bigint" for c in NAMES}


def test_odd_rows(spark):
    """Nulls, NaN, infinities, ragged and empty vectors, repeated rows and ids, groups of copies, ties, few labels."""
    rng = np.random.default_rng(3)
    table = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 256], int(rng.integers(0, 3))) for i in range(400)]
    table += [(i, [0.5, 0.25, 0.0, -0.125], i % 3) for i in range(400, 1000)]  # copies
    table += table[::7]
    table += [(100, [0.25] * 4, 1), (100, [0.5] * 4, 1), (200, [0.5] * 6, 2), (7, [0.1], 0), (1000, [], 0), (1100, [0.0] * 4, 1)]
    table += [(300, None, 1), (2000, [None, 1.0], 1), (2100, [float("nan"), 1.0], 1), (2200, [float("inf"), 1.0], 1), (2300, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    assert mined(spark, table) == brute(table)
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == [] == mined(spark, [(2000, [None], 1)])
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]) == [(0, 2, 1, 1, 65536, 65536)]  # the label of id 0 moves


def test_clusters_and_many_blocks(spark, monkeypatch):
    """Far clusters, which are pruned; blocks and chunks so small that each cell is salted; one group holds a third."""
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 2, (9, 12))
    table = [(i, [float(x) for x in (middles[i % 9] + rng.normal(0, 0.05, 12)).astype(np.float32)], int(rng.integers(0, 4))) for i in range(1200)]
    table += [(i, table[5][1], i % 4) for i in range(1200, 1800)]
    want = brute(table, 20)
    assert mined(spark, table, 20) == want and len(want) > 500
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "CHUNK", 2)
    assert mined(spark, table, 20) == want


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("seed", range(6))
def test_search_of_a_block(seed, same):
    rng = np.random.default_rng(seed)
    n, m, d, k = int(rng.integers(1, 3000)), int(rng.integers(1, 200)), int(rng.integers(1, 20)), 5
    span = [3, 300, 1 << 27][seed % 3]
    c, a = rng.integers(-span, span + 1, (n, d)), rng.integers(-span, span + 1, (m, d + seed % 2))
    cl, al, ids = rng.integers(0, 3, n), rng.integers(0, 3, m), rng.permutation(n).astype(np.int64)
    owner = np.sort(rng.integers(0, m, 2 * m))
    score = np.pad(a, ((0, 0), (0, 0))).astype(object)[:, :d] @ c.T.astype(object)
    cap = np.array([int(rng.choice(score[i].astype(np.int64))) for i in owner], np.int64)
    floor = cap - span * 10
    got = list(zip(*(x.tolist() for x in negatives.search(negatives.Block(c, cl, ids), a, al, negatives.Queries(owner, cap, floor), k, same)), strict=True))
    want = []
    for q, i in enumerate(owner.tolist()):
        fit = sorted((-score[i, j], int(ids[j])) for j in range(n) if (cl[j] == al[i]) == same and floor[q] <= score[i, j] <= cap[q])
        want += [(q, -s, x) for s, x in fit[:k]]
    assert sorted(got) == sorted(want)


def test_intervals_hold_all_products_and_prune():
    rng = np.random.default_rng(1)
    a, c = rng.normal(size=(500, 8)) * 3 + np.repeat([[-40], [40]], 250, axis=0), rng.normal(size=(900, 8)) * 10 + 40
    ta, tc = negatives.Tree(a, 8), negatives.Tree(c, 8)
    low, high = negatives.intervals(ta.nodes[-1], tc.nodes[-1])
    products = a[ta.order] @ c[tc.order].T
    for i, (lo, hi) in enumerate(zip(ta.starts[-1][:-1], ta.starts[-1][1:])):
        for j, (l2, h2) in enumerate(zip(tc.starts[-1][:-1], tc.starts[-1][1:])):
            part = products[lo:hi, l2:h2]
            assert part.size == 0 or (low[i, j] <= part.min() and part.max() <= high[i, j])
    assert (high < 0).any() and (low > 0).any()


def test_copies_are_left_out_before_the_shuffle(spark):
    df = spark.range(10).select(F.col("id"), F.lit(b"k").alias("key"))
    from pyspark.sql import Window

    plan = df.withColumn("rank", F.dense_rank().over(Window.partitionBy("key").orderBy("id"))).filter("rank <= 6")._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_empty(spark):
    assert mined(spark, []) == []
