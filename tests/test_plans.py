"""Queries without SQL against plain re-statements, and the package's independence."""

import subprocess
import sys
from datetime import datetime, timedelta

import numpy as np
import pytest

from spreadlake import catalog
from spreadlake.operators import ticks, validation

from .conftest import ROOT

SF = "/root/testdata/sf0.001"


def test_the_rest_does_not_need_the_corpus_package():
    code = "import sys; sys.modules['spreadlake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'trades' in e.queries() and not any(k.startswith('op') for k in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_hybrid_walk():
    """One long trade that ends by its z-exit, one that a dollar stop ends, and no second entry in one slow bar."""
    t0 = datetime(2024, 1, 3, 10)
    b = [100.0] * 8
    a = [100.0, 97.0, 97.5, 100.0, 97.0, 97.0, 90.0, 97.0]
    cfg = ticks.HybridConfig(entry=2.0, leave=0.5, stop=99.0, dollar_stop=5.0, mult_a=1.0, mult_b=1.0, slippage=0.0, commission=0.0)
    desk, made, number = ticks.HybridDesk(cfg), [], 0
    for i, bar in enumerate([1, 1, 1, 1, 1, 2, 2, 3]):
        if bar != number:
            number = bar
            desk.begin({"beta": 1.0, "alpha": 0.0, "mean": 0.0, "std": 0.01, "prev_z": 0.0, "gate": True, "number": bar, "end": None})
        made.append(desk.tick(t0 + timedelta(seconds=i), a[i], b[i], 600))
    got = [(m[0].second, m[1].second, m[2], m[11], m[-1]) for m in made if m]
    # after the exit at second 3 it cools down, until the next bar begins with |z before| inside its level
    assert got == [(1, 3, 1, 3.0, "TP_ZSCORE"), (5, 6, 1, -7.0, "SL_DOLLAR")]


def test_diverse_topk(spark):
    rows = [(0, 0, 1.0), (0, 1, 0.9), (1, 1, 0.5), (1, 0, 0.1)]
    df = spark.createDataFrame(rows, "a int, b int, score double")
    got = [(r["a"], r["b"]) for r in validation.diverse_topk(spark, df, ["a", "b"], "score", 3).orderBy("rank").collect()]
    left, chosen = [r for r in rows[1:]], [rows[0]]
    while len(chosen) < 3:
        best = max(left, key=lambda r: 0.6 * (r[2] - 0.1) / 0.9 + 0.4 * min(((r[0] != c[0]) + (r[1] != c[1])) / 2 for c in chosen))
        left.remove(best)
        chosen.append(best)
    assert got == [(r[0], r[1]) for r in chosen]


def test_greedy_match_is_one_to_one(spark):
    got = catalog.queries()["greedy_match"](spark, SF).toPandas()
    assert len(got) and got["entry_bar"].is_unique and got["other"].is_unique and (np.abs(got["entry_bar"] - got["other"]) <= 2).all()


@pytest.mark.parametrize("name", ["adf_full", "hybrid_ticks", "diverse_topk"])
def test_queries_without_sql_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() >= 0
