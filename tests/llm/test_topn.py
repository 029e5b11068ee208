from __future__ import annotations

import math
import random

from ionweave.llm.topn import top_n

SCHEMA = "g long, i long, s double, rank_no string, x int"


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best.setdefault(g, {})
            best[g][i] = max(s, best[g].get(i, -math.inf))
    return sorted((g, i, s, k + 1) for g, by in best.items() for k, (i, s) in enumerate(sorted(by.items(), key=lambda x: (-x[1], x[0]))[:n]))


def run(spark, rows, n, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return sorted((r["g"], r["i"], r["s"], r["rank_no"]) for r in top_n(df, "g", "s", "i", n, **kw).collect())


def test_ties_repeats_nulls_and_nan(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 5, 2.0), (1, 4, 2.0), (1, 4, 2.0), (1, 3, 1.0), (1, 2, nan), (1, 1, None), (None, 1, 9.0), (1, None, 9.0), (2, 7, inf), (2, 8, -inf), (3, 1, nan)]
    assert run(spark, rows, 2) == brute(rows, 2) == [(1, 4, 2.0, 1), (1, 5, 2.0, 2), (2, 7, inf, 1), (2, 8, -inf, 2)]


def test_hot_group_and_small_heaps(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, rnd.randrange(50)]), rnd.randrange(400), float(rnd.randrange(20))) for _ in range(5000)]
    assert run(spark, rows, 3, buffer_rows=64, state_rows=40) == brute(rows, 3)


def test_empty(spark):
    assert run(spark, [], 3) == []
