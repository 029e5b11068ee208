from __future__ import annotations

import random
from datetime import datetime, timedelta

from ionweave.operators import orphans as O

T0 = datetime(2031, 1, 1)
PARENT = "id long, loaded_at timestamp_ntz, deleted_at timestamp_ntz, k string"
REF = "row_id long, ref long, loaded_at timestamp_ntz, k int"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def found(spark, refs, parents, **kw):
    r = spark.createDataFrame([(i, k, day(t), 0) for i, k, t in refs], REF)
    p = spark.createDataFrame([(k, day(a), day(b), "x") for k, a, b in parents], PARENT)
    out = O.orphans(r, p, row_id="row_id", ref_key="ref", parent_key="id", parent_deleted="deleted_at", **kw)
    return sorted((x["row_id"], x["reason"]) for x in out.collect())


def brute(refs, parents):
    out = []
    for i, k, t in refs:
        if k is None:
            continue
        own = [(a, b) for q, a, b in parents if q == k]
        if not own:
            out.append((i, "missing"))
        elif t is None or all(a is None for a, _ in own):
            out.append((i, "late"))
        elif any(a is not None and a <= t and (b is None or b > t) for a, b in own):
            continue
        else:
            out.append((i, "deleted" if any(a is not None and a <= t for a, _ in own) else "late"))
    return sorted(out)


def test_reasons(spark):
    parents = [(1, 0, None), (2, 0, 5), (3, 9, None), (4, None, None), (None, 0, None), (6, 0, 3), (6, 7, None)]
    refs = [(1, 1, 1), (2, 2, 4), (3, 2, 5), (4, 3, 8), (5, 5, 1), (6, None, 1), (7, 4, 1), (8, 1, None), (9, 6, 4), (10, 6, 8), (11, 6, 2), (12, 1, 0)]
    assert found(spark, refs, parents) == brute(refs, parents)


def test_random_against_brute_force_with_hot_keys_and_small_blocks(spark):
    rnd = random.Random(3)
    parents = [(rnd.choice([7, *range(-40, 40)]), rnd.randrange(20), rnd.choice([None, rnd.randrange(30)])) for _ in range(120)]
    refs = [(i, rnd.choice([None, 7, 7, 7, *range(-50, 50)]), rnd.randrange(25)) for i in range(600)]
    assert found(spark, refs, parents, block=8, hot_share=0.05) == brute(refs, parents)


def test_empty_tables_and_repeated_rows(spark):
    assert found(spark, [], [(1, 0, None)]) == []
    assert found(spark, [(1, 1, 1), (1, 1, 1)], []) == [(1, "missing"), (1, "missing")]


def test_runs_are_cut_at_blocks(spark):
    keys = spark.createDataFrame([(k,) for k in [1, 2, 3, 3, 6, 7, 8, 9, None]], "id long")
    runs = sorted((r["run_start"], r["run_end"], r["n_keys"]) for r in O.key_runs(keys, "id", 8).collect())
    assert runs == [(1, 3, 3), (6, 7, 2), (8, 9, 2)]
