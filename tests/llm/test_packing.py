from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from ionweave.llm import packing as K


def run(spark, sizes, capacity, **kw):
    df = spark.createDataFrame([(i, n, "clash") for i, n in sizes], "id long, n long, container string")
    return [tuple(r) for r in K.pack(df, "id", "n", capacity, **kw).collect()]


def check(rows, sizes, capacity):
    pieces, load, said = defaultdict(list), Counter(), {}
    for item, piece, start, size, container, total in rows:
        pieces[item].append((piece, start, size))
        if container is not None:
            load[container] += size
            said[container] = total
    want = {i: n for i, n in sizes if i is not None and n is not None and n >= 0}
    assert set(pieces) == set(want)
    for i, n in want.items():
        ps = sorted(pieces[i])
        assert sum(s for _, _, s in ps) == n and [p for p, _, _ in ps] == list(range(len(ps)))
        assert len(ps) == 1 or n > capacity
        at = 0
        for _, start, s in ps:
            assert start == at
            at += s
    assert all(v <= capacity for v in load.values()) and load == Counter(said)
    return sum(load.values()) / (len(load) * capacity) if load else 1.0


def test_invariants_and_fill(spark):
    rnd = random.Random(5)
    sizes = [(i, rnd.choice([0, 1, 100, 250, rnd.randrange(400), 999, 100_000 if i % 500 == 0 else 7])) for i in range(3000)]
    assert check(run(spark, sizes, 100, partitions=5), sizes, 100) > 0.97
    assert check(run(spark, sizes, 1000, partitions=70), sizes, 1000) > 0.97


def test_same_result_whatever_the_order(spark):
    rnd = random.Random(6)
    sizes = [(i, rnd.randrange(1, 90)) for i in range(500)]
    a = sorted(run(spark, sizes, 100, partitions=3))
    rnd.shuffle(sizes)
    assert a == sorted(run(spark, sizes, 100, partitions=3))


def test_edges(spark):
    sizes = [(1, 0), (2, 10), (3, 20), (4, 21), (None, 5), (6, None), (7, -3)]
    rows = run(spark, sizes, 10)
    check(rows, sizes, 10)
    assert run(spark, [], 10) == []
    with pytest.raises(ValueError):
        run(spark, [(1, 1)], 0)


def test_bounded_state():
    p, most = K.Packer(100, 4), 0
    rnd = random.Random(7)
    for i in range(2000):
        p.put(rnd.randrange(1, 100), i)
        most = max(most, len(p.free))
    assert most <= 4


def test_report(spark):
    df = spark.createDataFrame([(1, 15), (2, 5)], "id long, n long")
    r = K.fill_report(K.pack(df, "id", "n", 10), 10).first()
    assert (r["n_containers"], r["n_pieces"], r["n_split"], r["total_size"], r["fill"]) == (2, 3, 1, 20, 1.0)
