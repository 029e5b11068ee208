from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ionweave.functions import peptidoform as P
from ionweave.llm import survivor as S

MODS = [(4, "Carbamidomethyl", "C", 57.021464), (7, "Deamidated", "NQ", 0.984016), (21, "Phospho", "STY", 79.966331), (34, "Methyl", "R", 14.01565), (35, "Oxidation", "M", 15.994915), (121, "GG", "K", 114.042927)]


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("PEPC[UNIMOD:4]K", "PEPC[UNIMOD:4]K"), ("_PEPC(UniMod:4)K_.2", "PEPC[UNIMOD:4]K"), (" PEPC(carbamidomethyl)K ", "PEPC[UNIMOD:4]K"), ("_PEPC[Carbamidomethyl (C)]K_", "PEPC[UNIMOD:4]K"), ("PEPC[+57]K/3", "PEPC[UNIMOD:4]K"),
        ("PEPC[+57.0215]K", "PEPC[UNIMOD:4]K"), ("K.PEPS[Phospho]K.S", "PEPS[UNIMOD:21]K"), ("-.AAK[+114.04].-", "AAK[UNIMOD:121]"), ("AN[+1]Q[+0.98]M[+16]", "AN[UNIMOD:7]Q[UNIMOD:7]M[UNIMOD:35]"), ("AT[Phospho (STY)]R[+14.02]", "AT[UNIMOD:21]R[UNIMOD:34]"),
        ("PEPBK", None), ("", None), (None, None), ("PEP[+57]K", None), ("A/K", None),
    ],
)
def test_notations(spark, text, form):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(P.canonical(F.col("s"), MODS)).first()[0] == form


def test_charges(spark):
    cases = [("A", "2", 2), ("A", " 3", 3), ("A", "2+", 2), ("A", "+4", 4), ("A", "z=2", 2), ("A", "2.0", 2), ("_A_.3", None, 3), ("A/4", "", 4), ("A/4", "2", 2), ("A", "x", None), (None, None, None)]
    df = spark.createDataFrame([(i, s, c) for i, (s, c, _) in enumerate(cases)], "i int, s string, c string")
    got = {r[0]: r[1] for r in df.select("i", P.written_charge(F.col("s"), F.col("c"))).collect()}
    assert [got[i] for i in range(len(cases))] == [z for _, _, z in cases]


def make(spark, rows):
    t0 = datetime(2031, 1, 1)
    return spark.createDataFrame([(i, k, t, None if d is None else t0 + timedelta(days=d), v, "clash", 1) for i, k, t, d, v in rows], "id long, k string, trust int, at timestamp_ntz, v double, n_records string, vote int")


def wide(spark, rows, **kw):
    fields = {"v": (F.col("v").isNotNull() & (F.col("v") > 0), F.col("v"))}
    return {r["k"]: r for r in S.survivors(make(spark, rows), ["k"], "id", "trust", "at", fields, **kw).collect()}


def test_order_of_records(spark):
    rows = [(1, "a", 1, 9, 5.0), (2, "a", 5, 1, 6.0), (3, "a", 5, 2, -1.0), (4, "a", 5, 1, 7.0), (5, "b", 1, 1, None), (6, "b", 1, 2, None), (7, "c", 1, 1, 1.0), (8, None, 1, 1, 1.0), (9, None, 1, 1, 1.0), (10, "d", None, None, 2.0), (11, "d", None, None, 2.0)]
    got = wide(spark, rows)
    assert set(got) == {"a", "b", "d"}
    assert (got["a"]["group_id"], got["a"]["n_records"], got["a"]["v_id"], got["a"]["v"]) == (1, 4, 2, "6.0")
    assert got["b"]["v_id"] is None and got["d"]["v_id"] == 10
    long = S.field_sources(S.survivors(make(spark, rows), ["k"], "id", "trust", "at", {"v": (F.col("v") > 0, F.col("v"))}), ["v"])
    assert sorted(tuple(r) for r in long.collect()) == [(1, "v", 2), (10, "v", 10)]


def test_votes_sum_over_equal_values(spark):
    rows = [(1, "a", 4, 10, 5.0), (2, "a", 3, 10, 6.0), (3, "a", 3, 10, 6.0)]
    assert wide(spark, rows, policy="votes")["a"]["v_id"] == 2
    assert wide(spark, rows)["a"]["v_id"] == 1
    old = [(1, "a", 4, 0, 5.0), (2, "a", 3, 400, 6.0)]
    assert wide(spark, old, policy="votes")["a"]["v_id"] == 2


def test_empty(spark):
    assert wide(spark, []) == {}
