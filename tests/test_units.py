from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.functions import quantities as Q
from ionweave.operators import units as U


@pytest.mark.parametrize(
    ("text", "value", "unit", "seconds"),
    [
        ("22,089 min", 22.089, "min", 1325.34), ("RT=13.710'", 13.71, "min", 822.6), ("1 527 660 ms", 1527660.0, "ms", 1527.66), ("1.234,5 s", 1234.5, "s", 1234.5), ("0,05405 Std.", 0.05405, "h", 194.58),
        ("00:14:39.66", None, "clock", 879.66), ("16:44.76", None, "clock", 1004.76), ("PT1H2M3.5S", None, "clock", 3723.5), ("PT", None, None, None), ("921.60", 921.6, None, None), ("n/a", None, None, None), ("-", None, None, None),
        ("", None, None, None), (None, None, None, None), ("1,234,567 msec", 1234567.0, "ms", 1234.567), ("5 parsecs", None, None, None), ("1e3 sec", 1000.0, "s", 1000.0),
    ],
)
def test_parse(spark, text, value, unit, seconds):
    r = Q.parse_times(spark.createDataFrame([(text, 1)], "x string, _t int").select("x"), "x").first()
    assert (r["value"], r["unit"]) == (value, unit)
    assert r["seconds"] == (None if seconds is None else pytest.approx(seconds))


def test_notes(spark):
    notes = {"RT [ms]": "ms", "24 h wash after carry-over": None, "retention times are minutes": "min", "Zeiten (RT) in Sekunden": "s", "temps de rétention en heures": "h", "60 min gradient, new trap column": None, "times as written by the instrument": None, "RT drifts by 2 min": None, "RT [s]": "s", "all RT values exported as decimal minutes": "min"}
    df = spark.createDataFrame([(k,) for k in notes], "n string")
    assert {r["n"]: r["u"] for r in df.select("n", Q.stated_unit(F.col("n")).alias("u")).collect()} == notes


def test_pelt_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = rng.integers(2, 11)
        x = rng.normal(0, 1, n) + np.repeat(rng.normal(0, 4, n), 1) * (rng.random(n) < 0.4)
        beta = 2.0

        def cost(a, b):
            return ((x[a:b] - x[a:b].mean()) ** 2).sum() + beta  # noqa: B023

        best = {0: (-beta, [])}
        for t in range(1, n + 1):
            best[t] = min((best[s][0] + cost(s, t), [*best[s][1], s]) for s in range(t))
        got = U.pelt(np.ones(n), x, x * x, beta)
        total = sum(cost(a, b) for a, b in zip(got, [*got[1:], n])) - beta
        assert total == pytest.approx(best[n][0])


def assign(spark, rows, sources, notes, **kw):
    t0 = datetime(2031, 1, 1)
    v = spark.createDataFrame([("h", i, s, None if d is None else t0 + timedelta(days=d), "s", x, u, None) for i, s, d, x, u in rows], "history string, row_id long, source_id int, loaded_at timestamp_ntz, own string, value double, unit string, seconds double")
    s = spark.createDataFrame(sources, "source_id int, low int, high int")
    n = spark.createDataFrame([(i, t0 + timedelta(days=d), u) for i, d, u in notes], "source_id int, valid_from timestamp_ntz, unit string")
    return {r["row_id"]: (r["unit_code"], r["rule"], r["seconds"]) for r in U.assign_units(v, s, n, **kw).collect()}


def test_rules(spark):
    rows = [(1, 1, 5, 600.0, None), (2, 1, 5, 10.0, None), (3, 1, 5, 0.2, None), (4, 1, 5, 600000.0, None), (5, 1, 5, 12.0, "min"), (6, 2, 1, 700.0, None), (7, 2, 20, 700.0, None), (8, None, 5, 9.0, None), (9, 1, None, 10.0, None), (10, 1, 5, None, None), (11, 1, 5, -3.0, None), (12, 3, 5, 1e9, None)]
    got = assign(spark, rows, [(1, 120, 1800), (2, 60, 10800), (3, 120, 1800)], [(2, 10, "s"), (2, 30, "min")])
    units = {k: v[0] for k, v in got.items()}
    assert units == {1: "s", 2: "min", 3: "h", 4: "ms", 5: "min", 6: "s", 7: "s", 8: "s", 9: "min", 10: None, 11: "s", 12: "s"}
    assert got[7][1] == "note" and got[2][2] == 600.0 and math.isclose(got[3][2], 720.0)


def test_segments_decide_between_units_that_both_fit(spark):
    rng = np.random.default_rng(2)
    first = [(i, 1, i * 0.1, float(rng.uniform(900, 3000)), None) for i in range(200)]
    minutes = [(200 + i, 1, 20 + i * 0.1, float(rng.uniform(15, 170)), None) for i in range(200)]
    got = assign(spark, first + minutes, [(1, 60, 10800)], [], max_bins=64)
    assert all(got[i][0] == "s" for i in range(200)) and all(got[i][0] == "min" for i in range(202, 400))
    both = [i for i in range(202, 400) if 60 <= minutes[i - 200][3] <= 180]
    assert both and all(got[i][1] == "segment" for i in both)


def test_one_segment_instead_of_the_search_gives_other_rows(spark):
    rows = [(i, 1, i * 0.1, 900.0 + i, None) for i in range(200)] + [(200 + i, 1, 20 + i * 0.1, 61.0 + i / 10, None) for i in range(100)]
    want = {i: ("s", "segment") if i < 200 else ("min", "segment") for i in range(300)}
    args = (rows, [(1, 60, 10800)], [])
    assert {k: v[:2] for k, v in assign(spark, *args).items()} == want
    assert {k: v[:2] for k, v in assign(spark, *args, search=lambda *_: [0]).items()} != want


def test_the_range_confirms_or_replaces_the_segment(spark):
    rows = [(i, 1, i * 0.1, 900.0 + i, None) for i in range(100)] + [(100, 1, 5.05, 20.0, None)]
    got = assign(spark, rows, [(1, 600, 1800)], [], max_bins=1)
    assert got[100][:2] == ("min", "range") and all(got[i][:2] == ("s", "segment") for i in range(100))


def test_empty(spark):
    assert assign(spark, [], [(1, 1, 2)], []) == {}
    assert assign(spark, [(1, 1, 1, 5.0, None)], [], []) == {1: ("s", "segment", 5.0)}
