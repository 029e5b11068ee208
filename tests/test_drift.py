from __future__ import annotations

import json
from datetime import datetime, timedelta

from ionweave.operators import drift as D

FILES = "file_id long, export_table string, producer string, written_at timestamp_ntz, file_format string, header_line string, extra int"
ROWS = "file_id long, line_no int, record_no long, payload string, file_format string"


def tables(spark, series):
    """series: (format, [records by record_no or (header, {record_no: line})])."""
    files, rows, n = [], [], 0
    for producer, (fmt, states) in series.items():
        for state in states:
            n += 1
            header, recs = state if fmt == "tsv" else (None, state)
            files.append((n, "peptides", producer, datetime(2031, 1, 1) + timedelta(days=n), fmt, header, 1))
            rows += [(n, i, r, p if fmt == "tsv" or isinstance(p, (str, type(None))) else json.dumps(p), "x") for i, (r, p) in enumerate(recs.items())]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(rows, ROWS)


def changes(spark, series):
    files, rows = tables(spark, series)
    return sorted((r["file_id"], r["change_kind"], r["field_name"]) for r in D.changes(files, D.tagged_values(files, rows)).collect())


def test_json_changes(spark):
    states = [
        {1: {"a": 1, "b": "x", "c": True}, 2: {"a": 2, "b": "y", "c": False}},
        {2: {"a": 2.0, "B": "y", "c": False, "d": None}, 3: {"a": 3.5, "B": "z", "c": True}},
        {3: {"a": 3.5, "B": ["z"], "e": {"k": 1}}, 4: {"a": 4.5, "B": ["w"], "e": {"k": 2}}},
    ]
    assert changes(spark, {"p": ("json", states)}) == [(2, "added", "d"), (2, "renamed", "B"), (2, "retyped", "a"), (3, "added", "e"), (3, "removed", "c"), (3, "removed", "d"), (3, "retyped", "B")]


def test_delimited_changes_and_missing_values(spark):
    states = [
        ("id\tx\tflag", {1: "1\t2.5\tTrue", 2: "2\tNA\tFalse"}),
        ("flag\tid\ty", {2: "False\t2\t", 3: "True\t3\t7.25"}),
        ("flag\tid\ty", {3: "1\t3\t7.25", 4: "0\t4\t"}),
    ]
    assert changes(spark, {"p": ("tsv", states)}) == [(2, "renamed", "y"), (3, "retyped", "flag")]


def test_no_common_record_renames_nothing_and_series_are_apart(spark):
    assert changes(spark, {"p": ("json", [{1: {"a": 1}}, {2: {"b": 1}}]), "q": ("json", [{1: {"z": 1}}])}) == [(2, "added", "b"), (2, "removed", "a")]


def test_broken_payloads_empty_files_and_repeated_lines(spark):
    files, rows = tables(spark, {"p": ("json", [{1: {"a": 1}, 2: "{broken", 3: None}, {1: {"b": 1}}])})
    rows = rows.unionByName(rows)
    got = sorted((r["file_id"], r["change_kind"], r["field_name"]) for r in D.changes(files, D.tagged_values(files, rows)).collect())
    assert got == [(2, "renamed", "b")]
    none = rows.limit(0)
    assert D.changes(files, D.tagged_values(files, none)).count() == 0


def test_one_table_with_typed_branches(spark):
    files, rows = tables(spark, {"p": ("json", [{1: {"seq": "AA", "n": 1}}, {1: {"Sequence": "AA", "n": 1.5}, 2: {"Sequence": "CC", "n": "many"}}])})
    tagged = D.tagged_values(files, rows)
    moved = D.changes(files, tagged).where("change_kind = 'renamed'").selectExpr("file_id", "old_name", "field_name as new_name")
    t = D.fused_table(files, tagged, moved, "peptides", {"sequence": "string", "n": "int"}).orderBy("file_id", "line_no").collect()
    assert [r["sequence"]["canonical"] for r in t] == ["AA", "AA", "CC"]
    assert [(r["n"]["tag"], r["n"]["as_integer"], r["n"]["as_decimal"], r["n"]["as_text"]) for r in t] == [("integer", 1, 1.0, None), ("decimal", None, 1.5, None), ("text", None, None, "many")]


def test_fused_tags(spark):
    files, rows = tables(spark, {"p": ("json", [{1: {"a": 1, "b": 1, "c": None}, 2: {"a": 2.5, "b": "x", "c": ""}}])})
    fused = {r["name"]: r["fused"] for r in D.fuse(D.tagged_values(files, rows)).collect()}
    assert fused == {"a": "decimal", "b": "integer|text", "c": None}


def test_nothing_is_lost_silently(spark):
    files, rows = tables(spark, {"p": ("json", [{1: {"Seq": "AA", "seq": "CC"}, 2: "{broken", 3: {"seq": None}, 4: {}}]), "q": ("tsv", [("seq\tn", {5: "DD\t1\tmore", 6: "EE"})])})
    rows = rows.unionByName(spark.createDataFrame([(99, 0, 7, "x", "x")], ROWS))
    assert sorted((r["record_no"], r["reason"]) for r in D.unread(files, rows).collect()) == [(2, "json"), (5, "surplus"), (6, "short"), (7, "file")]
    tagged = D.tagged_values(files, rows)
    none = spark.createDataFrame([], "file_id long, old_name string, new_name string")
    t = {r["record_no"]: r["seq"] for r in D.fused_table(files, tagged, none, "peptides", {"seq": "string"}).collect()}
    assert set(t) == {1, 3, 4, 5, 6} and t[3] is None and t[4] is None
    assert t[1]["canonical"] == "CC" and [tuple(o) for o in t[1]["others"]] == [("Seq", "AA")]


def test_a_producers_renames_are_its_own():
    names = [("a", "rt", 1), ("a", "time", 1), ("b", "mz", 1), ("b", "time", 1), ("c", "Extra", 2), ("d", "extra", 1), ("e", "rt", 1), ("e", "x", 1), ("e", "mz", 1)]
    got = D.canonical_names(names, [("a", "rt", "time"), ("b", "mz", "time"), ("e", "rt", "x"), ("e", "x", "mz")], ["rt", "mz"])
    assert got["a", "time"] == "rt" and got["b", "time"] == "mz" and got["e", "rt"] == "rt" and got["e", "mz"] == "mz" and got["e", "x"] == "x"
    assert got["c", "Extra"] == got["d", "extra"] == "Extra"


def test_fields_called_as_the_records_own_columns(spark):
    files, rows = tables(spark, {"p": ("json", [{1: {"file_id": 5, "Weight": 1}}]), "q": ("json", [{2: {"weight": 2, "WEIGHT ": 3}}])})
    none = spark.createDataFrame([], "file_id long, old_name string, new_name string")
    t = {r["record_no"]: r.asDict(True) for r in D.fused_table(files, D.tagged_values(files, rows), none, "peptides", {"seq": "string"}).collect()}
    assert t[1]["file_id_value"]["as_integer"] == 5 and t[1]["file_id"] == 1 and t[1]["seq"] is None
    name = next(k for k in t[1] if k.strip().lower() == "weight")
    assert t[1][name]["as_integer"] == 1 and sorted([t[2][name]["canonical"], t[2][name]["others"][0]["canonical"]]) == ["2", "3"]
