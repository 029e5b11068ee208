"""The driver's star-schema tables seen as instrument data: one definition for Spark and for the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionweave.session import read

#: View: tables it reads, select text that both engines run.
VIEWS: dict[str, tuple[str, str]] = {
    "peaks": ("lineitem", "SELECT CAST(l_suppkey AS INT) AS frame_id, CAST(l_partkey % 512 AS INT) AS scan, CAST(l_orderkey AS INT) AS tof, CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 9 END AS ms_type, CAST(l_suppkey AS DOUBLE) AS rt, CAST(l_partkey % 512 AS DOUBLE) / CAST(512 AS DOUBLE) AS mobility, l_extendedprice / CAST(100 AS DOUBLE) AS mz, l_quantity AS intensity FROM lineitem"),
    "frame_info": ("supplier", "SELECT CAST(s_suppkey AS INT) AS frame_id, CAST(s_suppkey AS DOUBLE) AS time, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 9 END AS ms_type FROM supplier"),
    "dia_info": ("supplier", "SELECT CAST(s_suppkey AS INT) AS frame_id, CAST(s_suppkey % 5 AS INT) AS window_group FROM supplier WHERE s_suppkey % 3 = 2"),
    "windows": ("nation", "SELECT CAST(n_regionkey AS INT) AS window_group, CAST(n_nationkey AS INT) AS row_order, CAST(n_nationkey * 20 AS INT) AS scan_begin, CAST(n_nationkey * 20 + CASE WHEN n_nationkey % 2 = 0 THEN 119 ELSE 39 END AS INT) AS scan_end, CAST(50 + n_nationkey * 40 AS DOUBLE) AS isolation_mz, CAST(60 AS DOUBLE) AS isolation_width, CAST(20 + n_nationkey AS DOUBLE) AS collision_energy FROM nation"),
    "pasef": ("customer", "SELECT c_custkey AS precursor_id, CAST(c_custkey % 10 AS INT) AS frame_id, CAST((c_custkey * 7) % 480 AS INT) AS scan_begin, CAST((c_custkey * 7) % 480 + 25 AS INT) AS scan_end, CAST(c_nationkey + 20 AS DOUBLE) AS collision_energy FROM customer"),
    "ms1": ("orders", "SELECT o_orderkey AS cluster_id, CAST(o_orderkey % 5 AS INT) AS window_group, CAST(o_orderkey % 2400 AS INT) AS rt_lo, CAST(o_orderkey % 2400 + 2 + o_orderkey % 4 AS INT) AS rt_hi, CAST(o_custkey % 500 AS INT) AS im_lo, CAST(o_custkey % 500 + 12 AS INT) AS im_hi, o_totalprice / CAST(500 AS DOUBLE) AS mz, o_totalprice AS raw_sum FROM orders"),
    "ms2": ("lineitem", "SELECT l_orderkey * 10 + l_linenumber AS cluster_id, CAST(l_suppkey % 5 AS INT) AS window_group, CAST(l_partkey % 2400 AS INT) AS rt_lo, CAST(l_partkey % 2400 + 3 AS INT) AS rt_hi, CAST(l_orderkey % 500 AS INT) AS im_lo, CAST(l_orderkey % 500 + 8 AS INT) AS im_hi, l_extendedprice / CAST(100 AS DOUBLE) AS mz, l_quantity AS raw_sum FROM lineitem"),
    "traces": ("events", "SELECT event_id, user_id AS trace_id, ts, value AS intensity, CASE WHEN event_type IN ('purchase','signup') THEN 1 ELSE 2 END AS ms_level FROM events"),
    "truth": ("orders", "SELECT o_orderkey AS seq_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS charge, o_totalprice AS intensity FROM orders"),
    "report": ("lineitem", "SELECT l_orderkey AS seq_id, CAST(l_linenumber % 5 + 1 AS INT) AS charge, l_extendedprice AS intensity, l_discount AS q FROM lineitem"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its select text is run over the table it reads."""
    table, text = VIEWS[name]
    return spark.sql(text.replace(f"FROM {table}", "FROM {source}"), source=read(spark, sf_dir, table))


def with_views(names: str, body: str) -> str:
    """SQL text with the named views as common table expressions ``v_name`` before ``body``."""
    parts = [f"v_{n} AS ({VIEWS[n][1]})" for n in names.split()]
    if not parts:
        return body
    body = body.strip()
    rest = f", {body[5:]}" if body[:5].upper() == "WITH " else f" {body}"
    return "WITH " + ", ".join(parts) + rest
