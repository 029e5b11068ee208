"""Streaming twins, run over what is there; each must equal its batch form. Names begin with the operator's inventory number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.plans.registry import Registry, Views
from ionweave.streaming import windows as S

R = Registry()
#: Longer than any delay in the data, so that nothing is dropped as late.
LATE = "36500 days"


def _events(v: Views) -> DataFrame:
    return S.read_stream(v.spark, f"{v.sf_dir}/events.parquet").select("user_id", "ts", "event_type", F.col("value").alias("intensity"))


def _micros(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.unix_micros(n) for n in names})


R.add("i372_tumbling", lambda v: _micros(S.run_available(S.tumbling(_events(v), "1 hour", LATE, "event_type"), "complete"), "start", "end").withColumn("intensity", F.round("intensity").cast("long")).select("event_type", "start", "end", "n"), "SELECT event_type, epoch_us(s) AS start, epoch_us(s + INTERVAL 1 HOUR) AS \"end\", n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n FROM events GROUP BY ALL) x")
R.add("i372_sliding", lambda v: _micros(S.run_available(S.sliding(_events(v), "1 hour", "30 minutes", LATE, "event_type"), "complete"), "start", "end").select("event_type", "start", "end", "n"), "SELECT event_type, epoch_us(s) AS start, epoch_us(s + INTERVAL 1 HOUR) AS \"end\", count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS s FROM events) x GROUP BY ALL")
R.add("i373_sessions", lambda v: _micros(S.run_available(S.sessions(_events(v), "2 hours", LATE, "user_id"), "complete"), "start", "end").select("user_id", "start", "end", "n"), "SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 2 HOUR) AS \"end\", count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS brk FROM events) x) y GROUP BY user_id, s")
R.add("i374_exclusion", lambda v: _micros(S.run_available(S.exclude_repeats(_events(v), "user_id", 6 * 3600.0)), "ts"))
R.add("i375_watermark", lambda v: S.run_available(S.tumbling(_events(v), "1 day", "1 hour"), "append").select(F.sum("n").cast("long").alias("n")), None)


def _lazy_frames(v: Views) -> DataFrame:
    """Frame batches summed one after the other and put together again."""
    out = None
    for part in S.batches(v.peaks, "frame_id", 512):
        s = part.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity"))
        out = s if out is None else out.unionByName(s)
    return out


R.add("i366_lazy_batches", _lazy_frames, "SELECT frame_id, count(*) AS n, sum(intensity) AS intensity FROM v_peaks GROUP BY frame_id", "peaks")

QUERIES, ORACLES = R.queries, R.oracles
