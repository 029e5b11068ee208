"""Best representative of each duplicate group: one surviving record, chosen field by field.

Fields are unpivoted to long rows, every usable value collects votes (trust of its source times recency decay) per
normalised value, the winner of each field is taken by max_by and the winners are pivoted back to one row a group. Where
single records are ranked instead of values, the same winners come from one aggregation.

All steps are aggregations with partial results, so a group with a third of all rows never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days after which a vote counts half.
HALF_LIFE_DAYS = 180.0
_EPOCH_DAYS = 20_000.0


def vote(trust: Column, loaded_at: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Trust times decay; only ratios matter, so the decay is counted from a fixed day."""
    days = F.unix_micros(loaded_at.cast("timestamp")) / F.lit(86_400e6) - F.lit(_EPOCH_DAYS)
    return F.coalesce(trust.cast("double"), F.lit(0.0)) * F.pow(F.lit(2.0), F.coalesce(days, F.lit(-1e3)) / F.lit(half_life))


def survivors(df: DataFrame, keys: list[str], ident: str, trust: str, loaded_at: str, fields: dict[str, tuple[Column, Column]], *, policy: str = "record", half_life: float = HALF_LIFE_DAYS, least: int = 2) -> DataFrame:
    """One row per group of at least ``least`` records: ``keys, group_id, n_records`` and per field F ``F, F_id``.

    ``fields`` maps a field to its usability condition and its normalised value (both over ``df``). ``F_id`` is the
    record that gives the field and ``F`` its value; both null where no record is usable. Policy ``record`` takes the
    record of highest trust, then latest load, then smallest identifier: an order of single records, which no sum of votes
    expresses, so nothing is unpivoted and every field is a ``max_by`` of one aggregation. Policy ``votes`` takes the
    value with most votes first, and that order among its records; ``F_votes`` are the votes for it. A null trust or load time
    ranks last. Rows with a null key or identifier belong to no group. Repeated rows of one identifier count once
    for ``group_id`` but each in ``n_records``.
    """
    if policy not in ("record", "votes"):
        raise ValueError(policy)
    k = [F.col(c).alias(f"k{j}") for j, c in enumerate(keys)]
    kn = [f"k{j}" for j in range(len(keys))]
    order = F.struct(F.coalesce(F.col(trust).cast("double"), F.lit(float("-inf"))).alias("t"), F.coalesce(F.unix_micros(F.col(loaded_at).cast("timestamp")), F.lit(-(2**62))).alias("l"), (-F.col(ident)).alias("i"))
    known = df.where(" and ".join(f"`{c}` is not null" for c in [*keys, ident]))
    out = [F.col(f"k{j}").alias(c) for j, c in enumerate(keys)] + ["group_id", "n_records"]
    if policy == "record":
        flat = known.select(*k, order.alias("rank"), *[x for j, (usable, value) in enumerate(fields.values()) for x in (F.coalesce(usable, F.lit(False)).alias(f"u{j}"), value.cast("string").alias(f"v{j}"))])
        aggs = [(-F.max("rank.i")).alias("group_id"), F.count(F.lit(1)).alias("n_records")]
        for j, name in enumerate(fields):  # apart, so that values nobody reads are not carried
            best = F.when(F.col(f"u{j}"), F.col("rank"))
            aggs += [F.max_by(F.col(f"v{j}"), best).alias(name), (-F.max_by(F.col("rank.i"), best)).alias(f"{name}_id")]
        wide = flat.groupBy(*kn).agg(*aggs).where(F.col("n_records") >= least)
        return wide.select(*out, *[x for name in fields for x in (name, f"{name}_id")])
    members = F.struct(F.lit("").alias("field"), F.lit(True).alias("usable"), F.lit("").alias("value"))
    long = known.select(
        *k, order.alias("rank"), vote(F.col(trust), F.col(loaded_at), half_life).alias("vote"),
        F.explode(F.array(members, *[F.struct(F.lit(name).alias("field"), F.coalesce(usable, F.lit(False)).alias("usable"), value.cast("string").alias("value")) for name, (usable, value) in fields.items()])).alias("x"),
    ).select(*kn, "rank", "vote", "x.field", "x.usable", "x.value").where("usable")
    values = long.groupBy(*kn, "field", "value").agg(F.sum("vote").alias("votes"), F.max("rank").alias("rank"), F.max("rank.i").alias("least_id"), F.count(F.lit(1)).alias("n"))
    best = F.struct("votes", "rank")
    pivot = [F.min(F.when(F.col("field") == "", -F.col("least_id"))).alias("group_id"), F.sum(F.when(F.col("field") == "", F.col("n"))).alias("n_records")]
    for name in fields:
        pivot.append(F.max_by(F.when(F.col("field") == name, F.struct("value", "rank.i", "votes")), F.when(F.col("field") == name, best)).alias(f"f_{name}"))
    wide = values.groupBy(*kn).agg(*pivot).where(F.col("n_records") >= least)
    for name in fields:
        out += [F.col(f"f_{name}.value").alias(name), (-F.col(f"f_{name}.i")).alias(f"{name}_id"), F.col(f"f_{name}.votes").alias(f"{name}_votes")]
    return wide.select(*out)


def field_sources(wide: DataFrame, fields: list[str]) -> DataFrame:
    """Long form ``group_id, field_name, finding_id`` of the records that give each field; no row where none does."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_id").alias("finding_id")) for f in fields])).alias("x")
    return wide.select("group_id", pairs).select("group_id", "x.field_name", "x.finding_id").where("finding_id is not null")
