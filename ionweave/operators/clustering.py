"""Density clustering and connected components by iterated aggregations, and a Gaussian mixture."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionweave.session import materialise


def connected_components(nodes: DataFrame, edges: DataFrame, ident: str = "id", rounds: int = 50) -> DataFrame:
    """``id, component`` (the smallest id in it) of undirected edges ``a, b``.

    Large star and small star alternate, each one aggregation over edges; the number of rounds grows with the logarithm of
    the longest path. Lineage is cut by a written table each round.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    e, last = materialise(e, "edges"), None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("mb")).select("a", F.least("a", "mb").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").select(F.least("m", "a").alias("x"), "a", "b", "m")
        nxt = small.select(F.col("m").alias("a"), "b").unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        nxt = materialise(nxt, "edges")
        mark = nxt.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        e = nxt
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    return nodes.select(F.col(ident).alias("id")).join(e.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "id"), "id", "left").select("id", F.coalesce("m", "id").alias("component"))


def dbscan(points: DataFrame, axes: list[str], eps: float, min_points: int, ident: str = "id", levels: int = 3) -> DataFrame:
    """``id, cluster, core``: cluster is the smallest core id in it, -1 for noise; a border point goes to the cluster with the
    smallest id among its core neighbours. A point counts as its own neighbour.

    Cells have a diagonal of ``eps``, so all points of a cell are neighbours. A cell with ``min_points`` points is dense: its points are core and of one cluster,
    without any pair being formed. Distances are measured only between points of which one lies in a cell that is not dense (at most ``min_points`` times the cells about
    it for each point), and between two dense cells as far as boxes do not decide: cells are halved ``levels`` times, pairs whose boxes lie apart fall away, pairs whose
    boxes lie wholly within ``eps`` are linked, and only the points of the small boxes still open are compared.
    """
    side, reach = eps / math.sqrt(len(axes)), math.ceil(math.sqrt(len(axes)))
    keys = [f"_{a}" for a in axes]
    cells = points.select(F.col(ident).alias("id"), *axes, *[F.floor(F.col(a) / side).cast("long").alias(f"_{a}") for a in axes])
    full = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points).select(*keys, F.lit(True).alias("_full"))
    cells = materialise(cells.join(full, keys, "left").withColumn("_full", F.coalesce("_full", F.lit(False))), "cells")
    thin = cells.where("not _full")

    def about(df: DataFrame) -> DataFrame:
        for k in keys:
            df = df.withColumn(k, F.explode(F.array(*[F.col(k) + d for d in range(-reach, reach + 1)])))
        return df

    two = lambda df, *more: df.select(F.col("id").alias("id2"), *[F.col(a).alias(f"{a}2") for a in axes], *keys, *more)
    d2 = sum(((F.col(a) - F.col(f"{a}2")) * (F.col(a) - F.col(f"{a}2")) for a in axes), F.lit(0.0))
    near = materialise(about(thin.select("id", *axes, *keys)).join(two(cells, "_full"), keys).where(d2 <= eps * eps).select("id", "id2", F.col("_full").alias("full2")), "pairs")  # of thin points with all
    core = near.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select("id")
    core = materialise(core.unionByName(cells.where("_full").select("id")), "core")
    heads = cells.where("_full").groupBy(*keys).agg(F.min("id").alias("head"))
    links = [
        cells.where("_full").join(heads, keys).select(F.col("head").alias("a"), F.col("id").alias("b")),
        near.join(core, "id", "left_semi").join(core.withColumnRenamed("id", "id2"), "id2", "left_semi").select(F.col("id").alias("a"), F.col("id2").alias("b")),
        _dense_links(cells.where("_full"), heads, axes, side, reach, eps, levels),
    ]
    comp = connected_components(core, links[0].unionByName(links[1]).unionByName(links[2]))
    border = near.join(comp.withColumnRenamed("id", "id2"), "id2").groupBy("id").agg(F.min("component").alias("near"))
    out = points.select(F.col(ident).alias("id")).join(comp, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("component", "near", F.lit(-1)).cast("long").alias("cluster"), F.col("component").isNotNull().alias("core"))


def _dense_links(dense: DataFrame, heads: DataFrame, axes: list[str], side: float, reach: int, eps: float, levels: int) -> DataFrame:
    """``a, b``: heads of dense cells with points within ``eps`` of each other."""
    keys = [f"_{a}" for a in axes]
    p = dense.join(heads, keys)
    for lv in range(levels + 1):
        p = p.withColumn(f"n{lv}", F.concat_ws(",", *[F.floor(F.col(a) / (side / 2**lv)).cast("string") for a in axes]))
    box = lambda lv: p.groupBy("head", f"n{lv}", *([f"n{lv - 1}"] if lv else []), *(keys if not lv else [])).agg(*[f(a).alias(f"{t}_{a}") for a in axes for f, t in ((F.min, "lo"), (F.max, "hi"))])
    other = lambda df, lv: df.select(F.col("head").alias("head2"), F.col(f"n{lv}").alias("m"), *([F.col(f"n{lv - 1}").alias("q")] if lv else keys), *[F.col(f"{t}_{a}").alias(f"{t}2_{a}") for a in axes for t in ("lo", "hi")])
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo_{a}") - F.col(f"hi2_{a}"), F.col(f"lo2_{a}") - F.col(f"hi_{a}")), 2.0) for a in axes), F.lit(0.0))
    far = sum((F.pow(F.greatest(F.col(f"hi2_{a}") - F.col(f"lo_{a}"), F.col(f"hi_{a}") - F.col(f"lo2_{a}")), 2.0) for a in axes), F.lit(0.0))
    first = box(0)
    wide = first
    for k in keys:
        wide = wide.withColumn(k, F.explode(F.array(*[F.col(k) + d for d in range(-reach, reach + 1)])))
    sure, found = None, wide.join(other(first, 0), keys).where("head < head2")
    for lv in range(levels + 1):
        if lv:
            b = box(lv)
            found = left.join(b.withColumnRenamed(f"n{lv - 1}", "n"), ["head", "n"]).join(other(b, lv).withColumnRenamed("q", "m0"), ["head2", "m0"])
        found = materialise(found.where(gap <= eps * eps).select("head", "head2", F.col(f"n{lv}").alias("n"), "m", (far <= eps * eps).alias("ok")), "boxes")
        now = found.where("ok").select("head", "head2").distinct()
        sure = now if sure is None else sure.unionByName(now)
        left = found.where("not ok").join(sure, ["head", "head2"], "left_anti").select("head", "head2", "n", F.col("m").alias("m0"))
    a = p.select("head", F.col(f"n{levels}").alias("n"), *axes)
    b = p.select(F.col("head").alias("head2"), F.col(f"n{levels}").alias("m0"), *[F.col(x).alias(f"{x}2") for x in axes])
    d2 = sum(((F.col(x) - F.col(f"{x}2")) * (F.col(x) - F.col(f"{x}2")) for x in axes), F.lit(0.0))
    exact = left.join(a, ["head", "n"]).join(b, ["head2", "m0"]).where(d2 <= eps * eps).select("head", "head2").distinct()
    return sure.unionByName(exact).select(F.col("head").alias("a"), F.col("head2").alias("b"))


def gaussian_mixture(df: DataFrame, columns: list[str], k: int, seed: int = 7):
    """A fitted mixture of the ml library over plain columns, and the assembled rows."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    return GaussianMixture(k=k, seed=seed, maxIter=30).fit(rows), rows


def rescore(df: DataFrame, features: list[str], label: str, n_folds: int = 3, key: str = "id") -> DataFrame:
    """``key, score`` by logistic regression: each fold is scored by a model of the others."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    folded = df.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(n_folds)))
    stages = [VectorAssembler(inputCols=features, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_s", withMean=True), LogisticRegression(featuresCol="_s", labelCol=label, maxIter=20, regParam=1e-3)]
    out = None
    for i in range(n_folds):
        scored = Pipeline(stages=stages).fit(folded.where(F.col("_fold") != i)).transform(folded.where(F.col("_fold") == i)).select(key, vector_to_array("rawPrediction")[1].alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out
