"""Filling fixed-capacity containers with items of varying size.

Bounded-space online packing: each partition keeps a fixed number of open containers, puts every item into the fullest
one that still takes it (best fit), and sends the fullest container on when none does. What is still open at the end is
merged across partitions in further rounds of the same procedure. An item is split only if it exceeds the capacity: into
full containers of its own and a rest, which is packed like any item.

Scale: the state of a task is ``OPEN`` containers whatever the number of items. Only item sizes are shuffled. A round of
merging takes at most ``OPEN`` containers from each partition and ``FAN_IN`` partitions into one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionweave.session import materialise

#: Open containers per partition.
OPEN = 64
#: Partitions of leftovers that one task merges.
FAN_IN = 32
#: Items per partition of the first round.
ITEMS_PER_PARTITION = 20_000

_OUT = "item long, piece int, start long, size long, container string, closed boolean, load long"


class Packer:
    """Open containers ordered by free space; ``put`` returns a container that had to be closed, if any."""

    def __init__(self, capacity: int, open_limit: int):
        self.capacity, self.limit, self.free = capacity, open_limit, []  # (free space, number)
        self.items: dict[int, list] = {}
        self.next = 0

    def put(self, size: int, item) -> list | None:
        closed = None
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            room, number = self.free.pop(k)
            self.items[number].append(item)
        else:
            if len(self.free) >= self.limit:
                closed = self.items.pop(self.free.pop(0)[1])  # the fullest
            room, number = self.capacity, self.next
            self.next += 1
            self.items[number] = [item]
        if room == size:
            done = self.items.pop(number)
            return done if closed is None else [*closed, None, *done]
        insort(self.free, (room - size, number))
        return closed

    def rest(self) -> list[list]:
        return [self.items[n] for _, n in self.free]


def _pack(capacity: int, open_limit: int, last: bool):
    """Packs units (one or more rows with a common ``unit``) that arrive unit by unit."""
    names = [c.split()[0] for c in _OUT.split(", ")]

    def emit(out: list, members: list, label: str, closed: bool) -> None:
        rows = [r for unit in members for r in unit]
        load = sum(r[3] for r in rows)
        out += [(*r, label, closed, load) for r in rows]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, count, part, held, unit = Packer(capacity, open_limit), 0, None, [], None

        def close(out: list, members: list | None) -> None:
            nonlocal count
            group: list = []
            for m in [*(members or []), None]:
                if m is not None:
                    group.append(m)
                elif group:
                    count += 1
                    emit(out, group, f"{part}-{count}", True)
                    group = []

        out: list[tuple] = []
        for pdf in frames:
            for p, u, item, piece, start, size in zip(pdf["part"].tolist(), pdf["unit"].tolist(), pdf["item"].tolist(), pdf["piece"].tolist(), pdf["start"].tolist(), pdf["size"].tolist()):
                if part is None:
                    part = p
                if u != unit and held:
                    close(out, packer.put(sum(r[3] for r in held), held))
                    held = []
                unit = u
                held.append((item, piece, start, size))
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if held:
            close(out, packer.put(sum(r[3] for r in held), held))
        for members in packer.rest():
            count += 1
            emit(out, members, f"{part}-{count}", last)
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


def pack(items: DataFrame, item: str, size: str, capacity: int, *, open_limit: int = OPEN, partitions: int | None = None, n_items: int | None = None) -> DataFrame:
    """``item, piece, start, size, container, load``: each piece of each item with its container.

    Items have unique ids; those with a null id, or a null or negative size, are left out, and those of size 0 come out in no
    container (null). ``start`` is the offset of the piece in its item. Every container holds at most ``capacity``. The result depends
    on the items and the parameters only, not on their order.
    """
    if capacity < 1 or open_limit < 1:
        raise ValueError("capacity and open_limit must be at least 1")
    x = items.select(F.col(item).cast("long").alias("item"), F.col(size).cast("long").alias("n")).where("item is not null and n >= 0")
    x = materialise(x, "sizes")
    total = n_items if n_items is not None else x.count()
    parts = partitions or max(1, -(-total // ITEMS_PER_PARTITION))
    empty = x.where("n = 0").select("item", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("container"), F.lit(0).cast("long").alias("load"))
    full = F.floor(F.col("n") / capacity)
    whole = x.where(F.col("n") >= capacity).select("item", F.explode(F.sequence(F.lit(0), (full - 1).cast("int"))).alias("piece"))
    whole = whole.select("item", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("size"), F.concat_ws("-", F.lit("w"), "item", "piece").alias("container"), F.lit(capacity).cast("long").alias("load"))
    rest = x.where(F.col("n") % capacity > 0).select("item", full.cast("int").alias("piece"), (full * capacity).alias("start"), (F.col("n") % capacity).alias("size"))
    done, level = [empty, whole], 0
    todo = rest.select(F.col("item").cast("string").alias("unit"), F.lit(0).cast("long").alias("unit_load"), "item", "piece", "start", "size")
    while True:
        last = parts == 1
        ordered = todo.repartition(parts, "unit").sortWithinPartitions(F.desc("unit_load"), F.xxhash64("unit"), "unit", "item", "piece")
        fed = ordered.select(F.concat_ws("-", F.lit(f"r{level}"), F.spark_partition_id()).alias("part"), "unit", "item", "piece", "start", "size")
        packed = materialise(fed.mapInPandas(_pack(capacity, open_limit, last), _OUT), "packed")
        cols = ["item", "piece", "start", "size", "container", "load"]
        done.append(packed.where("closed").select(*cols))
        if last:
            break
        level, parts = level + 1, -(-parts // FAN_IN)
        todo = packed.where("not closed").select(F.col("container").alias("unit"), F.col("load").alias("unit_load"), "item", "piece", "start", "size")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers, pieces, split items, size, and the share of the capacity that is filled."""
    used = packed.where("container is not null")
    per_item = used.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    a = used.agg(F.countDistinct("container").alias("n_containers"), F.count(F.lit(1)).alias("n_pieces"), F.sum("size").alias("total_size"))
    return a.withColumn("n_split", per_item.agg(F.count_if(F.col("n") > 1)).scalar()).withColumn("fill", F.col("total_size") / (F.col("n_containers") * capacity))
