"""Filling fixed-capacity containers with whole items and little unused space.

Items are counts per size, never rows, wherever a decision is taken: sizes are
bounded by the capacity, so a partition of any number of items is a histogram.
Each partition is packed by best-fit decreasing and certified by lower bounds
from dual feasible functions.  A partition that uses more containers than its
bound has a gap: it gives its emptiest containers' items to the exchange, where
the items of all such partitions are packed together, and so on until the
bound is met or a round brings nothing.  ``certificates`` states, for every
partition of every round and for the whole, the containers used, the bound and
the gap between them.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm import bpe
from scholium.session import durable

CAPACITY = 4_096
#: Items of a partition, about; what a partition leaves unused is less than a container.
PARTITION_ITEMS = 50_000
#: Another round of exchange is worth it only if the last one left at most this share of its items open.
WORTH = 0.9
#: Containers filled less than this are open for exchange in a partition that has a gap.
OPEN_BELOW = 0.995


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY, times: np.ndarray | None = None) -> int:
    """Containers that any packing of ``sizes`` (each ``times`` over) needs: the best of three families of dual feasible functions."""
    s = np.asarray(sizes, np.int64)
    if not len(s):
        return 0
    value, n = np.unique(s, return_counts=True)
    if times is not None:
        n = np.bincount(np.searchsorted(value, s), np.asarray(times, np.int64)).astype(np.int64)
    best = -(-int((value * n).sum()) // capacity)
    half = capacity // 2
    thresholds = np.unique(np.concatenate([value[value <= half], capacity - value[value > half] + 1, [0, half]]))
    thresholds = thresholds[thresholds <= half]
    if len(thresholds) > 400:  # any threshold gives a valid bound; a spread of them is enough
        thresholds = thresholds[np.linspace(0, len(thresholds) - 1, 400).astype(int)]
    for t in thresholds:
        # Items above capacity - t take a container each, items below t are left out.
        big, mid = value > capacity - t, (value >= t) & (value <= capacity - t)
        best = max(best, int(n[big].sum()) + -(-int((value[mid] * n[mid]).sum()) // capacity))
    for k in range(2, 21):
        # Rounding: an item counts in k-ths of a container.
        part = value * (k + 1)
        scaled = np.where(part % capacity == 0, value * k, (part // capacity) * capacity)
        best = max(best, -(-int((scaled * n).sum()) // (k * capacity)))
    return best


class _Room:
    """Open containers by free space; finds the least space that is enough in one step."""

    def __init__(self, capacity: int):
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, container: int, space: int) -> None:
        if space:
            self.free[space].append(container)
            self.mask |= 1 << space

    def take(self, size: int) -> tuple[int, int] | None:
        above = self.mask >> size
        if not above:
            return None
        space = size + (above & -above).bit_length() - 1
        held = self.free[space]
        container = held.pop()
        if not held:
            self.mask &= ~(1 << space)
        return container, space


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item (numbered from 0) and the load of each container."""
    order = np.argsort(-sizes, kind="stable")
    where = np.empty(len(sizes), np.int64)
    room, load = _Room(capacity), []
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        got = room.take(size)
        if got is None:
            container, space = len(load), capacity
            load.append(0)
        else:
            container, space = got
        load[container] += size
        where[i] = container
        room.put(container, space - size)
    return where, np.array(load, np.int64)


_OUT = "item long, part_no int, size int, home long, slot long, closed boolean"


def _pack(capacity: int, last: bool):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["item", "part_no"], kind="stable")
        sizes = items["size"].to_numpy(np.int64)
        where, load = best_fit_decreasing(sizes, capacity)
        gap = len(load) > lower_bound(sizes, capacity)
        closed = np.ones(len(load), bool) if last or not gap else load >= OPEN_BELOW * capacity
        return pd.DataFrame(
            {"item": items["item"].to_numpy(), "part_no": items["part_no"].to_numpy(), "size": items["size"].to_numpy(), "home": int(key[0]), "slot": where, "closed": closed[where]}
        )

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, partition_items: int = PARTITION_ITEMS) -> DataFrame:
    """``item, part_no, size, container_id, position, start`` of ``items(item, size)``.

    Every item of at least size 1 lies whole in one container; only an item
    above the capacity is cut, into parts of the capacity and a rest
    (``part_no`` 0, 1, ...).  ``position`` counts the items of a container from
    0, ``start`` is the space used before.  Null and non-positive sizes are
    left out, an empty table gives an empty result; repeated items are packed
    repeatedly.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    whole = items.where(F.col("size") > 0).select(F.col("item").cast("long").alias("item"), F.col("size").cast("int").alias("size"))
    parts = whole.select("item", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / capacity).cast("int") - 1)).alias("part_no")).select(
        "item", "part_no", F.least(F.lit(capacity), F.col("size") - F.col("part_no") * capacity).alias("size")
    )
    parts = durable(parts)
    full = parts.where(F.col("size") == capacity).select(
        "item", "part_no", "size", F.lit(-1).cast("long").alias("home"), F.monotonically_increasing_id().alias("slot")
    )
    rest = parts.where(F.col("size") < capacity)
    left = rest.count()
    done, at, k, last = [full], rest, 0, False
    while True:
        homes = max(1, -(-left // partition_items))
        last = last or homes == 1
        placed = at.withColumn("bucket", F.pmod(F.xxhash64("item", "part_no", F.lit(k)), F.lit(homes)).cast("int")).groupBy("bucket").applyInPandas(_pack(capacity, last), _OUT)
        placed = durable(placed)
        done.append(placed.where("closed").select("item", "part_no", "size", (F.col("home") + k * 1_000_000_000).alias("home"), "slot"))
        if last:
            break
        at, before = placed.where("not closed").select("item", "part_no", "size"), left
        left, k = at.count(), k + 1
        if not left:
            break
        last = left > WORTH * before  # this round brought little; the next one closes all
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    # Containers are small, so ordering within them never gathers much.
    grouped = out.groupBy("home", "slot").agg(F.sort_array(F.collect_list(F.struct("size", "item", "part_no")), asc=False).alias("held"))
    listed = grouped.select(F.concat_ws(":", "home", "slot").alias("container_id"), F.posexplode("held").alias("position", "x"), "held")
    before = F.aggregate(F.slice("held", 1, F.col("position")), F.lit(0), lambda a, x: a + x["size"])
    return listed.select("x.item", "x.part_no", "x.size", "container_id", "position", before.alias("start"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``doc_id, part_no, n_tokens, container_id, position, start`` for every document with at least one token."""
    counted = bpe.count_tokens(documents, "doc_id", "text", path).select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size"))
    packed = pack(counted.where(F.col("item").isNotNull()), capacity)
    return packed.select(F.col("item").alias("doc_id"), "part_no", F.col("size").alias("n_tokens"), "container_id", "position", "start")


def _certify(capacity: int):
    def run(key: tuple, counted: pd.DataFrame) -> pd.DataFrame:
        sizes, n = counted["n_tokens"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
        return pd.DataFrame({"home": [key[0]], "n_items": [int(n.sum())], "used": [int((sizes * n).sum())], "bound": [lower_bound(sizes, capacity, n)]})

    return run


def certificates(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``home, n_items, used, n_containers, bound, gap`` per partition, and of all together as home ``all``.

    ``home`` is round and partition as the containers' ids begin; ``bound`` is
    the least number of containers that any packing of these items needs, so a
    gap of 0 certifies that they cannot be packed better.  Sizes are counted
    before they are shuffled: a partition is at most ``capacity`` rows.
    """
    home = F.substring_index("container_id", ":", 1)
    sizes = packed.groupBy(home.alias("home"), "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    both = sizes.unionByName(sizes.groupBy("n_tokens").agg(F.sum("n").alias("n")).withColumn("home", F.lit("all")))
    bounds = both.groupBy("home").applyInPandas(_certify(capacity), "home string, n_items long, used long, bound long")
    used = packed.select(home.alias("home"), "container_id").distinct().groupBy("home").agg(F.count(F.lit(1)).alias("n_containers"))
    used = used.unionByName(used.agg(F.lit("all").alias("home"), F.sum("n_containers").alias("n_containers")))
    return bounds.join(used, "home").select("home", "n_items", "used", "n_containers", "bound", (F.col("n_containers") - F.col("bound")).alias("gap"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``n_containers, n_items, used, unused_share, least_possible``: the last by the dual feasible functions over all items."""
    return certificates(packed, capacity).where("home = 'all'").select(
        "n_containers", "n_items", "used", F.round(1 - F.col("used") / (F.col("n_containers") * capacity), 6).alias("unused_share"), F.col("bound").alias("least_possible")
    )
