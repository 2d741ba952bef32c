"""Texts packed into containers of fixed capacity: bound-certified repacking.

Texts are spread over partitions by the hash of their id and packed by best-fit decreasing. Dual
feasible functions give each partition a lower bound on its containers: where it is met the
partition is certified. Partitions with a gap release the texts of their containers that are not
full, certified ones only those of their emptiest container (the part of a container by which each bound is rounded up); both exchange
them with a neighbour (two partitions become one pool) and run best-fit decreasing again; the
result is kept if it needs fewer containers. This repeats for ``rounds`` rounds, or until every pool is certified or one is left; a
pool then holds what at most 2^rounds partitions released. Texts that stay in a pool with a gap are packed all the same: the rounds bound the
work, never the result, and ``gap`` tells how far above its bound a pool is.

A text larger than the capacity is split into full containers of its own and one remainder, which
is packed like any other text; no other text is split.

Scale: only (id, size) moves, never a text; the number of partitions follows the number of items, so a group
holds about ``ITEMS`` rows whatever the input; a size held by a third of all texts is spread like
any other, since partitions come from the id. Packing itself costs one bit operation per item.

Defined cases: null texts are no items; empty texts have size 0 and take no room; a repeated id is packed
once per row; capacities that are null or below 1 are ignored; without texts there are no containers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.session import durable

from .tokens import VOCABULARY, token_counter

ITEMS = 4_000
ROUNDS = 5
MAX_CAPACITIES = 1000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item, and what each container has left.

    The open containers are stacks by room left, and one integer whose bit r says that room r exists:
    the tightest fit is its lowest bit at or above the size.
    """
    order = np.argsort(-sizes, kind="stable")
    at = np.empty(len(sizes), dtype=np.int64)
    stacks: dict[int, list[int]] = {}
    rooms, left = 0, []
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = stacks[room]
            box = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, box = capacity, len(left)
            left.append(capacity)
        room -= size
        at[i] = box
        left[box] = room
        stacks.setdefault(room, []).append(box)
        rooms |= 1 << room
    return at, np.array(left, dtype=np.int64)


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Containers that any packing needs: the best of three families of dual feasible functions.

    ``counts``: how often each size occurs (once if not given).
    """
    counts = np.ones(len(sizes), dtype=np.int64) if counts is None else counts.astype(np.int64)
    some, some_counts = sizes > 0, counts[sizes > 0]
    s = sizes[some].astype(np.int64)
    if not len(s):
        return 1 if len(sizes) else 0
    best = -(-int((s * some_counts).sum()) // capacity)
    # rounding family: (k + 1) x rounded down to a k-th, whole multiples kept
    for k in range(1, 21):
        scaled = (k + 1) * s
        value = np.where(scaled % capacity == 0, s * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * some_counts).sum()) // (k * capacity)))
    # threshold family: items above C - e count whole, those below e not at all
    hist = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(hist, s, some_counts)
    count_below = np.concatenate([[0], np.cumsum(hist)])
    sum_below = np.concatenate([[0], np.cumsum(hist * np.arange(capacity + 1))])
    e = np.arange(1, capacity // 2 + 1)
    whole = count_below[-1] - count_below[capacity - e + 1]
    middle = sum_below[capacity - e + 1] - sum_below[e]
    if len(e):
        best = max(best, int((whole + -(-middle // capacity)).max()))
    return best


def _pack_group(rows: pd.DataFrame) -> pd.DataFrame:
    """First packing of a partition: adds container, whether it is full, and the partition's gap."""
    capacity = int(rows["capacity"].iloc[0])
    sizes = rows["size"].to_numpy()
    at, left = best_fit_decreasing(sizes, capacity)
    part = rows["part"].iloc[0]
    return rows.assign(
        container=[f"{part}.{b}" for b in at], room=left[at], gap=len(left) - lower_bound(sizes, capacity), last=at == left.argmax()
    )


def _repack_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Pool of released texts packed again; the old containers stay where nothing is gained."""
    capacity = int(rows["capacity"].iloc[0])
    sizes = rows["size"].to_numpy()
    old = rows["container"].nunique()
    at, left = best_fit_decreasing(sizes, capacity)
    pool, turn = rows["part"].iloc[0], rows["turn"].iloc[0]
    gap = min(old, len(left)) - lower_bound(sizes, capacity)
    if len(left) < old:
        rows = rows.assign(container=[f"r{turn}.{pool}.{b}" for b in at], room=left[at])
    emptiest = rows.loc[rows["room"].idxmax(), "container"]
    return rows.assign(gap=gap, last=rows["container"] == emptiest)


_COLUMNS = "capacity_id int, capacity long, part long, doc_id long, piece int, size long, container string, room long, gap long, last boolean"


def sizes_of(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every text that is not null."""
    count = token_counter(vocabulary)
    return docs.where("text is not null").select("doc_id", count(F.col("text")).alias("n_tokens"))


def pack(sizes: DataFrame, capacities: DataFrame, rounds: int = ROUNDS, items: int = ITEMS) -> DataFrame:
    """(doc_id, n_tokens) x (capacity_id, capacity_tokens) -> one row per piece of a text and capacity.

    Columns: capacity_id, capacity_tokens, container_id, doc_id, piece (from 1), n_tokens, gap.
    ``gap``: containers of the piece's partition above the certified bound (0: proven least).
    """
    wanted = [(r[0], r[1]) for r in capacities.select("capacity_id", "capacity_tokens").distinct().limit(MAX_CAPACITIES + 1).collect() if r[0] is not None and (r[1] or 0) >= 1]
    if len(wanted) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} capacities")
    sizes = durable(sizes, "sizes")
    parts = max(1, math.ceil(sizes.count() / items))
    caps = F.array(*[F.struct(F.lit(i).cast("int").alias("capacity_id"), F.lit(c).cast("long").alias("capacity")) for i, c in wanted])
    if not wanted:
        caps = F.array().cast("array<struct<capacity_id:int,capacity:bigint>>")
    each = sizes.select("doc_id", "n_tokens", F.explode(caps).alias("c")).select("c.*", "doc_id", "n_tokens")
    over = F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int")  # pieces before the last
    over = F.when(F.col("n_tokens") > F.col("capacity"), over).otherwise(0)
    full = each.withColumn("over", over).where("over > 0").select(
        "capacity_id", "capacity", F.lit(-1).cast("long").alias("part"), "doc_id",
        F.explode(F.sequence(F.lit(1), F.col("over"))).alias("piece"), F.col("capacity").alias("size"),
    ).select(
        "*", F.concat_ws(".", F.lit("d"), "doc_id", "piece").alias("container"), F.lit(0).cast("long").alias("room"), F.lit(0).cast("long").alias("gap"), F.lit(False).alias("last")
    )
    items_ = each.withColumn("over", over).select(
        "capacity_id", "capacity", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(parts)).alias("part"), "doc_id",
        (F.col("over") + 1).alias("piece"), (F.col("n_tokens") - F.col("over") * F.col("capacity")).alias("size"),
    )
    packed = durable(items_.groupBy("capacity_id", "part").applyInPandas(_pack_group, _COLUMNS), "packed")
    settled = []
    for turn in range(1, rounds + 1):
        if parts == 1:
            break
        open_ = ((F.col("gap") > 0) | F.col("last")) & (F.col("room") > 0)
        released = packed.where(open_)
        if released.isEmpty():
            break
        settled.append(packed.where(~open_))
        parts = math.ceil(parts / 2)
        pooled = released.withColumn("part", F.floor(F.col("part") / 2)).withColumn("turn", F.lit(turn))
        packed = durable(
            pooled.groupBy("capacity_id", "part").applyInPandas(_repack_group, _COLUMNS + ", turn int").drop("turn"), "repacked"
        )
    out = packed
    for s in settled:
        out = out.unionByName(s)
    return out.unionByName(full).select(
        "capacity_id", F.col("capacity").cast("int").alias("capacity_tokens"), F.col("container").alias("container_id"),
        "doc_id", "piece", F.col("size").alias("n_tokens"), "gap",
    )


def containers(packed: DataFrame) -> DataFrame:
    """One row per container with its fill."""
    return packed.groupBy("capacity_id", "capacity_tokens", "container_id").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("filled_tokens")
    ).withColumn("fill", F.round(F.col("filled_tokens") / F.col("capacity_tokens"), 6))


def _bound_group(rows: pd.DataFrame) -> pd.DataFrame:
    capacity = int(rows["capacity_tokens"].iloc[0])
    bound = lower_bound(rows["n_tokens"].to_numpy(), capacity, rows["n"].to_numpy())
    return pd.DataFrame({"capacity_id": [rows["capacity_id"].iloc[0]], "certified_bound": [bound]})


def report(packed: DataFrame) -> DataFrame:
    """One row per capacity: containers used, the least that any packing needs, and the mean fill.

    The bound comes from the sizes and how often each occurs: at most ``capacity`` rows per capacity.
    """
    sizes = packed.groupBy("capacity_id", "capacity_tokens", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    bounds = sizes.groupBy("capacity_id").applyInPandas(_bound_group, "capacity_id int, certified_bound long")
    each = containers(packed).groupBy("capacity_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("filled_tokens").alias("n_tokens")
    )
    return each.join(bounds, "capacity_id").withColumn(
        "mean_fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6)
    )


def valid(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per capacity: texts placed, containers over capacity, texts not placed once and whole or split without need,
    and whether the containers stay within a hundredth (and one) of the certified bound and the gaps that were left.
    """
    over = containers(packed).groupBy("capacity_id").agg(F.sum((F.col("filled_tokens") > F.col("capacity_tokens")).cast("long")).alias("overfull"))
    placed = packed.groupBy("capacity_id", "capacity_tokens", "doc_id").agg(
        F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("numbers")
    )
    need = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))
    wrong = (F.col("placed") != F.col("n_tokens")) | (F.col("pieces") != need) | (F.col("numbers") != need)
    texts = placed.join(sizes, "doc_id").groupBy("capacity_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(wrong.cast("long")).alias("misplaced")
    )
    bound = report(packed).select("capacity_id", (F.col("n_containers") <= 1.01 * F.col("certified_bound") + 1).alias("near_bound"))
    return texts.join(over, "capacity_id").join(bound, "capacity_id")
