"""Progressive joins: blocks of the inputs are joined one pair at a time, results arrive before the join ends.

The result of every policy is the plain inner join; only the order of arrival differs. Both inputs are cut into blocks by
a hash once and written with one folder for each block, so a pair reads its two folders and nothing else. Each pair is
one Spark join, whose strategy the optimizer chooses; up to ``in_flight`` pairs run at a time. The driver keeps
block numbers and match counts, which come with the write of a pair and cost no further job. ``progressive_join`` takes any condition and
compares all rows of a pair; ``progressive_edit_join`` is for keys within some edits and compares only keys that share a piece.

Policies: ``block`` (outer block by outer block), ``ripple`` (growing squares), ``one_sided`` (explores each left
block, then exploits those with the most matches, dropping a block after ``failures`` misses to the end
of the queue), ``two_sided`` (explores the blocks of both sides, rewards of both blocks of a pair are added) and ``online_ripple`` (grows
the square by the side whose newest block gave more matches for each pair; ``least`` pairs are tried on a side before it is judged, and it is
left behind by at most ``most`` blocks). ``must_explore`` pairs are tried for each block before any is exploited; ``left_cache`` and
``right_cache`` bound the blocks that are exploited at a time (others wait, they are not dropped).
"""

from __future__ import annotations

import contextvars
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomql.session import durable, durable_by

Condition = Callable[[DataFrame, DataFrame], Column]
Pair = tuple[int, int]
Part = tuple[Pair, int, DataFrame]
POLICIES = ("block", "ripple", "one_sided", "two_sided", "online_ripple")


def _folders(df: DataFrame, block: Column, n: int) -> list[DataFrame]:
    """One reader for each block; a block without rows is an empty table."""
    spark, schema = df.sparkSession, df.schema
    path = durable_by(df.withColumn("_block", block), "_block", "blocks")
    there = {r[0] for r in spark.read.parquet(path).select("_block").distinct().collect()}  # one number for each block
    return [spark.read.schema(schema).parquet(f"{path}/_block={i}") if i in there else spark.createDataFrame([], schema) for i in range(n)]


def _hashed(df: DataFrame, n: int, by: list[str] | None = None) -> list[DataFrame]:
    return _folders(df, F.pmod(F.xxhash64(*(by or df.columns)), F.lit(n)).cast("int"), n)


class _Queue:
    """Chooses the next pair from what the pairs before it gave."""

    def __init__(self, policy: str, n: int, m: int, failures: int, must_explore: int, caches: tuple[int | None, int | None], bounds: tuple[int, int]) -> None:
        self.policy, self.n, self.m, self.failures, self.must, self.caches, self.bounds = policy, n, m, failures, must_explore, caches, bounds
        self.todo = {(i, j) for i in range(n) for j in range(m)}
        self.gain, self.tried, self.missed = ([0.0] * n, [0.0] * m), ([0] * n, [0] * m), [0] * n
        self.edge = [0, 0]  # blocks of each side inside the growing square

    def learn(self, pair: Pair, matches: int) -> None:
        for side in (0, 1):
            self.gain[side][pair[side]] += matches
        self.missed[pair[0]] = 0 if matches else self.missed[pair[0]] + 1

    def take(self) -> Pair:
        pick = getattr(self, f"_{self.policy}")()
        self.todo.remove(pick)
        for side in (0, 1):
            self.tried[side][pick[side]] += 1
        return pick

    def _block(self) -> Pair:
        return min(self.todo)

    def _ripple(self) -> Pair:
        return min(self.todo, key=lambda p: (max(p), p[0] == p[1], p))

    def _explore(self, side: int) -> Pair | None:
        fresh = [p for p in self.todo if self.tried[side][p[side]] < self.must]
        return min(fresh, key=lambda p: (self.tried[side][p[side]], p[side], self.tried[1 - side][p[1 - side]], p)) if fresh else None

    def _exploit(self, sides: tuple[int, ...]) -> Pair:
        def worth(p: Pair) -> float:
            return sum(self.gain[s][p[s]] for s in sides)

        left = self.todo
        for side in sides:
            if (size := self.caches[side]) is not None:
                best = sorted({p[side] for p in left}, key=lambda b: (-self.gain[side][b], b))[:size]
                left = {p for p in left if p[side] in best} or left
        return min(left, key=lambda p: (self.missed[p[0]] >= self.failures, -worth(p), p))

    def _one_sided(self) -> Pair:
        return self._explore(0) or self._exploit((0,))

    def _two_sided(self) -> Pair:
        return self._explore(0) or self._explore(1) or self._exploit((0, 1))

    def _online_ripple(self) -> Pair:
        while not (inside := [p for p in self.todo if p[0] < self.edge[0] and p[1] < self.edge[1]]):
            self.edge[self._side_to_grow()] += 1
        return min(inside)

    def _side_to_grow(self) -> int:
        least, most = self.bounds
        size = (self.n, self.m)
        for side in (0, 1):
            if self.edge[side] >= size[side]:
                return 1 - side
            if not self.edge[side] or self.edge[1 - side] - self.edge[side] >= most:
                return side
        newest = [e - 1 for e in self.edge]
        rate = [self.gain[s][newest[s]] / max(1, self.tried[s][newest[s]]) if self.tried[s][newest[s]] >= least else float("inf") for s in (0, 1)]
        return 0 if rate[0] > rate[1] or (rate[0] == rate[1] and self.edge[0] <= self.edge[1]) else 1


def progressive_join(
    left: DataFrame, right: DataFrame, on: Condition, left_blocks: int, right_blocks: int,
    policy: str = "ripple", failures: int = 2, flip: bool = False, must_explore: int = 1,
    left_cache: int | None = None, right_cache: int | None = None, least: int = 1, most: int = 4, in_flight: int = 4,
) -> Iterator[Part]:
    """Yield ((left block, right block), matches, rows) for every pair of blocks that has matches or not.

    ``rows`` is stored, so reading it again does not join again. ``flip`` lets the right side be the outer one.
    """
    if policy not in POLICIES:
        raise ValueError(policy)
    if flip:
        turned = progressive_join(
            right, left, lambda a, b: on(b, a), right_blocks, left_blocks, policy, failures, False, must_explore, right_cache, left_cache, least, most, in_flight
        )
        for (j, i), n, rows in turned:
            yield (i, j), n, rows.select(*left.columns, *right.columns) if not set(left.columns) & set(right.columns) else rows
        return
    ls, rs = _hashed(left, left_blocks), _hashed(right, right_blocks)
    queue = _Queue(policy, left_blocks, right_blocks, failures, must_explore, (left_cache, right_cache), (least, most))
    yield from _run(queue, lambda p: ls[p[0]].join(rs[p[1]], on(ls[p[0]], rs[p[1]])), in_flight)


def progressive_edit_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, k: int, left_blocks: int, right_blocks: int,
    policy: str = "ripple", failures: int = 2, flip: bool = False, must_explore: int = 1,
    left_cache: int | None = None, right_cache: int | None = None, least: int = 1, most: int = 4, in_flight: int = 4,
) -> Iterator[Part]:
    """``progressive_join`` on keys within ``k`` edits; the columns of the sides have different names.

    Blocks are cut by the key, so each pair of distinct keys is looked at in one pair of blocks only. Of a pair of blocks the keys that
    match are stored; ``rows`` joins its two blocks by them (equi-joins, no text is compared again), so results, which can be many times
    the input, are not written before they are asked for.
    """
    from loomql.operators.special_joins import left_pieces, near_pieces, right_pieces

    if policy not in POLICIES:
        raise ValueError(policy)
    if flip:
        turned = progressive_edit_join(
            right, left, right_key, left_key, k, right_blocks, left_blocks, policy, failures, False, must_explore, right_cache, left_cache, least, most, in_flight
        )
        for (j, i), n, rows in turned:
            yield (i, j), n, rows.select(*left.columns, *right.columns)
        return

    def counted(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.groupBy(F.col(key).alias(name)).agg(F.count(F.lit(1)).alias(f"_n{name}"))

    left, right = left.where(F.col(left_key).isNotNull()), right.where(F.col(right_key).isNotNull())
    ls, rs = _hashed(left, left_blocks, [left_key]), _hashed(right, right_blocks, [right_key])
    lp = _hashed(left_pieces(counted(left, left_key, "l"), k), left_blocks, ["l"])
    rp = _hashed(right_pieces(counted(right, right_key, "r"), k), right_blocks, ["r"])

    def rows(p: Pair, met: DataFrame) -> DataFrame:
        met = met.select(F.col("l").alias("_l"), F.col("r").alias("_r"))
        found = ls[p[0]].join(met, F.col(left_key) == F.col("_l")).join(rs[p[1]], F.col("_r") == F.col(right_key))
        return found.select(*left.columns, *right.columns)

    queue = _Queue(policy, left_blocks, right_blocks, failures, must_explore, (left_cache, right_cache), (least, most))
    yield from _run(queue, lambda p: near_pieces(lp[p[0]], rp[p[1]], k), in_flight, F.coalesce(F.sum(F.col("_nl") * F.col("_nr")), F.lit(0)), rows)


def _run(
    queue: _Queue, joined: Callable[[Pair], DataFrame], in_flight: int, counted: Column | None = None, rows_of: Callable[[Pair, DataFrame], DataFrame] | None = None
) -> Iterator[Part]:
    """Pairs as the queue gives them, a few at a time, yielded in the order in which they were taken.

    ``joined`` is stored, and ``counted`` over it is the number of matches; ``rows_of`` makes the rows from what is stored.
    """
    counted = F.count(F.lit(1)) if counted is None else counted

    def one(pair: Pair) -> Part:
        count = Observation()
        stored = durable(joined(pair).observe(count, counted.alias("n")), "pairs")
        return pair, count.get["n"], stored if rows_of is None else rows_of(pair, stored)

    with ThreadPoolExecutor(max(1, in_flight)) as pool:
        running = []
        while queue.todo or running:
            while queue.todo and len(running) < max(1, in_flight):
                running.append(pool.submit(contextvars.copy_context().run, one, queue.take()))
            got = running.pop(0).result()
            queue.learn(got[0], got[1])
            yield got


def sorted_progressive_join(left: DataFrame, right: DataFrame, on: list[str], blocks: int, in_flight: int = 4) -> Iterator[Part]:
    """Equi-join on ``on`` in key order: both sides are cut into the same ranges of the first key, joined from the smallest on.

    Each range is a Spark sort-merge join; results come out range by range, as a merge over sorted inputs gives them.
    The first key is a number, date or timestamp.
    """
    from loomql.operators.special_joins import ranges_of

    keys = left.select(on[0]).unionByName(right.select(on[0]))
    size = max(1, keys.count() // max(1, blocks))
    cut = ranges_of(keys, on[0], size, blocks)
    ls, rs = _folders(left, cut, blocks), _folders(right, cut, blocks)
    queue = _Queue("block", blocks, 1, 0, 0, (None, None), (0, 0))
    yield from _run(queue, lambda p: ls[p[0]].hint("merge").join(rs[p[0]], on), in_flight)


def collect_progressive(parts: Iterator[Part]) -> DataFrame:
    """All results of a progressive join as one DataFrame."""
    return reduce(DataFrame.unionByName, [rows for _, _, rows in parts])


def time_to_k(parts: Iterator[Part], ks: list[int], sigma: float = 0.99) -> dict:
    """Seconds until the first k rows for each k, and the discounted time: sum over single results of sigma^i times the wait before it.

    Results of one pair of blocks arrive together: the first of them waited, the others did not.
    """
    began = last = time.time()
    have, found, score, i = 0, {}, 0.0, 0
    for _, n, _ in parts:
        now = time.time()
        have += n
        if n:
            score += sigma**i * (now - last)
            i += n
            last = now
        for k in ks:
            if k not in found and have >= k:
                found[k] = now - began
        if len(found) == len(ks):
            break
    return {"time_to_k": found, "discounted": score, "rows": have}
