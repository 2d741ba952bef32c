"""Sources mixed to target weights by Poisson replication.

Each distinct text gets a uniform number from the hash of its content (4096 levels) and is taken as often as the
inverse of a Poisson distribution says there, at most ``max_repeats`` times. The mean of the capped
distribution is the target repetition rate of its source: tokens wanted over tokens at hand. What the draw then misses by
chance is settled by shifting the uniform numbers of the source a little (round the circle, so that they stay uniform):
the tokens per source and level, a table bounded by sources x levels, give the exact size of the mixture for
any shift, and the smallest of the best shifts is taken. The chosen texts are exploded by their counts and shuffled globally by a hash.

Size: the largest mixture in which every source that has texts reaches its share within its repeats. The source that binds
is taken whole at its cap (a rate equal to the cap leaves nothing to draw). A source
without texts reaches nothing; the others keep their shares relative to each other.

Copies: a text is its content. Rows with the same text count once, under the smallest doc_id and that row's
source, so no text is taken more than ``max_repeats`` times in all.

Scale: one scan counts tokens and hashes; texts move only in the final join, and only those
taken. Counts are a pure function of content and calibrated means, so recomputed tasks agree.

Defined cases: null and empty texts are not taken; sources that are null or not in the targets are not
used; a null share counts as 0, null repeats as 1; repeated target rows for one source: the first in order counts;
without any reachable source the mixture is empty.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomql.session import durable

from .tokens import VOCABULARY, token_counter

LEVELS = 4096
SEED = 20
MAX_SOURCES = 1000
BROADCAST_ROWS = 500_000


def capped_mean(mean: float, cap: int) -> float:
    """Expectation of min(X, cap) for a Poisson X: the sum over k < cap of P(X > k)."""
    if mean > cap + 40 + 12 * math.sqrt(cap):
        return float(cap)
    total, out = 0.0, 0.0
    for k in range(cap):
        total += _mass(mean, k)
        out += 1.0 - min(total, 1.0)
        if k > mean and 1.0 - total < 1e-12:
            break
    return out


def _mass(mean: float, k: int) -> float:
    return math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else float(k == 0)


def mean_for(rate: float, cap: int) -> float:
    """Mean of the Poisson distribution whose capped expectation is ``rate``; infinite where the cap itself is asked for."""
    if rate >= cap * (1 - 1e-12):
        return math.inf if cap else 0.0
    low, high = 0.0, float(cap) + 40.0 + 12 * math.sqrt(cap)
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if capped_mean(middle, cap) < rate else (low, middle)
    return (low + high) / 2


def draws(mean: float, cap: int) -> list[int]:
    """Inverse of the capped Poisson distribution at the middle of each level; grows with the level."""
    if math.isinf(mean):
        return [cap] * LEVELS
    out, k, total = [], 0, _mass(mean, 0)
    for level in range(LEVELS):
        while k < cap and (level + 0.5) / LEVELS >= total:
            k += 1
            total += _mass(mean, k)
        out.append(k)
    return out


def settle(by_level: dict[int, int], times: list[int], target: float) -> int:
    """The shift of the levels, round the circle, whose tokens are nearest to ``target``; the smallest of equal ones."""
    tokens = np.zeros(LEVELS)
    for level, n in by_level.items():
        tokens[level] = n
    # all shifts at once: a circular correlation
    sizes = np.fft.irfft(np.fft.rfft(np.asarray(times, dtype=float)) * np.conj(np.fft.rfft(tokens)), LEVELS)
    return int(np.argmin(np.round(np.abs(sizes - target))))


def _content(text: str) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text."""
    return [F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2")]


def _level() -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), "h1", "h2"), F.lit(LEVELS)).cast("int")


def texts_of(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(h1, h2, doc_id, source, n_tokens, n_rows, level): each distinct text of a target source once."""
    count = token_counter(vocabulary)
    sources = [r[0] for r in targets.select("source").where("source is not null").distinct().limit(MAX_SOURCES + 1).collect()]
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = docs.where(F.col("source").isin(sources) & F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(
        *_content("text"), "doc_id", "source", count(F.col("text")).alias("n_tokens"),
    )
    one = rows.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "source", "n_tokens")).alias("r"), F.count(F.lit(1)).alias("n_rows")
    )
    return one.select("h1", "h2", "r.*", "n_rows", _level().alias("level"))


def plan(texts: DataFrame, targets: DataFrame) -> list[dict]:
    """Per target source: share, repeats, tokens at hand, size of its part, rate, mean and times by level."""
    wanted: dict[str, dict] = {}
    for r in targets.select("source", "target_share", "max_repeats").where("source is not null").orderBy(
        "source", F.desc_nulls_last("target_share"), F.desc_nulls_last("max_repeats")
    ).collect():
        cap = 1 if r[2] is None else max(0, int(r[2]))
        wanted.setdefault(r[0], {"source": r[0], "share": float(r[1] or 0.0), "cap": cap, "levels": {}})
    # bounded by sources x levels, whatever the number of texts
    for r in texts.groupBy("source", "level").agg(F.sum("n_tokens").alias("n")).collect():
        wanted[r[0]]["levels"][r[1]] = r[2]
    for w in wanted.values():
        w["at_hand"] = sum(w["levels"].values())
    able = [w for w in wanted.values() if w["share"] > 0 and w["cap"] > 0 and w["at_hand"] > 0]
    size = min((w["cap"] * w["at_hand"] / w["share"] for w in able), default=0.0)
    for w in wanted.values():
        w["rate"] = w["mean"] = 0.0
        w["times"] = []
        if w in able:
            w["rate"] = min(size * w["share"] / w["at_hand"], float(w["cap"]))
            w["mean"] = mean_for(w["rate"], w["cap"])
            plain = draws(w["mean"], w["cap"])
            shift = settle(w["levels"], plain, w["rate"] * w["at_hand"])
            w["times"] = [plain[(level + shift) % LEVELS] for level in range(LEVELS)]
    return list(wanted.values())


def counted(texts: DataFrame, planned: list[dict]) -> DataFrame:
    """``texts`` that are taken, with the number of times (column ``times``): met by source and level.

    The table of times holds at most sources x levels rows. Its size is known here: up to ``BROADCAST_ROWS`` rows it is
    broadcast, so that texts are not shuffled for it; beyond that both sides are shuffled by source and level.
    """
    rows = [(w["source"], level, k) for w in planned for level, k in enumerate(w["times"]) if k]
    times = texts.sparkSession.createDataFrame(rows, "source string, level int, times int")
    return texts.join(F.broadcast(times) if len(rows) <= BROADCAST_ROWS else times, ["source", "level"])


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens, text): the mixture, globally shuffled."""
    texts = durable(texts_of(docs, targets, vocabulary), "texts")
    planned = plan(texts, targets)
    taken = counted(texts, planned).select("doc_id", "source", "n_tokens", "times")
    # the level follows from the content, so texts that are not taken are left out before anything is shuffled
    hashed = docs.where(F.length("text") > 0).select("doc_id", "text", "source", *_content("text"))
    bodies = counted(hashed.withColumn("level", _level()), planned).select(
        "doc_id", "text", F.col("source").alias("_s")
    )
    drawn = bodies.join(taken.withColumnRenamed("source", "_s"), ["doc_id", "_s"])
    copies = drawn.select("doc_id", F.col("_s").alias("source"), "n_tokens", "text", F.explode(F.sequence(F.lit(1), "times")).alias("copy_no"))
    order = F.xxhash64(F.lit(SEED + 1), "doc_id", "copy_no")
    mixed = copies.withColumn("_o", order).repartition("_o").sortWithinPartitions("_o")
    return mixed.select("doc_id", "source", "copy_no", "n_tokens", "text")


def shares(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per target source: target and reached share, tokens, texts and copies taken."""
    texts = durable(texts_of(docs, targets, vocabulary), "texts")
    planned = plan(texts, targets)
    got = counted(texts, planned).groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("times")).alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"),
        F.sum("times").alias("n_copies"), F.max("times").alias("most_repeats"),
    )
    spark = texts.sparkSession
    rows = [(w["source"], w["share"], w["cap"], w["at_hand"], w["rate"]) for w in planned]
    want = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens_at_hand long, target_rate double")
    total = got.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens")).first()[0]
    out = want.join(got, "source", "left").na.fill(0, ["n_tokens", "n_texts", "n_copies", "most_repeats"])
    reached = F.when(F.lit(total) > 0, F.col("n_tokens") / F.lit(float(total) or 1.0)).otherwise(0.0)
    return out.withColumn("reached_share", F.round(reached, 6))
