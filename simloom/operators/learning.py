"""What a training step needs besides the policy: metrics, baselines, samples and losses."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.plans import durable, ranks


def summary(sessions: DataFrame, k: int = 1) -> DataFrame:
    """Mean recall, distance computations, hops and their ratios of sessions with column truth; with ``reward`` also its mean."""
    r1 = (F.get("best_ids", F.lit(0)) == F.get("truth", F.lit(0))).cast("double")
    out = [F.count(F.lit(1)).alias("n_sessions"), F.avg(r1).alias("recall_at_1"), F.avg("dcs").alias("mean_dcs"), F.avg("hops").alias("mean_hops"), F.avg(r1 / F.col("dcs")).alias("recall_per_dcs")]
    if k > 1:
        rk = F.size(F.array_intersect(F.slice("best_ids", 1, k), F.slice("truth", 1, k))) / F.lit(float(k))
        out += [F.avg(rk).alias(f"recall_at_{k}"), F.avg(rk / F.col("dcs")).alias(f"recall_{k}_per_dcs")]
    if "reward" in sessions.columns:
        out.append(F.avg("reward").alias("mean_reward"))
    return sessions.agg(*out)


def samples_per_hop(samples: DataFrame) -> DataFrame:
    return samples.groupBy("query_id", "hop").agg(F.count(F.lit(1)).alias("n_samples"))


class Baseline:
    """What rewards are held against."""

    mean_reward: float = 0.0  # of the last batch

    def advantages(self, samples: DataFrame) -> DataFrame:
        """``samples`` (session_index, reward and more) with columns baseline and advantage."""
        raise NotImplementedError

    def update(self, samples: DataFrame, sessions: DataFrame) -> "Baseline":
        """Learn from samples(session_index, reward) of ``sessions`` (query_id)."""
        raise NotImplementedError

    def close(self) -> None:
        """Delete what it has written."""


@dataclass
class MeanBaseline(Baseline):
    """A moving average of sessions' mean rewards; the first steps weigh more."""

    value: float = 0.0
    moving_average: float = 0.05
    horizon: float = 20.0
    step: int = 0
    mean_reward: float = 0.0  # of the last batch

    def advantages(self, samples: DataFrame) -> DataFrame:
        """``samples`` with columns baseline and advantage."""
        return samples.withColumn("baseline", F.lit(float(self.value))).withColumn("advantage", F.col("reward") - F.col("baseline"))

    def update(self, samples: DataFrame, sessions: DataFrame | int) -> "MeanBaseline":
        """From samples(session_index, reward); sessions without samples count as 0.

        ``sessions`` is their number, or a table with a row for each.
        """
        n = sessions if isinstance(sessions, int) else sessions.count()
        per = samples.groupBy("session_index").agg(F.avg("reward").alias("m"))
        self.mean_reward = per.agg(F.coalesce(F.sum("m"), F.lit(0.0))).first()[0] / max(n, 1)
        self.horizon = max(self.horizon - self.step, 1.0)
        alpha = self.horizon * self.moving_average
        self.value = (1 - alpha) * self.value + alpha * self.mean_reward
        self.step += 1
        return self


@dataclass
class SessionBaseline(Baseline):
    """A moving average of rewards for each query: a written table (query_id, value, updated)."""

    table: DataFrame
    moving_average: float = 0.05
    horizon: float = 20.0
    step: int = 0  # rounds in which every query was seen
    mean_reward: float = 0.0

    @classmethod
    def of(cls, queries: DataFrame) -> "SessionBaseline":
        start = queries.select(F.col("id").alias("query_id"), F.lit(0.0).alias("value"), F.lit(False).alias("updated"))
        return cls(durable.table(start, "baseline"))

    def advantages(self, samples: DataFrame) -> DataFrame:
        """``samples`` (session_index is the query's id) with columns baseline and advantage."""
        known = self.table.select(F.col("query_id").alias("session_index"), F.col("value").alias("baseline"))
        return samples.join(known, "session_index", "left").withColumn("baseline", F.coalesce("baseline", F.lit(0.0))).withColumn("advantage", F.col("reward") - F.col("baseline"))

    def update(self, samples: DataFrame, sessions: DataFrame) -> "SessionBaseline":
        """From samples(session_index, reward) of ``sessions`` (query_id); those without samples keep their value."""
        per = samples.groupBy(F.col("session_index").alias("query_id")).agg(F.avg("reward").alias("reward"))
        self.mean_reward = per.agg(F.coalesce(F.avg("reward"), F.lit(0.0))).first()[0]
        self.horizon = max(self.horizon - self.step, 1.0)
        batch = sessions.select("query_id").join(per, "query_id", "left")
        before, self.table = self.table, durable.table(session_baseline(self.table, batch, self.horizon * self.moving_average), "baseline")
        if hasattr(before, "_written"):
            durable.drop(before)
        if not self.table.where("updated").limit(1).count():
            self.step += 1
        return self

    def close(self) -> None:
        if hasattr(self.table, "_written"):
            durable.drop(self.table)


def session_baseline(baseline: DataFrame, rewards: DataFrame, alpha: float) -> DataFrame:
    """(query_id, value, updated) after one batch: each query's own moving average.

    ``rewards`` has a row for each query of the batch with its session's mean
    reward; where that is null, or without a row, the value stays. Queries of the
    batch are flagged; flags start anew once all queries have one.
    """
    out = baseline.join(rewards.select("query_id", "reward", F.lit(True).alias("_met")), "query_id", "left")
    new = F.when(F.col("reward").isNull(), F.col("value")).otherwise((1 - alpha) * F.col("value") + alpha * F.col("reward"))
    out = out.select("query_id", new.alias("value"), (F.col("updated") | F.col("_met").isNotNull()).alias("updated"))
    done = out.agg(F.bool_and("updated").alias("_all"))
    return out.join(F.broadcast(done), F.lit(True)).select("query_id", "value", (F.col("updated") & ~F.col("_all")).alias("updated"))


def aggregate_samples(samples: DataFrame) -> DataFrame:
    """(from_id, to_id, action, advantages, freqs): equal decisions as one row."""
    return samples.groupBy("from_id", "to_id", "action").agg(F.sum("advantage").alias("advantages"), F.count(F.lit(1)).alias("freqs"))


def gumbel_key(freqs: Column, u: Column) -> Column:
    """Descending order of this key is a weighted random permutation without replacement."""
    return F.log(freqs) - F.log(-F.log(u))


def standardized(samples: DataFrame, column: str = "advantage") -> DataFrame:
    """``column`` less its mean, over its sample standard deviation."""
    stats = samples.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    return samples.join(F.broadcast(stats), F.lit(True)).withColumn(column, (F.col(column) - F.col("_m")) / (F.col("_s") + 1e-8)).drop("_m", "_s")


def weighted(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def ppo_loss(clip: float = 0.2) -> Column:
    """Frequency-weighted clipped surrogate over rows (logp, old_logp, advantages, freqs)."""
    ratio = F.exp(F.col("logp") - F.col("old_logp"))
    bounded = F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
    return -weighted(F.least(ratio * F.col("advantages"), bounded * F.col("advantages")), F.col("freqs"))


def trpo_loss() -> Column:
    """Surrogate over rows whose advantages are sums over their samples: they aren't weighted again."""
    return -F.sum(F.exp(F.col("logp") - F.col("old_logp")) * F.col("advantages")) / F.sum("freqs")


def entropy(p0: Column, p1: Column) -> Column:
    return -(p0 * F.log(p0) + p1 * F.log(p1))


def kl(p0: Column, p1: Column, q0: Column, q1: Column) -> Column:
    """KL divergence of (p0, p1) from (q0, q1)."""
    return p0 * (F.log(p0) - F.log(q0)) + p1 * (F.log(p1) - F.log(q1))


def trailing_mean(history: DataFrame, n: int = 100) -> DataFrame:
    """(step, trailing): the mean of the last ``n`` rewards.

    Steps are ranked and cut into blocks; a block also gets the n - 1 rows before it.
    """
    size = max(n, ranks.RANGE_ROWS)
    told = ranks.ranked(history.select("step", "reward"), "step", out="_r").withColumn("_own", F.floor(F.col("_r") / size))
    late = F.when(F.col("_r") % size > size - n, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))
    told = told.withColumn("_block", F.explode(late))
    mean = F.avg("reward").over(Window.partitionBy("_block").orderBy("_r").rowsBetween(-(n - 1), 0))
    return told.withColumn("trailing", mean).where(F.col("_own") == F.col("_block")).select("step", "trailing")


def adjusted_ewm(history: DataFrame, span: int = 50) -> DataFrame:
    """(step, ewm): the exponentially weighted mean with weights (1 - 2/(span+1))^age.

    A linear recurrence over blocks of ranked steps: each block gives its weighted
    sum, these are carried from block to block, and a block starts from its carry.
    """
    q, size = 1 - 2 / (span + 1), ranks.RANGE_ROWS
    told = ranks.ranked(history.select("step", F.col("reward").cast("double").alias("reward")), "step", out="_r").withColumn("_block", F.floor(F.col("_r") / size))
    sums = told.groupBy("_block").agg(F.sum(F.col("reward") * F.pow(F.lit(q), size - 1 - F.col("_r") % size)).alias("s"))
    carry, carried = 0.0, []
    for r in sums.orderBy("_block").collect():  # a row for RANGE_ROWS steps
        carried.append((r["_block"], carry))
        carry = carry * q**size + r["s"]
    first = history.sparkSession.createDataFrame(carried, "_block long, _carry double")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_r")
        start, r = rows.column("_carry")[0].as_py(), rows.column("_r").to_numpy()
        top = list(accumulate(rows.column("reward").to_pylist(), lambda s, x: s * q + x, initial=start))[1:]
        return pa.table({"step": rows.column("step"), "ewm": np.array(top) / ((1 - q ** (r + 1.0)) / (1 - q))})

    return told.join(F.broadcast(first), "_block").groupBy("_block").applyInArrow(run, f"step {history.schema['step'].dataType.simpleString()}, ewm double")


def weighted_order(rows: DataFrame, key: str, *ties: str, out: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in descending order of ``key``: of :func:`gumbel_key` a weighted random permutation."""
    return ranks.ranked(rows, F.desc(key), *ties, out=out).withColumn(out, F.col(out) + 1)
