"""Training a policy on search sessions: batches, steps, evaluation, metrics, checkpoints and the loop around them.

A checkpoint is a folder of versions; a version counts once its manifest, which
is written last and moved into place, is there. A save that breaks off leaves
the version before as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.operators import learning as L
from simloom.operators.engine import SessionEngine
from simloom.operators.training import Trainer
from simloom.plans import durable, ranks

STATE = "params binary, m binary, s binary, t long, done long, step long, batches long, value double, horizon double, rounds long"


def name_of(template: str, **settings) -> str:
    """The experiment's name from its settings."""
    return template.format(**settings)


def minibatches(queries: DataFrame, batch_size: int = 50000, shuffle: bool = True, cycle: bool = True, seed: int = 0) -> Iterator[DataFrame]:
    """``queries`` (id and more) in batches of ``batch_size`` rows, the last of a round of what is left, dealt anew in each round.

    Ids are ranked in a random order, range by range; a batch is readable until the next round begins.
    """
    round_ = 0
    while True:
        key = F.xxhash64("id", F.lit(seed), F.lit(round_)) if shuffle else F.col("id")
        ids = ranks.ranked(queries.select("id").withColumn("_key", key), "_key", "id", out="_rank")
        dealt = durable.table(ids.select("id", F.floor(F.col("_rank") / batch_size).alias("_batch")), "dealt")
        durable.drop(ids)
        try:
            for i in range(-(-dealt.count() // batch_size)):
                yield queries.join(dealt.where(F.col("_batch") == i).select("id"), "id", "left_semi")
        finally:
            durable.drop(dealt)
        round_ += 1
        if not cycle:
            return


@dataclass
class Experiment:
    """An engine, a trainer with its policy, a baseline and a reward.

    ``reward`` maps (best_ids, truth, dcs) to a column; queries have id, vec and
    truth. ``log`` has a row for each step and metric.
    """

    engine: SessionEngine
    trainer: Trainer
    baseline: L.Baseline
    reward: Callable[[Column, Column, Column], Column]
    step: int = 0
    log: list[tuple] = field(default_factory=list)
    _sessions: DataFrame | None = field(default=None, repr=False)

    def session_batch(self, queries: DataFrame, prefix: str = "train", evaluate: bool = False) -> tuple[DataFrame, DataFrame, dict]:
        """Sessions with truth and reward, the samples of those that have some, and the summary, which is logged.

        They are readable until the next batch.
        """
        before, self._sessions = self._sessions, self.engine.sessions(self.trainer.policy, queries.select("id", "vec"), evaluate, greedy=evaluate)
        durable.drop(before)
        told = self._sessions.join(queries.select(F.col("id").alias("query_id"), "truth"), "query_id")
        told = told.withColumn("reward", self.reward(F.col("best_ids"), F.col("truth"), F.col("dcs")))
        summary = L.summary(told, self.engine.k).first().asDict()
        self.log += [(self.step, prefix, k, float(v)) for k, v in summary.items() if v is not None]
        samples = told.select(F.col("query_id").alias("session_index"), "reward", F.inline("samples"))
        return told, samples, summary

    def train_step(self, queries: DataFrame) -> float:
        """Sample sessions, update the policy and the baseline; the batch's mean reward."""
        sessions, samples, _ = self.session_batch(queries)
        known = self.baseline.advantages(samples)
        told = self.trainer.step(known.select("from_id", "to_id", "action", "advantage"), self.engine.vertices)
        told |= known.agg(F.avg("baseline").alias("baseline"), F.avg("advantage").alias("advantage")).first().asDict()
        self.baseline.update(samples.select("session_index", "reward"), sessions)
        self.log += [(self.step, "train", k, float(v)) for k, v in told.items() if v is not None]
        self.step += 1
        return self.baseline.mean_reward

    def evaluate(self, queries: DataFrame, prefix: str = "dev") -> float:
        """The mean reward of greedy sessions; confidence stays as it is."""
        return self.session_batch(queries, prefix, evaluate=True)[2]["mean_reward"]

    def metrics(self) -> DataFrame:
        """(step, prefix, name, value) of all that was logged."""
        return self.engine.vertices.sparkSession.createDataFrame(self.log, "step long, prefix string, name string, value double")

    def close(self) -> None:
        """Delete all tables of the run; checkpoints stay."""
        durable.drop(self._sessions)
        self._sessions = None
        self.engine.close()
        self.baseline.close()

    def save(self, folder: str) -> None:
        """Write what a run needs to go on: parameters and moments, baseline, edges with their confidence, virtual edges, metrics.

        The versions that were complete before go once the new one is.
        """
        spark, t, b = self.engine.vertices.sparkSession, self.trainer, self.baseline
        raw = lambda x: None if x is None else x.tobytes()
        state = (t.policy.flat.tobytes(), raw(getattr(t, "_m", None)), raw(getattr(t, "_s", None)), getattr(t, "_t", 0), t.done, self.step, self.engine.batches, getattr(b, "value", None), b.horizon, b.step)
        before = durable.versions(spark, folder)
        version = f"v{(durable.number_of(before[-1]) if before else 0) + 1:09d}-{uuid.uuid4().hex}"
        put = lambda df, name: df.write.parquet(f"{folder}/{version}/{name}")
        put(spark.createDataFrame([state], STATE), "state")
        put(self.engine.edges, "edges")
        put(self.metrics(), "metrics")
        if self.engine.virtual is not None:
            put(self.engine.virtual, "virtual")
        if isinstance(b, L.SessionBaseline):
            put(b.table, "baseline")
        durable.complete(spark, f"{folder}/{version}")
        for old in before:
            durable.remove(spark, f"{folder}/{old}")

    def restore(self, folder: str) -> "Experiment":
        """Go back to the newest complete version that :meth:`save` wrote."""
        spark, t, b = self.engine.vertices.sparkSession, self.trainer, self.baseline
        found = durable.versions(spark, folder)
        if not found:
            raise FileNotFoundError(f"no complete checkpoint in {folder}")
        read = lambda name: spark.read.parquet(f"{folder}/{found[-1]}/{name}")
        s = read("state").first()
        array = lambda x: None if x is None else np.frombuffer(bytes(x)).copy()
        t.policy.flat, t.done, self.step, self.engine.batches = array(s["params"]), s["done"], s["step"], s["batches"]
        if hasattr(t, "_t"):
            t._m, t._s, t._t = array(s["m"]), array(s["s"]), s["t"]
        b.horizon, b.step = s["horizon"], s["rounds"]
        if isinstance(b, L.SessionBaseline):
            b.close()
            b.table = durable.table(read("baseline"), "baseline")
        else:
            b.value = s["value"]
        self.engine.edges = self.engine.keep("edges", read("edges"))
        if self.engine.n_hop_virtual:
            self.engine.virtual = self.engine.keep("virtual", read("virtual"))
        self.log = [tuple(r) for r in read("metrics").collect()]
        return self

    def run(self, train: DataFrame, val: DataFrame, dev: DataFrame, folder: str, max_steps: int, batch_size: int = 50000, val_every: int = 10, save_every: int = 50, evolve_every: int | None = None, seed: int = 0) -> int:
        """Train; the best step on ``val`` among the saved ones that are past edge_patience, to which the state goes back.

        With ``evolve_every`` the edges evolve every so many steps. 0 where no step counts.
        """
        best, best_step = -np.inf, 0
        for batch in minibatches(train, batch_size, seed=seed):
            self.train_step(batch)
            if evolve_every and self.step % evolve_every == 0:
                self.log.append((self.step, "train", "promoted", float(self.engine.update_edges(self.trainer.policy))))
            if self.step % val_every == 0:
                got = self.evaluate(val, "val")
                if got > best and self.step % save_every == 0 and self.step >= self.engine.edge_patience:
                    best, best_step = got, self.step
            if self.step % save_every == 0:
                self.evaluate(dev)
                self.save(f"{folder}/{self.step}")
            if self.step >= max_steps:
                break
        if best_step:
            self.restore(f"{folder}/{best_step}")
        return best_step

    def history(self) -> DataFrame:
        """(step, reward) of the training batches, for the curves of :mod:`simloom.operators.learning`."""
        return self.metrics().where("prefix = 'train' and name = 'mean_reward'").select("step", F.col("value").alias("reward"))
