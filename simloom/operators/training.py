"""Policy optimisation: PPO, its variants on aggregated and on standardised samples, TRPO and its variant in batches.

A step is one barrier stage, whatever the numbers of samples, epochs and
batches. Its narrow samples are written once and dealt to the tasks, each with
the vectors that its samples name, once a vertex; both stay in the task's memory
for the whole step: 56 bytes a sample and 8 a component of a vertex. All tasks
hold the parameters and take the same steps; gradients, losses and Fisher
products are sums over the tasks' rows by :class:`simloom.plans.ring.Ring`. The
first task returns the new parameters. Nothing stays on disk.

Mini-batches are places in a random permutation of the samples' numbers, another
in each epoch, so every batch but the last has ``samples_in_batch`` rows and no
row moves. Barrier stages need all their tasks at once: ``workers`` is at most
the number of cores, and dynamic allocation has to be off.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions.policy import EdgePolicy
from simloom.operators import learning
from simloom.plans import durable
from simloom.plans.ring import Ring

CHUNK, TASK_ROWS = 8192, 4096
_U = np.uint64


def places(numbers: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """The places of ``numbers`` in a random permutation of 0 to n - 1 that ``key`` names.

    Four Feistel rounds over halves of the bits; what falls outside goes through them again.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, salt = _U((1 << half) - 1), [_U(int(x)) for x in np.random.default_rng([abs(k) for k in key]).integers(1, 1 << 62, 4)]
    out, todo = numbers.astype(np.uint64), np.arange(len(numbers))
    while len(todo):
        left, right = out[todo] >> _U(half), out[todo] & mask
        for s in salt:
            f = (right + s) * _U(0x9E3779B97F4A7C15)
            f = (f ^ (f >> _U(29))) * _U(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> _U(32))) & mask)
        out[todo] = (left << _U(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


class Shard:
    """One task's samples in order of their numbers, with the vectors they name, and the ring it adds up on."""

    def __init__(self, ring: Ring, columns: dict[str, np.ndarray], ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids)
        self.ring, self.vectors = ring, vectors[order]
        ends = [np.searchsorted(ids[order], columns[c]) for c in ("from_id", "to_id")]
        known = np.isin(columns["from_id"], ids) & np.isin(columns["to_id"], ids)
        keep = np.argsort(columns["row"])
        keep = keep[known[keep]]
        self.ends = [at[keep] for at in ends]
        self.held = {c: v[keep] for c, v in columns.items()}
        counts = np.zeros(ring.size, np.int64)
        counts[ring.rank] = len(keep)
        counts = ring.total(counts)
        self.n = int(counts.sum())
        self.number = int(counts[: ring.rank].sum()) + np.arange(len(keep))  # without gaps over all tasks
        self.old: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.number)

    def pairs(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.vectors[e[rows]] for e in self.ends], 1)

    def sum(self, part: Callable[[np.ndarray], np.ndarray], size: int, rows: np.ndarray | None = None) -> np.ndarray:
        """The sum of ``part`` over the rows of all tasks, some of them if told, in chunks."""
        rows = np.arange(len(self)) if rows is None else rows
        out = np.zeros(size)
        for i in range(0, len(rows), CHUNK):
            out += part(rows[i : i + CHUNK])
        return self.ring.total(out)

    def first(self, key: np.ndarray, take: int) -> np.ndarray:
        """Which rows are among the ``take``, one at least, of the largest keys of all tasks; of equal ones those of smaller numbers."""
        bits = np.ascontiguousarray(key, np.float64).view(np.uint64)
        bits = np.where(bits >> _U(63), ~bits, bits | _U(1 << 63))  # in the order of the numbers
        chosen, open_ = np.zeros(len(self), bool), np.ones(len(self), bool)
        for value in (bits, (1 << 62) - self.number.astype(np.uint64)):
            for shift in range(56, -1, -8):  # a byte at a time from the top
                digit = ((value >> _U(shift)) & _U(255)).astype(np.int64)
                counts = self.ring.total(np.bincount(digit[open_], minlength=256).astype(np.int64))
                above = np.cumsum(counts[::-1])[::-1] - counts
                cut = int(np.flatnonzero(above < take)[0])
                chosen |= open_ & (digit > cut)
                open_ &= digit == cut
                take -= int(above[cut])
        return chosen | open_


@dataclass
class Trainer:
    """Shared parts; samples have from_id, to_id, action and advantage."""

    policy: EdgePolicy
    entropy_reg: float = 0.01
    samples_in_batch: int = 4096
    seed: int = 0
    done: int = 0  # steps so far; batches of each are dealt differently
    workers: int | None = None  # tasks of a step; None takes one for TASK_ROWS samples, as many as there are cores at most
    standardise: ClassVar[bool] = False
    aggregate: ClassVar[bool] = False
    #: Whether a row's advantage is the sum over its samples already, and the divergence is that of the new policy from the old.
    summed: ClassVar[bool] = False

    def rows(self, samples: DataFrame) -> DataFrame:
        """The samples to learn from as a written table (from_id, to_id, action, advantages, freqs, row)."""
        flat = learning.standardized(samples) if self.standardise else samples
        flat = learning.aggregate_samples(flat) if self.aggregate else flat.select("from_id", "to_id", "action", F.col("advantage").alias("advantages"), F.lit(1).cast("long").alias("freqs"))
        flat = flat.select(*(F.col(c).cast("long").alias(c) for c in ("from_id", "to_id", "action")), F.col("advantages").cast("double").alias("advantages"), F.col("freqs").cast("long").alias("freqs"))
        return durable.table(flat.where("from_id is not null and to_id is not null").withColumn("row", F.monotonically_increasing_id()), "samples")

    def step(self, samples: DataFrame, vertices: DataFrame) -> dict:
        """Updates the policy from samples(from_id, to_id, action, advantage); samples of unknown vertices don't count."""
        rows = self.rows(samples)
        try:
            told = self.stage(rows, vertices)
        finally:
            durable.drop(rows)
        self.done += 1
        return told

    def stage(self, rows: DataFrame, vertices: DataFrame) -> dict:
        """One barrier stage over ``rows``, as :meth:`rows` wrote them."""
        cores = rows.sparkSession.sparkContext.defaultParallelism
        n = self.workers or max(1, min(cores, -(-rows.count() // TASK_ROWS)))
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
        named = dealt.select("shard", F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
        known = named.join(vertices.select("id", F.col("vec").cast("array<double>").alias("vec")), "id").select("shard", "id", "vec")
        both = dealt.unionByName(known, allowMissingColumns=True).repartitionById(n, "shard")
        trainer, secret = self, secrets.token_bytes(32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, list] = {c: [] for c in ("from_id", "to_id", "action", "advantages", "freqs", "row", "id", "vec")}
            for batch in batches:
                vertex = batch.column("id").is_valid()
                some, points = batch.filter(pa.compute.invert(vertex)), batch.filter(vertex)
                for c in held:
                    col = (points if c in ("id", "vec") else some).column(c)
                    held[c].append((col.flatten() if c == "vec" else col).to_numpy(zero_copy_only=False))
            kinds = {"advantages": np.float64, "vec": np.float64}
            flat = {c: np.concatenate([np.zeros(0), *v]).astype(kinds.get(c, np.int64)) for c, v in held.items()}
            ids, vec = flat.pop("id"), flat.pop("vec")
            ring = Ring.of_stage(secret)
            try:
                told = trainer.update(Shard(ring, flat, ids, vec.reshape(len(ids), -1) if len(ids) else np.zeros((0, trainer.policy.d))))
            finally:
                ring.close()
            names, values = list(told), [float(v) for v in told.values()]
            state = [x.tobytes() for x in trainer.state()]
            one = [[state], [names], [values]] if ring.rank == 0 else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(one[0], pa.list_(pa.binary())), pa.array(one[1], pa.list_(pa.string())), pa.array(one[2], pa.list_(pa.float64()))], ["state", "names", "figures"])

        got = both.mapInArrow(run, "state array<binary>, names array<string>, figures array<double>", barrier=True).collect()[0]
        self.take([np.frombuffer(bytes(x)).copy() for x in got["state"]])
        return dict(zip(got["names"], got["figures"], strict=True))

    def state(self) -> list[np.ndarray]:
        """What a step changes, as arrays."""
        return [self.policy.flat]

    def take(self, state: list[np.ndarray]) -> None:
        self.policy.flat = state[0]

    def update(self, shard: Shard) -> dict:
        """One step in a task; every task of the stage takes the same."""
        raise NotImplementedError

    def begin(self, shard: Shard) -> None:
        """Keep the old policy's log probabilities."""
        old = [self.policy.logp(shard.pairs(np.arange(i, min(i + CHUNK, len(shard))))) for i in range(0, len(shard), CHUNK)]
        shard.old = np.concatenate(old) if old else np.zeros((0, 2))

    def terms(self, shard: Shard, flat: np.ndarray, rows: np.ndarray, clip: float | None) -> tuple:
        """Per-row surrogate, divergence of the policies, entropy, weights, and derivatives by the logit of surrogate and entropy."""
        net = EdgePolicy(self.policy.d, self.policy.h, flat=flat)
        f, cache = net.logits(shard.pairs(rows))
        t = net.theta(f)
        p = np.stack([t, 1 - t], 1)
        i, adv, w, old = shard.held["action"][rows], shard.held["advantages"][rows], shard.held["freqs"][rows].astype(np.float64), shard.old[rows]
        each = np.arange(len(i))
        ratio = np.exp(np.log(p[each, i]) - old[each, i])
        free = np.ones(len(i), bool)
        value = ratio * adv
        if clip is not None:
            cut = np.clip(ratio, 1 - clip, 1 + clip) * adv
            free = value <= cut
            value = np.minimum(value, cut)
        entropy = -(p * np.log(p)).sum(1)
        kl = ((p * (np.log(p) - old)) if self.summed else np.exp(old) * (old - np.log(p))).sum(1)
        dt = (t - 1e-4) * (1 - 1e-4 - t) / (1 - 2e-4)  # dtheta/df
        sign = np.where(i == 0, 1.0, -1.0)
        d_value = np.where(free, ratio * adv * sign / p[each, i], 0) * dt
        d_entropy = (np.log(p[:, 1]) - np.log(p[:, 0])) * dt
        return net, cache, value, kl, entropy, w, d_value, d_entropy, dt**2 / (t * (1 - t))

    def gradient(self, shard: Shard, flat: np.ndarray, clip: float | None = None, reg: float | None = None, rows: np.ndarray | None = None) -> tuple[np.ndarray, float, float, float, float]:
        """Gradient of the loss, loss, divergence and entropy, each over the sum of frequencies, and that sum."""
        n, reg = len(flat), self.entropy_reg if reg is None else reg

        def part(some: np.ndarray) -> np.ndarray:
            net, cache, value, kl, entropy, w, d_value, d_entropy, _ = self.terms(shard, flat, some, clip)
            v = np.ones_like(w) if self.summed else w
            return np.concatenate([net.backward(cache, -(v * d_value + reg * w * d_entropy), flat), [-(v * value + reg * w * entropy).sum(), (w * kl).sum(), (w * entropy).sum(), w.sum()]])

        out = shard.sum(part, n + 4, rows)
        return out[:n] / max(out[-1], 1e-300), *(out[n:-1] / max(out[-1], 1e-300)), out[-1]

    def batches(self, shard: Shard, epoch: int) -> Iterator[np.ndarray]:
        """The task's rows of each mini-batch, which are dealt anew in each epoch."""
        batch = places(shard.number, shard.n, (self.seed, self.done, epoch)) // self.samples_in_batch
        order = np.argsort(batch, kind="stable")
        cuts = np.searchsorted(batch[order], np.arange(-(-shard.n // self.samples_in_batch) + 1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield order[a:b]


@dataclass
class PPO(Trainer):
    """Clipped surrogate with Adam, over shuffled mini-batches in each epoch."""

    lr: float = 3e-4
    clip_eps: float = 0.2
    epochs: int = 4
    target_kl: float | None = None
    _m: np.ndarray = field(default=None, repr=False)
    _s: np.ndarray = field(default=None, repr=False)
    _t: int = 0

    def state(self) -> list[np.ndarray]:
        return [self.policy.flat, self._m, self._s, np.array([float(self._t)])]

    def take(self, state: list[np.ndarray]) -> None:
        self.policy.flat, self._m, self._s, self._t = *state[:3], int(state[3][0])

    def update(self, shard: Shard) -> dict:
        """Means over updates, each measured before its update, and the number of epochs."""
        self.begin(shard)
        if self._m is None:
            self._m, self._s = np.zeros_like(self.policy.flat), np.zeros_like(self.policy.flat)
        told, epochs = [], 0
        for epoch in range(self.epochs):
            epochs, met = epoch + 1, []
            for rows in self.batches(shard, epoch):
                g, *numbers, weight = self.gradient(shard, self.policy.flat, self.clip_eps, rows=rows)
                if not weight:
                    continue
                self._t += 1
                self._m = self._m + 0.1 * (g - self._m)
                self._s = self._s + 0.001 * (g**2 - self._s)
                self.policy.flat = self.policy.flat - self.lr * (self._m / (1 - 0.9**self._t)) / (np.sqrt(self._s / (1 - 0.999**self._t)) + 1e-8)
                met.append((*numbers, weight))
            told += met
            shares = np.array([m[3] for m in met])
            if self.target_kl is not None and len(met) and (shares / shares.sum()) @ [m[1] for m in met] > 1.5 * self.target_kl:
                break
        loss, kl, entropy = np.mean([t[:3] for t in told], 0) if told else (0.0, 0.0, 0.0)
        return {"loss": float(loss), "kl": float(kl), "entropy": float(entropy), "epochs": epochs}


@dataclass
class OptimizedPPO(PPO):
    """PPO on standardised samples, equal ones as one row, which stops after an epoch whose divergence exceeds 1.5 target_kl."""

    samples_in_batch: int = 40000
    target_kl: float | None = 0.015
    standardise: ClassVar[bool] = True
    aggregate: ClassVar[bool] = True


@dataclass
class MemoryEfficientPPO(PPO):
    """PPO on standardised samples; old log probabilities are kept with them in any case."""

    standardise: ClassVar[bool] = True


@dataclass
class TRPO(Trainer):
    """Natural gradient by conjugate gradients on Fisher products, with a backtracking line search; entropy is told, but not part of the loss."""

    entropy_reg: float = 0.0
    max_kl: float = 0.01
    damping: float = 0.1
    cg_iters: int = 10
    aggregate: ClassVar[bool] = True
    summed: ClassVar[bool] = True

    @property
    def reg(self) -> float:
        return 0.0

    def leading(self, shard: Shard) -> np.ndarray | None:
        """The task's rows that Fisher products are made from; None for all."""
        return None

    def fisher(self, shard: Shard, v: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The Fisher matrix times ``v``: J'MJ v, which is the second derivative of the divergence at the old policy."""
        flat = self.policy.flat

        def part(some: np.ndarray) -> np.ndarray:
            net, cache, *_, w, _, _, m = self.terms(shard, flat, some, None)
            return np.concatenate([net.backward(cache, w * m * net.forward_product(cache, v, flat), flat), [w.sum()]])

        out = shard.sum(part, len(flat) + 1, rows)
        return out[:-1] / max(out[-1], 1e-300) + self.damping * v

    def update(self, shard: Shard) -> dict:
        """Unless max_kl is 0; loss, divergence and entropy after the update."""
        self.begin(shard)
        measure = lambda p: self.gradient(shard, p, reg=self.reg)[1:4]
        g, loss, *_ = self.gradient(shard, self.policy.flat, reg=self.reg)
        if self.max_kl > 0:
            some = self.leading(shard)
            x = conjugate_gradient(lambda v: self.fisher(shard, v, some), -g, self.cg_iters)
            scale = np.sqrt(max(x @ self.fisher(shard, x, some) / 2, 1e-300) / self.max_kl)
            self.policy.flat = line_search(lambda p: measure(p)[:2], self.policy.flat, x / scale, self.max_kl, loss)
        loss, kl, entropy = measure(self.policy.flat)
        return {"loss": float(loss), "kl": float(kl), "entropy": float(entropy), "epochs": 1}


@dataclass
class EfficientTRPO(TRPO):
    """TRPO whose Fisher products take the first batches of a weighted random order, and whose loss holds the entropy.

    The first 1/fvp_speedup of all batches are taken, fvp_min_batches at least.
    Both values of fvp_type, "fim" and "forward", name the same matrix: the
    products are only taken at the old policy.
    """

    samples_in_batch: int = 100000
    fvp_speedup: int = 5
    fvp_min_batches: int = 10
    fvp_type: str = "fim"

    @property
    def reg(self) -> float:
        return self.entropy_reg

    def leading(self, shard: Shard) -> np.ndarray | None:
        if self.fvp_type not in ("fim", "forward"):
            raise ValueError("fvp_type is fim or forward")
        count = -(-shard.n // self.samples_in_batch)
        take = max(count // self.fvp_speedup, min(self.fvp_min_batches, count)) * self.samples_in_batch
        if take >= shard.n:
            return None
        u = (shard.held["from_id"] * 7919 + shard.held["to_id"] * 104729 + shard.held["action"] * 1299709 + (self.seed + self.done) * 15485863) % 1000003
        key = np.log(shard.held["freqs"]) - np.log(-np.log((u + 0.5) / 1000003))  # a weighted random order, as learning.gumbel_key
        return np.flatnonzero(shard.first(key, take))


def conjugate_gradient(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, iters: int = 10, tol: float = 1e-10) -> np.ndarray:
    """x with product(x) = b."""
    x, r, p = np.zeros_like(b), b.copy(), b.copy()
    rr = r @ r
    for _ in range(iters):
        z = product(p)
        a = rr / (p @ z + 1e-8)
        x += a * p
        r -= a * z
        new = r @ r
        p = r + new / (rr + 1e-8) * p
        rr = new
        if rr < tol:
            break
    return x


def line_search(f: Callable[[np.ndarray], tuple[float, float]], x: np.ndarray, full: np.ndarray, max_kl: float, loss: float) -> np.ndarray:
    """Tries steps of halving size from wherever it got to, keeping each that lowers the loss within the KL bound."""
    for i in range(10):
        new = x + full * 0.5**i
        got, kl = f(new)
        if kl <= max_kl and got < loss:
            x, loss = new, got
    return x
