"""Column expressions over vectors, edges' states and rewards.

Distances and losses are computed in double precision, whatever the vectors' type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = 0.99989, 0.00011  # fixed values: the probabilities from which an edge counts as decided


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance over all dimensions."""
    return total(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def negative_dot(a: Column | str, b: Column | str) -> Column:
    """Negative inner product."""
    return -total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y))


def distance(a: Column | str, b: Column | str, metric: str = "auto", dim: int | None = None) -> Column:
    """``l2`` or ``dot``; ``auto`` takes dot for 300 dimensions, as word vectors have, else l2."""
    if metric == "auto":
        metric = "dot" if dim == 300 else "l2"
    return {"l2": squared_l2, "dot": negative_dot}[metric](a, b)


def norm(a: Column | str) -> Column:
    return F.sqrt(total(F.transform(col(a), lambda x: x.cast("double") * x)))


def scaled(a: Column | str, by: Column) -> Column:
    return F.transform(col(a), lambda x: x.cast("double") / by)


def uniform(query: Column, hop: Column, slot: Column, seed: int = 0) -> Column:
    """A reproducible number in (0, 1) for each (query, hop, slot)."""
    n = query.cast("long") * 7919 + hop.cast("long") * 104729 + slot.cast("long") * 1299709 + F.lit(seed * 15485863).cast("long")
    return (n % 1000003 + 0.5) / 1000003


def frozen(prob: Column, confidence: Column, patience: int) -> Column:
    """The probability of an edge after freezing: 1.1 or -0.1 once its confidence is at the patience."""
    return F.when(confidence == patience, F.lit(1.1)).when(confidence == -patience, F.lit(-0.1)).otherwise(prob)


def next_confidence(prob: Column, confidence: Column) -> Column:
    """Confidence after one scoring: steps up or down while decided, back to 0 when not."""
    step = confidence + F.when((prob < 1) & (prob > UPPER), F.lit(1.0)).otherwise(F.lit(0.0))
    step = step - F.when((prob > 0) & (prob < LOWER), F.lit(1.0)).otherwise(F.lit(0.0))
    reset = F.when((step > 0) & (prob < UPPER), F.lit(0.0)).otherwise(step)
    return F.when((reset < 0) & (prob > LOWER), F.lit(0.0)).otherwise(reset)


def recall(best_ids: Column, truth: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(best_ids, 1, k), F.slice(truth, 1, k))) / F.lit(float(k))


def reward_max_dcs(best_ids: Column, truth: Column, dcs: Column, max_dcs: int = 1000, k: int = 1, scale: bool = False) -> Column:
    """Recall times the distance computations left, one at least."""
    out = recall(best_ids, truth, k) * F.greatest(F.lit(max_dcs) - dcs, F.lit(1))
    return out / max_dcs if scale else out


def reward_recall(best_ids: Column, truth: Column) -> Column:
    return (F.get(best_ids, F.lit(0)) == F.get(truth, F.lit(0))).cast("double")


def reward_weighted_recall(best_ids: Column, truth: Column, decay: float = 0.5) -> Column:
    """decay to the power of the answer's place in the ground truth; 0 if it isn't there."""
    at = F.array_position(truth, F.get(best_ids, F.lit(0)))
    return F.when(at > 0, F.pow(F.lit(decay), at - 1)).otherwise(F.lit(0.0))


def reward_none(best_ids: Column, truth: Column, dcs: Column) -> Column:
    """0 for all, for evaluations that only measure."""
    return F.lit(0.0)


def hex_color(rgba: Column) -> Column:
    """#rrggbb or #rrggbbaa of channels in [0, 1]; other input gives null."""
    ok = F.forall(rgba, lambda c: (c >= 0) & (c <= 1)) & F.size(rgba).isin(3, 4)
    parts = F.transform(rgba, lambda c: F.lpad(F.lower(F.hex(F.rint(c * 255).cast("long"))), 2, "0"))
    return F.when(ok, F.concat(F.lit("#"), F.array_join(parts, "")))
