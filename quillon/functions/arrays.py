"""Columns of distributions and logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-12


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalise(target: Column) -> Column:
    """Negative parts as 0, divided by the sum; null without mass or with infinite mass."""
    up = F.transform(target, lambda x: F.greatest(x, F.lit(0.0)))
    mass = total(up)
    return F.when((mass > 0) & (mass < float("inf")), F.transform(up, lambda x: x / mass))


def is_soft(target: Column) -> Column:
    return F.array_max(target) < 1 - 1e-6


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / t))
    mass = total(e)
    return F.transform(e, lambda x: x / mass)


def argmax(a: Column) -> Column:
    """The first place (from 0) of the greatest part."""
    return F.array_position(a, F.array_max(a)) - 1


def top1_correct(p: Column, target: Column) -> Column:
    """Whether the predicted option has the target's greatest mass, up to 1e-9."""
    return F.get(target, argmax(p).cast("int")) >= F.array_max(target) - 1e-9


def nll(p: Column, target: Column) -> Column:
    return -total(F.zip_with(target, p, lambda t, q: t * F.ln(F.least(F.greatest(q, F.lit(CLIP)), F.lit(1.0)))))


def kl(gold: Column, p: Column) -> Column:
    return total(F.zip_with(gold, p, lambda g, q: F.when(g > 0, g * (F.ln(g) - F.ln(F.least(F.greatest(q, F.lit(CLIP)), F.lit(1.0))))).otherwise(0.0)))


def brier(p: Column, target: Column) -> Column:
    return total(F.zip_with(p, target, lambda a, b: (a - b) * (a - b)))


def entropy_bits(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)))


def expected(p: Column, values: Column) -> Column:
    return total(F.zip_with(p, values, lambda a, b: a * b))


def emd2(p: Column, target: Column) -> Column:
    """The summed squares of the differences of cumulated distributions."""
    diff = F.zip_with(p, target, lambda a, b: a - b)
    both = F.aggregate(diff, F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s")), lambda acc, d: F.struct((acc["c"] + d).alias("c"), (acc["s"] + (acc["c"] + d) * (acc["c"] + d)).alias("s")))
    return both["s"]


def one_hot(at: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def uniform_over(options: Column) -> Column:
    return F.transform(options, lambda _: F.lit(1.0) / F.size(options))


def unpermute(row: Column, perm: Column) -> Column:
    """Scores of presented options put back in original order: option perm[j] stands at place j."""
    return F.transform(F.sequence(F.lit(0), F.size(perm) - 1), lambda i: F.get(row, F.array_position(perm, i).cast("int") - 1))


def lr_factor(step: Column, total_steps: int, warmup: int, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine down to the floor."""
    done = F.least(F.lit(1.0), (step - warmup) / max(1, total_steps - warmup))
    return F.when(step < warmup, (step + 1) / max(1, warmup)).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * done)))


def ema_decay(step: Column, decay: float) -> Column:
    return F.least(F.lit(decay), (1 + step) / (10 + step))


def loss(p: Column, target: Column, kind: Column, weight: float = 0.5) -> Column:
    """Cross-entropy, and for ordered options a share of the squared earth mover's distance."""
    return nll(p, target) + F.when(kind == "score", weight * emd2(p, target)).otherwise(0.0)
