"""Set and multiset similarity formulas on counts (O-25 to O-29, O-32, O-37, O-39)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("dice", "jaccard", "overlap", "precision", "recall")


def check_method(method: str, message: str = "Unsupported method") -> str:
    """Raise here, where the plan is built, rather than in a job."""
    if method not in METHODS:
        raise ValueError(f"{message}: {method!r}; choose one of {', '.join(METHODS)}")
    return method


def set_metric(shared: Column, n1: Column, n2: Column, method: str) -> Column:
    """Similarity of two (multi)sets of sizes ``n1`` and ``n2`` (the truth first) with ``shared`` common items, as a double.

    Two empty sets: 1, but 0 for precision and recall. One empty set: 0.
    """
    over = {
        "dice": (2 * shared, n1 + n2),
        "jaccard": (shared, n1 + n2 - shared),
        "overlap": (shared, F.least(n1, n2)),
        "precision": (shared, n2),
        "recall": (shared, n1),
    }[check_method(method)]
    empty = 0.0 if method in ("precision", "recall") else 1.0
    ratio = F.coalesce(F.try_divide(over[0].cast("double"), over[1].cast("double")), F.lit(0.0))
    return F.when((n1 == 0) & (n2 == 0), F.lit(empty)).otherwise(ratio)


def pair_weight(n1: Column, n2: Column) -> Column:
    """Harmonic mean of the two sizes; 0 for two empty sets."""
    return F.coalesce(F.try_divide((2 * n1 * n2).cast("double"), (n1 + n2).cast("double")), F.lit(0.0))


def weighted_mean(parts: list[tuple[Column | float, Column]]) -> Column:
    """Mean of the scores that are not null, their weights scaled to 1; null if there is none or the weights add to 0."""
    zero = F.lit(0.0)
    top, bottom = zero, zero
    for weight, score in parts:
        weight = F.lit(float(weight)) if not isinstance(weight, Column) else weight
        top = top + F.coalesce(weight * score, zero)
        bottom = bottom + F.when(score.isNotNull(), weight).otherwise(zero)
    return F.try_divide(top, bottom)


def blend(structural: Column, behavioral: Column, structural_weight: float = 0.5) -> tuple[Column, Column, Column]:
    """Hybrid score and the two weights in effect; where one score is null the other has all the weight, where both are, none has."""
    if not 0 <= structural_weight <= 1:
        raise ValueError(f"structural_weight must be in [0, 1], not {structural_weight}")
    s, b, w = structural.isNotNull(), behavioral.isNotNull(), float(structural_weight)
    ws = F.when(s & b, w).when(s, 1.0).otherwise(0.0)
    wb = F.when(s & b, 1 - w).when(b, 1.0).otherwise(0.0)
    both = w * structural + (1 - w) * behavioral
    return F.when(s & b, both).otherwise(F.coalesce(structural, behavioral)), ws, wb
