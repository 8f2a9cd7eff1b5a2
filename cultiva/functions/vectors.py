"""Expressions over embedding vectors and class scores held in arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    """Class probabilities; the largest logit is subtracted first."""
    top = F.array_max(logits)
    scaled = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(scaled, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """Position from 0 of the first largest entry."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def class_name(index: Column, classes: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), index)


def flatten(vector: Column, length: int, prefix: str) -> list[Column]:
    """One column per entry, for a wide sink."""
    return [F.get(vector, F.lit(i)).alias(f"{prefix}{i}") for i in range(length)]


def zeros(length: int) -> Column:
    return F.array_repeat(F.lit(0.0), length)
