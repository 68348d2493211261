"""Fitted decision trees as SQL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def total(trees: Sequence, weights: Sequence[float], names: Sequence[str], depth: int, f: Column) -> Column:
    """The weighted sum of what the trees predict for a struct of features.

    All trees' nodes are constant arrays, and a walk of ``depth`` steps leads
    from each root to a leaf, which leads to itself."""
    feature, border, low, high, leaf, roots = [], [], [], [], [], []

    def add(node, weight: float) -> int:
        at = len(feature)
        for column, value in ((feature, 0), (border, 0.0), (low, at), (high, at), (leaf, weight * float(node.prediction()))):
            column.append(value)
        if node.getClass().getSimpleName().startswith("Internal"):
            feature[at], border[at] = node.split().featureIndex(), float(node.split().threshold())
            low[at], high[at] = add(node.leftChild(), weight), add(node.rightChild(), weight)
        return at

    for t, weight in zip(trees, weights):
        roots.append(add(t._call_java("rootNode"), float(weight)))
    features, borders, lows, highs, leaves = (F.lit(x) for x in (feature, border, low, high, leaf))

    def walk(values: Column, root: Column) -> Column:
        step = lambda at, _: F.when(values[features[at]] <= borders[at], lows[at]).otherwise(highs[at])
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, step)

    return once(F.array(*(f[name] for name in names)), lambda values: F.aggregate(F.lit(roots), F.lit(0.0), lambda n, root: n + leaves[walk(values, root)]))
