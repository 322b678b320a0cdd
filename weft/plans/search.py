"""Search over measured candidates: Pareto fronts, greedy clusters and a genetic search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pareto_front(df: DataFrame, costs: list[str], key: str, by: list[str] | None = None) -> DataFrame:
    """Rows that no other row of the group beats in one cost without losing in another.

    Two costs: a row stays if its second cost is the least of its first, and below that of every smaller first cost, a running
    minimum over the distinct first costs. More costs: batches drop what their own rows beat, the rest are compared.
    """
    by = by or []
    if len(costs) == 2:
        first, second = costs
        least = df.groupBy(*by, first).agg(F.min(second).alias("_least"))
        before = Window.partitionBy(*by).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
        front = least.withColumn("_before", F.min("_least").over(before)).where("_before is null or _least < _before").drop("_before")
        return df.join(front, [*by, first]).where(F.col(second) == F.col("_least")).select(*df.columns)

    def own_front(batches):
        for rows in batches:
            kept = [g.index[ranks(g[costs].to_numpy(float)) == 0] for _, g in (rows.groupby(by, dropna=False) if by else [(None, rows)])] if len(rows) else []
            yield rows.loc[[i for some in kept for i in some]]

    df = df.mapInPandas(own_front, df.schema)
    a, b = df.alias("a"), df.select(*by, *costs, key).alias("b")
    same = F.lit(True)
    for c in by:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    no_worse, better = F.lit(True), F.lit(False)
    for c in costs:
        no_worse = no_worse & (F.col(f"b.{c}") <= F.col(f"a.{c}"))
        better = better | (F.col(f"b.{c}") < F.col(f"a.{c}"))
    return a.join(b, same & no_worse & better, "left_anti")


def crowding(costs: np.ndarray) -> np.ndarray:
    """Distance of each candidate to its neighbours along each cost; infinite at the ends."""
    out = np.zeros(len(costs))
    finite = np.isfinite(costs)
    costs = np.where(finite, costs, costs[finite].max(initial=0.0) + 1)  # what failed lies beyond all others
    for j in range(costs.shape[1]):
        order = np.argsort(costs[:, j], kind="stable")
        x = costs[order, j]
        span = max(float(x[-1] - x[0]), 1e-12)
        out[order[0]] = out[order[-1]] = np.inf
        out[order[1:-1]] += (x[2:] - x[:-2]) / span
    return out


def ranks(costs: np.ndarray) -> np.ndarray:
    """Front of each candidate, 0 for those that none dominates."""
    beats = (costs[:, None, :] <= costs[None, :, :]).all(2) & (costs[:, None, :] < costs[None, :, :]).any(2)
    left, rank, level = np.ones(len(costs), bool), np.zeros(len(costs), int), 0
    while left.any():
        front = left & ~(beats & left[:, None]).any(0)
        rank[front] = level
        left &= ~front
        level += 1
    return rank


def genetic(initial: list[tuple], cost, mutate, cross, population: int = 40, generations: int = 20, mutation: float = 0.2, seed: int = 0) -> list[tuple[tuple, np.ndarray]]:
    """Elitist search over candidates; cost(list of candidates) -> costs, one row each, so that they can be measured together.

    Returns the candidates of the first front with their costs.
    """
    rng = np.random.default_rng(seed)
    pool = list(dict.fromkeys(initial))
    known = dict(zip(pool, np.asarray(cost(pool), float)))

    def pick(order: dict) -> tuple:
        some = [pool[i] for i in rng.integers(len(pool), size=3)]
        some.sort(key=lambda c: order[c])
        return some[0] if rng.random() < 0.9 else some[-1]

    for _ in range(generations):
        costs = np.asarray([known[c] for c in pool])
        rank, crowd = ranks(costs), crowding(costs)
        order = {c: (rank[i], -crowd[i]) for i, c in enumerate(pool)}
        children = []
        for _ in range(population):
            child = cross(pick(order), pick(order), rng)
            children.append(mutate(child, rng) if rng.random() < mutation else child)
        fresh = [c for c in dict.fromkeys(children) if c not in known]
        if fresh:
            known.update(zip(fresh, np.asarray(cost(fresh), float)))
        pool = list(dict.fromkeys([*pool, *children]))
        costs = np.asarray([known[c] for c in pool])
        rank, crowd = ranks(costs), crowding(costs)
        pool = [pool[i] for i in sorted(range(len(pool)), key=lambda i: (rank[i], -crowd[i]))][:population]
    costs = np.asarray([known[c] for c in pool])
    return [(c, k) for c, k, r in zip(pool, costs, ranks(costs)) if r == 0]


def greedy_clusters(single: dict[str, float], pair: dict[tuple[str, str], float]) -> list[list[str]]:
    """Columns, the costliest first, join the cluster where they save most by pair costs, or stay alone.

    The cost of a cluster is that of its members less the savings of its pairs; a column moves while a pass saves anything.
    """
    saving = {}
    for (a, b), cost in pair.items():
        saving[a, b] = saving[b, a] = single[a] + single[b] - cost
    groups: list[list[str]] = [[c] for c in sorted(single, key=lambda c: (-single[c], c))]

    def gain(column: str, group: list[str]) -> float:
        others = [g for g in group if g != column]
        return sum(saving.get((column, g), 0.0) for g in others) / max(1, len(others))

    moved = True
    while moved:
        moved = False
        for column in sorted(single, key=lambda c: (-single[c], c)):
            own = next(g for g in groups if column in g)
            best = max((g for g in groups if g is not own), key=lambda g: (gain(column, g), g), default=None)
            if best is not None and gain(column, best) > gain(column, own) + 1e-9 and gain(column, best) > 0:
                own.remove(column)
                best.append(column)
                groups = [g for g in groups if g]
                moved = True
    return sorted(sorted(g) for g in groups)
