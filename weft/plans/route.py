"""Routing by statistics: one aggregation gives the figures of all streams, expressions choose for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least_of(costs: dict[str, Column], raw: Column) -> Column:
    """Name of the strictly least cost below raw, the first of equals; `store` if none is below. Null costs do not count."""
    best, name = raw, F.lit("store")
    for key, cost in costs.items():
        better = cost.isNotNull() & (cost < best)
        name, best = F.when(better, F.lit(key)).otherwise(name), F.when(better, cost).otherwise(best)
    return name


def entropy_backend(rows: DataFrame, min_gain: int = 0) -> DataFrame:
    """Adds backend to size estimates of one-byte streams: store, constant, flatpack, bitpack or entropy."""
    total, coded = F.col("total"), F.col("entropy_bytes")
    gains = lambda c: c + min_gain <= total
    flat, packed = F.col("flatpacked_bytes"), F.col("bitpacked_bytes")
    coded = F.when(gains(coded), F.least(coded, total)).otherwise(total)
    choice = (
        F.when(total <= 1, "store")
        .when(F.col("symbols") == 1, "constant")
        .when((flat < packed) & (flat < coded) & gains(flat), "flatpack")
        .when((flat >= packed) & (packed <= coded) & gains(packed), "bitpack")
        .when(coded < total, "entropy")
        .otherwise("store")
    )
    return rows.withColumn("backend", choice)


#: Streams with fewer elements, and large parts with fewer, are stored.
SMALL_STORE, LARGE_STORE = 50, 100


def small_lengths(n: Column, width: Column, large: Column, large_width: Column) -> Column:
    """Route of a stream of small numbers; large: how many are 255 or more, large_width: bytes that those take."""
    rest = F.when(large < LARGE_STORE, "store").when(large_width == 2, "partition").when(large_width == 4, "quantize").otherwise("generic")
    return F.when(n < SMALL_STORE, "store").when(width == 1, "huffman").otherwise(F.concat(F.lit("sentinel+"), rest))


def generic(kind: str) -> list[str]:
    """Backends by kind of stream."""
    return {"serial": ["zstd"], "struct": ["field_lz"], "numeric": ["to_struct", "field_lz"], "string": ["separate", "zstd", "field_lz"]}[kind]


def clusters(streams: DataFrame, config: DataFrame) -> DataFrame:
    """streams (stream, tag, kind, width, bytes) and config (tag, kind, cluster) to (cluster, members, bytes, concat).

    Streams of one cluster, kind and width go together; tags that config does not name make clusters of their own, and a
    cluster of one member is not concatenated. A tag that config names twice fails.
    """
    named = config.groupBy("tag", "kind").agg(F.count("*").alias("n"), F.first("cluster").alias("cluster"))
    sure = named.select("tag", "kind", F.when(F.assert_true(F.col("n") == 1, F.lit("tag in two clusters")).isNull(), F.col("cluster")).alias("cluster"))
    joined = streams.join(sure, ["tag", "kind"], "left").withColumn("cluster", F.coalesce("cluster", F.concat(F.lit("own-"), F.col("tag").cast("string"))))
    out = joined.groupBy("cluster", "kind", "width").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes"))
    return out.withColumn("concat", F.col("members") > 1)


def gain(pair_cost: Column, a: Column, b: Column) -> Column:
    """Cost of two streams together as a share of their costs apart; below 1 they belong together."""
    return pair_cost / (a + b)


class Boosted:
    """Gradient-boosted trees over a row of features a stream, as expressions: trees are nested tuples (feature, limit, low, high) or leaf values."""

    def __init__(self, classes: list[str], forests: list[list], features: list[str]):
        self.classes, self.forests, self.features = classes, forests, features

    def tree(self, node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        feature, limit, low, high = node
        return F.when(F.col(self.features[feature]) < limit, self.tree(low)).otherwise(self.tree(high))

    def scores(self) -> list[Column]:
        return [sum((self.tree(t) for t in forest), F.lit(0.0)) for forest in self.forests]

    def choose(self) -> Column:
        """Class of the greatest score, the first of equals; with one forest class 1 if its score is above 0."""
        scores = self.scores()
        if len(scores) == 1:
            return F.when(scores[0] > 0, self.classes[1]).otherwise(self.classes[0])
        best, name = scores[0], F.lit(self.classes[0])
        for score, key in zip(scores[1:], self.classes[1:]):
            name, best = F.when(score > best, F.lit(key)).otherwise(name), F.greatest(best, score)
        return name


def fit_stumps(rows: list[tuple[list[float], str]], classes: list[str], features: list[str], rounds: int = 20, rate: float = 0.5) -> Boosted:
    """One-versus-rest boosting of single splits on a row of features a stream; rows are as many as measured streams."""
    import numpy as np

    x = np.asarray([r[0] for r in rows], float).reshape(len(rows), len(features))
    forests = []
    for c in classes:
        y = np.asarray([1.0 if r[1] == c else -1.0 for r in rows])
        f, forest = np.zeros(len(rows)), []
        for _ in range(rounds if len(rows) else 0):
            residual, best = y - f, None
            for j in range(len(features)):
                for limit in np.unique(x[:, j])[1:]:
                    low = x[:, j] < limit
                    a, b = residual[low].mean(), residual[~low].mean()
                    loss = ((residual - np.where(low, a, b)) ** 2).sum()
                    if best is None or loss < best[0] - 1e-12:
                        best = (loss, j, float(limit), float(a), float(b))
            if best is None:
                break
            _, j, limit, a, b = best
            forest.append((j, limit, rate * a, rate * b))
            f += rate * np.where(x[:, j] < limit, a, b)
        forests.append(forest)
    return Boosted(classes, forests, features)
