"""Column statistics, size estimates and features, each from one aggregation over what it needs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import bit_width


def melt(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, stream, value): numeric columns as rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("stream"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.stream", "_p.value")


def histogram(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, value).agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """(by, total, symbols, largest, entropy in bits a value) of a histogram; the total is a window over distinct values only."""
    total = F.sum(n).over(Window.partitionBy(*by)) if by else F.sum(n).over(Window.partitionBy(F.lit(1)))
    p = F.col(n) / F.col("_total")
    return counts.withColumn("_total", total).groupBy(*by).agg(F.sum(n).alias("total"), F.count("*").alias("symbols"), F.max(n).alias("largest"), F.sum(-p * F.log2(p)).alias("entropy"))


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(stream, low, high, n) of all columns in one aggregation."""
    aggs = [a for c in columns for a in (F.min(c).cast("double").alias(f"{c}_low"), F.max(c).cast("double").alias(f"{c}_high"), F.count(c).alias(f"{c}_n"))]
    rows = F.array(*[F.struct(F.lit(c).alias("stream"), F.col(f"{c}_low").alias("low"), F.col(f"{c}_high").alias("high"), F.col(f"{c}_n").alias("n")) for c in columns])
    return df.agg(*aggs).select(F.explode(rows).alias("_r")).select("_r.*")


def cardinality(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """(stream, cardinality, low, high): an estimate with bounds of two standard errors, or exact."""
    if exact:
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stream"), F.col(c).cast("string").alias("v")) for c in columns])).alias("_p")).select("_p.*").where("v is not null").distinct().groupBy("stream").agg(F.count("*").alias("cardinality"))
        return rows.select("stream", "cardinality", F.col("cardinality").alias("low"), F.col("cardinality").alias("high"))
    error = 0.02
    one = df.agg(*[F.approx_count_distinct(c, error).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("stream"), F.col(c).alias("cardinality"), F.floor(F.col(c) * (1 - 2 * error)).alias("low"), F.ceil(F.col(c) * (1 + 2 * error)).alias("high")) for c in columns])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def next_power(n: Column) -> Column:
    """Bits that number n things: 0 for one."""
    return F.when(n <= 1, 0).otherwise(bit_width(n - 1))


def size_estimates(counts: DataFrame, value: str, by: list[str], n: str = "n") -> DataFrame:
    """Bytes of a stream of one-byte values by backend, from its histogram: by, total, symbols, largest, entropy,
    entropy_bytes, bitpacked_bytes, flatpacked_bytes, constant_bytes (null unless one symbol)."""
    most = counts.groupBy(*by).agg(F.max(value).alias("most"))
    rows = entropy(counts, by, n).join(most, by)
    total, symbols = F.col("total"), F.col("symbols")
    varint = F.ceil(F.greatest(bit_width(total), F.lit(1)) / 7)
    return rows.select(
        *by, "total", "symbols", "largest", "entropy",
        F.ceil(F.round(total * F.col("entropy") / 8, 6)).cast("long").alias("entropy_bytes"),
        F.floor((total * next_power(F.col("most") + 1) + 7) / 8).cast("long").alias("bitpacked_bytes"),
        (F.floor((total * next_power(symbols) + 7) / 8) + symbols).cast("long").alias("flatpacked_bytes"),
        F.when(symbols == 1, 1 + varint).cast("long").alias("constant_bytes"),
    )


#: Bytes of a value by type.
WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8}


def features(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """(stream, n, width, cardinality, cardinality_low, cardinality_high, range_size, mean, variance, stddev, skewness, kurtosis).

    Sample variance, excess kurtosis; 0 where undefined. Cardinality and its bounds as in cardinality().
    """
    distinct = cardinality(df, columns, exact).select("stream", "cardinality", F.col("low").alias("cardinality_low"), F.col("high").alias("cardinality_high"))

    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        zero = F.lit(0.0)
        parts = {"n": F.count(x), "width": F.lit(WIDTH.get(df.schema[c].dataType.simpleString(), 8)), "range_size": F.max(x) - F.min(x), "mean": F.avg(x), "variance": F.coalesce(F.var_samp(x), zero), "stddev": F.coalesce(F.stddev_samp(x), zero), "skewness": F.coalesce(F.nanvl(F.skewness(x), zero), zero), "kurtosis": F.coalesce(F.nanvl(F.kurtosis(x), zero), zero)}
        return F.struct(F.lit(c).alias("stream"), *[v.alias(k) for k, v in parts.items()]).alias(c)

    return df.agg(*[one(c) for c in columns]).select(F.explode(F.array(*columns)).alias("_r")).select("_r.*").join(distinct, "stream")


def strides(df: DataFrame, value: str, by: list[str], ord_col: str) -> DataFrame:
    """(by, distance, matches): distances to the last equal value; peaks at multiples of a stride show its period."""
    gap = F.col(ord_col) - F.lag(ord_col).over(Window.partitionBy(*by, value).orderBy(ord_col))
    return df.select(*by, gap.alias("distance")).where("distance >= 1").groupBy(*by, "distance").agg(F.count("*").alias("matches"))


def dimensionality(df: DataFrame, value: str, by: list[str], ord_col: str) -> DataFrame:
    """(by, stride, share): the distance with most matches and its share of all matches."""
    rows = strides(df, value, by, ord_col)
    best = rows.groupBy(*by).agg(F.max(F.struct("matches", -F.col("distance"))).alias("b"), F.sum("matches").alias("all"))
    return best.select(*by, (-F.col("b.col2")).alias("stride"), (F.col("b.matches") / F.col("all")).alias("share"))


def byte_entropies(df: DataFrame, content: str, widths: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """(width, plane, n, entropy) of binaries cut at each width: sums of histograms within tasks, then over them."""

    def count(batches):
        total = {(w, p): np.zeros(256, "int64") for w in widths for p in range(w)}
        for rows in batches:
            for raw in rows[content].dropna():
                raw = np.frombuffer(raw, "uint8")
                for w, p in total:
                    total[w, p] += np.bincount(raw[: len(raw) // w * w][p::w], minlength=256)
        out = [(w, p, s, int(n)) for (w, p), c in total.items() for s, n in enumerate(c) if n]
        yield pd.DataFrame(out, columns=["width", "plane", "symbol", "n"])

    counts = df.select(content).mapInPandas(count, "width int, plane int, symbol int, n long").groupBy("width", "plane", "symbol").agg(F.sum("n").alias("n"))
    return entropy(counts, ["width", "plane"]).select("width", "plane", F.col("total").alias("n"), "entropy")


def guess_width(df: DataFrame, content: str) -> DataFrame:
    """(width, bits): mean entropy of byte planes at each width, the least first: the likely width of values in binaries."""
    return byte_entropies(df, content).groupBy("width").agg(F.avg("entropy").alias("bits"))


def checksum(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, n, checksum): a sum of 64-bit hashes, which does not depend on the order of rows unless a position is among the columns."""
    low = F.xxhash64(*columns).bitwiseAND(F.lit(0xFFFFFFFF))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(low).alias("checksum"))
