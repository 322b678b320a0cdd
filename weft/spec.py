"""Streams: ordered, typed columns. A stream keeps its order in explicit columns; rows of a DataFrame have none."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("serial", "struct", "numeric", "string")
#: Conversions that a plan may add by itself, in order of preference.
IMPLICIT = (("numeric", "struct"), ("struct", "serial"), ("numeric", "serial"))
WIDTHS = (1, 2, 4, 8)


@dataclass(frozen=True)
class StreamSpec:
    """What is known of a stream when a plan is built. meta: integers by name (cluster tag, channel)."""

    name: str
    kind: str
    width: int | None = None
    signed: bool = False
    meta: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")
        if self.kind == "numeric" and self.width not in WIDTHS:
            raise ValueError("numeric streams are 1, 2, 4 or 8 bytes wide")


def coerce(spec: StreamSpec, accepted: set[str]) -> list[str]:
    """Kinds that a stream passes through to be accepted, its own first; ValueError if none leads there."""
    if spec.kind in accepted:
        return [spec.kind]
    for source, target in IMPLICIT:
        if source == spec.kind and target in accepted:
            return [source, target]
    raise ValueError(f"{spec.kind} is not accepted as {sorted(accepted)}")


def within(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def chunked(df: DataFrame, position: str, rows: int, out: str = "chunk_id") -> DataFrame:
    """Chunk of a dense position or key: rows of neighbouring keys, at most `rows` keys each; no shuffle."""
    return df.withColumn(out, F.floor(F.col(position) / rows).cast("long"))


def numbered(df: DataFrame, order: list[str], out: str = "ord") -> DataFrame:
    """Adds the global position by order, without bringing the rows to one task: range partitions are sorted and counted."""
    from pyspark.sql.types import LongType, StructField, StructType

    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    placed = placed.persist()  # the bounds of the ranges are drawn anew by every run
    counts = {r[0]: (r[1], r[2]) for r in placed.groupBy("_part").agg(F.min("_id"), F.count("*")).collect()}
    before, rows = 0, []
    for part in sorted(counts):
        rows.append((part, before - counts[part][0]))
        before += counts[part][1]
    shift = df.sparkSession.createDataFrame(rows, "_part int, _shift long")
    return placed.join(F.broadcast(shift), "_part").withColumn(out, F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def unsigned(c: Column, width: int) -> Column:
    """Value of a signed integer of `width` bytes as unsigned; 8 bytes become decimal(20, 0)."""
    if width == 8:
        return F.when(c < 0, c.cast("decimal(20,0)") + F.lit(Decimal(1 << 64))).otherwise(c.cast("decimal(20,0)"))
    return F.pmod(c.cast("long"), F.lit(1 << 8 * width))


def modular(c: Column, width: int) -> Column:
    """c reduced modulo 2 ** (8 width); decimals for 8 bytes."""
    if width == 8:
        return F.pmod(c.cast("decimal(38,0)"), F.lit(Decimal(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)")
    return F.pmod(c, F.lit(1 << 8 * width))


def epoch_micros(c: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def bit_width(c: Column) -> Column:
    """Bits of a non-negative long, 0 for 0."""
    return F.when(c > 0, F.length(F.bin(c))).otherwise(0)


def byte_width(c: Column) -> Column:
    """Least of 1, 2, 4, 8 bytes that hold a non-negative long."""
    return F.when(c < 1 << 8, 1).when(c < 1 << 16, 2).when(c < 1 << 32, 4).otherwise(8)
