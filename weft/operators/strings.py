"""Dictionary, string and layout transforms. String lengths and positions are in bytes where a codec's are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import numbered, within

# -- dictionaries --------------------------------------------------------------------------------------------------------


def alphabet_sorted(df: DataFrame, value: str) -> DataFrame:
    """(value, idx): distinct values in ascending order. The distinct values, not the rows, are ranked, by many tasks."""
    return numbered(df.select(value).distinct(), [value], "idx").select(value, "idx")


def alphabet_first(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(value, idx): distinct values by first occurrence in the unique order."""
    firsts = df.groupBy(value).agg(F.min(F.struct(*order)).alias("_first"))
    return numbered(firsts, ["_first"], "idx").select(value, "idx")


def alphabet_given(values: DataFrame, value: str, rank: str) -> DataFrame:
    """(value, idx) of the user's own order."""
    return numbered(values, [rank], "idx").select(value, "idx")


def tokenize(df: DataFrame, value: str, alphabet: DataFrame) -> DataFrame:
    """Replaces value by idx. Spark broadcasts the alphabet if it measures small, else the join shuffles."""
    return df.join(alphabet, value).drop(value)


def detokenize(df: DataFrame, alphabet: DataFrame) -> DataFrame:
    return df.join(alphabet, "idx").drop("idx")


def index_width(symbols: Column) -> Column:
    return F.when(symbols <= 256, 1).when(symbols <= 65536, 2).otherwise(4)


# -- shared prefixes -----------------------------------------------------------------------------------------------------


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes that two binaries share at their start."""
    length = F.least(F.octet_length(a), F.octet_length(b))
    places = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def prefix_encode(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds shared (bytes shared with the string before) and suffix (binary)."""
    raw = F.encode(F.col(value), "UTF-8")
    rows = df.withColumn("_raw", raw).withColumn("_prior", F.lag("_raw").over(within(by, order)))
    shared = F.coalesce(common_prefix(F.col("_raw"), F.col("_prior")), F.lit(0)).cast("long")
    rows = rows.withColumn("shared", shared)
    return rows.withColumn("suffix", F.substring(F.col("_raw"), (F.col("shared") + 1).cast("int"), F.octet_length("_raw"))).drop("_raw", "_prior")


def prefix_decode(df: DataFrame, by: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Rebuilds strings from (shared, suffix) along the order; sequential within a chunk, whose size bounds the task."""
    kept = [f for f in df.schema if f.name in {*by, *order}]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{value}` string"

    def decode(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        out, last = [], b""
        for shared, suffix in zip(rows["shared"], rows["suffix"]):
            last = last[:shared] + bytes(suffix)
            out.append(last.decode())
        return rows[[f.name for f in kept]].assign(**{value: out})

    return df.groupBy(*by).applyInPandas(decode, schema)


# -- numbers in strings --------------------------------------------------------------------------------------------------


def parse_int(text: Column) -> Column:
    """Strict: no sign but -, no leading zero, no -0, no blanks; null if it does not fit 64 bits."""
    return F.when(text.rlike(r"\A(0|-?[1-9][0-9]{0,18})\z"), text.try_cast("bigint"))


def try_parse_int(df: DataFrame, text: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, value) of strings that parse, (keys, text) of the others."""
    rows = df.withColumn("_value", parse_int(F.col(text)))
    return rows.where("_value is not null").select(*keys, F.col("_value").alias("value")), rows.where("_value is null").select(*keys, text)


def parse_float(text: Column) -> Column:
    """A double, only if printing it gives the same text again."""
    value = text.try_cast("double")
    shown = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), F.concat(F.floor(value).cast("string"), F.lit(".0"))).otherwise(value.cast("string"))
    return F.when((shown == text) | (F.regexp_replace(shown, r"\.0\z", "") == text) & text.rlike(r"\A-?(0|[1-9][0-9]*)\z"), value)


def float_streams(df: DataFrame, text: str, by: list[str], position: str) -> tuple[DataFrame, DataFrame]:
    """(by, position, value) of strings that print the same again, (by, position, text) of the exceptions; null strings are in neither."""
    rows = df.where(F.col(text).isNotNull()).withColumn("_value", parse_float(F.col(text)))
    good = rows.where("_value is not null")
    whole = F.col(text).rlike(r"\A-?(0|[1-9][0-9]*)\z")
    return good.select(*by, position, F.col("_value").alias("value"), whole.alias("whole")), rows.where("_value is null").select(*by, position, text)


def float_texts(values: DataFrame, exceptions: DataFrame, text: str, by: list[str], position: str) -> DataFrame:
    """(by, position, text) again from float_streams."""
    x = F.col("value")
    dotted = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.concat(F.floor(x).cast("string"), F.lit(".0"))).otherwise(x.cast("string"))
    shown = F.when(F.col("whole"), F.regexp_replace(dotted, r"\.0\z", "")).otherwise(dotted)
    return values.select(*by, position, shown.alias(text)).union(exceptions.select(*by, position, text))


# -- layout --------------------------------------------------------------------------------------------------------------


def separate(df: DataFrame, text: str, by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, content: all strings of a chunk in order) and (by, order, length in bytes)."""
    lengths = df.select(*by, *[c for c in order if c not in by], F.octet_length(text).cast("long").alias("length"))
    parts = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t")))).alias("_parts"))
    return parts.select(*by, F.encode(F.array_join(F.transform("_parts", lambda p: p["_t"]), ""), "UTF-8").alias("content")), lengths


def set_lengths(content: DataFrame, lengths: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, order, text) again; the query fails if lengths do not add up to the content."""
    w = within(by, order)
    spans = lengths.withColumn("_end", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("length").over(Window.partitionBy(*by)))
    rows = spans.join(content, by)
    sure = F.assert_true(F.col("_all") == F.octet_length("content"), F.lit("lengths do not add up"))
    piece = F.substring(F.col("content"), (F.col("_end") - F.col("length") + 1).cast("int"), F.col("length").cast("int"))
    return rows.select(*by, *[c for c in order if c not in by], F.decode(F.when(sure.isNull(), piece), "UTF-8").alias("text"))


def to_structs(content: Column, width: int) -> Column:
    """A binary as an array of binaries of `width` bytes; null unless it divides."""
    n = F.octet_length(content)
    places = F.when(n > 0, F.sequence(F.lit(0), (n / width - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(n % width == 0, F.transform(places, lambda i: F.substring(content, i * width + 1, F.lit(width))))


def to_number(record: Column, big_endian: bool = False) -> Column:
    """Unsigned value of a binary of 1 to 7 bytes; of 8 as two's complement."""
    return F.conv(F.hex(record if big_endian else _reversed(record)), 16, -10).cast("long")


def _reversed(record: Column) -> Column:
    digits = F.hex(record)
    places = F.sequence(F.octet_length(record), F.lit(1), F.lit(-1))
    return F.unhex(F.array_join(F.transform(places, lambda i: F.substring(digits, i * 2 - 1, F.lit(2))), ""))


def from_number(value: Column, width: int, big_endian: bool = False) -> Column:
    record = F.unhex(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * width, 2 * width))
    return record if big_endian else _reversed(record)


def split_fields(record: Column, widths: list[int]) -> list[Column]:
    """Fixed-offset fields of a binary record; Spark reads only those that are used."""
    out, at = [], 1
    for n in widths:
        out.append(F.substring(record, at, n))
        at += n
    return out


def split_segments(position: Column, sizes: list[int]) -> Column:
    """Segment of a position for consecutive sizes; a last size of 0 takes the rest. Null beyond the last."""
    segment, at = F.lit(None).cast("long"), 0
    for i, n in enumerate(sizes):
        inside = position >= at if n == 0 and i == len(sizes) - 1 else (position >= at) & (position < at + n)
        segment = F.when(inside, F.lit(i).cast("long")).otherwise(segment)
        at += n
    return segment


def dispatch(df: DataFrame, tag: Column, tags: int) -> DataFrame:
    """Adds tag; the query fails if one is outside of 0 to tags - 1. Outputs are filters on it, the inverse is the order."""
    sure = F.assert_true((tag >= 0) & (tag < tags), F.lit("tag out of range"))
    return df.withColumn("tag", F.when(sure.isNull(), tag))


def dispatch_string(df: DataFrame, text: str, index: Column, outputs: int, by: list[str], position: str) -> tuple[DataFrame, list[DataFrame]]:
    """(by, position, index) and, for each output, (by, place: 0 and on within chunk and output, text). Indices outside of 0 to outputs - 1 fail."""
    if not 0 < outputs < 1 << 16:
        raise ValueError("1 to 65535 outputs")
    rows = dispatch(df, index, outputs).select(*by, position, F.col("tag").cast("int").alias("index"), text)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by, "index").orderBy(position)) - 1)
    return rows.select(*by, position, "index"), [rows.where(F.col("index") == i).select(*by, "place", text) for i in range(outputs)]


def dispatch_string_decode(indices: DataFrame, streams: list[DataFrame], text: str, by: list[str], position: str) -> DataFrame:
    """(by, position, text): each index takes the next string of its output."""
    placed = indices.withColumn("place", F.row_number().over(Window.partitionBy(*by, "index").orderBy(position)) - 1)
    whole = None
    for i, s in enumerate(streams):
        part = s.withColumn("index", F.lit(i))
        whole = part if whole is None else whole.unionByName(part)
    return placed.join(whole, [*by, "index", "place"]).select(*by, position, text)


def null_aware(text: Column) -> Column:
    """Channel 0 for empty strings, 1 for others."""
    return F.when(text == "", 0).otherwise(1)


def concat(streams: list[DataFrame], value: str, order: list[str]) -> DataFrame:
    """(src, order, value) of homogeneous streams, one after the other."""
    kinds = {s.schema[value].dataType.simpleString() for s in streams}
    if len(kinds) != 1:
        raise ValueError(f"streams of different types: {sorted(kinds)}")
    whole = None
    for i, s in enumerate(streams):
        part = s.select(F.lit(i).cast("long").alias("src"), *order, value)
        whole = part if whole is None else whole.unionByName(part)
    return whole


def interleave(streams: list[DataFrame], position: str, value: str) -> DataFrame:
    """(ord, value): round robin over streams of equal count by their dense positions; at most 512."""
    if not 0 < len(streams) <= 512:
        raise ValueError("1 to 512 streams")
    whole = None
    for i, s in enumerate(streams):
        part = s.select((F.col(position) * len(streams) + i).cast("long").alias("ord"), value)
        whole = part if whole is None else whole.unionByName(part)
    return whole


def deinterleave(df: DataFrame, n: int, value: str) -> DataFrame:
    return df.select((F.col("ord") % n).alias("src"), F.floor(F.col("ord") / n).cast("long").alias("position"), value)
