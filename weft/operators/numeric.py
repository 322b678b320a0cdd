"""Numeric transforms. Positional ones take the chunk columns `by` and the unique order `order`; one window serves many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import bit_width, byte_width, modular, unsigned, within

# -- differences ---------------------------------------------------------------------------------------------------------


def delta(value: Column, by: list[str], order: list[str]) -> Column:
    """First value as it is, then differences; for values whose differences fit a long."""
    return value - F.lag(value, 1, 0).over(within(by, order))


def delta_decode(value: Column, by: list[str], order: list[str]) -> Column:
    return F.sum(value).over(within(by, order).rowsBetween(Window.unboundedPreceding, 0))


def delta_modular(value: Column, width: int, by: list[str], order: list[str]) -> Column:
    """Differences of unsigned integers modulo 2 ** (8 width)."""
    lifted = unsigned(value, width)
    if width == 8:
        lifted = lifted.cast("decimal(38,0)")
    return modular(lifted - F.coalesce(F.lag(lifted, 1).over(within(by, order)), F.lit(0)), width)


def delta_modular_decode(value: Column, width: int, by: list[str], order: list[str]) -> Column:
    rows = within(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return modular(F.sum(value.cast("decimal(38,0)") if width == 8 else value).over(rows), width)


def zigzag(value: Column) -> Column:
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def unzigzag(value: Column) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-value.bitwiseAND(F.lit(1)))


# -- ranges and divisors -------------------------------------------------------------------------------------------------


def range_pack(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds packed (value less the chunk's minimum), base, packed_width (least bytes for the chunk's range)."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("base", low).withColumn("packed", F.col(value) - low).withColumn("packed_width", byte_width(high - low))


def range_unpack(df: DataFrame) -> Column:
    return F.col("packed") + F.col("base")


def divide_by(value: Column, divisor: int) -> Column:
    """Quotient; the query fails if a value is not divisible."""
    if divisor <= 0:
        raise ValueError("a divisor is at least 1")
    whole = F.assert_true(value % divisor == 0, F.lit("not divisible"))
    return F.when(whole.isNull(), value.cast("long") / divisor).cast("long") if divisor > 1 else value.cast("long")


def gcd_by(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Greatest common divisor of a column by group: within tasks first, then of the tasks' results."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema) + ", g long"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            some = rows.groupby(by, dropna=False)["g"].agg(lambda x: int(np.gcd.reduce(x.to_numpy("int64")))).reset_index()
            held = some if held is None else pd.concat([held, some]).groupby(by, dropna=False)["g"].agg(lambda x: int(np.gcd.reduce(x.to_numpy("int64")))).reset_index()
        if held is not None:
            yield held[[*by, "g"]]

    @F.pandas_udf("long")
    def whole(parts: pd.Series) -> pd.Series:
        return parts.map(lambda x: int(np.gcd.reduce(np.asarray(x, "int64"))))

    parts = df.select(*by, F.col(value).cast("long").alias("g")).where("g is not null").mapInPandas(partial, schema)
    return parts.groupBy(*by).agg(whole(F.collect_set("g")).alias("gcd"))


def divide_by_gcd(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds divisor (the greatest common divisor of the group, 1 if all values are 0 or null) and quotient; divide_by_decode gives value again."""
    found = gcd_by(df, value, by).select(*by, F.greatest("gcd", F.lit(1)).alias("divisor"))
    joined = df.join(found, by, "left") if by else df.crossJoin(found)
    return joined.withColumn("divisor", F.coalesce("divisor", F.lit(1).cast("long"))).withColumn("quotient", F.expr(f"`{value}` div divisor"))


def divide_by_decode(quotient: Column, divisor: Column) -> Column:
    return quotient * divisor


# -- quantisation --------------------------------------------------------------------------------------------------------


def quantize_offsets(value: Column) -> tuple[Column, Column, Column]:
    """(code, extra bits, number of them); 0 is an error."""
    sure = F.when(F.assert_true(value > 0, F.lit("offsets are not 0")).isNull(), value)
    code = bit_width(sure) - 1
    return code, value - _power(code), code


def _power(n: Column) -> Column:
    """2 ** n as a long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def quantize_lengths(value: Column) -> tuple[Column, Column, Column]:
    """(code, extra bits, number of them): below 16 the value itself, else its power of two plus 12."""
    power = bit_width(value) - 1
    return F.when(value < 16, value).otherwise(power + 12), F.when(value < 16, 0).otherwise(value - _power(power)), F.when(value < 16, 0).otherwise(power)


def unquantize(code: Column, extra: Column, first: int = 0, shift: int = 0) -> Column:
    """Value of a code of quantize_offsets (first 0, shift 0) or quantize_lengths (first 16, shift 12)."""
    return F.when(code < first, code.cast("long")).otherwise(_power(code - shift) + extra)


def preset_sizes(name: str) -> tuple[int, list[int]]:
    """(first value, bucket sizes) of a named partition."""
    if name == "offsets":
        return 1, [1 << i for i in range(32)]
    if name == "lengths":
        return 0, [1] * 16 + [1 << i for i in range(4, 32)]
    if name == "varbyte16":
        return 0, [2] + [1 << i for i in range(1, 16)]
    raise ValueError(f"unknown partition {name}")


def partition(value: Column, start: int, sizes: list[int]) -> tuple[Column, Column, Column]:
    """(bucket, offset within it, offset bits) over at most 256 ordered buckets; values outside are an error."""
    if not 0 < len(sizes) <= 256 or min(sizes) <= 0 or start + sum(sizes) > 1 << 64:
        raise ValueError("1 to 256 buckets of at least one value within 64 bits")
    starts = [start]
    for size in sizes:
        starts.append(starts[-1] + size)
    inside = F.assert_true((value >= start) & (value < min(starts[-1], (1 << 63) - 1)), F.lit("outside of all buckets"))
    table = F.array(*[F.lit(s).cast("long") for s in starts[:-1]])
    bits = F.array(*[F.lit((s - 1).bit_length()) for s in sizes])
    bucket = F.when(inside.isNull(), F.size(F.filter(table, lambda s: s <= value)) - 1)
    return bucket, value - F.element_at(table, bucket + 1), F.element_at(bits, bucket + 1)


# -- exceptions and sparse values ----------------------------------------------------------------------------------------


def sentinel_byte(df: DataFrame, value: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, small: below 255, or 255 where the value is an exception), (keys, value of exceptions)"""
    return df.select(*keys, F.least(F.col(value), F.lit(255)).alias("small")), df.where(F.col(value) >= 255).select(*keys, value)


def sentinel_columns(value: Column) -> tuple[Column, Column]:
    """(small, large or null) of one row, for both streams from one scan."""
    return F.least(value, F.lit(255)), F.when(value >= 255, value)


def sentinel_byte_decode(small: DataFrame, large: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return small.join(large, keys, "left").select(*keys, F.coalesce(F.col(value), F.col("small").cast("long")).alias(value))


def sentinel_num(df: DataFrame, value: str, exception: Column, sentinel: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, masked: sentinel at the exceptions), (keys, value of exceptions). A value that is the sentinel is an exception too."""
    there = exception | (F.col(value) == sentinel)
    return df.select(*keys, F.when(there, F.lit(sentinel)).otherwise(F.col(value)).alias("masked")), df.where(there).select(*keys, value)


def sentinel_num_decode(masked: DataFrame, exceptions: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return masked.join(exceptions, keys, "left").select(*keys, F.coalesce(F.col(value), F.col("masked").cast("long")).alias(value))


def sparse(df: DataFrame, value: str, by: list[str], order: list[str], dominant: int = 0) -> DataFrame:
    """(by, run, distance, literal): dominant values before each other value; a last row without literal has those at the end."""
    other = (F.col(value) != dominant).cast("long")
    rows = df.withColumn("run", F.sum(other).over(within(by, order).rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.coalesce("run", F.lit(0)))
    return rows.groupBy(*by, "run").agg((F.count("*") - F.sum(other)).alias("distance"), F.max(F.when(F.col(value) != dominant, F.col(value))).alias("literal"))


def sparse_decode(runs: DataFrame, by: list[str], dominant: int = 0) -> DataFrame:
    """(by, run, place, value) in the original order of (run, place)."""
    count = F.col("distance") + F.col("literal").isNotNull().cast("long")
    filled = runs.where(count > 0).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return filled.select(*by, "run", "place", F.when(F.col("place") < F.col("distance"), F.lit(dominant)).otherwise(F.col("literal")).alias("value"))


def dominant_by(df: DataFrame, value: str, by: list[str], order: list[str], first: int = 4096) -> DataFrame:
    """Majority vote over the first rows of each chunk, in order; 0 if no vote is left."""
    place = F.row_number().over(within(by, order))
    head = df.withColumn("_place", place).where(F.col("_place") <= first).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_place", F.col(value).cast("long").alias("v")))), lambda s: s["v"]).alias("vs"))
    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("votes"))
    vote = F.aggregate(
        "vs",
        start,
        lambda a, v: F.when(a["votes"] == 0, F.struct(v.alias("value"), F.lit(1).alias("votes")))
        .when(a["value"] == v, F.struct(a["value"].alias("value"), (a["votes"] + 1).alias("votes")))
        .otherwise(F.struct(a["value"].alias("value"), (a["votes"] - 1).alias("votes"))),
    )
    return head.select(*by, F.when(vote["votes"] > 0, vote["value"]).otherwise(0).cast("long").alias("dominant"))


# -- runs and ranges -----------------------------------------------------------------------------------------------------


def run_ids(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds run: strictly increasing runs, counted from 0."""
    w = within(by, order)
    stop = (F.col(value) <= F.lag(value).over(w)).cast("long")
    return df.withColumn("_stop", F.coalesce(stop, F.lit(0))).withColumn("run", F.sum("_stop").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_stop")


def merge_sorted(df: DataFrame, value: str, by: list[str], order: list[str], most: int = 64) -> DataFrame:
    """(by, value, runs: bit r is set if run r has it) for up to 64 strictly increasing runs; more are an error."""
    rows = run_ids(df, value, by, order)
    sure = F.when(F.assert_true(F.col("run") < most, F.lit("too many runs")).isNull(), F.col("run"))
    return rows.groupBy(*by, value).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), sure.cast("int"))).alias("runs"))


def merge_sorted_decode(merged: DataFrame, value: str, by: list[str], most: int = 64) -> DataFrame:
    """(by, run, value) in the original order of (run, value)."""
    rows = merged.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    return rows.where(F.call_function("shiftright", F.col("runs"), F.col("run")).bitwiseAND(F.lit(1)) == 1).select(*by, "run", value)


#: Least segment of one-byte, two-byte and wider values; blocks compared on each side; how often the usual amplitude a
#: gap has to be; tenths of the widest block that a level stretch may span.
SEGMENT_LEAST, SEGMENT_WIDE = {1: 128, 2: 64}, 32
COMPARED, GAP, LEVEL_TENTHS = 7, 2, 13


def range_cuts(x: np.ndarray, least: int) -> list[int]:
    """Positions where integers x pass from one value range to another that it does not meet.

    x is seen as blocks of half the least segment. A cut lies behind block b if the up to COMPARED blocks up to b since the
    last cut and the COMPARED blocks from b + 2 on are ranges that do not meet, and the gap or the block between is over GAP
    times as wide as the widest block of both, or neither side drifts. It is placed where the gap between all of the segment
    before and all behind is widest, two blocks around.
    """
    size = max(least // 2, 1)
    firsts = np.arange(0, len(x), size)
    n = len(firsts)
    if len(x) < 2 * least or n < 3:
        return []
    low, high = np.minimum.reduceat(x, firsts).tolist(), np.maximum.reduceat(x, firsts).tolist()
    wide = min(COMPARED, (n - 1) // 2)
    behind, b, start = [], wide - 1, 0
    while b + wide + 1 < n:
        left, right = slice(max(b - wide + 1, start), b + 1), slice(b + 2, b + wide + 2)
        if b + 1 - left.start < min(wide, 2):
            b += 1
            continue
        sides = [(min(low[s]), max(high[s]), max(h - w for w, h in zip(low[s], high[s]))) for s in (left, right)]
        gap = max(sides[1][0] - sides[0][1], sides[0][0] - sides[1][1])
        usual = max(sides[0][2], sides[1][2])
        level = all(10 * (top - bottom) <= LEVEL_TENTHS * widest for bottom, top, widest in sides)
        if gap > 0 and (usual == 0 or gap > GAP * usual or high[b + 1] - low[b + 1] > GAP * usual or level):
            behind.append(b)
            start = b + 2
            b += 2
        else:
            b += 1
    cuts = [0]
    for i, b in enumerate(behind):
        end = min(len(x), (behind[i + 1] + 1) * size) if i + 1 < len(behind) else len(x)
        zone, stop = max(cuts[-1] + 1, (b - 1) * size), min(len(x), (b + 3) * size, end)
        before, after = x[cuts[-1] : stop], x[zone:end][::-1]
        below, above = np.maximum.accumulate(before)[zone - cuts[-1] - 1 : -1], np.minimum.accumulate(before)[zone - cuts[-1] - 1 : -1]
        least_after, most_after = np.minimum.accumulate(after)[::-1][: stop - zone], np.maximum.accumulate(after)[::-1][: stop - zone]
        up, down = least_after > below, most_after < above
        gaps = np.where(up, least_after.view("u8") - below.view("u8"), np.where(down, above.view("u8") - most_after.view("u8"), np.uint64(0)))
        cut = zone + int(gaps.argmax()) if (up | down).any() else (b + 1) * size
        if cut - cuts[-1] >= least and len(x) - cut >= least:
            cuts.append(cut)
    return cuts[1:]


def split_byrange(df: DataFrame, value: str, by: list[str], ord_col: str, width: int = 4, least: int | None = None) -> DataFrame:
    """(by, segment, first_ord, last_ord, low, high): where stretches of a chunk take up separate value ranges (range_cuts); a chunk bounds the task."""
    least = least or SEGMENT_LEAST.get(width, SEGMENT_WIDE)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ord_col)
        x, place = rows[value].to_numpy("int64"), rows[ord_col].to_numpy("int64")
        cuts = [0, *range_cuts(x, least)]
        ends = [*cuts[1:], len(x)]
        out = pd.DataFrame({"segment": np.arange(len(cuts)), "first_ord": place[cuts], "last_ord": [place[e - 1] for e in ends], "low": [x[s:e].min() for s, e in zip(cuts, ends)], "high": [x[s:e].max() for s, e in zip(cuts, ends)]})
        for c in reversed(by):
            out.insert(0, c, rows[c].iloc[0])
        return out

    return df.select(*by, ord_col, value).groupBy(*by).applyInPandas(walk, keys + ", segment long, first_ord long, last_ord long, low long, high long")


def dedup(df: DataFrame, columns: list[str], out: str, trusted: bool = False) -> DataFrame:
    """One column for several equal ones; the query fails if they differ, unless trusted."""
    same = F.lit(True)
    for c in columns[1:]:
        same = same & F.col(columns[0]).eqNullSafe(F.col(c))
    value = F.col(columns[0])
    sure = value if trusted else F.when(F.assert_true(same, F.lit("columns differ")).isNull(), value)
    return df.withColumn(out, sure).drop(*[c for c in columns if c != out])


def constant(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, n); the query fails if a group has more than one value."""
    rows = df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return rows.select(*by, F.when(F.assert_true(F.col("low") == F.col("high"), F.lit("not constant")).isNull(), F.col("low")).alias("value"), "n")
