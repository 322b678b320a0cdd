"""Bit-level transforms: shifts and masks as expressions, payload bytes and float bits with numpy over Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import bit_width


def pack_bits_needed(most: Column) -> Column:
    """Bits a value for a maximum: 1 if it is 0."""
    return F.greatest(bit_width(most), F.lit(1))


def bitpack_size(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, bits, packed_bytes)"""
    rows = df.groupBy(*by).agg(F.count(value).alias("n"), pack_bits_needed(F.max(value)).cast("int").alias("bits"))
    return rows.withColumn("packed_bytes", F.ceil(F.col("n") * F.col("bits") / 8).cast("long"))


def bitpack(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """(by, n, bits, payload): values of a chunk in order, low bits first. Chunks bound what a task holds."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(order)[value].to_numpy("uint64")
        bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        flat = (values[:, None] >> np.arange(bits, dtype="uint64") & np.uint64(1)).astype("uint8")
        out = pd.DataFrame({"n": [len(values)], "bits": [bits], "payload": [np.packbits(flat.ravel(), bitorder="little").tobytes()]})
        for c in reversed(by):
            out.insert(0, c, [rows[c].iloc[0]])
        return out

    return df.groupBy(*by).applyInPandas(pack, keys + ", n long, bits int, payload binary")


def bitunpack(payload: bytes, bits: int, n: int | None = None) -> np.ndarray:
    """Integers of `bits` bits; without n as many as the bytes hold."""
    flat = np.unpackbits(np.frombuffer(payload, "uint8"), bitorder="little").astype("uint64")
    n = len(flat) // bits if n is None else n
    return (flat[: n * bits].reshape(n, bits) << np.arange(bits, dtype="uint64")).sum(1, dtype="uint64")


def bitunpack_rows(packed: DataFrame, by: list[str]) -> DataFrame:
    """Inverse of bitpack: (by, place, value)"""
    keys = [f for f in packed.schema if f.name in by]

    def unpack(batches):
        for rows in batches:
            for r in rows.itertuples(index=False):
                values = bitunpack(r.payload, r.bits, r.n).astype("int64")
                yield pd.DataFrame({**{f.name: getattr(r, f.name) for f in keys}, "place": np.arange(len(values)), "value": values})

    return packed.mapInPandas(unpack, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", place long, value long")


def bit_split(value: Column, widths: list[int]) -> list[Column]:
    """Fields of the given numbers of bits, low bits first."""
    out, low = [], 0
    for n in widths:
        out.append(F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << n) - 1)))
        low += n
    if low > 64:
        raise ValueError("over 64 bits")
    return out


def bit_join(fields: list[Column], widths: list[int]) -> Column:
    whole, low = F.lit(0).cast("long"), 0
    for f, n in zip(fields, widths):
        whole = whole.bitwiseOR(F.shiftleft(f.cast("long"), low))
        low += n
    return whole


def split_top8(value: Column, most: Column) -> tuple[Column, Column]:
    """(low bits, top 8 bits) by the effective bits of the maximum; all in the top part if there are 8 or fewer."""
    low = F.greatest(bit_width(most) - 8, F.lit(0)).cast("int")
    top = F.call_function("shiftrightunsigned", value, low)
    return value - F.call_function("shiftleft", top, low), top


def byte_planes(value: Column, width: int) -> list[Column]:
    """Bytes of an integer, the lowest first."""
    return [F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(255)) for i in range(width)]


def from_planes(planes: list[Column]) -> Column:
    return bit_join(planes, [8] * len(planes))


#: Bits of fraction and exponent of each float layout.
FLOATS = {"f16": (10, 5), "bf16": (7, 8), "f32": (23, 8), "f64": (52, 11)}


def float_bits(value: Column, layout: str = "f32") -> Column:
    """Bits of floats as longs; bf16 takes the upper half of the f32 bits."""

    @F.pandas_udf("long")
    def bits(x: pd.Series) -> pd.Series:
        kind, view = {"f16": ("float16", "uint16"), "bf16": ("float32", "uint32"), "f32": ("float32", "uint32"), "f64": ("float64", "int64")}[layout]
        raw = x.to_numpy(kind).view(view).astype("int64")
        return pd.Series(raw >> 16 if layout == "bf16" else raw)

    return bits(value)


def float_from_bits(value: Column, layout: str = "f32") -> Column:
    @F.pandas_udf("double" if layout == "f64" else "float")
    def back(x: pd.Series) -> pd.Series:
        raw = x.to_numpy("int64")
        if layout == "bf16":
            return pd.Series((raw << 16).astype("uint32").view("float32"))
        return pd.Series(raw.astype({"f16": "uint16", "f32": "uint32", "f64": "int64"}[layout]).view({"f16": "float16", "f32": "float32", "f64": "float64"}[layout]))

    return back(value)


def split_float(bits: Column, layout: str = "f32") -> tuple[Column, Column, Column]:
    """(fraction, exponent, sign)"""
    fraction, exponent = FLOATS[layout]
    return tuple(bit_split(bits, [fraction, exponent, 1]))


def deconstruct(bits: Column, layout: str = "f32") -> tuple[Column, Column]:
    """(fraction with the sign as its lowest bit, exponent)"""
    fraction, exponent, sign = split_float(bits, layout)
    return F.shiftleft(fraction, 1).bitwiseOR(sign), exponent


def reconstruct(signed_fraction: Column, exponent: Column, layout: str = "f32") -> Column:
    fraction, bits = FLOATS[layout]
    return bit_join([F.shiftrightunsigned(signed_fraction, 1), exponent, signed_fraction.bitwiseAND(F.lit(1))], [fraction, bits, 1])


def mux_lengths(literals: Column, matches: Column, split: int, bias: int = 0) -> tuple[Column, Column, Column]:
    """(byte, literal overflow, match overflow): the low `split` bits for the literal length, the rest for match length - bias.

    A field whose bits are all ones has the rest of its length in the overflow.
    """
    top, other = (1 << split) - 1, (1 << 8 - split) - 1
    match = matches - bias
    byte = F.least(literals, F.lit(top)).bitwiseOR(F.shiftleft(F.least(match, F.lit(other)), split))
    return byte, F.when(literals >= top, literals - top), F.when(match >= other, match - other)


def mux_decode(byte: Column, literal_rest: Column, match_rest: Column, split: int, bias: int = 0) -> tuple[Column, Column]:
    """(literal length, match length) again."""
    top = (1 << split) - 1
    literals = byte.bitwiseAND(F.lit(top)) + F.coalesce(literal_rest, F.lit(0))
    return literals, F.shiftrightunsigned(byte, split) + F.coalesce(match_rest, F.lit(0)) + bias


def best_mux_split(df: DataFrame, literals: str, matches: str, bias: int = 0) -> DataFrame:
    """(split, overflows) for each split point; one aggregation for all nine."""
    counts = [F.sum((F.col(literals) >= (1 << s) - 1).cast("long") + (F.col(matches) - bias >= (1 << 8 - s) - 1).cast("long")).alias(str(s)) for s in range(9)]
    return df.agg(*counts).select(F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(str(s)).alias("overflows")) for s in range(9)])).alias("x")).select("x.*")
