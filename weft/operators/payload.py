"""Terminal backends: bytes of a chunk through pyarrow's codecs."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compress(content: Column, codec: str = "zstd") -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda raw: None if raw is None else pa.compress(bytes(raw), codec=codec, asbytes=True))

    return run(content)


def decompress(content: Column, size: Column, codec: str = "zstd") -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if raw is None else pa.decompress(bytes(raw), decompressed_size=int(k), codec=codec, asbytes=True) for raw, k in zip(x, n)])

    return run(content, size)


def chunk_bytes(df: DataFrame, value: str, by: list[str], order: list[str], width: int) -> DataFrame:
    """(by, n, content): little-endian bytes of the values of a chunk in order."""
    from .strings import from_number

    parts = df.groupBy(*by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*order, from_number(F.col(value), width).alias("_b")))).alias("_p"))
    return parts.select(*by, "n", F.unhex(F.array_join(F.transform("_p", lambda p: F.hex(p["_b"])), "")).alias("content"))
